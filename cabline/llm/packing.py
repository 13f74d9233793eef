"""Packing documents into fixed-length token sequences by minimum bin slack.

Which lengths go together depends only on how many pieces have each length,
so the solver sees a histogram of at most ``capacity`` rows, whatever the data
size. For each bin it takes the longest length left and finds, by a bitset
subset-sum over the lengths left, the fullest completion. That combination is
then removed as often as the counts allow, which uses up at least one length,
so there are at most ``capacity`` combinations. Pieces are numbered within
their length in two levels (cell counts, then rows of a cell) and look up
their combination by number.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cabline.llm.common import LETTER, NOT_PLAIN, NUMBER, id_text, prepare, stored
from cabline.llm.token_counts import _tokenizer

# FIXED VALUES: the tokenizer's split pattern, over plain lower-case characters.
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^\s{LETTER}{NUMBER}]+"
#: Distinct words whose ids a worker keeps in each of two generations.
WORD_STORE = 250_000
#: Pieces of one length in a cell, on average, at most.
CELL_ROWS = 200_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _byte_chars() -> list[str]:
    """The character that stands for each byte: itself if it prints, else the next from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(other)) for b in range(256)]


BYTE_CHARS = _byte_chars()


class WordIds(dict):
    """The ids of words as bytes, from the library's model alone: a word is
    normal already and one pre-token. When full, the words become the old
    generation; those met again come back from it without being encoded."""

    def __init__(self, tokenizer) -> None:
        self.pieces, self.old = tokenizer.model.tokenize, {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= WORD_STORE:
            self.old = dict(self)
            self.clear()
        got = self.old.get(word)
        if got is None:
            text = word if word.isascii() else "".join(map(BYTE_CHARS.__getitem__, word.encode()))
            got = array("I", [p.id for p in self.pieces(text)]).tobytes()
        self[word] = got
        return got


#: Of each tokenizer file; a Python worker keeps it from task to task.
_STORES: dict[str, WordIds] = {}


def _pieces(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(path)
        special = [x.content for x in t.get_added_tokens_decoder().values()]
        find, odd = re.compile(WORDS).findall, re.compile(NOT_PLAIN).search

        store = _STORES.setdefault(path, WordIds(t))
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc, x in zip(b.column(0).to_pylist(), b.column(1)):
                text = x.as_py()
                if odd(text) or any(s in text for s in special):
                    ids = np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
                else:
                    ids = b"".join(map(store.__getitem__, find(text.lower())))
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for c, v in zip(rows, (doc, k, at // 4, len(part) // 4, zlib.crc32(part))):
                        c.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents' ids, then ``end_id``, cut each ``capacity`` ids.

    Texts of plain characters are split and looked up word by word, each
    distinct word being encoded by the library's model; others go through the
    library whole.
    """
    prepare(docs.sparkSession)
    return id_text(docs).mapInArrow(_pieces(tokenizer, end_id, capacity), PIECES)


def fullest(counts: dict[int, int], capacity: int) -> list[int]:
    """The longest length of ``counts`` and, with it, the fullest combination of the others.

    ``reach`` has bit s set if some lengths sum to s. Longer lengths come
    first and the search ends once the bin can be filled, so short ones are
    left for later bins.
    """
    first = max(counts)
    room = capacity - first
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for n in sorted((n for n in counts if n <= room), reverse=True):
        left = min(counts[n] - (n == first), room // n)
        k = 1
        while left > 0:
            take = min(k, left)
            steps.append((n, take, reach))
            reach |= (reach << (n * take)) & mask
            left -= take
            k *= 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, [first]
    for n, take, before in reversed(steps):
        if not before >> at & 1:
            at -= n * take
            out += [n] * take
    return out


def combinations(counts: dict[int, int], capacity: int) -> list[tuple[Counter, int]]:
    """(lengths with how often, number of bins) until ``counts`` is used up."""
    counts, out = {n: k for n, k in counts.items() if k}, []
    while counts:
        use = Counter(fullest(counts, capacity))
        times = min(counts[n] // k for n, k in use.items())
        for n, k in use.items():
            counts[n] -= k * times
            if not counts[n]:
                del counts[n]
        out.append((use, times))
    return out


def _places(found: list[tuple[Counter, int]]):
    """For each length: first numbers, pieces a bin, first bin, offset in the bin."""
    table: dict[int, list] = {}
    used: Counter = Counter()
    bins = 0
    for use, times in found:
        at = 0
        for n, k in sorted(use.items(), reverse=True):
            table.setdefault(n, []).append((used[n], k, bins, at))
            used[n] += k * times
            at += n * k
        bins += times
    return {n: np.array(v, np.int64) for n, v in table.items()}


def _place(table: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            bin_, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                here, t = np.flatnonzero(length == n), table[int(n)]
                row = t[np.searchsorted(t[:, 0], rank[here], side="right") - 1]
                k = rank[here] - row[:, 0]
                bin_[here], offset[here] = row[:, 2] + k // row[:, 1], row[:, 3] + k % row[:, 1] * n
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(bin_), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """``pieces`` (PIECES) with sequence_id and offset; a sequence holds ``capacity`` ids at most.

    Offsets of a sequence are gapless from 0. Repeated rows are pieces of their
    own. To the driver come the counts of each length, ``capacity`` rows at
    most; the table of combinations sent to the tasks has at most a few rows
    per length. A length that very many pieces share is numbered in cells by
    the hash of the row, so it is no single task.
    """
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    table = _places(combinations(counts, capacity))
    cells = max(8, -(-max(counts.values(), default=0) // CELL_ROWS))
    rows = pieces.withColumn("cell", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(cells)).cast("int"))
    before = rows.groupBy("length", "cell").count().withColumn(
        "before", F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    own = F.row_number().over(Window.partitionBy("length", "cell").orderBy("doc_id", "piece", "ids_crc32")) - 1
    numbered = rows.withColumn("own", own).join(before.select("length", "cell", "before"), ["length", "cell"])
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own")).alias("rank"))
    return numbered.mapInArrow(_place(table), f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Each piece of each document with its place (see ``token_pieces`` and ``pack``).

    A null or empty text is one piece of ``end_id`` alone. A repeated row is a
    document of its own, a null doc_id stays null, an empty table gives an
    empty result, other columns are left out. Pieces are stored once, so texts
    are tokenized once.
    """
    return pack(stored(token_pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)

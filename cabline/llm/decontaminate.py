"""Benchmark decontamination by greedy string tiling.

Documents and test items are word sequences. A seed is a run of SEED words,
named by a rolling 64-bit fingerprint; an item of fewer words is one seed as a
whole. The items' seeds are a table, joined with the documents' seeds, and a
bit array of the items' seeds, of bounded size, first rules out most of the
documents' ones where the texts are. The seeds shared by a document and an
item form diagonals: the longest run on any diagonal that touches no marked
word becomes a tile and is marked, again and again, until none is left. The
item's share of marked words is the coverage: it doesn't depend on the order
of the tiles, so reordered passages are caught.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cabline.llm.common import id_text, prepare, stored

#: Words of a seed and of the shortest tile.
SEED = 4
#: An item is leaked if tiles cover at least this share of its words.
COVERAGE = 0.6
#: Bits of the array for each seed, and their bounds: 64 MB are sent to a task at most; with more seeds it rules out less.
BITS_A_SEED, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 29
#: Distinct words whose hash a task keeps; when full, the store starts anew.
WORD_STORE = 350_000

# FIXED VALUE: a word; characters of scripts without spaces are words.
_ALONE = "぀-ヿ㐀-鿿가-힣\U00020000-\U0003134f"
WORD = re.compile(rf"[{_ALONE}]|[^\W{_ALONE}]+")
_A = np.uint64(0xD1342543DE82EF95)
HITS = "row long, doc_id long, seed long, at int"
SEEDS = "item_id long, text_id long, n_words int, seed long, to int"
PAIRS = "doc_id long, item_id long, n_words int, n_covered int, n_tiles int, longest int"


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > WORD_STORE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode())
        return h


def fingerprints(hashes: np.ndarray, size: int) -> np.ndarray:
    """The fingerprint of the ``size`` words from each position on."""
    n = len(hashes) - size + 1
    out = np.full(max(0, n), size, np.uint64)
    for k in range(size if n > 0 else 0):
        out = out * _A + hashes[k : k + n]
        out ^= out >> np.uint64(29)
    return out * _A


def seed_size(n_words: int) -> int:
    return min(SEED, n_words)


def tile(at: np.ndarray, to: np.ndarray, n_doc: int, n_item: int, seed: int = SEED) -> list[tuple[int, int, int]]:
    """Tiles (document start, item start, words) from seed hits: ``at`` in the document, ``to`` in the item."""
    out = []
    order = np.lexsort((to, at - to))
    at, to = at[order], to[order]
    doc, item = np.zeros(n_doc + 1, np.int64), np.zeros(n_item + 1, np.int64)
    while len(at):
        head = np.flatnonzero(np.r_[True, (np.diff(at - to) != 0) | (np.diff(to) != 1)])
        size = np.diff(np.r_[head, len(at)]) + seed - 1
        best = min(np.flatnonzero(size == size.max()), key=lambda i: (to[head[i]], at[head[i]]))
        a, b, n = int(at[head[best]]), int(to[head[best]]), int(size[best])
        out.append((a, b, n))
        doc[a : a + n] = item[b : b + n] = 1
        marked_doc, marked_item = np.r_[0, np.cumsum(doc)], np.r_[0, np.cumsum(item)]
        free = (marked_doc[at + seed] == marked_doc[at]) & (marked_item[to + seed] == marked_item[to])
        at, to = at[free], to[free]
    return out


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    store = WordHashes()
    for b in batches:
        rows = []
        for item, text in zip(b.column(0).to_pylist(), b.column(1)):
            text = text.as_py()
            w = words(text)
            s = fingerprints(np.fromiter(map(store.__getitem__, w), np.uint64, len(w)), seed_size(len(w))) if w else np.zeros(0, np.uint64)
            n = len(s)
            rows.append((np.full(n, item), np.full(n, xxhash.xxh64_intdigest(text.encode()) - (1 << 63)), np.full(n, len(w), np.int32), s.view(np.int64), np.arange(n, dtype=np.int32)))
        cols = [np.concatenate(x) for x in zip(*rows)] if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()))], names=["item_id", "text_id", "n_words", "seed", "to"])


def _hits(bits, n_bits: int, sizes: list[int]):
    """The seeds of the documents that the bits don't rule out. row: names the document within its task's output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, store, row = bits.value, WordHashes(), TaskContext.get().partitionId() << 36
        for b in batches:
            got = []
            for doc, text in zip(b.column(0), b.column(1)):
                row += 1
                w = words(text.as_py())
                h = np.fromiter(map(store.__getitem__, w), np.uint64, len(w))
                for size in sizes:
                    s = fingerprints(h, size)
                    cell = s & np.uint64(n_bits - 1)
                    at = np.flatnonzero(table[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8) & 1)
                    if len(at):
                        got.append((row, doc.as_py(), s[at].view(np.int64), at))
            if got:
                n = [len(x[3]) for x in got]
                who = np.repeat(np.arange(len(got)), n)
                rows, docs = pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int64())
                yield pa.RecordBatch.from_arrays([rows.take(who), docs.take(who), pa.array(np.concatenate([x[2] for x in got])), pa.array(np.concatenate([x[3] for x in got]), pa.int32())], names=["row", "doc_id", "seed", "at"])

    return run


def _tiles(coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, item, size, hits in zip(*(b.column(k).to_pylist() for k in range(3)), b.column(3)):
                x = hits.values
                at, to = x.field("at").to_numpy().astype(np.int64), x.field("to").to_numpy().astype(np.int64)
                seed = seed_size(size)
                # tiles lie within seeds, so no more than these words can be covered
                reach = np.unique((np.unique(to)[:, None] + np.arange(seed)).ravel())
                if len(reach) < coverage * size:
                    continue
                tiles = tile(at, to, int(at.max()) + seed, size, seed)
                covered = sum(x[2] for x in tiles)
                if covered >= coverage * size:
                    rows.append((doc, item, size, covered, len(tiles), max(x[2] for x in tiles)))
            cols = zip(*rows) if rows else ([],) * 6
            kinds = [pa.int64()] * 2 + [pa.int32()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "item_id", "n_words", "n_covered", "n_tiles", "longest"])

    return run


def _bits(seeds: DataFrame, n_bits: int) -> np.ndarray:
    """The bits of the seeds; n_bits / 64 rows to the driver at most."""
    cell = F.col("seed").bitwiseAND(n_bits - 1)
    words_ = seeds.select(F.shiftright(cell, 6).alias("cell"), F.expr(f"shiftleft(1L, cast((seed & {n_bits - 1}) & 63 as int))").alias("bit"))
    out = np.zeros(n_bits // 64, "<u8")
    for r in words_.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        out[r["cell"]] = r["bits"] & (1 << 64) - 1
    return out.view(np.uint8)


def find_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, most_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, item_id, n_words, n_covered, n_tiles, longest, coverage) of every leaked item.

    ``docs``: doc_id, text; ``benchmark``: item_id, text. A null or empty text
    leaks nothing; items without id or words are left out; an item under SEED
    words leaks where all of it stands in a row, whatever its length, and an
    item of any length is judged as a whole. Each row is a document of its own,
    repeated rows too; equal items with other ids are items of their own,
    repeated rows of an item are one, and items that share an id but not the
    text are judged each. Empty tables give an empty result; other columns are
    left out. Words are compared by 64-bit hashes. Nothing of the benchmark
    passes the driver but the bits of its seeds, MOST_BITS at most.
    """
    spark = docs.sparkSession
    prepare(spark)
    items = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    seeds = stored(items.mapInArrow(_item_seeds, SEEDS), "item-seeds")
    n, sizes = seeds.agg(F.count("*"), F.collect_set(F.least("n_words", F.lit(SEED)))).first()
    n_bits = min(most_bits, max(LEAST_BITS, 1 << max(0, BITS_A_SEED * n - 1).bit_length()))
    sent = spark.sparkContext.broadcast(_bits(seeds, n_bits))
    hits = id_text(docs).mapInArrow(_hits(sent, n_bits, sorted(sizes)), HITS)
    shared = hits.join(seeds, "seed").groupBy("row", "doc_id", "item_id", "text_id", "n_words").agg(F.collect_list(F.struct("at", "to")).alias("hits"))
    # seeds cover SEED words each, so fewer can't be enough
    shared = shared.where(F.size("hits") * SEED >= F.col("n_words") * coverage).select("doc_id", "item_id", "n_words", "hits")
    return shared.mapInArrow(_tiles(coverage), PAIRS).withColumn("coverage", F.col("n_covered") / F.col("n_words"))

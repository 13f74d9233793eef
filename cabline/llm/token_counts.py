"""Token counts without token ids.

A byte-level BPE never merges across pre-tokens, so a document's count is the
sum, over its pre-tokens, of the pieces of each. Each distinct pre-token is
encoded once; documents only bring their pre-token frequencies.

Plan: a bounded sample of documents tells the common pre-tokens, whose pieces
every task gets as a small table, so no pre-token of very many documents is
shuffled. All others leave as (document, pre-token, frequency) rows, dealt by
pre-token: there each distinct one is encoded once, joined to its rows, and
the products go back to be added up per document. Which pre-tokens count as
common changes no result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cabline.llm.common import LETTER, NOT_PLAIN, NUMBER, id_text, prepare

# FIXED VALUES: the tokenizer's split pattern, over plain characters, and its special token.
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^\s{LETTER}{NUMBER}]+|\s+(?!\S)|\s+"

#: Documents, about, that tell the common pre-tokens, and how many of these at most.
SAMPLE, COMMON = 2_000, 100_000
#: Distinct pre-tokens whose pieces a task keeps; when full, the store starts anew.
STORE = 200_000

ROWS = "doc_id long, pre string, n int, n_bytes long"


def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class Splitter:
    """The pre-tokens of a text, as the library cuts them."""

    def __init__(self, path: str) -> None:
        self.tokenizer = _tokenizer(path)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.plain, self.odd = re.compile(SPLIT).findall, re.compile(NOT_PLAIN).search

    def __call__(self, text: str) -> list[str]:
        if any(s in text for s in self.special):
            return [p for part in self.cut.split(text) for p in ([part] if part in self.special else self(part))]
        if self.odd(text):  # the library maps each byte of a pre-token to one character; the offsets give the text back
            return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return self.plain(text)

    def pieces(self, pre: list[str]) -> list[int]:
        return [len(x) for x in self.tokenizer.encode_batch_fast(pre, add_special_tokens=False)]


def _common(path: str):
    """(pre, n) of the sampled documents, added up per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Splitter(path)
        for b in batches:
            seen: Counter = Counter()
            for x in b.column(1):
                seen.update(set(split(x.as_py())))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["pre", "n"])

    return run


def _frequencies(path: str, common: dict[str, int]):
    """For each document a row with the pieces of its common pre-tokens, and one for each other pre-token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, known = Splitter(path), common.get
        for b in batches:
            doc, pre, n, size = [], [], [], []
            for i, x in zip(b.column(0).to_pylist(), b.column(1)):
                text = x.as_py()
                cut = split(text)
                pieces = list(map(known, cut, repeat(0)))
                doc.append(i), pre.append(None), n.append(sum(pieces)), size.append(len(text.encode()))
                rare = Counter(p for p, k in zip(cut, pieces) if not k)
                doc.extend(repeat(i, len(rare))), pre.extend(rare), n.extend(rare.values()), size.extend(repeat(0, len(rare)))
                if len(doc) > 100_000:
                    yield _batch(doc, pre, n, size)
                    doc, pre, n, size = [], [], [], []
            yield _batch(doc, pre, n, size)

    return run


def _batch(doc: list, pre: list, n: list, size: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(pre, pa.string()), pa.array(n, pa.int32()), pa.array(size, pa.int64())], names=["doc_id", "pre", "n", "n_bytes"])


def _join_pieces(path: str):
    """Frequencies times pieces; all rows of a pre-token come to one task, which encodes it once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, store = Splitter(path), {}
        for b in batches:
            pre = b.column(1).dictionary_encode()
            names = pre.dictionary.to_pylist()
            if len(store) > STORE:
                store = {}
            new = [p for p in names if p not in store]
            store.update(zip(new, split.pieces(new)))
            pieces = np.array([store[p] for p in names] + [1], np.int64)  # a row without pre-token has its sum already
            at = pc.fill_null(pre.indices, len(names)).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(b.column(2).to_numpy() * pieces[at]), b.column(3)], names=["doc_id", "n", "n_bytes"])

    return run


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per document.

    ``tokenizer``: path of a byte-level BPE file of the ``tokenizers`` library,
    readable on every executor. ``n_bytes``: UTF-8 bytes; ``over_limit``:
    n_tokens > ``limit``. A null or empty text has 0 tokens. ``doc_id`` names a
    document: rows that share one (null is one too) are parts of one document
    and are added up. An empty table gives an empty result; other columns are
    left out. To the driver come COMMON pre-tokens at most.
    """
    spark = docs.sparkSession
    prepare(spark)
    texts = id_text(docs)
    part = int(min(1.0, SAMPLE / max(1, texts.count())) * (1 << 40))
    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(1 << 40)) < part).mapInArrow(_common(tokenizer), "pre string, n long")
    top = sample.groupBy("pre").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "pre").limit(COMMON)
    common = [r["pre"] for r in top.select("pre").collect()]
    common = dict(zip(common, Splitter(tokenizer).pieces(common)))
    rows = texts.mapInArrow(_frequencies(tokenizer, common), ROWS)
    rows = rows.repartition(F.coalesce("pre", F.col("doc_id").cast("string")))
    parts = rows.mapInArrow(_join_pieces(tokenizer), "doc_id long, n long, n_bytes long")
    out = parts.groupBy("doc_id").agg(F.sum("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)

"""Removal of repeated byte strings across documents.

Sorting every suffix would move about 20 times the text, level by level, so
the induction is kept and the suffix array isn't: as in induced sorting, a
sample of positions picked by local minima cuts each text into substrings,
these get names, equal names settle all positions inside at once, and only
where names that share a sampled position differ are single positions
compared. Spark's sort is the disk-backed priority queue.

In detail: each window of ``length`` bytes has one anchor, its least k-byte
string by hash, so equal windows have equal anchors at equal offsets. Windows
in a row with the same anchor form a segment; its name is a 64-bit hash of all bytes
that its windows cover, beside 32 bits of its anchor. Segments are dealt
by anchor and sorted by name:

1. equal names: the windows of every document but the smallest are repeats;
2. names that differ though the anchor is the same: a few bits of the bytes
   that all windows in a band of offsets have around the anchor tell in which
   bands the names can agree at all; there, the windows of their smallest
   documents are hashed one by one and dealt by that hash;
3. an anchor with one name has no more to tell.

A frequent anchor, as a sample of documents tells, is dealt in parts by name,
so it is no hot task: equal names still meet, and differing ones are taken to
be there.

A batch of documents sends a name once, with its smallest document, and keeps
the spans that this settles, so a name in very many documents is as many rows
as there are batches. Names are compared, not bytes: of m segments that share
their anchor about m * m / 2**65 pairs are taken for equal wrongly, and of n
single windows of the second step n * n / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cabline.llm.common import id_text, prepare, stored

#: Bytes hashed at a time in a task.
CHUNK = 1 << 20

#: Bands of offsets of the anchor in its window; each has 8 bits in ``near``.
BANDS = 4
#: place: first window times SPAN, plus HOT if the anchor is a frequent one, plus STEP times the first window's offset of
#: the anchor, plus the number of windows; for spans that the batch has settled, minus first window times SPAN plus number of windows.
SEGMENTS = "name long, anchor int, doc long, place long, near int"
SPAN, HOT, STEP = 1 << 24, 1 << 23, 1 << 12
#: Documents, about, that tell the frequent anchors: those in so large a share of them. Their segments are dealt in as many parts.
SAMPLE, FREQUENT, PARTS = 2_000, 0.02, 256
_A = 0xD1342543DE82EF95
_A_INV = pow(_A, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(0, 1 << 64, 256, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Hasher:
    """Hashes of any substring of a chunk from prefix sums."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def load(self, raw: bytes) -> None:
        n = len(raw)
        if len(self.up) <= n:
            step = np.full(n + 1, _A, np.uint64)
            back = np.full(n + 1, _A_INV, np.uint64)
            step[0] = back[0] = 1
            self.up, self.down = np.multiply.accumulate(step), np.multiply.accumulate(back)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[np.frombuffer(raw, np.uint8)] * self.up[:n], out=self.sums[1:])

    def every(self, n: int) -> np.ndarray:
        """The hash of the n bytes at each position."""
        return mix((self.sums[n:] - self.sums[:-n]) * self.down[: len(self.sums) - n])

    def some(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def bands(length: int, k: int) -> list[tuple[int, int]]:
    """(least, greatest) offset of each band."""
    edges = [(length - k + 1) * j // BANDS for j in range(BANDS + 1)]
    return [(a, b - 1) for a, b in zip(edges, edges[1:])]


def segments(h: Hasher, starts: np.ndarray, ends: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(name, anchor, document, first window, windows, offset, near) of the loaded chunk, whose documents lie from starts to ends."""
    n = len(h.sums) - 1
    if n < length:
        return (np.zeros(0, np.uint64), np.zeros(0, np.uint32), *[np.zeros(0, np.int64)] * 5)
    gram = h.every(k)
    width = length - k + 1
    low = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)  # the least hash, the first of equals
    have = 1
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: -(width - have)], low[width - have :])
    anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    doc = np.repeat(np.arange(len(starts)), ends - starts)
    inside = (doc[: n - length + 1] == doc[length - 1 :])
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1]) | (doc[1 : len(anchor)] != doc[: len(anchor) - 1])]
    first = np.flatnonzero(new)
    windows = np.diff(np.r_[first, len(anchor)])
    ok = inside[first]
    first, windows = first[ok], windows[ok]
    top = (mix(gram[anchor[first]] + np.uint64(1)) >> np.uint64(32)).astype(np.uint32)
    name = h.some(first, first + windows - 1 + length)
    at, a = doc[first], anchor[first]
    near = np.zeros(len(a), np.int64)
    for j, (lo, hi) in enumerate(bands(length, k)):
        around = h.some(np.maximum(0, a - lo), np.minimum(n, a + max(k, length - hi)))
        near |= (around & np.uint64(255)).astype(np.int64) << 8 * j
    return name, top, at, first - starts[at], windows, a - first, near


def _chunks(docs: list, texts: pa.Array, reach: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, starts, ends, ids, offsets) of about CHUNK bytes; longer texts come in parts that overlap by ``reach``."""
    parts, ids, offsets, held = [], [], [], 0

    def done():
        ends = np.cumsum([len(p) for p in parts])
        return b"".join(parts), ends - [len(p) for p in parts], ends, np.array(ids, np.int64), np.array(offsets, np.int64)

    for doc, x in zip(docs, texts):
        raw = x.as_py().encode()
        for at in range(0, max(1, len(raw) - reach), CHUNK):
            part = raw[at : at + CHUNK + reach]
            parts.append(part), ids.append(doc), offsets.append(at)
            held += len(part)
            if held >= CHUNK:
                yield done()
                parts, ids, offsets, held = [], [], [], 0
    if parts:
        yield done()


def smallest(name: np.ndarray, anchor: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows by name, then doc, and whether the doc of each isn't the name's smallest."""
    order = np.lexsort((doc, anchor, name))
    n, a, d = name[order], anchor[order], doc[order]
    head = np.r_[True, (n[1:] != n[:-1]) | (a[1:] != a[:-1])] if len(n) else np.zeros(0, bool)
    least = d[head][np.cumsum(head) - 1] if len(n) else d
    return order, d > least


def _spans(doc: np.ndarray, start: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Adjoining runs of windows joined."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], (start + windows)[order]
    if not len(doc):
        return doc, start, end
    top = np.maximum.accumulate(end + (np.cumsum(np.r_[0, doc[1:] != doc[:-1]]) << 40)) - (np.cumsum(np.r_[0, doc[1:] != doc[:-1]]) << 40)
    new = np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] > top[:-1])]
    head = np.flatnonzero(new)
    return doc[head], start[head], top[np.r_[head[1:] - 1, len(doc) - 1]] - start[head]


def _rows(name: np.ndarray, anchor: np.ndarray, doc: np.ndarray, place: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
    short = [pa.array(x.astype(np.uint32).view(np.int32)) for x in (anchor, near)]
    return pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), short[0], pa.array(doc), pa.array(place), short[1]], names=["name", "anchor", "doc", "place", "near"])


def _unpack(part: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """First windows and numbers of windows."""
    p = np.array(part, np.int64)
    return p // SPAN, p % SPAN


def _anchors(length: int, k: int):
    """(anchor, docs): documents of the batch that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = Hasher()
        for b in batches:
            for raw, starts, ends, ids, _ in _chunks(b.column(0).to_pylist(), b.column(1), length - 1):
                h.load(raw)
                _, anchor, at, *_ = segments(h, starts, ends, length, k)
                pairs = np.unique(anchor.astype(np.uint64) << np.uint64(32) | at.astype(np.uint64))
                anchor, docs = np.unique(pairs >> np.uint64(32), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int64)), pa.array(docs)], names=["anchor", "docs"])

    return run


def frequent_anchors(texts: DataFrame, length: int, k: int) -> np.ndarray:
    """Anchors in a share of FREQUENT of about SAMPLE documents: at most as many as 1 / FREQUENT documents have."""
    part = int(min(1.0, SAMPLE / max(1, texts.count())) * (1 << 40))
    some = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < part)
    least = max(20.0, FREQUENT * some.count())
    counted = some.mapInArrow(_anchors(length, k), "anchor long, docs long").groupBy("anchor").agg(F.sum("docs").alias("docs"))
    return np.array([r["anchor"] for r in counted.where(F.col("docs") >= least).collect()], np.uint32)


def _combine(name, anchor, doc, start, windows, offset, near, hot) -> Iterator[pa.RecordBatch]:
    """What a batch sends: per name and smallest document one row for each place, and the spans it settles itself."""
    order, other = smallest(name, anchor, doc)
    # a document that has the name more than once must learn of each place; in the order of the texts, rows compress well
    mine, other = np.sort(order[~other]), order[other]
    frequent = np.isin(anchor, hot)
    anchor = anchor.astype(np.uint64)
    anchor = np.where(frequent, mix(anchor + name % np.uint64(PARTS)) >> np.uint64(32), anchor)
    yield _rows(name[mine], anchor[mine], doc[mine], start[mine] * SPAN + frequent[mine] * HOT + offset[mine] * STEP + windows[mine], near[mine])
    d, s, w = _spans(doc[other], start[other], windows[other])
    parts = -(-w // (SPAN - 1))
    part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    d, s, w = d.repeat(parts), s.repeat(parts) + part * (SPAN - 1), np.minimum(w.repeat(parts) - part * (SPAN - 1), SPAN - 1)
    spread = mix(d.view(np.uint64) ^ s.view(np.uint64) << np.uint64(20))
    yield _rows(spread, spread >> np.uint64(32), d, -(s * SPAN + w), np.zeros(len(d), np.int64))


def _segments(length: int, k: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = Hasher()
        for b in batches:
            got = []
            for raw, starts, ends, ids, offsets in _chunks(b.column(0).to_pylist(), b.column(1), length - 1):
                h.load(raw)
                name, anchor, at, first, *rest = segments(h, starts, ends, length, k)
                got.append((name, anchor, ids[at], first + offsets[at], *rest))
            if got:
                yield from _combine(*(np.concatenate(x) for x in zip(*got)), hot)

    return run


def _windows(length: int):
    """Single windows of the segments in question, named by all their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, unzip = Hasher(), zstandard.ZstdDecompressor().decompress
        for b in batches:
            got = []
            for doc, x, place in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                raw = unzip(x.as_py())
                s, w = _unpack(place.as_py())
                order = np.argsort(s, kind="stable")
                s, w = s[order], w[order]
                # the bytes between the segments aren't hashed in vain: far ones are loaded one after the other
                cut = np.r_[0, np.flatnonzero(np.diff(s) > 4096) + 1, len(s)]
                for i, j in zip(cut[:-1], cut[1:]):
                    if i == j:
                        continue
                    base = int(s[i])
                    h.load(raw[base : int((s[i:j] + w[i:j]).max()) + length - 1])
                    at = np.repeat(s[i:j] - np.r_[0, np.cumsum(w[i:j])[:-1]], w[i:j]) + np.arange(w[i:j].sum())
                    at = np.unique(at[at + length <= len(raw)])
                    zero = np.zeros(len(at), np.int64)
                    got.append((h.some(at - base, at - base + length), zero, zero + doc, at, zero + 1, zero, zero))
            if got:
                yield from _combine(*(np.concatenate(x) for x in zip(*got)), np.zeros(0, np.uint32))

    return run


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts' bytes compressed, as they are shuffled."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pack(x.as_py().encode()) for x in b.column(1)], pa.binary())], names=["doc_id", "text"])


def _remove(length: int):
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor().decompress
        for b in batches:
            sizes, spans, kept = [], [], []
            for x, place in zip(b.column(1), b.column(2)):
                raw = unzip(x.as_py())
                sizes.append(len(raw))
                s, w = _unpack(place.as_py() or [])
                if not len(s):
                    spans.append([]), kept.append(raw)
                    continue
                e = np.minimum(s + w - 1 + length, len(raw))
                _, s, n = _spans(np.zeros(len(s), np.int64), s, e - s)
                cuts = np.r_[0, np.stack([s, s + n], 1).ravel(), len(raw)].tolist()
                spans.append([{"start": i, "end": j} for i, j in zip(cuts[1:-1:2], cuts[2:-1:2])])
                kept.append(b"".join(raw[i:j] for i, j in zip(cuts[::2], cuts[1::2])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kinds), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = 50, k: int = 16) -> DataFrame:
    """(doc_id, n_bytes, spans array<struct<start,end>>, kept binary) for every row of ``docs`` (doc_id, text).

    Texts are UTF-8 bytes; a null text is empty. A byte goes if a string of
    ``length`` bytes that covers it also starts in a document with a smaller
    doc_id; strings are judged on the input. ``spans``: the maximal removed
    runs, end exclusive; ``kept``: the other bytes. ``k``: bytes of an anchor,
    ``length`` at most.

    Rows that share a doc_id are one document and must have the same text; each
    is returned. A row without doc_id is kept whole and removes nothing from
    others. An empty table gives an empty result; other columns are left out.
    """
    prepare(docs.sparkSession)
    texts = id_text(docs)
    settled = F.col("place") < 0
    cut = texts.where("doc_id is not null").mapInArrow(_segments(length, k, frequent_anchors(texts.where("doc_id is not null"), length, k)), SEGMENTS).repartition(settled, "anchor")
    cut = cut.select(settled.alias("settled"), "anchor", "name", "doc", "place", "near")
    by_anchor = Window.partitionBy("settled", "anchor")
    cut = cut.withColumn("least", F.min("doc").over(Window.partitionBy("settled", "anchor", "name")))
    cut = cut.withColumn("lowest", F.min("name").over(by_anchor)).withColumn("highest", F.max("name").over(by_anchor))
    known = F.col("settled") | (F.col("doc") > F.col("least"))
    hot = F.col("place").bitwiseAND(HOT) != 0  # dealt by part of the name, so its names differ elsewhere
    cut = cut.where(known | hot | (F.col("lowest") != F.col("highest")))

    # the windows of each band, where they go on; all of a settled span or known segment in one
    start, offset, windows = F.shiftright("place", 24), F.shiftright("place", 12).bitwiseAND(2047), F.col("place").bitwiseAND(4095)
    parts = [F.struct(F.lit(-1).alias("band"), F.lit(0).alias("around"), F.when(F.col("settled"), -F.col("place")).otherwise(start * SPAN + windows).alias("part"), F.lit(1).cast("long").alias("n"))]
    bits = []
    for j, (lo, hi) in enumerate(bands(length, k)):
        top, low = F.least(offset, F.lit(hi)), F.greatest(offset - windows + 1, F.lit(lo))
        around = F.shiftright("near", 8 * j).bitwiseAND(255)
        bits.append(F.struct(F.lit(j).alias("band"), around.alias("around"), ((start + offset - top) * SPAN + top - low + 1).alias("part"), (top - low + 1).alias("n")))
    part = F.explode(F.when(known, F.array(*parts)).otherwise(F.filter(F.array(*bits), lambda x: x["n"] > 0)))
    cut = cut.select("settled", "anchor", "name", "doc", hot.alias("hot"), part.alias("p")).select("settled", "anchor", "name", "doc", "hot", "p.band", "p.around", "p.part")
    alike = Window.partitionBy("settled", "anchor", "band", "around")
    cut = cut.withColumn("lowest", F.min("name").over(alike)).withColumn("highest", F.max("name").over(alike))
    is_known, open_ = F.col("band") < 0, (F.col("band") >= 0) & (F.col("hot") | (F.col("lowest") != F.col("highest")))
    per_doc = cut.where(is_known | open_).groupBy("doc").agg(F.collect_list(F.when(is_known, F.col("part"))).alias("known"), F.collect_list(F.when(open_, F.col("part"))).alias("open"))
    per_doc = stored(per_doc, "repeats-segments")

    # the texts are dealt by doc_id once, compressed: both joins read the same exchange
    texts = texts.mapInArrow(_zipped, "doc_id long, text binary")
    asked = per_doc.where(F.size("open") > 0).select("doc", "open")
    asked = texts.join(asked.hint("merge"), texts["doc_id"] == asked["doc"]).select("doc_id", "text", "open")
    single = asked.mapInArrow(_windows(length), SEGMENTS).withColumn("settled", settled)
    single = single.withColumn("least", F.min("doc").over(Window.partitionBy("settled", "name"))).where(F.col("settled") | (F.col("doc") > F.col("least")))
    one = F.when(F.col("settled"), -F.col("place")).otherwise(F.col("place"))
    single = single.groupBy("doc").agg(F.collect_list(one).alias("place"))
    first = per_doc.where(F.size("known") > 0).select("doc", F.col("known").alias("place"))
    found = first.union(single).groupBy("doc").agg(F.flatten(F.collect_list("place")).alias("place"))
    out = texts.join(found.hint("merge"), texts["doc_id"] == found["doc"], "left").select("doc_id", "text", "place")
    return out.mapInArrow(_remove(length), "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def repeat_digest(found: DataFrame) -> DataFrame:
    """The report columns of ``remove_repeats``' result."""
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )

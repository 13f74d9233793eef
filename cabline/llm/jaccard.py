"""Exact Jaccard join on word shingles by universe partition.

Two sets that link differ in at most H elements, H following from the larger
size a band allows. The universe is cut into H + 1 segments by hash, so at
least one segment of the two is equal: each set is indexed by the digest of
its elements in each segment. A set joins its own band, and the one below if
a partner can be there.

Cost decides how a segment is used, by the elements that its digest covers.
Segments are taken two by two. The sets differ in at most H elements and there
are H + 1 segments, so one pair of segments holds at most one differing
element: one half is equal, the other is equal but for one element. A half of
two or more elements is rare, so it is a key by itself. A half of no or one
element is shared by chance, so it is never one: it is a key as a subset of
two segments, together with its other half and the one-deletion neighbourhood
of that. Both sets see the equal half, so both allocate alike, and deletions
are only paid for beside costly halves. An equal key makes a candidate straight
away, as an edge to the smallest document of the key: never all pairs.

What is left are pairs of segments that hold next to nothing. Their keys cover
fewer than PAIR elements, and their sets are compared by a parity bitmap, which
bounds the number of differing elements from below. A key that counts more than
BLOCK sets isn't compared: its sets are indexed again below it, on a universe
cut by another hash, so the pairs compared stay in proportion to the rows.

Candidate edges give clusters, which hold every linked pair. Inside a cluster
sets are compared exactly, in blocks of bounded size, skipping pairs that are
connected already; the verified edges give the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cabline.llm.common import components, id_text, prepare, stored

#: Ratio of the sizes that bound a band.
BAND = 1.4
#: Rows of a block that one task compares with another block.
BLOCK = 800
#: Elements of a key of two segments from which it makes candidates by itself.
PAIR = 3
#: Times that the sets of a crowded key are indexed anew; what is crowded even then is compared in blocks.
LEVELS = 3
#: Parts that copies of one set are grouped in before they meet.
SALTS = 64
#: Distinct words whose hashes a task keeps; when full, the store starts anew.
WORD_STORE = 250_000

DOC, KEY, LIGHT, EDGE = 0, 1, 2, 3
ROWS = "kind tinyint, key long, doc long, n long, bits binary"

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > WORD_STORE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str, size: int, store: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes of ``text``; one for a text of 1 to ``size`` words, none without words."""
    w = text.encode().lower().split()  # of bytes, both know ASCII only
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(store.__getitem__, w), np.uint64, len(w))
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out += h[k : len(h) - n + 1 + k] * (_ODD[k % 8] + np.uint64(2 * (k // 8)))
    return np.unique(mix(out))


class Bands:
    """Size bands for links of at least num / den."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        tops = [1]
        while tops[-1] < 1 << 40:
            tops.append(max(tops[-1] + 1, int(tops[-1] * BAND)))
        self.tops = np.array(tops, np.int64)

    def apart(self, both: int) -> int:
        """Differing elements of linked sets whose sizes sum to ``both``, at most."""
        return both * (self.den - self.num) // (self.den + self.num)

    def of(self, size: int) -> list[int]:
        """The set's own band, then those below in which a partner can be."""
        b = int(np.searchsorted(self.tops, size))
        out = [b]
        while b and int(self.tops[b - 1]) * self.den >= size * self.num:
            b -= 1
            out.append(b)
        return out

    def segments(self, band: int) -> int:
        """More than linked sets of the band may differ in; even, as segments are used in pairs, unless it is 1."""
        top = int(self.tops[band])
        most = self.apart(top + top * self.den // self.num)
        return most + 1 if most % 2 or not most else most + 2


def parity(items: np.ndarray, words: int) -> np.ndarray:
    """Bit k is the parity of the items that hash to it; differing bits of two sets bound their differing items."""
    at = (items * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(32)
    at = at * np.uint64(64 * words) >> np.uint64(32)
    odd = np.bincount(at.astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def bitmap_words(segments: int) -> int:
    """Four bits a segment: unrelated sets differ in twice as many as linked ones may."""
    return -(-segments // 16)


def keys(items: np.ndarray, bands: Bands) -> tuple[list[np.ndarray], list[tuple[int, int]], bytes]:
    """Keys that make candidates by themselves; (key, number of the band) of the others; the bands' bitmaps."""
    full, light, bits = [], [], []
    for turn, band in enumerate(bands.of(len(items))):
        m = bands.segments(band)
        # items are sorted and segments are ranges of their high bits, so a segment is a slice
        seg = ((items >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        ends = np.searchsorted(seg, np.arange(m + 1, dtype=np.uint64))
        mixed = mix(items + np.uint64(band + 1))
        sums = np.r_[np.uint64(0), np.cumsum(mixed)]
        size, total = np.diff(ends), sums[ends[1:]] - sums[ends[:-1]]
        tag = np.arange(m, dtype=np.uint64) * np.uint64(1024) + np.uint64(band)
        whole = mix(total + np.uint64(0x2545F4914F6CDD1D) * tag)
        bits.append(parity(items, bitmap_words(m)).tobytes())
        if m == 1:  # only equal sets link here
            full.append(whole)
            continue
        half = np.flatnonzero(size < 2)
        other = half ^ 1
        both = total[half] + total[other] + np.uint64(0xD1342543DE82EF95) * tag[half]
        # sums are additive, so leaving out an item of the other half is a subtraction
        of = np.repeat(np.arange(len(half)), size[other])
        item = np.arange(len(of)) - np.repeat(np.cumsum(size[other]) - size[other], size[other]) + ends[other][of]
        key = mix(np.r_[both, both[of] - mixed[item]])
        covers = size[half] + size[other]
        covers = np.r_[covers, covers[of] - 1]
        full.append(np.r_[whole[size > 1], key[covers >= PAIR]])
        light += [(int(k), turn) for k in key[covers < PAIR].view(np.int64)]
    return full, light, b"".join(bits)


def bitmap(bits: bytes, size: int, turn: int, bands: Bands) -> bytes:
    """The bitmap of one of the set's bands."""
    words = [bitmap_words(bands.segments(b)) for b in bands.of(size)]
    return bits[8 * sum(words[:turn]) : 8 * sum(words[: turn + 1])]


def _first(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per key its smallest doc; and (leader, doc) for the others."""
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    head = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
    leader = doc[head][np.cumsum(head) - 1] if len(key) else doc
    other = leader != doc
    pairs = np.unique(np.stack([leader[other], doc[other]], 1), axis=0)
    return key[head], doc[head], pairs[:, 0], pairs[:, 1]


def _rows(kind: int, key, doc, n=None, bits=None) -> pa.RecordBatch:
    count = len(doc)
    n = np.zeros(count, np.int64) if n is None else n
    bits = pa.nulls(count, pa.binary()) if bits is None else pa.array(bits, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(np.full(count, kind, np.int8)), pa.array(np.asarray(key).view(np.int64)), pa.array(doc, pa.int64()), pa.array(n, pa.int64()), bits], names=["kind", "key", "doc", "n", "bits"])


def _sent(found: list[tuple[np.ndarray, int]], lights: list[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
    """Keys of a batch once, with the smallest document, and edges to it; (key, name of the set, turn) of light ones."""
    if found:
        key, doc, a, b = _first(np.concatenate([k for k, _ in found]), np.concatenate([np.full(len(k), d) for k, d in found]))
        yield _rows(KEY, key, doc)
        yield _rows(EDGE, mix(b.view(np.uint64)), b, a)
    if lights:
        key, name, turn = (np.array(x, np.int64) for x in zip(*lights))
        yield _rows(LIGHT, key, name, turn)


def set_name(items: np.ndarray) -> int:
    """Equal for equal sets; signed, as Spark's long."""
    return int(mix(np.array([np.add.reduce(mix(items + np.uint64(7)))], np.uint64) + np.uint64(len(items))).view(np.int64)[0])


def _index(size: int, num: int, den: int):
    """Rows of ROWS. A batch of documents sends a key once, with its smallest document, and edges to that one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, store = Bands(num, den), WordHashes()
        for batch in batches:
            seen, found, lights, sets = [], [], [], set()
            for doc, x in sorted(zip(batch.column(0).to_pylist(), batch.column(1)), key=lambda r: r[0]):
                items = shingles(x.as_py(), size, store)
                if not len(items):
                    continue
                name = set_name(items)
                if name in sets:
                    seen.append((name, doc, len(items), None))
                    continue
                sets.add(name)
                full, light, bits = keys(items, bands)
                seen.append((name, doc, len(items), bits if light else None))
                found += [(k, doc) for k in full if len(k)]
                lights += [(k, name, turn) for k, turn in light]
            if seen:
                names, ids, sizes = (np.array(x, np.int64) for x in zip(*[s[:3] for s in seen]))
                yield _rows(DOC, names, ids, sizes, [s[3] for s in seen])
                yield from _sent(found, lights)

    return run


def _again(size: int, num: int, den: int, level: int):
    """Rows of ROWS for sets of crowded keys: keys below each of these, by another cut of the universe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, store = Bands(num, den), WordHashes()
        for batch in batches:
            found, lights = [], []
            for name, doc, x, above in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                items = shingles(x.as_py(), size, store)
                if not len(items) or set_name(items) != name:  # another text of the same doc_id
                    continue
                full, light, _ = keys(np.sort(mix(items + np.uint64(1_000_003 * level))), bands)
                for k in above.as_py():
                    under = mix(np.array([k["key"]], np.int64).view(np.uint64) + np.uint64(level))
                    found.append((mix(full[k["turn"]] ^ under), doc))
                    mine = np.array([x for x, turn in light if turn == k["turn"]], np.int64).view(np.uint64)
                    lights += [(x, name, k["turn"]) for x in mix(mine ^ under).view(np.int64).tolist()]
            yield from _sent(found, lights)

    return run


def runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Consecutive rows that agree in the first ``n_keys`` columns, across batches."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if rest is None else pa.concat_tables([rest, t])
        if not len(t):
            continue
        new = np.zeros(len(t), bool)
        for k in range(n_keys):
            c = t.column(k).to_numpy()
            new[1:] |= c[1:] != c[:-1]
        ends = np.flatnonzero(new)
        start = 0
        for e in ends.tolist():
            yield t.slice(start, e - start)
            start = e
        rest = t.slice(start)
    if rest is not None and len(rest):
        yield rest


def linked(doc: np.ndarray, size: np.ndarray, side: np.ndarray, cross: bool, bits: np.ndarray, bands: Bands, check) -> list[tuple[int, int]]:
    """Edges that connect the rows which link: a spanning forest, not all pairs.

    cross: only pairs of different sides. check(i, j): the exact test, or None.
    """
    out, label = [], np.arange(len(doc))
    order = np.lexsort((doc, side))
    doc, size, side, bits = doc[order], size[order], side[order], bits[order]
    stop = np.searchsorted(side, side[0], side="right") if cross else len(doc)
    for i in range(stop):
        j0 = stop if cross else i + 1
        both = size[j0:] + size[i]
        ok = (np.minimum(size[j0:], size[i]) * bands.den >= np.maximum(size[j0:], size[i]) * bands.num) & (label[j0:] != label[i])
        j = np.flatnonzero(ok) + j0
        if not len(j):
            continue
        apart = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64)
        near = apart <= both[j - j0] * (bands.den - bands.num) // (bands.den + bands.num)
        j = j[near][np.argsort(apart[near], kind="stable")]
        for k in j.tolist():
            if label[k] != label[i] and (check is None or check(order[i], order[k])):
                label[label == label[k]] = label[i]
                out.append((int(doc[i]), int(doc[k])))
    return out


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _light(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, found = Bands(num, den), []
        for t in runs(batches, 3):
            if len(t) < 2:
                continue
            cross = t["lo"][0].as_py() != t["hi"][0].as_py()
            side = t["block"].to_numpy()
            if cross and side.min() == side.max():
                continue
            size = t["size"].to_numpy()
            maps = [bitmap(*x, bands) for x in zip(t["bits"].to_pylist(), size.tolist(), t["turn"].to_pylist())]
            bits = np.frombuffer(b"".join(maps), np.uint64).reshape(len(maps), -1)
            found += linked(t["doc"].to_numpy(), size, side, cross, bits, bands, None)
            if len(found) > 50_000:
                yield _edges(found)
                found = []
        yield _edges(found)

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = WordHashes()
        for b in batches:
            sets = [shingles(x.as_py(), size, store).tobytes() for x in b.column(4)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(sets, pa.binary())], names=["doc", "cluster", "block", "blocks", "items"])

    return run


def _verify(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, found = Bands(num, den), []
        for t in runs(batches, 3):
            if len(t) < 2:
                continue
            cross = t["lo"][0].as_py() != t["hi"][0].as_py()
            side = t["block"].to_numpy()
            if cross and side.min() == side.max():
                continue
            sets = [np.frombuffer(x, np.uint64) for x in t["items"].to_pylist()]
            size = np.array(list(map(len, sets)), np.int64)
            words = 2 * bitmap_words(bands.apart(2 * int(size.max())) + 1)
            bits = np.stack([parity(x, words) for x in sets])

            def check(i: int, j: int, sets=sets) -> bool:
                a, b = sets[i], sets[j]
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                common = int((b[at] == a).sum())
                return den * common >= num * (len(a) + len(b) - common)

            found += linked(t["doc"].to_numpy(), size, side, cross, bits, bands, check)
            if len(found) > 50_000:
                yield _edges(found)
                found = []
        yield _edges(found)

    return run


def _paired(rows: DataFrame, key: str) -> DataFrame:
    """Each row once for every block that its own is compared with; a block pair is one (key, lo, hi)."""
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.withColumn("other", other).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    rest = [c for c in rows.columns if c not in (key, "lo", "hi", "other", "blocks")]
    return rows.select(key, "lo", "hi", *rest).repartition(key, "lo", "hi").sortWithinPartitions(key, "lo", "hi")


def _met(rows: DataFrame, name: str) -> DataFrame:
    """Rows of ROWS with the smallest document of their key, without keys that only this one has."""
    # a batch sends other keys once, but every copy of a set its name, and light keys may be frequent: these meet in parts first
    salt = F.when(F.col("kind").isin(DOC, LIGHT), F.pmod(F.xxhash64("doc"), F.lit(SALTS))).otherwise(0).cast("int")
    rows = rows.withColumn("part", salt)
    rows = rows.withColumn("leader", F.min("doc").over(Window.partitionBy("kind", "key", "part"))).drop("part")
    return stored(rows.where((F.col("kind") != KEY) | (F.col("doc") != F.col("leader"))), name)


def _shared(rows: DataFrame) -> DataFrame:
    met = rows.where(F.col("kind") == KEY).select(F.col("leader").alias("a"), F.col("doc").alias("b"))
    return met.union(rows.where(F.col("kind") == EDGE).select(F.col("n").alias("a"), F.col("doc").alias("b")))


def near_duplicates(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text).

    Words are runs of anything but ASCII white space, A-Z lower-cased; a set
    has the distinct ``size``-word shingles, or the whole sequence if shorter.
    Documents link if den * intersection >= num * union; component_id is the
    smallest doc_id reachable by links. Sets are compared by 64-bit shingle
    hashes.

    A null or empty text, or one without words, has 0 shingles and links with
    nothing. A row without doc_id links with nothing and has a null
    component_id. Repeated rows are returned as often as they occur. An empty
    table gives an empty result; other columns are left out.
    """
    spark = docs.sparkSession
    prepare(spark)
    texts = id_text(docs)
    rows = texts.where("doc_id is not null").mapInArrow(_index(size, num, den), ROWS)
    rows = _met(rows, "jaccard-rows")

    sets = rows.where(F.col("kind") == DOC)
    leaders = sets.where("doc = leader").select(F.col("key").alias("name"), "doc", F.col("n").alias("size"), "bits").distinct()
    names = leaders.groupBy(F.col("name").alias("of")).agg(F.min("doc").alias("first"))
    leaders = stored(leaders.join(names, F.col("name") == F.col("of")).drop("of"), "jaccard-leaders")
    equal = sets.where("doc <> leader").select(F.col("leader").alias("a"), F.col("doc").alias("b"))
    equal = equal.union(leaders.where("doc <> first").select(F.col("first").alias("a"), F.col("doc").alias("b")))
    maps = leaders.where("doc = first and bits is not null").select("name", "doc", "size", "bits")
    edges = equal.union(_shared(rows))
    for level in range(1, LEVELS + 2):
        light = rows.where(F.col("kind") == LIGHT).select("key", F.col("doc").alias("name"), F.col("n").cast("int").alias("turn")).distinct()
        light = stored(light, "jaccard-light")
        counts = light.groupBy(F.col("key").alias("counted")).agg(F.count("*").alias("rows")).where("rows > 1")
        light = stored(light.join(counts, F.col("key") == F.col("counted")).drop("counted"), "jaccard-light")
        crowded = light.where(F.col("rows") > BLOCK)
        last = level > LEVELS or crowded.isEmpty()
        pairs = (light if last else light.where(F.col("rows") <= BLOCK)).withColumn("blocks", F.ceil(F.col("rows") / BLOCK).cast("int"))
        pairs = pairs.join(maps, "name").withColumn("block", F.pmod(F.xxhash64("doc"), "blocks").cast("int"))
        pairs = _paired(pairs.select("key", "doc", "turn", "size", "bits", "block", "blocks"), "key")
        edges = edges.union(pairs.mapInArrow(_light(num, den), "a long, b long"))
        if last:
            break
        # a set has as many keys as segments at most
        above = crowded.groupBy("name").agg(F.collect_list(F.struct("key", "turn")).alias("above")).join(maps.select("name", "doc"), "name")
        above = texts.join(above, texts["doc_id"] == above["doc"]).select("name", "doc", "text", "above")
        rows = _met(above.mapInArrow(_again(size, num, den, level), ROWS), "jaccard-again")
        edges = edges.union(_shared(rows))
    clusters = components(edges.distinct(), "jaccard-clusters")

    # equal sets need one member in the comparison; the others hang on its edge
    members = clusters.withColumnRenamed("component", "cluster").join(leaders.where("doc = first").select(F.col("doc").alias("node")).distinct(), "node")
    sizes = members.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("rows")).where(F.col("rows") > 1)
    members = members.join(sizes.select("cluster", "blocks"), "cluster")
    members = members.select(F.col("node").alias("doc"), "cluster", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"), "blocks")
    texts = texts.join(members, texts["doc_id"] == members["doc"]).select("doc", "cluster", "block", "blocks", "text")
    full = texts.mapInArrow(_sets(size), "doc long, cluster long, block int, blocks int, items binary")
    links = _paired(full, "cluster").mapInArrow(_verify(num, den), "a long, b long")
    found = components(links.union(equal), "jaccard-links").withColumnRenamed("node", "doc")

    counts = sets.groupBy(F.col("doc").alias("set_id")).agg(F.max("n").alias("n_shingles"))
    ids = docs.select(docs["doc_id"].cast("long").alias("doc_id"))
    known = counts.join(found, counts["set_id"] == found["doc"], "left").select("set_id", "n_shingles", "component")
    # without doc_id a row is in no join, so its shingles are counted here
    alone = id_text(docs).where("doc_id is null").mapInArrow(_alone(size), "doc_id long, n_shingles long")
    out = ids.where("doc_id is not null").join(known, ids["doc_id"] == known["set_id"], "left")
    out = out.select("doc_id", F.coalesce("n_shingles", F.lit(0)).cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    return out.union(alone.withColumn("component_id", F.lit(None).cast("long")))


def _alone(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = WordHashes()
        for b in batches:
            n = [len(shingles(x.as_py(), size, store)) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_shingles"])

    return run

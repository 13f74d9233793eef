"""Phrases whose words occur together more often than apart.

Words that occur often enough have ids, so a phrase is one packed number. A
task collects its phrases in counting quotient filters: an invertible
permutation spreads the numbers evenly, the high bits of the result (the
quotient) are kept as runs in a bit vector and the low bits (the remainder) in
full, so nothing is lost and a counter is added to each. Filters are sorted,
so filters of the same range, from all tasks, merge by merging sorted runs.
Phrases that occur often enough are then turned back into words.

Ids are given to VOCABULARY words at most, the most frequent ones. If there
are more, the phrases with any of the other words are counted in plain words
besides; only those that a filter of all frequent words doesn't rule out.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cabline.llm.common import prepare, stored

#: Occurrences of a candidate at least; phrases returned for each language; share of a phrase, in hundredths, that a longer one must have.
LEAST, TOP, COVER = 10, 2000, 50
#: Parts of a language that are ranked by themselves.
PARTS = 64
#: Words with ids at most, and bytes of the longest of them: what is sent to the tasks is bounded by their product.
VOCABULARY, LONGEST = 1 << 20, 64
#: Phrases that a task holds before it sends a filter; phrases of a range on average; ranges at most.
HELD, RANGE_KEYS, MOST_RANGES = 1 << 22, 1 << 20, 1 << 17
#: Distinct words that a task counts before it sends them.
WORDS_HELD = 400_000

# FIXED VALUES: bytes that end a piece; the language of texts without one.
ENDS, NO_LANG = b".,;:!?\n\x0b\x0c\r", "und"
#: Stands for the end of a piece; no byte of UTF-8.
END = b"\xff"
_TO_END = bytes.maketrans(ENDS, END * len(ENDS))
_ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def tokens(text: str) -> list[bytes]:
    """The words of a text, lower-cased, and END between pieces."""
    raw = text.encode().lower()  # bytes: A-Z alone
    return raw.translate(_TO_END).replace(END, b" " + END + b" ").split()


def permute(x: np.ndarray, width: int) -> np.ndarray:
    """An invertible permutation of the numbers of ``width`` bits."""
    mask, half = np.uint64((1 << width) - 1), np.uint64((width + 1) // 2)
    for odd in _ODD:
        x = (x * np.uint64(odd)) & mask
        x = x ^ (x >> half)
    return x


def unpermute(x: np.ndarray, width: int) -> np.ndarray:
    mask, half = np.uint64((1 << width) - 1), np.uint64((width + 1) // 2)
    for odd in reversed(_ODD):
        x = x ^ (x >> half)  # its own inverse, as the shift is half the width at least
        x = (x * np.uint64(pow(odd, -1, 1 << 64))) & mask
    return x


def encode(keys: np.ndarray, counts: np.ndarray, width: int) -> bytes:
    """A counting quotient filter of sorted distinct ``keys`` under 2**width.

    The keys' quotients, which grow, are a bit vector in which the i-th key
    sets bit quotient + i; remainders are whole bytes; a counter is a byte, and
    eight more where that is full.
    """
    n = len(keys)
    rest = min(8, max(0, -(-(width - max(0, n.bit_length() - 1)) // 8)))
    low = 8 * rest
    quotient = (keys >> np.uint64(low)).astype(np.int64) if low < 64 else np.zeros(n, np.int64)
    bits = np.zeros(n + (1 << max(0, width - low)), np.uint8)
    bits[quotient + np.arange(n)] = 1
    remainders = np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(n, 8)[:, :rest])
    large = counts >= 255
    small = np.where(large, 255, counts).astype(np.uint8)
    return struct.pack("<IBI", n, rest, len(bits)) + np.packbits(bits).tobytes() + remainders.tobytes() + small.tobytes() + counts[large].astype("<u8").tobytes()


def decode(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) of a filter, sorted."""
    n, rest, n_bits = struct.unpack_from("<IBI", raw)
    at = 9 + -(-n_bits // 8)
    quotient = np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8, at - 9, 9), count=n_bits)) - np.arange(n)
    keys = np.zeros((n, 8), np.uint8)
    keys[:, :rest] = np.frombuffer(raw, np.uint8, n * rest, at).reshape(n, rest)
    keys = keys.view("<u8").ravel().astype(np.uint64)
    if rest < 8:
        keys |= quotient.astype(np.uint64) << np.uint64(8 * rest)
    at += n * rest
    counts = np.frombuffer(raw, np.uint8, n, at).astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw, "<u8", -1, at + n).astype(np.int64)
    return keys, counts


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted runs as one, equal keys added up."""
    if len(keys) == 1:
        return keys[0], counts[0]
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")  # merges the runs
    k, c = k[order], c[order]
    head = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return k[head], np.add.reduceat(c, head)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n); the null word has the number of all."""

    def send() -> pa.RecordBatch:
        lang, word, n = [], [], []
        for x, c in seen.items():
            lang += [x] * (len(c) + 1)
            word += [None, *c]
            n += [c.total(), *c.values()]
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], names=["lang", "word", "n"])

    seen: dict[str, Counter] = {}
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
            seen.setdefault(lang, Counter()).update(tokens(text.as_py()))
        for c in seen.values():
            c.pop(END, None)
        if sum(map(len, seen.values())) > WORDS_HELD:
            yield send()
            seen = {}
    if seen:
        yield send()


class Vocabulary:
    """Ids of words by language, from 1 on; sent as bytes and built in the task."""

    def __init__(self, langs: list[str], words: list[bytes]) -> None:
        order = sorted(zip(langs, words))
        self.langs, self.packed = [x for x, _ in order], b" ".join(w for _, w in order)
        self.bits = max(1, len(order).bit_length())

    def words(self) -> list[bytes]:
        return [b"", *self.packed.split()]

    def ids(self) -> dict[str, dict[bytes, int]]:
        out: dict[str, dict[bytes, int]] = {}
        for k, (lang, word) in enumerate(zip(self.langs, self.packed.split()), 1):
            out.setdefault(lang, {})[word] = k
        return out


def phrase_keys(ids: np.ndarray, bits: int) -> np.ndarray:
    """The packed phrases of two and three ids; none across a 0."""
    b = np.uint64(bits)
    two = (ids[:-1] > 0) & (ids[1:] > 0)
    pairs = (ids[:-1] << (b + b)) | (ids[1:] << b)
    three = two[:-1] & two[1:]
    return np.concatenate([pairs[two], pairs[:-1][three] | ids[2:][three]])


def _filters(sent, ranges: int):
    """(range, filter): the phrases of the task's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value
        ids, width = vocabulary.ids(), 3 * vocabulary.bits
        spare = max(0, width - ranges)

        def send() -> pa.RecordBatch:
            keys, counts = merged(*zip(*held))
            at = (keys >> np.uint64(spare)).astype(np.int64)
            part, first = np.unique(at, return_index=True)
            low = np.uint64((1 << spare) - 1)
            filters = [encode(keys[i:j] & low, counts[i:j], spare) for i, j in zip(first, np.r_[first[1:], len(keys)])]
            return pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(filters, pa.binary())], names=["range", "filter"])

        held, size = [], 0
        for b in batches:
            rows, flat = [], 0
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                words = tokens(text.as_py())
                words.append(END)
                rows.append(np.fromiter(map(ids.get(lang, {}).get, words, repeat(0)), np.uint64, len(words)))
            if not rows:
                continue
            keys = permute(phrase_keys(np.concatenate(rows), vocabulary.bits), width)
            for k in range(0, len(keys), HELD):
                held.append(np.unique(keys[k : k + HELD], return_counts=True))
                size += len(held[-1][0])
                if size >= HELD:
                    yield send()
                    held, size = [], 0
        if size:
            yield send()

    return run


def _merge(sent, ranges: int, least: int):
    """(lang, phrase, words, a) of the phrases of a range that occur ``least`` times. Rows come sorted by range; one range is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value
        words, bits = vocabulary.words(), vocabulary.bits
        width = 3 * bits
        spare = max(0, width - ranges)

        def done() -> pa.RecordBatch:
            keys, counts = merged(*held)
            often = counts >= least
            x = unpermute(keys[often] | np.uint64(at << spare), width).astype(np.int64)
            mask = (1 << bits) - 1
            ids = [(x >> 2 * bits).tolist(), (x >> bits & mask).tolist(), (x & mask).tolist()]
            phrases = [b" ".join([words[i], words[j], *([words[k]] if k else [])]) for i, j, k in zip(*ids)]
            size = [3 if k else 2 for k in ids[2]]
            lang = [vocabulary.langs[i - 1] for i in ids[0]]
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(size, pa.int32()), pa.array(counts[often], pa.int64())], names=["lang", "phrase", "words", "a"])

        at, held, size = None, ([], []), 0
        for b in batches:
            for part, raw in zip(b.column(0).to_pylist(), b.column(1)):
                if part != at:
                    if at is not None:
                        yield done()
                    at, held, size = part, ([], []), 0
                for x, y in zip(held, decode(raw.as_py())):
                    x.append(y)
                size += len(held[0][-1])
                if size > max(HELD, len(held[0][0])):  # what has come so far, as one run
                    held, size = tuple([x] for x in merged(*held)), 0
        if at is not None:
            yield done()

    return run


def _other_phrases(sent, frequent):
    """(lang, phrase, words, a) per batch of the phrases with a word without id; each word may be frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, known = sent.value.ids(), Bits(frequent.value)
        for b in batches:
            seen: Counter = Counter()
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                mine = ids.get(lang, {})
                words = tokens(text.as_py())
                kind = [0 if w == END else 2 if w in mine else 1 if known.has(lang, w) else 0 for w in words]
                for k in [k for k, x in enumerate(kind) if x == 1]:
                    for size in (2, 3):
                        # by its first word without id, so each place counts once
                        for first in range(max(0, k - size + 1), k + 1):
                            x = kind[first : first + size]
                            if len(x) == size and 0 not in x and x.index(1) == k - first:
                                seen[lang, b" ".join(words[first : first + size]), size] += 1
            cols = zip(*seen) if seen else ([], [], [])
            lang, phrase, size = cols
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(phrase, pa.binary()).cast(pa.string()), pa.array(size, pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["lang", "phrase", "words", "a"])

    return run


class Bits:
    """Bits of the frequent words without id: a word whose bit isn't set is none of them."""

    SIZE = 1 << 26

    def __init__(self, raw: bytes) -> None:
        self.bits = np.frombuffer(raw, np.uint8)

    @classmethod
    def of(cls, lang: str, word: bytes) -> int:
        import xxhash

        return xxhash.xxh64_intdigest(lang.encode() + b" " + word) % cls.SIZE

    def has(self, lang: str, word: bytes) -> bool:
        at = self.of(lang, word)
        return bool(self.bits[at >> 3] >> (at & 7) & 1)


def _bit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(at): the bits of the words."""
    for b in batches:
        at = np.array([Bits.of(lang, word.encode()) for lang, word in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(at))], names=["at"])


def _frequent_bits(words: DataFrame) -> bytes:
    """The bits of ``words`` (lang, word), Bits.SIZE / 8 bytes whatever their number."""
    one = F.expr("shiftleft(1L, cast(at & 63 as int))")
    cells = words.select("lang", "word").mapInArrow(_bit_rows, "at long").groupBy(F.shiftright("at", 6).alias("cell")).agg(F.bit_or(one).alias("x"))
    out = np.zeros(Bits.SIZE // 64, np.uint64)
    for r in cells.toLocalIterator():  # Bits.SIZE / 64 rows at most
        out[r["cell"]] = np.uint64(r["x"] & (1 << 64) - 1)
    return out.astype("<u8").tobytes()


def _with_ids(known: DataFrame, vocabulary: int) -> tuple[DataFrame, bool]:
    """The ``vocabulary`` most frequent of the ``known`` words, about; whether that is all of them."""
    short = known.where(F.octet_length("word") <= LONGEST)
    n, n_short = known.count(), short.count()
    if n_short <= vocabulary:
        return short, n_short == n
    level = F.floor(F.log2("n") * 8).cast("int")
    taken, floor = 0, None
    for r in short.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # 512 at most
        taken += r["count"]
        if taken > vocabulary:
            break
        floor = r["level"]
    return short.where(F.lit(False) if floor is None else level >= floor), False


def _phrases(texts: DataFrame, known: DataFrame, n_words: int, least: int, vocabulary: int) -> DataFrame:
    """(lang, phrase, words, a) of the phrases of two and three words that occur ``least`` times."""
    sc = texts.sparkSession.sparkContext
    chosen, complete = _with_ids(known, vocabulary)
    table = chosen.select("lang", F.encode("word", "UTF-8").alias("word")).toArrow()
    words = Vocabulary(table.column("lang").to_pylist(), table.column("word").to_pylist())
    sent = sc.broadcast(words)
    ranges = max(4, min(MOST_RANGES, 2 * n_words // RANGE_KEYS).bit_length())
    filters = texts.mapInArrow(_filters(sent, ranges), "range int, filter binary")
    dealt = filters.repartition("range").sortWithinPartitions("range")
    found = dealt.mapInArrow(_merge(sent, ranges, least), "lang string, phrase string, words int, a long")
    if not complete:
        other = known.join(chosen.select("lang", "word"), ["lang", "word"], "left_anti")
        frequent = sc.broadcast(_frequent_bits(other))
        rest = texts.mapInArrow(_other_phrases(sent, frequent), "lang string, phrase string, words int, a long")
        rest = rest.groupBy("lang", "phrase", "words").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
        found = found.union(rest)
    return stored(found, "phrases")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exact for counts up to 10**15."""
    a, left, right = (x.cast("decimal(15,0)") for x in (a, left, right))
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (a * a), left * right)


def mine_phrases(docs: DataFrame, least: int = LEAST, top: int = TOP, cover: int = COVER, vocabulary: int = VOCABULARY) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of ``docs`` (text, lang): the ``top`` phrases of two or three words of each language.

    a, l, r: occurrences of the phrase and of the two parts of its lowest-scoring
    cut, n: of all words of the language. A phrase counts if it occurs ``least``
    times and isn't nearly always (``cover`` hundredths) part of a longer one.
    A null text is empty, a null lang is ``und``, as is that language. Rows
    count one by one, so repeated rows count again; doc_id isn't read. An empty
    table gives an empty result; other columns are left out. To the driver and
    the tasks go ``vocabulary`` words of LONGEST bytes at most.
    """
    prepare(docs.sparkSession)
    lang = F.coalesce(docs["lang"].cast("string"), F.lit(NO_LANG))
    texts = docs.select(lang.alias("lang"), docs["text"].cast("string").alias("text")).where("text <> ''")
    counted = texts.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    known = stored(counted.where((F.col("n") >= least) | F.col("word").isNull()), "phrase-words")
    sizes, known = known.where("word is null").select("lang", "n"), known.where("word is not null")
    n_words = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = _phrases(texts, known, n_words, least, vocabulary)

    # every part of a candidate occurs as often at least, so it is a known word or a candidate
    part = lambda k: F.substring_index("phrase", " ", k)
    one = known.withColumnRenamed("word", "part")
    pairs = found.where("words = 2").select("lang", F.col("phrase").alias("part"), F.col("a").alias("n"))
    parts = found.select("lang", "phrase", "words", "a", part(1).alias("first"), part(-1).alias("last"), part(2).alias("head"), part(-2).alias("tail"))
    for name in ("first", "last"):
        parts = parts.join(one.select("lang", F.col("part").alias(name), F.col("n").alias(f"n_{name}")), ["lang", name])
    short = parts.where("words = 2").select("lang", "phrase", "a", F.col("n_first").alias("l"), F.col("n_last").alias("r"), _score(F.col("a"), F.col("n_first"), F.col("n_last")).alias("score"))
    long = parts.where("words = 3")
    for name in ("head", "tail"):
        long = long.join(pairs.select("lang", F.col("part").alias(name), F.col("n").alias(f"n_{name}")), ["lang", name])
    cuts = [F.struct(_score(F.col("a"), F.col(x), F.col(y)).alias("score"), F.col(x).alias("l"), F.col(y).alias("r")) for x, y in (("n_first", "n_tail"), ("n_head", "n_last"))]
    long = long.select("lang", "phrase", "a", F.when(cuts[1]["score"] < cuts[0]["score"], cuts[1]).otherwise(cuts[0]).alias("cut"))
    long = long.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    within = found.where("words = 3").select("lang", F.explode(F.array_distinct(F.array(part(2), part(-2)))).alias("within"), F.col("a").alias("longer"))
    within = within.groupBy("lang", "within").agg(F.max("longer").alias("longer"))
    short = short.join(within.withColumnRenamed("within", "phrase"), ["lang", "phrase"], "left")
    short = short.where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * cover)).drop("longer")

    # the best of each of PARTS parts of a language first, so none is ranked whole in one task
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    parted = short.unionByName(long).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    best = parted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


PHRASES_SQL = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, list_filter(string_split_regex(unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')), '[\x20\x09]+'), lambda x: x <> '') AS w FROM d),
g AS (SELECT lang, size, list_slice(w, i, i + size - 1) AS g FROM (SELECT lang, w, size, unnest(range(1, CAST(len(w) AS BIGINT) - size + 2)) AS i FROM p, (SELECT unnest([1, 2, 3]) AS size))),
f AS MATERIALIZED (SELECT lang, size, array_to_string(g, ' ') AS phrase, g, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE size > 1 AND f >= {LEAST}),
q AS MATERIALIZED (SELECT lang, size, phrase, g, f, k, array_to_string(list_slice(g, 1, k), ' ') AS x, array_to_string(list_slice(g, k + 1, size), ' ') AS y
  FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
k AS (SELECT q.lang, q.size, q.phrase, q.g, q.f AS a, k, l.f AS l, r.f AS r, 1000000 * q.f::HUGEINT * q.f::HUGEINT // (l.f::HUGEINT * r.f::HUGEINT) AS score
  FROM q JOIN f l ON l.lang = q.lang AND l.phrase = q.x JOIN f r ON r.lang = q.lang AND r.phrase = q.y),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT lang, within, max(f) AS longer FROM (SELECT lang, f, unnest([array_to_string(g[1:2], ' '), array_to_string(g[2:3], ' ')]) AS within FROM c WHERE size = 3) GROUP BY ALL),
s AS (SELECT b.* FROM b LEFT JOIN o ON o.lang = b.lang AND o.within = b.phrase AND b.size = 2 WHERE longer IS NULL OR 100 * longer < {COVER} * a)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM s JOIN n ON n.lang = s.lang QUALIFY rank <= {TOP}
"""

"""Phrases, source mixing and the filter audit against brute force."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from cabline.llm import collocations, filter_audit, mixing
from cabline.llm.common import prepare

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def clash(df):
    """Extra columns whose names operators use inside."""
    from pyspark.sql import functions as F

    for c in ("word", "n", "phrase", "part", "mask", "maybe", "words", "name", "size", "h", "of", "bucket", "budget", "most", "label_id", "first"):
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def rows(odd_rows):
    """The odd rows and random texts of few words, with null sources and languages and copies."""
    r = random.Random(5)
    out = [(i, t, ["en", None, "und"][k % 3], [None, "a", "b", "Z", ""][k % 5], 1) for k, (i, t) in enumerate(odd_rows)]
    words = "the The of OF new york city bank,\tof a. b c;d straße É x|y # Ab ABCD one two".split(" ")
    for i in range(300):
        text = " ".join(r.choice(words) for _ in range(r.randrange(1, 90)))
        out.append((100 + i, text, r.choice(["en", "de", None, "und"]), r.choice([None, "a", "b", "é", "Z", ""]), 1))
    for i in range(40):
        _, text, lang, source, _ = out[-1 - r.randrange(200)]
        out.append((r.choice([None, 3, 500 + i]), text, lang, source, 1))
    return out


# ---- phrases -----------------------------------------------------------------


def phrases(rows, least, top, cover):
    f, n = defaultdict(Counter), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for _, text, lang, _, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in (1, 2, 3):
                f[lang].update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, c in f.items():
        many = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        got = []
        for p, a in many.items():
            if any(len(q) > len(p) and 100 * b >= cover * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in many.items()):
                continue
            score, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            got.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(got)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("vocabulary", [collocations.VOCABULARY, 9, 0])
def test_phrases(spark, rows, vocabulary):
    docs = clash(spark.createDataFrame(rows, SCHEMA))
    got = collocations.mine_phrases(docs, least=4, top=60, cover=50, vocabulary=vocabulary).collect()
    want = phrases(rows, 4, 60, 50)
    assert len(want) > 100 and sorted(map(tuple, got)) == want


def test_no_phrases(spark, make):
    for docs in (make([]), make([(1, None), (None, ""), (2, ". , !")])):
        assert collocations.mine_phrases(docs).collect() == []


@pytest.mark.parametrize("width", [1, 3, 17, 40, 63])
def test_permutation_and_filter(width):
    r = np.random.default_rng(width)
    n = min(5000, 1 << width)
    x = np.unique(r.integers(0, 1 << width, n, np.uint64))
    y = collocations.permute(x, width)
    assert len(np.unique(y)) == len(x) and int(y.max()) < 1 << width
    assert (collocations.unpermute(y, width) == x).all()
    keys = np.sort(y)
    counts = r.integers(1, 600, len(keys))
    k, c = collocations.decode(collocations.encode(keys, counts, width))
    assert (k == keys).all() and (c == counts).all()
    half = len(keys) // 2
    k, c = collocations.merged([keys, keys[:half]], [counts, counts[:half]])
    assert (k == keys).all() and (c == counts + np.where(np.arange(len(keys)) < half, counts, 0)).all()


def test_filter_is_compact():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 54, 100_000, np.uint64))
    assert len(collocations.encode(keys, np.ones(len(keys), np.int64), 54)) < 6.5 * len(keys)


def test_exact_score(spark):
    from pyspark.sql import functions as F

    cases = [(999_999_999_999_999, 999_999_999_999_999, 999_999_999_999_999), (123_456_789_012, 987_654_321_098, 555_555_555_555), (10, 17, 23)]
    df = spark.createDataFrame(cases, "a long, l long, r long")
    got = [x[0] for x in df.select(collocations._score(F.col("a"), F.col("l"), F.col("r"))).collect()]
    assert got == [1000000 * a * a // (x * y) for a, x, y in cases]


# ---- mixing ------------------------------------------------------------------


def test_mix(spark, rows):
    docs = clash(spark.createDataFrame(rows, SCHEMA))
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    assert Counter((x.doc_id, x.size, x.source) for x in got) == Counter((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s) for i, t, _, s, _ in rows)
    size = Counter()
    for x in got:
        size[x.source] += x.size
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = dict(zip(order, [5, 2, 1] * len(order)))
    want, open_, left = {}, list(order), 1.5 * sum(size.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if 2 * size[s] < level * weight[s]]
        if not full:
            want |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            want[s] = 2 * size[s]
            left -= want[s]
            open_.remove(s)
    taken, largest = Counter(), Counter()
    same = Counter()
    for x in got:
        assert x.source_size == size[x.source] and x.target == pytest.approx(want[x.source]) and x.taken in (0, x.size, 2 * x.size)
        taken[x.source] += x.taken
    texts = {(i, t, s): len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _, s, _ in rows}
    for i, t, _, s, _ in rows:
        same[i, t, s] += texts[i, t, s]
    for (_, _, s), n in same.items():
        largest[s] = max(largest[s], n)
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 for s in order)
    again = mixing.mix(spark.createDataFrame(rows[::-1], SCHEMA).repartition(3)).collect()
    assert Counter(x.doc_id for x in again if x.taken) == Counter(x.doc_id for x in got if x.taken)


@pytest.mark.parametrize("budget", [0, 1, 499, 500, 7777, 10**9])
def test_threshold_refines(spark, budget):
    """All hashes in one bucket of every histogram but the last."""
    top = 1 << 59
    rows = [("s", 5, top + k) for k in range(2000)] + [(None, 5, k << 40) for k in range(500)]
    df = spark.createDataFrame(rows, "source string, size long, h long")
    budgets = spark.createDataFrame([("s", float(budget)), (None, float(budget))], "source string, budget double")
    most = {x.source: x.most for x in mixing.thresholds(df, budgets).collect()}
    for s in ("s", None):
        h = [k for x, _, k in rows if x == s]
        if 5 * len(h) <= budget:
            assert s not in most
        else:
            assert abs(sum(5 for k in h if k <= most[s]) - budget) <= 2.5


def test_mix_of_nothing(make):
    assert mixing.mix(make([])).collect() == []
    assert [(x.size, x.taken, x.target) for x in mixing.mix(make([(1, None), (2, " ")])).collect()] == [(0, 0, 0.0)] * 2


def test_mix_plan_is_native(make):
    plan = mixing.mix(make([(1, "a b"), (2, "c")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- filter audit ----------------------------------------------------------------


def report(rows, labels):
    smallest = {}
    for i, t, *_ in rows:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    fails = []
    for i, t, _, s, _ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A"} if len(w) < 50 else set()
        f |= {"B"} if 100 * len(set(w)) < 65 * len(w) else set()
        f |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t) else set()
        f |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        f |= {"E"} if i is not None and i > smallest[t] else set()
        good = any(x == i and q == 1 for x, q, _ in labels if i is not None)
        toxic = any(x == i and y == 1 for x, _, y in labels if i is not None)
        fails.append((s or "", f, good, toxic))
    out, shapley = {}, Counter()
    for part in {x[0] for x in fails}:
        mine = [x for x in fails if x[0] == part]
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                before = set(order[:k])
                gone = [x for x in mine if f in x[1] and not x[1] & before]
                kept = sum(not x[1] & (before | {f}) for x in mine)
                redundant = sum(f in x[1] and bool(x[1] & before) for x in mine)
                out[part, "".join(order), k + 1] = [kept, len(gone), redundant, sum(x[1] == {f} for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone)]
                shapley[part, f] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit(spark, rows):
    r = random.Random(2)
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in (None, 1, 2, 2, 3, *range(100, 250), 9999)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(x.part, x.filter_order, x.step): (x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost, x.toxic_lost, x.shapley) for x in filter_audit.audit(clash(spark.createDataFrame(rows, SCHEMA)), table).collect()}
    assert got == report(rows, labels)


@pytest.mark.parametrize("most_cells", [1 << 29, 8])
def test_prepass_only_clears(spark, rows, most_cells):
    """Whatever the sketch's size, the masks are the same; of a fitting one, most unique texts are cleared."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, SCHEMA)
    copies = filter_audit.failed_filters(docs, most_cells).where("mask >= 16").count()
    assert copies == filter_audit.failed_filters(docs).where("mask >= 16").count() > 20
    prepare(spark)
    text = F.coalesce("text", F.lit(""))
    maybe = docs.select(text.alias("text"), filter_audit.possible_repeat(docs, text, most_cells)(F.xxhash64(text)).alias("maybe")).collect()
    n = Counter(x.text for x in maybe)
    assert all(x.maybe for x in maybe if n[x.text] > 1)
    cleared = sum(not x.maybe for x in maybe)
    assert cleared >= 0.9 * sum(n[x.text] == 1 for x in maybe) if most_cells > 8 else cleared == 0


def test_audit_of_nothing(spark, make):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(make([]), none).collect() == []
    (part,) = {x.part for x in filter_audit.audit(make([(None, None)]), none).collect()}
    assert part == "src0"

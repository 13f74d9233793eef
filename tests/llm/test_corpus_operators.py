"""Joins, repeats, leaks, search, line dedup, the classifier and the pipeline against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cabline.llm import decontaminate, hamming, jaccard, line_dedup, quality, repeats
from tests.conftest import SF_SMALL
from tests.llm.test_text_operators import clash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_sets(rows, size):
    import re

    out = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        out[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    return out


def brute_components(sets, num, den):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in sets if i is not None)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and den * len(x & y) >= num * len(x | y):
                ra, rb = sorted((find(a), find(b)))
                root[rb] = ra
    return {i: find(i) for i in ids}


def mutated(r, words, n):
    w = list(words)
    for _ in range(n):
        k = r.randrange(len(w))
        w[k : k + r.choice((0, 1, 1))] = [f"m{r.randrange(10**6)}"]
    return w


@pytest.mark.parametrize("size,num", [(4, 85), (5, 80)])
def test_jaccard_components(make, odd_rows, size, num):
    r = random.Random(11)
    rows = [*odd_rows, (13, "ONE two"), (14, "one TWO"), (15, "Éa one two x y z"), (16, "éa one two x y z")]
    for g in range(12):
        base = [f"w{r.randrange(4000)}" for _ in range(r.choice((3, 8, 25, 60, 200, 700)))]
        for _ in range(r.choice((2, 5, 12))):
            rows.append((len(rows) + 100, " ".join(mutated(r, base, r.randrange(0, 1 + len(base) // 25)))))
    # a hot line in short texts of their own: shingles that very many sets share
    for k in range(150):
        rows.append((len(rows) + 100, "this is a very common line in all of them " + " ".join(f"u{r.randrange(10**6)}" for _ in range(r.randrange(0, 9)))))
    got = jaccard.near_duplicates(clash(make(rows)), size, num, 100).collect()
    sets = word_sets(rows, size)
    want = brute_components({i: s for i, s in sets.items() if i is not None}, num, 100)
    assert Counter(x.doc_id for x in got) == Counter(i for i, _ in rows)
    for x in got:
        if x.doc_id is None:
            assert x.component_id is None
        else:
            assert (x.n_shingles, x.component_id) == (len(sets[x.doc_id]), want[x.doc_id]), x.doc_id
    assert sum(a != b for a, b in want.items()) > 40


def test_jaccard_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    sets = word_sets(rows, 4)
    want = brute_components(sets, 85, 100)
    got = jaccard.near_duplicates(documents, 4, 85, 100).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, len(sets[i]), want[i]) for i in sets}


@settings(max_examples=150, deadline=None)
@given(st.sets(st.integers(0, 400), min_size=1, max_size=120), st.data())
def test_linked_sets_share_a_key(base, data):
    """Every pair that links has an equal key, in full or in a light segment."""
    bands = jaccard.Bands(85, 100)
    drop = data.draw(st.sets(st.sampled_from(sorted(base)), max_size=max(1, len(base) // 10)))
    other = (base - drop) | data.draw(st.sets(st.integers(500, 900), max_size=max(1, len(base) // 12)))
    if not other or 100 * len(base & other) < 85 * len(base | other):
        return
    h = lambda s: np.sort(jaccard.mix(np.array(sorted(s), np.uint64)))
    (fa, la, _), (fb, lb, _) = jaccard.keys(h(base), bands), jaccard.keys(h(other), bands)
    flat = lambda f, x: {int(k) for a in f for k in a.view(np.int64)} | {k for k, _ in x}
    assert flat(fa, la) & flat(fb, lb)


@pytest.mark.parametrize("crowd,levels", [(3, 3), (3, 0)])
def test_jaccard_of_crowded_keys(make, monkeypatch, crowd, levels):
    """Sets of frequent light keys are indexed again, or compared in blocks; many copies and texts that share a doc_id too."""
    monkeypatch.setattr(jaccard, "BLOCK", crowd)
    monkeypatch.setattr(jaccard, "LEVELS", levels)
    r = random.Random(5)
    rows = []
    for g in range(60):
        base = [f"w{r.randrange(300)}" for _ in range(r.choice((20, 30, 45)))]
        for _ in range(r.choice((1, 2, 4))):
            rows.append((len(rows), " ".join(mutated(r, base, r.randrange(0, 2)))))
    bands, store = jaccard.Bands(80, 100), jaccard.WordHashes()
    light = Counter(k for _, text in rows for k, _ in jaccard.keys(jaccard.shingles(text, 5, store), bands)[1])
    assert max(light.values()) > crowd
    rows += [(1000 + k, rows[7][1]) for k in range(200)]
    got = jaccard.near_duplicates(make(rows), 5, 80, 100).collect()
    want = brute_components(word_sets(rows, 5), 80, 100)
    assert {x.doc_id: x.component_id for x in got} == want
    both = [*rows, (0, rows[20][1]), (3, " ".join(f"x{k}" for k in range(90)))]
    assert len(jaccard.near_duplicates(make(both), 5, 80, 100).collect()) == len(both)


@pytest.mark.parametrize("size,num", [(4, 85), (5, 80)])
def test_few_sets_are_compared_in_pairs(spark, size, num):
    """Costly segments are keys together with their neighbours: fewer pairs than sets are left for the bitmaps, and keys grow by half at most."""
    from tests.conftest import SF_SMALL

    bands, store, light, n, single = jaccard.Bands(num, 100), jaccard.WordHashes(), Counter(), 0, 0
    sets = {s.tobytes(): s for s in (jaccard.shingles(x.text or "", size, store) for x in spark.read.parquet(f"{SF_SMALL}/../sf0.01/documents.parquet").collect()) if len(s)}
    for s in sets.values():
        full, rest, _ = jaccard.keys(s, bands)
        n += sum(map(len, full)) + len(rest)
        light.update(k for k, _ in rest)
        single += sum(bands.segments(b) for b in bands.of(len(s)))
    assert sum(v * (v - 1) // 2 for v in light.values()) < len(sets)
    assert n < 1.6 * single


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5), (7, 9), (7, 9)]
    got = {x.node: x.component for x in jaccard.components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    want = brute_components({i: set() for e in edges for i in e}, 1, 1)
    for _ in range(100):
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    assert got == {i: c for i, c in want.items() if any(i in e and e[0] != e[1] for e in edges)}


def brute_repeats(rows, length=50):
    texts = {i: (t or "").encode() for i, t in rows}
    least = {}
    for i in sorted(i for i in texts if i is not None):
        for k in range(len(texts[i]) - length + 1):
            least.setdefault(texts[i][k : k + length], i)
    out = {}
    for i, raw in texts.items():
        gone = np.zeros(len(raw) + 1, bool)
        if i is not None:
            for k in range(len(raw) - length + 1):
                if least[raw[k : k + length]] < i:
                    gone[k : k + length] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = int((np.diff(np.r_[False, gone].astype(int)) == 1).sum())
        out[i] = (len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def repeat_rows(odd_rows):
    r = random.Random(4)
    rows, words = [x for x in odd_rows if x[0] != 6], [f"wörd{k}" for k in range(300)]
    passages = [" ".join(r.choice(words) for _ in range(n)) for n in (6, 7, 8, 9, 30, 60)]
    passages += [passages[4][:50], passages[4][:49], "ab" * 60, "x" * 70, passages[5][20:75]]
    for k in range(120):
        parts = []
        for _ in range(r.randrange(1, 5)):
            p = r.choice(passages)
            a = r.randrange(0, max(1, len(p) - 52))
            parts += [p if r.random() < 0.5 else p[a : a + r.randrange(48, 90)], "".join(r.choice("etaoin shrdlu") for _ in range(r.randrange(0, 40)))]
        rows.append((r.randrange(1000, 10**6), "".join(parts)))
    return rows


@pytest.mark.parametrize("k", [20, 8, 50])
def test_repeats(make, odd_rows, k):
    rows = repeat_rows(odd_rows)
    got = repeats.repeat_digest(repeats.remove_repeats(clash(make(rows)), 50, k)).collect()
    want = brute_repeats(rows)
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id
        else:
            assert r.n_removed == 0
    assert sum(w[1] > 0 for w in want.values()) > 50


def test_repeats_in_long_texts(make, monkeypatch):
    """Texts longer than a chunk are cut with overlap."""
    r = random.Random(1)
    a = "".join(r.choice("abcdefgh ") for _ in range(3 << 20))
    rows = [(1, a), (2, a[1_000_000:1_100_000] + "ZZ" + a[2_097_100:2_097_200] + "YY" + a[-60:])]
    got = {x.doc_id: x for x in repeats.remove_repeats(make(rows)).collect()}
    assert not got[1].spans and [(s.start, s.end) for s in got[2].spans] == [(0, 100_000), (100_002, 100_102), (100_104, 100_164)]
    assert bytes(got[2].kept) == b"ZZYY"


def test_repeats_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = repeats.repeat_digest(repeats.remove_repeats(documents)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_repeats(rows)


def test_names_around_one_string():
    """300,000 segments that share their anchor have 300,000 names."""
    r = np.random.default_rng(8)
    h = repeats.Hasher()
    raw = r.integers(97, 123, 200_000, np.uint8).tobytes()
    h.load(raw)
    at = int(np.argmin(h.every(16)))
    anchor = raw[at : at + 16]  # a string that is the anchor wherever it stands
    n, seen = 0, []
    for _ in range(6):
        around = r.integers(97, 123, (50_000, 2, 34), np.uint8)
        parts = [a.tobytes() + anchor + b.tobytes() for a, b in around]
        h.load(b"".join(parts))
        starts = np.arange(len(parts)) * 84
        name, top, doc, first, windows, offset, _ = repeats.segments(h, starts, starts + 84, 50, 16)
        mine = (first <= 34) & (first + offset == 34)
        assert len(np.unique(top[mine])) == 1 and mine.sum() >= 49_900
        n += int(mine.sum())
        seen.append(name[mine])
    assert len(np.unique(np.concatenate(seen))) == n >= 299_000


def test_frequent_anchors_are_dealt_in_parts(make, monkeypatch):
    """A string of all documents with differing surroundings: the same result, from several parts."""
    r = random.Random(12)
    line = "the one line of all documents, which is longer than fifty bytes"
    rows = [(k, "".join(r.choice("abcdefgh ") for _ in range(60)) + line[: r.randrange(30, 64)] + "".join(r.choice("abcdefgh ") for _ in range(60))) for k in range(150)]
    docs = make(rows)
    texts = docs.select("doc_id", "text")
    assert len(repeats.frequent_anchors(texts, 50, 16)) > 0
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in repeats.repeat_digest(repeats.remove_repeats(docs)).collect()}
    assert got == brute_repeats(rows)
    monkeypatch.setattr(repeats, "FREQUENT", 2.0)
    assert got == {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in repeats.repeat_digest(repeats.remove_repeats(docs)).collect()}


def test_empty_tables(make):
    assert jaccard.near_duplicates(make([]), size=4, num=85, den=100).collect() == []
    assert repeats.repeat_digest(repeats.remove_repeats(make([]))).collect() == []


def brute_tiles(doc, item, least):
    """Greedy string tiling by its definition."""
    d, t, out = [False] * len(doc), [False] * len(item), []
    while True:
        best = (0, 0, 0)
        for b in range(len(item)):
            for a in range(len(doc)):
                n = 0
                while a + n < len(doc) and b + n < len(item) and doc[a + n] == item[b + n] and not d[a + n] and not t[b + n]:
                    n += 1
                if n > best[0]:
                    best = (n, a, b)
        n, a, b = best
        if n < least:
            return out
        out.append((a, b, n))
        d[a : a + n] = t[b : b + n] = [True] * n


@pytest.mark.parametrize("seed", range(8))
def test_tiling(seed):
    r = random.Random(seed)
    item = [r.choice("abcdef") for _ in range(24)]
    doc = [r.choice("abcdef") for _ in range(20)] + item[12:] + ["x"] + item[:12] + [r.choice("abc") for _ in range(10)]
    n = decontaminate.SEED
    hits = [(a, b) for a in range(len(doc) - n + 1) for b in range(len(item) - n + 1) if doc[a : a + n] == item[b : b + n]]
    at, to = np.array(hits).reshape(-1, 2).T
    assert sorted(decontaminate.tile(at, to, len(doc), len(item))) == sorted(brute_tiles(doc, item, n))


def test_leaks(make, spark):
    r = random.Random(9)
    words = [f"t{k}" for k in range(200)]
    items = [(k, " ".join(r.choice(words) for _ in range(30))) for k in range(6)] + [(50, None), (None, "x " * 20), (51, "too short to tell"), (52, "")]
    w = items[0][1].split()
    rows = [
        (1, "before " + items[0][1] + " after"),
        (2, " ".join(w[20:] + ["and"] + w[:10] + ["then"] + w[10:20])),
        (3, " ".join(w[:10])),
        (4, items[1][1].upper().replace(" ", ", ")),
        (5, None),
        (6, ""),
        (None, items[2][1]),
        (7, items[3][1]),
        (7, items[3][1]),
        (8, " ".join(r.choice(words) for _ in range(20_000))),
        (9, " ".join([items[4][1]] * 500)),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = Counter((x.doc_id, x.item_id, x.n_covered, x.n_tiles) for x in decontaminate.find_leaks(clash(make(rows)), bench).collect())
    assert got == Counter([(1, 0, 30, 1), (2, 0, 30, 3), (4, 1, 30, 1), (None, 2, 30, 1), (7, 3, 30, 1), (7, 3, 30, 1), (9, 4, 30, 1)])
    assert decontaminate.find_leaks(make([]), bench).collect() == []
    assert decontaminate.find_leaks(make(rows), bench.limit(0)).collect() == []


def test_leaks_whatever_the_bits_rule_out(spark):
    bench = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    whole = sorted(map(tuple, decontaminate.find_leaks(docs, bench).collect()))
    assert sorted(map(tuple, decontaminate.find_leaks(docs, bench, most_bits=64).collect())) == whole and whole


def test_leaks_of_short_and_long_items(make, spark):
    r = random.Random(6)
    long = [f"w{r.randrange(5000)}" for _ in range(70_000)]
    items = [(1, "three odd words"), (2, "unique1"), (3, " ".join(long)), (4, "他们在公园里散步看花"), (5, "three odd words"), (6, "...")]
    rows = [
        (10, "here are Three odd, words."),
        (11, "odd three words unique"),
        (12, "unique1"),
        (13, " ".join(long[30_000:] + ["cut"] + long[:15_000])),  # over 0.6 of it
        (14, " ".join(long[:30_000])),
        (15, "昨天他们在公园里散步看花了"),
        (16, "他们在家"),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((x.doc_id, x.item_id, x.n_words, x.n_covered) for x in decontaminate.find_leaks(make(rows), bench).collect())
    assert got == [(10, 1, 3, 3), (10, 5, 3, 3), (12, 2, 1, 1), (13, 3, 70_000, 55_000), (15, 4, 10, 10)]


def test_search(spark):
    r = np.random.default_rng(3)
    centers = r.normal(size=(6, 64))
    v = [(int(k), (centers[k % 6] + 0.5 * r.normal(size=64)).tolist()) for k in range(700)]
    v += [(k, v[0][1]) for k in range(1000, 1100)] + [(2000, None), (None, v[1][1]), (2020, []), (2040, [None] * 64), (20, v[20][1])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>").withColumn("code", F.lit("x")).withColumn("id", F.lit(1))
    got = defaultdict(list)
    for x in sorted(hamming.search_vectors(df, k=10).collect()):
        got[x.query_id].append((x.distance, x.neighbor_id))
    codes = {x.id: x.code & (1 << 64) - 1 for x in hamming.binary_codes(df).collect()}
    assert 2000 not in codes and 2020 not in codes and codes[2040] == 0
    want = {q: sorted(((c ^ d).bit_count(), i) for i, d in codes.items() if i != q)[:10] for q, c in codes.items() if q % 20 == 0}
    assert dict(got) == want


def test_search_of_few(spark):
    df = spark.createDataFrame([(0, [1.0] * 64), (20, [-1.0] * 64)], "vec_id long, embedding array<double>")
    assert [(x.query_id, x.neighbor_id, x.distance) for x in sorted(hamming.search_vectors(df).collect())] == [(0, 20, 64), (20, 0, 64)]
    assert hamming.search_vectors(df.limit(0)).collect() == []


def test_boilerplate(spark):
    pages = [(k, "a.org", ["Home", f"page {k}", "Home", "", "rare" if k < 2 else "x"]) for k in range(10)]
    pages += [(k, "b.org", ["Home", "Only"]) for k in range(20, 23)] + [(99, None, None), (99, None, None), (None, "a.org", [" Home  ", "own"])]
    df = spark.createDataFrame(pages, "id long, host string, lines array<string>")
    got = Counter((x.id, x.host, tuple(x.kept)) for x in line_dedup.drop_boilerplate(df, 0.5, 5).collect())
    want = Counter({(99, "", ()): 2, (None, "a.org", ("own",)): 1})
    want += Counter((k, "a.org", (f"page {k}", "", *(["rare"] if k < 2 else []))) for k in range(10))
    want += Counter((k, "b.org", ("Home", "Only")) for k in range(20, 23))
    assert got == want
    assert line_dedup.drop_boilerplate(df.limit(0)).collect() == []


def test_page_lines(spark):
    html = "<html><head><TITLE>T  t</TITLE><script>var x = '<p>no</p>';</script></head><body><!-- <p>no --><p>One <b>bold</b>\n</p><br/>two<style>p{}</style><div class='x'>three</div></body>"
    rows = [(1, "https://u@Host.org:8080/x?y", html), (2, None, None), (3, "not a url", ""), (None, "http://h/", "plain\ntext")]
    df = clash(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {x.page_id: (x.host, x.n_lines, x.n_dropped, x.text) for x in line_dedup.clean_pages(df).collect()}
    assert got == {1: ("host.org", 4, 0, "T t\nOne bold\ntwo\nthree"), 2: ("", 0, 0, ""), 3: ("", 0, 0, ""), None: ("h", 2, 0, "plain\ntext")}


def test_expectation_maximisation():
    """Accuracies of simulated labellers are found again."""
    r = np.random.default_rng(5)
    y = r.random(20_000) < 0.2
    right = [(0.97, 0.8), (0.99, 0.6), (0.9, 0.9), (0.95, 0.7)]
    votes = [np.where(r.random(len(y)) < 0.1, 2, np.where(r.random(len(y)) < np.where(y, b, g), y, ~y).astype(int)) for g, b in right]
    counts = Counter("".join(map(str, v)) for v in zip(*votes))
    share, got, p = quality.expectation_maximisation(counts, least_right=0.5)
    assert abs(share - 0.2) < 0.03 and np.abs(got - np.array(right)).max() < 0.06
    assert p["1111"] > 0.95 and p["0000"] < 0.05
    assert quality.expectation_maximisation({}) == (0.0, pytest.approx(np.zeros((0, 2))), {})


def test_fit_against_plain_descent():
    """The same minimum as by proximal gradient on a dense matrix; weights count as copies."""
    r = np.random.default_rng(3)
    x = (r.random((300, 12)) < 0.3).astype(float)
    x[0] = 0
    y = 1 / (1 + np.exp(-(x @ np.r_[3, -2, 1, np.zeros(9)] - 0.5)))
    copies = r.integers(1, 4, 300)
    at, size = np.nonzero(x)[1], x.sum(axis=1).astype(int)
    w, b = quality.fit_linear(at, size, 12, y, copies.astype(float), penalty=5e-3, steps=3000)
    dense, target = np.repeat(x, copies, axis=0), np.repeat(y, copies)
    v, c = np.zeros(12), 0.0
    for _ in range(20_000):
        error = 1 / (1 + np.exp(-(dense @ v + c))) - target
        v, c = v - 0.5 * dense.T @ error / len(target), c - 0.5 * error.mean()
        v = np.sign(v) * np.maximum(0, np.abs(v) - 0.5 * 5e-3)
    assert np.abs(w - v).max() < 2e-3 and abs(b - c) < 2e-3 and (v == 0).any()
    assert quality.fit_linear(np.zeros(0, int), np.zeros(0, int), 0, np.zeros(0), np.zeros(0))[1] == 0.0


def test_associated_features(spark):
    r = random.Random(1)
    rows = []
    for k in range(400):
        bad = k % 4 == 0
        rows.append((1.0 + k % 2, float(bad), 0.0, [1] * (r.random() < (0.9 if bad else 0.1)) + [2] * (r.random() < 0.5) + [3]))
    df = spark.createDataFrame(rows, quality.EXAMPLES)
    assert [x.bucket for x in quality.associated(df, "junk").collect()] == [1] and quality.associated(df, "toxic").collect() == []
    assert quality.associated(df.limit(0), "junk").collect() == []


def test_sample_counts_copies_once(make, monkeypatch):
    """A text of a third of the rows is one example with their weight."""
    rows = [(k, f"word{k} and others" if k % 3 else "the copied text") for k in range(300)]
    seen = []
    monkeypatch.setattr(quality, "fit_scorer", lambda examples, task: (seen.append(examples.select("weight").collect()), (np.zeros(quality.BUCKETS), 0.0))[1])
    quality.fit(make(rows))
    assert sorted(x.weight for x in seen[0]) == [1.0] * 200 + [100.0]


def test_classifier_on_labels(spark):
    """Accuracy on the half of the labels that the fit never sees."""
    sf = SF_SMALL.replace("sf0.001", "sf0.1")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").withColumn("text", F.lit(None))
    seen = F.xxhash64("doc_id", F.lit(1)) % 2 == 0
    held = labels.where(~seen).select("doc_id", F.col("quality").alias("label_quality"), F.col("toxic").alias("label_toxic"))
    got = quality.classify(clash(docs), labels.where(seen)).join(held, "doc_id").collect()
    # the smaller tables have stems that ordinary words share, so whole words must tell
    for task, least, bad in (("junk", 0.95, lambda x: x.label_quality == 0), ("toxic", 0.9, lambda x: x.label_toxic == 1)):
        yes = [x for x in got if x[task] >= quality.THRESHOLD]
        hit = sum(map(bad, yes))
        assert hit >= 0.95 * len(yes) and hit >= least * sum(map(bad, got)), (task, hit, len(yes), sum(map(bad, got)))
    clean = [x for x in got if x.label_quality and not x.label_toxic]
    assert sum(x.keep for x in clean) >= 0.99 * len(clean)


def test_whole_words_are_mined(make):
    """Words of few toxic labels, whose beginnings clean words share."""
    word = lambda k: f"achlich{'abcdefgh'[k]}x"
    rows = [(k, f"ein {word(k % 8)} und {word((k + 3) % 8)} wort{k}") for k in range(24)]
    rows += [(k, f"ein achlicher text und achlichen wort{k}") for k in range(24, 240)]
    df = make(rows)
    labels = df.select("doc_id", (F.col("doc_id") < 24).cast("int").alias("toxic"))
    stems = quality.mine_stems(df, labels)
    known = quality.StemWords(stems)
    assert all(known[word(k)] for k in range(8))
    assert not any(known[x] for x in ("ein", "und", "achlicher", "achlichen", "text", "wort30"))


def test_classifier_on_odd_rows(make, odd_rows):
    got = quality.classify(clash(make(odd_rows))).collect()
    assert Counter(x.doc_id for x in got) == Counter(i for i, _ in odd_rows)
    assert quality.classify(make([])).collect() == []
    odd = make(odd_rows).sparkSession.createDataFrame([(1, 0, 1), (1, 1, None), (None, 0, 1), (5, 1, 0), (77, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality.classify(make(odd_rows), odd).count() == len(odd_rows) and quality.classify(make(odd_rows), odd.limit(0)).count() == len(odd_rows)
    assert quality.keep_good(make(odd_rows)).columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_SMALL)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        after = {r.doc_id: r for r in out.collect()}
        assert set(after) <= set(before)
        if name == "quality_classifier":
            kept = {r.doc_id for r in quality.classify(docs, spark.read.parquet(f"{SF_SMALL}/labels.parquet")).collect() if r.keep}
            assert set(after) == kept and len(after) < len(before)
        elif name == "line_dedup":
            assert len(after) == len(before)
            distinct = {(r.source, r.text) for r in before.values()}  # copies count once
            pages, seen = Counter(source for source, _ in distinct), Counter()
            norm = lambda x: " ".join(x.replace("\n", " ").split(" ")).strip() if False else __import__("re").sub(r"[ \t\r\f]+", " ", x).strip(" ")
            for source, text in distinct:
                seen.update({(source, norm(x)) for x in text.split("\n") if norm(x)})
            for i, r in before.items():
                keep = [x for x in r.text.split("\n") if not norm(x) or seen[r.source, norm(x)] < 2 or seen[r.source, norm(x)] <= 0.1 * pages[r.source]]
                assert after[i].text == "\n".join(keep) and after[i].n_chars == len(after[i].text)
        elif name == "ngram_jaccard_join":
            sets = word_sets([(i, r.text) for i, r in before.items()], 5)
            want = brute_components(sets, 80, 100)
            assert set(after) == {i for i in before if want[i] == i}
        else:
            leaks = decontaminate.find_leaks(docs, spark.read.parquet(f"{SF_SMALL}/benchmark.parquet"))
            assert set(before) - set(after) == {r.doc_id for r in leaks.collect()}
        docs, before = out, after
    assert corpus_pipeline.run(spark, SF_SMALL).count() >= len(before)


def test_pipeline_keeps_one_of_many_copies(make, spark):
    """A third of the rows are copies; their lines aren't boilerplate, a line of all pages is."""
    import corpus_pipeline

    own = lambda k: "\n".join(" ".join(f"w{k}x{j}y{i}" for i in range(8)) for j in range(3))
    rows = [(k, f"Home page\n{own(0 if k % 9 < 3 else k)}") for k in range(90)]
    stages = dict(corpus_pipeline.STAGES)
    out = stages["line_dedup"](spark, make(rows), SF_SMALL)
    assert {r.doc_id: r.text for r in out.collect()} == {k: t.split("\n", 1)[1] for k, t in rows}
    left = stages["ngram_jaccard_join"](spark, out, SF_SMALL).collect()
    assert [r.doc_id for r in left if r.text == own(0)] == [0] and len(left) == 61


def test_pipeline_decides_by_row(make, spark):
    """Rows without doc_id go too, one of identical rows stays, a clean row that shares a leaking row's doc_id stays."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    rows = [(5, text(0)), (5, text(0)), (None, text(0)), (4, text(0) + " tail"), (None, text(1)), (None, text(1)), (7, text(2)), (7, text(3)), (8, ""), (8, ""), (9, None)]
    left = stages["ngram_jaccard_join"](spark, make(rows), SF_SMALL).collect()
    assert Counter((r.doc_id, r.text) for r in left) == Counter([(4, text(0) + " tail"), (None, text(1)), (7, text(2)), (7, text(3)), (8, ""), (8, ""), (9, None)])
    item = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").where("text is not null").first().text
    rows = [(1, "a " + item), (1, text(4)), (None, item), (None, text(5)), (2, None), (3, item), (3, item)]
    left = stages["benchmark_decontamination"](spark, make(rows), SF_SMALL).collect()
    assert Counter((r.doc_id, r.text) for r in left) == Counter([(1, text(4)), (None, text(5)), (2, None)])


def test_pipeline_of_odd_rows(make, spark, odd_rows):
    import corpus_pipeline

    docs = make(odd_rows)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_SMALL)
        out.collect()
        docs = out if "text" in out.columns else docs

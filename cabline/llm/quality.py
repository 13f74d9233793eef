"""Quality classifier from weak labels.

Heuristic labellers vote bad, good or nothing on each text. One of them knows
words and word stems that a bounded sample of labelled documents ties to abuse,
in whatever language. How often each pattern of votes occurs is counted over all
documents; the patterns are few, so expectation-maximisation over their counts
estimates the labellers' accuracies exactly as over the documents. The posteriors are soft labels for a
linear scorer on hashed words, word beginnings and binned statistics, fitted with an L1 penalty
on a bounded sample and applied to every document. There are two such tasks:
junk and toxic. A document that either scorer finds bad is rejected.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cabline.llm.common import prepare, stored

#: Distinct texts that the scorer is fitted on, about: a hash sample, each weighed by its copies; all if there are fewer.
SAMPLE = 10_000
#: Labelled documents that the stems are mined from, about: a hash sample of the labels.
LABELLED = 20_000
#: Lengths of word beginnings. A stem is one, or a whole word, that at least STEM_DOCS bad labelled documents have and
#: whose share of bad ones is STEM_SHARE at least, smoothed by STEM_PRIOR of the bad documents' number at the common
#: share: more labels show more rare words that are bad by chance.
BEGINNINGS, STEM_DOCS, STEM_SHARE, STEM_PRIOR = (4, 5, 6, 7), 3, 0.6, 0.01
#: Hash buckets of the scorer's features.
BUCKETS = 1 << 18
#: L1 penalty and steps of the fit; standard errors by which a feature must be associated with the labels to enter it.
PENALTY, STEPS, LEAST_Z = 2e-4, 300, 4.0
#: A score from here on is bad.
THRESHOLD = 0.6
#: Distinct words whose bucket a task keeps; when full, the store starts anew.
WORD_STORE = 350_000

#: A labeller is right on at least this share of good texts: its limits for bad lie far from ordinary text. Without
#: this, kinds of junk that few labellers know would pass for a habit of good texts.
LEAST_RIGHT = 0.99

TASKS = ("junk", "toxic")
# FIXED VALUES: English words of abuse, by the labeller that knows them; they overlap.
PERSONS = "idiot moron loser scum clown fool jerk imbecile idiots morons losers clowns".split()
CONTEMPT = "stupid pathetic worthless disgusting trash dumb garbage loser scum".split()
WORDS_OF_ABUSE = tuple(sorted({*PERSONS, *CONTEMPT}))
_MARKS = np.frombuffer(b"#$%&*|~^<>=+{}[]\\@_`", np.uint8)
WORD = re.compile(r"\w+")
ABUSE = re.compile(r"\b(?:" + "|".join(WORDS_OF_ABUSE) + r")\b")

GOOD, BAD, NONE = 0, 1, 2
EXAMPLES = "weight double, junk double, toxic double, x array<int>"


def _grade(value: float, good: float, bad: float) -> int:
    """BAD from ``bad`` on, GOOD up to ``good``, nothing in between; bad may be the lower one."""
    if good > bad:
        return _grade(-value, -good, -bad)
    return BAD if value >= bad else GOOD if value <= good else NONE


def statistics(text: str) -> dict[str, float]:
    """Shares that the labellers and the scorer look at."""
    raw = np.frombuffer(text.encode(), np.uint8)
    h = np.bincount(raw, minlength=256)
    spaces = int(h[9:14].sum() + h[32])  # of bytes
    n = max(1, len(raw) - spaces)
    tokens = text.split()
    words = max(1, len(tokens))
    upper, lower, high = int(h[65:91].sum()), int(h[97:123].sum()), int(h[128:].sum())
    lines = [x for x in text.split("\n") if x]
    return {
        "marks": int(h[_MARKS].sum()) / words,
        "pipes": int(h[124]) / words,
        "bangs": int(h[33]) / words,
        "upper": upper / max(1, upper + lower),
        "letters": (upper + lower + high) / n,
        "digits": int(h[48:58].sum()) / n,
        "again": 1 - len(set(lines)) / max(1, len(lines)),
        "stutter": sum(map(eq, tokens, tokens[1:])) / words,
        "squeeze": min(1.0, len(zlib.compress(raw, 1)) / len(raw)) if len(raw) >= 100 else 0.5,
    }


def abuse(low: str) -> list[str]:
    """The words of abuse in a lower-cased text; a plain search goes first."""
    return ABUSE.findall(low) if any(w in low for w in WORDS_OF_ABUSE) else []


def beginnings(word: str) -> list[str]:
    return [word[:n] for n in BEGINNINGS if len(word) >= n]


def stems_of(word: str) -> list[str]:
    """The possible stems of a word: the whole of it, which ends with $, and its beginnings."""
    return [f"{word}$", *beginnings(word)]


class StemWords(dict):
    """Whether a word is a stem or begins with one."""

    def __init__(self, stems: frozenset) -> None:
        self.stems = stems

    def __missing__(self, word: str) -> bool:
        if len(self) > WORD_STORE:
            self.clear()
        self[word] = known = not self.stems.isdisjoint(stems_of(word))
        return known


def votes(text: str, stems: StemWords | None = None) -> tuple[list[int], list[int]]:
    """The labellers' votes for each task."""
    s = statistics(text)
    junk = [
        _grade(s["marks"], 0.1, 0.4),
        _grade(s["pipes"], 0.05, 0.3),
        _grade(s["bangs"], 0.05, 0.4),
        _grade(s["upper"], 0.25, 0.6),
        _grade(s["letters"], 0.85, 0.7),
        _grade(s["stutter"], 0.05, 0.4),
        _grade(s["squeeze"], 0.35, 0.2) if len(text) >= 100 else NONE,
    ]
    low = text.lower()
    hits = abuse(low)
    begun = sum(map(stems.__getitem__, set(WORD.findall(low)))) if stems is not None and stems.stems else -1
    # the lists are English: that they find nothing says little beside stems of every language
    nothing = GOOD if begun < 0 else NONE
    toxic = [
        BAD if any(w in PERSONS for w in hits) else nothing,
        BAD if any(w in CONTEMPT for w in hits) else nothing,
        BAD if len(set(hits)) > 1 else NONE if hits else nothing,
        BAD if begun > 1 else GOOD if begun == 0 else NONE,
    ]
    return junk, toxic


def _patterns(stems: frozenset):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = StemWords(stems)
        for texts in batches:
            yield texts.map(lambda x: ["".join(map(str, v)) for v in votes(x, known)])

    return run


def _stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(stem, docs, bad) of a batch of (text, bad): documents that have it, and bad ones among them."""
    for b in batches:
        docs, bad = Counter(), Counter()
        for text, label in zip(b.column(0), b.column(1).to_pylist()):
            has = {x for w in set(WORD.findall(text.as_py().lower())) for x in stems_of(w)}
            docs.update(has)
            if label:
                bad.update(has)
        # what no bad document of the batch has can still have one elsewhere, so all go on
        yield pa.RecordBatch.from_arrays([pa.array(list(docs), pa.string()), pa.array(list(docs.values()), pa.int64()), pa.array([bad[x] for x in docs], pa.int64())], names=["stem", "docs", "bad"])


def mine_stems(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> frozenset:
    """Words and word beginnings that ``labels`` (doc_id, toxic) ties to toxic documents.

    From about ``labelled`` labels, picked by the hash of the doc_id, so few
    enough to be broadcast; the sample also bounds the number of stems.
    """
    part = int(min(1.0, labelled / max(1, labels.count())) * (1 << 40))
    some = labels.select(labels["doc_id"].cast("long").alias("label_id"), (labels["toxic"] == 1).alias("bad")).where("label_id is not null and bad is not null")
    some = some.where(F.pmod(F.xxhash64("label_id"), F.lit(1 << 40)) < part).groupBy("label_id").agg(F.bool_or("bad").alias("bad"))
    texts = docs.select(docs["doc_id"].cast("long").alias("id"), _text(docs).alias("text")).join(F.broadcast(some), F.col("id") == F.col("label_id")).select("text", "bad")
    counts = texts.mapInArrow(_stems, "stem string, docs long, bad long").groupBy("stem").agg(F.sum("docs").alias("docs"), F.sum("bad").alias("bad"))
    n, n_bad = some.agg(F.count("*"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0))).first()
    prior = STEM_PRIOR * n_bad
    share = (F.col("bad") + prior * n_bad / max(1, n)) / (F.col("docs") + prior)
    found = counts.where((F.col("bad") >= STEM_DOCS) & (share >= STEM_SHARE))
    return frozenset(r["stem"] for r in found.collect())


def expectation_maximisation(counts: dict[str, int], rounds: int = 200, least_right: float = LEAST_RIGHT) -> tuple[float, np.ndarray, dict[str, float]]:
    """(share of bad, accuracy[labeller, class], P(bad) of each pattern) from counts of vote patterns.

    accuracy[j, c]: how often labeller j, if it votes, is right on class c.
    Starts with labellers that are better than chance, which settles the names
    of the two classes; counts are smoothed, so no accuracy is 0 or 1, and
    accuracy on good texts is ``least_right`` at least.
    """
    if not counts:
        return 0.0, np.zeros((0, 2)), {}
    v = np.array([[int(c) for c in p] for p in counts])
    n = np.array(list(counts.values()), float)
    right = np.tile([max(0.95, least_right), 0.5], (v.shape[1], 1))
    share = 0.1
    for _ in range(rounds):
        with np.errstate(divide="ignore"):
            bad = np.log(share) + np.where(v == BAD, np.log(right[:, BAD]), np.where(v == GOOD, np.log(1 - right[:, BAD]), 0)).sum(axis=1)
            good = np.log(1 - share) + np.where(v == GOOD, np.log(right[:, GOOD]), np.where(v == BAD, np.log(1 - right[:, GOOD]), 0)).sum(axis=1)
        p = 1 / (1 + np.exp(np.clip(good - bad, -500, 500)))
        share = float(np.clip((n * p).sum() / n.sum(), 1e-6, 1 - 1e-6))
        for c, w in ((GOOD, n * (1 - p)), (BAD, n * p)):
            right[:, c] = ((w[:, None] * (v == c)).sum(axis=0) + 1) / ((w[:, None] * (v != NONE)).sum(axis=0) + 2)
        # a labeller that votes at random may not turn the classes around
        right = np.maximum(right, np.stack([1 - right[:, BAD] + 1e-3, 1 - right[:, GOOD] + 1e-3], 1)).clip(1e-4, 1 - 1e-4)
        right[:, GOOD] = right[:, GOOD].clip(least_right)
    return share, right, dict(zip(counts, p.tolist()))


class Buckets(dict):
    """The buckets of a word and its beginnings."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > WORD_STORE:
            self.clear()
        self[word] = h = tuple(zlib.crc32(x.encode()) % BUCKETS for x in (word, *[f"^{b}" for b in beginnings(word)]))
        return h


def features(text: str, store: Buckets) -> np.ndarray:
    """Buckets of the distinct words, of their beginnings and of the binned statistics."""
    found = set(chain.from_iterable(map(store.__getitem__, set(WORD.findall(text.lower())))))
    found.update(zlib.crc32(f"{k}={min(20, int(x * 20))}".encode()) % BUCKETS for k, x in statistics(text).items())
    return np.sort(np.fromiter(found, np.int64, len(found)))


def _examples(stems: frozenset, posterior: list[dict[str, float]]):
    """(weight, junk, toxic, x) of (text, weight): the posterior labels and the features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, known = Buckets(), StemWords(stems)
        for b in batches:
            found, target = [], []
            for text in b.column(0):
                text = text.as_py()
                target.append([p["".join(map(str, v))] for p, v in zip(posterior, votes(text, known))])
                found.append(features(text, store).astype(np.int32))
            ends = np.cumsum([0, *map(len, found)])
            x = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *found])))
            target = np.array(target, float).reshape(-1, len(TASKS))
            yield pa.RecordBatch.from_arrays([b.column(1), *(pa.array(target[:, k]) for k in range(len(TASKS))), x], names=["weight", *TASKS, "x"])

    return run


def _only(kept: np.ndarray):
    """The places in the sorted ``kept`` of those features that are among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x")
            flat = x.flatten().to_numpy()
            at = np.minimum(np.searchsorted(kept, flat), max(0, len(kept) - 1))
            has = kept[at] == flat if len(kept) else np.zeros(len(flat), bool)
            ends = np.r_[0, np.cumsum(has)][np.r_[0, np.cumsum(x.value_lengths().to_numpy())]]
            yield pa.RecordBatch.from_arrays([b.column("weight"), *(b.column(t) for t in TASKS), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at[has].astype(np.int32)))], names=["weight", *TASKS, "x"])

    return run


def associated(examples: DataFrame, task: str) -> DataFrame:
    """(bucket) of the features whose share of ``task`` differs from all examples' by LEAST_Z standard errors.

    ``examples``: weight, junk, toxic, x. The others would only carry noise.
    """
    w, mean, square = examples.agg(*(F.coalesce(F.sum(x), F.lit(0.0)) for x in (F.col("weight"), F.col("weight") * F.col(task), F.col("weight") * F.col(task) * F.col(task)))).first()
    if not w:
        return examples.select(F.explode("x").alias("bucket")).limit(0)
    mean, spread = mean / w, max(0.0, square / w - (mean / w) ** 2)
    counts = examples.select("weight", (F.col("weight") * (F.col(task) - mean)).alias("shift"), F.explode("x").alias("bucket"))
    counts = counts.groupBy("bucket").agg((F.sum("weight") / w).alias("share"), (F.sum("shift") / w).alias("shift"), F.count("*").alias("n"))
    error = F.sqrt(F.col("share") * (1 - F.col("share")) * (spread / w)) + 1e-12
    return counts.where(F.abs("shift") > LEAST_Z * error).select("bucket")


def fit_linear(at: np.ndarray, size: np.ndarray, n_features: int, target: np.ndarray, weight: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """(weights, bias) of a logistic scorer on 0/1 features by accelerated proximal gradient.

    ``at``: the features of one example after the other, ``size`` of them each;
    an example counts ``weight`` times. Minimises the mean logistic loss plus
    ``penalty`` times the sum of the absolute weights.
    """
    n, bias, x, x0, b0, t = len(size), 0.0, np.zeros(n_features), np.zeros(n_features), 0.0, 1.0
    if not n:
        return x, bias
    row, part = np.repeat(np.arange(n, dtype=np.int32), size), weight / weight.sum()
    y, c = x, bias
    # a feature of few documents bends the loss little: each has its own step length
    width = np.bincount(at, weights=((size + 1) * part)[row], minlength=n_features) / 4 + 1e-300
    width0 = ((size + 1) * part).sum() / 4
    for _ in range(steps):
        score = np.bincount(row, weights=y[at], minlength=n) + c
        error = (1 / (1 + np.exp(-np.clip(score, -50, 50))) - target) * part
        x0, b0, x, bias = x, bias, y - np.bincount(at, weights=error[row], minlength=n_features) / width, c - error.sum() / width0
        x = np.sign(x) * np.maximum(0, np.abs(x) - penalty / width)
        t0, t = t, (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, c = x + (t0 - 1) / t * (x - x0), bias + (t0 - 1) / t * (bias - b0)
    return x, float(bias)


def fit_scorer(examples: DataFrame, task: str) -> tuple[np.ndarray, float]:
    """(weights of all buckets, bias) for ``task``. Only associated features come to the driver, as numbers in one Arrow table."""
    kept = np.sort(np.array([r["bucket"] for r in associated(examples, task).collect()], np.int32))
    table = examples.mapInArrow(_only(kept), EXAMPLES).select("weight", task, "x").toArrow().combine_chunks()
    lists = table.column("x").combine_chunks()
    at = lists.flatten().to_numpy() if table.num_rows else np.zeros(0, np.int32)
    size = lists.value_lengths().to_numpy() if table.num_rows else np.zeros(0, np.int32)
    weights = np.zeros(BUCKETS)
    weights[kept], bias = fit_linear(at, size, len(kept), table.column(task).to_numpy(), table.column("weight").to_numpy())
    return weights, bias


class Model:
    """Weights and bias of each task; ``labellers``: their estimated accuracies; ``stems``: what was mined."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, labellers: dict[str, np.ndarray], stems: frozenset) -> None:
        self.weights, self.bias, self.labellers, self.stems = weights, bias, labellers, stems

    def udf(self):
        kept = np.flatnonzero((self.weights != 0).any(axis=0))
        values, bias = self.weights[:, kept], self.bias

        @F.pandas_udf("struct<junk:double,toxic:double>")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            weights = np.zeros((len(TASKS), BUCKETS))
            weights[:, kept] = values
            store = Buckets()
            for texts in batches:
                s = np.array([weights[:, features(x, store)].sum(axis=1) + bias for x in texts]).reshape(-1, len(TASKS))
                p = 1 / (1 + np.exp(-np.clip(s, -50, 50)))
                yield pd.DataFrame({t: p[:, k] for k, t in enumerate(TASKS)})

        return score


def _text(docs: DataFrame):
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def fit(docs: DataFrame, labels: DataFrame | None = None, sample: int = SAMPLE) -> Model:
    """The model of ``docs`` (doc_id, text). Votes are counted over all of them.

    ``labels`` (doc_id, toxic) of some of them give the stems (see
    ``mine_stems``); without labels that labeller is silent. To the driver come
    the stems, the patterns, 3**7 and 3**4 at most, and those features of
    about ``sample`` distinct texts, picked by their hash, that are associated
    with the posterior labels. However many copies a text has, it is one row.
    """
    prepare(docs.sparkSession)
    stems = mine_stems(docs, labels) if labels is not None else frozenset()
    texts = docs.select(_text(docs).alias("text"))
    patterns = _patterns(stems)
    voted = texts.select(patterns("text").alias("p"))
    counted = voted.groupBy(F.col("p")[0].alias("junk"), F.col("p")[1].alias("toxic")).count().collect()
    posterior, labellers = [], {}
    for k, task in enumerate(TASKS):
        counts: dict[str, int] = {}
        for r in counted:
            counts[r[task]] = counts.get(r[task], 0) + r["count"]
        _, labellers[task], p = expectation_maximisation(dict(sorted(counts.items())))
        posterior.append(p)
    total = sum(r["count"] for r in counted)
    part = int(min(1.0, sample / max(1, total)) * (1 << 40))
    picked = texts.where(F.pmod(F.xxhash64("text"), F.lit(1 << 40)) < part).groupBy("text").agg(F.count("*").cast("double").alias("weight"))
    examples = stored(picked.mapInArrow(_examples(stems, posterior), EXAMPLES), "examples")
    fitted = [fit_scorer(examples, t) for t in TASKS]
    return Model(np.stack([w for w, _ in fitted]), np.array([b for _, b in fitted]), labellers, stems)


def classify(docs: DataFrame, labels: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, junk, toxic, keep) for every row of ``docs`` (doc_id, text).

    junk, toxic: the scorers' probabilities; keep: both below THRESHOLD. A
    null or empty text has no words and gets the score of its statistics alone.
    Rows are scored one by one: repeated rows are returned as often as they
    occur, a null doc_id stays null. An empty table gives an empty result;
    other columns are left out.
    """
    score = fit(docs, labels, sample).udf()
    out = docs.select(docs["doc_id"].cast("long").alias("doc_id"), score(_text(docs)).alias("s"))
    return out.select("doc_id", F.col("s.junk").alias("junk"), F.col("s.toxic").alias("toxic"), _keep("s").alias("keep"))


def _keep(s: str):
    return (F.col(f"{s}.junk") < THRESHOLD) & (F.col(f"{s}.toxic") < THRESHOLD)


def keep_good(docs: DataFrame, labels: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with all their columns."""
    scored = docs.select(F.struct(*docs.columns).alias("row"), fit(docs, labels, sample).udf()(_text(docs)).alias("s"))
    return scored.where(_keep("s")).select("row.*")

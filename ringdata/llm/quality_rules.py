"""Quality rules: gradient-boosted trees over document statistics.

Trees are grown on the driver from the statistics of at most SAMPLE_DOCS labelled
documents (those of the least hash) with logistic loss over histograms; features
named in MONOTONE may only move the score one way. The forest is flattened into
numpy arrays (feature, threshold, children, value) and scores whole batches by
walking all rows down one level at a time.
Defined cases: a null or empty text has no words and fails the base rules; with
labels of fewer than two kinds the forest keeps every text; repeated rows are judged
alike; an empty table gives an empty result; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import remainder, texts

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "same_next_share", "upper_share", "digit_share", "mark_share", "end_share"]
#: +1: the score of being good may only rise with the feature, -1: only fall.
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "same_next_share": -1, "upper_share": -1, "mark_share": -1}
SAMPLE_DOCS = 20_000
TREES, DEPTH, BINS, RATE, LEAST = 40, 3, 64, 0.2, 12
KEEP = 0.5


def word_ids(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64, count=len(words))


def repeat_words(ids: np.ndarray) -> int:
    """Words in 3-word windows that occur at least twice."""
    if len(ids) < 4:
        return 0
    n = int(ids.max()) + 1
    pair = ids[:-1] * n + ids[1:]
    if n > 2_000_000:  # three ids no longer fit 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    _, at, count = np.unique(pair[:-1] * n + ids[2:], return_inverse=True, return_counts=True)
    start = count[at] > 1
    covered = np.zeros(len(ids), dtype=bool)
    for k in range(3):
        covered[k : k + len(start)] |= start
    return int(covered.sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The counts COUNTS and the FEATURES of one text."""
    text = text or ""
    words = text.encode().split()
    n = len(words)
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    dup_lines = len(lines) - len(set(lines))
    chars = len(text) - sum(map(text.count, SPACE))
    ids = word_ids(words)
    repeated = repeat_words(ids)
    distinct = int(ids.max()) + 1 if n else 0
    same_next = int((ids[1:] == ids[:-1]).sum()) if n else 0
    some, letters = max(n, 1), max(chars, 1)
    upper = upper_letters(text)
    marks = sum(map(text.count, "!#*$%&|<>_=^~"))
    ends = sum(map(text.count, ".,;:?"))
    digits = sum(map(text.count, "0123456789"))
    return [n, chars, symbols, dup_lines, repeated], [
        float(np.log1p(n)), chars / some, symbols / some, dup_lines / max(len(lines), 1), repeated / some, distinct / some, same_next / some, upper / letters, digits / letters, marks / some, ends / some,
    ]


def upper_letters(text: str) -> int:
    """Upper-case letters A-Z and of Latin-1."""
    data = np.frombuffer(text.encode("utf-16-le", errors="surrogatepass"), dtype="<u2")
    return int((((data >= 65) & (data <= 90)) | ((data >= 0xC0) & (data <= 0xDE) & (data != 0xD7))).sum())


@dataclass
class Forest:
    """Node arrays of all trees; a leaf points to itself."""

    start: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of being good for each row."""
        if not len(self.roots):
            return 1 / (1 + np.exp(-np.full(len(x), self.start)))
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.start + self.value[at].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boosted trees; y is 0 or 1."""
    none = np.zeros(0, dtype=np.int64)
    if len(set(y.tolist())) < 2:
        return Forest(10.0, none, none, none.astype(float), none, none, none.astype(float))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)  # bin b: x <= edges[b]
    sign = [MONOTONE.get(name, 0) for name in FEATURES]
    start = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(len(y), start)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        for a, v in ((feature, 0), (threshold, 0.0), (left, len(left)), (right, len(right)), (value, 0.0)):
            a.append(v)
        return len(left) - 1

    def leaf(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + 1.0), low, high))

    def grow(rows: np.ndarray, depth: int, low: float, high: float) -> int:
        me = node()
        g, h = grad[rows], hess[rows]
        value[me] = RATE * leaf(g.sum(), h.sum(), low, high)
        if depth == 0 or len(rows) < 2 * LEAST:
            return me
        best = (1e-6, -1, -1, 0.0, 0.0)
        gain_of = lambda gs, hs, v: -(gs * v + 0.5 * (hs + 1.0) * v * v)
        whole = gain_of(g.sum(), h.sum(), leaf(g.sum(), h.sum(), low, high))
        for f, e in enumerate(edges):
            if not len(e):
                continue
            b = bins[rows, f]
            gs, hs, ns = (np.cumsum(np.bincount(b, weights=w, minlength=len(e) + 1))[:-1] for w in (g, h, None))
            vl, vr = np.clip(-gs / (hs + 1.0), low, high), np.clip(-(g.sum() - gs) / (h.sum() - hs + 1.0), low, high)
            ok = (ns >= LEAST) & (len(rows) - ns >= LEAST) & (sign[f] * (vr - vl) >= 0)
            gain = np.where(ok, gain_of(gs, hs, vl) + gain_of(g.sum() - gs, h.sum() - hs, vr) - whole, -1)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), f, k, float(vl[k]), float(vr[k]))
        _, f, k, vl, vr = best
        if f < 0:
            return me
        # what lies below a monotone split stays on its side of the middle
        mid = (vl + vr) / 2
        lows = (low, mid) if sign[f] > 0 else (mid, low) if sign[f] < 0 else (low, low)
        highs = (mid, high) if sign[f] > 0 else (high, mid) if sign[f] < 0 else (high, high)
        go = bins[rows, f] <= k
        feature[me], threshold[me] = f, float(edges[f][k])
        left[me] = grow(rows[go], depth - 1, lows[0], highs[0])
        right[me] = grow(rows[~go], depth - 1, lows[1], highs[1])
        return me

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        roots.append(grow(np.arange(len(y)), DEPTH, -4.0, 4.0))
        tree = Forest(0.0, np.array(roots[-1:]), *(np.array(a) for a in (feature, threshold, left, right, value)))
        p = tree.score(x)
        margin += np.log(p / (1 - p))
    return Forest(start, np.array(roots), *(np.array(a) for a in (feature, threshold, left, right, value)))


def add_statistics(docs: DataFrame) -> DataFrame:
    """docs with the counts and `features` instead of the text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [statistics(t) for t in f["text"]]
            counts = np.array([c for c, _ in found], dtype=np.int64).reshape(-1, len(COUNTS))
            yield f.drop(columns="text").assign(**dict(zip(COUNTS, counts.T, strict=True)), features=[x for _, x in found])

    kept = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in docs.schema if x.name != "text")
    return docs.mapInPandas(run, ", ".join([kept, *[f"{c} long" for c in COUNTS], "features array<double>"]))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE_DOCS) -> Forest:
    """Fit on at most `sample` labelled rows of docs whose crc32(doc_id as text) mod 4 is not 2; the others are for testing.

    Of several labels or texts of one doc_id the least is learnt from.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("y IN (0, 1) AND doc_id IS NOT NULL").where(remainder(F.col("doc_id"), 4) != 2)
    chosen = known.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = texts(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("y").alias("y"), F.min("text").alias("text"))
    rows = add_statistics(rows).select("doc_id", "y", "features").toPandas().sort_values("doc_id")  # at most `sample` rows
    return fit(np.array(rows["features"].tolist(), dtype=float).reshape(-1, len(FEATURES)), rows["y"].to_numpy(dtype=float))


def judge(docs: DataFrame, forest: Forest) -> DataFrame:
    """doc_id, the counts, base_failed, rule_score and kept of every row."""
    held = docs.sparkSession.sparkContext.broadcast(forest)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = np.array(f["features"].tolist(), dtype=float).reshape(-1, len(FEATURES))
            yield f.drop(columns="features").assign(rule_score=held.value.score(x))

    rows = add_statistics(texts(docs))
    schema = ", ".join([f"doc_id {docs.schema['doc_id'].dataType.simpleString()}", *[f"{c} long" for c in COUNTS], "rule_score double"])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.mapInPandas(run, schema).withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("rule_score") >= KEEP))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).select("doc_id", *COUNTS, "base_failed", "kept", "rule_score")

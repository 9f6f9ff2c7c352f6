"""Quality classifier: a byte-level convolutional network in numpy.

A filter is a table (width x 256): its response at a byte is the sum of the entries
of the next `width` bytes. Responses are max-pooled over chunks of CHUNK bytes that
overlap by half and cover the whole text; a hidden layer turns each chunk into a
logit, and mean, largest and smallest logit are combined into one probability.
It is fitted on the driver on at most SAMPLE_DOCS labelled documents of together at
most SAMPLE_BYTES bytes (in order of hash; what does not fit is no row of the sample,
and a very long text never reaches the driver), on every byte of each: filters on all
chunks in every epoch, where a document's chunks together weigh as much as another's,
and the combiner on the same summaries of whole texts that scoring uses. Scoring reads
every byte of every text, of any length.
Defined cases: a null or empty text is one chunk of padding and gets a score; with
labels of fewer than two kinds every score is the smoothed share of label 1 (0.5
without labels); repeated rows score alike; an empty table gives an empty result;
`add_score` keeps other columns;
of several labels or texts of one doc_id the least is learnt from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import remainder, texts

CHUNK = 256
HALF = CHUNK // 2
WIDTH, FILTERS, HIDDEN = 5, 24, 16
SAMPLE_DOCS, SAMPLE_BYTES = 3_000, 64 << 20
EPOCHS, BATCH, RATE = 6, 64, 3e-3
THRESHOLD = 0.7


@dataclass
class Net:
    """None in `table` stands for a constant score, `prior`."""

    prior: float
    table: np.ndarray | None = None
    bias: np.ndarray | None = None
    w1: np.ndarray | None = None
    b1: np.ndarray | None = None
    w2: np.ndarray | None = None
    b2: float = 0.0
    out: np.ndarray | None = None

    def pooled(self, data: np.ndarray) -> np.ndarray:
        """Largest response of each filter in each half chunk (rows) of the padded bytes."""
        rows = []
        for k in range(0, len(data) - WIDTH + 1, 64 * HALF):
            part = data[k : k + 64 * HALF + WIDTH - 1]
            n = len(part) - WIDTH + 1
            z = self.table[0][part[:n]]
            for j in range(1, WIDTH):
                z += self.table[j][part[j : j + n]]
            rows.append(z.reshape(n // HALF, HALF, FILTERS).max(axis=1))
        return np.concatenate(rows)

    def chunk_logits(self, text: bytes) -> np.ndarray:
        size = max(2, -(-len(text) // HALF)) * HALF
        data = np.zeros(size + WIDTH - 1, dtype=np.uint8)
        data[: len(text)] = np.frombuffer(text, dtype=np.uint8)
        halves = self.pooled(data)
        top = np.maximum(halves[:-1], halves[1:]) + self.bias
        hidden = np.maximum(np.maximum(top, 0) @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def score(self, text: str | None) -> float:
        if self.table is None:
            return self.prior
        logits = self.chunk_logits((text or "").encode())
        return float(_sigmoid(np.append(_summary(logits), 1.0) @ self.out))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _summary(logits: np.ndarray) -> np.ndarray:
    return np.clip(np.array([logits.mean(), logits.max(), logits.min()]), -8, 8)


def fit(documents: list[bytes], labels: list[int], seed: int = 11) -> Net:
    """Train on whole documents with 0 / 1 labels."""
    y_doc = np.array(labels, dtype=np.float32)
    prior = float((y_doc.sum() + 1) / (len(y_doc) + 2))
    if len(set(labels)) < 2:
        return Net(prior)
    rng = np.random.default_rng(seed)
    # chunks side by side cover every byte; the last one is a whole chunk as well where the text has that many
    places = [[*range(0, max(1, len(t) - CHUNK + 1), CHUNK), *([len(t) - CHUNK] if len(t) > CHUNK and len(t) % CHUNK else [])] for t in documents]
    owner = np.repeat(np.arange(len(documents)), [len(p) for p in places])
    x = np.zeros((len(owner), CHUNK + WIDTH - 1), dtype=np.uint8)
    for i, w in enumerate(t[k : k + CHUNK] for t, p in zip(documents, places, strict=True) for k in p):
        x[i, : len(w)] = np.frombuffer(w, dtype=np.uint8)
    y = y_doc[owner]
    # the rarer label counts more, but not as much as balance would ask for
    weight = np.where(y == 1, 1.0, np.clip(y_doc.mean() / max(1e-6, 1 - y_doc.mean()), 1, 3)).astype(np.float32)
    share = 1.0 / np.bincount(owner)[owner]
    weight *= (share / share.mean()).astype(np.float32)
    p = {
        "table": rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32), "bias": np.zeros(FILTERS, np.float32),
        "w1": rng.normal(0, 0.4, (FILTERS, HIDDEN)).astype(np.float32), "b1": np.zeros(HIDDEN, np.float32),
        "w2": rng.normal(0, 0.4, HIDDEN).astype(np.float32), "b2": np.zeros(1, np.float32),
    }
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            xb, n = x[rows], len(rows)
            z = p["table"][0][xb[:, :CHUNK]]
            for j in range(1, WIDTH):
                z += p["table"][j][xb[:, j : j + CHUNK]]
            where = z.argmax(axis=1)
            top = np.take_along_axis(z, where[:, None, :], 1)[:, 0] + p["bias"]
            act = np.maximum(top, 0)
            pre = act @ p["w1"] + p["b1"]
            hid = np.maximum(pre, 0)
            err = (_sigmoid(hid @ p["w2"] + p["b2"]) - y[rows]) * weight[rows] / n
            g_pre = np.outer(err, p["w2"]) * (pre > 0)
            g_top = g_pre @ p["w1"].T * (top > 0)
            cells = [(np.take_along_axis(xb, where + j, 1).astype(np.intp) + 256 * j) * FILTERS + np.arange(FILTERS) for j in range(WIDTH)]
            g_table = np.bincount(np.concatenate(cells, axis=None), np.tile(g_top.ravel(), WIDTH), p["table"].size).reshape(p["table"].shape)
            grads = {"table": g_table, "bias": g_top.sum(0), "w1": act.T @ g_pre, "b1": g_pre.sum(0), "w2": hid.T @ err, "b2": np.array([err.sum()])}
            step += 1
            for k, g in grads.items():
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.99 * m2[k] + 0.01 * g * g
                p[k] -= (RATE * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    net = Net(prior, p["table"], p["bias"], p["w1"], p["b1"], p["w2"], float(p["b2"][0]))
    seen = np.array([np.append(_summary(net.chunk_logits(t)), 1.0) for t in documents])
    net.out = _logistic(seen, y_doc)
    return net


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 25) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        q = _sigmoid(x @ w)
        hess = (x * (q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(hess, x.T @ (y - q) - ridge * w)
    return w


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Net:
    """Fit on the labelled rows of docs whose crc32(doc_id as text) mod 4 is not 2, at most `sample` rows and `sample_bytes` bytes."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("y IN (0, 1)").where(remainder(F.col("doc_id"), 4) != 2)
    # the rows are chosen by id before any text is read
    chosen = known.join(docs.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = texts(docs).where(F.octet_length("text") <= sample_bytes).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("y").alias("y"), F.min("text").alias("text"))
    kept, room = [], sample_bytes
    for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id").toLocalIterator():
        text = r.text.encode()
        if len(text) <= room:
            kept.append((r.doc_id, text, r.y))
            room -= len(text)
    kept.sort(key=lambda r: r[0])
    return fit([text for _, text, _ in kept], [y for _, _, y in kept])


def add_score(docs: DataFrame, net: Net, name: str = "score") -> DataFrame:
    """docs with the score of `text`; the other columns pass through."""
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(**{name: np.array([held.value.score(t) for t in f["text"]], dtype=float)})

    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in docs.schema)
    return docs.mapInPandas(run, f"{schema}, `{name}` double")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = add_score(texts(docs), net)
    return scored.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

import gc
import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from ringdata.llm import pitman_yor as p
from ringdata.llm import seating


def exact(c, x, d):
    """Mean and variance of p(t) ~ S(c, t) x^t by the whole recurrence."""
    t, row = np.arange(c + 2), np.full(c + 2, -np.inf)
    row[0] = 0.0
    with np.errstate(divide="ignore", invalid="ignore"):
        for k in range(c):
            new = row + np.log(np.maximum(k - d * t, 0))
            new[1:] = np.logaddexp(new[1:], row[:-1])
            new[0] = -np.inf
            row = new
    w = np.exp(row + t * math.log(x) - (row + t * math.log(x)).max())
    mean = (w * t).sum() / w.sum()
    return mean, (w * t * t).sum() / w.sum() - mean * mean


@pytest.mark.parametrize(("c", "x", "d"), [(2, 0.3, 0.5), (9, 1.7, 0.5), (40, 2.0, 0.6), (41, 2.0, 0.6), (80, 2.0, 0.6), (400, 20.0, 0.8), (400, 0.01, 0.8), (2_000, 5.0, 0.8), (10_000, 3.0, 0.8), (10_000, 1_200.0, 0.8)])
def test_tables_against_the_whole_distribution(c, x, d):
    mean, var = exact(c, x, d)
    n = 20_000
    got = seating.sample_tables(np.full(n, c), np.full(n, x), d, np.arange(n, dtype=np.uint64) * np.uint64(7919), 3)
    assert abs(seating.mean_tables(np.array([c]), np.array([x]), d)[0] - mean) < 0.004 * mean
    assert abs(got.mean() - mean) < 0.005 * mean + 4 * math.sqrt(var / n)
    assert abs(got.var() - var) < 0.08 * var + 0.02
    assert got.min() >= 1 and got.max() <= c


def test_few_customers_and_hashed_numbers():
    got = seating.sample_tables(np.array([0, 1, 10**9]), np.array([0.5, 0.5, 3.0]), 0.3, np.arange(3, dtype=np.uint64), 1)
    assert got[0] == 0 and got[1] == 1 and 1 <= got[2] < 10**6
    u = seating.uniform(np.arange(100_000, dtype=np.uint64), 7)
    assert 0 < u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.005


def brute_scores(train, asked, d0, d1, sweeps=60, burn=20):
    """log10 of averaged predictive probabilities, by seating one customer after another."""
    rng = random.Random(5)
    tok = lambda t: [b"", *t.encode().lower().split(), b"\n"]
    vocabulary = {w for t in train for w in tok(t)[1:]}
    base = 1 / (len(vocabulary) + 1)
    tables = defaultdict(list)  # (context, word) -> customers of each table; the parent's context is None
    total, count = defaultdict(int), defaultdict(int)  # tables, customers of each context

    def prob(u, w):
        lower, theta, d = (base, p.THETA_ROOT, d0) if u is None else (prob(None, w), p.THETA, d1)
        own = tables.get((u, w), ())
        return (sum(own) - d * len(own) + (theta + d * total[u]) * lower) / (theta + count[u])

    def seat(u, w):
        lower, theta, d = (base, p.THETA_ROOT, d0) if u is None else (prob(None, w), p.THETA, d1)
        own = tables[u, w]
        k = rng.choices(range(len(own) + 1), [n - d for n in own] + [(theta + d * total[u]) * lower])[0]
        count[u] += 1
        if k < len(own):
            own[k] += 1
            return
        own.append(1)
        total[u] += 1
        if u is not None:
            seat(None, w)

    def leave(u, w):
        own = tables[u, w]
        k = rng.choices(range(len(own)), own)[0]
        own[k] -= 1
        count[u] -= 1
        if not own[k]:
            del own[k]
            total[u] -= 1
            if u is not None:
                leave(None, w)

    pairs = [x for t in train for x in zip(tok(t), tok(t)[1:], strict=False)]
    for u, w in pairs:
        seat(u, w)
    mean = [defaultdict(float) for _ in asked]
    for sweep in range(sweeps):
        rng.shuffle(pairs)
        for u, w in pairs:
            leave(u, w)
            seat(u, w)
        if sweep >= burn:
            for t, m in zip(asked, mean, strict=True):
                for k, (u, w) in enumerate(zip(tok(t), tok(t)[1:], strict=False)):
                    m[k] += prob(u, w) / (sweeps - burn)
    return [sum(map(math.log10, m.values())) for m in mean]


def test_scores_against_one_customer_after_another(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    make = lambda: " ".join(rng.choices(words, [1 / (i + 1) for i in range(60)], k=rng.randint(1, 25)))
    train, asked = [make() for _ in range(90)], [*[make() for _ in range(20)], "", "unknown", "w0 unknown w1", "w3 w3 w3"]
    rows = [(i, t, True) for i, t in enumerate(train)] + [(1_000 + i, t, False) for i, t in enumerate(asked)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    got = {r.doc_id: r for r in p.score(docs, least=(3, 2)).collect()}
    tok = lambda t: [b"", *t.encode().split(), b"\n"]
    pairs = Counter(x for t in train for x in zip(tok(t), tok(t)[1:], strict=False))
    contexts = Counter(w for _, w in pairs)
    of = lambda counts: p.discount(sum(v == 1 for v in counts.values()), sum(v == 2 for v in counts.values()))
    want = brute_scores(train, asked, of(contexts), of(pairs))
    for i, (t, w) in enumerate(zip(asked, want, strict=True)):
        assert abs(got[1_000 + i].score - w) < 0.03 * len(tok(t)), t
    assert abs(sum(got[1_000 + i].score for i in range(20)) / sum(want[:20]) - 1) < 0.01
    other = {r.doc_id: r.score for r in p.score(docs, least=(7, 5)).collect()}
    assert all(math.isclose(other[i], r.score, rel_tol=1e-9) for i, r in got.items())  # buckets and shards do not matter


def brute_base(rows):
    tok = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    c = Counter(w for i, t in rows if not held(i) for w in tok(t))
    n, v = sum(c.values()), len(c)
    return [(i, held(i), len(tok(t)), sum(c[w] > 0 for w in tok(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tok(t)), 6)) for i, t in rows]


def check(spark, rows, tmp):
    spark.createDataFrame([(i, t, True) for i, t in rows], "doc_id long, text string, train boolean").write.parquet(f"{tmp}/documents.parquet")
    got = p.op8_pitman_yor(spark, str(tmp)).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == sorted(brute_base(rows), key=str)
    return got


def test_base_and_model(spark, tmp_path):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(10_000, None), (10_001, ""), (10_001, ""), (None, "ABC é  x"), (10_002, "new " * 50_000)]
    one = check(spark, rows, tmp_path / "a")
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"train": p.remainder(F.col("doc_id"), 7) != 2, "bucket": F.lit(1), "kind": F.lit("x")})
    many = p.score(docs, bucket_bytes=40_000, least=(2, 70)).collect()
    assert sorted((str(r.doc_id), round(r.base_score, 6), round(r.score, 6)) for r in many) == sorted((str(r.doc_id), round(r.base_score, 6), round(r.score, 6)) for r in one)
    assert all(r.score <= 1e-9 for r in one)
    held = [r for r in one if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_few_and_no_rows(spark, tmp_path):
    check(spark, [(1, "only one")], tmp_path / "b")
    nothing = spark.createDataFrame([(1, "a b", False)], "doc_id long, text string, train boolean")
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in p.score(nothing, least=(2, 2)).collect()] == [(3, 0, 0)]
    assert p.score(nothing.limit(0), least=(2, 2)).count() == 0


def test_probabilities_sum_to_one(spark):
    words = ["a", "b", "c", "dd", "ee"]
    rows = [(i, " ".join(words[(i * k) % 5] for k in range(1, 9)), True) for i in range(40)]
    asked = ["", *words, "unknown", *[f"{a} {b}" for a in [*words, "unknown"] for b in [*words, "unknown"]]]
    rows += [(1_000 + i, t, False) for i, t in enumerate(asked)]
    got = {r.doc_id: 10.0**r.score for r in p.score(spark.createDataFrame(rows, "doc_id long, text string, train boolean"), least=(2, 2)).collect()}
    # the texts of up to one word: P(end | start) + sum of P(w | start) P(end | w); those of two words add to it, and all stay below one
    chance = dict(zip(asked, [got[1_000 + i] for i in range(len(asked))], strict=True))
    assert 0 < sum(chance.values()) < 1


def test_memory_of_a_bucket_and_a_shard():
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{i}" for i in (rng.pareto(0.8, 5_000) * 40).astype(np.int64) % 60_000) for _ in range(160)]
    shards = 4

    def peak(f):
        gc.collect()
        tracemalloc.start()
        out = f()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out, most

    sent = []
    for b in range(4):
        rows = pd.DataFrame({"text": texts[b::4], "train": True})
        bucket, most = peak(lambda: p.Bucket(rows, shards))  # noqa: B023
        assert most < 50 * len(bucket.at)
        sent += [m for m in bucket.asks(b, shards) if m[1] == 1]
    asked = p.messages(sent)
    pairs = sum(len(p.unpack(d)[3]) for d in asked["data"])
    got, most = peak(lambda: p.count_pairs(asked, shards))
    assert most < 45 * pairs
    # the pairs of the shard are counted as by hand
    words = [[b"", *t.encode().split(), b"\n"] for t in texts]
    counts = Counter(x for t in words for x in zip(t, t[1:], strict=False))
    code = lambda w: np.array([xxhash.xxh64_intdigest(w)], dtype=np.uint64)
    mine = Counter(n for (u, w), n in counts.items() if p.pair_shard(code(u), code(w), shards)[0] == 1)
    sums = next(m[4] for m in got if m[0] == "sums")
    assert sums == [mine[1], mine[2]]
    again = p.unpack(next(m[3] for m in got if m[0] == "pairs"))[3]
    assert Counter(again.tolist()) == Counter({n: k for n, k in mine.items() if n > 1})

import random
import re
from collections import Counter, defaultdict

from ringdata.llm import mixing


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    total, target, open_ = sum(sizes.values()), {}, set(order)
    while open_:
        left = total - sum(target.values())
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w >= 3 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / w for s in open_}
        for s in over:
            target[s] = 3 * sizes[s]
        open_ -= over
    return target


def check(spark, rows, tmp, near=0.02):
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, size int")
    df.write.mode("overwrite").parquet(f"{tmp}/documents.parquet")
    got = mixing.op5_mixing(spark, str(tmp)).collect()
    n = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, _, t, _ in rows]
    sizes = defaultdict(int)
    for (_, s, _, _), k in zip(rows, n):
        sizes[s] += k
    want = brute_targets(sizes)
    taken, src = Counter(), {i: s for i, s, _, _ in rows}
    assert sorted((r.doc_id, r.size) for r in got) == sorted((i, k) for (i, _, _, _), k in zip(rows, n))
    for r in got:
        s = src[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s]), (r, want[s])
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(near * want[s], 3), (s, taken[s], want[s])
    again = mixing.plan(df.repartition(7)).selectExpr("doc_id", "copies * size AS taken").collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    assert sum(len((r.text or "").split()) for r in mixed.collect()) == sum(taken.values())


def test_mixing(spark, tmp_path):
    r = random.Random(1)
    text = lambda k: " ".join(["w"] * k) + r.choice(["", " ", "\n\x0b"])
    rows = [(i, r.choice(["a", "b", "b", "b", "b", "c", "ä", None, "tiny"]) if i % 40 else "tiny", text(min(2000, int(r.paretovariate(0.9) * 5))), 7) for i in range(600)]
    rows += [(1000 + i, "b", text(50).strip(), 7) for i in range(700)] + [(2000, "zero", None, 7), (2001, "zero", "  ", 7), (2002, "one", "x", 7)]
    check(spark, rows, tmp_path / "a")
    check(spark, [(1, "s", "a b c", 0)], tmp_path / "b")
    assert mixing.plan(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0

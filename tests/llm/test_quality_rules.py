import random
import re
import zlib
from collections import Counter

import numpy as np

from ringdata.llm import quality_rules as q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    tri = Counter(zip(words, words[1:], words[2:]))
    hit = set()
    for i in range(len(words) - 2):
        if tri[tuple(words[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)]


def test_counts():
    r = random.Random(4)
    texts = [None, "", " \n", "a a a a", "a a a", "x y z x y z", "é b c\u0085d\n \n \n", "a\n\x0ba\na\n\n"]
    texts += ["".join(r.choice(["a", "b", "cc", "é", "# "]) + r.choice([" ", "\n", "  ", "\t"]) for _ in range(r.choice([3, 30, 400]))) for _ in range(60)]
    for t in texts:
        assert q.statistics(t)[0] == brute(t), t
    ids = np.concatenate([np.arange(1_500_000), np.arange(10)])
    assert q.repeat_words(ids) == 20


def test_forest_is_monotone_and_learns():
    r = np.random.default_rng(1)
    x = r.random((2_000, len(q.FEATURES)))
    y = ((x[:, 2] + 0.3 * x[:, 1] + 0.2 * r.standard_normal(2_000)) < 0.6).astype(float)
    forest = q.fit(x, y)
    assert ((forest.score(x) > 0.5) == y).mean() > 0.85
    for name, sign in q.MONOTONE.items():
        f = q.FEATURES.index(name)
        grid = np.repeat(x[:50], 30, axis=0)
        grid[:, f] = np.tile(np.linspace(-0.1, 1.1, 30), 50)
        steps = np.diff(forest.score(grid).reshape(50, 30), axis=1) * sign
        assert (steps >= -1e-12).all()


def test_flat_arrays_against_a_walk():
    r = np.random.default_rng(3)
    x = r.random((500, len(q.FEATURES)))
    forest = q.fit(x, (x[:, 0] + x[:, 3] > 1).astype(float))

    def walk(row, at):
        while forest.left[at] != at:
            at = forest.left[at] if row[forest.feature[at]] <= forest.threshold[at] else forest.right[at]
        return forest.value[at]

    want = [1 / (1 + np.exp(-(forest.start + sum(walk(row, at) for at in forest.roots)))) for row in x]
    assert np.allclose(forest.score(x), want)


def test_query(spark, tmp_path):
    d = "/root/testdata/sf0.1"
    got = q.op7_quality_rules(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    long = got[got.n_words >= 50]
    held_out = long[[zlib.crc32(str(i).encode()) % 4 == 2 for i in long.doc_id]]  # no label of these was seen
    assert len(held_out) > 500 and (held_out.kept == (held_out.quality == 1)).mean() > 0.98 and not got[got.base_failed].kept.any()
    docs = spark.createDataFrame([(1, None, 1), (2, "w " * 60 + "x", 1), (2, "w " * 60 + "x", 1), (None, " ".join(map(str, range(80))), 1)], "doc_id long, text string, n_words int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = q.op7_quality_rules(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.base_failed, r.kept) for r in rows) == [("1", True, False), ("2", True, False), ("2", True, False), ("None", False, True)]
    assert q.judge(docs.limit(0), q.fit(np.zeros((0, len(q.FEATURES))), np.zeros(0))).count() == 0

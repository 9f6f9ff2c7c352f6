import numpy as np
from pyspark.sql import functions as F

from ringdata.llm import quality_net as q


def test_conv_equals_loop():
    r = np.random.default_rng(0)
    net = q.Net(0.5, r.normal(size=(q.WIDTH, 256, q.FILTERS)).astype(np.float32), r.normal(size=q.FILTERS).astype(np.float32), r.normal(size=(q.FILTERS, q.HIDDEN)), r.normal(size=q.HIDDEN), r.normal(size=q.HIDDEN), 0.1)
    for text in (b"", b"abc", bytes(r.integers(0, 256, 9_000, dtype=np.uint8))):
        size = max(2, -(-len(text) // q.HALF)) * q.HALF
        data = text + b"\0" * (size + q.WIDTH - 1 - len(text))
        z = np.array([sum(net.table[j][data[p + j]] for j in range(q.WIDTH)) for p in range(size)])
        want = []
        for at in range(0, size - q.HALF, q.HALF):
            top = np.maximum(z[at : at + q.CHUNK].max(axis=0) + net.bias, 0)
            want.append(np.maximum(top @ net.w1 + net.b1, 0) @ net.w2 + net.b2)
        assert np.allclose(net.chunk_logits(text), want, atol=1e-3)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    got = q.op4_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert len(got) > 500 and got.score.between(0, 1).all()
    assert (got.predicted == got.quality).mean() > 0.97
    good = got[got.quality == 1]
    assert (good.predicted == 1).mean() > 0.98
    size = {r.doc_id: r.n_chars for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "n_chars").collect()}
    longest = got[got.doc_id.map(size).rank(pct=True) > 0.95]
    assert (longest.predicted == longest.quality).mean() > 0.95


def test_training_reads_whole_texts():
    """The only difference lies in the middle of long texts."""
    r = np.random.default_rng(2)
    word = lambda: bytes(r.integers(97, 123, 5, dtype=np.uint8))
    make = lambda bad: b" ".join(b"#$#$#" if bad and 600 <= i < 850 else word() for i in range(1_200))
    net = q.fit([make(i % 2) for i in range(400)], [1 - i % 2 for i in range(400)])
    assert all((net.score(make(bad).decode()) >= 0.5) != bad for bad in (True, False) * 5)


def test_every_chunk_is_learnt_from(monkeypatch):
    """A table entry moves for each byte value that only one chunk of a very long text holds."""
    r = np.random.default_rng(4)
    long = b"".join(bytes([128 + k]) * q.CHUNK for k in range(100))
    docs = [long, *[bytes(r.integers(97, 123, 300, dtype=np.uint8)) for _ in range(20)]]
    monkeypatch.setattr(q, "EPOCHS", 0)
    before = q.fit(docs, [0] + [1] * 20).table
    monkeypatch.setattr(q, "EPOCHS", 1)
    moved = np.abs(q.fit(docs, [0] + [1] * 20).table - before).max(axis=(0, 2)) > 0
    assert moved[128:228].all() and not moved[228:].any()


def test_sample_is_bounded_in_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "word " * (40 if i else 4_000)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(q, "fit", lambda texts, y: seen.append([len(t) for t in texts]))
    q.learn(docs, labels, sample_bytes=2_000)
    q.learn(docs, labels)
    assert sum(seen[0]) == 2_000 and set(seen[0]) == {200}
    assert len(seen[1]) > 30 and max(seen[1]) == 20_000


def test_ties_of_labels(spark):
    docs = spark.createDataFrame([(i, ("good words in here ", "### $$$ ### ")[i % 2] * 9) for i in range(40)] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i in range(40) for y in (1 - i % 2, 0 if i % 2 else 1)], "doc_id long, quality int")
    one, two = q.learn(docs, labels), q.learn(docs.orderBy(F.desc("doc_id")).repartition(3), labels.orderBy(F.desc("doc_id")))
    assert one.score("good words in here") == two.score("good words in here") > 0.5 > one.score("### $$$ ###")


def test_cases(spark, tmp_path):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "x " * 90_000, "a"), (3, "x " * 90_000, "a"), (None, "words here", "a")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = q.op4_quality(spark, str(tmp_path)).collect()
    assert len(got) == 5 and {r.score for r in got} == {0.5} and {r.predicted for r in got} == {0}
    net = q.fit([b"good words in here", b"### $$$ ###"] * 20, [1, 0] * 20)
    assert q.add_score(docs.select("doc_id", "text"), net).where(F.col("score").between(0, 1)).count() == 5
    assert q.add_score(docs.select("doc_id", "text").limit(0), net).count() == 0

import hashlib
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as c
from ringdata.llm import bpe, quality_net

D = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    extra = [(90_001, None, "en", None, 0), (90_002, "", None, "src1", 0), (None, "Write to ann@example.org, a new document of some words.", "en", "src1", 55)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    before, steps = docs, {}
    for name, stage in c.STAGES:
        out = stage(spark, before, D)
        out.write.parquet(f"{tmp_path}/{name}")
        steps[name] = (before, spark.read.parquet(f"{tmp_path}/{name}"))
        if name != "tokens":
            assert steps[name][1].schema.names == docs.schema.names
        before = steps[name][1]

    rows = lambda df: Counter(tuple(r) for r in df.collect())
    was, now = (rows(x) for x in steps["quality"])
    net = quality_net.learn(docs, spark.read.parquet(f"{D}/labels.parquet"))
    assert now == Counter({r: n for r, n in was.items() if net.score(r[1]) >= quality_net.THRESHOLD})

    was, now = (rows(x) for x in steps["near_dedup"])
    assert all(was[r] >= n for r, n in now.items()) and len({r[1] for r in now}) == sum(now.values())
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))}
    kept = [shingles(r[1]) for r in now]
    for r in was - now:
        s = shingles(r[1])
        assert max(len(s & k) / len(s | k) for k in kept) > 0.35, r  # what goes has a kin that stays

    was, now = (steps["personal_data"][k].collect() for k in (0, 1))
    assert len(was) == len(now)
    for r in now:
        assert not re.search(r"[\w.]+@[\w-]+\.\w|\+[0-9][ ().0-9-]{8,}[0-9]|(?<![0-9.])[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{1,2}(?![0-9.])", r.text) and r.n_chars == len(r.text)
    by = {r.doc_id: r.text for r in now}
    assert all(by[r.doc_id] == r.text for r in was if not re.search("[0-9@]", r.text))

    was, now = (rows(x) for x in steps["mixture"])
    assert set(now) <= set(was) and all(n <= 3 * was[r] for r, n in now.items())
    size = lambda rs: sum(n * len(r[1].encode().split()) for r, n in rs.items())
    assert abs(size(now) - size(was)) < 0.05 * size(was)

    hf = Tokenizer.from_file(bpe.default_vocabulary())
    was, got = steps["tokens"][0].collect(), steps["tokens"][1].collect()
    ids = lambda t: np.array(hf.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()
    assert Counter((r.doc_id, ids(r.text)) for r in was) == Counter((r.doc_id, bytes(r.ids)) for r in got)
    assert Counter(hashlib.sha256(r.text.encode()).hexdigest() for r in was) == Counter(r.decoded_sha256 for r in got)


def test_run_gives_the_same(spark):
    assert c.run(spark, D).count() > 0
    assert c.run(spark, D).select("doc_id", "ids_sha256").exceptAll(c.run(spark, D).select("doc_id", "ids_sha256")).count() == 0


def test_odd_rows_and_clashing_columns(spark):
    """Every stage: names that stages use themselves, repeated rows, very long and empty texts, nulls; then no rows at all."""
    more = ["_quality", "_pii", "_copies", "_k", "_times", "_id", "_KEY", "_rows", "_hash", "_source", "n", "a", "bucket"]
    docs = spark.read.parquet(f"{D}/documents.parquet").limit(40)
    odd = [(80_001, "long words here " * 30_000, "en", "src1", 480_000), (80_002, None, None, None, None), (80_003, "", "en", "src2", 0), (None, "Some words of a text that has no id at all.", "en", "src1", 43)]
    docs = docs.unionByName(spark.createDataFrame(odd + odd[:1] + odd[3:], docs.schema)).withColumns({c: F.lit(f"kept {c}") for c in more})
    for rows in (docs, docs.limit(0)):
        for name, stage in c.STAGES:
            out = stage(spark, rows, D)
            got = out.collect()
            assert set(out.columns) >= {"doc_id"} and (name == "tokens" or out.columns == docs.columns)
            if name != "tokens":
                assert all(r[m] == f"kept {m}" for r in got for m in more)
            assert bool(got) == bool(rows.count())

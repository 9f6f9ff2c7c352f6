"""Scores above a bound, documents by ranges, activity from a stream's state: against exhaustive or batch versions."""

import random

import pytest
from pyspark.sql import functions as F

from ringdata.operators import correlate as K
from ringdata.sources import files
from ringdata.streaming import incremental as T


def sessions(spark, rows):
    return spark.createDataFrame(rows, "subscriber string, destination string, port string, at long").select("subscriber", "destination", "port", F.timestamp_seconds("at").alias("ts"))


@pytest.mark.parametrize("block", [256, 5])
def test_pairs_above_a_score(spark, monkeypatch, block):
    """Equal to the exhaustive scores: hot items, copies, missing values, people with one item and with none."""
    monkeypatch.setattr(K, "BLOCK", block)
    r, rows = random.Random(3), []
    for person in range(60):
        for _ in range(r.choice([1, 3, 12, 30])):
            hot = r.random() < 0.6
            rows.append((f"p{person}", "everywhere" if hot else f"d{r.randrange(40)}", r.choice(["443", "80", None, "nan"]), 1_700_000_000 + 3600 * (r.randrange(3) if hot else r.randrange(60))))
    rows += [(f"twin{k}", dest, "9", 1_700_000_000) for k in range(12) for dest in ("x", "y")]
    rows += [("alone", None, None, None), ("", "x", "9", 1_700_000_000), (None, "x", "9", 1_700_000_000)]
    s = sessions(spark, rows)
    every = {(x.lo, x.hi): x for x in K.correlate_sessions(s).collect()}
    for least in (0.3, 0.5, 0.75, 1.0):
        got = {(x.lo, x.hi): x for x in K.correlate_above(s, least).collect()}
        want = {p: x for p, x in every.items() if x.score >= least}
        assert len(want) >= 66 and got == want
    assert K.correlate_above(s.limit(0), 0.5).count() == 0
    with pytest.raises(ValueError):
        K.correlate_above(s, 0.25)


def test_agent_documents_in_few_files(spark, tmp_path):
    """100,000 agents, one of them with a third of all rows, in 24 files; one agent is read from its own files."""
    one = spark.range(100_000).select(F.format_string("a%06d", "id").alias("agent_id"), F.lit("stats").alias("part"), F.lit(1).cast("long").alias("k"), F.struct(F.col("id").alias("calls")).alias("stats"), F.lit(None).cast("struct<ts: timestamp>").alias("item"))
    many = spark.range(50_000).select(F.lit("a050000").alias("agent_id"), F.lit("calls").alias("part"), (F.col("id") + 1).alias("k"), F.lit(None).cast("struct<calls: long>").alias("stats"), F.struct(F.timestamp_micros(F.col("id") + 1_700_000_000_000_001).alias("ts")).alias("item"))
    docs, path = one.unionByName(many), str(tmp_path / "docs")
    files.write_agent_docs(docs, path, files=24)
    assert len(list((tmp_path / "docs" / "documents").glob("*.json"))) <= 24
    assert files.read_agent_docs(spark, path, docs.schema).exceptAll(docs).count() == 0 == docs.exceptAll(files.read_agent_docs(spark, path, docs.schema)).count()
    large = files.read_agent_docs(spark, path, docs.schema, "a050000")
    assert large.count() == 50_001 and 1 < len(large.inputFiles()) < 24
    small = files.read_agent_docs(spark, path, docs.schema, "a000007")
    assert [r.stats.calls for r in small.collect()] == [7] and len(small.inputFiles()) == 1
    assert files.read_agent_docs(spark, path, docs.schema, "nobody").count() == 0
    for row in spark.read.parquet(f"{path}/files").where("agent_id IN ('a000007', 'a099999', 'a050000')").collect():
        lines = (tmp_path / "docs" / "documents" / row.file).read_text().splitlines()[row.first_row :][: row.rows]
        assert len(lines) == row.rows and all(f'"{row.agent_id}"' in x for x in lines)


def test_activity_over_ten_batches(spark, tmp_path):
    """Rows out of order and new files later: the state has a row a subject and equals the batch result."""
    folder, checkpoint = tmp_path / "in", str(tmp_path / "state")
    rows = spark.range(1_000).select(F.when(F.col("id") % 7 > 0, F.concat(F.lit("s"), F.col("id") % 7)).alias("subject"), F.timestamp_seconds(F.lit(1_700_000_000) - F.col("id") * 977 % 5_000).alias("ts"), (F.col("id") % 10).alias("batch"))
    for batch in range(10):
        rows.where(F.col("batch") == batch).drop("batch").coalesce(1).write.mode("append").parquet(str(folder))
    for further in range(2):
        if further:
            rows.limit(90).drop("batch").coalesce(1).write.mode("append").parquet(str(folder))
        got = T.stream_subject_activity(T.read_stream(spark, str(folder), "subject string, ts timestamp", files_per_trigger=1), "subject", checkpoint).collect()
        want = spark.read.parquet(str(folder)).groupBy("subject").agg(F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).collect()
        assert len(got) == 7 and {tuple(r) for r in got} == {tuple(r) for r in want}

"""Line dedup: lines that many documents repeat stay in one document only.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased. The
keys of every document are exploded and hashed (MD5, 16 bytes); distinct documents are
counted for each hash; keys of at least `min_chars` code points that at least `min_docs`
documents hold lose all their lines, except in the largest doc_id that holds them; what
stays is put together again by position.
Hot lines: documents are counted by (hash, document) before they are counted by hash,
both with partial sums, and the rows of hot hashes stay where they are and get their
verdict by broadcast (at most shared.HOT_SHARE rows of 40 bytes). Texts are shuffled
once, to meet the positions that they lose; lines travel as hashes.
Defined cases: a null or empty text is one empty line; a document is a doc_id, so rows
that repeat one count once for a line and are treated alike; rows without doc_id count
as one document, below all others; of two rows with equal doc_id and text, both stay;
very long texts and lines are read whole, in time linear in their length; an empty table
gives an empty result; other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import hot_keys, join_skewed, stored, unused, upper_to_lower

MIN_CHARS, MIN_DOCS = 20, 3
SPACE = " \t\n\v\f\r"


def split_lines(text: Column) -> Column:
    """The lines of a text; a null text has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def hashed_lines(docs: DataFrame, min_chars: int, *keep: str) -> DataFrame:
    """_at, _hash of every line whose key has at least min_chars code points, beside the columns `keep`; docs has text."""
    lines = docs.select(*keep, F.posexplode(split_lines(upper_to_lower(F.col("text")))).alias("_at", "_line"))
    key = F.btrim("_line", F.lit(SPACE))
    return lines.select(*keep, "_at", key.alias("_line")).where(F.length("_line") >= min_chars).select(*keep, "_at", F.unhex(F.md5("_line")).alias("_hash"))


def common_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """_hash, _last (the largest doc_id that holds it), n (its lines) of hashes in at least min_docs documents; lines has _doc and _hash."""
    once = lines.groupBy("_hash", "_doc").agg(F.count(F.lit(1)).alias("n"))
    held = once.groupBy("_hash").agg(F.count(F.lit(1)).alias("docs"), F.max("_doc").alias("_last"), F.sum("n").alias("n"))
    return held.where(F.col("docs") >= min_docs).drop("docs")


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """docs with the lines that stay as text, and two more columns: lines before, and lines dropped."""
    digest, n_chars = F.xxhash64("text"), F.length("text")
    keyed = docs.select(F.col("doc_id").alias("_doc"), digest.alias("_digest"), n_chars.alias("_size"), "text")
    row = ["_doc", "_digest", "_size"]
    common = stored(common_lines(hashed_lines(keyed, min_chars, "_doc"), min_docs), "common-lines")
    # rows of equal doc_id, digest and length are one text: each position is dropped once for all of them
    met = join_skewed(hashed_lines(keyed, min_chars, *row), common.drop("n"), "_hash", hot_keys(common, "_hash"))
    lost = met.where(~F.col("_doc").eqNullSafe(F.col("_last"))).groupBy(*row).agg(F.collect_set("_at").alias("_lost"))

    d, g, s, gone, work, before = unused(docs.columns, "_doc", "_digest", "_size", "_lost", "_work", "_lines")
    lost = lost.select(*(F.col(c).alias(f"{c}__r") for c in row), F.col("_lost").alias(gone))
    same = F.col("doc_id").eqNullSafe(F.col("_doc__r")) & F.xxhash64("text").eqNullSafe(F.col("_digest__r")) & F.length("text").eqNullSafe(F.col("_size__r"))
    rows = docs.join(lost, same, "left")
    rows = rows.withColumn(before, split_lines(F.col("text")))
    stay = F.array_except(F.sequence(F.lit(0), F.size(before) - 1), F.coalesce(gone, F.array().cast("array<int>")))
    # lines and places are bound once to a struct: a lambda evaluates what it names for every element
    rows = rows.withColumn(work, F.array(F.struct(F.col(before).alias("lines"), stay.alias("stay"))))
    kept = F.element_at(F.transform(work, lambda w: F.array_join(F.transform(w["stay"], lambda i: w["lines"][i]), "\n")), 1)
    names = {c: F.col(c) for c in docs.columns} | {"text": kept.alias("text")}
    out_lines, out_dropped = unused(docs.columns, n_lines, n_dropped)
    return rows.select(*names.values(), F.size(before).cast("long").alias(out_lines), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(out_dropped))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents
), keyed AS (
    SELECT doc_id, place, line, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM lines
), common AS (
    SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (c.last <> k.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (c.last IS NULL OR c.last = k.doc_id), '')) AS kept_sha256
FROM keyed k LEFT JOIN common c ON k.key = c.key
GROUP BY k.doc_id
"""

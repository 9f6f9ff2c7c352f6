"""Folders shared by driver and executors, and small column helpers."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringdata.sources.tables import cut, shared_dir

__all__ = ["cut", "shared_dir", "stored"]

#: A key is hot above GROUP_PART rows and a share of 1 / HOT_SHARE, so at most HOT_SHARE keys are.
GROUP_PART, HOT_SHARE = 500, 20_000


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder, in parts by some columns if asked, and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(df.columns)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and the columns named; other columns are dropped."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def upper_to_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def remainder(c: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n (null: the text is empty)."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def hot_keys(counts: DataFrame, key: str) -> DataFrame:
    """The hot keys of counts (key, n) as a column of the same name; at most HOT_SHARE rows."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.where(F.col("n") > max(GROUP_PART, math.ceil(total / HOT_SHARE))).select(key)


def join_skewed(rows: DataFrame, other: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """rows joined with other, which has one row a key; rows of hot keys stay where they are and get theirs by broadcast."""
    hot = hot.select(F.col(key).alias("_hot"))
    marked = rows.join(F.broadcast(hot), rows[key] == hot["_hot"], "left")
    mine = other.join(F.broadcast(hot), other[key] == hot["_hot"], "left_semi")
    cold = marked.where("_hot IS NULL").drop("_hot").join(other, key)
    return cold.unionByName(marked.where("_hot IS NOT NULL").drop("_hot").join(F.broadcast(mine), key))


def unused(columns: list[str], *names: str) -> list[str]:
    """Names like those given that no column has, in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out

"""Event times of whole sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringdata.functions import scalars as S


def date_orders(df: DataFrame, text: str, source: list[str]) -> DataFrame:
    """source, year_first: whether more than half of a source's texts that are not blank start (null: all are blank) with the year."""
    return df.groupBy(*source).agg((F.avg(S.year_first(F.col(text)).cast("int")) > 0.5).alias("year_first"))


def parse_event_times(df: DataFrame, text: str, zone: Column | None = None, source: list[str] | None = None, into: str = "event", default_zone: str = S.ZONE) -> DataFrame:
    """df with `into`, the struct of scalars.parse_event_time, with each source's order of dates.

    Each source (a file, an export; all rows are one if there is none) votes once: where
    most texts start with the year, a date such as 01/02/2024 has its month first, else
    its day. The vote is an aggregate of a row for each source, joined to the rows; a
    source without any text has only times that are missing.
    """
    keys = source or []
    votes = date_orders(df, text, keys).select(*[F.col(k).alias(f"_vote_{k}") for k in keys], F.col("year_first").alias("_year_first"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_vote_{k}"))
    joined = df.join(votes if keys else F.broadcast(votes), same, "left")  # without keys the vote is one row
    day_first = ~F.coalesce("_year_first", F.lit(False))
    return joined.select(*df.columns, S.parse_event_time(F.col(text), zone, default_zone, day_first).alias(into))

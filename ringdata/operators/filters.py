"""Row filters."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns that must not hold letters, and words that mark a junk row.
LETTER_COLUMNS = ["Mobile_No", "Other_Party_No", "SMSC_No", "LRN_B_Party_No", "Original_Originated_Party"]
KEYWORDS = ["otp", "spam"]


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _junk(df: DataFrame, letter_columns, keywords, strict: bool) -> tuple[Column, Column]:
    wanted = df.columns if letter_columns == "all" else letter_columns
    missing = [c for c in wanted if c not in df.columns]
    if strict and missing:
        raise ValueError(f"no columns {missing}")
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    letters = _any([text(c).rlike("[A-Za-z]") for c in wanted if c in df.columns])
    pattern = "(?i)" + "|".join(re.escape(k) for k in keywords)
    words = _any([text(c).rlike(pattern) for c in df.columns]) if keywords else F.lit(False)
    return letters, words


def filter_junk(df: DataFrame, letter_columns=LETTER_COLUMNS, keywords=KEYWORDS, strict: bool = False) -> DataFrame:
    """Rows without letters in the columns named ('all': any) and without a keyword in any cell."""
    letters, words = _junk(df, letter_columns, keywords, strict)
    return df.where(~letters & ~words)


def junk_reasons(df: DataFrame, letter_columns=LETTER_COLUMNS, keywords=KEYWORDS, strict: bool = False) -> DataFrame:
    """rows_read, rows_kept, rows_removed and the rows of each reason (a row may have both)."""
    letters, words = _junk(df, letter_columns, keywords, strict)
    return df.agg(
        F.count(F.lit(1)).alias("rows_read"), F.count_if(~letters & ~words).alias("rows_kept"), F.count_if(letters | words).alias("rows_removed"),
        F.count_if(letters).alias("letter_rows"), F.count_if(words).alias("keyword_rows"),
    )


def relevant_events(df: DataFrame, people: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of which any of the columns is one of people (column person); test this before parsing times."""
    p = people.select("person").distinct()
    flagged = df
    for i, c in enumerate(columns):
        flagged = flagged.join(p.withColumnRenamed("person", f"_p{i}"), F.col(c) == F.col(f"_p{i}"), "left")
    return flagged.where(_any([F.col(f"_p{i}").isNotNull() for i in range(len(columns))])).select(*df.columns)


def usable_calls(df: DataFrame, a: str = "caller", b: str = "receiver") -> DataFrame:
    """No blank end, no call to oneself."""
    return df.where((F.trim(F.coalesce(a, F.lit(""))) != "") & (F.trim(F.coalesce(b, F.lit(""))) != "") & (F.col(a) != F.col(b)))


def usable_measures(df: DataFrame, duration: str | None = None, volume: str | None = None, destination: str | None = None) -> DataFrame:
    """P5: durations of at least 0, volumes above 0, destinations that are not blank."""
    tests = []
    if duration:
        tests.append(F.col(duration) >= 0)
    if volume:
        tests.append(F.col(volume) > 0)
    if destination:
        tests.append(F.trim(F.col(destination)) != "")
    return df.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def search(df: DataFrame, columns: list[str], text: str) -> DataFrame:
    """Rows whose columns, joined by spaces, contain the text; empty: all rows."""
    if not text.strip():
        return df
    return df.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(text.strip().lower())))


def contacts_by_direction(df: DataFrame, mode: str) -> DataFrame:
    """Contacts with incoming / outgoing / both kinds of calls / all."""
    tests = {"incoming": F.col("incoming") > 0, "outgoing": F.col("outgoing") > 0, "both": (F.col("incoming") > 0) & (F.col("outgoing") > 0), "all": F.lit(True)}
    return df.where(tests[mode])


def calls_by_direction(df: DataFrame, person: str, mode: str = "all") -> DataFrame:
    """A person's calls, tagged outgoing or incoming, newest first."""
    out = df.where(F.col("caller") == person).withColumn("direction", F.lit("outgoing")).withColumn("other", F.col("receiver"))
    into = df.where(F.col("receiver") == person).withColumn("direction", F.lit("incoming")).withColumn("other", F.col("caller"))
    both = {"outgoing": out, "incoming": into, "all": out.unionByName(into)}[mode]
    return both.orderBy(F.col("ts").desc(), "direction", "other")

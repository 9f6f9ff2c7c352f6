"""Alias maps and identifier resolution (S4-S8, J1, J2, X2). A match is evidence, never proof, of identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringdata.functions import scalars as S
from ringdata.operators.schema import find_column, plain_name

# Names of the canonical and the alias columns of a map, and further identity columns.
CANONICAL_NAMES = ["canonical_id", "canonical", "person_id", "subscriber_id", "subscriber", "target_id", "target"]
ALIAS_NAMES = ["alias", "alias_id", "source_identifier", "source_id", "msisdn", "mobile_no", "phone", "alternate_msisdn", "from"]
MELTED_NAMES = ["msisdn", "Mobile_No", "source_identifier", "alternate_msisdn", "imei", "imsi", "alias", "alias_id"]
SUBSCRIBER_COLUMNS = ["subscriber_id", "msisdn", "Mobile_No", "Landline/MSISDN/MDN/Leased Circuit ID for Internet Access", "source_identifier", "imei", "imsi", "User Id for internet Access based on authentication"]
PAIR_COLUMNS = [
    ("person_a", "person_b"), ("msisdn_u", "msisdn_v"), ("subscriber_id_u", "subscriber_id_v"), ("source_identifier_u", "source_identifier_v"), ("person_1", "person_2"),
    ("user_a", "user_b"), ("user_1", "user_2"), ("caller", "receiver"), ("caller_id", "receiver_id"),
]
LABEL_NAMES = ["label", "is_friend_or_interacting", "friend_or_interacting", "is_friend", "is_interacting", "target", "relationship", "base_truth", "ground_truth", "truth_label"]
#: Largest alias map (rows) that is broadcast for a lookup; a row is two identifiers, well under 1 kB.
BROADCAST_ALIASES = 200_000


def finalize_map(rows: DataFrame) -> DataFrame:
    """alias, canonical, ambiguous: an alias of several canonicals is held apart (canonical null)."""
    kept = rows.where("alias <> '' AND canonical <> ''")
    return kept.groupBy("alias").agg(F.min("canonical").alias("c"), F.count_distinct("canonical").alias("n")).select("alias", F.when(F.col("n") == 1, F.col("c")).alias("canonical"), (F.col("n") > 1).alias("ambiguous"))


def alias_map_from_table(df: DataFrame, country_code: str = S.COUNTRY_CODE) -> DataFrame:
    """Melt a wide table's identity columns to (alias, canonical, ambiguous). The canonical is normalized once, by its own column's rule; where it is blank, the row's first other identity is."""
    canonical, alias = find_column(df.columns, CANONICAL_NAMES), find_column(df.columns, ALIAS_NAMES)
    if canonical is None:
        if len(df.columns) < 2:
            raise ValueError(f"no canonical and alias column among {df.columns}")
        canonical, alias = df.columns[:2]
    melted = {plain_name(n) for n in MELTED_NAMES}
    columns = [canonical, *[c for c in df.columns if c != canonical and (c == alias or plain_name(c) in melted)]]
    norm = lambda c: S.normalize_identifier(F.col(f"`{c}`"), S.is_phone_field(c), country_code)
    target = F.coalesce(*[F.when(norm(c) != "", norm(c)) for c in columns])
    entry = [F.struct(norm(c).alias("alias"), target.alias("canonical")) for c in columns]
    return finalize_map(df.select(F.inline(F.array(*entry))))


def alias_map_from_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object {alias: canonical}, {canonical: [aliases]} or {key: {canonical, aliases}}, or a list of {alias, canonical}. No phone rule applies."""
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("j"))
    is_list = F.col("j").startswith("[")
    listed = text.where(is_list).select(F.inline(F.from_json("j", "array<struct<alias:string,canonical:string>>")))
    entries = text.where(~is_list).select(F.explode(F.from_json("j", "map<string,string>")).alias("k", "v"))
    many, one = F.from_json("v", "array<string>"), F.from_json("v", "struct<canonical:string,canonical_id:string,aliases:array<string>>")
    pair = lambda a, c: F.struct(a.alias("alias"), c.alias("canonical"))
    key, value = F.col("k"), F.col("v")
    target = F.coalesce(one["canonical"], one["canonical_id"], key)
    rows = (
        F.when(value.startswith("["), F.transform(F.array_append(many, key), lambda a: pair(a, key)))
        .when(value.startswith("{"), F.transform(F.array_union(F.coalesce(one["aliases"], F.array().cast("array<string>")), F.array(key, target)), lambda a: pair(a, target)))
        .otherwise(F.array(pair(key, value), pair(value, value)))
    )
    both = listed.unionByName(entries.select(F.inline(rows)))
    return finalize_map(both.select(S.normalize_identifier(F.col("alias")).alias("alias"), S.normalize_identifier(F.col("canonical")).alias("canonical")).distinct())


def merge_alias_maps(a: DataFrame, b: DataFrame) -> DataFrame:
    """An alias stays ambiguous if it is so in either map, or if the maps disagree."""
    both = a.unionByName(b).groupBy("alias").agg(F.max("ambiguous").alias("amb"), F.min("canonical").alias("c"), F.count_distinct("canonical").alias("n"))
    ambiguous = F.col("amb") | (F.col("n") > 1)
    return both.select("alias", F.when(~ambiguous, F.col("c")).alias("canonical"), ambiguous.alias("ambiguous"))


def ambiguous_aliases(rows: DataFrame) -> DataFrame:
    """Aliases with several canonicals, and how many. rows: alias, canonical."""
    return rows.groupBy("alias").agg(F.count_distinct("canonical").alias("canonicals")).where("canonicals > 1")


def read_pairs(df: DataFrame, require_label: bool = False, row_number: str | None = None) -> DataFrame:
    """person_a, person_b, label (parsed, null if invalid or absent) and source_row."""
    a, b = next(((x, y) for x, y in PAIR_COLUMNS if find_column(df.columns, [x]) and find_column(df.columns, [y])), (None, None))
    if a is None:
        raise ValueError(f"no pair of person columns among {df.columns}")
    a, b = find_column(df.columns, [a]), find_column(df.columns, [b])
    label = find_column(df.columns, LABEL_NAMES)
    if require_label and label is None:
        raise ValueError(f"no label column among {df.columns}")
    norm = lambda c: S.normalize_identifier(F.col(f"`{c}`"), S.is_phone_field(c))
    parsed = S.parse_label(F.col(f"`{label}`").cast("string")) if label else F.lit(None).cast("int")
    return df.select(norm(a).alias("person_a"), norm(b).alias("person_b"), parsed.alias("label"), (F.col(row_number) if row_number else F.lit(None).cast("long")).alias("source_row"))


def subscriber_aliases(df: DataFrame) -> DataFrame:
    """Aliases of a subscriber table; canonical is the first of SUBSCRIBER_COLUMNS that is not blank."""
    columns = [c for n in SUBSCRIBER_COLUMNS if (c := find_column(df.columns, [n]))]
    norm = [S.normalize_identifier(F.col(f"`{c}`"), S.is_phone_field(c)) for c in columns]
    canonical = F.coalesce(*[F.when(c != "", c) for c in norm], F.lit(""))
    return finalize_map(df.select(F.inline(F.array(*[F.struct(c.alias("alias"), canonical.alias("canonical")) for c in norm]))))


def canonicalize_ids(df: DataFrame, column: str, phone: bool, alias_map: DataFrame, policy: str = "quarantine", into: str = "canonical") -> DataFrame:
    """J1 (policy 'quarantine') and J2 ('drop_ambiguous'): df with `into` and `into`_reason.

    The spellings of an identifier are tried in order. Quarantine: the first that is
    ambiguous gives '' / ambiguous_mapping, the first that maps gives its canonical;
    drop_ambiguous: ambiguous aliases count as absent. Else the first spelling.
    """
    known = alias_map if policy == "quarantine" else alias_map.where("NOT ambiguous")
    if known.limit(BROADCAST_ALIASES + 1).count() <= BROADCAST_ALIASES:
        known = F.broadcast(known)
    out = df.withColumn("_v", S.identifier_variants(F.col(f"`{column}`"), phone))
    hits: list[Column] = []
    for i in range(3):
        side = known.select(F.col("alias").alias(f"_a{i}"), F.struct("canonical", "ambiguous").alias(f"_h{i}"))
        out = out.join(side, F.get("_v", F.lit(i)) == F.col(f"_a{i}"), "left")
        hits.append(F.col(f"_h{i}"))
    first = F.coalesce(*hits)
    value = F.when(F.size("_v") == 0, "").when(first["ambiguous"], "").otherwise(F.coalesce(first["canonical"], F.get("_v", F.lit(0))))
    reason = F.when(F.size("_v") == 0, "missing").when(first["ambiguous"], "ambiguous_mapping").when(first.isNotNull(), "explicit_mapping").otherwise("normalized_identifier")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], value.alias(into), reason.alias(f"{into}_reason"))

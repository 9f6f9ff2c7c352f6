"""Two-source evidence and the decision on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def source_summary(df: DataFrame) -> DataFrame:
    """A1. df: subject, subject_reason, contact, contact_reason, ts_status."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("subject") == "").alias("missing_id_rows"),
        F.count_if((F.col("subject_reason") == "ambiguous_mapping") | (F.col("contact_reason") == "ambiguous_mapping")).alias("ambiguous_rows"),
        F.count_if(F.col("ts_status").isin("invalid", "missing", "invalid_zone")).alias("invalid_timestamp_rows"), F.count_if(F.col("ts_status") == "invalid_zone").alias("invalid_zone_rows"),
        F.count_distinct(F.when(F.col("subject") != "", F.col("subject"))).alias("subjects"), F.count_distinct(F.when(F.col("contact") != "", F.col("contact"))).alias("contacts"),
    )


def subject_activity(df: DataFrame, subject: str, ts: str = "ts") -> DataFrame:
    """A2: rows, first and last instant of every subject."""
    return df.where(F.col(subject) != "").groupBy(F.col(subject).alias("subject")).agg(F.count(F.lit(1)).alias("rows"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def contact_activity(df: DataFrame, contact: str) -> DataFrame:
    """A3."""
    return df.where(F.col(contact) != "").groupBy(F.col(contact).alias("contact")).agg(F.count(F.lit(1)).alias("rows"))


def timestamp_quality(df: DataFrame, status: str = "ts_status", has_zone_column: bool = False) -> DataFrame:
    """A4: counts of time values and one word for how their zones were known."""
    c = lambda *s: F.count_if(F.col(status).isin(*s))
    counted = df.agg(F.count(F.lit(1)).alias("total"), c("explicit", "zone", "assumed").alias("valid"), c("invalid", "missing", "invalid_zone").alias("invalid"), c("invalid_zone").alias("bad_zone"), c("explicit").alias("explicit"), c("zone", "assumed", "invalid").alias("naive"), c("missing").alias("missing"))
    word = (
        F.when(F.col("total") == F.col("missing"), "unavailable")
        .when(F.col("bad_zone") > 0, "invalid_timezone_values")
        .when((F.col("naive") > 0) & (F.col("explicit") > 0), "mixed_explicit_and_per_row" if has_zone_column else "mixed_explicit_and_assumed")
        .when(F.col("naive") > 0, "per_row_timezone" if has_zone_column else "naive_assumed")
        .otherwise("explicit")
    )
    return counted.select("total", "valid", "invalid", "bad_zone", word.alias("zone_status"))


def observation_overlap(a: DataFrame, b: DataFrame, ts: str = "ts") -> DataFrame:
    """A5: the common period of two sources (each reduced to one row first)."""
    span = lambda df, n: df.agg(F.min(ts).alias(f"{n}_start"), F.max(ts).alias(f"{n}_end"))
    both = span(a, "a").join(span(b, "b"), F.lit(True))
    start, end = F.greatest("a_start", "b_start"), F.least("a_end", "b_end")
    missing = F.col("a_start").isNull() | F.col("b_start").isNull()
    status = F.when(missing, "unavailable").when(start <= end, "overlap").otherwise("non_overlapping")
    return both.select(F.when(status == "overlap", start).alias("start_ts"), F.when(status == "overlap", end).alias("end_ts"), status.alias("status"))


def match_subjects(a: DataFrame, b: DataFrame) -> DataFrame:
    """Subject and where it occurs (matched, cdr_only, ipdr_only). a, b: a subject a row."""
    x, y = a.select("subject").distinct().withColumn("in_a", F.lit(True)), b.select("subject").distinct().withColumn("in_b", F.lit(True))
    where = F.when(F.col("in_a") & F.col("in_b"), "matched").when(F.col("in_a"), "cdr_only").otherwise("ipdr_only")
    return x.join(y, "subject", "full_outer").select("subject", where.alias("status"))


def match_coverage(matches: DataFrame) -> DataFrame:
    """Counts and shares; the share of an empty side is null."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    counted = matches.agg(n("matched").alias("matched"), n("cdr_only").alias("cdr_only"), n("ipdr_only").alias("ipdr_only"))
    share = lambda side: F.when(F.col("matched") + F.col(side) > 0, F.col("matched") / (F.col("matched") + F.col(side)))
    return counted.select("*", share("cdr_only").alias("cdr_coverage"), share("ipdr_only").alias("ipdr_coverage"))


def matched_details(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both sides' activity (A2) of matched subjects."""
    left, right = (x.select("subject", *[F.col(c).alias(f"{n}_{c}") for c in ("rows", "first_ts", "last_ts")]) for x, n in ((a, "cdr"), (b, "ipdr")))
    return left.join(right, "subject")


def contact_only(subjects: DataFrame, contacts: DataFrame) -> DataFrame:
    """Contacts (column contact) that are never a subject."""
    return contacts.select("contact").distinct().join(subjects.select(F.col("subject").alias("contact")).distinct(), "contact", "left_anti")


def content_fingerprint(df: DataFrame) -> DataFrame:
    """Rows and a digest of the content that does not depend on their order: the sum of 60 bits of every row's MD5.

    A row is its columns as text in the order of df, each with its length before it; a null has a sign of its own.
    """
    cells = [F.coalesce(F.concat(F.length(F.col(f"`{c}`").cast("string")), F.lit(":"), F.col(f"`{c}`").cast("string")), F.lit("-")) for c in df.columns]
    bits = F.conv(F.substring(F.md5(F.concat(*cells)), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(bits), F.lit(0)).cast("string").alias("digest"))


def validation_fingerprint(settings: dict[str, str], *content: DataFrame) -> DataFrame:
    """S11, for a whole check: one SHA-256 of the settings (zone, country code, schemas, ...) by name and of the given content fingerprints in order."""
    said = F.lit("\n".join(f"{k}={settings[k]}" for k in sorted(settings)))
    out, parts = None, []
    for i, c in enumerate(content):
        one = c.select(F.concat_ws(" ", "rows", "digest").alias(f"c{i}"))
        out, parts = one if out is None else out.join(one, F.lit(True)), [*parts, F.col(f"c{i}")]  # one row each
    return out.select(F.sha2(F.concat_ws("\n", said, *parts), 256).alias("fingerprint"))


def identity_decision(evidence: DataFrame, answer: Column, mode: Column) -> DataFrame:
    """What may be done with each row of evidence; identifiers agreeing is evidence, and confirmation never overrides it.

    evidence: cdr_present, ipdr_present (booleans), cdr_count, ipdr_count, matched,
    ambiguous. Adds answer, mode, allowed, status, blockers, warnings and operations.
    """
    spoken = F.regexp_replace(F.trim(F.regexp_replace(F.lower(F.replace(F.coalesce(answer, F.lit("")), F.lit("_"), F.lit(" "))), r"\s+", " ")), "-", " ")
    word = (
        F.when(spoken.isin("same", "same person"), "same_person")
        .when(spoken.isin("different", "different people"), "different_people")
        .when(spoken.isin("multiple", "multiple people", "multiple person dataset"), "multiple_person_dataset")
        .when(spoken == "not sure", "not_sure")
    )
    asked = F.regexp_replace(F.lower(F.trim(F.coalesce(mode, F.lit("")))), r"[-\s]", "_")
    chosen = (
        F.when(asked == "", None)
        .when(asked.isin("combined_same_person", "same_person"), "combined")
        .when(asked == "different_people", "separate_sources")
        .when(asked.isin("multi_person", "multiple_person_dataset"), "multi_person_conditioned")
        .when(asked == "template_expansion", "single_person_template")
        .when(asked == "ipdr_only", "ipdr_only_correlation")
        .otherwise(asked)
    )
    cdr, ipdr = F.col("cdr_present"), F.col("ipdr_present")
    both = cdr & ipdr
    n, p, m = F.col("cdr_count"), F.col("ipdr_count"), F.col("matched")
    default = (
        F.when(both, F.when(word == "same_person", "combined").when(word == "different_people", "separate_sources").when(word == "multiple_person_dataset", "multi_person_conditioned").when(word == "not_sure", "review_required"))
        .when(cdr, "cdr_only")
        .when(ipdr, "ipdr_only_correlation")
    )
    used = F.coalesce(chosen, default)
    waiting = both & word.isNull()
    rules = [
        (waiting, "an identity answer is needed before both sources are used"),
        (~both & answer.isNotNull() & word.isNull(), "the identity answer is not one of the four"),
        (~cdr & ~ipdr, "no source is given"),
        (cdr & ~waiting & (n < 1), "the call records hold no usable subject"),
        (cdr & ~ipdr & ~used.isin("cdr_only", "single_person_template"), "call records alone allow cdr_only or single_person_template"),
        (ipdr & ~cdr & (used != "ipdr_only_correlation"), "sessions alone allow ipdr_only_correlation"),
        (both & (word == "same_person") & ~used.isin("combined", "single_person_template"), "same person needs combined or single_person_template"),
        (both & (word == "same_person") & ~((n == 1) & (p == 1) & (m == 1)), "same person needs one subject in each source, matched"),
        (both & (word == "same_person") & (F.col("ambiguous") > 0), "an ambiguous alias must be corrected first"),
        (both & (word == "different_people") & used.isin("combined", "multi_person_conditioned"), "different people cannot be combined"),
        (both & (word == "multiple_person_dataset") & ~used.isin("multi_person_conditioned", "separate_sources", "cdr_only"), "several people need matching by subject or separate sources"),
        (both & (word == "not_sure") & ~used.isin("cdr_only", "ipdr_only_correlation", "separate_sources", "review_required"), "not sure cannot enable combined processing"),
    ]
    notes = [
        (both & (word == "different_people"), "identities stay separate"),
        (both & (word == "multiple_person_dataset") & ((m < n) | (m < p)), "partial coverage: unmatched profiles inherit nothing"),
        (both & (word == "not_sure"), "for review; confirmation does not override contradictions"),
    ]
    steps = (
        F.when(waiting, "cdr_only_generation,ipdr_only_correlation,provide_mapping_or_correct_files")
        .when(both & (word == "same_person"), "combined_cdr_ipdr_generation")
        .when(both & (word == "different_people"), "cdr_only_generation,ipdr_only_correlation,separate_source_reports")
        .when(both & (word == "multiple_person_dataset"), "per_subject_matching,cdr_only_generation,ipdr_only_correlation")
        .when(both, "show_detected_evidence,provide_mapping_or_correct_files,cdr_only_generation,ipdr_only_correlation")
        .when(cdr, "cdr_only_generation")
        .when(ipdr, "ipdr_only_correlation")
        .otherwise("")
    )
    listed = lambda xs: F.array_join(F.filter(F.array(*[F.when(t, F.lit(s)) for t, s in xs]), lambda x: x.isNotNull()), "; ")
    blockers = listed(rules)
    status = F.when(waiting, "awaiting_identity_answer").when(blockers == "", "allowed").otherwise("blocked")
    return evidence.select("*", word.alias("answer"), used.alias("mode"), (blockers == "").alias("allowed"), status.alias("status"), blockers.alias("blockers"), listed(notes).alias("warnings"), steps.alias("operations"))


def two_source_evidence(cdr: DataFrame, ipdr: DataFrame, alias_map: DataFrame) -> DataFrame:
    """The one-row evidence of X5, which X4 decides on. cdr, ipdr: subject, ts (canonical and parsed)."""
    a, b = subject_activity(cdr, "subject"), subject_activity(ipdr, "subject")
    counts = match_coverage(match_subjects(a, b))
    overlap = observation_overlap(cdr.where("subject <> ''"), ipdr.where("subject <> ''"))
    amb = alias_map.agg(F.count_if("ambiguous").alias("ambiguous"))
    one = counts.join(overlap, F.lit(True)).join(amb, F.lit(True))
    return one.select(
        F.lit(True).alias("cdr_present"), F.lit(True).alias("ipdr_present"), (F.col("matched") + F.col("cdr_only")).alias("cdr_count"), (F.col("matched") + F.col("ipdr_only")).alias("ipdr_count"),
        "matched", "cdr_only", "ipdr_only", "cdr_coverage", "ipdr_coverage", F.col("status").alias("period_status"), "start_ts", "end_ts", "ambiguous", F.lit(False).alias("proves_identity"),
    )


def evidence_reports(cdr: DataFrame, ipdr: DataFrame, alias_map: DataFrame, settings: dict[str, str], has_zone_column: bool = False) -> dict[str, DataFrame]:
    """All reports on two sources by name, each a DataFrame of its own, computed when used.

    cdr, ipdr: the columns of A1 and ts. Of each source: summary (A1), times (A4),
    subjects (A2), contacts (A3), contact_only (J8) and fingerprint (S11). Of both:
    overlap (A5), coverage (A6), matches (J9), matched_details (J10), the fingerprint of
    the check and the one-row evidence. Give sources that are dear to derive as stored tables.
    """
    out, active = {}, {}
    for name, df in (("cdr", cdr), ("ipdr", ipdr)):
        active[name] = subject_activity(df, "subject")
        out |= {
            f"{name}_summary": source_summary(df), f"{name}_times": timestamp_quality(df, has_zone_column=has_zone_column), f"{name}_subjects": active[name],
            f"{name}_contacts": contact_activity(df, "contact"), f"{name}_contact_only": contact_only(df.where("subject <> ''"), df.where("contact <> ''")), f"{name}_fingerprint": content_fingerprint(df),
        }
    matches = match_subjects(active["cdr"], active["ipdr"])
    return out | {
        "overlap": observation_overlap(cdr.where("subject <> ''"), ipdr.where("subject <> ''")), "coverage": match_coverage(matches), "matches": matches, "matched_details": matched_details(active["cdr"], active["ipdr"]),
        "check": validation_fingerprint(settings, out["cdr_fingerprint"], out["ipdr_fingerprint"]), "evidence": two_source_evidence(cdr, ipdr, alias_map),
    }

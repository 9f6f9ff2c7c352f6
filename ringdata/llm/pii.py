"""Personal data: regular expressions propose, checksums confirm, context words adjust the score.

Everything is Column expressions. A kind's matches are found twice by the same
pattern: as strings (regexp_extract_all) and as the gaps between them (split);
running lengths of both give code-point positions. Patterns are possessive and
anchored at the start of a run or at the last match's end, which changes no match
and keeps very long runs linear. Context words are looked for in the match and in the
CONTEXT_CHARS signs on either side of it (before it as far as the last but one match
of its kind, behind it as far as the next).
Defined cases: a null or empty text has no spans; very long texts and matches of any
length are read whole; spans of different kinds may overlap and all stay; repeated rows
each get their row; an empty table gives an empty result; other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import texts

LOCAL = "[A-Za-z0-9._%+-]"
#: kind -> (pattern, cheap test that every match passes, score before context, context words)
KINDS: dict[str, tuple[str, str, float, list[str]]] = {
    "email": (rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.8, ["mail", "contact", "write to"]),
    "ip": (r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.6, ["ip", "host", "address", "server"]),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", r"[0-9]", 0.7, ["card", "visa", "credit", "payment"]),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.6, ["phone", "tel", "call", "mobile"]),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}", 0.7, ["iban", "account", "bank"]),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-[0-9]", 0.3, ["ssn", "social security"]),
    "secret": (r"(?<![0-9A-Za-z+/_=-])[0-9A-Za-z+/_-]{20,}+={0,2}(?![0-9A-Za-z+/_=-])", r"[0-9A-Za-z+/_-]{20}", 0.3, ["token", "secret", "api_key", "apikey", "api key", "password", "passwd", "credential", "bearer"]),
    # fixed values: prefixes of keys that services publish
    "key": (r"(?<![0-9A-Za-z])(?:[spr]k_(?:live|test)_[0-9A-Za-z]{16,64}|gh[pousr]_[0-9A-Za-z]{36}|A(?:KIA|SIA)[0-9A-Z]{16}|xox[abprs]-[0-9A-Za-z-]{10,72}|AIza[0-9A-Za-z_-]{35}|glpat-[0-9A-Za-z_-]{20})(?![0-9A-Za-z])", r"k_live_|k_test_|gh[pousr]_|A[KS]IA|xox|AIza|glpat-", 0.7, ["token", "secret", "key"]),
}
BASE = ["email", "ip", "card", "phone"]
CONTEXT_CHARS = 32
CONTEXT_BONUS = 0.3
ACCEPT = 0.5
#: Signs that differ in a run that may be a secret; hexadecimal runs have at most 16.
DISTINCT = 10
SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn check."""
    n = F.length(digits)

    def step(acc, i):
        d = F.substr(digits, n - i + 1, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0


def mod97(c: Column) -> Column:
    """Whether an IBAN (spaces allowed) leaves 1 modulo 97."""
    plain = F.replace(c, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))

    def step(acc, ch):
        v = F.when(ch.between("0", "9"), ch.cast("int")).otherwise(F.ascii(ch) - 55)
        return (acc * F.when(v > 9, 100).otherwise(10) + v) % 97

    return F.aggregate(F.filter(F.split(turned, ""), lambda ch: ch != ""), F.lit(0), step) == 1


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        def small(part):
            bare = F.regexp_replace(part, "^0+", "")
            return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))

        return F.forall(F.split(hit, r"\."), small)
    if kind == "card":
        d = _digits(hit)
        return F.when(F.length(d).between(16, 19), luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(hit)).between(8, 15)
    if kind == "iban":
        return mod97(hit)
    if kind == "secret":  # words and numbers have few different signs, or no digits among them
        return (F.size(F.array_distinct(F.split(hit, ""))) >= DISTINCT) & hit.rlike("[0-9][^0-9]*[0-9]") & hit.rlike("[A-Za-z]")
    return F.lit(True)


def let(value: Column, use) -> Column:
    """use(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), use), 0)


def scan(values: Column, op) -> Column:
    """What op makes, from 0, of all values before each: exclusive running sums, or greatest values.

    Two levels of folds over parts of sqrt(n) values: a single one would copy its
    output at every step.
    """
    width = lambda v: F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v))).cast("int"))
    parts = lambda v: F.transform(F.filter(F.sequence(F.lit(0), width(v)), lambda k: k * width(v) < F.size(v)), lambda k: F.slice(v, k * width(v) + 1, width(v)))
    last = lambda o: F.element_at(o, -1)
    run = lambda part, at: F.aggregate(part, F.array(at), lambda o, x: F.concat(o, F.array(op(last(o), x))))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, part: let(run(part, acc["at"]), lambda o: F.struct(last(o).alias("at"), F.concat(acc["out"], F.slice(o, F.lit(1), F.size(part))).alias("out")))
    return let(values, lambda v: F.aggregate(parts(v), empty, step, lambda acc: acc["out"]))


def _spans(kind: str, text: Column) -> Column:
    pattern, test, score, words = KINDS[kind]

    def rows(gaps: Column, hits: Column) -> Column:
        """A match with the texts before and after it, and where the one before it begins."""
        n = F.size(hits)
        before = F.slice(gaps, F.lit(1), n)
        lengths = F.zip_with(before, hits, lambda g, h: F.length(g) + F.length(h))
        whole = F.zip_with(before, hits, lambda g, h: F.concat(g, h))
        context = F.zip_with(F.slice(F.concat(F.array(F.lit("")), whole), F.lit(1), n), before, lambda w, g: F.right(F.concat(w, g), F.lit(CONTEXT_CHARS)))
        return F.arrays_zip(hits.alias("hit"), before.alias("before"), context.alias("context"), F.slice(gaps, F.lit(2), n).alias("after"), scan(lengths, lambda a, x: a + x).alias("at"))

    def span(r: Column) -> Column:
        start = r["at"] + F.length(r["before"])
        near = F.lower(F.concat(r["context"], r["hit"], F.left(r["after"], F.lit(CONTEXT_CHARS))))
        bonus = F.when(near.rlike("|".join(words)), CONTEXT_BONUS).otherwise(0.0)
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(r["hit"])).alias("end"), F.least(F.lit(1.0), F.lit(score) + bonus).alias("score"))

    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    found = let(both, lambda s: F.transform(F.filter(rows(s["gaps"], s["hits"]), lambda r: _valid(kind, r["hit"])), span))
    if score < ACCEPT:
        found = F.filter(found, lambda s: s["score"] >= ACCEPT)
    possible = F.contains(text, F.lit(test)) if kind == "email" else text.rlike(test)
    return F.when(possible, found).otherwise(F.array().cast(SPAN))


def find_pii(docs: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """docs with the column `into`: an array of (kind, start, end, score) by kind as listed, then start."""
    empty = F.array().cast(SPAN)
    known = F.coalesce(F.col(text), F.lit(""))
    # a text without a digit or an at sign has nothing to propose
    return docs.withColumn(into, F.when(known.rlike("[0-9@]"), F.concat(*[_spans(k, known) for k in KINDS])).otherwise(empty))


def mask_pii(found: DataFrame, text: str = "text", spans_in: str = "pii") -> DataFrame:
    """The output of find_pii with every span replaced by its kind in brackets; spans that overlap become one."""
    ordered = F.array_sort(F.transform(spans_in, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def pieces(signs: Column, spans: Column) -> Column:
        # reach: the end of all spans before
        rows = F.arrays_zip(spans.alias("span"), scan(F.transform(spans, lambda s: s["end"]), lambda a, x: F.greatest(a, x)).alias("reach"))
        cut = lambda lo, hi: F.array_join(F.slice(signs, lo + 1, F.greatest(hi - lo, F.lit(0))), "")
        fresh = F.filter(rows, lambda r: r["span"]["start"] >= r["reach"])
        parts = F.transform(fresh, lambda r: F.concat(cut(r["reach"], r["span"]["start"]), F.lit("["), F.upper(r["span"]["kind"]), F.lit("]")))
        return F.concat(F.array_join(parts, ""), cut(F.array_max(F.transform(spans, lambda s: s["end"])), F.size(signs)))

    signs = F.split(F.col(text), "")  # one sign each, so that a piece costs its length and not its place
    masked = let(F.struct(signs.alias("signs"), ordered.alias("spans")), lambda s: pieces(s["signs"], s["spans"]))
    return found.withColumn(text, F.when(F.size(spans_in) > 0, masked).otherwise(F.col(text))).drop(spans_in)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))).select("doc_id", "pii")
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(written(base), 256).alias("base_sha256"), written(F.col("pii")).alias("spans"))

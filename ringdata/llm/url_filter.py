"""URL filter lists: expand, equi-join on short hash prefixes, confirm, take the longest rule.

Each url becomes expressions (every host suffix x every path prefix of a length that
some rule has, and the words of its host labels). An expression's SHA-256 starts
with a 4-byte prefix; the join is on that prefix and the whole digest confirms it.
Defined cases: a null url, or one without "://", has an empty host and path and
meets no rule; equal urls are judged alike; an empty table gives an empty result;
other columns, whatever their names, are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import hot_keys, join_skewed, upper_to_lower

#: (host, path, verdict)
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: The method's own list, for urls that no rule fits: labels of a host, or parts of a label between hyphens.
BLOCKED_WORDS = ["adult", "bet", "bets", "casino", "gambling", "jackpot", "malware", "nude", "phishing", "poker", "porn", "sex", "slots", "warez", "xxx"]
PREFIX_HEX = 8
#: Ranks of rules are above those of list entries, which are lengths of urls.
RULE_RANK = 1 << 20
#: Largest rule table (rows) that is broadcast; each row is under 1 kB, so 64 MB at most.
BROADCAST_ROWS = 65_536


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    pattern = r"(?s)^.*?://([^/?#]*+)([^?#]*+)"
    part = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return upper_to_lower(part(1)), part(2)


def rule_table(spark: SparkSession, rules=RULES, words=BLOCKED_WORDS, listed: DataFrame | None = None) -> DataFrame:
    """expr, rule (null for what is only listed), verdict and rank (rules by length; below all rules list entries by length, then words).

    listed: entries (host, path, verdict) of a list of any size, in effect where no rule fits.
    """
    schema = "expr string, rule string, verdict string, rank int, labels int, path_len int"
    rows = [(f"{h}{p}", f"{h}{p}", v, RULE_RANK + len(h) + len(p), len(h.split(".")), len(p)) for h, p, v in rules]
    out = spark.createDataFrame(rows + [(f"*{w}*", None, "block", 0, 0, 0) for w in words], schema)
    if listed is None:
        return out
    host, path = upper_to_lower(F.col("host")), F.coalesce("path", F.lit("/"))
    entry = [F.concat(host, path), F.lit(None).cast("string"), F.col("verdict"), F.length("host") + F.length(path), F.size(F.split("host", r"\.")), F.length(path)]
    return out.unionByName(listed.select(*[c.alias(f.name) for c, f in zip(entry, out.schema, strict=True)]))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, url, host, path, rule and verdict for every row of pages."""
    shape = rules.agg(F.max("labels").alias("labels"), F.array_sort(F.collect_set("path_len")).alias("lens"), F.count(F.lit(1)).alias("n")).first()
    host, path = split_url(F.col("url"))
    urls = pages.select("page_id", "url").withColumn("host", host).withColumn("path", path)

    labels = F.split("host", r"\.")
    # a suffix of more labels than any rule's host has, or a prefix of another length, equals no rule
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(1, shape["labels"] or 1)))),
        lambda k: F.array_join(F.slice(labels, -k, k), "."),
    )
    prefixes = F.transform(
        F.filter(F.array(*[F.lit(n) for n in shape["lens"]]), lambda n: n <= F.length("path")),
        lambda n: F.substr(F.col("path"), F.lit(1), n),
    )
    both = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    words = F.transform(F.array_distinct(F.split("host", r"[.\-]")), lambda w: F.concat(F.lit("*"), w, F.lit("*")))
    digest = lambda c: F.sha2(c, 256)
    short = lambda c: F.substring(c, 1, PREFIX_HEX)

    # each url is judged once, however many pages have it; urls without a host fit nothing
    known = urls.where("host <> ''").groupBy("url", "host", "path").agg(F.count(F.lit(1)).alias("n"))
    keys = known.select("url", F.explode(F.array_union(both, words)).alias("expr")).select("url", digest(F.col("expr")).alias("digest"))
    keys = keys.withColumn("prefix", short(F.col("digest")))
    listed = rules.select(digest(F.col("expr")).alias("rule_digest"), "rule", "verdict", "rank").withColumn("prefix", short(F.col("rule_digest")))
    if shape["n"] <= BROADCAST_ROWS:
        listed = F.broadcast(listed)
    met = keys.join(listed, "prefix").where(F.col("digest") == F.col("rule_digest"))
    best = met.groupBy("url").agg(F.max(F.struct("rank", "rule", "verdict")).alias("best"))
    judged = known.select("url").join(best, "url", "left")
    found = join_skewed(urls.where("host <> ''"), judged, "url", hot_keys(known, "url"))
    found = found.unionByName(urls.where("host = ''"), allowMissingColumns=True)
    return found.select("page_id", "url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge_urls(pages, rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


_WORDS_SQL = ", ".join(f"'{w}'" for w in BLOCKED_WORDS)
OP2_SQL = f"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), v AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(rhost, rpath, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), m AS (
  SELECT v.page_id, r.rhost || r.rpath AS rule, r.verdict,
    row_number() OVER (PARTITION BY v.page_id ORDER BY length(r.rhost || r.rpath) DESC) AS k
  FROM v JOIN r ON (v.host = r.rhost OR ends_with(v.host, '.' || r.rhost)) AND starts_with(v.path, r.rpath)
)
SELECT v.page_id, v.host, v.path, m.rule,
  coalesce(m.verdict, CASE WHEN len(list_intersect(regexp_split_to_array(v.host, '[.-]'), [{_WORDS_SQL}])) > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM v LEFT JOIN m ON m.page_id = v.page_id AND m.k = 1
"""

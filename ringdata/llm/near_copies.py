"""One document of each group of near-copies: SimHash links and MinHash bands propose, whole shingle sets decide.

Two texts are near-copies at a Jaccard similarity of at least `least` between their
sets of word shingles. SimHash fingerprints within BITS bits, found through the
Gray-order index, are the first candidates: links that span them, and then, since a
link may prove wrong that stood for others, all pairs of the rows that stay. Fingerprints alone can't give all of them:
at a similarity of 0.80 two texts differ in 10 of 64 bits on average, where an index
prunes nothing, so among the rows that stay candidates also share one of BANDS buckets
of ROWS MinHashes each (chance to meet: 99.9 % at 0.80, over 99.99 % at 0.85 and
above). A pair counts only when the whole sets, as 32-bit hashes, are that alike. In a
bucket every row is compared with the row of the smallest doc_id; rows that are linked
leave all buckets, and the others are regrouped, first ROUNDS times, then all pairs,
until none is left. So of two near-copies that meet, at most one is kept: the smaller
either leads a bucket of both or is linked to a smaller row itself.
Defined cases: a null text is empty; texts without words are equal; fewer words than
a shingle count as one shingle; a null doc_id comes last; rows that repeat in doc_id
and text count once; an empty table gives an empty result; all columns are kept,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, simhash
from .components import components
from .shared import hot_keys, join_skewed, stored, texts

LEAST = 0.8
BITS = 6
BANDS, ROWS = 24, 6
ROUNDS = 3
#: Shingles hashed at once.
PART = 4_096


def bands(hashes: np.ndarray) -> list[int]:
    """The buckets of a set as signed longs (none for an empty set)."""
    from xxhash import xxh64_intdigest

    if not len(hashes):
        return []
    odd = np.array([xxh64_intdigest(k.to_bytes(4, "little"), simhash.SEED) | 1 for k in range(BANDS * ROWS)], dtype=np.uint64)
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for k in range(0, len(hashes), PART):
        part = hashes[k : k + PART]
        for i, by in enumerate(odd):
            least[i] = min(least[i], (part * by).min())
    keys = [xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def alike(a: bytes, b: bytes, least: float) -> bool:
    """Whether two sets of 32-bit hashes have a Jaccard similarity of at least `least`."""
    x, y = np.frombuffer(a, dtype=np.uint32), np.frombuffer(b, dtype=np.uint32)
    if min(len(x), len(y)) < least * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= least * (len(x) + len(y) - both)


def add_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """docs (with text) with `node` (a digest of the shingle set), `fp`, `buckets` and `hashes` (32 bits each) instead of the text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh64_intdigest

        for f in frames:
            rows = []
            for t in f["text"]:
                all_ = simhash.shingle_hashes((t or "").encode(), shingle)
                one = np.unique(all_)
                rows.append((xxh64_intdigest(one.tobytes(), simhash.SEED), simhash.fingerprint(all_), bands(one), np.unique(one.astype(np.uint32)).tobytes()))
            node, fp, buckets, hashes = zip(*rows, strict=True) if rows else ((),) * 4
            signed = lambda x: np.array(x, dtype=np.uint64).view(np.int64)
            yield f.drop(columns="text").assign(node=signed(node), fp=signed(fp), buckets=list(buckets), hashes=list(hashes))

    kept = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in docs.schema if x.name != "text")
    return docs.mapInPandas(run, f"{kept}, node long, fp long, buckets array<long>, hashes binary")


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets are alike; a may lead very many, so its set goes to as many parts."""
    counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    hot = hot_keys(counts, "a")
    # at most HOT_SHARE rows
    parts = F.broadcast(counts.join(F.broadcast(hot), "a", "left_semi").select("a", F.ceil(F.col("n") / shared.GROUP_PART).cast("int").alias("parts")))
    slot = lambda part: F.xxhash64("a", part)
    right = pairs.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("right")), "b")
    right = right.join(parts, "a", "left").withColumn("slot", slot(F.coalesce(F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"), F.lit(0))))
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("left")).join(pairs.select("a").distinct(), "a", "left_semi")
    left = left.join(parts, "a", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1)))
    left = left.select("a", "left", slot(F.col("part")).alias("slot"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.loc[[alike(x, y, least) for x, y in zip(f["left"], f["right"], strict=True)], ["a", "b"]]

    return right.drop("parts").join(left, ["slot", "a"]).select("a", "b", "left", "right").mapInPandas(run, "a long, b long")


def near_links(nodes: DataFrame, sets_of, least: float = LEAST) -> DataFrame:
    """a, b: verified links among nodes (node, best, fp, buckets); a comes before b in the order of best.

    sets_of: gives node and hashes of the nodes of a table.
    """
    # SimHash: each node with the first of its fingerprint, and fingerprints along the index's links
    fps = stored(nodes.groupBy("fp").agg(F.min(F.struct("best", "node")).alias("head"), F.count(F.lit(1)).alias("n")), "fps")
    same = join_skewed(nodes.select("fp", "node"), fps.select("fp", F.col("head.node").alias("a")), "fp", hot_keys(fps, "fp")).select("a", F.col("node").alias("b"))
    spans = simhash.near_links(fps.select("fp"), BITS)
    side = lambda c: fps.select(F.col("fp").alias(c), F.col("head").alias(f"h{c}"))
    spans = spans.join(side("a"), "a").join(side("b"), "b")
    spans = spans.select(F.least("ha", "hb")["node"].alias("a"), F.greatest("ha", "hb")["node"].alias("b"))
    pairs = stored(same.unionByName(spans).where("a <> b").distinct(), "pairs")

    # rows of one fingerprint that are not alike to its first are a bucket like others
    rows = nodes.select("node", F.explode(F.array_append("buckets", F.xxhash64(F.lit("fingerprint"), "fp"))).alias("bucket"))
    counts = stored(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    live = join_skewed(rows, counts.select("bucket"), "bucket", hot_keys(counts, "bucket"))
    live = stored(live.distinct().join(nodes.select("node", "best"), "node"), "live")
    found = stored(_verified(pairs, stored(sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "sets"), least), "links")

    # a spanning link stands for others, which count if it proves wrong: all pairs of fingerprints of the rows that stay
    left = stored(nodes.select("node", "best", "fp").join(found.select(F.col("b").alias("node")).distinct(), "node", "left_anti"), "left")
    end = lambda c: left.select(F.col("fp").alias(c), F.struct("best", "node").alias(f"h{c}"))
    pairs = simhash.near_links(left.select("fp").distinct(), BITS, every=True).join(end("a"), "a").join(end("b"), "b")
    pairs = stored(pairs.select(F.least("ha", "hb")["node"].alias("a"), F.greatest("ha", "hb")["node"].alias("b")).distinct(), "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    sets = stored(sets_of(live.select("node").unionByName(ends).distinct()), "sets")

    links = found = stored(found.unionByName(_verified(pairs, sets, least)), "links")
    for round_ in range(ROUNDS + 1):
        live = stored(live.join(found.select(F.col("b").alias("node")).distinct(), "node", "left_anti"), "live")
        heads = stored(live.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("best", "node")).alias("head")).where("n > 1"), "heads")
        if heads.isEmpty():
            break
        if round_ < ROUNDS:
            live = join_skewed(live, heads.select("bucket", F.col("head.node").alias("a")), "bucket", hot_keys(heads, "bucket"))
            pairs = live.select("a", F.col("node").alias("b"))
        else:
            # few rows are left, each unlike the leaders of its buckets
            one, two = (live.select("bucket", F.struct("best", "node").alias(x)) for x in ("x", "y"))
            pairs = one.join(two, "bucket").where("x < y").select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
        found = stored(_verified(stored(pairs.where("a <> b").distinct(), "pairs"), sets, least), "links")
        links = links.unionByName(found)
        live = live.where(F.col("a") != F.col("node")).drop("a") if round_ < ROUNDS else live.limit(0)
    return links


def keep_one(docs: DataFrame, shingle: int = 5, least: float = LEAST) -> DataFrame:
    """docs without near-copies, all columns kept: of each group of verified links the row of the smallest doc_id (null last) stays."""
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    keyed = texts(docs).withColumn("key", key)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    rows = stored(add_sets(keyed, shingle), "rows")
    nodes = stored(rows.groupBy("node").agg(F.min(order).alias("best"), F.first("fp").alias("fp"), F.first("buckets").alias("buckets")), "nodes")

    def sets_of(wanted: DataFrame) -> DataFrame:
        """One row's hashes for each node wanted; the other rows of a node find no partner, however many there are."""
        place = lambda i, k: F.xxhash64("node", F.coalesce(F.col(i), F.lit(0)), F.col(i).isNull(), k).alias("place")
        chosen = nodes.join(wanted, "node").select("node", place("best.doc_id", "best.key"))
        return rows.select("node", place("doc_id", "key"), "hashes").join(chosen, ["place", "node"]).groupBy("place", "node").agg(F.first("hashes").alias("hashes")).drop("place")

    found = components(near_links(nodes, sets_of, least))
    best = nodes.select("node", "best").join(found, "node", "left").groupBy(F.coalesce("component", "node").alias("of")).agg(F.min("best").alias("best"))
    stay = stored(best.select(F.col("best.doc_id").alias("i"), F.col("best.key").alias("k")), "stay")
    times = rows.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    stay = stay.join(times, F.col("i").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("key")), "left").select("i", "k", F.coalesce("times", F.lit(1)).alias("times"))
    stay = stay.toDF(*shared.unused(docs.columns, "_id", "_key", "_times"))
    kept = docs.join(stay, docs["doc_id"].eqNullSafe(stay[stay.columns[0]]) & (key == stay[stay.columns[1]]))
    once, again = (kept.where(test).select(docs["*"]) for test in (stay[stay.columns[2]] == 1, stay[stay.columns[2]] > 1))
    return once.unionByName(again.dropDuplicates(["doc_id", "text"]))

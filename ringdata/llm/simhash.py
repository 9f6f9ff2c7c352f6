"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints: 64 bits over the XXH64 hashes (seed 42) of word shingles, repeats
included. Links: two fingerprints that differ in at most `bits` bits. The index: its
top level deals the distinct fingerprints by the values of some bands (the 64 bits are
cut into `bands`; two fingerprints within the limit agree on at least bands - bits of
them, and each goes to a bucket for every choice of that many; the number of bands
grows with the table so that a bucket holds about BUCKET). Below, rows are sorted by
bucket and Gray rank, so that neighbours differ in few bits; groups of eight, then of
groups, become nodes that keep the bit pattern all members share and a mask of it.
Node pairs are walked top-down, and a pair is dropped when the shared patterns already
differ in too many bits, when no bucket has members in both, or when all its members
are known to be linked. What leaves are spanning links.
Equal texts have one fingerprint, so copies never meet as pairs. A bucket above
max(HOT_ROWS, 1 / HOT_SHARE of all fingerprints) is dealt once more by HOT_BANDS of its
bits; what is still above is split into pairs of blocks.
Defined cases: a null text is empty; a text without words has fingerprint zero,
linked like any other; fewer words than a shingle count as one shingle; a null
doc_id is kept and joins its component; repeated rows each get their row; an empty
table gives an empty result; other columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import HOT_SHARE, hot_keys, join_skewed, stored, texts

SEED = 42
BITS = 4
FANOUT = 8
#: Fingerprints of a bucket, as far as the number of bands can see to it; bands that agree when a hot bucket is dealt again.
BUCKET, AGAIN = 512, 4
#: A bucket is hot above HOT_ROWS fingerprints and above a share of 1 / HOT_SHARE, so at most HOT_SHARE * C(bands, bits) buckets are.
HOT_ROWS = 4_000
#: Node pairs held at once while walking an index.
WALK = 1 << 14


def shingle_hashes(data: bytes, shingle: int) -> np.ndarray:
    """XXH64 of each word shingle of a text in UTF-8, repeats included."""
    from xxhash import xxh64_intdigest

    words = data.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    return np.fromiter((xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), dtype=np.uint64, count=len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that are set in more than half of the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 65_536):
        part = np.ascontiguousarray(hashes[k : k + 65_536])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << b for b in range(64) if 2 * ones[b] > len(hashes)))


def add_fingerprint(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """docs (with text) with `fp`, the fingerprint as a signed long, instead of the text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            fp = np.array([fingerprint(shingle_hashes((t or "").encode(), shingle)) for t in f["text"]], dtype=np.uint64)
            yield f.drop(columns="text").assign(fp=fp.view(np.int64))

    kept = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in docs.schema if x.name != "text")
    return docs.mapInPandas(run, f"{kept}, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each value in the binary reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def index(fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels (pattern, mask), leaves first: the bits that all members of a node share."""
    levels = [(fp, np.full(len(fp), ~np.uint64(0)))]
    while len(levels[-1][0]) > 1:
        pattern, mask = levels[-1]
        at = np.arange(0, len(pattern), FANOUT)
        # a member's shared bits are known; where two patterns differ on them, the group shares nothing
        ones = np.bitwise_and.reduceat(pattern & mask, at)
        zeros = np.bitwise_and.reduceat(~pattern & mask, at)
        levels.append((ones, ones | zeros))
    return levels


def spanning_links(fp: np.ndarray, bits: int, bucket: np.ndarray | None = None, every: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all that is connected, within each bucket, at `bits` or fewer differing bits; every: all such pairs.

    bucket: numbers in ascending order; links between buckets may come too.
    """
    bucket = np.zeros(len(fp), dtype=np.int64) if bucket is None else bucket
    order = np.lexsort((gray_rank(fp), bucket))
    fp = fp[order]
    n = len(fp)
    root = np.arange(n)

    def union(a: np.ndarray, b: np.ndarray) -> None:
        """Merge the components of linked members."""
        nonlocal root
        while True:
            ra, rb = root[a], root[b]
            open_ = ra != rb
            if not open_.any():
                return
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            low, high = np.minimum(ra, rb), np.maximum(ra, rb)
            np.minimum.at(root, high, low)
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root = up

    near = np.flatnonzero(np.bitwise_count(fp[1:] ^ fp[:-1]) <= bits)
    if not every:
        union(near, near + 1)
    pairs = [(fp[:0], fp[:0])]
    levels = index(fp)

    def whole(level: int, node: np.ndarray) -> np.ndarray:
        """The component of a node's members, -1 if they have several."""
        width = FANOUT**level
        if level == 0:
            return root[node]
        at = np.arange(0, n, width)
        low, high = np.minimum.reduceat(root, at), np.maximum.reduceat(root, at)
        return np.where(low == high, low, -1)[node]

    stack = [(len(levels) - 1, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]
    while stack:
        level, a, b = stack.pop()
        if len(a) > WALK:
            stack += [(level, a[WALK:], b[WALK:]), (level, a[:WALK], b[:WALK])]
            continue
        pattern, mask = levels[level]
        width = FANOUT**level
        strange = bucket[np.minimum(a * width + width, n) - 1] < bucket[b * width]
        apart = strange | (np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b]) > bits)
        if every:
            go = ~apart & ((a != b) | (level > 0))
        else:
            ca, cb = whole(level, a), whole(level, b)
            go = ~apart & ~((ca == cb) & (ca >= 0))
        a, b = a[go], b[go]
        if level == 0 and every:
            pairs.append((fp[a], fp[b]))
        elif level == 0:
            union(a, b)
        elif len(a):
            below = len(levels[level - 1][0])
            child = np.arange(FANOUT)
            x = (a[:, None, None] * FANOUT + child[None, :, None] + 0 * child[None, None, :]).ravel()
            y = (b[:, None, None] * FANOUT + child[None, None, :] + 0 * child[None, :, None]).ravel()
            ok = (x < below) & (y < below) & (x <= y)
            stack.append((level - 1, x[ok], y[ok]))
    if every:
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        return np.minimum(a, b), np.maximum(a, b)
    tied = root != np.arange(n)
    return fp[root[tied]], fp[tied]


def bands_for(n: int, bits: int) -> int:
    """The least number of bands for which a bucket of n even fingerprints holds about BUCKET."""
    bands = bits + 1
    while n > BUCKET * 2 ** (64 * (bands - bits) / bands) and bands < bits + AGAIN:
        bands += 1
    return bands


def near_links(fps: DataFrame, bits: int = BITS, every: bool = False) -> DataFrame:
    """a, b: links that connect exactly the distinct fingerprints (column fp) connected at `bits` or fewer differing bits; every: all such pairs."""
    n = max(1, fps.count())
    limit = max(HOT_ROWS, math.ceil(n / HOT_SHARE))

    def keyed(bands: int, *more: str) -> Column:
        """The buckets of a fingerprint: which bands, and their bits, mixed to one number (a clash of two buckets only adds tests)."""
        edges = [round(64 * i / bands) for i in range(bands + 1)]
        keys = []
        for t, chosen in enumerate(combinations(range(bands), bands - bits)):
            mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
            mask -= (mask >> 63) << 64
            keys.append(F.xxhash64(*more, F.lit(t), F.col("fp").bitwiseAND(F.lit(mask))))
        return F.explode(F.array(*keys)).alias("bucket")

    def parted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows of other buckets and of hot ones, with n."""
        # at most HOT_SHARE rows for each bucket of a fingerprint, of 16 bytes
        hot = F.broadcast(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit))
        marked = rows.join(hot, "bucket", "left")
        return marked.where("n IS NULL").select("fp", "bucket"), marked.where("n IS NOT NULL")

    rows, hot = parted(fps.select("fp", keyed(bands_for(n, bits))))
    again, hot = parted(hot.select("fp", keyed(bits + AGAIN, "bucket")))
    blocks = F.ceil(F.col("n") * 2 / limit).cast("int")
    mine = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda other: F.xxhash64(F.col("bucket"), F.least(mine, other), F.greatest(mine, other)))
    rows = rows.unionByName(again).unionByName(hot.select("fp", F.explode(pairs).alias("bucket")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by bucket; whole buckets are walked together, as many as came, and the last one waits for its other rows."""
        held = [np.zeros(0, dtype=np.int64)] * 2

        def walked(bucket: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
            a, b = spanning_links(fp.view(np.uint64), bits, np.cumsum(np.diff(bucket, prepend=bucket[:1]) != 0), every)
            return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

        for f in frames:
            bucket, fp = (np.concatenate([h, f[c].to_numpy()]) for h, c in zip(held, ("bucket", "fp"), strict=True))
            whole = int(np.searchsorted(bucket, bucket[-1])) if len(bucket) else 0
            if whole:
                yield walked(bucket[:whole], fp[:whole])
            held = [bucket[whole:], fp[whole:]]
        if len(held[0]):
            yield walked(*held)

    dealt = rows.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInPandas(run, "a long, b long").where("a <> b").distinct()


def group(docs: DataFrame, shingle: int = 4, bits: int = BITS) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable through links, itself included)."""
    n = F.count(F.lit(1)).alias("n")
    rows = stored(add_fingerprint(texts(docs), shingle), "simhash")
    fps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), n), "fingerprints")
    found = components(near_links(fps.select("fp"), bits))
    classes = stored(fps.join(found, fps["fp"] == found["node"], "left").select("fp", "first_id", F.coalesce("component", "fp").alias("class")), "classes")
    ids = stored(classes.groupBy("class").agg(F.min("first_id").alias("component_id"), n), "ids")
    named = join_skewed(classes.select("fp", "class"), ids.drop("n"), "class", hot_keys(ids, "class")).select("fp", "component_id")
    return join_skewed(rows, named, "fp", hot_keys(fps, "fp")).select("doc_id", "fp", "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = group(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

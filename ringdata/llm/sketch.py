"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's set of paragraph digests (non-empty lines, xxhash64) goes into a sketch of
three sub-tables; a cell holds a count, the XOR of its digests and the XOR of their
check sums. The number of cells is a power of two that follows the number of digests,
so a sketch folds to any smaller size: cells whose places are equal modulo that size
are added. The fingerprint is that sketch. Two versions' fingerprints are folded to
the smaller size and subtracted cell by cell; cells that then hold one digest are
peeled, sub-table by sub-table, as long as any does. Pairs with digests left are tried
again with larger sketches of both, until none has. What is peeled are the digests on
one side only, so likeness = shared / union.
Every step is a DataFrame operation; a document's cells are rows, so long texts cost
in proportion to their lines.
Defined cases: a null text is empty; two texts without a non-empty line are alike
(1.0); rows with the same doc_id are ordered by text, a null doc_id comes first; a
single document is its own next one; an empty table gives an empty result; other
columns are dropped.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import stored, texts

SUBTABLES = 3
#: Cells of a sub-table: at least LEAST, and CELLS_EACH for each digest, as a power of two.
LEAST, CELLS_EACH = 4, 0.8
#: Growth from one attempt to the next, and sub-rounds of peeling before a look at what is left.
GROWTH, SUBROUNDS = 4, 9
#: Digests that one task handles.
TASK_DIGESTS = 50_000
#: Ranges of doc_id: so many documents each, and at most so many ranges (their bounds pass through the driver; past
#: 17 million documents a range holds more of them, which its task sorts with spilling).
RANGE_DOCS, MAX_RANGES = 256, 65_536
NO_ID = -(2**63)


def digests(text: Column) -> Column:
    """The sorted set of paragraph digests."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(F.split(text, "\n"), lambda x: x != ""), lambda x: F.xxhash64(x))))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit("check")).bitwiseAND(F.lit(0xFFFFFFFF))


def _place(key: Column, table: int, size: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(table)), size.cast("long"))


def sketch_size(n: Column) -> Column:
    """Cells of a sub-table for n digests."""
    return F.greatest(F.lit(LEAST), F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(n * CELLS_EACH, F.lit(1.0)))))).cast("long")


def sketches(sets: DataFrame, key: list[str]) -> DataFrame:
    """key and the fingerprint of `keys` for every row of sets, as text: cells of a sub-table, then of each cell that holds anything its place, count, digests and check sums (4, 4, 8 and 4 bytes in base64)."""
    cell = lambda k, t: F.struct((_place(k, t, F.col("size")) + t * F.col("size")).alias("slot"), k.alias("key"), _check(k).alias("chk"))
    marker = F.array(F.struct(F.lit(-1).cast("long").alias("slot"), F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("chk")))  # keeps empty sets
    entries = F.flatten(F.transform("keys", lambda k: F.array(*[cell(k, t) for t in range(SUBTABLES)])))
    cells = sets.withColumn("size", sketch_size(F.size("keys"))).select(*key, "size", F.inline(F.concat(entries, marker)))
    cells = cells.groupBy(*key, "size", "slot").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("chk").alias("chk"))
    hexes = F.concat(*[F.lpad(F.hex(c), n, "0") for c, n in (("slot", 8), ("n", 8), ("key", 16), ("chk", 8))])
    held = F.array_sort(F.collect_list(F.when(F.col("slot") >= 0, hexes)))
    return cells.groupBy(*key, "size").agg(held.alias("cells")).select(*key, F.concat_ws(":", F.col("size").cast("string"), F.base64(F.unhex(F.array_join("cells", "")))).alias("fingerprint"))


def with_next(docs: DataFrame) -> DataFrame:
    """part, pos (together a row's key), doc_id, text and next_text, by ascending doc_id.

    Documents are dealt by ranges of doc_id (quantiles); each range's first document
    is also sent to the range before it, so texts are shuffled once.
    """
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"))
    n = ids.count()
    ranges = max(1, min(MAX_RANGES, math.ceil(n / RANGE_DOCS)))
    bounds: list[int] = []
    listed = lambda xs, kind: F.split(F.lit(",".join(map(str, xs))), ",").cast(f"array<{kind}>")  # noqa: E731  (one literal)
    numbers = lambda xs: listed(xs, "bigint")
    if ranges > 1:
        shares = listed([i / ranges for i in range(1, ranges)], "double")
        bounds = sorted(set(ids.agg(F.percentile_approx("id", shares, 4 * ranges)).first()[0]))
    steps = F.array(*[F.lit(2**k) for k in reversed(range(max(1, len(bounds).bit_length())))])

    def part_of(c: Column) -> Column:
        if not bounds:
            return F.lit(0)
        return F.aggregate(steps, F.lit(0), lambda acc, k: F.when(F.get(numbers(bounds), acc + k - 1) <= c, acc + k).otherwise(acc))

    firsts = dict(ids.groupBy(part_of(F.col("id")).alias("part")).agg(F.min("id")).collect())  # MAX_RANGES rows at most
    kept = sorted(firsts)
    before = {p: kept[i - 1] for i, p in enumerate(kept)}  # the first range goes before the last
    first_id = numbers([firsts.get(p, NO_ID) for p in range(len(bounds) + 1)])
    previous = numbers([before.get(p, 0) for p in range(len(bounds) + 1)])
    at = lambda part, guest: F.struct(part.cast("int").alias("part"), F.lit(guest).alias("guest"))
    own = F.col("own")
    dealt = (
        docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"))
        .withColumn("own", part_of(F.col("id")))
        .withColumn("at", F.explode(F.when(F.col("id") == F.get(first_id, own), F.array(at(own, 0), at(F.get(previous, own), 1))).otherwise(F.array(at(own, 0)))))
        .select("at.part", "at.guest", "id", "doc_id", "text")
    )
    order = Window.partitionBy("part").orderBy("guest", "id", "text")
    return dealt.withColumn("next_text", F.lead("text").over(order)).withColumn("pos", F.row_number().over(order)).where("guest = 0").select("part", "pos", "doc_id", "text", "next_text")


def differences(pairs: DataFrame, tasks: int) -> DataFrame:
    """part, pos, pair and the numbers of digests only in plus (n_plus) and only in minus (n_minus).

    pairs: part, pos, pair (together a key), plus and minus (arrays of digests). The
    first attempt is at the smaller size of both fingerprints, unless the numbers of
    digests tell that more must differ than it has cells.
    """
    key = ["part", "pos", "pair"]
    cell = ["table", "idx"]
    zero = F.lit(0)
    place = lambda k, table: _place(k, table, F.col("size"))

    def entry(table, idx, n, k, chk) -> Column:
        return F.struct(F.lit(table).alias("table"), idx.cast("long").alias("idx"), n.cast("long").alias("n"), k.cast("long").alias("key"), chk.cast("long").alias("chk"))

    def summed(rows: DataFrame) -> DataFrame:
        got = rows.groupBy(*key, "size", *cell).agg(F.sum("n").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("chk").alias("chk"))
        return got.where("n <> 0 OR key <> 0 OR chk <> 0")

    pure = (F.abs("n") == 1) & (F.col("chk") == _check(F.col("key")))

    def peeled(cells: DataFrame) -> DataFrame:
        for r in range(SUBROUNDS):
            t = r % SUBTABLES
            out = F.array(
                entry(-1, F.col("key"), F.col("n"), zero, zero),
                *[entry(o, place(F.col("key"), o), -F.col("n"), F.col("key"), F.col("chk")) for o in range(SUBTABLES) if o != t],
            )
            same = F.array(F.struct("table", "idx", "n", "key", "chk"))
            cells = summed(cells.select(*key, "size", F.inline(F.when((F.col("table") == t) & pure, out).otherwise(same))))
        return cells

    def looked_at(cells: DataFrame) -> DataFrame:
        """Per pair: cells left, whether any can be peeled, and the digests found; cells of pairs that go on."""
        left = F.col("table") >= 0
        found = cells.groupBy(*key, "size").agg(
            F.count_if(left).alias("left"), F.count_if(left & pure).alias("more"), F.count_if((F.col("table") == -1) & (F.col("n") > 0)).alias("n_plus"), F.count_if((F.col("table") == -1) & (F.col("n") < 0)).alias("n_minus"),
            F.collect_list(F.when(left | (F.col("table") == -1), F.struct("table", "idx", "n", "key", "chk"))).alias("cells"),
        )
        goes_on = (F.col("left") > 0) & (F.col("more") > 0)
        return stored(found.withColumn("cells", F.when(goes_on, F.col("cells"))), "sketch-found")

    n_plus, n_minus = F.size("plus"), F.size("minus")
    small, whole = F.least(sketch_size(n_plus), sketch_size(n_minus)), sketch_size(n_plus + n_minus)
    todo = pairs.withColumn("size", F.when(F.abs(n_plus - n_minus) > SUBTABLES * small, whole).otherwise(small))
    out = None
    while True:
        todo = todo.repartition(tasks, "part", "pos")  # the one shuffle of an attempt: all that follows stays in these partitions
        signed = F.concat(*[F.transform(side, lambda k: F.struct(k.alias("k"), F.lit(sign).alias("n"))) for side, sign in (("plus", 1), ("minus", -1))])  # noqa: B023
        inserted = F.flatten(F.transform(signed, lambda e: F.array(*[entry(t, place(e["k"], t), e["n"], e["k"], _check(e["k"])) for t in range(SUBTABLES)])))
        marker = F.array(entry(-2, zero, F.lit(1), zero, zero))  # keeps pairs whose cells all cancel
        found = looked_at(peeled(summed(todo.select(*key, "size", F.inline(F.concat(inserted, marker))))))
        stuck = None
        while True:
            done = found.where("left = 0").select(*key, "n_plus", "n_minus")
            out = done if out is None else out.unionByName(done)
            failed = found.where("left > 0 AND more = 0").select(*key, "size")
            stuck = failed if stuck is None else stuck.unionByName(failed)
            going = found.where("left > 0 AND more > 0")
            if going.isEmpty():
                break
            found = looked_at(peeled(going.select(*key, "size", F.inline("cells"))))
        # a pair is tried next at a size for all its digests, or GROWTH times the last
        again = stuck.select(*key, F.col("size").alias("tried"))
        todo = pairs.join(again, key).withColumn("size", F.greatest(whole, F.col("tried") * GROWTH)).drop("tried")
        if stuck.isEmpty():
            return out


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints and likenesses of every row."""
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substr("next_text", F.lit(1), half))
    rows = with_next(texts(docs)).withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", edited)
    rows = stored(
        rows.select("part", "pos", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), digests(F.col("text")).alias("own"), digests(F.col("edited")).alias("edited"), digests(F.col("next_text")).alias("next")),
        "sketch-rows",
    )
    total = rows.agg(F.sum(F.size("own") + F.size("edited") + F.size("next"))).first()[0] or 0
    tasks = max(1, math.ceil(total / TASK_DIGESTS))
    pair = lambda i, name: F.struct(F.lit(i).alias("pair"), F.col("own").alias("plus"), F.col(name).alias("minus"))
    pairs = rows.select("part", "pos", F.inline(F.array(pair(0, "edited"), pair(1, "next"))))
    found = differences(pairs, tasks).repartition(tasks, "part", "pos").groupBy("part", "pos").agg(*[F.max(F.when(F.col("pair") == i, F.struct("n_plus", "n_minus"))).alias(f"d{i}") for i in (0, 1)])
    rows = rows.repartition(tasks, "part", "pos")
    side = lambda name: F.struct(F.lit(name).alias("side"), F.col(name).alias("keys"))
    printed = sketches(rows.select("part", "pos", F.inline(F.array(side("own"), side("edited")))), ["part", "pos", "side"])
    printed = printed.groupBy("part", "pos").agg(*[F.max(F.when(F.col("side") == name, F.col("fingerprint"))).alias(into) for name, into in (("own", "fingerprint"), ("edited", "edited_fingerprint"))])

    def near(d: str) -> Column:
        union = F.col("n_own") + F.col(f"{d}.n_minus")
        return F.when(union == 0, 1.0).otherwise((F.col("n_own") - F.col(f"{d}.n_plus")) / union)

    rows = rows.select("part", "pos", "doc_id", "n_chars", "edited_sha256", F.size("own").alias("n_own"))
    return rows.join(found, ["part", "pos"]).join(printed, ["part", "pos"]).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("d0").alias("near_edited"), near("d1").alias("near_next"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(spark.read.parquet(f"{sf_dir}/documents.parquet"))

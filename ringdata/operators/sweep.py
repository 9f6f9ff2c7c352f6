"""Sweep join: points and marks in one sorted stream per range of (key, time)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ringdata.sources.tables import stored


def near_marks(points: DataFrame, marks: DataFrame, key: str, at: str, width: int, order: tuple[str | Column, ...] = (), into: str = "near") -> DataFrame:
    """points with `into`: whether a mark of the same key lies within `width` of them, both ends included.

    points and marks have key (text) and at (long). A point is placed at at + width: a
    mark is near it just if the last mark up to that place is at most 2 * width before.
    So one pass over both, sorted by key and place, decides every point, in time linear
    in the rows, however many marks a point is near to. Rows are dealt by ranges of (key,
    place, order), where `order` tells apart points of equal place, so a key with any
    share of the rows spans many tasks; marks that are equal count once, before they are
    dealt. A task's first points may depend on a mark of an earlier task: they take the
    last mark before the task from a table with a row for each task.
    Points without key or time are near nothing; columns of points are kept.
    """
    place = F.col(at) + width
    names = [f for f in points.columns if f not in (key, at)]
    rows = points.select(key, at, F.struct(*names).alias("_rest"), F.col(key).alias("_key"), place.alias("_place"), F.lit(1).alias("_kind"), *[(F.col(c) if isinstance(c, str) else c).alias(f"_o{k}") for k, c in enumerate(order)])
    kinds = {f.name: f.dataType for f in rows.schema}
    ends = marks.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(key, at).distinct()
    ends = ends.select(*[F.lit(None).cast(kinds[c]).alias(c) for c in (key, at, "_rest")], F.col(key).alias("_key"), F.col(at).alias("_place"), F.lit(0).alias("_kind"), *[F.lit(None).cast(kinds[f"_o{k}"]).alias(f"_o{k}") for k in range(len(order))])
    by = ["_key", "_place", "_kind", *[f"_o{k}" for k in range(len(order))]]
    sorted_ = rows.unionByName(ends).repartitionByRange(*by).sortWithinPartitions(*by)
    more = {"_near": T.BooleanType(), "_part": T.IntegerType(), "_mark": T.LongType(), "_owner": T.StringType()}
    schema = T.StructType([T.StructField(c, t, True) for c, t in ({c: kinds[c] for c in (key, at, "_rest")} | more).items()])

    # the rest of a point stays as it is: only key, place and kind go through numpy
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, owner, last = TaskContext.get().partitionId(), None, 0
        for b in batches:
            keys, where, is_mark = b.column("_key").to_numpy(zero_copy_only=False), b.column("_place"), b.column("_kind").to_numpy(zero_copy_only=False) == 0
            known = np.array(where.is_valid())
            spot = where.fill_null(0).to_numpy(zero_copy_only=False)
            before = np.maximum.accumulate(np.where(is_mark, np.arange(len(keys)), -1))
            whose = np.where(before >= 0, keys[before], owner)
            mark_at = np.where(before >= 0, spot[before], last)
            lost = pd.isna(keys) | ~known
            near = (whose == keys) & (mark_at >= spot - 2 * width) & ~lost
            # nothing seen yet in this task: an earlier one decides
            open_ = np.array([w is None for w in whose], dtype=bool) & ~lost if owner is None else np.zeros(len(keys), dtype=bool)
            if len(keys) and before[-1] >= 0:
                owner, last = keys[before[-1]], int(spot[before[-1]])
            keep = pa.array(~is_mark)
            n = int((~is_mark).sum())
            columns = [b.column(c).filter(keep) for c in (key, at, "_rest")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(near[~is_mark].astype(bool), mask=open_[~is_mark]), pa.array(np.full(n, part, dtype=np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string())], names=[key, at, "_rest", "_near", "_part", "_mark", "_owner"])
        if owner is not None:
            none = [pa.nulls(1, b.schema.field(c).type) for c in (key, at, "_rest")]
            yield pa.RecordBatch.from_arrays([*none, pa.nulls(1, pa.bool_()), pa.array([part], pa.int32()), pa.array([last], pa.int64()), pa.array([owner], pa.string())], names=[key, at, "_rest", "_near", "_part", "_mark", "_owner"])

    swept = stored(sorted_.mapInArrow(run, schema), "swept")
    parts = swept.select("_part").distinct().join(swept.where("_owner IS NOT NULL").select("_part", "_mark", "_owner"), "_part", "left")  # one row a task
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("_part", F.last(F.when(F.col("_owner").isNotNull(), F.struct("_owner", "_mark")), True).over(earlier).alias("_carried"))
    late = F.coalesce((F.col("_carried._owner") == F.col(key)) & (F.col("_carried._mark") >= F.col(at) - width), F.lit(False))
    found = swept.where("_owner IS NULL").drop("_mark", "_owner").join(F.broadcast(carried), "_part")
    return found.select(key, at, *[F.col("_rest").getField(c).alias(c) for c in names], F.coalesce("_near", late).alias(into))

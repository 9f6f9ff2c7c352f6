"""File sources and sinks."""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ringdata.operators.schema import is_header

from .tables import stored

HEADER_ROWS = 101


def first_existing(spark: SparkSession, folder: str, names: list[str]) -> str:
    """The first of the names that can be read in the folder."""
    for name in names:
        path = f"{folder}/{name}"
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return path
    raise FileNotFoundError(f"none of {names} in {folder}")


def _cells(line: str) -> list[str]:
    """The fields of a line of CSV, trimmed."""
    return [c.strip() for c in next(csv.reader([line]), [])]


class _Head:
    """Finds a file's header among its first HEADER_ROWS lines, seen one after another."""

    def __init__(self, kind: str, overrides: dict[str, str]) -> None:
        self.kind, self.overrides = kind, overrides
        self.lines: list[str] = []
        self.at: int | None = None

    def take(self, line: str | None) -> bool:
        """Note a line; true once the header is known."""
        if self.at is None:
            self.lines.append((line or "").removeprefix("\ufeff") if not self.lines else line or "")
            if is_header(_cells(self.lines[-1]), self.kind, self.overrides):
                self.at = len(self.lines) - 1
            elif len(self.lines) == HEADER_ROWS:
                self.end()
        return self.at is not None

    def end(self) -> None:
        """No row is a header: the first that is not blank counts as one."""
        if self.at is None:
            self.at = next((k for k, x in enumerate(self.lines) if x.strip()), len(self.lines) - 1)

    def rest(self) -> list[str]:
        """Lines after the header."""
        return self.lines[self.at + 1 :]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def headers(spark: SparkSession, path: str, kind: str, overrides: dict[str, str] | None = None) -> DataFrame:
    """file, names: the header of every file, found in the file's first split."""
    asked = dict(overrides or {})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heads: dict[str, _Head] = {}
        for f in frames:
            for file, own in f.groupby("file", sort=False)["value"]:
                head = heads.setdefault(file, _Head(kind, asked))
                if head.at is None:
                    for line in own:
                        if head.take(line):
                            break
        for file, head in heads.items():
            head.end()
            names: list[str] = []
            for i, c in enumerate(_cells(head.lines[head.at])):
                name = c or f"_c{i}"
                names.append(name if name not in names else f"{name}.{i}")
            yield pd.DataFrame({"file": [file], "names": [names]})

    return _lines(spark, path).where("start = 0").select("value", "file").mapInPandas(run, "file string, names array<string>")


def read_records(spark: SparkSession, path: str, kind: str = "cdr", overrides: dict[str, str] | None = None) -> DataFrame:
    """CSV files as text columns, each with a preamble and a header of its own.

    A file's header is the first of its first 101 rows that names the columns which the
    kind requires (or those of overrides), else its first row; what stands before it is
    passed over by position, in the file's first split; later splits are data. Columns
    are those of all headers, in order of first sight: a field that a row lacks is '', a
    column that its file lacks is null. Lines that are blank are none. Fields hold no
    line ends, so that files split anywhere between lines. One pass over the first
    splits finds the headers; a second one, in which Python only cuts off the heads,
    reads the rows.
    """
    found = stored(headers(spark, path, kind, overrides), "headers")
    # distinct headers: as many as there are layouts, not files
    layouts = [r["names"] for r in found.groupBy("names").agg(F.min("file").alias("file")).orderBy("file").collect()]
    if not layouts:
        raise ValueError(f"{path} is empty")
    columns = list(dict.fromkeys(n for names in layouts for n in names))
    width = max(map(len, layouts))
    asked = dict(overrides or {})

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        heads: dict[str, _Head] = {}
        for b in batches:
            files, starts = b.column("file"), b.column("start").to_numpy(zero_copy_only=False)
            data, at = b.column("value"), 0
            while at < len(b):
                # rows of one split stand together
                file = files[at].as_py()
                same = np.array(pa.compute.equal(files.slice(at), file)) & (starts[at:] == starts[at])
                until = at + (int(np.argmin(same)) if not same.all() else len(same))
                if starts[at] == 0:
                    head = heads.setdefault(file, _Head(kind, asked))
                    while at < until and head.at is None:
                        head.take(data[at].as_py())
                        at += 1
                        if head.at is not None and head.rest():
                            yield pa.RecordBatch.from_arrays([pa.array(head.rest()), pa.array([file] * len(head.rest()))], names=["value", "file"])
                if at < until:
                    yield pa.RecordBatch.from_arrays([data.slice(at, until - at), files.slice(at, until - at)], names=["value", "file"])
                at = until
        for file, head in heads.items():
            if head.at is None:
                head.end()
                if head.rest():
                    yield pa.RecordBatch.from_arrays([pa.array(head.rest()), pa.array([file] * len(head.rest()))], names=["value", "file"])

    lines = _lines(spark, path).mapInArrow(cut, "value string, file string").where(F.trim("value") != "")
    fields = F.from_csv("value", F.lit(", ".join(f"_{k} string" for k in range(width))), {"escape": '"', "nullValue": "\0", "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "maxCharsPerColumn": "-1", "maxColumns": str(max(width, 1) + 20_480)})
    rows = lines.withColumn("_row", fields).join(found.withColumnsRenamed({"file": "_file", "names": "_names"}), F.col("file") == F.col("_file"))
    as_array = F.array(*[F.col(f"_row._{k}") for k in range(width)])
    held = rows.select("_names", as_array.alias("_fields"))
    if len(layouts) == 1:
        return held.select(*[F.coalesce(F.get("_fields", F.lit(k)), F.lit("")).alias(c) for k, c in enumerate(columns)])
    place = lambda c: F.array_position("_names", F.lit(c)).cast("int")
    return held.select(*[F.when(place(c) > 0, F.coalesce(F.get("_fields", place(c) - 1), F.lit(""))).alias(c) for c in columns])


def malformed_rows(df: DataFrame, corrupt: str = "_corrupt_record") -> DataFrame:
    """S3: rows, and those with more fields than the header."""
    every = F.concat_ws("", *[F.col(f"`{c}`") for c in df.columns if c != corrupt])  # a pruned scan would not see extra fields
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col(corrupt).isNotNull(), every)).alias("malformed"))


def fail_on_malformed(df: DataFrame, corrupt: str = "_corrupt_record") -> DataFrame:
    """The rows, without the corrupt column; running it stops at the first malformed one."""
    return df.where(F.when(F.col(corrupt).isNotNull(), F.raise_error(F.concat(F.lit("malformed row: "), F.col(corrupt)))).otherwise(F.lit(True))).drop(corrupt)


def write_csv(df: DataFrame, path: str) -> None:
    """Replace the path by the rows; Spark's committer makes the files visible at the end only."""
    df.write.mode("overwrite").csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


#: Instants of documents keep their microseconds.
DOC_INSTANTS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def write_agent_docs(docs: DataFrame, path: str, files: int | None = None, dealt: bool = False) -> None:
    """The documents of all agents as ranges of (agent, part, place) in JSON lines, with two indexes.

    An agent's document is one line for the measures and one for each item of its lists,
    in order. Files are cut by range, so that their number (`files`; otherwise as many as
    a shuffle has partitions, at most) follows the size of the data, not the number of
    agents, and a large document takes several. With `dealt`, tasks hold their rows sorted by
    agent already, as agent_documents leaves them, and become files as they are. `index` holds the measures of every agent;
    `files` where its lines are: agent_id, file, first_row (from 0) and rows.
    """
    spark, order = docs.sparkSession, ["agent_id", "part", "k"]
    ranges = docs
    if not dealt:
        ranges = (docs.repartitionByRange(files, *order) if files else docs.repartitionByRange(*order)).sortWithinPartitions(*order)
    ranges.write.mode("overwrite").option("timestampFormat", DOC_INSTANTS).json(f"{path}/documents")
    docs.where("part = 'stats'").select("agent_id", "stats").write.mode("overwrite").json(f"{path}/index")
    lines = spark.read.schema("agent_id string").json(f"{path}/documents").select("agent_id", F.col("_metadata.file_name").alias("file"))
    before = F.sum("rows").over(Window.partitionBy("file").orderBy("agent_id").rowsBetween(Window.unboundedPreceding, -1))  # agents of one file
    held = lines.groupBy("agent_id", "file").agg(F.count(F.lit(1)).alias("rows")).withColumn("first_row", F.coalesce(before, F.lit(0)))
    held.repartitionByRange("agent_id").sortWithinPartitions("agent_id", "file").write.mode("overwrite").parquet(f"{path}/files")


def read_agent_docs(spark: SparkSession, path: str, schema, agent: str | None = None) -> DataFrame:
    """The rows that write_agent_docs was given; those of one agent from its own files only, found in the index."""
    reader = spark.read.schema(schema)  # Spark's own reader of instants takes DOC_INSTANTS, in less time than by a pattern
    if agent is None:
        return reader.json(f"{path}/documents")
    held = spark.read.parquet(f"{path}/files").where(F.col("agent_id") == agent).select("file").collect()  # at most one row a file
    return reader.json([f"{path}/documents/{r.file}" for r in held]).where(F.col("agent_id") == agent) if held else spark.createDataFrame([], schema)


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """Rows of several exports, missing columns null, with the source's name."""
    out = None
    for name, df in sources.items():
        tagged = df.withColumn("source", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out

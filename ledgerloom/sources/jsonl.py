"""Catalog and ledger files: one JSON object a line.

Lines are parsed by Python's JSON reader in Arrow batches, for Spark's accepts unknown
fields, drops blank lines and keeps no line numbers. Line numbers come from each split's
count of lines, so a file of any size is read in parallel.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors.exceptions.captured import UnsupportedOperationException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .. import schema as S
from ..operators.catalog import upsert

_KINDS = {"string": str, "bigint": int, "map<string,string>": dict}
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "map<string,string>": pa.map_(pa.string(), pa.string())}


class CatalogInvalid(ValueError):
    """The first bad line of a catalog, counted from 1."""

    def __init__(self, line: int, message: str):
        super().__init__(f"line {line}: {message}")
        self.line = line


def _fits(value: object, kind: str) -> bool:
    if kind == "bigint":
        return isinstance(value, int) and not isinstance(value, bool) and -(2**63) <= value < 2**63
    if kind == "string":
        return isinstance(value, str)
    return isinstance(value, dict) and all(isinstance(x, str) for x in value.values())


def _checked(line: str, fields: list[tuple[str, str, bool, bool]], enums: dict[str, frozenset[str]]) -> tuple[dict | None, str | None, str | None]:
    """(row, error category, message). fields: name, kind, nullable, optional."""
    if not line:
        return None, "json_syntax", "blank line"
    try:
        row = json.loads(line)
    except ValueError as e:
        return None, "json_syntax", f"invalid JSON: {e}"
    if not isinstance(row, dict):
        return None, "json_syntax", "not an object"
    names = {f[0] for f in fields}
    if unknown := sorted(set(row) - names):
        return None, "unknown_key", unknown[0]
    if missing := sorted(n for n, _, _, optional in fields if not optional and n not in row):
        return None, "missing_field", missing[0]
    for name, kind, nullable, _ in fields:
        value = row.get(name)
        if value is None and nullable:
            continue
        if not _fits(value, kind):
            return None, "invalid_value", name
        if name in enums and value not in enums[name]:
            return None, "unknown_enum", f"{name}: {value}"
    return row, None, None


def _lines(spark: SparkSession, path: str, schema: T.StructType, optional: frozenset[str], enums: dict[str, frozenset[str]]) -> DataFrame:
    """schema's columns with line_no, category and message."""
    fields = [(f.name, f.dataType.simpleString(), f.nullable, f.name in optional) for f in schema]
    raw = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), "value")
    head = [("f", pa.string()), ("b", pa.int64()), ("n", pa.int64()), ("category", pa.string()), ("message", pa.string())]
    out = T.StructType([T.StructField("f", T.StringType()), T.StructField("b", T.LongType()), T.StructField("n", T.LongType()), T.StructField("category", T.StringType()), T.StructField("message", T.StringType()), *(T.StructField(f.name, f.dataType) for f in schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n = None, 0
        for batch in batches:
            rows: list[list] = []
            for f, b, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = n + 1 if (f, b) == at else 1
                at = (f, b)
                row, category, message = _checked(v.removesuffix("\r"), fields, enums)
                values = [(row or {}).get(name) for name, *_ in fields]
                rows.append([f, b, n, category, message, *(list(x.items()) if isinstance(x, dict) else x for x in values)])
            kinds = [k for _, k in head] + [_ARROW[k] for _, k, *_ in fields]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names=[*(h for h, _ in head), *(f[0] for f in fields)])

    parsed = raw.mapInArrow(run, out)
    counts = parsed.groupBy("f", "b").agg(F.max("n").alias("c"))
    before = counts.select("f", "b", (F.sum("c").over(Window.partitionBy("f").orderBy("b")) - F.col("c")).alias("before"))
    return parsed.join(before, ["f", "b"]).withColumn("line_no", F.col("n") + F.col("before")).drop("f", "b", "n", "before")


#: Columns that a catalog line may lack.
OPTIONAL = frozenset({"content_type", "quarantined_at", "tombstoned_at", "origin"})


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The catalog of a file; the first bad line ends it. A later row of one (source, key) replaces an earlier one."""
    rows = _lines(spark, path, S.CATALOG, OPTIONAL, {})
    bad = rows.where("category IS NOT NULL").orderBy("line_no").select("line_no", "category", "message").limit(1).collect()
    if bad:
        raise CatalogInvalid(bad[0].line_no, f"{bad[0].category}: {bad[0].message}")
    return upsert(rows, ["source", "key"], "line_no").select(S.CATALOG.names)


def read_ledger(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(ledger rows with line_no, errors: line_no, category, message)."""
    rows = _lines(spark, path, T.StructType([T.StructField(f.name, f.dataType, f.name in _NULLABLE) for f in S.LEDGER]), frozenset(), {"action": frozenset(S.ACTIONS), "result": frozenset(S.RESULTS)})
    return rows.where("category IS NULL").drop("category", "message"), rows.where("category IS NOT NULL").select("line_no", "category", "message")


_NULLABLE = {"source", "target", "key", "content_hash", "size_bytes", "error"}


def to_lines(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """value: an object a row, its names sorted, nulls kept, the names of maps sorted."""
    cols = [F.map_from_entries(F.array_sort(F.map_entries(f.name))).alias(f.name) if isinstance(f.dataType, T.MapType) else F.col(f.name) for f in sorted(schema, key=lambda f: f.name)]
    return rows.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value"))


def write_file(lines: DataFrame, path: str) -> None:
    """One file that appears at once, its lines in the order of the partitions: all tasks write their parts side by side, and
    the file system puts them one behind the other (by itself where it can, else by copying bytes) before the result takes its place."""
    spark = lines.sparkSession
    beside = f"{path}.writing"
    lines.write.mode("overwrite").option("lineSep", "\n").text(beside)
    hadoop = spark._jvm.org.apache.hadoop
    at, target, whole = (hadoop.fs.Path(p) for p in (beside, path, f"{beside}/whole"))
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = [x.getPath() for x in fs.listStatus(at) if x.getPath().getName().startswith("part-") and x.getLen()]
    parts.sort(key=lambda p: int(p.getName().split("-")[1]))
    fs.create(whole, True).close()
    if parts and not _concatenated(spark, fs, whole, parts):
        out = fs.create(whole, True)
        try:
            for part in parts:
                read = fs.open(part)
                try:
                    hadoop.io.IOUtils.copyBytes(read, out, 1 << 20, False)
                finally:
                    read.close()
        finally:
            out.close()
    fs.delete(target, False)
    fs.rename(whole, target)
    fs.delete(at, True)


def _concatenated(spark: SparkSession, fs, whole, parts: list) -> bool:
    """Whether the file system has moved the parts' blocks behind each other, without reading them."""
    array = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Path, len(parts))
    for i, part in enumerate(parts):
        array[i] = part
    try:
        fs.concat(whole, array)
        return True
    except UnsupportedOperationException:
        return False


def write_catalog(catalog: DataFrame, path: str) -> None:
    """Rows in the order of (content_hash, source, key): equal catalogs give equal bytes, however many tasks write them."""
    write_file(to_lines(catalog.orderBy("content_hash", "source", "key"), S.CATALOG), path)


def append_ledger(rows: DataFrame, folder: str) -> None:
    """Adds a run's rows to a Parquet ledger, by run."""
    rows.write.mode("append").partitionBy("run_id").parquet(folder)


Parser = Callable[[SparkSession, str], DataFrame]

"""Line-oriented sources and sinks: JSON lines, whole JSON files, CSV and Excel; outputs are committed as a whole."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogforge.functions.text import SPACE, json_valid
from dialogforge.operators.records import last_wins, numbered
from dialogforge.operators.running import before

def scan_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file, line_no, raw``: physical lines from 1, blank ones too, of files of any size.

    Lines are ordered within the splits of a file only; the counts of the splits before give the rest of the number.
    """
    lines = spark.read.option("lineSep", "\n").text(paths)
    placed = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), F.rtrim("value", F.lit("\r")).alias("raw"))
    counted = before(placed, ["file"], ["_block"], ["_id"], {"_before": F.lit(1)})
    return counted.select("file", (F.col("_before") + 1).alias("line_no"), "raw")


def scan_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file, raw`` of every line, in splits of any size, where line numbers are not needed."""
    return spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw"))


def validated(lines: DataFrame, on_bad: str = "skip", on_blank: str = "skip") -> DataFrame:
    """Lines that are JSON. on_bad, on_blank: skip, error (the job fails at the first such line) or keep (column ``valid`` tells)."""
    blank = ~F.regexp_like(F.coalesce("raw", F.lit("")), F.lit(f"[^{SPACE[1:-1]}]"))
    judged = lines.withColumn("_blank", blank).withColumn("valid", F.when(F.col("_blank"), F.lit(False)).otherwise(json_valid(F.col("raw"))))
    for mode, bad, what in ((on_blank, F.col("_blank"), "blank line"), (on_bad, ~F.col("_blank") & ~F.col("valid"), "line that is no JSON")):
        if mode == "error":
            judged = judged.filter(F.when(bad, F.raise_error(F.lit(what)).cast("boolean")).otherwise(F.lit(True)))  # a filter is never pruned
        elif mode not in ("skip", "keep"):
            raise ValueError(f"unknown mode {mode}")
        elif mode == "skip":
            judged = judged.filter(~bad)
    return judged.drop("_blank")


def malformed(lines: DataFrame) -> DataFrame:
    """``line_no, snippet`` (and ``file`` if there) of the lines that are neither blank nor JSON; the first 200 characters."""
    bad = validated(lines, on_bad="keep").filter("not valid")
    return bad.select(*[c for c in ("file", "line_no") if c in lines.columns], F.left("raw", F.lit(200)).alias("snippet"))


def keyed(lines: DataFrame, path: str = "dialogue_id", order: list[str] | None = None) -> DataFrame:
    """The last valid record of each id: the lines' columns and ``key``; records without the id are left out."""
    records = validated(lines).withColumn("key", F.get_json_object("raw", f"$.{path}"))
    return last_wins(records, "key", order or ["file", "line_no"])


def scan_json_file(spark: SparkSession, paths: str | list[str], explode_arrays: bool = True) -> DataFrame:
    """``file, raw``: one record per file; a file that holds an array gives one per element, if wanted."""
    whole = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw"))
    if not explode_arrays:
        return whole
    elements = F.from_json("raw", "array<variant>")
    is_array = F.startswith(F.ltrim("raw"), F.lit("["))
    arrays = whole.filter(is_array).select("file", F.explode(elements).alias("v")).select("file", F.to_json("v").alias("raw"))
    return whole.filter(~is_array).unionByName(arrays)


def read_csv(spark: SparkSession, paths: str | list[str], schema: str | None = None) -> DataFrame:
    """A CSV file with a header; without a schema the types are inferred by one more pass."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.schema(schema).csv(paths) if schema else reader.option("inferSchema", True).csv(paths)


def read_excel(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Every sheet of a workbook; needs an Excel reader on the driver, as Spark has none (workbooks are bounded by their format)."""
    try:
        import openpyxl  # noqa: F401
    except ImportError as error:
        raise RuntimeError("reading Excel files needs openpyxl") from error
    return {name: spark.createDataFrame(sheet) for name, sheet in pd.read_excel(path, sheet_name=None).items()}


def write_jsonl(df: DataFrame, path: str, mode: str = "error", ascii: bool = False) -> None:
    """JSON lines in UTF-8, or with escapes for what is not ASCII; the folder appears as a whole."""
    df.write.mode(mode).option("ignoreNullFields", False).option("writeNonAsciiCharacterAsCodePoint", ascii).json(path)


def write_same_names(df: DataFrame, path: str, file: str = "file", column: str = "raw", mode: str = "error") -> None:
    """Lines in one folder per file they came from, named after it (``source=<name>``)."""
    name = F.element_at(F.split(file, "/"), -1)
    df.select(name.alias("source"), F.col(column).alias("value")).write.mode(mode).partitionBy("source").text(path)


def write_lines(df: DataFrame, path: str, column: str = "raw", mode: str = "error") -> None:
    """Lines as they were read, not serialised anew."""
    df.select(F.col(column).alias("value")).write.mode(mode).text(path)


def write_by(df: DataFrame, column: str, path: str, mode: str = "error") -> None:
    """One folder per value of ``column``."""
    df.write.mode(mode).partitionBy(column).json(path)


def append_with_ids(df: DataFrame, path: str, order: list[str], prefix: str = "id_") -> None:
    """Appends rows whose ids continue behind the lines that are there; the rows are numbered by ranges, not in one task."""
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    start = spark.read.text(path).filter("trim(value) <> ''").count() if there else 0
    rows = numbered(df, order, "_i", start)
    rows.withColumn("custom_id", F.concat(F.lit(prefix), F.col("_i").cast("string"))).drop("_i").write.mode("append").json(path)


def replace(df: DataFrame, path: str, backup: bool = False, text: bool = False) -> None:
    """Puts ``df`` (which may be read from ``path``) in the place of ``path``: written beside it, then renamed.

    The old folder is moved aside first and deleted last, so that a crash loses neither; if the new one can't be moved, the
    old one comes back. text: the one column holds whole lines. backup: the old folder is kept as ``<path>.backup`` if there is none yet.
    """
    spark = df.sparkSession
    beside = f"{path}.{uuid.uuid4().hex}"
    df.write.text(beside) if text else write_jsonl(df, beside)
    as_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = as_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    kept = backup and not fs.exists(as_path(f"{path}.backup"))
    aside = f"{path}.backup" if kept else f"{beside}.old"
    there = fs.exists(as_path(path))
    if there and not fs.rename(as_path(path), as_path(aside)):
        raise OSError(f"{path} can't be moved; the new data is at {beside}")
    if not fs.rename(as_path(beside), as_path(path)):
        if there:
            fs.rename(as_path(aside), as_path(path))
        raise OSError(f"{path} can't be replaced; the new data is at {beside}")
    if there and not kept:
        fs.delete(as_path(aside), True)


def write_text(spark: SparkSession, path: str, content: str) -> None:
    """One small text file, such as a report or a summary."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(bytearray(content.encode("utf-8")))
    finally:
        stream.close()


def write_summary(one_row: DataFrame, path: str) -> None:
    """A table of one row as an indented JSON object."""
    row = one_row.limit(1).collect()
    write_text(one_row.sparkSession, path, json.dumps(row[0].asDict(recursive=True) if row else {}, indent=2, ensure_ascii=False, default=str))


def write_csv(small: DataFrame, path: str, mode: str = "error") -> None:
    """A small table as one CSV file with a header."""
    small.coalesce(1).write.mode(mode).option("header", True).csv(path)


def output_names(inputs: list[str], suffix: str, out: str | None = None, inplace: bool = False) -> list[str]:
    """Where each input's result goes: in place, to ``out`` (a file for one input, a folder for several), or beside it with the suffix."""
    if out and inplace:
        raise ValueError("an output and in-place writing exclude each other")
    if inplace:
        return list(inputs)
    if out:
        return [out] if len(inputs) == 1 else [f"{out.rstrip('/')}/{x.rsplit('/', 1)[-1]}" for x in inputs]
    return [f"{x.removesuffix('.jsonl')}.{suffix}.jsonl" for x in inputs]

"""Whole-record operators: last record wins, pairing, splitting, ids, envelopes, sampling and line accounting."""

from __future__ import annotations

import functools
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from dialogforge.functions.text import SPACE, custom_id_index, strip_code_fence, unwrap_fenced_json
from dialogforge.session import cut


def last_wins(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each non-null key by ``order`` (names of comparable columns), found by a map-side combined aggregation."""
    whole = F.struct(*[F.col(c) for c in df.columns])
    best = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max_by(whole, F.struct(*order)).alias("_row"))
    return best.select("_row.*")


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """``key, records`` of the keys that occur more than once."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("records")).filter("records > 1")


def split_results(df: DataFrame, kind: Column) -> DataFrame:
    """With ``output``: success for succeeded, error for errored and expired; others (canceled) are dropped."""
    output = F.when(kind == "succeeded", "success").when(kind.isin("errored", "expired"), "error")
    return df.withColumn("output", output).filter("output is not null")


def envelope_text(raw: Column) -> Column:
    """Text of a provider's reply, of either layout; null where neither is there."""
    a, b = F.get_json_object(raw, "$.result.message.content[0].text"), F.get_json_object(raw, "$.response.body.choices[0].message.content")
    has_result = F.array_contains(F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>")), "result")
    return F.when(has_result, a).otherwise(b)


def envelope_truncated(raw: Column) -> Column:
    """Whether the provider cut the reply off at its limit."""
    a, b = F.get_json_object(raw, "$.result.message.stop_reason"), F.get_json_object(raw, "$.response.body.choices[0].finish_reason")
    return F.coalesce(a == "max_tokens", F.lit(False)) | F.coalesce(b == "length", F.lit(False))


def open_envelopes(df: DataFrame, raw: str = "raw") -> DataFrame:
    """``payload`` of each envelope: the reply without its json fence; records that carry a dialogue_id pass as they are.

    Replies cut off by the provider, empty ones and envelopes of another layout are dropped; a failed request is one of them.
    """
    keys = F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>"))
    ready = F.array_contains(keys, "dialogue_id")
    payload = F.when(ready, F.col(raw)).when(~envelope_truncated(F.col(raw)), unwrap_fenced_json(envelope_text(F.col(raw))))
    return df.withColumn("payload", payload).filter(F.coalesce(F.col("payload"), F.lit("")) != "")


def joined_text(content: Column) -> Column:
    """The texts of all text blocks of a reply, joined by blanks; a block without text counts as ""."""
    texts = F.transform(F.filter(content, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit("")))
    return F.array_join(texts, " ")


def expand_payload(role: Column, content: Column) -> Column:
    """``struct<role, content, code_snippet>`` of a message whose content may itself be a JSON object with these fields."""
    inner = strip_code_fence(content)
    parsed = F.from_json(inner, "content string, code_snippet string")
    is_object = F.coalesce(F.json_object_keys(inner).isNotNull(), F.lit(False)) & F.startswith(inner, F.lit("{"))
    return F.struct(role.alias("role"), F.when(is_object, parsed["content"]).otherwise(content).alias("content"), F.when(is_object, parsed["code_snippet"]).alias("code_snippet"))


def pair_by_index(inputs: DataFrame, outputs: DataFrame, prefix: str = "id_0", offset: int = 1) -> DataFrame:
    """Inputs (``line_index``) with the outputs (``custom_id``, ``out_order``) whose id names that line; of several the last counts."""
    resolved = outputs.withColumn("line_index", custom_id_index(F.col("custom_id"), prefix, offset)).filter("line_index is not null")
    return inputs.join(last_wins(resolved, "line_index", ["out_order"]), "line_index")


def missing_outputs(inputs: DataFrame, outputs: DataFrame, prefix: str = "id_0", offset: int = 1) -> DataFrame:
    """Inputs without any output."""
    resolved = outputs.select(custom_id_index(F.col("custom_id"), prefix, offset).alias("line_index"))
    return inputs.join(resolved, "line_index", "left_anti")


def add_ids(lines: DataFrame, prefix: str = "", line_no: str = "line_no", name: str = "id") -> DataFrame:
    """An id per physical line: ``prefix_i`` or ``i``, counted from 0 and over blank lines too."""
    index = (F.col(line_no) - 1).cast("string")
    return lines.withColumn(name, F.concat(F.lit(f"{prefix}_"), index) if prefix else index)


def set_nested(df: DataFrame, path: str, value: Column) -> DataFrame:
    """``value`` at a dotted path; missing structs on the way are made."""
    first, _, rest = path.partition(".")
    if not rest:
        return df.withColumn(first, value)
    inner = value
    parts = rest.split(".")
    if first in df.columns:
        return df.withColumn(first, F.col(first).withField(rest, inner))
    for name in reversed(parts):
        inner = F.struct(inner.alias(name))
    return df.withColumn(first, inner)


def get_path(raw: Column, path: str) -> Column:
    """The value at a dotted path of a JSON text, as text; arrays are not entered; null where a step is missing."""
    return F.get_json_object(raw, "$." + path)


def line_counts(lines: DataFrame, valid: Column, by: list[str]) -> DataFrame:
    """``lines, blank, valid, invalid`` per group; ``valid`` judges the lines that are not blank."""
    blank = ~F.regexp_like(F.coalesce("raw", F.lit("")), F.lit(f"[^{SPACE[1:-1]}]"))
    judged = lines.withColumn("_blank", blank).withColumn("_valid", valid)
    return judged.groupBy(*by).agg(F.count("*").alias("lines"), F.count_if("_blank").alias("blank"), F.count_if(~F.col("_blank") & F.col("_valid")).alias("valid"), F.count_if(~F.col("_blank") & ~F.col("_valid")).alias("invalid"))


def unique_ids(df: DataFrame, id_column: str, order: list[str]) -> DataFrame:
    """Repeated ids made distinct: every further occurrence gets its number (from 1) behind a hyphen.

    order: columns that name a row together with the id. A new id that some row already has gets low lines behind it until
    it is free. Rows are numbered by ranges, so that an id of any number of rows is spread. Null ids stay null.
    """
    placed = numbered(df.filter(F.col(id_column).isNotNull()), [id_column, *order], "_n")
    first = placed.groupBy(F.col(id_column).alias("_id")).agg(F.min("_n").alias("_first"))
    ranked = placed.join(first, F.col(id_column) == F.col("_id")).withColumn("_k", F.col("_n") - F.col("_first"))
    further = F.concat_ws("-", id_column, F.col("_k").cast("string"))
    made = cut(ranked.withColumn("_new", F.when(F.col("_k") == 0, F.col(id_column)).otherwise(further)).drop("_n", "_id", "_first"), "made")
    known = first.select(F.col("_id").alias("_new"), F.lit(True).alias("_taken"))
    while made.filter("_k > 0").join(known, "_new", "left_semi").limit(1).count():  # ids that end so are rare: a round or two
        marked = made.join(known, "_new", "left")
        made = cut(marked.withColumn("_new", F.when((F.col("_k") > 0) & F.col("_taken"), F.concat("_new", F.lit("_"))).otherwise(F.col("_new"))).drop("_taken"), "made")
    return made.withColumn(id_column, F.col("_new")).select(df.columns).unionByName(df.filter(F.col(id_column).isNull()))


def numbered(df: DataFrame, order: list[str], name: str = "number", start: int = 0) -> DataFrame:
    """Rows with their place (from ``start``) in the order of the named columns, which should name a row.

    Rows are range-partitioned and written once with their place in the partition; partition sizes give the offsets.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    within = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = cut(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_place", within), "numbered")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # a row per partition
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    return placed.join(offsets, "_part").withColumn(name, F.col("_offset") + F.col("_place") + start).drop("_part", "_place", "_offset")


_BUCKETS = 4_096
_ORDERED = 10_000  # rows of one bucket that may be ordered in one place


def sample_exact(df: DataFrame, n: int, keys: list[str], seed: int = 0) -> DataFrame:
    """Exactly ``min(n, rows)`` rows, uniformly by a seeded hash of ``keys`` (which name a row).

    The hash's leading digits are counted in buckets; whole buckets below the cut are kept, and the bucket at the cut is
    taken apart by the next digits until it is small enough to be ordered, so that no sample gathers in one place.
    """
    digit = lambda level: F.pmod(F.shiftrightunsigned("_h", 12 * level), F.lit(_BUCKETS))
    part, kept, left = df.withColumn("_h", F.xxhash64(F.lit(seed), *keys)), [], n
    for level in range(5):
        counts = {r["b"]: r["n"] for r in part.groupBy(digit(level).alias("b")).agg(F.count("*").alias("n")).collect()}  # at most _BUCKETS rows
        if sum(counts.values()) <= left:
            kept.append(part)
            break
        at = 0
        while counts.get(at, 0) <= left:
            left -= counts.get(at, 0)
            at += 1
        kept.append(part.filter(digit(level) < at))
        part = part.filter(digit(level) == at)
        if counts[at] <= _ORDERED or level == 4:  # equal hashes are left in the end
            kept.append(part.orderBy("_h", *keys).limit(left))
            break
    return functools.reduce(DataFrame.unionByName, kept).drop("_h")


def sample_percent(df: DataFrame, percent: float, keys: list[str], seed: int = 0) -> DataFrame:
    """A sample of ``round(rows * percent / 100)`` rows (half to even)."""
    if not 0 < percent <= 100:
        raise ValueError("percent must lie in (0, 100]")
    return sample_exact(df, round(df.count() * percent / 100), keys, seed)


def with_json_field(raw: Column, path: str, value: Column, parse: bool = False) -> Column:
    """A JSON object's text with ``value`` (a text; with ``parse`` JSON) at a dotted path; a field that is there is replaced, missing objects are made.

    Text that is no object stays as it is.
    """

    @F.pandas_udf("string")
    def put(lines: pd.Series, values: pd.Series) -> pd.Series:
        *steps, name = path.split(".")

        def one(line: str | None, v: str | None) -> str | None:
            try:
                record = json.loads(line)
            except (TypeError, ValueError, RecursionError):
                return line
            if not isinstance(record, dict):
                return line
            at = record
            for step in steps:
                if not isinstance(at.get(step), dict):
                    at[step] = {}
                at = at[step]
            at[name] = json.loads(v) if parse and v is not None else v
            return json.dumps(record, ensure_ascii=False)

        return pd.Series([one(x, v) for x, v in zip(lines, values)], dtype=object)

    return put(raw, value)


def require_path(df: DataFrame, raw: str, path: str) -> DataFrame:
    """``df``, whose job fails at the first row without a value at the dotted path; the error names the path."""
    there = F.when(get_path(F.col(raw), path).isNull(), F.raise_error(F.lit(f"no value at {path}")).cast("boolean")).otherwise(F.lit(True))
    return df.filter(there)

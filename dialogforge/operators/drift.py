"""Schemas that drift between files: rescue-column ingestion and a report of every layout change.

``ingest`` enforces one target schema, keeps what does not fit as JSON in ``rescued`` and says of each field of a record
whether it was kept or rescued, with its JSON type and hashes of its values (``layout``). ``promote`` turns an approved field
of ``rescued`` into a typed column, and ``replay`` fills the target's columns from rescued values. ``layout_changes`` reports
added, removed, renamed and retyped fields of each file against the file before it in the same feed, from what the
ingestion kept and rescued.

Lines are parsed once, in Arrow batches; counting, comparing files and judging renames are Spark aggregations, windows and
joins on the field inventory (files x fields rows) and the hashed values, never on whole feeds in one task. Further names
that renames show are resolved as a graph and joined to the files that use them; no list of names is gathered.

Defined results: null, blank, invalid or non-object lines have no layout (``ingest`` keeps them with ``parse_error``);
files without a valid record are passed over; duplicate keys: the last wins; repeated lines count once per file where
values are compared; an empty table gives no rows; columns other than those named are ignored or passed through.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from dialogforge.operators.components import components
from dialogforge.session import cut

#: Python types of parsed JSON -> JSON type.
_TYPES = {str: "string", bool: "boolean", int: "number", float: "number", list: "array", dict: "object"}

#: Share of the compared records whose values must agree for a rename, for scalars and for containers (their content).
SAME_SHARE, CONTENT_SHARE = 0.8, 0.5

def parse_record(raw: str | None) -> dict | None:
    """The JSON object on a line, or None if it is blank, invalid or no object."""
    if raw is None:
        return None
    try:
        value = json.loads(raw)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def layout_of(record: dict) -> dict[tuple[str, str], list]:
    """(container, field) -> [kind of the container, JSON type, places of the elements that hold a value, hashes of the scalars]."""
    out: dict[tuple[str, str], list] = {}

    def add(container: str, kind: str, place: int, element: dict) -> list[int]:
        """Describe the fields of an element; all its hashes."""
        inside: list[int] = []
        for field, value in element.items():
            entry = out.get((container, field))
            if entry is None:
                entry = out[container, field] = [kind, None, [], []]
            if value is None:
                continue
            if entry[1] is None:
                entry[1] = _TYPES[type(value)]
            nested = not container and isinstance(value, dict | list)
            hashes = below(field, value) if nested else _leaves(value)
            if hashes:
                entry[2].append(place)
                entry[3] += hashes if not place else [_placed(h, place) for h in hashes]
                inside += hashes
        return inside

    def below(container: str, value: dict | list) -> list[int]:
        if isinstance(value, dict):
            return add(container, "object", 0, value)
        inside: list[int] = []
        for place, x in enumerate(value):
            inside += add(container, "array", place, x) if isinstance(x, dict) else _leaves(x)
        return inside

    add("", "", 0, record)
    return out


_FOUND = "feed_key string, file_name string, file_seq int, dialogue_id string, paths array<string>, types array<string>, places array<array<int>>, leaves array<array<bigint>>"
_FOUND_ARROW = {"paths": pa.list_(pa.string()), "types": pa.list_(pa.string()), "places": pa.list_(pa.list_(pa.int32())), "leaves": pa.list_(pa.list_(pa.int64()))}


def layouts(df: DataFrame) -> DataFrame:
    """``feed_key, file_name, file_seq, dialogue_id, paths, types, places, leaves`` of every valid line, as the ingestion found it.

    paths: container and field; types: kind of the container, JSON type, kept or rescued; feed_key: the feed, "" for null.
    """

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [conform(x, {}, layout=True, typed=False) for x in batch.column("raw").to_pylist()]
            valid = pa.array([not f[4] for f in found], pa.bool_())
            kept = batch.select(["feed_key", "file_name", "file_seq"]).filter(valid)
            found = [f for f in found if not f[4]]
            made = [pa.array([f[0] for f in found], pa.string())] + [pa.array([f[5][name] for f in found], kind) for name, kind in _FOUND_ARROW.items()]
            yield pa.RecordBatch.from_arrays([*kept.columns, *made], names=["feed_key", "file_name", "file_seq", "dialogue_id", *_FOUND_ARROW])

    lines = df.filter("file_seq is not null and file_name is not null").select(F.coalesce("feed", F.lit("")).alias("feed_key"), "file_name", F.col("file_seq").cast("int").alias("file_seq"), "raw")
    wide = df.sparkSession.sparkContext.defaultParallelism
    if lines.rdd.getNumPartitions() < wide:  # a small table in few files: parsing is worth a shuffle
        lines = lines.repartition(wide)
    return lines.mapInArrow(described, _FOUND)


def field_inventory(found: DataFrame) -> DataFrame:
    """``feed_key, file_name, file_seq, container, field, kind, jtype, n, rescued`` of ``layouts``: records, and records whose value was rescued."""
    file = ["feed_key", "file_name", "file_seq"]
    alike = found.groupBy(*file, "paths", "types").agg(F.count("*").alias("n"))
    each = alike.select(*file, "n", F.explode_outer(F.arrays_zip("paths", "types")).alias("x"))
    path, kind = F.split("x.paths", "\x1f"), F.split("x.types", "\x1f")
    rows = each.select(*file, path[0].alias("container"), path[1].alias("field"), kind[0].alias("kind"), F.nullif(kind[1], F.lit("")).alias("jtype"), "n", (kind[2] == "rescued").cast("bigint").alias("rescued"))
    return rows.groupBy(*file, "container", "field", "kind", "jtype").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("rescued")).alias("rescued"))


def _layouts(inventory: DataFrame) -> DataFrame:
    """One row per file and field with its JSON type and the rank of the file in its feed.

    A file's type of a field is the one of most records (ties: the first by name).
    """
    files = inventory.select("feed_key", "file_name", "file_seq").distinct()
    files = files.withColumn("rank", F.row_number().over(W.partitionBy("feed_key").orderBy("file_seq", "file_name")))
    per_field = inventory.filter("container is not null").groupBy("feed_key", "file_name", "file_seq", "container", "kind", "field")
    best = F.max(F.when(F.col("jtype").isNotNull(), F.struct(F.col("n"), F.negative(F.ascii("jtype")).alias("tie"), F.col("jtype"))))
    return per_field.agg(best["jtype"].alias("jtype")).join(files, ["feed_key", "file_name", "file_seq"])


def _leaves(value: object) -> list[int]:
    """Hashes of the scalars within a value; a number, a boolean and its text are alike, nulls are left out."""
    if isinstance(value, str):
        return [xxhash.xxh64_intdigest(value) - (1 << 63)]
    if value is None:
        return []
    if isinstance(value, dict | list):
        return [h for x in (value.values() if isinstance(value, dict) else value) for h in _leaves(x)]
    return [xxhash.xxh64_intdigest(json.dumps(value)) - (1 << 63)]


def _placed(leaf: int, place: int) -> int:
    """The hash of a scalar of the element at ``place``."""
    return (leaf + place * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


def _wanted_values(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """Values of the fields in ``wanted`` (feed_key, file_name, pair, side, path) by record; repeated records count once."""
    per_file = wanted.groupBy("feed_key", "file_name").agg(F.collect_set(F.struct("pair", "side", "path")).alias("wanted"))
    each = found.filter("dialogue_id is not null").join(per_file, ["feed_key", "file_name"]).withColumn("w", F.explode("wanted"))
    at = F.array_position("paths", F.col("w.path"))
    held = each.withColumn("at", at.cast("int")).filter("at > 0").select("w.*", "dialogue_id", F.split(F.element_at("types", F.col("at")), "\x1f")[1].alias("jtype"), F.element_at("places", F.col("at")).alias("places"), F.element_at("leaves", F.col("at")).alias("leaves"))
    return held.filter(F.size("leaves") > 0).groupBy("pair", "side", "path", "dialogue_id").agg(F.min_by(F.struct("jtype", "places", "leaves"), F.xxhash64("leaves")).alias("v"))


def _renames(found: DataFrame, gone: DataFrame, new: DataFrame) -> DataFrame:
    """Pairs of a gone and a new field of the same level and file pair whose values agree.

    gone, new: feed_key, rank (of the newer file), group (the level), file_name, container, field.
    """
    on = ["feed_key", "rank", "group"]
    both = gone.select(*on, F.lit(0).alias("side"), "file_name", "container", "field").unionByName(new.select(*on, F.lit(1).alias("side"), "file_name", "container", "field"))
    sides = both.groupBy(*on).agg(F.min("side").alias("a"), F.max("side").alias("b")).filter("a = 0 and b = 1").select(*on)
    pair = F.concat_ws("\x1e", "feed_key", F.col("rank").cast("string"), "group")
    wanted = both.join(sides, on).select("feed_key", "file_name", pair.alias("pair"), "side", F.concat_ws("\x1f", "container", "field").alias("path"))
    values = cut(_wanted_values(found, wanted), "values")
    old_v = values.filter("side = 0").select("pair", "dialogue_id", F.col("path").alias("old_path"), F.col("v").alias("old_v"))
    new_v = values.filter("side = 1").select("pair", "dialogue_id", F.col("path").alias("new_path"), F.col("v").alias("new_v"))
    a, b = F.col("old_v.leaves"), F.col("new_v.leaves")
    nested = F.col("old_v.jtype").isin("object", "array") | F.col("new_v.jtype").isin("object", "array")
    shared = F.size(F.array_intersect(a, b)) / F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    # Single values may be null in either file: only elements that both hold are compared.
    same = F.when(nested, shared >= CONTENT_SHARE).otherwise(shared == 1).cast("int")
    held = old_v.join(new_v, ["pair", "dialogue_id"]).filter(F.arrays_overlap("old_v.places", "new_v.places"))
    score = held.groupBy("pair", "old_path", "new_path").agg(F.avg(same).alias("share"), F.count("*").alias("held"))
    order = [F.col("share").desc(), F.col("held").desc()]
    ranked = score.filter(F.col("share") >= SAME_SHARE)
    ranked = ranked.withColumn("r_old", F.row_number().over(W.partitionBy("pair", "old_path").orderBy(*order, "new_path")))
    ranked = ranked.withColumn("r_new", F.row_number().over(W.partitionBy("pair", "new_path").orderBy(*order, "old_path"))).filter("r_old = 1 and r_new = 1")
    key = F.split("pair", "\x1e")
    old_path, new_path = F.split("old_path", "\x1f"), F.split("new_path", "\x1f")
    return ranked.select(key[0].alias("feed_key"), key[1].cast("int").alias("rank"), key[2].alias("group"), old_path[0].alias("old_container"), old_path[1].alias("old_field"), new_path[0].alias("new_container"), new_path[1].alias("new_field"))


def _written(container: Column, kind: Column, field: Column) -> Column:
    return F.when(container == "", field).when(kind == "array", F.concat(container, F.lit("[]."), field)).otherwise(F.concat(container, F.lit("."), field))


def layout_changes(df: DataFrame) -> DataFrame:
    """``file_name, change_kind, old_field, new_field``: the changes of each file against the one before it in its feed."""
    found = cut(layouts(df), "layouts")
    fields = cut(_layouts(field_inventory(found)), "fields")
    ranks = fields.select("feed_key", "rank", F.col("file_name").alias("this_file")).distinct()

    def compare(now: DataFrame) -> DataFrame:
        """Fields that are gone, new or retyped between two files that both exist: ``status`` and both sides' names.

        A field is named by its group (level) and name; types are held against the last known one of that name.
        """
        seen = F.last("jtype", ignorenulls=True).over(W.partitionBy("feed_key", "group", "field").orderBy("rank").rowsBetween(W.unboundedPreceding, -1))
        typed = now.withColumn("last_type", seen).withColumn("is", F.lit(True))
        older = now.select("feed_key", "group", "kind", "field", (F.col("rank") + 1).alias("rank"), F.lit(True).alias("was"), F.col("container").alias("old_container"), F.col("file_name").alias("old_file"))
        both = typed.drop("file_name").join(older, ["feed_key", "group", "kind", "field", "rank"], "full_outer").join(ranks, ["feed_key", "rank"]).filter("rank > 1")
        status = F.when(F.col("is").isNull(), "gone").when(F.col("was").isNull(), "new").when(F.col("jtype") != F.col("last_type"), "retyped")
        return both.select("feed_key", "rank", "group", "kind", "field", "container", "old_container", "old_file", "this_file", status.alias("status")).filter("status is not null")

    def rename(changed: DataFrame, name: str) -> DataFrame:
        side = lambda status, file, container: changed.filter(F.col("status") == status).select("feed_key", "rank", "group", F.col(file).alias("file_name"), F.col(container).alias("container"), "field")
        return cut(_renames(found, side("gone", "old_file", "old_container"), side("new", "this_file", "container")), name)

    def report(changed: DataFrame, renamed: DataFrame) -> DataFrame:
        """Rows of the result; what was renamed is neither gone nor new."""
        moved = renamed.select("feed_key", "rank", F.lit("gone").alias("status"), F.col("old_container").alias("at"), F.col("old_field").alias("field"))
        moved = moved.unionByName(renamed.select("feed_key", "rank", F.lit("new").alias("status"), F.col("new_container").alias("at"), F.col("new_field").alias("field")))
        old_name, new_name = _written(F.col("old_container"), F.col("kind"), F.col("field")), _written(F.col("container"), F.col("kind"), F.col("field"))
        left = changed.withColumn("at", F.when(F.col("status") == "gone", F.col("old_container")).otherwise(F.col("container"))).join(moved, ["feed_key", "rank", "status", "at", "field"], "left_anti")
        names = F.create_map(*[F.lit(x) for x in ("gone", "removed", "new", "added", "retyped", "type_changed")])
        plain = left.select("this_file", names[F.col("status")].alias("change_kind"), F.when(F.col("status") == "new", "").otherwise(old_name).alias("old_field"), F.when(F.col("status") == "gone", "").otherwise(new_name).alias("new_field"))
        kind = F.split("group", "\x1d")[0]
        both = renamed.join(ranks, ["feed_key", "rank"]).select("this_file", F.lit("renamed").alias("change_kind"), _written(F.col("old_container"), kind, F.col("old_field")).alias("old_field"), _written(F.col("new_container"), kind, F.col("new_field")).alias("new_field"))
        return plain.unionByName(both)

    # Top level.
    top = cut(compare(fields.filter("container = ''").withColumn("group", F.lit("top"))), "top")
    renamed = rename(top, "renamed")

    # Below: the fields of a container, which keeps its identity when it is itself renamed.
    moved = renamed.select("feed_key", F.explode(F.array("old_field", "new_field")).alias("container")).distinct().withColumn("moved", F.lit(True))
    below = fields.filter("container <> ''").join(moved, ["feed_key", "container"], "left")
    below = below.withColumn("group", F.concat(F.col("kind"), F.lit("\x1d"), F.when(F.col("moved"), F.lit("\x1dmoved")).otherwise(F.col("container")))).drop("moved")
    # Where the container came, went or changed its type, its fields say nothing of their own.
    held = below.select("feed_key", "rank", "group", "container").distinct()
    before = held.select("feed_key", (F.col("rank") + 1).alias("rank"), "group", F.col("container").alias("c_was"))
    renamed_now = renamed.select("feed_key", "rank", F.col("old_field").alias("c_was"), F.col("new_field").alias("container"), F.lit(True).alias("renamed_now"))
    retyped = top.filter("status = 'retyped'").select("feed_key", "rank", F.col("field").alias("container"))
    kept = held.join(before, ["feed_key", "rank", "group"]).join(renamed_now, ["feed_key", "rank", "c_was", "container"], "left").filter("container = c_was or renamed_now")
    kept = kept.join(retyped, ["feed_key", "rank", "container"], "left_anti").select("feed_key", "rank", "group", F.col("container").alias("c_now"), "c_was")
    inner = compare(below).join(kept, ["feed_key", "rank", "group"])
    inner = cut(inner.filter("(status = 'new' or old_container = c_was) and (status = 'gone' or container = c_now)"), "below")
    changes = report(top, renamed).unionByName(report(inner, rename(inner, "renamed_below")))
    return changes.select(F.col("this_file").alias("file_name"), "change_kind", "old_field", "new_field").distinct()


#: Target layout: path in the target -> (SQL type, names under which the value may stand).
TARGET = {
    "dialogue_id": ("string", ["dialogue_id"]),
    "metadata.tier": ("string", ["tier"]),
    "metadata.primary_task": ("string", ["primary_task"]),
    "metadata.downstream_application": ("string", ["downstream_application"]),
    "metadata.language": ("string", ["language", "lang"]),
    "metadata.complexity_score": ("bigint", ["complexity_score"]),
    "metadata.topics": ("array<string>", ["topics"]),
}
#: Names of the containers and of a message's fields; the first is the target's own.
CONTAINERS = {"metadata": ["metadata", "meta"], "messages": ["messages", "conversation", "turns"]}
MESSAGE = {"role": ("string", ["role"]), "content": ("string", ["content"]), "code_snippet": ("string", ["code_snippet"]), "reasoning_chain": ("string", ["reasoning_chain"]), "ground_truth_valid": ("boolean", ["ground_truth_valid"])}

INGESTED = (
    "dialogue_id string, metadata struct<tier:string,primary_task:string,downstream_application:string,language:string,complexity_score:bigint,topics:array<string>>, "
    "messages array<struct<role:string,content:string,code_snippet:string,reasoning_chain:string,ground_truth_valid:boolean>>, rescued string, parse_error boolean"
)


def cast_json(value: object, sql_type: str) -> tuple[object, bool]:
    """(value as the SQL type, whether it could be cast); only casts that lose nothing are made."""
    if value is None:
        return None, True
    if sql_type == "string":
        return (value, True) if isinstance(value, str) else (None, False)
    if sql_type == "bigint":
        if isinstance(value, int) and not isinstance(value, bool) and abs(value) < 1 << 63:
            return value, True
        if isinstance(value, str) and value.strip().lstrip("-").isdecimal() and len(value.strip()) < 19:
            return int(value), True
        return None, False
    if sql_type == "boolean":
        if isinstance(value, bool):
            return value, True
        if value in (0, 1) or isinstance(value, str) and value.strip().lower() in ("true", "false", "0", "1"):
            return str(value).strip().lower() in ("true", "1"), True
        return None, False
    if sql_type == "array<string>":
        return (value, True) if isinstance(value, list) and all(x is None or isinstance(x, str) for x in value) else (None, False)
    return None, False


def _take(source: dict, names: list[str], sql_type: str) -> object:
    """The first castable value under ``names``, taken out of ``source``; what can't be cast stays there."""
    for name in names:
        if name in source:
            value, ok = cast_json(source[name], sql_type)
            if ok:
                del source[name]
                return value
    return None


def _embedded(text: str) -> dict | list | None:
    """The object or array that a string holds as JSON."""
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict | list) else None


def conform(raw: str | None, aliases: dict[str, list[str]], layout: bool = False, typed: bool = True) -> tuple:
    """One line in the target schema; unknown and uncastable fields stay as JSON in ``rescued``, under their own paths.

    layout: whether the fields of the line as it came are described too, as ``layouts`` shows them; typed: whether ``rescued`` is
    written out.
    """
    record = parse_record(raw)
    if record is None:
        return None, None, None, raw, True, None
    came = layout_of(record) if layout else {}
    names = lambda target, own: own + [a for a in aliases.get(target, []) if a not in own]
    for target, own in CONTAINERS.items():  # a container may come as JSON within a string
        for name in names(target, own):
            if isinstance(record.get(name), str) and (inner := _embedded(record[name])) is not None:
                record[name] = inner
    out: dict[str, object] = {"dialogue_id": _take(record, ["dialogue_id"], "string")}
    metadata = None
    for name in names("metadata", CONTAINERS["metadata"]):
        if isinstance(record.get(name), dict):
            inner = record[name]
            metadata = {path.split(".")[1]: _take(inner, names(path, own), kind) for path, (kind, own) in TARGET.items() if path.startswith("metadata.")}
            if not inner:
                del record[name]
            break
    messages = None
    for name in names("messages", CONTAINERS["messages"]):
        if isinstance(record.get(name), list):
            messages, left = [], []
            for element in record[name]:
                if isinstance(element, dict):
                    messages.append({field: _take(element, names(f"messages[].{field}", own), kind) for field, (kind, own) in MESSAGE.items()})
                    left.append(element)
                else:
                    messages.append(None)
                    left.append(element)
            if any(x not in ({}, None) for x in left):
                record[name] = left
            else:
                del record[name]
            break
    described = _described(came, record) if layout else None
    return out["dialogue_id"], metadata, messages, json.dumps(record, ensure_ascii=False) if record and typed else None, False, described


def _described(came: dict[tuple[str, str], list], left: dict) -> dict[str, list]:
    """The layout of a record; what is in ``left`` was rescued."""
    rest = {}
    for container, elements in {"": left, **{k: left[k] for k in {c for c, _ in came if c} if k in left}}.items():
        elements = [elements] if isinstance(elements, dict) else elements if isinstance(elements, list) else []
        rest[container] = {field for x in elements if isinstance(x, dict) for field in x}
    order = sorted(came)
    types = [f"{came[k][0]}\x1f{came[k][1] or ''}\x1f{'rescued' if k[1] in rest.get(k[0], ()) else 'kept'}" for k in order]
    return {"paths": [f"{c}\x1f{f}" for c, f in order], "types": types, "places": [came[k][2] for k in order], "leaves": [came[k][3] for k in order]}


@functools.lru_cache(maxsize=4096)
def _names(aliases: str | None) -> dict[str, list[str]]:
    return json.loads(aliases) if aliases else {}


def _alias_column(aliases: dict[str, list[str]] | Column | None) -> Column:
    return aliases if isinstance(aliases, Column) else F.lit(json.dumps(aliases or {}))


def ingest(df: DataFrame, aliases: dict[str, list[str]] | Column | None = None) -> DataFrame:
    """Every line in one schema: the columns of ``df`` but raw, then the target columns, ``rescued`` and ``parse_error``.

    aliases: target path -> further approved names (for ``messages``, ``metadata.language``, ``messages[].content`` ...), or a
    column that holds them as JSON, where they differ by file. Columns of ``df`` that clash with a column of the result are
    dropped.
    """
    names = ["dialogue_id", "metadata", "messages", "rescued", "parse_error"]
    carried = [c for c in df.columns if c not in {*names, "raw"}]
    made = ",".join(f.strip().replace(" ", ":", 1) for f in re.split(r",\s(?=[a-z_]+ )", INGESTED))

    @F.pandas_udf(f"struct<{made}>")
    def conformed(raw: pd.Series, named: pd.Series) -> pd.DataFrame:
        rows = [conform(x, _names(n)) for x, n in zip(raw, named)]
        return pd.DataFrame({n: pd.Series([r[k] for r in rows], dtype=object) for k, n in enumerate(names)})

    return df.select(*carried, conformed("raw", _alias_column(aliases)).alias("_c")).select(*carried, "_c.*")


def promote(df: DataFrame, path: str, sql_type: str, name: str) -> DataFrame:
    """A rescued field as a typed column: ``path`` is read from ``rescued`` by name, cast, and null where it can't be."""
    return df.withColumn(name, F.get_json_object("rescued", f"$.{path}").try_cast(sql_type))


def read_wrapped(value: object, sql_type: str) -> tuple[object, bool]:
    """Approved readings of values that don't cast: a text alone in an object or list, text blocks in order, one text for a list."""
    if sql_type == "array<string>":
        return ([value], True) if isinstance(value, str) else (None, False)
    if sql_type == "string":
        if isinstance(value, list) and value and all(isinstance(x, dict) and isinstance(x.get("text"), str) for x in value):
            return "".join(x["text"] for x in value), True
        if isinstance(value, dict | list) and len(value) == 1:
            only = next(iter(value.values())) if isinstance(value, dict) else value[0]
            return (only, True) if isinstance(only, str) else (None, False)
        if isinstance(value, int | float) and not isinstance(value, bool):
            return json.dumps(value), True
    return None, False


def replay_record(metadata: dict | None, messages: list | None, rescued: str | None, aliases: dict[str, list[str]]) -> tuple:
    """Typed values that are null filled from ``rescued`` by the approved readings, and what then is left there."""
    record = parse_record(rescued)
    if record is None:
        return metadata, messages, rescued
    names = lambda target, own: own + [a for a in aliases.get(target, []) if a not in own]

    def fill(target: dict, source: dict, fields: dict[str, tuple[str, list[str]]]) -> None:
        for field, (kind, known) in fields.items():
            for name in known:
                if target.get(field) is None and name in source:
                    value, ok = read_wrapped(source[name], kind)
                    if ok:
                        target[field] = value
                        del source[name]

    inner = {path.split(".")[1]: (kind, names(path, own)) for path, (kind, own) in TARGET.items() if path.startswith("metadata.")}
    fields = {field: (kind, names(f"messages[].{field}", own)) for field, (kind, own) in MESSAGE.items()}
    for name in names("metadata", CONTAINERS["metadata"]):
        if metadata is not None and isinstance(record.get(name), dict):
            fill(metadata, record[name], inner)
            if not record[name]:
                del record[name]
    for name in names("messages", CONTAINERS["messages"]):
        left = record.get(name)
        if messages is not None and isinstance(left, list) and len(left) == len(messages):
            for target, source in zip(messages, left):
                if isinstance(target, dict) and isinstance(source, dict):
                    fill(target, source, fields)
            if all(x in ({}, None) for x in left):
                del record[name]
    return metadata, messages, json.dumps(record, ensure_ascii=False) if record else None


def replay(ingested: DataFrame, aliases: dict[str, list[str]] | Column | None = None) -> DataFrame:
    """Rescued values replayed into the typed columns; what no reading fits stays in ``rescued``. aliases: as for ``ingest``."""
    kinds = {f.name: f.dataType.simpleString() for f in ingested.schema.fields}

    @F.pandas_udf(f"struct<metadata:{kinds['metadata']},messages:{kinds['messages']},rescued:string>")
    def replayed(metadata: pd.Series, messages: pd.Series, rescued: pd.Series, names: pd.Series) -> pd.DataFrame:
        load = lambda x: None if x is None else json.loads(x)
        return pd.DataFrame([replay_record(load(m), load(ms), r, _names(n)) for m, ms, r, n in zip(metadata, messages, rescued, names)], columns=["metadata", "messages", "rescued"])

    filled = replayed(F.to_json("metadata"), F.to_json("messages"), F.when(~F.col("parse_error"), F.col("rescued")), _alias_column(aliases))
    out = ingested.withColumn("_r", F.when(F.col("rescued").isNotNull() & ~F.col("parse_error"), filled))
    return out.select(*[F.when(F.col("_r").isNotNull(), F.col(f"_r.{c}")).otherwise(F.col(c)).alias(c) if c in ("metadata", "messages", "rescued") else c for c in ingested.columns])


def aliases_of(changes: DataFrame) -> DataFrame:
    """``level, field, target``: further names of the target's fields as the reported renames show them, directly or through others.

    level: "" for the containers, object or array for the fields within them.
    """
    spark = changes.sparkSession
    place = lambda name: F.when(F.contains(name, F.lit("[].")), F.lit("array")).when(F.contains(name, F.lit(".")), F.lit("object")).otherwise(F.lit(""))
    node = lambda name, side: (place(F.col(name)).alias(f"{side}_level"), F.regexp_replace(name, r"^.*?(\[\])?\.", "").alias(f"{side}_field"))
    number = lambda level, field: F.xxhash64(level, field)
    pairs = changes.filter("change_kind = 'renamed'").select(*node("old_field", "a"), *node("new_field", "b")).distinct()
    pairs = cut(pairs.withColumns({"a": number("a_level", "a_field"), "b": number("b_level", "b_field")}), "names")
    group = components(pairs.select("a", "b"))
    named = pairs.select(F.col("a").alias("node"), F.col("a_level").alias("level"), F.col("a_field").alias("field")).union(pairs.select("b", "b_level", "b_field")).distinct().join(group, "node")
    known = [(path, "object", name) for path, (_, own) in TARGET.items() if "." in path for name in own]
    known += [(f"messages[].{f}", "array", name) for f, (_, own) in MESSAGE.items() for name in own] + [(c, "", name) for c, own in CONTAINERS.items() for name in own]
    own = F.broadcast(spark.createDataFrame(known, "target string, level string, field string"))  # as many rows as the target has names
    meant = named.join(own, ["level", "field"]).select("level", "component", "target").distinct()
    return named.join(meant, ["level", "component"]).join(own, ["level", "field", "target"], "left_anti").select("level", "field", "target").distinct()


def with_aliases(lines: DataFrame, aliases: DataFrame, inventory: DataFrame) -> DataFrame:
    """``lines`` with the column ``aliases``: as JSON, the names in ``aliases`` that the line's file uses, by target field."""
    used = inventory.filter("container is not null").select("feed_key", "file_name", F.col("kind").alias("level"), "field").distinct()
    named = used.join(aliases, ["level", "field"]).groupBy("feed_key", "file_name", "target").agg(F.sort_array(F.collect_set("field")).alias("names"))
    per_file = named.groupBy("feed_key", "file_name").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("target", "names")))).alias("aliases"))
    return lines.drop("aliases").withColumn("feed_key", F.coalesce("feed", F.lit(""))).join(per_file, ["feed_key", "file_name"], "left").drop("feed_key")

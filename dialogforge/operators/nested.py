"""Deeply nested dialogues as related flat tables with interval labels.

Every node of a record (the record itself, turns, messages, topics, constraints, scores, strengths, weaknesses)
gets its pre-order and post-order number from a depth-first walk. ``a`` is an ancestor of ``b`` in the same record
exactly if ``a.pre < b.pre`` and ``a.post > b.post``; the parent is the ancestor one level up.

The walk is one narrow expression per record: the nodes are laid out in depth-first order, so that ``pre`` is the place
in that order and ``post = pre + size - 1 - depth``. Nothing is shuffled, and a record is never split or collected.

Defined results: null records, arrays, maps and elements give no rows, but null elements count as positions; an empty
table gives empty tables; extra columns are ignored (the id column and the nested columns are taken by name).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: child type -> (depth, path pattern); the walk below visits them in this order.
CHILDREN = {
    "turn": (1, "turns[i]"),
    "message": (2, "turns[i].messages[j]"),
    "topic": (1, "metadata.topics[i]"),
    "constraint": (1, "final_ground_truth.constraints_to_check[i]"),
    "score": (1, "scores.KEY[i]"),
    "strength": (2, "scores.KEY[i].strengths[j]"),
    "weakness": (2, "scores.KEY[i].weaknesses[j]"),
}

#: The least a reader must fetch for labels: whether elements are null, not what they say.
LABEL_SCHEMA = (
    "record_id bigint, metadata struct<topics:array<string>>, turns array<struct<messages:array<struct<ground_truth_valid:boolean>>>>, "
    "final_ground_truth struct<constraints_to_check:array<string>>, scores map<string,array<struct<strengths:array<string>,weaknesses:array<string>>>>"
)

_NODE = "struct<kind:string,depth:int,size:int,i:int,j:int,key:string,path:string>"


def _size(array: Column) -> Column:
    """Number of non-null elements, 0 for a null array."""
    return F.coalesce(F.size(F.filter(array, lambda x: x.isNotNull())), F.lit(0))


def _node(kind: str, size: Column, i: Column, j: Column, key: Column, path: Column) -> Column:
    depth = CHILDREN[kind][0] if kind in CHILDREN else 0
    return F.struct(
        F.lit(kind).alias("kind"), F.lit(depth).alias("depth"), size.cast("int").alias("size"), i.cast("int").alias("i"), j.cast("int").alias("j"), key.cast("string").alias("key"), path.cast("string").alias("path")
    )


def _none() -> Column:
    return F.array().cast(f"array<{_NODE}>")


def _leaves(kind: str, array: Column, prefix: Column, i: Column | None, key: Column) -> Column:
    """Nodes of an array of scalars; ``i`` is the position of the parent, None directly below the record."""
    null = F.lit(None)

    def leaf(x: Column, k: Column) -> Column:
        at = (k, null) if i is None else (i, k)
        return F.when(x.isNotNull(), _node(kind, F.lit(1), *at, key, F.concat(prefix, F.lit("["), k.cast("string"), F.lit("]"))))

    return F.coalesce(F.filter(F.transform(array, leaf), lambda n: n.isNotNull()), _none())


def _turn(t: Column, i: Column) -> Column:
    path = F.concat(F.lit("turns["), i.cast("string"), F.lit("]"))
    null = F.lit(None)

    def message(m: Column, j: Column) -> Column:
        return F.when(m.isNotNull(), _node("message", F.lit(1), i, j, null, F.concat(path, F.lit(".messages["), j.cast("string"), F.lit("]"))))

    messages = F.coalesce(F.filter(F.transform(t["messages"], message), lambda n: n.isNotNull()), _none())
    own = _node("turn", F.size(messages) + 1, i, null, null, path)
    return F.when(t.isNotNull(), F.concat(F.array(own), messages)).otherwise(_none())


def _score(key: Column, s: Column, i: Column) -> Column:
    path = F.concat(F.lit("scores."), key, F.lit("["), i.cast("string"), F.lit("]"))
    below = F.concat(_leaves("strength", s["strengths"], F.concat(path, F.lit(".strengths")), i, key), _leaves("weakness", s["weaknesses"], F.concat(path, F.lit(".weaknesses")), i, key))
    own = _node("score", F.size(below) + 1, i, F.lit(None), key, path)
    return F.when(s.isNotNull(), F.concat(F.array(own), below)).otherwise(_none())


def _walk() -> Column:
    """All nodes of a record but itself in depth-first order."""
    null = F.lit(None)
    turns = F.coalesce(F.flatten(F.transform("turns", _turn)), _none())
    topics = _leaves("topic", F.col("metadata.topics"), F.lit("metadata.topics"), None, null)
    constraints = _leaves("constraint", F.col("final_ground_truth.constraints_to_check"), F.lit("final_ground_truth.constraints_to_check"), None, null)
    scores = F.coalesce(F.flatten(F.transform(F.map_entries("scores"), lambda e: F.coalesce(F.flatten(F.transform(e["value"], lambda s, i: _score(e["key"], s, i))), _none()))), _none())
    return F.concat(turns, topics, constraints, scores)


def label(df: DataFrame, id_column: str = "record_id") -> DataFrame:
    """One row per node: ``record_id, pre, post, depth, kind, i, j, key, path``; the record is node 0.
    """
    # The array always holds the record itself; the outer form keeps the optimiser from computing it twice for a filter.
    return _labelled(df, id_column).select(id_column, F.inline_outer("nodes"))


def _labelled(df: DataFrame, id_column: str, keep: list[str] | None = None) -> DataFrame:
    root = _node("record", F.size(F.col("below")) + 1, F.lit(None), F.lit(None), F.lit(None), F.lit(""))
    needed = df.select(id_column, "metadata", "turns", "final_ground_truth", "scores")
    nodes = F.transform(
        F.concat(F.array(root), F.col("below")),
        lambda n, pre: F.struct(
            pre.cast("int").alias("pre"),
            (pre + n["size"] - 1 - n["depth"]).cast("int").alias("post"),
            n["depth"].alias("depth"),
            n["kind"].alias("kind"),
            n["i"].alias("i"),
            n["j"].alias("j"),
            n["key"].alias("key"),
            n["path"].alias("path"),
        ),
    )
    return needed.withColumn("below", _walk()).select(id_column, *(keep or []), nodes.alias("nodes"))


def children(df: DataFrame, id_column: str = "record_id") -> DataFrame:
    """``record_id, child, child_path`` of every node below a record."""
    nodes = label(df, id_column)
    return nodes.filter(F.col("depth") > 0).select(id_column, F.col("kind").alias("child"), F.col("path").alias("child_path"))


def node_table(df: DataFrame, kind: str, id_column: str = "record_id") -> DataFrame:
    """The flat table of one node type: id, interval, position, and the node's own fields.

    The payload is fetched inside the record before the rows are made, so a row carries its own node only.
    """
    if kind == "record":
        return label(df, id_column).filter("kind = 'record'").select(id_column, "pre", "post")
    source = {"turn": "turns", "message": "turns", "topic": "metadata", "constraint": "final_ground_truth", "score": "scores", "strength": "scores", "weakness": "scores"}[kind]
    value = {
        "turn": lambda n: F.struct(F.element_at("turns", n["i"] + 1)["turn_id"].alias("turn_id")),
        "message": lambda n: F.element_at(F.element_at("turns", n["i"] + 1)["messages"], n["j"] + 1),
        "topic": lambda n: F.struct(F.element_at(F.col("metadata.topics"), n["i"] + 1).alias("topic")),
        "constraint": lambda n: F.struct(F.element_at(F.col("final_ground_truth.constraints_to_check"), n["i"] + 1).alias("constraint_text")),
        "score": lambda n: F.element_at(F.element_at("scores", n["key"]), n["i"] + 1).dropFields("strengths", "weaknesses"),
        "strength": lambda n: F.struct(F.element_at(F.element_at(F.element_at("scores", n["key"]), n["i"] + 1)["strengths"], n["j"] + 1).alias("strength")),
        "weakness": lambda n: F.struct(F.element_at(F.element_at(F.element_at("scores", n["key"]), n["i"] + 1)["weaknesses"], n["j"] + 1).alias("weakness")),
    }[kind]
    own = F.transform(F.filter("nodes", lambda n: n["kind"] == kind), lambda n: F.struct(n.alias("n"), value(n).alias("v")))
    rows = _labelled(df, id_column, [source]).select(id_column, F.explode(own).alias("x"))
    position = [F.col("x.n.i").alias("pos_1")] + ([F.col("x.n.j").alias("pos_2")] if CHILDREN[kind][0] == 2 else []) + ([F.col("x.n.key").alias("score_key")] if source == "scores" else [])
    return rows.select(id_column, F.col("x.n.pre").alias("pre"), F.col("x.n.post").alias("post"), F.col("x.n.depth").alias("depth"), *position, "x.v.*")


def link(parents: DataFrame, kids: DataFrame, id_column: str = "record_id") -> DataFrame:
    """Each row of ``kids`` with the ``pre`` of the row of ``parents`` whose interval contains it.

    Both are node tables with ``pre`` and ``post``; the parents' intervals must be disjoint (nodes of one type are).
    An equi-join on the record keeps the containment test within one record.
    """
    p = parents.select(F.col(id_column), F.col("pre").alias("parent_pre"), F.col("post").alias("_post"))
    inside = (F.col("parent_pre") < F.col("pre")) & (F.col("_post") > F.col("post"))
    return kids.join(p, id_column).filter(inside).drop("_post")

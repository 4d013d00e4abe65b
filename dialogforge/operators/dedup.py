"""Duplicates of a normalised key within a scope: exact groups, near-duplicates by sequence ratio, flags and removal.

Input rows: ``scope`` (what counts as one file), ``line`` (a number that names the row and orders it) and ``key``. Empty and
null keys are never duplicates. Of a group the least line is kept.
"""

from __future__ import annotations

import difflib
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogforge.operators.components import components
from dialogforge.operators.similarity import difflib_ratio
from dialogforge.session import cut

THRESHOLD = 0.97
#: Signature of a key for the candidate search: bands of rows over hashed word shingles.
BANDS, ROWS, SHINGLE = 16, 2, 3
#: Rows and characters of one side of a block in the exact search.
BLOCK_ROWS, BLOCK_CHARS = 2000, 8_000_000
_CHARS, _GRAMS = 97, 512  # counters of a text's characters (letters, digits and blanks have one each) and three-character runs


def exact_groups(rows: DataFrame) -> DataFrame:
    """``scope, line, first_line, copies`` of every row; a row without a key stands alone.

    Groups are counted by a map-side combined aggregation and joined back, so that a group of any size is never gathered.
    """
    key = F.coalesce("key", F.lit(""))
    # Keys may be long and dear to compute: they are read once and hashed.
    hashed = cut(rows.select("scope", "line", F.sha2(key, 256).alias("h"), (key == "").alias("empty")), "hashed")
    groups = hashed.filter("not empty").groupBy("scope", "h").agg(F.min("line").alias("first_line"), F.count("*").alias("copies")).filter("copies > 1")
    out = hashed.join(groups, ["scope", "h"], "left")
    alone = F.col("empty") | F.col("first_line").isNull()
    return out.select("scope", "line", F.when(alone, F.col("line")).otherwise(F.col("first_line")).alias("first_line"), F.when(alone, F.lit(1)).otherwise(F.col("copies")).alias("copies"))


def flags(groups: DataFrame) -> DataFrame:
    """With ``flag``: UNIQUE, ORIGINAL or DUPLICATE -> L<line kept>; ``copies`` says how many rows share the key."""
    flag = F.when(F.col("copies") == 1, F.lit("UNIQUE")).when(F.col("line") == F.col("first_line"), F.lit("ORIGINAL")).otherwise(F.concat(F.lit("DUPLICATE -> L"), F.col("first_line").cast("string")))
    return groups.withColumn("flag", flag)


def list_duplicates(flagged: DataFrame) -> DataFrame:
    """Flags in the long form, with the duplicates' lines in the original's flag: for reports on groups that fit in one row."""
    others = flagged.filter(F.col("line") != F.col("first_line")).groupBy("scope", "first_line").agg(F.array_join(F.transform(F.sort_array(F.collect_list("line")), lambda x: F.concat(F.lit("L"), x.cast("string"))), ", ").alias("_lines"))
    joined = flagged.join(others.withColumnRenamed("first_line", "line"), ["scope", "line"], "left")
    return joined.withColumn("flag", F.when(F.col("_lines").isNotNull(), F.concat(F.lit("ORIGINAL (dups: "), F.col("_lines"), F.lit(")"))).otherwise(F.col("flag"))).drop("_lines")


def remove_duplicates(rows: DataFrame, flag: str = "flag") -> DataFrame:
    """Rows whose flag does not begin with DUPLICATE; rows without a flag stay."""
    return rows.filter(~F.startswith(F.coalesce(flag, F.lit("")), F.lit("DUPLICATE")))


def totals(flagged: DataFrame) -> DataFrame:
    """Per scope: unique, originals, duplicates and distinct rows."""
    is_ = lambda word: F.count_if(F.startswith(F.col("flag"), F.lit(word)))
    return flagged.groupBy("scope").agg(is_("UNIQUE").alias("uniques"), is_("ORIGINAL").alias("originals"), is_("DUPLICATE").alias("duplicates"), (is_("UNIQUE") + is_("ORIGINAL")).alias("distinct_rows"))


def _candidates(keys: DataFrame) -> DataFrame:
    """Pairs ``scope, a, b`` of lines that share a band of their shingles' least hashes; copies have been collapsed before.

    Within a band each line meets the band's least line, found by a map-side combined aggregation. This only unites large groups
    at little cost; ``_rest`` finds every other link.
    """
    words = F.split("key", " +")
    grams = F.when(F.size("words") < SHINGLE, F.array("key")).otherwise(F.transform(F.sequence(F.lit(1), F.size("words") - SHINGLE + 1), lambda i: F.array_join(F.slice("words", i, F.lit(SHINGLE)), " ")))
    hashed = keys.withColumn("words", words).withColumn("grams", F.transform(grams, lambda g: F.xxhash64(g)))
    least = lambda k: F.array_min(F.transform("grams", lambda g: F.xxhash64(g, F.lit(k))))
    bands = F.array(*[F.xxhash64(F.lit(b), *[least(b * ROWS + r) for r in range(ROWS)]) for b in range(BANDS)])
    rows = hashed.select("scope", "line", "chars", F.explode(bands).alias("band"))
    least = rows.groupBy("scope", "band").agg(F.min("line").alias("a"))
    pairs = rows.join(least, ["scope", "band"]).select("scope", "a", F.col("line").alias("b")).filter("a <> b")
    return pairs.distinct()


def _counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each text's characters and of its three-character runs, in hashed counters."""
    chars, grams = np.zeros((len(texts), _CHARS), dtype=np.int32), np.zeros((len(texts), _GRAMS), dtype=np.int32)
    for k, t in enumerate(texts):
        c = np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32)
        chars[k] = np.bincount(c % _CHARS, minlength=_CHARS)
        g = (c[:-2] * np.uint32(961) + c[1:-1] * np.uint32(31) + c[2:]) * np.uint32(0x9E3779B1) >> np.uint32(23)
        grams[k] = np.bincount(g, minlength=_GRAMS)
    return chars[:, chars.any(axis=0)], grams


def _linking(threshold: float, autojunk: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The links of one block: rows of its two sides (the same rows, if there is one side only) in different components.

    No pair within the ratio is dropped: matched characters are at most the shorter text, and at most the characters in
    common; each character that isn't matched changes at most five places among the counts of three-character runs.
    Components that a link has joined are not compared again.
    """

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        # By length, so that the lengths that the ratio allows are neighbours.
        rows = rows.assign(chars=rows.key.str.len()).sort_values(["chars", "line"])
        keys, line, last, size, side = rows.key.tolist(), rows.line.tolist(), rows["last"].tolist(), rows.chars.to_numpy(), rows.side.to_numpy()
        component, (chars, grams) = rows.component.to_numpy(), _counts(keys)
        crossed = side.min() != side.max()
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        later: dict[int, list[int]] = {}  # candidates by the text that comes second, whose index difflib keeps
        for k in range(len(keys) - 1):
            size_k = size[k]
            end = len(keys) if threshold <= 0 else int(np.searchsorted(size, size_k * (2 - threshold) / threshold + 1, side="right"))
            other = np.arange(k + 1, end)
            other = other[(component[other] != component[k]) & (2.0 * size_k / (size_k + size[other]) >= threshold)]
            if crossed:
                other = other[side[other] != side[k]]
            other = other[2.0 * np.minimum(chars[other], chars[k]).sum(axis=1) / (size_k + size[other]) >= threshold]
            other = other[np.abs(grams[other] - grams[k]).sum(axis=1) <= 5 * (1 - threshold) * (size_k + size[other]) + 1e-6]
            for j in other.tolist():
                a, b = (k, j) if line[k] < line[j] else (j, k)
                later.setdefault(b, []).append(a)
                if line[b] < last[a]:  # a copy of the earlier text follows the later one
                    later.setdefault(a, []).append(b)
        links = []
        matcher = difflib.SequenceMatcher(autojunk=autojunk)
        for b, firsts in later.items():
            fresh = True
            for a in firsts:
                ra, rb = root(int(component[a])), root(int(component[b]))
                if ra == rb:
                    continue
                if fresh:
                    matcher.set_seq2(keys[b])
                    fresh = False
                matcher.set_seq1(keys[a])
                if matcher.ratio() >= threshold:
                    parent[max(ra, rb)] = min(ra, rb)
                    links.append((rows.scope.iat[0], min(line[a], line[b]), max(line[a], line[b])))
        return pd.DataFrame(links, columns=["scope", "a", "b"])

    return block


def _rest(nodes: DataFrame, threshold: float, autojunk: bool) -> DataFrame:
    """Links ``scope, a, b`` between the components of ``nodes`` (``scope, line, last, component, key, chars``): every pair
    of lengths that the ratio allows is looked at once, in blocks of bounded size.
    """
    if threshold >= 1:  # only equal texts, and they are one node
        return nodes.select("scope", F.col("line").alias("a"), F.col("line").alias("b")).limit(0)
    # Lengths within the ratio differ by one step at most.
    step = F.floor(F.log("chars") / math.log((2 - threshold) / threshold * (1 + 1e-9))) if threshold > 0 else F.lit(0)
    rows = nodes.select("scope", "line", "last", "component", "key", "chars", step.cast("int").alias("step"))
    parts = F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("chars") / BLOCK_CHARS)).cast("int")
    sizes = cut(rows.groupBy("scope", "step").agg(parts.alias("parts")), "sizes")
    near = lambda by, name: sizes.select("scope", (F.col("step") + by).alias("step"), F.col("parts").alias(name))
    around = sizes.join(near(1, "below"), ["scope", "step"], "left").join(near(-1, "above"), ["scope", "step"], "left")
    rows = rows.join(around, ["scope", "step"]).withColumn("part", F.pmod(F.xxhash64("line"), F.col("parts")).cast("int"))
    up_to = lambda n: F.filter(F.sequence(F.lit(0), F.coalesce(n, F.lit(0))), lambda x: x < F.coalesce(n, F.lit(0)))
    block = lambda low, i, high, j, side: F.struct(low.alias("low"), i.alias("i"), high.alias("high"), j.alias("j"), side.cast("int").alias("side"))
    own, s = F.col("part"), F.col("step")
    same = F.transform(up_to(F.col("parts")), lambda x: block(s, F.least(own, x), s, F.greatest(own, x), own > x))
    above = F.transform(up_to(F.col("above")), lambda x: block(s, own, s + 1, x, F.lit(0)))
    below = F.transform(up_to(F.col("below")), lambda x: block(s - 1, x, s, own, F.lit(1)))
    met = rows.withColumn("k", F.explode(F.concat(same, above, below))).select("scope", "line", "last", "component", "key", "k.*")
    types = {f.name: f.dataType.simpleString() for f in nodes.schema.fields}
    return met.groupBy("scope", "low", "i", "high", "j").applyInPandas(_linking(threshold, autojunk), f"scope {types['scope']}, a {types['line']}, b {types['line']}")


def near_groups(rows: DataFrame, threshold: float = THRESHOLD, autojunk: bool = True) -> DataFrame:
    """``scope, line, first_line, copies`` of groups joined by sequence ratios of at least ``threshold``.

    A pair is judged with the earlier line first, and the other way round too where copies lie on both sides. Rows with
    equal keys are one node. Banded word shingles unite large groups first; then every pair of nodes in different groups is
    compared, within bounds on lengths, characters and three-character runs that lose no link.
    """
    groups = cut(exact_groups(rows), "groups")
    ends = groups.groupBy("scope", "first_line").agg(F.max("line").alias("last")).withColumnRenamed("first_line", "line")
    # Lines are unique within a scope only: components run over a node number.
    kept = rows.select("scope", "line", "key").filter("key <> ''").withColumn("chars", F.length("key")).withColumn("node", F.xxhash64("scope", "line"))
    nodes = cut(kept.join(ends, ["scope", "line"]), "nodes")
    side = lambda x: nodes.select("scope", F.col("line").alias(x), F.col("key").alias(f"k{x}"), F.col("chars").alias(f"c{x}"), F.col("last").alias(f"l{x}"))
    lengths = F.lit(2.0) * F.least("ca", "cb") / (F.col("ca") + F.col("cb")) >= threshold
    pairs = _candidates(nodes).select("scope", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = cut(pairs.join(side("a"), ["scope", "a"]).join(side("b"), ["scope", "b"]).filter(lengths).select("scope", "a", "b", "ka", "kb", "la"), "both")
    turned = both.filter("b < la").select("scope", "a", "b", F.col("kb").alias("ka"), F.col("ka").alias("kb"), "la")
    links = both.unionByName(turned).filter(difflib_ratio(F.col("ka"), F.col("kb"), autojunk) >= threshold).select("scope", "a", "b")
    numbered = nodes.select("scope", "line", "node")
    numbers = lambda found: found.join(numbered.select("scope", F.col("line").alias("a"), F.col("node").alias("x")), ["scope", "a"]).join(numbered.select("scope", F.col("line").alias("b"), F.col("node").alias("y")), ["scope", "b"]).select(F.col("x").alias("a"), F.col("y").alias("b"))
    first = cut(numbers(links), "first")
    united = nodes.join(components(first), "node", "left").withColumn("component", F.coalesce("component", "node"))
    more = cut(numbers(_rest(united, threshold, autojunk)), "more")
    parts = cut(components(first.unionByName(more)), "parts")
    labelled = numbered.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = labelled.groupBy("component").agg(F.min("line").alias("group_line"))
    final = labelled.join(least, "component").select("scope", F.col("line").alias("first_line"), "group_line", "component")
    merged = groups.join(final, ["scope", "first_line"], "left").withColumn("group_line", F.coalesce("group_line", "line"))
    sizes = merged.filter("component is not null").groupBy("component").agg(F.count("*").alias("members"))
    return merged.join(sizes, "component", "left").select("scope", "line", F.col("group_line").alias("first_line"), F.coalesce("members", F.lit(1)).alias("copies"))

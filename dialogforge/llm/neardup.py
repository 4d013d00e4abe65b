"""Near-duplicate openings: SuperMinHash signatures, banding, verification and union-find grouping.

The words of a text are a multiset; each word with its occurrence number is one element, so that the overlap of two
texts "counted with repeats" is the size of a set intersection. SuperMinHash gives every element a permutation of the
signature's places and hands out the ranks level by level; a text is finished as soon as all places are filled by a
lower level than the next one (early stopping), so only a few levels are looked at. Bands are sets of places.

Scale: exact copies are collapsed first; band rows are (key, id, length) only; within a band every text is compared with
the band's pivot first, and only texts outside the pivot's group with the others, so a band full of near-copies costs a
linear number of comparisons; a large band is salted there, and no step orders or caps a band. Sketches of 128 bits drop
chance pairs before word sets are fetched.

Defined results: texts without a word and null ids are in no group; equal texts are in one group; repeated ids (a message
delivered twice) count once; an empty table gives no rows; columns other than those named are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialogforge.operators.components import components
from dialogforge.session import cut

WORD = re.compile(r"\w+")
PLACES = 256  # a power of two: permutations are keyed bijections of a byte
#: Bands of 8 places: at the least Jaccard similarity of a true pair (2/3) all 150 miss with probability 0.003, at 3/4 with 1e-6.
ROWS, BANDS = 8, 150
#: Of 128 sketch bits, at 2/3 about 107 agree (standard deviation 4); chance pairs stay near 77.
SKETCH_BITS, SKETCH_AGREE = 128, 90
SHARE = 0.8
USER_ROLES = ("user", "User", "human")
_CHUNK = 300_000  # words handled at once
_BAND_ROWS = 10_000  # rows of a band that one task holds against the texts outside the pivot's group
_ELEMENTS = "id bigint, n int, fp bigint, elements array<bigint>, signature binary, s0 bigint, s1 bigint"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _place(key: np.ndarray, level: int) -> np.ndarray:
    """The place that an element's permutation has at ``level``: a keyed bijection of 0..255."""
    k = [(key >> np.uint64(s)).astype(np.uint8) for s in (0, 8, 16, 24, 32, 40)]
    x = np.full(len(key), level, dtype=np.uint8)
    for a, b in ((k[0], k[1]), (k[2], k[3]), (k[4], k[5])):
        x = x * (a | np.uint8(1)) + b
        x ^= x >> np.uint8(4)
        x = x * np.uint8(0x9D)
        x ^= x >> np.uint8(3)
    return x


def superminhash(owner: np.ndarray, elements: np.ndarray, n: int) -> np.ndarray:
    """Signatures (n, PLACES) of ``n`` element sets given as sorted owners and 64-bit element hashes.

    The value of a place is the level in its high bits and the element's random rank in its low 22 bits; places of
    empty sets keep the largest value.
    """
    signature = np.full(n * PLACES, 0xFFFFFFFF, dtype=np.uint32)
    own, key = owner.astype(np.int64), elements
    for level in range(PLACES):
        if not len(own):
            break
        rank = (_mix(key + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(42)).astype(np.uint32)
        value = np.uint32(level << 22) | rank
        np.minimum.at(signature, own * PLACES + _place(key, level), value)
        open_ = (signature.reshape(n, PLACES) == 0xFFFFFFFF).any(axis=1)  # early stopping: the others are final
        keep = open_[own]
        own, key = own[keep], key[keep]
    return signature.reshape(n, PLACES)


def elements_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, element hash) of every word with its occurrence number, ordered by owner."""
    ids: dict[str, int] = {}
    owner, words = [], []
    for k, text in enumerate(texts):
        found = WORD.findall(text.lower())
        owner.append(np.full(len(found), k, dtype=np.int64))
        words.extend(ids.setdefault(w, len(ids)) for w in found)
    own = np.concatenate(owner) if owner else np.zeros(0, dtype=np.int64)
    word = np.array(words, dtype=np.int64)
    order = np.lexsort((word, own))
    own, word = own[order], word[order]
    first = np.ones(len(own), dtype=bool)
    first[1:] = (own[1:] != own[:-1]) | (word[1:] != word[:-1])
    start = np.maximum.accumulate(np.where(first, np.arange(len(own)), 0))
    occurrence = (np.arange(len(own)) - start).astype(np.uint64)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in ids), dtype=np.uint64, count=len(ids))
    return own, _mix(hashes[word] + occurrence * np.uint64(0xD6E8FEB86659FD93)) if len(own) else np.zeros(0, dtype=np.uint64)


def _chunks(sizes: list[int]) -> Iterator[slice]:
    begin, total = 0, 0
    for k, size in enumerate(sizes):
        if total + size > _CHUNK and k > begin:
            yield slice(begin, k)
            begin, total = k, 0
        total += size
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def _describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        ids, texts = batch.id.tolist(), batch.text.tolist()
        for part in _chunks([len(t) // 5 for t in texts]):
            own, elements = elements_of(texts[part])
            count = len(texts[part])
            signature = superminhash(own, elements, count)
            order = np.lexsort((elements, own))
            elements = elements[order].view(np.int64)
            ends = np.searchsorted(own, np.arange(count + 1))
            bits = np.packbits((signature[:, :SKETCH_BITS] >> np.uint32(3)) & np.uint32(1), axis=1).view(np.int64)
            rows = [
                (ids[part][k], int(b - a), xxhash.xxh64_intdigest(elements[a:b].tobytes()) - (1 << 63), elements[a:b], signature[k].astype(np.uint8).tobytes(), int(bits[k, 0]), int(bits[k, 1]))
                for k, (a, b) in enumerate(zip(ends[:-1], ends[1:]))
                if b > a
            ]
            yield pd.DataFrame(rows, columns=["id", "n", "fp", "elements", "signature", "s0", "s1"])


def describe(texts: DataFrame) -> DataFrame:
    """Length, fingerprint, elements, signature (low bytes) and sketch of each ``id, text``."""
    return texts.filter("id is not null and text is not null").select("id", "text").mapInPandas(_describe, _ELEMENTS)


_SETS = np.stack([np.random.default_rng(7_001 + b).choice(PLACES, ROWS, replace=False) for b in range(BANDS)])


def _band_keys(signatures: Column) -> Column:
    @F.pandas_udf("array<bigint>")
    def keys(column: pd.Series) -> pd.Series:
        if not len(column):
            return pd.Series([], dtype=object)
        out = []
        for begin in range(0, len(column), 2000):
            part = column.iloc[begin : begin + 2000]
            matrix = np.frombuffer(b"".join(part), dtype=np.uint8).reshape(len(part), PLACES)
            packed = np.ascontiguousarray(matrix[:, _SETS]).view(np.uint64).reshape(len(part), BANDS)
            out.extend(_mix(packed + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64))
        return pd.Series(out)

    return keys(signatures)


def _near(a: str, b: str) -> Column:
    """Whether the lengths allow the overlap at all."""
    return F.least(a, b) >= SHARE * F.greatest(a, b)


def verify(pairs: DataFrame, described: DataFrame) -> DataFrame:
    """The pairs ``a, b`` of ids whose overlap reaches the share of the longer text, as ``a, b, overlap``."""
    sketch = lambda side: described.select(F.col("id").alias(side), F.col("n").alias(f"{side}_n"), F.col("s0").alias(f"{side}0"), F.col("s1").alias(f"{side}1"))
    differing = F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))) + F.bit_count(F.col("a1").bitwiseXOR(F.col("b1")))
    likely = pairs.select("a", "b").join(sketch("a"), "a").join(sketch("b"), "b").filter(_near("a_n", "b_n") & (differing <= SKETCH_BITS - SKETCH_AGREE)).select("a", "b")
    likely = cut(likely, "likely")
    words = lambda side: described.select(F.col("id").alias(side), F.col("n").alias(f"{side}_n"), F.col("elements").alias(f"{side}_e"))
    both = likely.join(words("a"), "a").join(words("b"), "b")
    overlap = F.size(F.array_intersect("a_e", "b_e"))
    return both.select("a", "b", overlap.alias("overlap"), F.greatest("a_n", "b_n").alias("longer")).filter(F.col("overlap") * 5 >= F.col("longer") * 4).select("a", "b", "overlap")


def _grouped(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``id, rep, group`` of every text with a word, where rep is the least id of its exact copies, and the descriptions of the reps."""
    described = cut(describe(texts), "described")
    copies = cut(described.groupBy("fp", "n").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("copies")), "copies")
    members = described.select("id", "fp", "n").join(copies, ["fp", "n"]).select("id", "rep").distinct()
    reps = described.join(copies.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
    rows = cut(reps.dropDuplicates(["id"]).select("id", "n", F.explode(_band_keys(F.col("signature"))).alias("key")), "rows")
    # The pivot of a band comes from a map-side combined aggregation; a band of any size is split by the join.
    pivots = rows.groupBy("key").agg(F.min("id").alias("pivot"), F.count("*").alias("held")).filter("held > 1")
    bands = cut(rows.join(pivots, "key").select("key", "id", "n", "pivot", "held"), "bands")
    first = bands.filter(F.col("id") != F.col("pivot")).select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    linked = cut(verify(first, reps), "linked")
    parts = cut(components(linked), "parts")
    # Texts of a band outside the group of its pivot are compared with all of the band that isn't in their own group.
    label = parts.select(F.col("node").alias("id"), "component")
    labelled = bands.filter("held > 2").join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    of_pivot = parts.select(F.col("node").alias("pivot"), F.col("component").alias("pivot_component"))
    labelled = labelled.join(of_pivot, "pivot", "left").withColumn("pivot_component", F.coalesce("pivot_component", "pivot"))
    salts = F.ceil(F.col("held") / _BAND_ROWS).cast("int")
    minor = labelled.filter("component <> pivot_component").select("key", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.col("id").alias("x"), F.col("n").alias("x_n"), F.col("component").alias("x_c"), "pivot_component")
    others = labelled.filter("id <> pivot").select("key", F.pmod(F.xxhash64("id"), salts).cast("int").alias("salt"), F.col("id").alias("y"), F.col("n").alias("y_n"), F.col("component").alias("y_c"))
    met = minor.join(others, ["key", "salt"]).filter((F.col("x_c") != F.col("y_c")) & _near("x_n", "y_n"))
    second = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    more = cut(verify(second, reps), "more")
    edges = linked.unionByName(more)
    final = components(edges).select(F.col("node").alias("rep"), F.col("component").alias("group"))
    out = members.join(final, "rep", "left")
    return out.select("id", "rep", F.coalesce("group", "rep").alias("group")), reps.dropDuplicates(["id"])


def group(texts: DataFrame) -> DataFrame:
    """``id, group`` of every text (``id bigint, text string``) with a word; the group is its least id."""
    return _grouped(texts)[0].select("id", "group")


_SALTED = 500  # ids of a group that meet the whole group in one task
_BLOCK_ELEMENTS = 2_000_000  # words of the texts on one side of a block


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Number of common elements of every text on the left with every one on the right."""
    common = np.intersect1d(np.concatenate(left), np.concatenate(right))

    def by_code(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        owner, flat = np.repeat(np.arange(len(texts)), [len(t) for t in texts]), np.concatenate(texts)
        held = np.isin(flat, common)
        owner, code = owner[held], np.searchsorted(common, flat[held])
        order = np.argsort(code, kind="stable")
        return owner[order], code[order]

    sides = [(*by_code(texts), len(texts)) for texts in (left, right)]
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    for begin in range(0, len(common), 2048):
        held = []
        for owner, code, count in sides:
            part = slice(*np.searchsorted(code, [begin, begin + 2048]))
            table = np.zeros((count, 2048), dtype=np.float32)
            table[owner[part], code[part] - begin] = 1
            held.append(table)
        out += (held[0] @ held[1].T).astype(np.int64)
    return out


def _count_links(block: pd.DataFrame) -> pd.DataFrame:
    """``rep, links`` of the pairs in one block: of its two parts, or within the part that meets itself."""
    left, right = block[block.side == 0], block[block.side == 1]
    alone = block.i.iat[0] == block.j.iat[0]
    if alone:
        right = left
    elif left.empty or right.empty:  # nothing to meet
        return pd.DataFrame({"rep": block.rep, "links": 0})
    a, b = left.n.to_numpy(), right.n.to_numpy()
    similar = _overlaps(left.elements.tolist(), right.elements.tolist()) * 5 >= np.maximum.outer(a, b) * 4
    if alone:
        np.fill_diagonal(similar, False)
        return pd.DataFrame({"rep": left.rep, "links": similar.sum(axis=1)})
    return pd.DataFrame({"rep": np.concatenate([left.rep, right.rep]), "links": np.concatenate([similar.sum(axis=1), similar.sum(axis=0)])})


def group_links(texts: DataFrame) -> DataFrame:
    """``id, group, links`` as ``group`` has them; links: number of differing texts that are similar to this one.

    Every pair of a group's differing texts is verified, in blocks of bounded size; only counts leave a block.
    """
    grouped, reps = _grouped(texts)
    grouped = cut(grouped, "grouped")
    nodes = grouped.filter("id = rep").select("rep", "group").join(reps.select(F.col("id").alias("rep"), "n", "elements"), "rep")
    parts = F.ceil(F.greatest(F.count("*") / _SALTED, F.sum("n") / _BLOCK_ELEMENTS)).cast("int").alias("parts")
    sizes = nodes.groupBy("group").agg(F.count("*").alias("size"), parts).filter("size > 1")
    salted = nodes.join(sizes, "group").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    met = salted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    blocks = met.select("group", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), (F.col("part") > F.col("other")).cast("int").alias("side"), "rep", "n", "elements")
    counted = blocks.groupBy("group", "i", "j").applyInPandas(_count_links, "rep bigint, links bigint")
    degree = counted.groupBy("rep").agg(F.sum("links").alias("links"))
    return grouped.join(degree, "rep", "left").select("id", "group", F.coalesce("links", F.lit(0)).alias("links"))


def openings(messages: DataFrame) -> DataFrame:
    """``id, text`` of each dialogue's opening: the user message with the smallest turn_id (then msg_index, msg_id)."""
    last = F.lit(2**31 - 1)
    order = F.struct(F.coalesce("turn_id", last), F.coalesce("msg_index", last), "msg_id")
    text = F.concat_ws(" ", "content", "code_snippet")
    users = messages.filter(F.col("role").isin(*USER_ROLES) & F.col("dialogue_id").isNotNull() & F.col("msg_id").isNotNull())
    first = users.groupBy("dialogue_id").agg(F.min_by(F.struct(F.col("msg_id").alias("id"), text.alias("text")), order).alias("o"))
    return first.select("o.id", "o.text")


def pairs_within(grouped: DataFrame) -> DataFrame:
    """Every pair of ids within a group, as the result of problem 5 asks for; one side of a large group is split by a salt."""
    sizes = grouped.groupBy("group").agg(F.count("*").alias("size")).filter("size > 1")
    parts = F.ceil(F.col("size") / _SALTED).cast("int")
    members = grouped.select("group", "id").join(sizes, "group").withColumn("parts", parts)
    a = members.select("group", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.col("id").alias("msg_id_a"))
    b = members.select("group", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("id").alias("msg_id_b"))
    return a.join(b, ["group", "part"]).filter("msg_id_a < msg_id_b").select("msg_id_a", "msg_id_b")

"""Mixing sources to target weights by a low-discrepancy source schedule.

The mix is a sequence of slots of ``block`` tokens. Slot ``i`` belongs to the source in whose part of the cumulative
weights the golden-ratio point ``frac(i * phi)`` falls, so that every prefix of the mix has the target shares up to a
few slots. Within each source the documents are shuffled by a hash, repeated up to ``max_repeats`` times (each repeat in
another order) and cut into blocks of equal tokens by their running token count; the k-th slot of a source takes its
k-th block.

Scale: ranks and running counts are made in two steps (sums per chunk, then places within a chunk), so that no source,
however large, is ordered in one task. Only the totals per source (as many rows as ``targets``) reach the driver.

Defined results: documents with a null id or text or of a source without target are not used; documents without tokens
may be drawn and add nothing; repeated ids count as one document; without targets or documents the mix is empty; a
source that is exhausted leaves its later slots empty, which the report shows. Source names are compared without case and
surrounding blanks. Columns other than those named are ignored.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from dialogforge.operators.running import before
from dialogforge.session import cut

#: Public byte-level BPE ranks; the folder is described in its README.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Split pattern that belongs to these ranks (fixed value of the public tokenizer).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 1_024
_CHUNK = 65_536  # slots, or documents, that one chunk holds about
_POINTS = 1 << 31
_GOLDEN = 1_327_217_885  # the odd number nearest to 2**31 / phi


def token_count(text: Column, path: str = TOKENIZER) -> Column:
    """Number of tokens of a text; special tokens are read as ordinary text."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        sent = SparkFiles.get(os.path.basename(path))
        with open(sent if os.path.exists(sent) else path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        encoding = tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for texts in batches:
            yield pd.Series([len(encoding.encode_ordinary(t)) for t in texts], dtype="int64")

    return count(text)


def source_name(source: Column) -> Column:
    return F.lower(F.trim(source))


def sized(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``doc_id, source, tokens`` of the usable documents; the tokenizer's file is sent to the executors by Spark."""
    documents.sparkSession.sparkContext.addFile(path)
    usable = documents.filter("doc_id is not null and text is not null and source is not null")
    return usable.select("doc_id", source_name(F.col("source")).alias("source"), token_count(F.col("text"), path).alias("tokens"))


def _plan(sizes: DataFrame, targets: DataFrame, total_tokens: int | None) -> list[dict]:
    """Per source: share, allowed repeats, tokens at hand; as many rows as there are targets, whatever the documents."""
    wanted = targets.filter("source is not null and target_share > 0").select(source_name(F.col("source")).alias("source"), "target_share", F.coalesce("max_repeats", F.lit(1)).alias("max_repeats")).dropDuplicates(["source"])
    have = sizes.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"))
    rows = [r.asDict() for r in wanted.join(have, "source", "left").orderBy("source").collect()]
    whole = sum(r["target_share"] for r in rows) or 1.0
    for r in rows:
        r["share"], r["tokens"], r["documents"] = r["target_share"] / whole, r["tokens"] or 0, r["documents"] or 0
    if total_tokens is None:  # the largest mix in which every source reaches its share
        total_tokens = math.floor(min((r["tokens"] * r["max_repeats"] / r["share"] for r in rows), default=0))
    for r in rows:
        r["total"] = total_tokens
    return rows


def schedule(sizes: DataFrame, plan: list[dict], block: int) -> DataFrame:
    """``slot, source, rank``: the source of every slot and the slot's rank within it."""
    slots = plan[0]["total"] // block if plan else 0
    bounds, names = np.cumsum([r["share"] for r in plan]), np.array([r["source"] for r in plan], dtype=object)

    @F.pandas_udf("string")
    def drawn(point: pd.Series) -> pd.Series:
        return pd.Series(names[np.minimum(np.searchsorted(bounds, point, side="right"), len(names) - 1)], dtype=object)

    point = F.pmod(F.pmod(F.col("id"), F.lit(_POINTS)) * F.lit(_GOLDEN), F.lit(_POINTS)) / F.lit(float(_POINTS))
    rows = sizes.sparkSession.range(slots).select(F.col("id").alias("slot"), drawn(point).alias("source"), (F.col("id") / _CHUNK).cast("bigint").alias("chunk"))
    return before(rows, ["source"], ["chunk"], ["slot"], {"rank": F.lit(1)}).select("slot", "source", "rank")


def blocks(sizes: DataFrame, plan: list[dict], block: int, seed: int) -> DataFrame:
    """``source, rank, doc_id, repeat, tokens, start``: every drawn copy and the block it begins in."""
    spark = sizes.sparkSession
    need = [(r["source"], int(min(r["max_repeats"], math.ceil((r["share"] * r["total"] + 2 * block) / r["tokens"]))) if r["tokens"] else 0, max(1, r["documents"] // _CHUNK)) for r in plan]
    use = spark.createDataFrame(need, "source string, repeats int, chunks int")
    copies = sizes.join(F.broadcast(use), "source").filter("repeats > 0")  # as many rows as there are targets
    copies = copies.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.col("repeats"))))
    shuffled = copies.withColumn("h", F.xxhash64("doc_id", "repeat", F.lit(seed))).withColumn("chunk", F.shiftrightunsigned("h", 20) % F.col("chunks"))
    placed = before(shuffled, ["source"], ["repeat", "chunk"], ["h", "doc_id"], {"before": F.col("tokens")})
    return placed.select("source", (F.col("before") / block).cast("bigint").alias("rank"), "doc_id", "repeat", "tokens", F.col("before").alias("start"))


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, block: int = BLOCK, seed: int = 1, tokenizer: str = TOKENIZER) -> DataFrame:
    """``slot, place, source, doc_id, repeat, tokens``: the mix in order (slot, then place within its block).

    total_tokens: size of the mix; None for the largest in which every source can reach its share.
    """
    sizes = cut(sized(documents, tokenizer).dropDuplicates(["doc_id"]), "sizes")
    plan = _plan(sizes, targets, total_tokens)
    drawn = blocks(sizes, plan, block, seed).join(schedule(sizes, plan, block), ["source", "rank"])
    return drawn.select("slot", F.col("start").alias("place"), "source", "doc_id", "repeat", "tokens")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of ``targets``: the target and the reached share, tokens, drawn copies, documents and most repeats."""
    per_doc = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("times"), F.sum("tokens").alias("tokens"))
    per_source = per_doc.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum("times").alias("copies"), F.count("*").alias("documents"), F.max("times").alias("most_repeats"))
    wanted = targets.filter("source is not null").select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").dropDuplicates(["source"])
    total = F.sum("tokens").over(W.partitionBy())  # over one row per source
    out = wanted.join(per_source, "source", "left").fillna(0, ["tokens", "copies", "documents", "most_repeats"])
    return out.withColumn("share", F.coalesce(F.col("tokens") / F.nullif(total, F.lit(0)), F.lit(0.0)))

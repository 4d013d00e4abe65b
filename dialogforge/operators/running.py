"""Running sums over ordered groups of any size, in two steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def before(rows: DataFrame, keys: list[str], chunk: list[str], order: list[Column | str], amounts: dict[str, Column]) -> DataFrame:
    """``rows`` with, for each amount, its sum over the rows of the same keys that come earlier (0 for the first).

    ``chunk`` names columns that cut a group into consecutive parts, ordered by them; only one part of a group is ordered in
    one place, and sums per part give what lies before it. Keys may be null.
    """
    sums = rows.groupBy(*keys, *chunk).agg(*[F.sum(a).alias(f"_sum_{n}") for n, a in amounts.items()])
    parts = W.partitionBy(*keys).orderBy(*chunk).rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(c).alias(f"_at_{c}") for c in (*keys, *chunk)], *[F.coalesce(F.sum(f"_sum_{n}").over(parts), F.lit(0)).alias(f"_offset_{n}") for n in amounts])
    within = W.partitionBy(*keys, *chunk).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumns({f"_within_{n}": F.coalesce(F.sum(a).over(within), F.lit(0)) for n, a in amounts.items()})
    same = [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in (*keys, *chunk)]
    joined = placed.join(offsets, same)
    return joined.select(*rows.columns, *[(F.col(f"_offset_{n}") + F.col(f"_within_{n}")).alias(n) for n in amounts])

"""Top N items within every group, by descending score bands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.storage import materialize

#: Shares of all rows above the lower edge of each band but the last.
BAND_SHARES = (1 / 64, 1 / 8, 1 / 2)
#: A group is heavy if it has at least 1 / HEAVY_PARTS of the rows; there are at most HEAVY_PARTS such groups.
HEAVY_PARTS = 2000


def top_n(df: DataFrame, keys: list[str], score: str, tie: str, n: int, band_shares: tuple[float, ...] = BAND_SHARES) -> DataFrame:
    """The ``n`` rows of highest ``score`` in every group, ties going to the smaller ``tie``; columns keys, score, tie.

    The needed columns are written once, each task's rows in order of score, so that a band of falling score reads its
    own pages of every file only. Rows are taken band by band. In each band the groups that already have n rows are dropped: heavy
    ones by a broadcast anti-join before anything is sorted (at most HEAVY_PARTS groups), the others after the
    band was cut to n rows a group in every task. An exact ranking over what was kept decides at the end.

    NULL and NaN scores never qualify; rows with a NULL key belong to no group; 0.0 and -0.0 are tied; a NULL tie
    comes last; repeated rows count each on its own. An empty table gives no rows; other columns are ignored.
    """
    held = {c: f"__{i}" for i, c in enumerate([*keys, score, tie])}
    k, s, t = [held[c] for c in keys], held[score], held[tie]
    rows = df.select(*[F.col(f"`{c}`").alias(a) for c, a in held.items()]).dropna(subset=[*k, s]).filter(~F.isnan(F.col(s).cast("double")))
    order = (F.col(s) + F.lit(0)).desc(), F.col(t).asc_nulls_last()
    cut = lambda d: d.withColumn("__rn", F.row_number().over(Window.partitionBy(*k).orderBy(*order))).filter(F.col("__rn") <= n).drop("__rn")
    rows = materialize(rows.sortWithinPartitions(F.col(s).desc()), "scored")
    numeric = rows.withColumn(s, F.col(s).cast("double"))
    total = rows.count()
    edges = sorted(set(numeric.approxQuantile(s, [1 - x for x in band_shares], 0.002)), reverse=True) if total and band_shares else []
    heavy = materialize(rows.groupBy(*k).count().filter(F.col("count") >= -(-total // HEAVY_PARTS)).drop("count"), "heavy") if total > HEAVY_PARTS else None
    kept: list[DataFrame] = []
    upper = None
    for lower in [*edges, None]:
        band = rows
        if lower is not None:
            band = band.filter(F.col(s) >= lower)
        if upper is not None:
            band = band.filter(F.col(s) < upper)
        if kept:
            filled = reduce(DataFrame.unionAll, kept).groupBy(*k).count().filter(F.col("count") >= n).drop("count")
            if heavy is not None:
                band = band.join(F.broadcast(heavy.join(filled, k, "left_semi")), k, "left_anti")
            band = cut(band).join(filled, k, "left_anti")
        else:
            band = cut(band)
        kept.append(materialize(band, "band"))
        upper = lower
    return cut(reduce(DataFrame.unionAll, kept)).select(*[F.col(a).alias(c) for c, a in held.items()])

"""Exact quantiles of a whole column without bringing its values to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells that an interval is cut into in a round, and values that are taken one by one at the end.
CELLS, FEW = 1024, 4096


def exact_quantiles(df: DataFrame, column: str, shares: list[float], cells: int = CELLS, few: int = FEW) -> list[float | None]:
    """The interpolated quantiles of the values that are there; None for all if there are none.

    The interval that holds a wanted place is cut into ``cells`` of equal width; one aggregation gives each cell's count, least and greatest value, and the cell with the
    place is the next interval. It ends where a cell has one value only, however often, or ``few`` at most. Each round sends some thousand rows to the driver at most, whatever
    the table's size.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where("v is not null and not isnan(v)").persist()
    try:
        n, low, high = values.agg(F.count("*"), F.min("v"), F.max("v")).first()
        if not n:
            return [None] * len(shares)
        at = [(n - 1) * q for q in shares]
        wanted = sorted({int(p) for p in at} | {min(n - 1, int(p) + 1) for p in at})
        known: dict[int, float] = {}
        open_ = {(low, high, 0, n): wanted}  # values from and to, how many are below and inside: places
        while open_:
            narrowed: dict[tuple, list[int]] = {}
            small = {k: v for k, v in open_.items() if k[0] < k[1] and k[3] <= few}
            large = {k: v for k, v in open_.items() if k[0] < k[1] and k[3] > few}
            for (least, _, _, _), places in ((k, v) for k, v in open_.items() if k[0] == k[1]):
                known |= dict.fromkeys(places, least)
            for (least, most, below, _), places in small.items():
                own = sorted(r[0] for r in values.where(F.col("v").between(least, most)).collect())
                known |= {p: own[p - below] for p in places}
            if large:
                order = list(large)
                which = F.coalesce(*[F.when(F.col("v").between(k[0], k[1]), F.lit(i)) for i, k in enumerate(order)])
                cell = F.coalesce(*[F.when(F.col("v").between(k[0], k[1]), F.least(F.lit(cells - 1), F.floor((F.col("v") / 2 - k[0] / 2) / (k[1] / 2 - k[0] / 2) * cells))) for k in order])
                counted = values.select("v", which.alias("i"), cell.alias("c")).where("i is not null").groupBy("i", "c").agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most")).collect()
                for i, k in enumerate(order):
                    below = k[2]
                    for r in sorted((r for r in counted if r["i"] == i), key=lambda r: r["c"]):
                        inside = [p for p in large[k] if below <= p < below + r["n"]]
                        if inside:
                            narrowed.setdefault((r["least"], r["most"], below, r["n"]), []).extend(inside)
                        below += r["n"]
            open_ = narrowed
        return [known[int(p)] * (1 - (p - int(p))) + known[min(n - 1, int(p) + 1)] * (p - int(p)) if p > int(p) else known[int(p)] for p in at]
    finally:
        values.unpersist()

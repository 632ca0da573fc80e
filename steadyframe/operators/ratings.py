"""Expert ratings: means, agreement between raters, rank correlation, bootstrap intervals and a case-wise ridge."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from steadyframe.functions.checks import require
from steadyframe.operators.detection import running_sums, value_ranges

KEYS = ["case_id", "segment_id"]
SCORES = ["salas_total", "osa_cns_total"]
NOT_FEATURES = {"case_id", "segment_id", "frame_count", "duration_s"}


def mean_ratings(ratings: DataFrame, scores: list[str] = SCORES) -> DataFrame:
    require(ratings, {*KEYS, *scores}, "rating")
    return ratings.groupBy(*KEYS).agg(*[F.avg(s).alias(s) for s in scores])


def icc_2_1(ratings: DataFrame, score: str) -> DataFrame:
    """Two-way random effects, absolute agreement, one rater: one row (n, k, icc). Segments that lack a rater are left out.

    NULL below two segments or raters, or without variance.
    """
    require(ratings, {*KEYS, "rater_id", score}, "rating")
    cells = ratings.groupBy(*KEYS, "rater_id").agg(F.avg(score).alias("v")).where("v is not null")
    raters = cells.agg(F.countDistinct("rater_id").alias("k"))
    whole = cells.groupBy(*KEYS).agg(F.count("*").alias("c"), F.avg("v").alias("row")).crossJoin(F.broadcast(raters)).where("c = k")
    full = cells.join(whole, KEYS)
    columns = full.groupBy("rater_id").agg(F.avg("v").alias("col"))
    grand = full.agg(F.avg("v").alias("grand"))
    each = full.join(F.broadcast(columns), "rater_id").crossJoin(F.broadcast(grand))
    square = lambda c: F.sum(c * c)
    sums = each.agg(
        F.countDistinct(*KEYS).alias("n"), F.first("k").alias("k"),
        square(F.col("row") - F.col("grand")).alias("rows"), square(F.col("col") - F.col("grand")).alias("cols"),
        square(F.col("v") - F.col("row") - F.col("col") + F.col("grand")).alias("rest"),
    )
    n, k = F.col("n"), F.col("k")
    msr, msc, mse = F.try_divide(F.col("rows"), n - 1), F.try_divide(F.col("cols"), k - 1), F.try_divide(F.col("rest"), (n - 1) * (k - 1))
    return sums.select("n", "k", F.when((n >= 2) & (k >= 2), F.try_divide(msr - mse, msr + (k - 1) * mse + k * (msc - mse) / n)).alias("icc"))


def with_average_rank(rows: DataFrame, keys: list[str], c: str, name: str) -> DataFrame:
    """Add the rank from 1 within the group; equal values share the mean of their ranks.

    Values are counted first, so a value that many rows have is one row from then on; running counts go by ranges of distinct values, not by
    one window a group. The ranks come back by a join with one row a value, whose common values Spark deals over tasks.
    """
    values = rows.groupBy(*keys, c).agg(F.count("*").alias("__k"))
    whole = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    upper = running_sums(value_ranges(values, keys, c), keys, c, {"__s": "__k"}).join(whole, keys)
    ranks = upper.select(*keys, c, (F.col("__n") - F.col("__s") + (F.col("__k") + 1) / 2).alias(name))
    return rows.join(ranks, [*keys, c])


def pearson(x: str, y: str) -> Column:
    """Correlation from sums; NULL if either is constant."""
    n = F.count("*").cast("double")
    top = n * F.sum(F.col(x) * F.col(y)) - F.sum(x) * F.sum(y)
    left = n * F.sum(F.col(x) * F.col(x)) - F.sum(x) * F.sum(x)
    right = n * F.sum(F.col(y) * F.col(y)) - F.sum(y) * F.sum(y)
    return F.try_divide(top, F.sqrt(left * right))


def numeric_features(df: DataFrame) -> list[str]:
    """Columns that count as features: numbers and booleans other than keys and sizes."""
    return [f.name for f in df.schema.fields if f.name not in NOT_FEATURES and isinstance(f.dataType, (T.NumericType, T.BooleanType))]


def feature_score_rows(metrics: DataFrame, ratings: DataFrame, features: list[str] | None = None, scores: list[str] = SCORES) -> DataFrame:
    """Long rows (case_id, segment_id, feature, score, x, y) of segments with both, without missing values."""
    features = features or numeric_features(metrics)
    joined = metrics.join(mean_ratings(ratings, scores), KEYS)
    pairs = [F.struct(F.lit(f).alias("feature"), F.lit(s).alias("score"), F.col(f).cast("double").alias("x"), F.col(s).alias("y")) for f in features for s in scores]
    return joined.select(*KEYS, F.explode(F.array(*pairs)).alias("p")).select(*KEYS, "p.*").where("x is not null and y is not null")


def spearman(rows: DataFrame) -> DataFrame:
    """Per (feature, score): rho (NULL under three rows or if constant), two-sided p, n and independent_cases."""
    keys = ["feature", "score"]
    ranked = with_average_rank(with_average_rank(rows, keys, "x", "rx"), keys, "y", "ry")
    out = ranked.groupBy(*keys).agg(pearson("rx", "ry").alias("rho"), F.count("*").alias("n"), F.countDistinct("case_id").alias("independent_cases"))
    p = F.pandas_udf(_p_values, T.DoubleType())
    return out.withColumn("spearman_rho", F.when(F.col("n") >= 3, F.col("rho"))).drop("rho").withColumn("p_value", p("spearman_rho", "n"))


def _p_values(rho: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([None if r is None or r != r else student_p(r, int(m)) for r, m in zip(rho, n)], dtype=float)


def student_p(rho: float, n: int) -> float:
    """Two-sided p of a correlation by Student's t with n - 2 degrees of freedom."""
    if n <= 2 or abs(rho) >= 1:
        return 0.0 if n > 2 else 1.0
    df = n - 2
    return incomplete_beta(df / 2, 0.5, 1 - rho * rho)


def incomplete_beta(a: float, b: float, x: float, steps: int = 300) -> float:
    """The regularized incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x, steps)
    value = 1.0
    for m in range(steps, 0, -1):  # from the innermost fraction outwards
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m - 1) * (a + b + m - 1) * x / ((a + 2 * m - 2) * (a + 2 * m - 1))
        value = 1 + odd / (1 + even / value)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
    return front / (a * value)


def drawn_cases(rows: DataFrame, repetitions: int = 2000, seed: int = 42) -> DataFrame:
    """(feature, score, rep_id, case_id, times): how often each repetition draws a case of the pair (feature, score).

    A repetition draws as many cases as the pair has rows of, with replacement. Draw k is the number that the first 15 hexadecimal digits of the MD5 of
    ``seed|feature|score|rep_id|k`` make, modulo the number of cases, in the order of their ids: any task can make it, and no plan leaves the driver.
    """
    pair = ["feature", "score"]
    cases = rows.select(*pair, "case_id").distinct()
    numbered = cases.withColumn("at", F.row_number().over(Window.partitionBy(*pair).orderBy("case_id")) - 1)
    sizes = cases.groupBy(*pair).agg(F.count("*").alias("n"))
    reps = sizes.withColumn("rep_id", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1)))).repartition(*pair, "rep_id")
    draws = reps.withColumn("k", F.explode(F.expr("sequence(0, cast(n as int) - 1)")))
    text = F.concat_ws("|", F.lit(str(seed)), *pair, F.col("rep_id").cast("string"), F.col("k").cast("string"))
    at = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") % F.col("n")
    times = draws.select(*pair, "rep_id", at.cast("int").alias("at")).groupBy(*pair, "rep_id", "at").agg(F.count("*").alias("times"))
    return times.join(numbered, [*pair, "at"]).select(*pair, "rep_id", "case_id", "times")


def bootstrap_interval(rows: DataFrame, repetitions: int = 2000, seed: int = 42) -> DataFrame:
    """Per (feature, score): the 2.5 and 97.5 percentiles of rho over repetitions that draw the pair's cases, without constant ones.

    A row drawn t times is a weight t: its average rank is that of t equal rows, so that a row comes once for each repetition that draws it. NULL under three cases.
    """
    keys = ["feature", "score", "rep_id"]
    drawn = rows.join(drawn_cases(rows, repetitions, seed), ["feature", "score", "case_id"])
    for v, r in (("x", "rx"), ("y", "ry")):
        upto = F.sum("times").over(Window.partitionBy(*keys).orderBy(v))
        same = F.sum("times").over(Window.partitionBy(*keys, v))
        drawn = drawn.withColumn(r, upto - (same - 1) / 2)
    n = F.sum("times").cast("double")
    sums = {k: F.sum(F.col("times") * e) for k, e in {"x": F.col("rx"), "y": F.col("ry"), "xy": F.col("rx") * F.col("ry"), "xx": F.col("rx") * F.col("rx"), "yy": F.col("ry") * F.col("ry")}.items()}
    rho = F.try_divide(n * sums["xy"] - sums["x"] * sums["y"], F.sqrt((n * sums["xx"] - sums["x"] * sums["x"]) * (n * sums["yy"] - sums["y"] * sums["y"])))
    reps = drawn.groupBy(*keys).agg(rho.alias("rho")).where("rho is not null")
    ends = reps.groupBy("feature", "score").agg(F.percentile("rho", F.lit([0.025, 0.975])).alias("e"), F.count("*").alias("repetitions"))
    enough = rows.groupBy("feature", "score").agg(F.countDistinct("case_id").alias("cases"))
    few = F.col("cases") < 3
    return enough.join(ends, ["feature", "score"], "left").select(
        "feature", "score", F.when(~few, F.col("e")[0]).alias("ci95_low"), F.when(~few, F.col("e")[1]).alias("ci95_high"), F.coalesce("repetitions", F.lit(0)).alias("repetitions")
    )


def leave_one_case_out(data: DataFrame, features: list[str], target: str, alpha: float = 1.0) -> DataFrame:
    """Ridge predictions of each row by a fit on all other cases: ``data`` with ``predicted``.

    Only per-case sums (of products of features, at most features squared numbers) leave the rows; each case's fit takes
    the total less its own. Features are standardized by population deviations of the fit, constant ones count as 0.
    """
    rows = data.dropna(subset=[*features, target])
    cols = [F.lit(1.0), *[F.col(f).cast("double") for f in features], F.col(target).cast("double")]
    size = len(cols)
    moments = [F.sum(cols[i] * cols[j]).alias(f"m{i}_{j}") for i in range(size) for j in range(i, size)]
    sums = rows.groupBy("case_id").agg(*moments)
    names = [f"m{i}_{j}" for i in range(size) for j in range(i, size)]
    total = sums.agg(*[F.sum(n).alias(f"t_{n}") for n in names])
    rest = sums.crossJoin(F.broadcast(total)).select("case_id", F.array(*[F.col(f"t_{n}") - F.col(n) for n in names]).alias("m"))

    def fit(m: pd.Series) -> pd.Series:
        out = []
        for v in m:
            g = np.zeros((size, size))
            g[np.triu_indices(size)] = v
            g = g + np.triu(g, 1).T
            n = g[0, 0]
            if n <= 0:
                out.append(None)
                continue
            mean = g[0] / n
            cov = g / n - np.outer(mean, mean)
            sd = np.sqrt(np.maximum(np.diag(cov)[1:-1], 0))
            sd[sd < 1e-12] = 1.0
            z = cov[1:-1, 1:-1] / np.outer(sd, sd) * n
            beta = np.linalg.solve(z + alpha * np.eye(size - 2), cov[1:-1, -1] / sd * n) / sd
            out.append([float(mean[-1] - beta @ mean[1:-1]), *beta.tolist()])
        return pd.Series(out)

    fits = rest.withColumn("beta", F.pandas_udf(fit, T.ArrayType(T.DoubleType()))("m")).select("case_id", "beta")
    guess = reduce(lambda a, b: a + b, [F.col("beta")[k + 1] * F.col(f).cast("double") for k, f in enumerate(features)], F.col("beta")[0])
    return rows.join(fits, "case_id").withColumn("predicted", guess).drop("beta")


def prediction_scores(rows: DataFrame, target: str) -> DataFrame:
    """mae and r2 of ``predicted``, one row."""
    e = F.col(target) - F.col("predicted")
    n, s, q = F.count("*"), F.sum(target), F.sum(F.col(target) * F.col(target))
    return rows.agg(F.avg(F.abs(e)).alias("mae"), (1 - F.try_divide(F.sum(e * e), q - s * s / n)).alias("r2"))


def rating_template(spark) -> DataFrame:
    """The empty table that raters fill in; ``files.write_template`` writes its header."""
    return spark.createDataFrame([], "case_id string, osa_cns_total double, rater_id string, salas_total double, segment_id string")

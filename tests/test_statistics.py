"""Quantiles by narrowing, ranks with common values and bootstrap draws, against plain versions."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from steadyframe.functions.quantiles import exact_quantiles
from steadyframe.operators import ratings

SHARES = [0.0, 0.25, 0.33, 0.5, 0.67, 0.999, 1.0]


@pytest.mark.parametrize("kind", ["even", "tied", "steep", "one", "two"])
def test_quantiles_by_narrowing(spark, kind):
    rng = np.random.default_rng(4)
    values = {"even": rng.random(3000), "tied": np.where(rng.random(3000) < 0.6, 7.0, rng.integers(0, 20, 3000)), "steep": np.exp(rng.normal(0, 40, 2000)), "one": np.array([2.5]), "two": np.array([-1e308, 1e308])}[kind]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double").repartition(3)
    got = exact_quantiles(df, "v", SHARES, cells=7, few=5)
    want = [float(np.sort(values)[int((len(values) - 1) * q)]) * (1 - ((len(values) - 1) * q) % 1) + float(np.sort(values)[min(len(values) - 1, int((len(values) - 1) * q) + 1)]) * (((len(values) - 1) * q) % 1) for q in SHARES]
    assert got == pytest.approx(want, rel=1e-12, abs=0)
    assert got == exact_quantiles(df, "v", SHARES)


def test_quantiles_of_nothing(spark):
    assert exact_quantiles(spark.createDataFrame([(None,)], "v double"), "v", [0.5]) == [None]


def test_ranks_with_a_value_on_half_the_rows(spark):
    rng = random.Random(2)
    rows = [(g, 5.0 if rng.random() < 0.5 else float(rng.randint(0, 30)), k) for g in "ab" for k in range(400)]
    got = ratings.with_average_rank(spark.createDataFrame(rows, "g string, v double, k int"), ["g"], "v", "r").collect()
    assert len(got) == 800
    for r in got:
        lower, same = (sum(f(v, r.v) for g, v, _ in rows if g == r.g) for f in (float.__lt__, float.__eq__))
        assert r.r == lower + (same + 1) / 2


def test_draws_are_of_each_pairs_own_cases(spark):
    rows = [(f"C{k}", f"S{k}", f, "s", float(k), float(k * k)) for f, cases in (("whole", range(5)), ("thin", (1, 3))) for k in cases]
    df = spark.createDataFrame(rows, "case_id string, segment_id string, feature string, score string, x double, y double")
    got = {(r.feature, r.rep_id, r.case_id): r.times for r in ratings.drawn_cases(df, 30, 7).collect()}
    want = Counter()
    for f, cases in (("whole", [f"C{k}" for k in range(5)]), ("thin", ["C1", "C3"])):
        for rep in range(30):
            for k in range(len(cases)):
                want[f, rep, cases[int(hashlib.md5(f"7|{f}|s|{rep}|{k}".encode()).hexdigest()[:15], 16) % len(cases)]] += 1
    assert got == dict(want)
    out = {r.feature: r for r in ratings.bootstrap_interval(df, 30, 7).collect()}
    assert out["thin"].ci95_low is None and out["whole"].ci95_low == pytest.approx(1.0) and 0 < out["whole"].repetitions <= 30
    assert ratings.bootstrap_interval(df.where(F.lit(False)), 30, 7).collect() == []

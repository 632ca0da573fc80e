"""The twelve COCO statistics with any number of truths an image, crowds included, against a plain loop."""

import random

import pytest

from steadyframe.operators import detection

LEVELS = [round(0.5 + 0.05 * k, 2) for k in range(10)]
AREAS = {"all": (0, 1e10), "small": (0, 1024), "medium": (1024, 9216), "large": (9216, 1e10)}


def size(b):
    return (b[2] - b[0]) * (b[3] - b[1])


def overlap(d, g, crowd):
    both = max(0, min(d[2], g[2]) - max(d[0], g[0])) * max(0, min(d[3], g[3]) - max(d[1], g[1]))
    return both / (size(d) if crowd else size(d) + size(g) - both)


def loop(dets, truths):
    """Per image lists of (score, box) by rank and of (box, crowd)."""
    out = {}
    for name, (low, high) in AREAS.items():
        n = sum(not c and low <= size(g) <= high for gs in truths.values() for g, c in gs)
        aps, recalls = [], []
        for t in LEVELS:
            rows = []
            for image, ds in dets.items():
                gs, taken = truths.get(image, []), set()
                for rank, (score, d) in enumerate(ds[:100], 1):
                    free = [(not c and low <= size(g) <= high, overlap(d, g, c), k) for k, (g, c) in enumerate(gs) if (k not in taken or c) and overlap(d, g, c) >= t]
                    if free:
                        real, _, k = max(free)
                        taken.add(k)
                        if real:
                            rows.append((score, rank, True))
                    elif low <= size(d) <= high:
                        rows.append((score, rank, False))
            points = []
            for s in sorted({r[0] for r in rows}, reverse=True):
                seen = [hit for score, _, hit in rows if score >= s]
                points.append((sum(seen) / n if n else 0, sum(seen) / len(seen)))
            aps.append(sum(max((p for r, p in points if r + 1e-11 >= k / 100), default=0) for k in range(101)) / 101)
            recalls.append([sum(hit for _, rank, hit in rows if rank <= m) / n if n else 0 for m in (1, 10, 100)])
        mean = lambda xs: sum(xs) / len(xs) if n else -1
        out[f"map_{name}"] = mean(aps)
        out |= {f"{name}_{m}": mean([r[k] for r in recalls]) for k, m in enumerate((1, 10, 100))}
        if name == "all":
            out |= {"map_50": mean(aps[:1]), "map_75": mean(aps[5:6])}
    return [out["map_all"], out["map_50"], out["map_75"], out["map_small"], out["map_medium"], out["map_large"], *[out[f"all_{m}"] for m in (1, 10, 100)], *[out[f"{x}_100"] for x in ("small", "medium", "large")]]


@pytest.mark.parametrize("seed", [1, 2])
def test_several_truths_and_crowds_equal_a_loop(spark, seed):
    rng = random.Random(seed)
    truths, dets = {}, {}
    for image in range(25):
        gs = []
        for _ in range(rng.randint(0, 5)):
            x, y, w = rng.randrange(60), rng.randrange(60), rng.choice((20, 40, 70, 120))
            gs.append(([x, y, x + w, y + w], rng.random() < 0.25))
        if gs and rng.random() < 0.5:
            gs.append((gs[0][0], False))  # two truths in one place: equal overlaps
        truths[image] = gs
        ds = []
        for _ in range(rng.randint(0, 14)):
            near = rng.choice(gs)[0] if gs and rng.random() < 0.8 else [rng.randrange(90), rng.randrange(90), 140, 150]
            ds.append((rng.randint(1, 12) / 13, [v + rng.randint(-4, 4) for v in near]))
        dets[image] = sorted(ds, key=lambda d: -d[0])
    rows = [(i, k, s, *map(float, b)) for i, ds in dets.items() for k, (s, b) in enumerate(ds)]
    own = [(i, k, *map(float, b), c if rng.random() < 0.9 or c else None) for i, gs in truths.items() for k, (b, c) in enumerate(gs)]
    c = spark.createDataFrame(rows, "image int, k int, score double, x1 double, y1 double, x2 double, y2 double")
    g = spark.createDataFrame(own, "image int, truth_id int, x1 double, y1 double, x2 double, y2 double, crowd boolean")
    got = list(detection.mean_average_precision(c, ["image"], ["k"], g).first())
    assert got == pytest.approx(loop(dets, truths), abs=1e-9)


def test_no_detections_and_no_truths(spark):
    c = spark.createDataFrame([], "image int, k int, score double, x1 double, y1 double, x2 double, y2 double")
    g = spark.createDataFrame([(1, 0, 0.0, 0.0, 50.0, 50.0, False)], "image int, truth_id int, x1 double, y1 double, x2 double, y2 double, crowd boolean")
    assert list(detection.mean_average_precision(c, ["image"], ["k"], g).first()) == [0, 0, 0, -1, 0, -1, 0, 0, 0, -1, 0, -1]
    assert set(detection.mean_average_precision(c, ["image"], ["k"], g.where("crowd")).first()) == {-1}

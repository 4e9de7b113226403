import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from pagelens.llm import centroid_clusters as cc


def brute(rows, k=16, rounds=3, size=64, scale=64):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x * scale) for x in v)]
    points = [v for i, v in sorted((x for x in kept if x[0] is not None), key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[0], r[1]))[:k]]
    for r in range(rounds + 1):
        distances = [[sum((a - b) ** 2 for a, b in zip(v, p, strict=True)) for p in points] for _, v in kept]
        near = [min(range(len(points)), key=d.__getitem__) for d in distances]
        if r < rounds:
            for c in range(len(points)):
                own = [v for (_, v), n in zip(kept, near, strict=True) if n == c]
                if own:
                    points[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    top = 2**63 - 1
    d = [min(x[n], top) for x, n in zip(distances, near, strict=True)]
    per = [sum(x for x, n in zip(d, near, strict=True) if n == c) for c in range(len(points))]
    return [(i, n, x, min(per[n], top), min(sum(d), top), hashlib.sha256(",".join(map(str, points[n])).encode()).hexdigest()) for (i, _), n, x in zip(kept, near, d, strict=True)]


def sort(rows):
    return sorted(map(tuple, rows), key=str)


def frame_of(spark, rows, kind="double"):
    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(5)
    for c in ("ids", "cluster", "key", "rows", "a.b"):
        frame = frame.withColumn(c, F.lit("x"))
    return frame


def test_clusters_equal_brute_force(spark):
    rng = random.Random(2)
    centres = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(9)]
    rows = [(i, [x + rng.gauss(0, 0.4) for x in rng.choice(centres)]) for i in range(3000)]
    rows += [(i, [float(rng.randint(-1, 1)) / 64] * 64) for i in range(5000, 5400)]  # ties between centroids
    rows += [(None, rows[0][1]), (7, rows[8][1]), (7, rows[7][1]), (9001, None), (9002, []), (9003, [1.0] * 63), (9004, [math.nan] * 64), (9005, [math.inf] + [0.0] * 63), (9006, [None] + [0.0] * 63), (9007, [0.0] * 64)]
    frame = frame_of(spark, rows)
    assert sort(cc.cluster_vectors(frame).collect()) == sort(brute(rows))
    assert sort(cc.cluster_vectors(frame, 3, 5).collect()) == sort(brute(rows, 3, 5))
    _, _, rescanned = cc.clustered(cc.usable(frame))
    assert rescanned[0] == 3404 and rescanned[-1] < 3404  # standing gaps save comparisons


def test_numbers_of_any_size(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice((1.0, 1e6, 1e12, -3e37)) * rng.random() for _ in range(64)]) for i in range(60)] + [(99, [2.9e306] * 64), (100, [1e308] * 64), (101, [-2.5e306] * 64)]
    assert sort(cc.cluster_vectors(frame_of(spark, rows)).collect()) == sort(brute(rows))
    floats = [(i, [float(np.float32(rng.gauss(0, 3e4))) for _ in range(64)]) for i in range(300)]
    assert sort(cc.cluster_vectors(frame_of(spark, floats, "float")).collect()) == sort(brute(floats))


def test_few_vectors(spark):
    one = [(5, [0.1 * i for i in range(64)])]
    assert sort(cc.cluster_vectors(frame_of(spark, one)).collect()) == sort(brute(one))
    same = [(i, [1.0] * 64) for i in range(40)]
    assert sort(cc.cluster_vectors(frame_of(spark, same)).collect()) == sort(brute(same))
    assert cc.cluster_vectors(frame_of(spark, [])).count() == 0
    assert [tuple(r) for r in cc.cluster_vectors(frame_of(spark, [(None, [1.0] * 64)])).collect()] == [(None, None, None, None, None, None)]

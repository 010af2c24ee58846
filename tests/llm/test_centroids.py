import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pricelens.llm import centroids as ce
from pricelens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(vectors, k, rounds, seed=2, scale=256):
    """vectors: (id, integers); the result rows by plain distances."""
    order = sorted(vectors, key=lambda v: (hashlib.sha256(f"{seed}:{'' if v[0] is None else v[0]}".encode()).hexdigest(), v[1]))
    c = [list(v[1]) for v in order[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, y)), j) for j, y in enumerate(c))

    for _ in range(rounds):
        own = [[] for _ in c]
        for _, x in vectors:
            own[nearest(x)[1]].append(x)
        c = [[sum(col) // len(o) for col in zip(*o)] if o else was for o, was in zip(own, c)]
    placed = [(i, *nearest(x)) for i, x in vectors]
    sums = {}
    for _, d, j in placed:
        sums[j] = sums.get(j, 0) + d
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted(((i, j, d, sums[j], sum(sums.values()), sha[j]) for i, d, j in placed), key=repr)


def rows(df):
    return sorted(((r[0], r["cluster"], int(r["distance"]), int(r["cluster_inertia"]), int(r["inertia"]), r["centroid_sha256"])
                   for r in df.collect()), key=repr)


def test_query_equals_brute_force(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    vectors = [(r["vec_id"], [math.floor(256 * float(x)) for x in r["embedding"]]) for r in table]
    assert rows(QUERIES["op13_bisector_clusters"](spark, SF)) == brute(vectors, 40, 5)


@pytest.mark.parametrize("k", [1, 2, 3, 5, 8, 13])
def test_tournament_is_the_nearest_with_ties_to_the_smaller(k):
    rnd = np.random.default_rng(k)
    c = rnd.integers(-2, 3, (k, 3))
    c[-1] = c[0]  # equal centroids tie everywhere
    x = rnd.integers(-3, 4, (5000, 3)).astype(float)
    number, distance = ce.Bisectors(c.tolist()).nearest(x)
    plain = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert (number == plain.argmin(axis=1)).all() and list(distance) == plain.min(axis=1).astype(int).tolist()


def test_large_components_are_exact():
    rnd = random.Random(3)
    big = 2 ** 50
    c = [[rnd.randint(-big, big) for _ in range(4)] for _ in range(5)]
    x = [[v + rnd.randint(-1, 1) for v in rnd.choice(c)] for _ in range(50)]
    number, distance = ce.Bisectors(c).nearest(np.array(x, dtype=float))
    for row, n, d in zip(x, number, distance):
        assert (d, n) == min((sum((a - b) ** 2 for a, b in zip(row, y)), j) for j, y in enumerate(c))
    with pytest.raises(ValueError):
        ce.integer_rows(pa.array([[1e300, 0.0]]), 2, 256)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    table = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (1, [-0.5, 2.0]), (None, [0.25, 0.001]), (2, None), (3, []), (4, [1.0]), (5, [1.0, 2.0, 3.0]),
             (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [3.0, -0.001]), (10, [3.0, 0.0])]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>").select(
        "*", *(F.lit("clash").alias(c) for c in ("id", "v", "cluster", "n", "s", "h", "dim", "centroid", "distance", "inertia")))
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in table if i not in (2, 3, 4, 5, 6, 7, 8)]
    for k in (1, 3, 40):
        assert rows(ce.cluster(df, k=k, rounds=3, dims=2)) == brute(good, k, 3)
    assert ce.cluster(df.limit(0), dims=2).count() == 0
    assert ce.cluster(df.where("vec_id = 2"), dims=2).count() == 0


def test_hot_vector_and_empty_centroid(spark):
    """A third of the rows are one vector, given as the first centroids twice, so one centroid is empty."""
    df = spark.range(600).select(
        F.col("id").alias("vec_id"),
        F.when(F.col("id") % 3 == 0, F.array(F.lit(1.0), F.lit(1.0))).otherwise(F.array(F.sin("id"), F.cos("id"))).alias("embedding")).repartition(5)
    vectors = [(r["vec_id"], [math.floor(256 * x) for x in r["embedding"]]) for r in df.collect()]
    found = ce.cluster(df, k=20, rounds=4, dims=2)
    assert rows(found) == brute(vectors, 20, 4)
    assert found.select("cluster").distinct().count() < 20

"""K-means over integer vectors by bisector tournaments.

The points nearer to centroid b than to centroid a lie on one side of a hyperplane:
|x - a|^2 > |x - b|^2 exactly if 2 (b - a) . x > |b|^2 - |a|^2.  Normals and thresholds
of all pairs are computed once a round, from integers.  A vector's nearest centroid is
then the winner of a tournament: every test is one dot product and one comparison, and
k - 1 tests leave one.  Equality favours the smaller number, so the outcome does not
depend on the bracket.  Only the winner's distance is computed.

A round is one scan: tasks add up counts and component sums of their vectors, Spark
adds those, and the driver gets one row per centroid and component.  What is sent out
and collected is bounded by k and the number of components, not by the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelens.llm.common import written

#: larger integer components than this are an error; sums and squares stay within 38 digits
LARGEST = 2 ** 51
_EXACT = 2.0 ** 53
_BLOCK = 2048


def usable(vector: Column, dims: int) -> Column:
    """True for vectors of exactly ``dims`` components, none null or non-finite."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.coalesce((F.size(vector) == dims) & finite, F.lit(False))


def integer_rows(vectors: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors are usable, and their components as floor(scale * x): doubles that hold integers."""
    right = pc.fill_null(pc.equal(pc.list_value_length(vectors), dims), False).to_numpy(zero_copy_only=False).copy()
    flat = vectors.filter(pa.array(right)).flatten().cast(pa.float64())
    x = flat.fill_null(math.nan).to_numpy(zero_copy_only=False).reshape(-1, dims)
    finite = np.isfinite(x).all(axis=1)
    right[right] = finite
    x = np.floor(scale * x[finite])
    if x.size and np.abs(x).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST} after scaling")
    return right, x


class Bisectors:
    """Normals and thresholds of all pairs of centroids (rows of integers)."""

    def __init__(self, centroids: list[list[int]]):
        self.exact = [list(map(int, c)) for c in centroids]
        self.k, self.top = len(centroids), max((abs(v) for c in self.exact for v in c), default=0)
        self.made: dict[type, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def of(self, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """centroids, normals[a, b], thresholds[a, b] for a < b, as doubles or whole Python numbers."""
        if kind not in self.made:
            c = np.array(self.exact, dtype=kind)
            square = (c * c).sum(axis=1)
            self.made[kind] = c, 2 * (c[None, :, :] - c[:, None, :]), square[None, :] - square[:, None]
        return self.made[kind]

    def kind(self, x: np.ndarray) -> type:
        """Doubles where all sums are exact in them, else whole numbers of any size."""
        most = max(float(np.abs(x).max(initial=0)), float(self.top))
        return float if 4.0 * x.shape[1] * most * most < _EXACT else object

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid of every row, and the squared distance as whole numbers."""
        number, distance = np.empty(len(x), dtype=np.int64), np.empty(len(x), dtype=object)
        for at in range(0, len(x), _BLOCK):
            rows = x[at:at + _BLOCK]
            kind = self.kind(rows)
            if kind is object:
                rows = np.array([[int(v) for v in r] for r in rows], dtype=object).reshape(rows.shape)
            c, normals, thresholds = self.of(kind)
            winner = self._tournament(rows, normals, thresholds)
            apart = rows - c[winner]
            squares = (apart * apart).sum(axis=1)
            number[at:at + _BLOCK] = winner
            distance[at:at + _BLOCK] = [int(d) for d in squares]
        return number, distance

    def _tournament(self, rows: np.ndarray, normals: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
        m = len(rows)
        first = np.arange(0, self.k - 1, 2)
        # the first matches are the same for every row: one product for all
        side = rows @ normals[first, first + 1].T > thresholds[first, first + 1] if len(first) else np.empty((m, 0), dtype=bool)
        alive = [first[j] + side[:, j] for j in range(len(first))]
        if self.k % 2:
            alive.append(np.full(m, self.k - 1))
        # slots keep their order, so the left one always has the smaller number
        while len(alive) > 1:
            after = []
            for a, b in zip(alive[::2], alive[1::2]):
                n = normals[a, b]
                dot = np.einsum("ij,ij->i", rows, n) if rows.dtype != object else (rows * n).sum(axis=1)
                after.append(np.where((dot > thresholds[a, b]).astype(bool), b, a))
            if len(alive) % 2:
                after.append(alive[-1])
            alive = after
        return alive[0]


def first_centroids(vectors: DataFrame, k: int, seed: int, dims: int, scale: int, id_col: str, vector_col: str) -> list[list[int]]:
    """The usable vectors with the ``k`` smallest hashes of seed and id, in that order;
    a null id counts as an empty one, equal ids go by their components."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    rows = vectors.where(usable(F.col(vector_col), dims)).select(order.alias("h"), F.col(vector_col).alias("v"))
    chosen = rows.orderBy("h", "v").limit(k).collect()
    return [[math.floor(scale * float(x)) for x in r["v"]] for r in chosen]


def moved(vectors: DataFrame, centroids: list[list[int]], dims: int, scale: int, vector_col: str) -> list[list[int]]:
    """Every centroid that has vectors becomes their floored mean."""
    test = Bisectors(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = [0] * test.k, [[0] * dims for _ in range(test.k)]
        for b in batches:
            _, x = integer_rows(b.column(0), dims, scale)
            number, _ = test.nearest(x)
            for at in range(0, len(x), _BLOCK):  # a block's sums are below 2^51 times 2^11
                own, part = number[at:at + _BLOCK], x[at:at + _BLOCK].astype(np.int64)
                for c in np.unique(own):
                    mine = part[own == c]
                    count[c] += len(mine)
                    total[c] = [s + int(v) for s, v in zip(total[c], mine.sum(axis=0))]
        for c in range(test.k):
            if count[c]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c] * dims, pa.int32()), pa.array(range(dims), pa.int32()), pa.array([count[c]] * dims, pa.int64()),
                     pa.array([Decimal(s) for s in total[c]], pa.decimal128(38, 0))],
                    ["centroid", "dim", "n", "s"],
                )

    sums = vectors.select(F.col(vector_col).alias("v")).mapInArrow(run, "centroid int, dim int, n bigint, s decimal(38,0)")
    after = [list(c) for c in centroids]
    for r in sums.groupBy("centroid", "dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():
        after[r["centroid"]][r["dim"]] = int(r["s"]) // r["n"]
    return after


def assigned(vectors: DataFrame, centroids: list[list[int]], dims: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """id, cluster and distance (squared, decimal) of every usable vector."""
    test = Bisectors(centroids)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, x = integer_rows(b.column(1), dims, scale)
            number, distance = test.nearest(x)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).filter(pa.array(kept)), pa.array(number.astype("i4")),
                 pa.array([Decimal(d) for d in distance], pa.decimal128(38, 0))],
                ["id", "cluster", "distance"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, cluster int, distance decimal(38,0)")


def cluster(
    vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, dims: int = 64, scale: int = 256,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """One row per usable vector: id, cluster, distance (squared), cluster_inertia and
    inertia (distances summed over the cluster and over all; decimals), centroid (its
    final components) and centroid_sha256 (of those, joined by commas).

    Usable are vectors of exactly ``dims`` components, none null, NaN or infinite; the
    others have no row.  Components are floor(scale * x).  Centroids start as the ``k``
    vectors with the smallest hashes of seed and id; with fewer vectors there are fewer.
    Ties go to the smaller number; a centroid without vectors stays where it is.
    Repeated rows count each; columns besides the two named are ignored.  An empty
    table gives an empty result.  Integer components beyond 2^51 raise an error.
    """
    centroids = first_centroids(vectors, k, seed, dims, scale, id_col, vector_col)
    for _ in range(rounds if centroids else 0):
        centroids = moved(vectors, centroids, dims, scale, vector_col)
    usable_rows = vectors if centroids else vectors.limit(0)
    placed, _ = written(assigned(usable_rows, centroids, dims, scale, id_col, vector_col))
    finals = vectors.sparkSession.createDataFrame(
        [(c, x, ",".join(map(str, x))) for c, x in enumerate(centroids)], "cluster int, centroid array<bigint>, joined string")
    sums = placed.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    # one row a centroid: what is broadcast and what meets in the window is bounded by k
    about = sums.join(F.broadcast(finals), "cluster").withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy()))
    return placed.join(F.broadcast(about), "cluster").select(
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid",
        F.sha2("joined", 256).alias("centroid_sha256"))

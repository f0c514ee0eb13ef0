"""M4: exact k-nearest-neighbour vote on count vectors of any dimension.

Train rows collapse to distinct vectors with class counts; test rows to distinct
vectors (queries). Pivots cut the train vectors into cells (nearest pivot) and each
cell into rings by distance from its pivot. By the triangle inequality a vector of
a ring lies at least ``max(|q p| - hi, lo - |q p|)`` from a query ``q``, so a query

* first meets its home rings: the nearest by that bound which hold ``k`` rows
  together. The ``k``-th of these rows gives the query a radius of its own;
* then meets the other rings whose bound is within that radius, and of those only
  vectors whose distance from the pivot differs from the query's by no more.

Each task keeps the ``k`` best candidates of a query before the shuffle (window group
limit). The meeting of a ring with its queries is a grid: a ring of many vectors is
split by the vectors' hash, its queries by theirs, so a cell of the grid holds about
``GRID`` of each however dense the ring is. Pivots come from a sample of at most
``SAMPLE`` distinct vectors: they decide about the work, never about the result. Only
the pivots and the table of rings (``PIVOTS`` x ``RINGS`` rows) pass the driver.

Vote: neighbours in order of (squared distance, vector); a vector contributes
``min(rows, k - rows before it)`` rows, class 0 rows first; class 1 wins only
with strictly more votes (a tie goes to class 0).
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagframe.session import materialize

# Task functions travel by value: Python workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LABEL = "label_binary"
PIVOTS, RINGS, SAMPLE, GRID = 64, 16, 4096, 4096
#: Relative slack of distances, which are rounded square roots.
SLACK = 1e-9


def choose_pivots(vectors: DataFrame, cols: list[str], count: int = PIVOTS) -> np.ndarray:
    """Farthest-first pivots of the ``SAMPLE`` distinct vectors with the smallest hashes."""
    drawn = vectors.select(*cols).orderBy(F.xxhash64(*cols), *cols).limit(SAMPLE).toPandas()
    points = drawn.to_numpy(np.float64)
    if not len(points):
        return points
    chosen, away = [0], ((points - points[0]) ** 2).sum(1)
    while len(chosen) < count and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((points - points[chosen[-1]]) ** 2).sum(1))
    return points[chosen]


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances, a row a point and a column a pivot."""
    return np.sqrt(np.stack([((points - p) ** 2).sum(1) for p in pivots], axis=1))


def in_cells(vectors: DataFrame, cols: list[str], pivots: np.ndarray) -> DataFrame:
    """``vectors`` with the number of the nearest pivot (``cell``) and the distance from it (``away``)."""
    def nearest(batches):
        for pdf in batches:
            d = distances(pdf[cols].to_numpy(np.float64), pivots)
            cell = d.argmin(1)
            yield pdf.assign(cell=cell.astype(np.int32), away=d[np.arange(len(d)), cell])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema) + ", cell int, away double"
    return vectors.mapInPandas(nearest, kind)


def in_rings(cells: DataFrame, rings: int = RINGS) -> DataFrame:
    """``cells`` with ``ring``: the place of a vector's distance among approximate quantiles of its cell."""
    shares = [i / rings for i in range(1, rings)]
    bounds = cells.groupBy("cell").agg(F.percentile_approx("away", shares, 1000).alias("_bounds"))
    placed = cells.join(F.broadcast(bounds), "cell")  # one row a pivot
    return placed.withColumn("ring", F.col("cell") * rings + F.size(F.filter("_bounds", lambda b: b < F.col("away")))).drop("_bounds")


def ring_table(ringed: DataFrame) -> pd.DataFrame:
    """Per ring: its cell, smallest and largest distance, training rows and distinct vectors."""
    return (ringed.groupBy("ring").agg(F.first("cell").alias("cell"), F.min("away").alias("lo"), F.max("away").alias("hi"),
                                       F.sum(F.col("n0") + F.col("n1")).alias("n"), F.count(F.lit(1)).alias("vectors"))
            .orderBy("ring").toPandas())


def home_and_bounds(points: np.ndarray, pivots: np.ndarray, table: pd.DataFrame, k: int):
    """Distances from the pivot of every ring, lower bounds, and which rings are home (a row a query)."""
    away = distances(points, pivots)[:, table["cell"].to_numpy()]
    bound = np.maximum(np.maximum(away - table["hi"].to_numpy(), table["lo"].to_numpy() - away), 0)
    order = np.lexsort((away, bound), axis=1)
    n = table["n"].to_numpy(np.int64)[order]
    home = np.zeros(bound.shape, bool)
    np.put_along_axis(home, order, np.cumsum(n, axis=1) - n < k, axis=1)
    return away, bound, home


def probes(queries: DataFrame, cols: list[str], pivots: np.ndarray, table: pd.DataFrame, k: int, kth: bool) -> DataFrame:
    """``queries`` by ring to visit (``ring``, ``q_away``): the home rings, or with ``kth`` the others within that radius."""
    q_cols, numbers = [f"q_{c}" for c in cols], table["ring"].to_numpy(np.int32)

    def visits(batches):
        for pdf in batches:
            for first in range(0, len(pdf), 2048):
                part = pdf.iloc[first:first + 2048]
                away, bound, home = home_and_bounds(part[q_cols].to_numpy(np.float64), pivots, table, k)
                if kth:
                    radius = np.sqrt(part["kth"].to_numpy(np.float64))[:, None]
                    home = ~home & (bound <= radius + SLACK * (1 + away))
                row, col = np.nonzero(home)
                yield part.iloc[row].assign(ring=numbers[col], q_away=away[row, col])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema) + ", ring int, q_away double"
    return queries.mapInPandas(visits, kind)


def squared_distance(cols: list[str]) -> Column:
    return sum((F.col(c) - F.col(f"q_{c}")) * (F.col(c) - F.col(f"q_{c}")) for c in cols)


def meet(visits: DataFrame, ringed: DataFrame, cols: list[str], grid: int = GRID) -> DataFrame:
    """``(_q, vector, n0, n1, d2)`` of every visit with the vectors of its ring; with ``kth`` those within it."""
    sizes = ringed.groupBy("ring").agg(F.ceil(F.count(F.lit(1)) / grid).cast("int").alias("_vs"))
    asked = visits.groupBy("ring").agg(F.ceil(F.count(F.lit(1)) / grid).cast("int").alias("_qs"))
    splits = F.broadcast(sizes.join(asked, "ring"))  # at most PIVOTS x RINGS rows
    left = (visits.join(splits, "ring").withColumn("_qi", F.pmod(F.xxhash64("_q"), F.col("_qs")).cast("int"))
            .withColumn("_vi", F.explode(F.sequence(F.lit(0), F.col("_vs") - 1))).drop("_qs", "_vs"))
    right = (ringed.join(splits, "ring").withColumn("_vi", F.pmod(F.xxhash64(*cols), F.col("_vs")).cast("int"))
             .withColumn("_qi", F.explode(F.sequence(F.lit(0), F.col("_qs") - 1))).drop("_qs", "_vs", "cell"))
    pairs = left.join(right, ["ring", "_vi", "_qi"])
    d2 = squared_distance(cols)
    if "kth" in visits.columns:
        near = F.abs(F.col("q_away") - F.col("away")) <= F.sqrt(F.col("kth").cast("double")) + SLACK * (1 + F.col("q_away"))
        pairs = pairs.where(near).where(d2 <= F.col("kth"))
    return pairs.select("_q", *cols, "n0", "n1", d2.alias("d2"))


def best(candidates: DataFrame, cols: list[str], k: int) -> DataFrame:
    """The first ``k`` vectors of each query; every vector has a row at least, so they hold its first ``k`` rows."""
    w = Window.partitionBy("_q").orderBy("d2", *cols)
    return candidates.withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= k).drop("_at")


def knn_vector_votes(train: DataFrame, test: DataFrame, cols, k: int = 10, pivots: int = PIVOTS, grid: int = GRID) -> DataFrame:
    cols = list(cols)
    tv = materialize(train.groupBy(*cols).agg(
        F.sum((F.col(LABEL) == 0).cast("long")).alias("n0"),
        F.sum((F.col(LABEL) == 1).cast("long")).alias("n1")))
    points = choose_pivots(tv, cols, pivots)
    queries = materialize(test.select(*[F.col(c).alias(f"q_{c}") for c in cols]).distinct()
                          .withColumn("_q", F.monotonically_increasing_id()))
    if not len(points):  # no training vector: no votes
        none = queries.where(F.lit(False)).select(*[F.col(f"q_{c}").alias(c) for c in cols], F.lit(0).cast("long").alias("v0"))
        return none.select("*", F.col("v0").alias("v1"), F.lit(0).alias("prediction"))
    ringed = materialize(in_rings(in_cells(tv, cols, points)))
    table = ring_table(ringed)

    near_home = materialize(best(meet(probes(queries, cols, points, table, k, False), ringed, cols, grid), cols, k))
    order = Window.partitionBy("_q").orderBy("d2", *cols)
    size = F.col("n0") + F.col("n1")
    held = near_home.withColumn("_held", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # with fewer than k training rows every ring is home and no radius is needed
    radius = held.groupBy("_q").agg(F.min(F.when(F.col("_held") >= k, F.col("d2"))).alias("kth")).where("kth is not null")
    asking = materialize(queries.join(radius, "_q"))
    farther = meet(probes(asking, cols, points, table, k, True), ringed, cols, grid)

    ranked = best(near_home.unionByName(best(farther, cols, k)), cols, k)
    before = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = ranked.withColumn("_take", F.greatest(F.lit(0), F.least(size, F.lit(k) - before)))
    votes = taken.groupBy("_q").agg(F.sum(F.least(F.col("n0"), F.col("_take"))).alias("v0"),
                                    F.sum(F.col("_take") - F.least(F.col("n0"), F.col("_take"))).alias("v1"))
    return queries.join(votes, "_q").select(
        *[F.col(f"q_{c}").alias(c) for c in cols], "v0", "v1",
        F.when(F.col("v1") > F.col("v0"), F.lit(1)).otherwise(F.lit(0)).alias("prediction"))


def knn_predict(train: DataFrame, test: DataFrame, cols, k: int = 10, key: str = "doc_id") -> DataFrame:
    """Prediction per test row: its vector's vote (equal vectors share one vote).

    The test rows are read several times (distinct vectors, final join), so their
    features are checkpointed once instead of recomputed.
    """
    test = materialize(test.select(key, LABEL, *cols))
    votes = knn_vector_votes(train, test, cols, k)
    return test.select(key, LABEL, *cols).join(votes.select(*cols, "prediction"), list(cols)) \
               .select(key, LABEL, "prediction")

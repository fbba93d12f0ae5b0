"""Clusters of coordinates by weighted k-means, labelled from north to south."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def kmeans(points: DataFrame, k: int, x: str = "x", y: str = "y", weight: str | None = None, seed: int = 7) -> DataFrame:
    """``points`` with ``cluster`` 0..k-1 by falling centre y (ties by x)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=[x, y], outputCol="_f").transform(points)
    options = {"k": k, "seed": seed, "featuresCol": "_f", "predictionCol": "_c", **({"weightCol": weight} if weight else {})}
    model = KMeans(**options).fit(data)
    order = sorted(range(len(model.clusterCenters())), key=lambda i: (-model.clusterCenters()[i][1], model.clusterCenters()[i][0]))
    label = F.element_at(F.array(*[F.lit(order.index(i)) for i in range(len(order))]), F.col("_c") + 1)
    return model.transform(data).withColumn("cluster", label).drop("_f", "_c")


def kmeans_within(points: DataFrame, key: str, names: list, k: int, weight: str | None = None) -> DataFrame:
    """Separate clusters for each of a few areas, numbered through in the order of ``names``."""
    parts, offset = None, 0
    for name in names:
        own = kmeans(points.where(F.col(key) == name), k, weight=weight).withColumn("cluster", F.col("cluster") + offset)
        parts, offset = own if parts is None else parts.unionByName(own), offset + k
    return parts


def kmeans_by_dominant_area(units: DataFrame, area: str, names: list, k: int, size: float, weight: str = "mw") -> DataFrame:
    """``units`` (id, x, y, area, weight) with cell_x, cell_y, cell_area and cluster.

    Units fall into square cells; a cell belongs to the area with most weight in it (ties to the smaller), its
    weighted centre is clustered with the other cells of that area, and all its units take its cluster.
    """
    cell = lambda c: F.round(F.col(c) / size).cast("long")
    own = units.withColumn("cell_x", cell("x")).withColumn("cell_y", cell("y"))
    parts = own.groupBy("cell_x", "cell_y", area).agg(F.sum(weight).alias("_w"), F.sum(F.col(weight) * F.col("x")).alias("_x"), F.sum(F.col(weight) * F.col("y")).alias("_y"))
    cells = parts.groupBy("cell_x", "cell_y").agg(
        F.min_by(area, F.struct(-F.col("_w"), F.col(area))).alias("cell_area"), F.sum("_w").alias("_w"), (F.sum("_x") / F.sum("_w")).alias("x"), (F.sum("_y") / F.sum("_w")).alias("y"),
    ).where("_w > 0")
    grouped = kmeans_within(cells, "cell_area", names, k, "_w").select("cell_x", "cell_y", "cell_area", "cluster")
    return own.join(grouped, ["cell_x", "cell_y"])


def representatives(points: DataFrame, k: int, weight: str = "mw") -> DataFrame:
    """cluster, x, y, mw, n: weighted centres of clusters of the distinct coordinates."""
    merged = points.groupBy("x", "y").agg(F.sum(weight).alias("mw"), F.count(F.lit(1)).alias("n"))
    c = kmeans(merged, k, weight="mw")
    mean = lambda v: F.sum(F.col("mw") * F.col(v)) / F.sum("mw")
    return c.groupBy("cluster").agg(mean("x").alias("x"), mean("y").alias("y"), F.sum("mw").alias("mw"), F.sum("n").alias("n"))


def dominant(df: DataFrame, key: str, part: str, weight: str) -> DataFrame:
    """key, part with the largest weight sum (ties to the smaller part)."""
    g = df.groupBy(key, part).agg(F.sum(weight).alias("w"))
    return g.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("w"), part))).where("_r = 1").select(key, part, "w")

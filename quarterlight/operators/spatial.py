"""Nearest joins, weights, cells and geometry on longitude and latitude."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import settle

#: A point set of at most this many rows is joined whole; a larger one through grid cells.
SMALL = 400


def nearest(left: DataFrame, points: DataFrame, point: str, x: str = "x", y: str = "y", within: list[str] | None = None, count: int | None = None) -> DataFrame:
    """``left`` with the nearest of ``points`` (ties to the smaller id) and its distance, among equal ``within`` keys.

    ``left`` needs a unique ``id``. Points are a dimension (cluster centres); their number is
    checked before they are broadcast. A larger set is searched cell by cell.
    """
    keys = within or []
    n = points.count() if count is None else count
    if n > SMALL:
        return _nearest_by_cells(left, points, point, x, y, keys, n)
    small = F.broadcast(points.select(F.col(point).alias("_p"), F.col(x).alias("_px"), F.col(y).alias("_py"), *[F.col(k).alias(f"_{k}") for k in keys]))
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    d2 = (F.col(x) - F.col("_px")) * (F.col(x) - F.col("_px")) + (F.col(y) - F.col("_py")) * (F.col(y) - F.col("_py"))
    best = left.select("id", x, y, *keys).join(small, on).groupBy("id").agg(F.min(F.struct(d2.alias("d2"), F.col("_p").alias("p"))).alias("m"))
    return left.join(best.select("id", F.col("m.p").alias(point), F.sqrt("m.d2").alias("distance")), "id", "left")


def _nearest_by_cells(left: DataFrame, points: DataFrame, point: str, x: str, y: str, keys: list[str], n: int) -> DataFrame:
    """Candidates from the 3 x 3 cells around each row, cells growing until every row has a proven nearest.

    Rows without coordinates or without a point of their keys have none, and are left out of the search.
    """
    box = points.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    size = max(box[1] - box[0], box[3] - box[2], 1e-9) / max(1.0, n**0.5)
    todo, done = left.select("id", x, y, *keys).where(F.col(x).isNotNull() & F.col(y).isNotNull()), None
    if keys:
        todo = todo.join(points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys).distinct(), keys, "left_semi").select("id", x, y, *keys)
    known = points.select(F.col(point).alias("_p"), F.col(x).alias("_px"), F.col(y).alias("_py"), *[F.col(k).alias(f"_{k}") for k in keys])
    while True:
        cell = lambda c, s=size: F.floor(c / s).cast("long")
        around = todo.withColumn("_i", F.explode(F.sequence(cell(F.col(x)) - 1, cell(F.col(x)) + 1))).withColumn("_j", F.explode(F.sequence(cell(F.col(y)) - 1, cell(F.col(y)) + 1)))
        placed = known.withColumn("_ci", cell(F.col("_px"))).withColumn("_cj", cell(F.col("_py")))
        on = (F.col("_i") == F.col("_ci")) & (F.col("_j") == F.col("_cj"))
        for k in keys:
            on = on & (F.col(k) == F.col(f"_{k}"))
        d2 = (F.col(x) - F.col("_px")) * (F.col(x) - F.col("_px")) + (F.col(y) - F.col("_py")) * (F.col(y) - F.col("_py"))
        best = around.join(placed, on).groupBy("id").agg(F.min(F.struct(d2.alias("d2"), F.col("_p").alias("p"))).alias("m")).where(F.col("m.d2") <= size * size)
        found = best.select("id", F.col("m.p").alias(point), F.sqrt("m.d2").alias("distance"))
        found = settle(found)
        done = found if done is None else done.unionByName(found)
        todo = settle(todo.join(found, "id", "left_anti"))
        size *= 4
        if todo.isEmpty():
            return left.join(done, "id", "left")


def shares(df: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Weight sum, share of the total and row count by keys."""
    g = df.where(F.col(weight) > 0).groupBy(*keys).agg(F.sum(weight).alias("weight"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy(F.lit(1))))


def weighted(value: Column, weight: Column) -> Column:
    return F.sum(weight * value) / F.sum(F.when(value.isNotNull(), weight))


def cell_mean(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Weighted mean; the plain mean where no weight is positive; null without values."""
    ok = F.col(value).isNotNull() & (F.col(weight) > 0)
    total = F.sum(F.when(ok, F.col(weight)))
    return df.groupBy(*keys).agg(F.coalesce(F.sum(F.when(ok, F.col(weight) * F.col(value))) / total, F.avg(value)).alias(value))


def top_cells(df: DataFrame, keys: list[str], size: float, k: int, least: float, x: str = "x", y: str = "y", mw: str = "mw") -> DataFrame:
    """The ``k`` strongest grid cells per key, with weighted centroid; cells under ``least`` only if none reaches it."""
    cell = df.withColumn("cx", F.round(F.col(x) / size).cast("long")).withColumn("cy", F.round(F.col(y) / size).cast("long"))
    g = cell.groupBy(*keys, "cx", "cy").agg(F.sum(mw).alias("mw"), F.count(F.lit(1)).alias("n"), weighted(F.col(x), F.col(mw)).alias("x"), weighted(F.col(y), F.col(mw)).alias("y"))
    every = Window.partitionBy(*keys)
    strong = F.max((F.col("mw") >= least).cast("int")).over(every)
    g = g.withColumn("_any", strong).where((F.col("_any") == 0) | (F.col("mw") >= least)).drop("_any")
    rank = F.row_number().over(every.orderBy(F.desc("mw"), F.desc("n"), "cx", "cy"))
    return g.withColumn("rank", rank).where(F.col("rank") <= k)


def hhi(df: DataFrame, keys: list[str], part: str, weight: str) -> DataFrame:
    """Herfindahl index of the parts' weight shares."""
    g = df.groupBy(*keys, part).agg(F.sum(weight).alias("w"))
    share = F.col("w") / F.sum("w").over(Window.partitionBy(*keys))
    return g.withColumn("s", share).groupBy(*keys).agg(F.sum(F.col("s") * F.col("s")).alias("hhi"))


def segment_distance_km(lon: Column, lat: Column, line: list[tuple[float, float]]) -> Column:
    """Least distance to a polyline's segments, equirectangular, in km."""
    kx, ky = F.cos(F.radians(lat)) * 111.32, F.lit(110.574)
    best = None
    for (x1, y1), (x2, y2) in zip(line, line[1:], strict=False):
        ax, ay = (F.lit(x1) - lon) * kx, (F.lit(y1) - lat) * ky
        dx, dy = F.lit(x2 - x1) * kx, F.lit(y2 - y1) * ky
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / (dx * dx + dy * dy)))
        ex, ey = ax + t * dx, ay + t * dy
        d = F.sqrt(ex * ex + ey * ey)
        best = d if best is None else F.least(best, d)
    return best


def inside_polygon(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Ray casting against a closed ring."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if y1 == y2:
            continue
        spans = (F.lit(min(y1, y2)) <= y) & (y < F.lit(max(y1, y2)))
        at = F.lit(x1) + (y - F.lit(y1)) * F.lit((x2 - x1) / (y2 - y1))
        crossings = crossings + F.when(spans & (x < at), 1).otherwise(0)
    return crossings % 2 == 1


def edges_of(rings: DataFrame, polygon: str = "polygon", ring: str = "ring") -> DataFrame:
    """polygon, x1, y1, x2, y2 of closed rings (arrays of structs x, y); level edges never cross a ray and go."""
    n = F.size(ring)
    pair = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(F.col(ring), i).alias("a"), F.get(F.col(ring), F.pmod(i + 1, n)).alias("b")))
    e = rings.where(n > 0).select(polygon, F.explode(pair).alias("e"))
    return e.select(polygon, F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))


def points_in_polygons(points: DataFrame, rings: DataFrame, size: float, point: str = "id", polygon: str = "polygon", x: str = "x", y: str = "y") -> DataFrame:
    """point, polygon: every pair of a point and a polygon around it, by ray casting.

    ``rings`` has one row a polygon: its id and ``ring``, an array of structs x, y, closed by its last edge. Rings and points meet by
    grid cells of ``size``. A cell that no edge of a polygon passes is wholly inside or outside of it, which its
    middle decides; in other cells a point is tested against the polygon's edges of its row of cells.
    All joins are equi-joins; a point meets no polygon that is not in its cell. Points and
    corners without coordinates are in no polygon.
    """
    cell = lambda c: F.floor(c / size).cast("long")
    sound = rings.where(F.forall("ring", lambda p: p["x"].isNotNull() & p["y"].isNotNull()))
    edges = edges_of(sound, polygon)
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    # An edge in each row of cells it reaches, with the cells between its ends there (a hair wider, so rounding hides none).
    rows = edges.withColumn("_j", F.explode(F.sequence(cell(low - 1e-9), cell(high + 1e-9))))
    at = lambda v: F.when(F.col("y1") == F.col("y2"), F.col("x1")).otherwise(F.col("x1") + (F.greatest(low, F.least(high, v)) - F.col("y1")) * ((F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))))
    one, two = at(F.col("_j") * size), F.when(F.col("y1") == F.col("y2"), F.col("x2")).otherwise(at((F.col("_j") + 1) * size))
    passed = rows.withColumn("_i", F.explode(F.sequence(cell(F.least(one, two) - 1e-9), cell(F.greatest(one, two) + 1e-9)))).select(polygon, "_i", "_j").distinct()
    passed = settle(passed)
    slanted = settle(rows.where("y1 <> y2").select(polygon, "_j", "x1", "y1", "x2", "y2"))

    def crossings(candidates: DataFrame, keys: list[str]) -> DataFrame:
        """Candidates (keys, polygon, _j, x, y) whose ray to the right crosses an odd number of the polygon's edges."""
        spans = (F.least("y1", "y2") <= F.col(y)) & (F.col(y) < F.greatest("y1", "y2"))
        hit = spans & (F.col(x) < F.col("x1") + (F.col(y) - F.col("y1")) * ((F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))))
        counted = candidates.join(slanted, [polygon, "_j"]).groupBy(*keys, polygon).agg(F.sum(hit.cast("int")).alias("_n"))
        return counted.where(F.col("_n") % 2 == 1).select(*keys, polygon)

    # Cells between the outermost edges of a row that no edge passes: inside if their middle is.
    spans = passed.groupBy(polygon, "_j").agg(F.min("_i").alias("_a"), F.max("_i").alias("_z"))
    between = spans.withColumn("_i", F.explode(F.sequence("_a", "_z"))).select(polygon, "_i", "_j").join(passed, [polygon, "_i", "_j"], "left_anti")
    middle = between.withColumn(x, (F.col("_i") + 0.5) * size).withColumn(y, (F.col("_j") + 0.5) * size)
    whole = crossings(middle, ["_i", "_j"])
    own = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(point, x, y, cell(F.col(x)).alias("_i"), cell(F.col(y)).alias("_j"))
    tested = crossings(own.join(passed, ["_i", "_j"]), [point])
    return own.join(whole, ["_i", "_j"]).select(point, polygon).unionByName(tested)


def lines_distance_km(points: DataFrame, segments: DataFrame, reach: float, point: str = "id", x: str = "x", y: str = "y") -> DataFrame:
    """point, line, km: each point's distance to every line of ``segments`` (line, x1, y1, x2, y2) that comes within ``reach`` degrees in both directions.

    Segments lie in all grid cells around their box that ``reach`` makes matter, so points meet only near ones, by an equi-join.
    """
    cell = lambda c: F.floor(c / F.lit(reach)).cast("long")
    around = lambda a, b, name: F.explode(F.sequence(cell(F.least(a, b)) - 1, cell(F.greatest(a, b)) + 1)).alias(name)
    placed = segments.select("*", around("x1", "x2", "_i")).select("*", around("y1", "y2", "_j"))
    own = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(point, x, y, cell(F.col(x)).alias("_i"), cell(F.col(y)).alias("_j"))
    kx, ky = F.cos(F.radians(F.col(y))) * 111.32, F.lit(110.574)
    ax, ay = (F.col("x1") - F.col(x)) * kx, (F.col("y1") - F.col(y)) * ky
    dx, dy = (F.col("x2") - F.col("x1")) * kx, (F.col("y2") - F.col("y1")) * ky
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(-(ax * dx + ay * dy), dx * dx + dy * dy), F.lit(0.0))))
    ex, ey = ax + t * dx, ay + t * dy
    near = (F.abs(ex) <= reach * kx) & (F.abs(ey) <= reach * ky)
    return own.join(placed, ["_i", "_j"]).where(near).groupBy(point, "line").agg(F.min(F.sqrt(ex * ex + ey * ey)).alias("km"))

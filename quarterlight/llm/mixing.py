"""Mixing sources to target weights by entropy balancing.

Rates r_i of a source's documents minimise the relative entropy to a uniform start
under one constraint, the source's token target; the entropy is that of the bounded
rates r_i and L - r_i, L being the copy limit. (A document count in the same proportion
is no second constraint: the uniform rate would meet both, and nothing would be tilted.)
The optimum is an exponential tilt of the odds, r_i / (L - r_i) proportional to
exp(b * z_i) with z_i the size over the source's mean size; Newton steps on the strictly
convex dual, bracketed, give b for every source at once. Each step is one aggregate over
the histogram (source, size, documents), which is built once, with partial sums
before its shuffle, so a hot source costs no more than its number of sizes.

Rates become whole copies by systematic rounding: documents of a source stand in
order of size, their fractional parts are accumulated, and a document gets one more
copy where the running sum, plus a phase, passes an integer. Each source takes the
phase, of 64, that comes nearest to its token target; they are tried on the histogram.
Equal rows (id, source and text) are one row with a count until they come out again in portions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, n_words, packed_rows, unpacked_rows

WEIGHTS = (3, 1, 2)
#: Newton stops at this relative residual of every source. Bracketed steps get there in far fewer than STEPS; one that does not is an error.
TOLERANCE, STEPS = 1e-9, 100
#: Documents of one (source, size) cell are numbered in so many separate parts, by hash.
PARTS = 4096
#: Equal rows and copies come out of their count in portions of so many.
PORTION = 4096
PHASES = 64


def targets(sizes: DataFrame, share: float = 1.5, limit: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, docs, words, target: from a table (source, docs, words) with one row per source.

    Sources by code point, null last, take ``weights`` in turn. A target stops at ``limit``
    times the source's words and the excess goes to the others by weight until none is
    above: the water level t solves sum(min(limit * words, w * t)) = share * all words.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before, after = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    turn = F.array(*[F.lit(float(w)) for w in weights])
    w = sizes.withColumn("w", F.get(turn, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))))
    w = w.withColumn("cap", F.col("words") * F.lit(limit)).withColumn("full_at", F.col("cap") / F.col("w"))
    total = F.sum("words").over(Window.partitionBy(F.lit(1))) * F.lit(share)
    # The level if exactly the sources before this one (by the level that fills them) are full.
    w = w.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    # The first source that its own level does not fill sets the level of all; if every one fills, all are full.
    unfilled = F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", F.col("source").isNull().alias("last"), "source", "level"))
    w = w.withColumn("t", F.min(unfilled).over(Window.partitionBy(F.lit(1)))["level"])
    return w.select("source", "docs", "words", F.when(F.col("t").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("w") * F.col("t"))).alias("target"))


def _rate(a: Column, b: Column, z: Column, limit: float) -> Column:
    return F.lit(limit) / (1 + F.lit(limit - 1.0) * F.exp(-F.greatest(F.least(a + b * z, F.lit(60.0)), F.lit(-60.0))))


def exact(value: Column) -> Column:
    """A sum of decimals, which does not depend on the order in which rows come: reruns get the same rates to the last bit."""
    return F.sum(value.cast("decimal(38,12)")).cast("double")


def balance(hist: DataFrame, goals: DataFrame, limit: float = 2.0) -> DataFrame:
    """goals with the dual variable b by bracketed Newton steps over ``hist`` (source, size, docs).

    ``a`` is 0, and 60 where the target is at the limit: the optimum is at infinity, every rate is the limit.
    """
    mean = F.col("words") / F.col("docs")
    duals = goals.where("words > 0").withColumn("mean", mean).withColumn("ratio", F.col("target") / F.col("words"))
    duals = duals.withColumn("a", F.when(F.col("ratio") >= limit * (1 - 1e-12), F.lit(60.0)).otherwise(F.lit(0.0))).withColumn("b", F.lit(0.0))
    unknown = F.lit(None).cast("double")
    duals = materialize(duals.withColumn("low", unknown).withColumn("high", unknown))
    for _ in range(STEPS):
        z = F.col("size") / F.col("mean")
        r = _rate(F.col("a"), F.col("b"), z, limit)
        free = r * (1 - r / F.lit(limit))  # the rate's derivative by its exponent
        sums = (
            hist.join(duals.select(F.col("source").alias("_s"), "mean", "a", "b"), F.col("source").eqNullSafe(F.col("_s")))
            .groupBy("source")
            .agg(exact(F.col("m") * z * r).alias("g"), exact(F.col("m") * z * z * free).alias("h"))
            .withColumnRenamed("source", "_s")
        )
        moved = duals.join(sums, duals["source"].eqNullSafe(F.col("_s"))).drop("_s")
        moved = moved.withColumn("e", F.when(F.col("a") > 0, F.lit(0.0)).otherwise(F.col("ratio") * F.col("docs") - F.col("g")))
        # The tokens taken grow with b: the sign of the residual tells on which side of the optimum b is.
        moved = moved.withColumn("low", F.when(F.col("e") > 0, F.col("b")).otherwise(F.col("low")))
        moved = moved.withColumn("high", F.when(F.col("e") < 0, F.col("b")).otherwise(F.col("high")))
        most = 8 + F.abs("b")
        to = F.col("b") + F.greatest(-most, F.least(most, F.col("e") / F.greatest(F.col("h"), F.lit(1e-300))))
        inside = (F.col("low").isNull() | (to > F.col("low"))) & (F.col("high").isNull() | (to < F.col("high")))
        to = F.when(F.col("e") == 0, F.col("b")).when(inside | F.col("low").isNull() | F.col("high").isNull(), to).otherwise((F.col("low") + F.col("high")) / 2)
        moved = moved.withColumn("off", F.abs("e") / F.greatest(F.col("docs") * F.col("ratio"), F.lit(1e-300)))
        moved = materialize(moved.withColumn("b", to))
        worst = moved.agg(F.max("off")).first()[0]
        duals = moved.select(*duals.columns)
        if worst is None or worst <= TOLERANCE:
            return duals.drop("low", "high")
    raise RuntimeError(f"the dual has a relative residual of {worst} after {STEPS} steps")


def _digest(text: Column) -> Column:
    """SHA-256 of the text, null for a null text: tells texts of one id apart."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _portions(df: DataFrame, count: Column) -> DataFrame:
    """``df`` with _from and _many: each row's count cut into portions, so that no array holds all of a large one."""
    cut = df.where(count > 0).withColumn("_count", count)
    cut = cut.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_count") - 1, F.lit(PORTION).cast("long"))))
    return cut.withColumn("_many", F.least(F.lit(PORTION).cast("long"), F.col("_count") - F.col("_from"))).drop("_count")


def _upto(k: Column) -> Column:
    """Documents with one more copy among a cell's first ``k``."""
    return F.floor(F.col("start") + k * F.col("part_rate") + F.col("phase"))


def mixed_classes(df: DataFrame, share: float, limit: int, weights: tuple[int, ...], id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc_id, source, digest, size, m (rows equal in these), before (rows of the cell that stand before them) and the cell's plan: source_size, target, whole, part_rate, start, phase.

    Equal rows are counted before anything is numbered, so a repeated row is one row here however often it occurs.
    """
    own = df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), _digest(F.col(text_col)).alias("digest"))
    own = own.groupBy("source", "size", "doc_id", "digest").agg(F.count(F.lit(1)).alias("m"))
    own = materialize(own.withColumn("part", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(PARTS))))
    cells = own.groupBy("source", "size", "part").agg(F.sum("m").alias("n"))
    hist = materialize(own.groupBy("source", "size").agg(F.sum("m").alias("m")))
    goals = materialize(targets(hist.groupBy("source").agg(F.sum("m").alias("docs"), F.sum(F.col("m") * F.col("size")).alias("words")), share, limit, weights))
    duals = balance(hist, goals, limit)
    rates = (
        goals.select(F.col("source").alias("_g"), "words", "target")
        .join(duals.select(F.col("source").alias("_d"), "mean", "a", "b"), F.col("_g").eqNullSafe(F.col("_d")), "left")
        .drop("_d")
    )
    rate = F.coalesce(_rate(F.col("a"), F.col("b"), F.col("size") / F.col("mean"), limit), F.lit(0.0))
    by_size = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    sizes = hist.join(rates, F.col("source").eqNullSafe(F.col("_g"))).drop("_g").withColumn("rate", rate)
    sizes = sizes.withColumn("whole", F.floor("rate")).withColumn("part_rate", F.col("rate") - F.col("whole"))
    sizes = sizes.withColumn("start", F.coalesce(F.sum(F.col("m") * F.col("part_rate")).over(by_size), F.lit(0.0)))
    sizes = materialize(sizes)
    tried = sizes.withColumn("phase", F.explode(F.sequence(F.lit(0), F.lit(PHASES - 1)))).withColumn("phase", F.col("phase") / F.lit(float(PHASES)))
    extra = _upto(F.col("m")) - _upto(F.lit(0))
    tried = tried.groupBy("source", "phase").agg(F.first("target").alias("target"), F.sum(F.col("size") * (F.col("m") * F.col("whole") + extra)).alias("taken"))
    best = tried.groupBy("source").agg(F.min_by("phase", F.struct(F.abs(F.col("taken") - F.col("target")), "phase")).alias("phase")).withColumnRenamed("source", "_b")
    sizes = sizes.join(best, F.col("source").eqNullSafe(F.col("_b"))).drop("_b")
    in_cell = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.withColumn("skip", F.coalesce(F.sum("n").over(in_cell), F.lit(0))).select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("part").alias("_p"), "skip")
    plan = (
        starts.join(sizes.drop("mean", "a", "b", "m"), F.col("_s").eqNullSafe(F.col("source")) & (F.col("_z") == F.col("size")))
        .select("_s", "_z", "_p", "skip", F.col("words").alias("source_size"), "target", "whole", "part_rate", "start", "phase")
    )
    earlier = Window.partitionBy("source", "size", "part").orderBy(F.xxhash64("doc_id", "digest"), "doc_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    placed = own.withColumn("k", F.coalesce(F.sum("m").over(earlier), F.lit(0)))
    placed = placed.join(plan, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")) & (F.col("part") == F.col("_p"))).drop("_s", "_z", "_p")
    return placed.withColumn("before", F.col("skip") + F.col("k")).drop("skip", "k", "part")


def mix(df: DataFrame, share: float = 1.5, limit: int = 2, weights: tuple[int, ...] = WEIGHTS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, digest (of the text), size, source_size, target, copies, taken for every row of ``df``.

    A null text has size 0 and takes nothing; null sources are one source, last in order.
    Equal rows are separate documents. A source without words has target 0. An empty
    table gives no rows. Other columns are not read. The result depends on the rows
    alone, so reruns agree; between equal rows the copies are interchangeable.
    """
    classes = mixed_classes(df, share, limit, weights, id_col, text_col, source_col)
    # Portions of a much repeated row go to different tasks before they become rows.
    rows = _portions(classes, F.col("m")).repartition("doc_id", "digest", "_from")
    rows = rows.withColumn("_i", F.explode(F.sequence(F.col("_from") + 1, F.col("_from") + F.col("_many"))))
    j = F.col("before") + F.col("_i")
    copies = F.least(F.col("whole") + _upto(j) - _upto(j - 1), F.lit(limit)).cast("long")
    return rows.withColumn("copies", copies).select(
        "doc_id", "source", "digest", "size", F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"),
        "copies", (F.col("copies") * F.col("size")).alias("taken"),
    )


def repeat_rows(df: DataFrame, share: float = 1.5, limit: int = 2, weights: tuple[int, ...] = WEIGHTS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``df`` as often as the mix takes them, with their own columns, whatever these are called.

    The copies that rows with one id, source and text get together are dealt evenly over those
    rows, which are counted, not gathered: rows equal in all columns are one with a count, and
    the others stand in order of a hash of all columns. Null ids are ids like any other; an empty table gives no rows.
    """
    taken = mixed_classes(df, share, limit, weights, id_col, text_col, source_col)
    copies = F.least(F.col("whole") * F.col("m") + _upto(F.col("before") + F.col("m")) - _upto(F.col("before")), F.lit(limit) * F.col("m"))
    taken = taken.select(F.col("doc_id").alias("_i"), F.col("source").alias("_s"), F.col("digest").alias("_d"), copies.alias("copies")).where("copies > 0")
    everything = [F.col(f"`{c}`") for c in df.columns]
    nulls = [c.isNull() for c in everything]
    rows = packed_rows(df, id=F.col(id_col), source=F.col(source_col), digest=_digest(F.col(text_col)), h1=F.xxhash64(F.lit(1), *everything, *nulls), h2=F.xxhash64(F.lit(2), *everything, *nulls))
    kinds = rows.groupBy("id", "source", "digest", "h1", "h2").agg(F.first("row").alias("row"), F.count(F.lit(1)).alias("m"))
    same = Window.partitionBy("id", "source", "digest")
    upto = F.sum("m").over(same.orderBy("h1", "h2").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kinds = kinds.withColumn("upto", upto).withColumn("all", F.sum("m").over(same))
    joined = kinds.join(taken, F.col("id").eqNullSafe(F.col("_i")) & F.col("source").eqNullSafe(F.col("_s")) & F.col("digest").eqNullSafe(F.col("_d")))
    part = lambda n: F.floor(F.col("copies") * n / F.col("all"))
    own = (part(F.col("upto")) - part(F.col("upto") - F.col("m"))).cast("long")
    rows = _portions(joined, own)
    return unpacked_rows(rows.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("_many").cast("int")))), df.columns)

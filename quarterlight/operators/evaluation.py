"""Evaluation: point, quantile and coverage metrics, predictive-ability tests, panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import time as T


def errors(pred: str = "y_pred", true: str = "y_true") -> Column:
    return F.col(pred) - F.col(true)


def point_metrics(df: DataFrame, by: list[str], pred: str = "y_pred", true: str = "y_true") -> DataFrame:
    """MAE, RMSE, bias, R2 over complete pairs, and counts."""
    e, y = errors(pred, true), F.col(true)
    ok = e.isNotNull()
    sse = F.sum(e * e)
    spread = F.sum(F.when(ok, y * y)) - F.count(e) * F.pow(F.avg(F.when(ok, y)), F.lit(2.0))
    return df.groupBy(*by).agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.avg(e * e).alias("mse"),
        F.when(spread > 0, 1 - sse / spread).alias("r2"), F.avg(F.when(ok, y)).alias("mean_true"),
        F.count(e).alias("n_obs"), F.sum(F.when(ok, 0).otherwise(1)).alias("n_missing"),
    )


def monthly_metrics(df: DataFrame, model: str = "model", pred: str = "y_pred", true: str = "y_true") -> DataFrame:
    """Per model: one row over everything and one per local month, in one pass by grouping sets."""
    own = df.withColumn("month", F.date_format(T.local(F.col("ts")), "yyyy-MM")).withColumn("e", errors(pred, true)).where("e IS NOT NULL")
    sets = own.groupingSets([[F.col(model)], [F.col(model), F.col("month")]], F.col(model), F.col("month"))
    return sets.agg(F.avg(F.abs("e")).alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg("e").alias("bias"), F.count("e").alias("n_obs")).withColumn(
        "month", F.coalesce("month", F.lit("full"))
    )


def pinball(q: Column, y: Column, tau: Column) -> Column:
    d = y - q
    return F.greatest(tau * d, (tau - 1) * d)


def kupiec(df: DataFrame, by: list[str], hit: str, alpha: float) -> DataFrame:
    """Unconditional coverage: likelihood ratio against hit rate 1 - alpha, and acceptance at 5 %."""
    sums = df.groupBy(*by).agg(F.count(hit).alias("n"), F.sum(F.col(hit).cast("int")).alias("k"))
    n, k, p = F.col("n"), F.col("k"), F.lit(1 - alpha)
    rate = k / n
    lr = -2 * (k * F.log(p) + (n - k) * F.log(1 - p) - k * F.log(rate) - (n - k) * F.log(1 - rate))
    inside = (k > 0) & (k < n)
    return sums.select(*by, "n", "k", F.when(inside, lr).alias("lr"), F.coalesce(inside & (lr <= 3.841458820694124), F.lit(False)).alias("accepted"))


def giacomini_white(daily: DataFrame, by: list[str]) -> DataFrame:
    """Conditional predictive ability from daily mean loss differences ``d`` ordered by ``day``: closed form of five sums."""
    p = F.lag("d").over(Window.partitionBy(*by).orderBy("day"))
    d = F.col("d")
    s = daily.withColumn("p", p).where("p IS NOT NULL AND d IS NOT NULL").groupBy(*by).agg(
        F.sum(d).alias("s1"), F.sum(F.col("p") * d).alias("s2"), F.sum(d * d).alias("a"), F.sum(d * d * F.col("p")).alias("b"),
        F.sum(d * d * F.col("p") * F.col("p")).alias("c"), F.avg(d).alias("mean_d"), F.count(d).alias("n"),
    )
    det = F.col("a") * F.col("c") - F.col("b") * F.col("b")
    stat = (F.col("c") * F.col("s1") * F.col("s1") - 2 * F.col("b") * F.col("s1") * F.col("s2") + F.col("a") * F.col("s2") * F.col("s2")) / det
    stat = F.when(det > 1e-12 * F.col("a") * F.col("c"), stat * F.signum("mean_d"))
    return s.select(*by, "n", stat.alias("statistic"), F.when(stat > 0, F.exp(-stat / 2)).otherwise(F.lit(1.0)).alias("p_value"))


def holm(df: DataFrame, by: list[str], p: str = "p_value") -> DataFrame:
    """Step-down adjusted p-values with running maximum."""
    w = Window.partitionBy(*by).orderBy(p) if by else Window.orderBy(p)
    m = F.count(F.lit(1)).over(Window.partitionBy(*(by or [F.lit(1)])))
    step = F.least(F.lit(1.0), (m - F.row_number().over(w) + 1) * F.col(p))
    return df.withColumn("_step", step).withColumn("p_holm", F.max("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def panel_gaps(panel: DataFrame, expected: DataFrame, by: list[str]) -> DataFrame:
    """Missing and extra timestamps per model."""
    models = panel.select(*by).distinct()
    wanted = models.crossJoin(expected.select("ts"))  # models are a handful
    missing = wanted.join(panel.select(*by, "ts"), [*by, "ts"], "left_anti").groupBy(*by).agg(F.count(F.lit(1)).alias("missing"))
    extra = panel.join(expected.select("ts"), "ts", "left_anti").groupBy(*by).agg(F.count(F.lit(1)).alias("extra"))
    return models.join(missing, by, "left").join(extra, by, "left").na.fill(0, ["missing", "extra"])

"""Reports over results and published rates. All inputs are reduced by partial aggregates first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plyframe.functions.text import is_true


def results_analysis(results: DataFrame, *by: str) -> DataFrame:
    """Totals and percents of a results file read as text; percents are 0 without rows."""
    counts = results.groupBy(*by).agg(
        F.count("*").alias("total_moves"), F.count_if(is_true(F.col("legal"))).alias("legal_moves"),
        F.count_if(is_true(F.col("good"))).alias("good_moves"),
    )

    def percent(part: str):
        return F.coalesce(F.round(F.try_divide(100 * F.col(part), F.col("total_moves")), 2), F.lit(0.0))

    return counts.withColumns({
        "legal_percentage": percent("legal_moves"), "good_percentage": percent("good_moves")
    })


def model_pivot(rates: DataFrame) -> DataFrame:
    """Few-shot against fine-tuned in one row per model. `rates` has model, phase, n, legal, best."""
    wide = rates.groupBy("model").pivot("phase", ["few_shot", "fine_tuned"]).agg(
        F.sum("legal").alias("legal"), F.sum("best").alias("best"), F.sum("n").alias("n")
    )
    out = ["model"]
    for phase in ("few_shot", "fine_tuned"):
        for what in ("legal", "best"):
            count = F.col(f"{phase}_{what}")
            out += [count.alias(f"{phase}_{what}"),
                    F.round(100 * count / F.col(f"{phase}_n"), 1).alias(f"{phase}_{what}_pct")]
    return wide.select(*out)


def improvement_factor(pivot: DataFrame) -> DataFrame:
    """How many times more legal and best moves after tuning; null from zero."""
    def factor(what: str):
        return F.round(F.try_divide(F.col(f"fine_tuned_{what}_pct"), F.col(f"few_shot_{what}_pct")), 2)

    return pivot.select("model", factor("legal").alias("legal_factor"), factor("best").alias("best_factor"))


def accuracy_curve(scored: DataFrame) -> DataFrame:
    """Best-move rate by training-set size and the gain over the next smaller one."""
    curve = scored.groupBy("model", "train_size").agg(
        F.count("*").alias("n"), (F.avg(F.col("good").cast("int")) * 100).alias("rate")
    )
    by_size = Window.partitionBy("model").orderBy("train_size")
    return curve.withColumn("gain", F.col("rate") - F.lag("rate").over(by_size))


def saturation_fit(scored: DataFrame, exponents: list[float], near: float = 0.95) -> DataFrame:
    """model, exponent, ceiling, slope, residual, saturated_at: the curve ceiling - slope * size^-exponent through the
    best-move rates of each model by training-set size, every reply counted alike, with the exponent of the least sum of
    squares; the size from which on the curve is over `near` of its ceiling, null where it does not rise to one.

    Replies are reduced to a row for each size, and the sums of a fit merge, so each exponent is one aggregate. A model with
    fewer than three sizes gives no row.
    """
    points = scored.groupBy("model", "train_size").agg(F.count("*").cast("double").alias("w"), (F.avg(F.col("good").cast("int")) * 100).alias("y"))
    grid = points.withColumn("exponent", F.explode(F.array(*map(F.lit, exponents)))).withColumn("z", F.pow(F.col("train_size").cast("double"), -F.col("exponent")))
    w, y, z = F.col("w"), F.col("y"), F.col("z")
    sums = grid.groupBy("model", "exponent").agg(
        F.count("*").alias("sizes"), F.sum(w).alias("n"), F.sum(w * z).alias("sz"), F.sum(w * y).alias("sy"),
        F.sum(w * z * z).alias("szz"), F.sum(w * z * y).alias("szy"), F.sum(w * y * y).alias("syy")).where("sizes >= 3")
    fit = sums.withColumn("b", F.expr("try_divide(n * szy - sz * sy, n * szz - sz * sz)")).withColumn("a", F.expr("(sy - b * sz) / n"))
    fit = fit.withColumn("residual", F.expr("syy - a * sy - b * szy")).where("residual IS NOT NULL")
    best = fit.groupBy("model").agg(F.min(F.struct("residual", "exponent", "a", "b")).alias("f")).select("model", "f.*")
    rises = (F.col("b") < 0) & (F.col("a") > 0)
    return best.select("model", "exponent", F.col("a").alias("ceiling"), (-F.col("b")).alias("slope"), "residual",
                       F.when(rises, F.pow(-F.col("b") / (F.col("a") * (1 - near)), 1 / F.col("exponent"))).alias("saturated_at"))

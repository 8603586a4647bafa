"""Fits: zone width by likelihood, deflated Sharpe ratio, classifiers of zone outcomes."""

from __future__ import annotations

from statistics import NormalDist

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Widths to choose from.
WIDTHS = tuple(round(0.2 + 0.05 * i, 2) for i in range(27))
EULER = 0.5772


def fit_width(touches: DataFrame, strata: list[str], offset: str, widths: tuple[float, ...] = WIDTHS, outside: float = 0.2) -> DataFrame:
    """The strata, n, q, log_likelihood: the width (in ATRs) under which the offsets of touches from their zone's center are likeliest, as a mix of a uniform share within the
    zone and a normal share of ``outside`` with half the width as deviation; of equal ones the smallest."""
    q = F.explode(F.array(*(F.lit(x) for x in widths)))
    e = F.col(offset)
    rows = touches.where(e.isNotNull()).select(*strata, e.alias("e")).groupBy(*strata, "e").agg(F.count("*").alias("c")).select("*", q.alias("q"))
    half = F.col("q") / 2
    inside = F.when(F.abs("e") <= half, (1 - outside) / F.col("q")).otherwise(0.0)
    normal = F.exp(-F.pow(F.col("e") / half, 2) / 2) / (half * F.lit(2.5066282746310002))
    rows = rows.withColumn("ll", F.col("c") * F.log(F.greatest(inside + outside * normal, F.lit(1e-300))))
    each = rows.groupBy(*strata, "q").agg(F.sum("c").alias("n"), F.round(F.sum("ll"), 6).alias("ll"))
    best = F.max(F.struct("ll", (-F.col("q")).alias("minus"), "n")).alias("b")
    return each.groupBy(*strata).agg(best).select(*strata, F.col("b.n").alias("n"), (-F.col("b.minus")).alias("q"), F.col("b.ll").alias("log_likelihood"))


def moments(returns: DataFrame, key: list[str], value: str) -> DataFrame:
    """The key, n, sharpe (per period), skew and kurtosis (3 for a normal) of the returns."""
    r = F.col(value)
    one = returns.where(r.isNotNull()).groupBy(*key).agg(F.count("*").alias("n"), F.avg(r).alias("m"), F.stddev_samp(r).alias("s"), F.skewness(r).alias("skew"), (F.kurtosis(r) + 3).alias("kurtosis"))
    return one.select(*key, "n", (F.col("m") / F.nullif("s", F.lit(0.0))).alias("sharpe"), "skew", "kurtosis")


def deflated_sharpe(found: DataFrame, trials: DataFrame) -> DataFrame:
    """``found`` (n, sharpe, skew, kurtosis of ``moments``) with expected_best, what the best of as many trials without skill would show, and deflated: the probability that the Sharpe ratio
    is above it. ``trials``: sharpe of each trial that was ever run; their number and variance count, one row of figures."""
    figures = F.broadcast(trials.agg(F.count("sharpe").alias("trials"), F.var_samp("sharpe").alias("spread")))  # one row

    def run(batches):
        normal = NormalDist()
        for pdf in batches:
            best, sure = [], []
            for row in pdf.itertuples():
                n = row.trials
                above = row.spread**0.5 * ((1 - EULER) * normal.inv_cdf(1 - 1 / n) + EULER * normal.inv_cdf(1 - 1 / (n * 2.718281828459045))) if n > 1 else 0.0
                scale = 1 - row.skew * row.sharpe + (row.kurtosis - 1) / 4 * row.sharpe**2
                best.append(above)
                sure.append(normal.cdf((row.sharpe - above) * (row.n - 1) ** 0.5 / scale**0.5) if scale > 0 else None)
            yield pdf.drop(columns=["trials", "spread"]).assign(expected_best=best, deflated=pd.Series(sure, index=pdf.index, dtype=float))

    rows = found.where("sharpe is not null").crossJoin(figures)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
    return rows.mapInPandas(run, f"{schema}, expected_best double, deflated double")


def outcome_models(rows: DataFrame, features: list[str], label: str, train: str, depth: int = 3, rounds: int = 20) -> DataFrame:
    """``rows`` with p_linear (logistic regression), p_trees (boosted trees) and p (a logistic regression on the two log odds): fits on the rows where ``train`` holds and ``label`` is known, all of
    them by Spark's own learners. The stack learns on the quarter of the training dates that the two base models have not seen. Rows with a null feature get null."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    whole = rows.where(" and ".join(f"{c} is not null" for c in features)).withColumn("_y", F.col(label).cast("double"))
    late = F.pmod(F.xxhash64("as_of"), F.lit(4)) == 0
    learn = whole.where(F.expr(train) & F.col("_y").isNotNull())
    base = Pipeline(stages=[
        VectorAssembler(inputCols=features, outputCol="_x"),
        LogisticRegression(featuresCol="_x", labelCol="_y", regParam=0.01, probabilityCol="_pl", rawPredictionCol="_rl", predictionCol="_dl"),
        GBTClassifier(featuresCol="_x", labelCol="_y", maxDepth=depth, maxIter=rounds, seed=0, predictionCol="_dt").setProbabilityCol("_pt").setRawPredictionCol("_rt"),
    ]).fit(learn.where(~late))
    odds = lambda df: df.withColumns({f"{n}": F.least(F.greatest(vector_to_array(c)[1], F.lit(1e-6)), F.lit(1 - 1e-6)) for n, c in (("p_linear", "_pl"), ("p_trees", "_pt"))}).withColumns({f"_o{n}": F.log(F.col(c) / (1 - F.col(c))) for n, c in ((0, "p_linear"), (1, "p_trees"))})
    stack = Pipeline(stages=[VectorAssembler(inputCols=["_o0", "_o1"], outputCol="_z"), LogisticRegression(featuresCol="_z", labelCol="_y", regParam=0.01, probabilityCol="_p", rawPredictionCol="_r", predictionCol="_d")]).fit(odds(base.transform(learn.where(late))))
    scored = stack.transform(odds(base.transform(whole))).withColumn("p", vector_to_array("_p")[1])
    return scored.select(*rows.columns, "p_linear", "p_trees", "p")

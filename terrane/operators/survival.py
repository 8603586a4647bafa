"""How long zones last after a touch: hazards by session, tables and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import DEFAULT
from .labels import KEY

SMALL = 1e-6


def person_periods(labels: DataFrame, horizon: int = DEFAULT.horizon) -> DataFrame:
    """``labels`` of touched zones, a row for each session from the touch on, as long as the zone has not broken: step (1: the session of the touch) and event, 1 in the session that breaks
    it. A zone that has not broken by the end of the horizon is censored there, one whose sessions are not all there (label_gap) is left out."""
    touched = labels.where("y_touch = 1 and not label_gap")
    last = F.coalesce(F.when(F.col("y_break") == 1, F.col("t_break")), F.lit(horizon)) - F.col("t_touch") + 1
    rows = touched.withColumn("step", F.explode(F.sequence(F.lit(1).cast("long"), last.cast("long"))))
    return rows.withColumn("event", ((F.col("y_break") == 1) & (F.col("t_touch") + F.col("step") - 1 == F.col("t_break"))).cast("long"))


def hazard_table(periods: DataFrame, strata: list[str]) -> DataFrame:
    """The strata, step, at_risk, breaks, hazard (breaks over zones at risk), survival (the running product of 1 - hazard) and p_break, the probability of breaking in that very session."""
    one = periods.groupBy(*strata, "step").agg(F.count("*").alias("at_risk"), F.sum("event").alias("breaks"))
    one = one.withColumn("hazard", F.col("breaks") / F.col("at_risk"))
    w = Window.partitionBy(*strata).orderBy("step")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    # A hazard of one ends the product at nought; the logarithm cannot say so.
    log = F.sum(F.when(F.col("hazard") < 1, F.log1p(-F.col("hazard"))).otherwise(0.0)).over(run)
    survival = F.when(F.max("hazard").over(run) >= 1, 0.0).otherwise(F.exp(log))
    one = one.withColumn("survival", survival)
    return one.withColumn("p_break", F.coalesce(F.lag("survival").over(w), F.lit(1.0)) * F.col("hazard"))


def time_to_break(rows: DataFrame, features: list[str], train: str, horizon: int = DEFAULT.horizon) -> DataFrame:
    """The zone's key, step, p_hazard, p_survival for each session of the horizon after a touch, and t_break_q50, the first session by which half of such zones have broken (null if fewer do).

    ``rows``: features and the columns of labels. A logistic regression of Spark's own on the person-periods of the rows where ``train`` holds, with a term for each session,
    gives hazards; survival is their running product. Rows with a null feature are left out."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    steps = [f"_s{i}" for i in range(2, horizon + 1)]
    marked = lambda df: df.withColumns({c: (F.col("step") == int(c[2:])).cast("double") for c in steps})
    whole = rows.where(" and ".join(f"{c} is not null" for c in features))
    learn = marked(person_periods(whole.where(F.expr(train)), horizon)).withColumn("_y", F.col("event").cast("double"))
    stages = [VectorAssembler(inputCols=[*features, *steps], outputCol="_x"), LogisticRegression(featuresCol="_x", labelCol="_y", regParam=0.001, probabilityCol="_p", rawPredictionCol="_r", predictionCol="_d")]
    asked = marked(whole.select(*KEY, *features).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))))
    told = Pipeline(stages=stages).fit(learn).transform(asked).withColumn("p_hazard", F.least(F.greatest(vector_to_array("_p")[1], F.lit(SMALL)), F.lit(1 - SMALL)))
    run = Window.partitionBy(*KEY).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    told = told.withColumn("p_survival", F.exp(F.sum(F.log1p(-F.col("p_hazard"))).over(run)))
    half = F.min(F.when(F.col("p_survival") <= 0.5, F.col("step"))).over(Window.partitionBy(*KEY)).cast("long")
    return told.select(*KEY, F.col("step").cast("long").alias("step"), "p_hazard", "p_survival", half.alias("t_break_q50"))

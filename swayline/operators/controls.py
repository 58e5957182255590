"""Logistic regression of the outcome on the metric and row-level controls."""

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import functions as F

from swayline.scratch import materialise

MAX_STEPS = 50


def logit_controls(frame, predictors=("metric", "final", "appearance")):
    """Coefficients of outcome ~ predictors; equal rows are merged and weighted first."""
    predictors = list(predictors)
    known = frame.select("outcome", *predictors).dropna()
    merged = known.groupBy(*predictors).agg(
        F.count(F.lit(1)).cast("double").alias("weight"), F.avg("outcome").alias("label"))
    merged = materialise(merged, "merged")  # every pass of the fit reads it
    vectors = VectorAssembler(inputCols=predictors, outputCol="features").transform(merged)
    model = GeneralizedLinearRegression(
        family="binomial", link="logit", weightCol="weight", maxIter=MAX_STEPS, tol=1e-10).fit(vectors)
    summary = model.summary
    if summary.numIterations >= MAX_STEPS:
        raise RuntimeError(f"the logit has not converged in {MAX_STEPS} steps")
    names = ["(Intercept)", *predictors]
    estimates = [model.intercept, *model.coefficients.tolist()]
    # the fit lists the intercept last
    order = [len(predictors), *range(len(predictors))]
    rows = [(names[i], float(estimates[i]), float(summary.coefficientStandardErrors[order[i]]),
             float(summary.tValues[order[i]]), float(summary.pValues[order[i]])) for i in range(len(names))]
    return frame.sparkSession.createDataFrame(
        rows, "term string, estimate double, std_error double, statistic double, p_value double")

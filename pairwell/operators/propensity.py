"""L2 logistic models with the inverse-strength parameter ``C``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwell.functions import frames


def fit_logistic(
    df: DataFrame,
    label: str,
    features: Sequence[str],
    C: float = 1.0,
    balanced: bool = False,
    weight: str | None = None,
) -> LogisticRegressionModel:
    """Minimize 0.5 |b|^2 + C sum w loss; the intercept is not penalized."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    y = (F.col(label) == 1).cast("double")
    prepared = df.select(*features, y.alias("_y"), w.alias("_w"))
    if balanced:
        totals = prepared.agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("pos")).first()
        n, pos = float(totals["n"]), float(totals["pos"])
        factor = F.when(F.col("_y") == 1, n / (2 * pos)).otherwise(n / (2 * (n - pos)))
        prepared = prepared.withColumn("_w", F.col("_w") * factor)
    total = prepared.agg(F.sum("_w").alias("s")).first()["s"]
    assembled = VectorAssembler(inputCols=list(features), outputCol="_f").transform(prepared)
    learner = LogisticRegression(
        featuresCol="_f",
        labelCol="_y",
        weightCol="_w",
        regParam=1.0 / (C * total),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=2000,
        tol=1e-10,
    )
    return learner.fit(assembled.select("_f", "_y", "_w"))


def score_logistic(model: LogisticRegressionModel, df: DataFrame, features: Sequence[str], out: str) -> DataFrame:
    """Probability of the positive class as a plain expression over the fitted coefficients."""
    margin = F.lit(float(model.intercept))
    for name, b in zip(features, model.coefficients.toArray()):
        margin = margin + F.lit(float(b)) * F.col(name).cast("double")
    return df.withColumn(out, 1.0 / (1.0 + F.exp(-margin)))


def propensity_scores(
    df: DataFrame,
    label: str,
    covariates: Sequence[str],
    use_age: bool = True,
    age_squared: bool = True,
    individual: str | None = None,
    individual_order: Sequence[str] = (),
) -> DataFrame:
    """Add ``ps`` and ``logit_ps``. Missing covariates count as zero in the fit and in scoring."""
    out = df
    used = [c for c in covariates if c in df.columns]
    if use_age:
        out = frames.standardize(out, "age", "age_z", "age_z2" if age_squared else None)
        used += ["age_z"] + (["age_z2"] if age_squared else [])
    if not used:
        return df.withColumns({"ps": F.lit(0.5), "logit_ps": F.lit(0.0)})
    filled = {f"_x_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in used}
    prepared = out.withColumns(filled)
    sample = prepared
    if individual is not None:
        from pairwell.operators.cohort import keep_first

        sample = keep_first(prepared, [individual], list(individual_order))
    model = fit_logistic(sample, label, list(filled), balanced=True)
    scored = score_logistic(model, prepared, list(filled), "ps").drop(*filled)
    return frames.repaired_logit(scored, "ps", "logit_ps")

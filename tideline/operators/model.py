"""Training, evaluating and applying the churn model with Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.scalars import stable_bucket
from tideline.operators.features import MODEL_FEATURES

LABEL = "is_churned"
CATEGORICAL = ["customer_segment", "loyalty_tier"]
NUMERIC = [c for c in MODEL_FEATURES if c not in CATEGORICAL]

EVAL_FIFTHS = 5
L2 = 0.1
MAX_ITERATIONS = 50
TOLERANCE = 1e-6
# A held-out AUC this close to 1 means the label leaked into the features.
LEAKAGE_AUC = 0.9999


class SingleClassError(ValueError):
    """The training set holds only one outcome."""


def split_training(training: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Four fifths to train, one to evaluate, by a hash of the customer id."""
    fifth = stable_bucket(EVAL_FIFTHS, "customer_id", F.lit("eval"))
    return training.where(fifth != 0), training.where(fifth == 0)


def class_weights(training: DataFrame) -> DataFrame:
    """Weight of each class, inversely proportional to its share.

    The result has one row per class.
    """
    per_class = training.groupBy(LABEL).agg(F.count(F.lit(1)).alias("customers"))
    per_class_mean = per_class.select(
        (F.sum("customers") / F.count(F.lit(1))).alias("mean")
    ).scalar()
    return per_class.select(
        LABEL, "customers", (per_class_mean / F.col("customers")).alias("class_weight")
    )


def _model_input(features: DataFrame) -> DataFrame:
    numeric = [F.col(c).cast("double").alias(c) for c in NUMERIC]
    rest = [F.col(c) for c in features.columns if c not in NUMERIC]
    return features.select(*rest, *numeric)


def _stages() -> list:
    indexed = [f"{c}_index" for c in CATEGORICAL]
    encoded = [f"{c}_onehot" for c in CATEGORICAL]
    filled = [f"{c}_filled" for c in NUMERIC]
    return [
        StringIndexer(inputCols=CATEGORICAL, outputCols=indexed, handleInvalid="keep",
                      stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=indexed, outputCols=encoded, handleInvalid="keep"),
        Imputer(inputCols=NUMERIC, outputCols=filled, strategy="mean"),
        VectorAssembler(inputCols=encoded + filled, outputCol="features"),
        LogisticRegression(
            featuresCol="features", labelCol="label", weightCol="class_weight",
            regParam=L2, elasticNetParam=0.0, maxIter=MAX_ITERATIONS, tol=TOLERANCE,
        ),
    ]


def train_churn_model(training: DataFrame) -> PipelineModel:
    """Fit the logistic regression on the training four fifths of the set."""
    fit_rows, _ = split_training(training)
    weights = {r[LABEL]: r["class_weight"] for r in class_weights(fit_rows).collect()}
    if len(weights) < 2:
        raise SingleClassError(f"training set holds only {sorted(weights)}")
    weight = F.when(F.col(LABEL) == 1, F.lit(weights[1])).otherwise(F.lit(weights[0]))
    prepared = (
        _model_input(fit_rows)
        .withColumn("label", F.col(LABEL).cast("double"))
        .withColumn("class_weight", weight)
    )
    return Pipeline(stages=_stages()).fit(prepared)


def predict_churn(model: PipelineModel, features: DataFrame) -> DataFrame:
    """Feature rows with the probability of churning and the predicted class.

    The positive class sits at the index equal to its label, which holds
    because the labels are the class indices 0 and 1.
    """
    scored = model.transform(_model_input(features))
    return scored.select(
        "customer_id",
        *[c for c in features.columns if c != "customer_id"],
        vector_to_array("probability")[1].alias("churn_probability"),
        F.col("prediction").cast("bigint").alias("predicted_is_churned"),
    )


def evaluate_model(
    model: PipelineModel, training: DataFrame, evaluated_at: str
) -> DataFrame:
    """Held-out metrics as one row; ``leakage_suspected`` says that they are too good."""
    _, held_out = split_training(training)
    scored = model.transform(
        _model_input(held_out).withColumn("label", F.col(LABEL).cast("double"))
    ).withColumn("_p", vector_to_array("probability")[1])
    auc = BinaryClassificationEvaluator(
        rawPredictionCol="rawPrediction", labelCol="label", metricName="areaUnderROC"
    ).evaluate(scored)
    hit = F.col("prediction") == F.col("label")
    positive, guessed = F.col("label") == 1, F.col("prediction") == 1
    p = F.least(F.greatest(F.col("_p"), F.lit(1e-15)), F.lit(1 - 1e-15))
    counts = scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(hit).alias("hits"),
        F.count_if(positive & guessed).alias("tp"),
        F.count_if(guessed).alias("guessed"),
        F.count_if(positive).alias("positives"),
        F.avg(-F.when(positive, F.log(p)).otherwise(F.log(1 - p))).alias("log_loss"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return (
        counts.withColumn("precision", ratio("tp", "guessed"))
        .withColumn("recall", ratio("tp", "positives"))
        .select(
            F.lit(evaluated_at).cast("timestamp").alias("evaluated_at"),
            "precision",
            "recall",
            ratio("hits", "n").alias("accuracy"),
            F.coalesce(
                F.try_divide(
                    2 * F.col("precision") * F.col("recall"),
                    F.col("precision") + F.col("recall"),
                ),
                F.lit(0.0),
            ).alias("f1_score"),
            "log_loss",
            F.lit(float(auc)).alias("roc_auc"),
            F.lit(bool(auc >= LEAKAGE_AUC)).alias("leakage_suspected"),
        )
    )


def model_coefficients(model: PipelineModel, training: DataFrame) -> DataFrame:
    """Each input's coefficient, its spread and the product of the two.

    The number of rows is the width of the feature vector, which the column
    list and the category levels fix; the spread is computed by Spark.
    """
    spark = training.sparkSession
    logistic = model.stages[-1]
    assembled = model.transform(_model_input(training))
    attributes = assembled.schema["features"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for group in attributes.values() for a in group}
    values = vector_to_array("features")
    positions = sorted(names)
    spread = assembled.select(values.alias("v")).agg(
        *[F.stddev_pop(F.col("v")[i]).alias(f"s{i}") for i in positions]
    )
    rows = [(int(i), names[i], float(logistic.coefficients[i])) for i in positions]
    listed = spark.createDataFrame(rows, "position int, feature string, coefficient double")
    long = spread.select(
        F.explode(
            F.array(*[
                F.struct(F.lit(int(i)).alias("position"), F.col(f"s{i}").alias("spread"))
                for i in positions
            ])
        ).alias("item")
    ).select("item.*")
    return listed.join(long, "position").select(
        "feature",
        "coefficient",
        "spread",
        (F.col("coefficient") * F.col("spread")).alias("attribution"),
    )

"""The churn run: features, labels, training, evaluation, scoring, merge.

``full`` trains and scores; ``rescore`` scores with the stored model.  The run
stops at the first step that fails and says so in its step table.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.operators import features, model, scoring
from tideline.sources import snapshots

FULL = "full"
RESCORE = "rescore"
MODES = (FULL, RESCORE)

STEP_SCHEMA = "step int, name string, label string, status string, affected bigint, detail string"


@dataclass
class ChurnStore:
    """Where a run keeps its model, evaluation and serving table."""

    root: str

    @property
    def model(self) -> str:
        return f"{self.root}/model"

    @property
    def training(self) -> str:
        return f"{self.root}/training"

    @property
    def evaluation(self) -> str:
        return f"{self.root}/evaluation"

    @property
    def risk(self) -> str:
        return f"{self.root}/risk"


def run_churn_pipeline(
    spark: SparkSession,
    orders: DataFrame,
    store: ChurnStore,
    today: dt.date | str,
    calculated_at: str,
    mode: str = FULL,
) -> DataFrame:
    """Run the steps and return one row per step that was started."""
    steps: list[tuple] = []

    def step(name: str, label: str, work: Callable[[], int | None]) -> bool:
        number = len(steps) + 1
        try:
            steps.append((number, name, label, "done", work(), None))
            return True
        except Exception as err:  # the step table is how a failure is reported
            steps.append((number, name, label, "failed", None, str(err)))
            return False

    def finish() -> DataFrame:
        return spark.createDataFrame(steps, STEP_SCHEMA)

    if mode not in MODES:
        steps.append((1, "mode", "Choose the mode", "failed", None,
                      f"unknown mode {mode!r}; expected one of {', '.join(MODES)}"))
        return finish()

    facts = features.order_facts(orders)

    def build_training() -> int:
        version = snapshots.write_version(features.training_set(facts, today), store.training)
        return snapshots.read_version(spark, store.training, version).count()

    def train() -> None:
        fitted = model.train_churn_model(snapshots.read_latest(spark, store.training))
        fitted.write().overwrite().save(store.model)

    def evaluate() -> int:
        fitted = PipelineModel.load(store.model)
        row = model.evaluate_model(
            fitted, snapshots.read_latest(spark, store.training), calculated_at
        )
        snapshots.write_version(row, store.evaluation)
        return 1

    def score_and_merge() -> int:
        fitted = PipelineModel.load(store.model)
        predictions = model.predict_churn(fitted, features.live_features(facts, today))
        source = scoring.score_customers(predictions, calculated_at)
        return scoring.store_merge(source, store.risk).agg(F.sum("affected")).first()[0] or 0

    if mode == FULL:
        if not step("training_set", "Build the training set", build_training):
            return finish()
        if not step("train", "Train the churn model", train):
            return finish()
        if not step("evaluate", "Evaluate on the held-out fifth", evaluate):
            return finish()
    step("score", "Score customers and merge the risk table", score_and_merge)
    return finish()


REPORT_SCHEMA = "section string, position int, name string, value double, number long, note string"


def run_report(store: ChurnStore, spark: SparkSession, customer_ids: Iterable[str] = ()) -> DataFrame:
    """What a run left behind: the newest evaluation, the risk tiers and some customers' scores.

    One row per figure, in order; ``number`` counts a tier's customers, or the days since a
    customer's last purchase.  A table that is not there yet leaves its section out.
    """
    parts = [spark.createDataFrame([], REPORT_SCHEMA)]
    if snapshots.versions(spark, store.evaluation):
        newest = scoring.latest_evaluation(snapshots.read_latest(spark, store.evaluation))
        figures = [f for f in newest.columns if f != "evaluated_at"]
        measured = F.posexplode(F.array(*[F.struct(F.lit(f).alias("name"), F.round(F.col(f).cast("double"), 4).alias("value")) for f in figures]))
        parts.append(newest.select(measured.alias("position", "m")).select(
            F.lit("evaluation").alias("section"), F.col("position"), "m.name", "m.value",
            F.lit(None).cast("long").alias("number"), F.lit(None).cast("string").alias("note")))
    if snapshots.versions(spark, store.risk):
        risk = snapshots.read_latest(spark, store.risk)
        # One row per tier.
        by_size = Window.orderBy(F.desc("avg_probability"), "churn_risk_tier")
        parts.append(scoring.risk_distribution(risk).select(
            F.lit("distribution").alias("section"), (F.row_number().over(by_size) - 1).alias("position"), F.col("churn_risk_tier").alias("name"),
            F.col("avg_probability").alias("value"), F.col("customers").alias("number"), F.lit(None).cast("string").alias("note")))
        ids = list(customer_ids)
        if ids:
            chosen = risk.where(F.col("customer_id").isin(ids))
            parts.append(chosen.select(
                F.lit("customers").alias("section"), (F.row_number().over(Window.orderBy("customer_id")) - 1).alias("position"),
                F.col("customer_id").alias("name"), F.round("churn_probability", 4).alias("value"),
                F.col("days_since_last_purchase").cast("long").alias("number"),
                F.concat_ws(" ", "churn_risk_tier", "automated_retention_action").alias("note")))
    return reduce(DataFrame.unionByName, parts)

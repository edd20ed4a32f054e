"""The tables behind the dashboard's four charts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.registry import loss_curves
from lectern.operators.warehouse import actions_per_user_month, chart_rec_by_action


def dashboard_frames(outcome: DataFrame, analysis: DataFrame, model: DataFrame) -> dict[str, DataFrame]:
    return {
        "recommended_books_by_action": chart_rec_by_action(outcome),
        "actions_per_user": actions_per_user_month(analysis),
        "policy_losses": loss_curves(model, "losses"),
        "adapter_losses": loss_curves(model, "adapter_losses"),
    }


def dashboard_points(frames: dict[str, DataFrame]) -> DataFrame:
    """All charts as points (chart, line, x, y)."""
    def points(chart: str, line: str, x: str, y: str) -> DataFrame:
        return frames[chart].select(
            F.lit(chart).alias("chart"),
            F.col(line).cast("string").alias("line"),
            F.col(x).cast("string").alias("x"),
            F.col(y).cast("double").alias("y"),
        )

    return reduce(
        DataFrame.unionByName,
        [
            points("recommended_books_by_action", "action_type", "recommendation_date", "total_recommended_books"),
            points("actions_per_user", "actionname", "month_label", "action_per_user"),
            points("policy_losses", "training_round", "epoch", "loss"),
            points("adapter_losses", "training_round", "epoch", "loss"),
        ],
    )

"""Case registry on plain tables: latest-wins upsert, retraction, knowledge gate, recommendations, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Distinct (date, unit) cases that a quantitative statement needs.
DIVERSITY = 3


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """The row of the highest version of each key, from both tables."""
    order = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in version))
    return old.unionByName(new).withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def retract(cases: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """cases whose key is not in gone."""
    return cases.join(gone, keys, "left_anti")


def knowledge(cases: DataFrame) -> DataFrame:
    """pattern, n_cases, signs_agree, mean_delta_pct, low, high from cases(pattern, scope, effective, delta_pct).

    n_cases counts distinct (date, unit); the mean stands only for three of them or more, one row each, all with a delta.
    """
    out = cases.groupBy("pattern").agg(
        F.count_distinct("effective", "scope").alias("n_cases"),
        F.count("*").alias("n"),
        F.count("delta_pct").alias("known"),
        (F.bool_and(F.col("delta_pct") > 0) | F.bool_and(F.col("delta_pct") < 0)).alias("signs_agree"),
        F.avg("delta_pct").alias("mean"),
        F.min("delta_pct").alias("low"),
        F.max("delta_pct").alias("high"),
    )
    gate = (F.col("n_cases") >= DIVERSITY) & (F.col("n_cases") == F.col("n")) & (F.col("known") == F.col("n"))
    return out.select("pattern", "n_cases", F.coalesce("signs_agree", F.lit(False)).alias("signs_agree"), F.round(F.when(gate, F.col("mean")), 6).alias("mean_delta_pct"), "low", "high")


def adverse(better: str, delta: str):
    """Whether a change goes against the metric's good direction; context metrics have none."""
    return ((F.col(better) == "up") & (F.col(delta) < 0)) | ((F.col(better) == "down") & (F.col(delta) > 0))


def recommend(comparisons: DataFrame, known: DataFrame) -> DataFrame:
    """An action for each adverse change, with the range of known cases of its pattern where there are enough."""
    rows = comparisons.where(adverse("better", "delta_abs")).join(known, "pattern", "left")
    enough = F.coalesce(F.col("n_cases"), F.lit(0)) >= DIVERSITY
    return rows.withColumns({"action": F.when(enough, "compare_with_cases").otherwise("discuss"), "range_low": F.round(F.when(enough, F.col("low")), 6), "range_high": F.round(F.when(enough, F.col("high")), 6)})


def restore_decisions(recommendations: DataFrame, decisions: DataFrame) -> DataFrame:
    """recommendations with the stored decision, `discuss` where there is none."""
    return recommendations.join(decisions.select("recommendation_id", F.col("decision").alias("_d")), "recommendation_id", "left").withColumn("decision", F.coalesce("_d", F.lit("discuss"))).drop("_d")


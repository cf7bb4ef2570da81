"""Pipeline state: a small control table of stages, their inputs, outputs and identity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.exprs import fingerprint

SCHEMA = "stage string, ordinal int, status string, inputs map<string,string>, config string, outputs map<string,string>, detail string"


def new_state(spark, stages: list[str]) -> DataFrame:
    return spark.createDataFrame([(s, i, "pending", None, None, None, None) for i, s in enumerate(stages)], SCHEMA)


def _set(state: DataFrame, stage: str, **values) -> DataFrame:
    here = F.col("stage") == stage
    return state.select(*[F.when(here, values[c]).otherwise(F.col(c)).cast(state.schema[c].dataType).alias(c) if c in values else F.col(c) for c in state.columns])


def _map(d: dict[str, str]):
    return F.create_map(*[F.lit(x) for kv in sorted(d.items()) for x in kv]) if d else F.create_map().cast("map<string,string>")


def begin(state: DataFrame, stage: str, inputs: dict[str, str], config: str = "") -> DataFrame:
    """The stage is running with these input hashes and configuration."""
    return _set(state, stage, status=F.lit("running"), inputs=_map(inputs), config=F.lit(config), outputs=F.lit(None), detail=F.lit(None))


def complete(state: DataFrame, stage: str, outputs: dict[str, str]) -> DataFrame:
    return _set(state, stage, status=F.lit("complete"), outputs=_map(outputs))


def fail(state: DataFrame, stage: str, category: str) -> DataFrame:
    return _set(state, stage, status=F.lit("failed"), detail=F.lit(category))


def reusable(state: DataFrame, stage: str, inputs: dict[str, str], config: str, observed: dict[str, str]) -> DataFrame:
    """One row: whether the stage is complete with this identity and all its outputs still have their hashes."""
    same = (F.col("status") == "complete") & (F.map_entries("inputs") == F.map_entries(_map(inputs))) & F.col("config").eqNullSafe(config)
    intact = F.forall(F.map_entries("outputs"), lambda e: F.coalesce(F.element_at(_map(observed), e["key"]) == e["value"], F.lit(False))) if observed else F.size("outputs") == 0
    return state.where(F.col("stage") == stage).select(F.coalesce(same & intact, F.lit(False)).alias("reusable"))


def invalidate_from(state: DataFrame, stage: str, reason: str = "upstream_identity_changed") -> DataFrame:
    """The stage and all after it are pending again."""
    at = state.where(F.col("stage") == stage).select(F.col("ordinal").alias("__from")).withColumn("__one", F.lit(1))
    s = state.withColumn("__one", F.lit(1)).join(F.broadcast(at), "__one")
    hit = F.col("ordinal") >= F.col("__from")
    return s.select("stage", "ordinal", F.when(hit, "pending").otherwise(F.col("status")).alias("status"), "inputs", "config", F.when(~hit, F.col("outputs")).alias("outputs"), F.when(hit, reason).otherwise(F.col("detail")).alias("detail"))


def stage_identity(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with the SHA-256 of the canonical JSON of the columns."""
    return df.withColumn("identity", fingerprint(*columns))

"""Registries and metadata: JSON files as dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCKS = "names array<string>, numStates int, defaultStateId int, material string, properties array<struct<name:string,type:string,values:array<string>>>, states struct<flags:array<int>,light:array<int>>"


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON that may have comments and spread over lines."""
    reader = spark.read.option("multiLine", "true").option("allowComments", "true")
    return (reader.schema(schema) if schema else reader).json(path)


def block_states(blocks: DataFrame) -> DataFrame:
    """(name, state, flags, opacity, emission, is_default): one row for each state of each name of block records.

    An array of one value holds for all states.
    """
    s = blocks.select("names", "numStates", "defaultStateId", "states", F.explode(F.sequence(F.lit(0), F.col("numStates") - 1)).alias("state"))

    def own(values):
        return F.when(F.size(values) == 1, values[0]).otherwise(F.get(values, F.col("state")))

    light = own(F.col("states.light"))
    return s.select(F.explode("names").alias("name"), "state", own(F.col("states.flags")).alias("flags"), light.bitwiseAND(15).alias("opacity"), F.shiftright(light, 4).alias("emission"), (F.col("state") == F.col("defaultStateId")).alias("is_default"))


def legacy_states(blocks: DataFrame) -> DataFrame:
    """(state, name, values, flags, opacity, emission, is_default) of records (name, id, defaultStateId, flags, light, states: arrays of one or 16): 16 states of each, id << 4 | data.

    An array of one value holds for all; a state beyond the array of values has none.
    """
    s = blocks.select("*", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("_m"))

    def own(values):
        return F.when(F.size(values) == 1, F.get(values, F.lit(0))).otherwise(F.get(values, F.col("_m")))

    state = F.shiftleft(F.col("id"), 4).bitwiseOR(F.col("_m"))
    light = own(F.col("light"))
    return s.select(state.alias("state"), "name", F.get("states", F.col("_m")).alias("values"), own(F.col("flags")).alias("flags"), light.bitwiseAND(15).alias("opacity"), F.shiftright(light, 4).alias("emission"), (F.col("_m") == F.col("defaultStateId").bitwiseAND(15)).alias("is_default"))


def renames(records: DataFrame) -> DataFrame:
    """(v, old, new) of records (version, renames: a map of old to new names)."""
    return records.select(F.col("version").alias("v"), F.explode("renames").alias("old", "new"))


def write_metadata(spark: SparkSession, path: str, version: int, data_version: int, transforms: list[str]) -> None:
    spark.createDataFrame([(version, data_version, transforms)], "version int, data_version int, transforms array<string>").coalesce(1).write.mode("overwrite").json(path)


def read_metadata(spark: SparkSession, path: str, known: int = 1) -> dict:
    row = read_json(spark, path, "version int, data_version int, transforms array<string>").first()
    if row.data_version > known:
        raise ValueError(f"the container has version {row.data_version}; {known} is the latest known")
    return row.asDict()

"""Materials of blocks as a dimension table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Attributes of a material and their bits.
ATTRIBUTES = {"blocks_motion": 1, "flammable": 2, "liquid": 4, "solid_blocking": 8, "replaceable": 16, "solid": 32}

#: Name, map colour, attribute bits.
MATERIALS = (
    ("air", "air", 16),
    ("structural_air", "air", 16),
    ("portal", "air", 0),
    ("carpet", "wool", 2),
    ("plant", "plant", 0),
    ("water_plant", "water", 0),
    ("replaceable_plant", "plant", 18),
    ("replaceable_fireproof_plant", "plant", 16),
    ("replaceable_water_plant", "water", 16),
    ("water", "water", 20),
    ("bubble_column", "water", 20),
    ("lava", "fire", 20),
    ("snow_layer", "snow", 16),
    ("fire", "air", 16),
    ("decoration", "air", 0),
    ("cobweb", "wool", 32),
    ("redstone_lamp", "air", 41),
    ("clay", "clay", 41),
    ("dirt", "dirt", 41),
    ("grass", "grass", 41),
    ("dense_ice", "ice", 41),
    ("sand", "sand", 41),
    ("sponge", "yellow", 41),
    ("shulker_box", "purple", 41),
    ("wood", "wood", 43),
    ("nether_wood", "wood", 41),
    ("bamboo_sapling", "wood", 42),
    ("bamboo", "wood", 43),
    ("wool", "wool", 43),
    ("tnt", "fire", 35),
    ("leaves", "plant", 35),
    ("glass", "air", 33),
    ("ice", "ice", 33),
    ("cactus", "plant", 33),
    ("stone", "stone", 41),
    ("metal", "metal", 41),
    ("snow_block", "snow", 41),
    ("repair_station", "metal", 41),
    ("barrier", "air", 41),
    ("piston", "stone", 41),
    ("moss", "plant", 41),
    ("vegetable", "plant", 41),
    ("egg", "plant", 41),
    ("cake", "air", 41),
    ("amethyst", "purple", 41),
    ("powder_snow", "snow", 8),
    ("sculk", "black", 41),
)
#: The attributes of a material that isn't known; heights that they give are never too high.
UNKNOWN = ("unknown", "magenta", 33)


def materials(spark: SparkSession) -> DataFrame:
    """(material, colour, flags) and a boolean column for each attribute."""
    rows = [(*m, *(bool(m[2] & bit) for bit in ATTRIBUTES.values())) for m in (*MATERIALS, UNKNOWN)]
    return spark.createDataFrame(rows, "material string, colour string, flags int, " + ", ".join(f"{a} boolean" for a in ATTRIBUTES))


def with_material(states: DataFrame, name: str = "material") -> DataFrame:
    """States with the attributes of their material; of the unknown one where it isn't in the table."""
    known = materials(states.sparkSession)
    found = F.when(F.col(name).isin([m[0] for m in MATERIALS]), F.col(name)).otherwise(UNKNOWN[0])
    return states.withColumn("_m", found).join(known.withColumnRenamed("material", "_m"), "_m").drop("_m")

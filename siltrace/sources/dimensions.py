"""Small fixed tables of the domain."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Pattern names in their reporting order, raw labels, check-list texts, expected patterns of each mode.
CLASSES = ("CENTER", "DONUT", "EDGE_LOC", "EDGE_RING", "LOC", "NEAR_FULL", "RANDOM", "SCRATCH")
CLASSES9 = ("NONE", *CLASSES)
RAW_LABELS = {
    "Center": "CENTER",
    "Donut": "DONUT",
    "Edge-Loc": "EDGE_LOC",
    "Edge-Ring": "EDGE_RING",
    "Loc": "LOC",
    "Near-full": "NEAR_FULL",
    "Random": "RANDOM",
    "Scratch": "SCRATCH",
}
EXPECTED = {
    "ring": ("EDGE_RING",),
    "center": ("CENTER",),
    "scratch": ("SCRATCH",),
    "random": ("RANDOM",),
    "donut": ("DONUT",),
    "edge_loc": ("EDGE_LOC",),
    "clean": ("CLEAN",),
}
ACTIONS = {
    "CLEAN": "no action",
    "CENTER": "check centre temperature and gas flow",
    "DONUT": "check rotation and coating uniformity",
    "EDGE_LOC": "check handling and clamp contact at the edge",
    "EDGE_RING": "check edge exclusion, etch and focus-ring wear",
    "LOC": "check for local contamination",
    "NEAR_FULL": "stop the lot and check the whole process",
    "RANDOM": "check particles and chamber cleanliness",
    "SCRATCH": "check robot arms, polishing pads and carriers",
}


def mapped(table: dict[str, str], key: Column) -> Column:
    """Value of ``key`` in a constant table; null where absent."""
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain(*table.items())]), key)


def class_table(spark: SparkSession, names: tuple[str, ...] = CLASSES) -> DataFrame:
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, ordinal int")


def expected_patterns(mode: str, noise: float = 0.0) -> tuple[str, ...]:
    """Patterns that a synthetic wafer of a mode may be given; noise on a clean wafer may look random."""
    if mode == "clean" and noise > 0:
        return ("CLEAN", "RANDOM")
    return EXPECTED[mode]

"""Synthetic wafers and fields as table-valued functions; randomness is a hash of the seed and the place."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltrace.functions.columns import norm2

MODES = ("ring", "center", "donut", "edge_loc", "scratch", "random", "clean")


def uniform(seed: int, *by: Column | str) -> Column:
    """Uniform in [0, 1), fixed by seed and place."""
    return F.pmod(F.xxhash64(F.lit(seed), *by), F.lit(1 << 40)) / float(1 << 40)


def gaussian(seed: int, *by: Column | str) -> Column:
    u, v = uniform(seed, F.lit("u"), *by), uniform(seed, F.lit("v"), *by)
    return F.sqrt(-2.0 * F.ln(1.0 - u)) * F.cos(v * 6.283185307179586)


def _pattern(mode: str, rn: Column, angle: Column, distance: Column, width: float, bounds: dict, u: Column) -> Column:
    return {
        "ring": rn >= bounds["ring"],
        "center": rn <= bounds["center"],
        "donut": rn.between(0.40, 0.62),
        "edge_loc": (rn >= bounds["edge_loc"]) & (F.abs(angle - 45.0) <= 35.0),
        "scratch": distance <= width,
        "random": u < 0.05,
        "clean": F.lit(False),
    }[mode]


def sample_wafer(
    spark: SparkSession, mode: str = "ring", diameter: float = 300.0, die: float = 10.0, exclusion: float = 3.0, noise: float = 0.0, seed: int = 42
) -> DataFrame:
    """(die_x, die_y, radius, angle_deg, status) of one synthetic wafer: dies whole within the usable radius."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    if not 0 <= noise <= 1:
        raise ValueError("noise must lie between 0 and 1")
    limit = diameter / 2 - exclusion
    n = int(limit // die) + 1
    axis = F.sequence(F.lit(-n), F.lit(n))
    grid = spark.range(1).select(F.explode(axis).alias("i")).select("i", F.explode(axis).alias("j"))
    x, y = F.col("die_x"), F.col("die_y")
    dies = (
        grid.select((F.col("i") * die).alias("die_x"), (F.col("j") * die).alias("die_y"))
        .withColumn("radius", norm2(x, y))
        .filter(F.col("radius") + die / 2 * sqrt(2) <= limit)
        .withColumn("angle_deg", F.degrees(F.atan2(y, x)))
    )
    # The scratch follows a line through the centre at 30 degrees.
    distance = F.abs(-0.5 * x + sqrt(3) / 2 * y)
    bounds = {"ring": 0.82, "center": 0.22, "edge_loc": 0.80}
    fail = _pattern(mode, F.col("radius") / limit, F.col("angle_deg"), distance, die, bounds, uniform(seed, F.lit("mode"), x, y))
    flipped = uniform(seed, F.lit("noise"), x, y) < noise
    return dies.withColumn("status", F.when(fail != flipped, "FAIL").otherwise("PASS"))


def parametric_field(
    spark: SparkSession,
    mode: str = "ring",
    size: int = 31,
    radius: float = 14.5,
    target: float = 435.0,
    spec: float = 0.05,
    depression: float = 45.0,
    noise_sd: float = 6.0,
    seed: int = 42,
) -> DataFrame:
    """(x, y, z, target, spec_lo, spec_hi): a measured quantity over the grid, null outside the wafer."""
    half = (size - 1) / 2
    axis = F.sequence(F.lit(0), F.lit(size - 1))
    grid = spark.range(1).select(F.explode(axis).alias("i")).select("i", F.explode(axis).alias("j"))
    x, y = F.col("i") - F.lit(half), F.lit(half) - F.col("j")
    rn = norm2(x, y) / radius
    bounds = {"ring": 0.80, "center": 0.25, "edge_loc": 0.78}
    hit = _pattern(mode, rn, F.degrees(F.atan2(y, x)), F.abs(-0.5 * x + sqrt(3) / 2 * y), 1.2, bounds, uniform(seed, F.lit("mode"), "i", "j"))
    drop = F.when(hit, depression + gaussian(seed, F.lit("drop"), "i", "j") * depression / 4).otherwise(0.0)
    z = target - 4.0 * rn + gaussian(seed, F.lit("z"), "i", "j") * noise_sd - drop
    return grid.select(
        x.alias("x"),
        y.alias("y"),
        F.when(rn <= 1.0, z).alias("z"),
        F.lit(target).alias("target"),
        F.lit(target * (1 - spec)).alias("spec_lo"),
        F.lit(target * (1 + spec)).alias("spec_hi"),
    )


# Wafers of each class in the public data set, in the reporting order of the classes.
CLASS_COUNTS = (4294, 555, 5189, 9680, 3593, 149, 866, 1193)


def _drawn(u: Column, names: tuple[str, ...], weights: list[Column]) -> Column:
    total, below, out = sum(weights[1:], weights[0]), F.lit(0.0), None
    for name, w in zip(names[:-1], weights[:-1], strict=True):
        below = below + w / total
        out = F.when(u < below, name) if out is None else out.when(u < below, name)
    return out.otherwise(names[-1])


def beta(seed: int, a: float, b: float, *by: Column | str) -> Column:
    """Beta(a, b) fixed by seed and place, as a ratio of gamma values."""

    def gamma(name: str, shape: float) -> Column:
        # A cubed normal value, taken if it passes; four tries, of which each passes in more than 95 of 100 cases.
        d = shape + 1 - 1 / 3
        tries = []
        for k in range(4):
            x, u = gaussian(seed, F.lit(f"{name}{k}"), *by), uniform(seed, F.lit(f"{name}u{k}"), *by)
            v = F.pow(1 + x / sqrt(9 * d), 3)
            tries.append(F.when((v > 0) & (F.ln(1.0 - u) < x * x / 2 + d - d * v + d * F.ln(v)), d * v))
        return F.coalesce(*tries, F.lit(d)) * F.pow(1.0 - uniform(seed, F.lit(f"{name}p"), *by), 1 / shape)

    x, y = gamma("a", a), gamma("b", b)
    return x / (x + y)


# The demo stream's shifts, as shares of its groups and of its wafers.
DRIFT_START, DRIFT_OVER, DRIFT = 0.60, 0.20, 0.15  # EDGE_RING
STEP_START, STEP = 0.825, 0.10  # SCRATCH
AGEING_START, AGEING = 0.75, 0.15  # rows of low confidence


def demo_predictions(spark: SparkSession, groups: int = 200, size: int = 25, seed: int = 0) -> DataFrame:
    """(sample_id, lot, y_pred, confidence): class mix of the public set, with a drift, a step, and later rows of low confidence."""
    from siltrace.sources.dimensions import CLASSES

    g = F.floor(F.col("id") / size)
    weights = [F.lit(float(c)) / sum(CLASS_COUNTS) for c in CLASS_COUNTS]
    ring, scratch = CLASSES.index("EDGE_RING"), CLASSES.index("SCRATCH")
    drift = DRIFT * F.least(F.lit(1.0), (g - groups * DRIFT_START) / (groups * DRIFT_OVER))
    weights[ring] = weights[ring] + F.when(g >= groups * DRIFT_START, drift).otherwise(0.0)
    weights[scratch] = weights[scratch] + F.when(g >= groups * STEP_START, STEP).otherwise(0.0)
    aged = (g >= groups * AGEING_START) & (uniform(seed, F.lit("aged"), "id") < AGEING)
    confidence = F.when(aged, 0.3 + 0.4 * uniform(seed, F.lit("low"), "id")).otherwise(beta(seed, 8.0, 1.2, "id"))
    drawn = _drawn(uniform(seed, F.lit("class"), "id"), CLASSES, weights)
    return spark.range(groups * size).select(F.col("id").alias("sample_id"), F.format_string("lot%04d", g).alias("lot"), drawn.alias("y_pred"), confidence.alias("confidence"))


def labelled_maps(spark: SparkSession, lots: int = 120, unlabelled: int = 50, none_lots: int | None = None, seed: int = 0) -> DataFrame:
    """(lot, wafer_index, die_size, wafer_map, failure_type) as in the public set: maps of many sizes, labels in nested arrays.

    Lots of 8 to 19 wafers: four fifths of a lot's wafers show its pattern.  Then lots without pattern, of which 5 % of wafers
    are strays with one, and wafers of one lot whose label is empty.
    """
    from siltrace.operators.dies import die_map
    from siltrace.sources.dimensions import RAW_LABELS

    none_lots = lots // 2 if none_lots is None else none_lots
    kinds = F.array(*[F.lit(k) for k in RAW_LABELS])
    pick = lambda values, name, *by: F.get(values, F.floor(uniform(seed, F.lit(name), *by) * F.size(values)).cast("int"))
    own = spark.range(lots + none_lots).select(F.col("id").alias("lot_id"), F.explode(F.sequence(F.lit(0), (7 + F.floor(uniform(seed, F.lit("wafers"), "id") * 12)).cast("int"))).alias("w"))
    other, stray = pick(kinds, "own", "lot_id", "w"), uniform(seed, F.lit("stray"), "lot_id", "w")
    label = F.when(F.col("lot_id") < lots, F.when(stray < 0.8, pick(kinds, "lot", "lot_id")).otherwise(other)).otherwise(F.when(stray < 0.05, other).otherwise("none"))
    named = own.select(F.concat(F.lit("lot"), "lot_id").alias("lot"), F.col("w").alias("wafer_index"), label.alias("label"))
    rest = spark.range(unlabelled).select(F.lit("lotX").alias("lot"), F.col("id").cast("int").alias("wafer_index"), F.lit(None).cast("string").alias("label"))
    wafers = named.unionByName(rest)
    by = ("lot", "wafer_index")
    spread = lambda name, lo, hi: lo + (hi - lo) * uniform(seed, F.lit(name), *by)
    wafers = wafers.select(
        *by,
        "label",
        pick(F.array(*[F.lit(float(v)) for v in (200, 250, 300, 350)]), "diameter", *by).alias("diameter"),
        pick(F.array(*[F.lit(float(v)) for v in (8, 10, 12)]), "die", *by).alias("die"),
        F.when(F.col("label") == "none", spread("noise", 0.0, 0.04)).otherwise(spread("noise", 0.01, 0.08)).alias("noise"),
        spread("turn", -3.141592653589793, 3.141592653589793).alias("turn"),
        spread("out", 0.3, 0.65).alias("out"),
        spread("blob", 0.12, 0.2).alias("blob"),
        spread("full", 0.65, 0.9).alias("full"),
    ).withColumn("limit", F.col("diameter") / 2 - 3.0)
    n = F.floor(F.col("limit") / F.col("die")).cast("int")
    axis = F.sequence(-F.col("n"), F.col("n"))
    grid = wafers.withColumn("n", n).withColumn("i", F.explode(axis)).withColumn("j", F.explode(axis))
    x, y = F.col("i") * F.col("die"), F.col("j") * F.col("die")
    rn, angle, u = norm2(x, y) / F.col("limit"), F.degrees(F.atan2(y, x)), uniform(seed, F.lit("die"), *by, "i", "j")
    cx, cy = F.col("out") * F.cos("turn"), F.col("out") * F.sin("turn")
    shapes = {
        "Center": rn <= 0.22,
        "Donut": rn.between(0.40, 0.62),
        "Edge-Loc": (rn >= 0.80) & (F.abs(angle - 45.0) <= 35.0),
        "Edge-Ring": rn >= 0.82,
        "Loc": (norm2(x / F.col("limit") - cx, y / F.col("limit") - cy) <= F.col("blob")) | (u < 0.05),
        "Near-full": u < F.col("full"),
        "Random": u < 0.05,
        "Scratch": F.abs(-0.5 * x + sqrt(3) / 2 * y) <= F.col("die"),
        "none": F.lit(False),
    }
    shape = F.coalesce(F.col("label"), F.lit("Random"))
    fail = F.coalesce(*[F.when(shape == k, c) for k, c in shapes.items()])
    flipped = (uniform(seed, F.lit("flip"), *by, "i", "j") < F.col("noise")) & (shape != "Near-full")
    dies = grid.filter(norm2(x, y) + F.col("die") / 2 * sqrt(2) <= F.col("limit"))
    cells = dies.select(
        F.struct(*by, "label").alias("wafer"), (2 * F.col("n") + 1).alias("height"), (2 * F.col("n") + 1).alias("width"),
        (F.col("i") + F.col("n")).alias("x"), (F.col("n") - F.col("j")).alias("y"), F.when(fail != flipped, 2).otherwise(1).alias("v"),
    )
    nested = F.when(F.col("wafer.label").isNull(), F.array().cast("array<array<string>>")).otherwise(F.array(F.array("wafer.label")))
    return die_map(cells).select("wafer.lot", "wafer.wafer_index", F.lit(1.0).alias("die_size"), "wafer_map", nested.alias("failure_type"))


# Process steps of the lot demo and their numbers of tools.
DEMO_STEPS = {"PHOTO": 4, "ETCH": 4, "DEP": 3, "CMP": 3, "CLEAN": 2}


def demo_lots(spark: SparkSession, lots: int = 240, wafers: int = 25, seed: int = 0, effect: float = 0.20) -> tuple[DataFrame, DataFrame]:
    """(predictions, history) with a planted cause, ETCH-03, that raises EDGE_RING by ``effect`` and mostly goes with DEP-02."""
    from siltrace.sources.dimensions import CLASSES

    lot = F.format_string("lot%04d", "id")
    tool = {s: F.format_string(f"{s}-%02d", F.floor(uniform(seed, F.lit(s), "id") * n) + 1) for s, n in DEMO_STEPS.items()}
    cause = tool["ETCH"] == "ETCH-03"
    tool["DEP"] = F.when(cause & (uniform(seed, F.lit("pin"), "id") < 0.75), "DEP-02").otherwise(tool["DEP"])
    base = spark.range(lots)
    steps = F.array(*[F.struct(F.lit(s).alias("step"), t.alias("tool")) for s, t in tool.items()])
    history = base.select(lot.alias("lot"), F.inline(steps))
    weights = [F.lit(float(c)) / sum(CLASS_COUNTS) for c in CLASS_COUNTS]
    weights[CLASSES.index("EDGE_RING")] = weights[CLASSES.index("EDGE_RING")] + F.when(F.col("cause"), effect).otherwise(0.0)
    rows = base.select("id", lot.alias("lot"), cause.alias("cause"), F.explode(F.sequence(F.lit(0), F.lit(wafers - 1))).alias("wafer"))
    return rows.select("lot", "wafer", _drawn(uniform(seed, F.lit("y"), "id", "wafer"), CLASSES, weights).alias("y_pred")), history

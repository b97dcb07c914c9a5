"""Image quality as columns: resolution, overall score and the preprocessing that follows from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def resolution_score(pixels: Column) -> Column:
    base = F.least(F.lit(100.0), pixels / 1e4)
    return F.when(pixels > 2_000_000, 100.0).when(pixels > 1_000_000, F.least(F.lit(100.0), base * 1.2)).otherwise(base)


# The weights of the overall score, and the limits and order of the rules below.
def overall_quality(noise: Column, contrast: Column, brightness: Column, blur: Column, resolution: Column, density: Column) -> Column:
    return 0.25 * contrast + 0.20 * (100 - noise) + 0.15 * blur + 0.20 * resolution + 0.10 * density + 0.10 * (100 - F.abs(brightness - 50))


def preprocessing(noise: Column, contrast: Column, blur: Column, resolution: Column, overall: Column) -> Column:
    """The first rule that fits names the method; unknown metrics (null) mean ``minimal``."""
    rules = [
        (resolution < 20, "scale_aware"),
        ((overall > 75) & (noise < 15) & (contrast > 65) & (blur > 40), "minimal"),
        (noise > 70, "advanced"),
        ((blur < 15) & (noise > 40), "morphology"),
        ((blur < 15) & (noise < 20), "advanced"),
        ((noise > 40) & (blur < 30), "morphology"),
        (noise > 40, "medium"),
        ((contrast < 35) & (noise < 25), "light"),
        (contrast < 35, "medium"),
        ((resolution < 35) & (overall < 60), "scale_aware"),
        ((overall > 70) & (contrast > 55), "minimal"),
        (overall > 60, "light"),
        ((overall > 50) & (noise > 25), "medium"),
        (overall > 50, "light"),
        (blur < 20, "medium"),
    ]
    chosen = F.when(F.lit(False), "minimal")
    for rule, method in rules:
        chosen = chosen.when(rule, method)
    return chosen.otherwise("minimal")


def dispatch(requested: Column, automatic: Column) -> Column:
    """The transform that a request means: ``auto`` or none takes the automatic choice, unknown names ``minimal``."""
    known = ["minimal", "light", "default", "old", "medium", "advanced", "morphology", "scale_aware"]
    return F.when(requested.isNull() | (requested == "auto"), automatic).when(requested == "old", "default").when(requested.isin(known), requested).otherwise("minimal")

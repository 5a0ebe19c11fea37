"""Settings: a JSON object laid over defaults."""

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    """threshold1 is for explicit lines, threshold2 for corners and implicit ones."""

    canvas_size: int = 1024
    mag_ratio: float = 10.0
    threshold1: float = 0.2
    threshold2: float = 0.1

    def overlaid(self, found: dict, known_only: bool = True) -> "Settings | dict":
        """With the values of a JSON object. thresholds[0] and [1] become threshold1 and threshold2, further ones are ignored.

        known_only: other keys are ignored; else a dict with them comes back.
        """
        values = asdict(self)
        limits = found.get("thresholds", [])
        changes = {k: v for k, v in found.items() if k != "thresholds" and (k in values or not known_only)} | dict(zip(("threshold1", "threshold2"), limits, strict=False))
        merged = values | changes
        return Settings(**merged) if known_only else merged


def read_settings(spark: SparkSession, path: str, defaults: Settings | None = None, known_only: bool = True) -> "Settings | dict":
    """The JSON file at a path that Spark can read, laid over defaults; a configuration is one small file."""
    text = spark.read.text(path, wholetext=True).first().value
    return (defaults or Settings()).overlaid(json.loads(text), known_only)


def settings_of(text: Column, defaults: Settings | None = None) -> Column:
    """A struct of the settings in a column of JSON texts, laid over defaults; a text that isn't an object changes nothing."""
    given = F.from_json(text, "canvas_size int, mag_ratio double, threshold1 double, threshold2 double, thresholds array<double>")
    first = {"threshold1": F.get(given["thresholds"], 0), "threshold2": F.get(given["thresholds"], 1)}
    return F.struct(*[F.coalesce(*([first[k]] if k in first else []), given[k], F.lit(v)).alias(k) for k, v in asdict(defaults or Settings()).items()])

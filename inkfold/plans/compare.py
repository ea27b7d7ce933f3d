"""Wall time of several methods for the same result, side by side."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame


def compare(methods: dict[str, Callable[[], DataFrame]], units: int = 1) -> dict[str, dict[str, float]]:
    """seconds, seconds_per_unit and speed (times the slowest) of each method; every column of every row is produced."""
    took: dict[str, float] = {}
    for name, make in methods.items():
        began = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        took[name] = time.perf_counter() - began
    slowest = max(took.values(), default=0.0)
    return {k: {"seconds": s, "seconds_per_unit": s / max(units, 1), "speed": slowest / s if s else 0.0} for k, s in took.items()}

"""Rule engines: chains of conditions built from plain tables of thresholds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the first engine, in the order in which they are tried: label, confidence, and lower and
#: upper bounds (exclusive above and below, but for the dribble's, which include their ends).
IMPACT_ACC, IMPACT_GYRO = 25.0, 8.0
DRIBBLE_HZ, DRIBBLE_PEAKS = (1.5, 4.5), 3
SHOT_GYRO, SHOT_ACC = 5.0, 12.0
PASS_GYRO, PASS_PEAKS = 3.0, 2
SPRINT_HZ, SPRINT_ACC = 0.8, 13.0


def first_match(chain: list[tuple[str, float, Column]], otherwise: tuple[str, float]) -> tuple[Column, Column]:
    """(label, confidence) of the first condition that holds."""
    label, confidence = F.lit(otherwise[0]), F.lit(otherwise[1])
    for name, sure, condition in reversed(chain):
        label, confidence = F.when(condition, name).otherwise(label), F.when(condition, sure).otherwise(confidence)
    return label, confidence


def motion_rules(acc_max: Column, acc_hz: Column, acc_peaks: Column, gyro_max: Column) -> tuple[Column, Column]:
    return first_match([
        ("jump", 0.65, (acc_max > IMPACT_ACC) & (gyro_max < IMPACT_GYRO)),
        ("dribble", 0.70, acc_hz.between(*DRIBBLE_HZ) & (acc_peaks >= DRIBBLE_PEAKS)),
        ("shot", 0.60, (gyro_max > SHOT_GYRO) & (acc_max > SHOT_ACC)),
        ("pass", 0.55, (gyro_max > PASS_GYRO) & (acc_peaks <= PASS_PEAKS)),
        ("sprint", 0.50, (acc_hz > SPRINT_HZ) & (acc_max > SPRINT_ACC)),
    ], ("idle", 0.50))


#: A bound's name: the feature, and whether it is the least or the most.
Bounds = dict[str, dict[str, float]]


#: Bounds on counts include their ends in every engine.
COUNTS = ("peak_count",)


def holds(bounds: dict[str, float], strict: bool = False, optional: tuple[str, ...] = (), columns: list[str] | None = None) -> Column:
    """All bounds of one label: ``<feature>_min`` and ``<feature>_max``, without their ends if ``strict``, but for counts. An
    optional feature bounds only rows that have it; with ``columns`` a table that lacks it is not bounded at all."""
    parts = [F.lit(True)]
    for name, value in bounds.items():
        feature, low = name[:-4], name.endswith("_min")
        if feature in optional and columns is not None and feature not in columns:
            continue
        x, open_ = F.col(feature), strict and feature not in COUNTS
        met = (x > value if open_ else x >= value) if low else (x < value if open_ else x <= value)
        parts.append(x.isNull() | F.isnan(x.cast("double")) | met if feature in optional else met)
    return F.coalesce(reduce(Column.__and__, parts), F.lit(False))


def by_priority(bounds: Bounds, priority: list[str], strict: bool = False, optional: tuple[str, ...] = (), columns: list[str] | None = None) -> tuple[Column, Column]:
    """The first label in order of priority whose bounds all hold, with confidence 1; else unknown with 0."""
    return first_match([(k, 1.0, holds(bounds[k], strict, optional, columns)) for k in priority if k in bounds], ("unknown", 0.0))


def scored(bounds: Bounds, strict: bool = True) -> dict[str, Column]:
    """0 or 1 for each label."""
    return {f"rule_{k}": holds(b, strict).cast("double") for k, b in bounds.items()}


def best_scored(bounds: Bounds, strict: bool = True) -> tuple[Column, Column]:
    """(label, score) of the label with the highest score, the first of equals in the order of the table; unknown where all
    are 0."""
    return first_match([(k, 1.0, holds(b, strict)) for k, b in bounds.items()], ("unknown", 0.0))


def from_config(config: dict, names: dict[str, str]) -> tuple[Bounds, list[str]]:
    """(bounds, priority) of a configuration read from a file, ``thresholds`` by label and ``priority``; ``names`` gives the
    feature that a bound's name without its end stands for."""
    def named(bound: str) -> str:
        feature, end = bound[:-4], bound[-4:]
        if end not in ("_min", "_max"):
            raise ValueError(f"{bound} is neither a lower nor an upper bound")
        return names.get(feature, feature) + end

    return {k: {named(n): float(v) for n, v in b.items()} for k, b in config["thresholds"].items()}, list(config["priority"])


def disagreement(*predictions: Column) -> Column:
    first, *rest = predictions
    return reduce(Column.__or__, [first != p for p in rest])


def rejected(max_p: Column, distance: Column, least_p: float, most_distance: Column, label: Column) -> tuple[Column, Column]:
    """Open-set rejection: (label or unknown, confidence)."""
    out = (max_p < least_p) | (distance > most_distance)
    return F.when(out, "unknown").otherwise(label), F.when(out, 1 - max_p).otherwise(max_p)

"""Numeric expressions: half-even rounding, guarded ratios, intervals, schedules, frame counts."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    """a / b; `empty` where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(empty))


def half_even(x: Column, places: int = 0) -> Column:
    return F.rint(x * 10**places) / 10**places if places else F.rint(x)


def six(x: Column) -> Column:
    """Rounded to six places the same way in any engine."""
    return F.floor(x * 1e6 + 0.5) / 1e6


def wilson(n_success: Column, n_total: Column, z: float = 1.96) -> Column:
    """Struct low, high of the Wilson score interval; (0, 1) for no trial."""
    n = n_total.cast("double")
    p = ratio(n_success.cast("double"), n)
    safe = F.greatest(n, F.lit(1.0))
    denom = 1 + z * z / safe
    centre = (p + z * z / (2 * safe)) / denom
    half = z * F.sqrt(p * (1 - p) / safe + z * z / (4 * safe * safe)) / denom
    low = F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), centre - half))
    high = F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), centre + half))
    return F.struct(low.alias("low"), high.alias("high"))


def wilson_interval(n_success: int, n_total: int, z: float = 1.96) -> tuple[float, float]:
    if n_total == 0:
        return 0.0, 1.0
    p, w = n_success / n_total, z * z / n_total
    centre, half = p + w / 2, z * math.sqrt(p * (1 - p) / n_total + w / (4 * n_total))
    return max(0.0, (centre - half) / (1 + w)), min(1.0, (centre + half) / (1 + w))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2.0 * tp, 2.0 * tp + fp + fn)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return ratio(both.cast("double"), (F.size(a) + F.size(b) - both).cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return ratio(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def encoder_frames(n_mel: Column, most: int = 1500) -> Column:
    """Frames after a stride-2 convolution of width 3."""
    return F.least(F.floor((n_mel - 1) / 2) + 1, F.lit(most)).cast("long")


def frames_of_samples(n_samples: Column, hop: int = 160, most: int = 1500) -> Column:
    return encoder_frames(F.floor(n_samples / hop), most)


def masked_mean(frames: Column, n_valid: Column) -> Column:
    """Mean of the first n_valid vectors of array<array<double>> (none: zeros)."""
    kept = F.slice(frames, F.lit(1), n_valid.cast("int"))
    zero = F.transform(F.get(frames, F.lit(0)), lambda _: F.lit(0.0))
    total = F.aggregate(kept, zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.greatest(n_valid, F.lit(1)))


def warmup_cosine(step: Column, total: int, warmup: int) -> Column:
    """Learning rate factor: linear to 1 over the warm-up, then half a cosine to 0."""
    progress = (step - warmup) / max(1, total - warmup)
    return F.when(step < warmup, step / max(1, warmup)).otherwise(0.5 * (1 + F.cos(F.lit(math.pi) * progress)))


def total_steps(budget: str, n_train: int, batch_size: int, epochs: int, other_steps: int | None = None) -> int:
    if budget == "epoch_matched":
        return epochs * -(-n_train // batch_size)
    if budget == "step_matched_to_c":
        if other_steps is None:
            raise ValueError("step_matched_to_c needs the step count of the arm that it matches")
        return other_steps
    raise ValueError(f"unknown budget rule: {budget}")

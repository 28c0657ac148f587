"""Learning-rate and margin curves as expressions of the step."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def warmup(it: Column, steps: int, from_zero: bool = True) -> Column:
    """Factor that rises to 1 over the first steps."""
    return F.least(F.lit(1.0), it / steps) if from_zero else F.lit(1.0)


def exponential_decrease(it: Column, total: int, first: float, last: float, warm: int = 0) -> Column:
    """first at the start, last at the end, with a constant ratio between steps."""
    return warmup(it, warm) * first * F.exp(it / total * math.log(last / first)) if warm else first * F.exp(it / total * math.log(last / first))


def triangular2(it: Column, half_cycle: int, low: float, high: float) -> Column:
    """Saw teeth from low to high whose height halves every cycle."""
    cycle = F.floor(1 + it / (2 * half_cycle))
    x = F.abs(it / half_cycle - 2 * cycle + 1)
    return low + (high - low) * F.greatest(F.lit(0.0), 1 - x) / F.pow(F.lit(2.0), cycle - 1)


def warmup_cosine(it: Column, warm: int, total: int, high: float, low: float) -> Column:
    """Linear rise, then half a cosine down to low."""
    down = low + (high - low) * 0.5 * (1 + F.cos(math.pi * (it - warm) / (total - warm)))
    return F.when(it < warm, high * it / warm).otherwise(down)


def warmup_steps(it: Column, warm: int, every: int, high: float, factor: float) -> Column:
    """Linear rise, then times factor every so many steps."""
    return F.when(it < warm, high * it / warm).otherwise(high * F.pow(F.lit(factor), F.floor((it - warm) / every)))


def margin_curve(it: Column, start: int, end: int, first: float, last: float, kind: str = "exp") -> Column:
    """first before start, last after end, in between linear or an exponential approach."""
    t = (it - start) / (end - start)
    if kind == "exp":
        between = first + (last - first) * (1 - F.exp(t * math.log(1e-3 / (1 + 1e-6))))
    else:
        between = first + (last - first) * t
    return F.when(it < start, F.lit(first)).when(it >= end, F.lit(last)).otherwise(between)

"""Colour ramps as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ramp stops as (position, (red, green, blue)).
HEAT_RAMP = ((0.0, (255, 210, 138)), (0.5, (255, 138, 76)), (1.0, (232, 72, 58)))
GREEN_RAMP = ((0.0, (18, 38, 30)), (0.5, (45, 122, 90)), (1.0, (110, 220, 170)))

Ramp = tuple[tuple[float, tuple[int, int, int]], ...]


def ramp_hex(position: Column, ramp: Ramp) -> Column:
    """Hex colour at a position in [0, 1]; null positions have none."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), position))

    def channel(i: int) -> Column:
        picked = None
        for (t0, c0), (t1, c1) in zip(ramp, ramp[1:], strict=False):
            share = (t - t0) / (t1 - t0)
            value = F.bround(F.lit(float(c0[i])) + share * float(c1[i] - c0[i]), 0).cast("int")
            picked = F.when(t <= t1, value) if picked is None else picked.when(t <= t1, value)
        return picked

    text = F.format_string("#%02x%02x%02x", channel(0), channel(1), channel(2))
    return F.when(position.isNotNull(), text)

"""Expressions on times, intervals and opacity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def duration(start: Column, end: Column) -> Column:
    return end - start


def contains(ms: Column, start: Column, end: Column) -> Column:
    return (ms >= start) & (ms < end)


def smoothstep(x: Column) -> Column:
    x = F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    return x * x * (3 - 2 * x)


def centred_fade(ms: Column, start: Column, end: Column | None, transition: int) -> Column:
    """Ramps of `transition` ms centred on both edges; an open end (null) doesn't fade; hard edges without a transition."""
    inside = ms >= start if end is None else (ms >= start) & (ms < F.coalesce(end, ms + 1))
    if transition <= 0:
        return F.when(inside, 1.0).otherwise(0.0)
    half, whole = transition / 2, float(max(1, transition))
    up = smoothstep((ms - start + half) / whole)
    return up if end is None else F.least(up, F.when(end.isNull(), 1.0).otherwise(smoothstep((end + half - ms) / whole)))


def overlay_visible(ms: Column, enabled: Column, start: Column, end: Column) -> Column:
    """Hard edges; no end when it is 0 or less."""
    return enabled & (ms >= start) & ((end <= 0) | (ms < end))


def overlay_opacity(ms: Column, enabled: Column, start: Column, end: Column, transition: int) -> Column:
    """0 when disabled, 1 for the whole video, else faded at its edges."""
    return F.when(~enabled, 0.0).when((start <= 0) & (end <= 0), 1.0).otherwise(centred_fade(ms, start, F.when(end > 0, end), transition))


def segment_opacity(ms: Column, start: Column, end: Column, before: Column, after: Column, transition: int) -> Column:
    """Opacity of a caption with the gaps to its neighbours (null: none). A ramp is centred on the edge where the gap has room for it, inside otherwise."""
    if transition <= 0:
        return F.when(contains(ms, start, end), 1.0).otherwise(0.0)
    half = transition / 2
    room_before = before.isNull() | (before >= int(half))
    room_after = after.isNull() | (after >= int(half))
    a, b = F.when(room_before, start - half).otherwise(start.cast("double")), start + half
    c, d = end - half, F.when(room_after, end + half).otherwise(end.cast("double"))
    return F.least(smoothstep((ms - a) / F.greatest(b - a, F.lit(1.0))), smoothstep((d - ms) / F.greatest(d - c, F.lit(1.0))))


def alpha_byte(a: Column) -> Column:
    return (a * 255 + 0.5).cast("int")


def rise(alpha: Column, distance: Column) -> Column:
    return distance * (1 - alpha)


def pixel_rect(box: Column, width: int, height: int) -> Column:
    """A box of canvas fractions in pixels; null when it is under a pixel wide or high."""
    w, h = box["w"] * width, box["h"] * height
    return F.when((w >= 1) & (h >= 1), F.struct((box["x"] * width).alias("x"), (box["y"] * height).alias("y"), w.alias("w"), h.alias("h")))


def even(n: Column) -> Column:
    """An even canvas dimension, 2 at least."""
    return F.greatest(n - n % 2, F.lit(2))


def x_to_time(x: Column, width: Column, duration_ms: Column) -> Column:
    """The time at a pixel of a timeline, which is a pixel wide at least; pixels outside are its ends."""
    share = F.least(F.greatest(x.cast("double") / F.greatest(width, F.lit(1)), F.lit(0.0)), F.lit(1.0))
    return F.floor(share * duration_ms).cast("bigint")


def time_to_x(ms: Column, width: Column, duration_ms: Column) -> Column:
    return F.when(duration_ms <= 0, 0.0).otherwise(ms * width / duration_ms)

"""Numbers of detections and frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FALLBACK_FPS = 25.0
LEAST_INTERVAL = 0.2


#: Splits a double into two halves of its digits.
_SPLIT = float((1 << 27) + 1)


def _halves(x: Column) -> tuple[Column, Column]:
    high = x * _SPLIT - (x * _SPLIT - x)
    return high, x - high


def rounded(x: Column, places: int, in_lambda: bool = False) -> Column:
    """x rounded to so many places (8 at most) by its exact binary value; halves, which are rare there, to even.

    2.675 lies below the middle of 2.67 and 2.68 and becomes 2.67, which bround and round, going by the printed digits,
    miss. The scaled value and what it lost are two doubles, whose sum is exact. NaN and values too large for digits
    after the point stay. in_lambda: the same value by a form that needs x in few places, as a lambda evaluates each of
    them anew. Over rows the longer form was faster: the short one made code of 21 KB, which Java doesn't compile.
    """
    scale, one = 10.0**places, F.abs(x)
    high, low = _halves(one)
    product = one * scale
    lost = (high * scale - product) + low * scale
    if in_lambda:
        # what was lost decides halves alone; any other value rounds the same way without it
        half = F.signum(x) * F.rint(product + F.signum(lost) * 0.5)
        scaled = (x + 0.0) * scale  # -0.0 becomes 0.0
        plain = F.rint(scaled)
        found = F.when(F.abs(scaled - plain) == 0.5, half).otherwise(plain) / scale
        return F.when(one >= float(1 << 52) / scale, x).otherwise(found)  # NaN is larger than any number to Spark
    whole = F.floor(product).cast("double")
    over = product - whole - 0.5
    up = (over > 0) | ((over == 0) & ((lost > 0) | ((lost == 0) & (whole % 2 == 1))))
    found = (whole + F.when(up, 1.0).otherwise(0.0)) / scale
    return F.when(F.isnan(x) | (one >= float(1 << 52) / scale), x).otherwise(F.when(x < 0, -found).otherwise(found))


def combined_confidence(detector: Column, classifier: Column, in_lambda: bool = False) -> Column:
    return rounded(F.least(detector, classifier), 3, in_lambda)


def effective_fps(reported: Column) -> Column:
    return F.when(reported.isNull() | (reported == 0), F.lit(FALLBACK_FPS)).otherwise(reported.cast("double"))


def frame_step(fps: Column, interval: Column) -> Column:
    """Frames from one sample to the next: whole, 1 at least."""
    return F.greatest(F.lit(1), (fps * F.greatest(F.lit(LEAST_INTERVAL), interval)).cast("int"))


def frame_time(index: Column, fps: Column, in_lambda: bool = False) -> Column:
    return rounded(index / fps, 2, in_lambda)


def clipped(box: Column, width: Column, height: Column) -> Column:
    """Corners of the box within the image; a box outside has x2 < x1 or y2 < y1."""
    return F.struct(
        F.greatest(F.lit(0), box["x"]).alias("x1"),
        F.greatest(F.lit(0), box["y"]).alias("y1"),
        F.least(width, box["x"] + box["width"]).alias("x2"),
        F.least(height, box["y"] + box["height"]).alias("y2"),
    )


def corners(box: Column) -> Column:
    """Unclipped corners, and the top of the label above the box."""
    return F.struct(
        box["x"].alias("x1"), box["y"].alias("y1"), (box["x"] + box["width"]).alias("x2"), (box["y"] + box["height"]).alias("y2"),
        F.greatest(F.lit(0), box["y"] - 24).alias("label_y"),
    )

"""Boxes, tiles and small gray frames as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_bbox(text: Column) -> Column:
    """First four numbers of a comma-separated string; anything less is the whole frame."""
    numbers = F.filter(F.transform(F.split(F.regexp_replace(text, r"[\[\]()\s]", ""), ","), lambda x: x.try_cast("double")), lambda x: x.isNotNull())
    return F.when(F.size(numbers) >= 4, F.slice(numbers, 1, 4)).otherwise(F.array(*[F.lit(float(x)) for x in (0, 0, 1, 1)]))


def clamp_bbox(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, padding: float = 0.0, extra: int = 4) -> Column:
    """Pixel box inside the frame. Values up to 1.5 are shares of the frame; corners may come in any order; the box is
    padded by a share of its size and `extra` pixels, and is one pixel at least."""
    share = F.greatest(F.abs(x0), F.abs(y0), F.abs(x1), F.abs(y1)) <= 1.5
    scaled = [F.when(share, v * size).otherwise(v) for v, size in ((x0, width), (y0, height), (x1, width), (y1, height))]
    left, right = F.least(scaled[0], scaled[2]), F.greatest(scaled[0], scaled[2])
    top, bottom = F.least(scaled[1], scaled[3]), F.greatest(scaled[1], scaled[3])
    px, py = (right - left) * padding + extra, (bottom - top) * padding + extra
    a, b = F.greatest(F.lit(0.0), left - px).cast("int"), F.greatest(F.lit(0.0), top - py).cast("int")
    c, d = F.least(width, right + px).cast("int"), F.least(height, bottom + py).cast("int")
    c, d = F.when(c <= a, F.least(width, a + 1)).otherwise(c), F.when(d <= b, F.least(height, b + 1)).otherwise(d)
    return F.struct(a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1"))


def near(a: Column, b: Column, margin: float = 0.04) -> Column:
    """Whether two normalized boxes (arrays of four) touch once both are widened by the margin."""
    return (a[0] - margin <= b[2]) & (b[0] - margin <= a[2]) & (a[1] - margin <= b[3]) & (b[1] - margin <= a[3])


def union_bbox(a: Column, b: Column) -> Column:
    return F.array(F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3]))


def tile_plan(height: Column, tile: int = 1100, overlap: float = 0.18) -> Column:
    """Start rows of overlapping tiles; the first tile that reaches the bottom is the last."""
    step = max(1, int(tile * (1 - overlap)))
    last = F.greatest(F.lit(0), F.ceil((height - tile) / step).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.struct((k * step).alias("y0"), F.least(height, k * step + tile).alias("y1")))


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: acc + x) / F.size(values)


def spread(values: Column) -> Column:
    """Population standard deviation, from whole-number sums."""
    total = F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: acc + x)
    squares = F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: acc + x * x)
    n = F.size(values)
    return F.sqrt(F.greatest(F.lit(0.0), (squares * n - total * total) / (n * n)))


def changed(a: Column, b: Column, delta: int = 18) -> Column:
    """Per pixel, 1 where two frames differ by more than delta."""
    return F.zip_with(a, b, lambda x, y: (F.abs(x - y) > delta).cast("int"))


def mean_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference of two equal-sized patches."""
    return mean(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def full_image_size(width: Column, height: Column, limit: int) -> Column:
    """width, height, scale of a whole image whose long side is cut to limit (0: any size)."""
    long_side = F.greatest(width, height)
    scale = F.when(F.lit(limit <= 0) | (long_side <= limit), F.lit(1.0)).otherwise(F.lit(float(limit)) / long_side)
    return F.struct((width * scale).cast("int").alias("width"), (height * scale).cast("int").alias("height"), scale.alias("scale"))


def small_size(width: Column, height: Column, most: int = 960) -> Column:
    """width, height of the small gray frame that frames are compared in: `most` wide at most."""
    scale = F.least(F.lit(1.0), F.lit(float(most)) / width)
    return F.struct(F.greatest(F.lit(1), (width * scale).cast("int")).alias("width"), F.greatest(F.lit(1), (height * scale).cast("int")).alias("height"))


def upscale_factor(width: Column, height: Column, most_pixels: int, least_height: int = 96) -> Column:
    """By how much a crop lower than least_height is enlarged: three times at most, and never beyond most_pixels; else 1."""
    wanted = F.when(height < least_height, F.least(F.lit(3.0), F.lit(float(least_height)) / F.greatest(F.lit(1), height))).otherwise(F.lit(1.0))
    fits = F.when(width * height * wanted * wanted > most_pixels, F.greatest(F.lit(1.0), F.sqrt(F.lit(float(most_pixels)) / (width * height)))).otherwise(wanted)
    return F.when(fits <= 1.001, F.lit(1.0)).otherwise(fits)

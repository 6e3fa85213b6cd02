"""Sizes and layout of images and pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _nearest(side: Column, error) -> Column:
    """Of the whole numbers next to side the one with less error (of equal ones the lower), at least 1."""
    low, high = F.floor(side), F.ceil(side)
    return F.greatest(F.lit(1), F.when((low == 0) | (error(low) <= error(high)), low).otherwise(high))


def thumbnail(w: Column, h: Column, max_w: Column, max_h: Column) -> Column:
    """Fit inside the limits (0: none) without enlarging; the bound side is exact, the other next to it so that the aspect is nearest."""
    lw, lh = F.when(max_w > 0, F.least(max_w, w)).otherwise(w), F.when(max_h > 0, F.least(max_h, h)).otherwise(h)
    aspect = w.cast("double") / h
    by_height = lw.cast("double") / lh >= aspect
    width = F.when(by_height, _nearest(lh * aspect, lambda n: F.abs(aspect - n.cast("double") / lh))).otherwise(lw)
    height = F.when(by_height, lh).otherwise(_nearest(lw / aspect, lambda n: F.abs(aspect - lw.cast("double") / n)))
    whole = (lw >= w) & (lh >= h)
    return F.struct(F.when(whole, w).otherwise(width).cast("long").alias("width"), F.when(whole, h).otherwise(height).cast("long").alias("height"))


def a4_layout(w: Column, h: Column, orientation: Column, margin_mm: Column, dpi: int = 150) -> Column:
    """Page size, and size and place of an image that fills an A4 page within its margins, centred."""
    landscape = (orientation == "landscape") | ((orientation == "auto") & (w > h))
    page_w, page_h = F.when(landscape, 1754).otherwise(1240), F.when(landscape, 1240).otherwise(1754)
    margin = F.bround(F.greatest(F.lit(0), F.least(F.lit(30), margin_mm)) / 25.4 * dpi).cast("long")
    room_w, room_h = page_w - 2 * margin, page_h - 2 * margin
    by_width = room_w * h <= room_h * w
    width = F.when(by_width, room_w).otherwise(F.greatest(F.lit(1), F.bround(w * room_h / h))).cast("long")
    height = F.when(by_width, F.greatest(F.lit(1), F.bround(h * room_w / w))).otherwise(room_h).cast("long")
    return F.struct(page_w.cast("long").alias("page_width"), page_h.cast("long").alias("page_height"), width.alias("width"), height.alias("height"), F.floor((page_w - width) / 2).alias("x"), F.floor((page_h - height) / 2).alias("y"))


def page_layout(w: Column, h: Column, page_size: Column, orientation: Column, margin_mm: Column, dpi: int = 150) -> Column:
    """As a4_layout, but with page size original the page is the image itself."""
    own = F.struct(w.cast("long").alias("page_width"), h.cast("long").alias("page_height"), w.cast("long").alias("width"), h.cast("long").alias("height"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))
    return F.when(page_size == "original", own).otherwise(a4_layout(w, h, orientation, margin_mm, dpi))


def render_size(points: Column, dpi: Column) -> Column:
    return F.ceil(points * dpi / 72).cast("long")


def upscaled(w: Column, h: Column, scale: Column) -> Column:
    return F.struct((w * scale).alias("width"), (h * scale).alias("height"))


def mask_size(w: Column, h: Column, side: int = 512) -> Column:
    """Size for the mask model: at most side, cut down to whole pixels."""
    longest = F.greatest(w, h)

    def cut(x: Column) -> Column:
        return F.when(longest > side, F.floor(x * (F.lit(float(side)) / longest))).otherwise(x).cast("long")

    return F.struct(cut(w).alias("width"), cut(h).alias("height"))

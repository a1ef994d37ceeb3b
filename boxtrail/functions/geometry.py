"""Box arithmetic as column expressions; boxes are corner coordinates in pixels."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column


def box(prefix: str = "") -> Box:
    return Box(*[F.col(f"{prefix}{c}") for c in Box._fields])


def _span(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), b - a)


def area(b: Box) -> Column:
    return _span(b.x1, b.x2) * _span(b.y1, b.y2)


def intersection_area(a: Box, b: Box) -> Column:
    return _span(F.greatest(a.x1, b.x1), F.least(a.x2, b.x2)) * _span(F.greatest(a.y1, b.y1), F.least(a.y2, b.y2))


def iou(a: Box, b: Box) -> Column:
    """Overlap over union; 0 when boxes do not overlap or have no area."""
    both = intersection_area(a, b)
    union = area(a) + area(b) - both
    return F.when((both > 0) & (union > 0), both / union).otherwise(0.0)


def expand_box(b: Box, share_x: float, share_y: float) -> Box:
    """Scaled about the centre; negative shares count as 0."""
    cx, cy = (b.x1 + b.x2) * 0.5, (b.y1 + b.y2) * 0.5
    half_w = _span(b.x1, b.x2) * (1 + max(0.0, share_x)) * 0.5
    half_h = _span(b.y1, b.y2) * (1 + max(0.0, share_y)) * 0.5
    return Box(cx - half_w, cy - half_h, cx + half_w, cy + half_h)


def lower_body(b: Box, share: float) -> Box:
    share = min(1.0, max(0.01, share))
    return Box(b.x1, b.y2 - F.greatest(F.lit(1e-6), b.y2 - b.y1) * share, b.x2, b.y2)


def bottom_centre_in(b: Box, outer: Box) -> Column:
    return ((b.x1 + b.x2) * 0.5).between(outer.x1, outer.x2) & b.y2.between(outer.y1, outer.y2)


def on_motorcycle(person: Box, bike: Box, share_x: float, share_y: float, lower: float, overlap: float) -> Column:
    low, wide = lower_body(person, lower), expand_box(bike, share_x, share_y)
    return (area(low) > 0) & (intersection_area(low, wide) / F.nullif(area(low), F.lit(0.0)) >= overlap) & bottom_centre_in(person, wide)


def _side(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(1e-6), b - a)


def centre_motion(before: Box, now: Box) -> Column:
    """Way of the centre in shares of the earlier height."""
    dx = (now.x1 + now.x2) * 0.5 - (before.x1 + before.x2) * 0.5
    dy = (now.y1 + now.y2) * 0.5 - (before.y1 + before.y2) * 0.5
    return F.hypot(dx, dy) / _side(before.y1, before.y2)


def size_change(before: Box, now: Box) -> Column:
    was = _side(before.x1, before.x2) * _side(before.y1, before.y2)
    return F.abs(_side(now.x1, now.x2) * _side(now.y1, now.y2) - was) / F.greatest(was, F.lit(1e-6))


def is_still(before: Box, now: Box, least_iou: float, most_motion: float, most_change: float) -> Column:
    return (iou(before, now) >= least_iou) & (centre_motion(before, now) <= most_motion) & (size_change(before, now) <= most_change)


def same_place(a: Box, b: Box) -> Column:
    """Overlap of 0.15, or both centre offsets within 0.75 of the largest side (8 at least)."""
    scale = F.greatest(F.lit(8.0), a.x2 - a.x1, a.y2 - a.y1, b.x2 - b.x1, b.y2 - b.y1) * 0.75
    off = lambda p, q, r, s: F.abs((p + q) * 0.5 - (r + s) * 0.5)
    return (iou(a, b) >= 0.15) | ((off(a.x1, a.x2, b.x1, b.x2) <= scale) & (off(a.y1, a.y2, b.y1, b.y2) <= scale))


def from_centre(cx: Column, cy: Column, w: Column, h: Column) -> Box:
    half_w, half_h = F.greatest(w, F.lit(0.0)) * 0.5, F.greatest(h, F.lit(0.0)) * 0.5
    return Box(cx - half_w, cy - half_h, cx + half_w, cy + half_h)


def letterbox(width: Column, height: Column, to_w: int, to_h: int) -> dict[str, Column]:
    """Layout of a frame scaled to fit and centred: size, pads, offsets and gains back to frame pixels."""
    scale = F.least(F.lit(float(to_w)) / width, F.lit(float(to_h)) / height)
    nw, nh = (F.greatest(F.lit(1), F.bround(x * scale).cast("int")) for x in (width, height))
    pad_x, pad_y = (F.floor((F.lit(t) - n) / 2).cast("int") for t, n in ((to_w, nw), (to_h, nh)))
    back_x, back_y = width / nw, height / nh
    return {
        "nw": nw, "nh": nh, "pad_x": pad_x, "pad_y": pad_y,
        "ox": -pad_x * back_x, "oy": -pad_y * back_y, "gain_x": to_w * back_x, "gain_y": to_h * back_y,
    }


def unletterbox(b: Box, ox: Column, oy: Column, gain_x: Column, gain_y: Column) -> Box:
    return Box(b.x1 * gain_x + ox, b.y1 * gain_y + oy, b.x2 * gain_x + ox, b.y2 * gain_y + oy)


def clamp_box(b: Box, width: Column, height: Column) -> Box:
    """Cut to whole pixels inside the frame; callers drop boxes that became empty."""
    inside = lambda v, side: F.greatest(F.lit(0), F.least(side - 1, v.cast("int"))).cast("int")
    return Box(inside(b.x1, width), inside(b.y1, height), inside(b.x2, width), inside(b.y2, height))


def padded_crop(b: Box, width: Column, height: Column, margin: float) -> Box:
    pad_x, pad_y = (F.greatest(F.lit(1.0), d) * margin for d in (b.x2 - b.x1, b.y2 - b.y1))
    return Box(
        F.greatest(F.lit(0), F.floor(b.x1 - pad_x)).cast("int"),
        F.greatest(F.lit(0), F.floor(b.y1 - pad_y)).cast("int"),
        F.least(width, F.ceil(b.x2 + pad_x)).cast("int"),
        F.least(height, F.ceil(b.y2 + pad_y)).cast("int"),
    )


def not_empty(b: Box) -> Column:
    return (b.x2 > b.x1) & (b.y2 > b.y1)

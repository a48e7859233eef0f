"""Boxes, corner anchors and page transforms as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradewright.functions.numeric import col_of
from gradewright.settings import DEFAULTS, Thresholds

CORNERS = ("TL", "TR", "BL", "BR")


def side(box, name: str) -> Column:
    return F.coalesce(col_of(box)[name], F.lit(0.0))


def make_box(x, y, w, h) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def expand_box(box, cfg: Thresholds = DEFAULTS, by: int | None = None) -> Column:
    e = cfg.expand_px if by is None else by
    return make_box(side(box, "x") - e, side(box, "y") - e, side(box, "w") + 2 * e, side(box, "h") + 2 * e)


def _whole(value: Column) -> Column:
    # half to even, as whole pixels
    return F.bround(value, 0).cast("int")


def clip_box(box, page_w, page_h) -> Column:
    """Whole-pixel box inside the page; null when nothing is left."""
    pw, ph = col_of(page_w), col_of(page_h)
    x = F.least(F.greatest(F.lit(0), _whole(side(box, "x"))), pw - 1)
    y = F.least(F.greatest(F.lit(0), _whole(side(box, "y"))), ph - 1)
    w = F.least(_whole(side(box, "w")), pw - x)
    h = F.least(_whole(side(box, "h")), ph - y)
    return F.when((w > 0) & (h > 0), make_box(x, y, w, h))


def inset_box(box, page_w, page_h, cfg: Thresholds = DEFAULTS, by: int | None = None) -> Column:
    """Box without its printed border; null when the border is all there is."""
    i = cfg.border_inset_px if by is None else by
    pw, ph = col_of(page_w), col_of(page_h)
    bx, by_ = _whole(side(box, "x")), _whole(side(box, "y"))
    bw, bh = _whole(side(box, "w")), _whole(side(box, "h"))
    x1 = F.greatest(F.lit(0), F.least(bx + i, pw - 1))
    y1 = F.greatest(F.lit(0), F.least(by_ + i, ph - 1))
    x2, y2 = F.least(bx + bw - i, pw), F.least(by_ + bh - i, ph)
    return F.when((x2 > x1) & (y2 > y1), make_box(x1, y1, x2 - x1, y2 - y1))


def number_region(boxes, cfg: Thresholds = DEFAULTS) -> Column:
    """Bounding box of all digit boxes plus a margin."""
    b, pad = col_of(boxes), cfg.number_region_pad
    left = F.array_min(F.transform(b, lambda d: d["x"])) - pad
    top = F.array_min(F.transform(b, lambda d: d["y"])) - pad
    right = F.array_max(F.transform(b, lambda d: d["x"] + d["w"])) + pad
    bottom = F.array_max(F.transform(b, lambda d: d["y"] + d["h"])) + pad
    return F.when(F.size(b) > 0, make_box(left, top, right - left, bottom - top))


def anchor_centre(anchor) -> Column:
    """Centre of an anchor written either as ``center{x,y}`` or as ``x,y``."""
    a = col_of(anchor)
    nested = a["center"].isNotNull()
    return F.struct(
        F.when(nested, F.coalesce(a["center"]["x"], F.lit(0.0))).otherwise(F.coalesce(a["x"], F.lit(0.0))).alias("x"),
        F.when(nested, F.coalesce(a["center"]["y"], F.lit(0.0))).otherwise(F.coalesce(a["y"], F.lit(0.0))).alias("y"),
    )


def complete_corners(corners: dict[str, Column]) -> dict[str, Column]:
    """Fill one missing corner from the other three (parallelogram)."""
    # corner -> (neighbour, neighbour, opposite)
    around = {
        "TL": ("TR", "BL", "BR"),
        "TR": ("TL", "BR", "BL"),
        "BR": ("BL", "TR", "TL"),
        "BL": ("BR", "TL", "TR"),
    }

    def estimate(name: str) -> Column:
        p, q, r = (corners[c] for c in around[name])
        known = p.isNotNull() & q.isNotNull() & r.isNotNull()
        point = F.struct((p["x"] + q["x"] - r["x"]).alias("x"), (p["y"] + q["y"] - r["y"]).alias("y"))
        return F.when(known, point)

    return {name: F.coalesce(corners[name], estimate(name)) for name in CORNERS}


def apply_transform(matrix, x: Column, y: Column) -> Column:
    """Map a point with a 3x3 matrix given as nine doubles, rounded to pixels."""
    m = col_of(matrix)
    depth = m[6] * x + m[7] * y + m[8]
    depth = F.nullif(depth, F.lit(0.0))
    return F.struct(
        F.coalesce(_whole((m[0] * x + m[1] * y + m[2]) / depth), F.lit(0)).alias("x"),
        F.coalesce(_whole((m[3] * x + m[4] * y + m[5]) / depth), F.lit(0)).alias("y"),
    )


def transform_box(matrix, box) -> Column:
    """Corners of a box in scan pixels."""
    x, y = side(box, "x"), side(box, "y")
    a = apply_transform(matrix, x, y)
    b = apply_transform(matrix, x + side(box, "w"), y + side(box, "h"))
    return F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))


def scale_matrix(scale_x: Column, scale_y: Column, off_x: Column | None = None, off_y: Column | None = None) -> Column:
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(
        scale_x, zero, off_x if off_x is not None else zero,
        zero, scale_y, off_y if off_y is not None else zero,
        zero, zero, one,
    )

"""Box geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .shared import let

BOX = "struct<x1:bigint,y1:bigint,x2:bigint,y2:bigint>"
CORNERS = ("x1", "y1", "x2", "y2")


def make_box(x1, y1, x2, y2) -> Column:
    parts = zip(CORNERS, (x1, y1, x2, y2))
    return F.struct(*[c.cast("bigint").alias(n) for n, c in parts])


def ordered_box(x1, y1, x2, y2) -> Column:
    """Box whose first corner is the upper left one."""
    return make_box(F.least(x1, x2), F.least(y1, y2), F.greatest(x1, x2), F.greatest(y1, y2))


def box_or_null(box: Column) -> Column:
    """The box when all four corners are known."""

    def whole(b):
        known = [b[n].isNotNull() for n in CORNERS]
        return F.when(known[0] & known[1] & known[2] & known[3], b)

    return let(box, whole)


def scaled(x: Column, size_in, size_out) -> Column:
    """Whole-number position of ``x`` after a change of scale, cut towards zero."""
    return (x.cast("double") / size_in.cast("double") * size_out.cast("double")).cast("bigint")


def unscaled(x: Column, resized, original) -> Column:
    ratio = resized.cast("double") / original.cast("double")
    return (x.cast("double") / ratio).cast("bigint")

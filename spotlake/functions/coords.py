"""Coordinate column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Where each of the eight square symmetries, by number, takes the point (x, y).
SYMMETRIES = (("x", "y"), ("y", "-x"), ("-x", "-y"), ("-y", "x"), ("-x", "y"), ("x", "-y"), ("y", "x"), ("-y", "-x"))


def dihedral(x: Column, y: Column, op: Column) -> tuple[Column, Column]:
    """The point moved by the symmetry ``op``; null for a number outside the table."""
    place = {"x": x, "y": y, "-x": -x, "-y": -y}
    table = F.array(*[F.struct(place[first].alias("x"), place[second].alias("y")) for first, second in SYMMETRIES])
    moved = F.get(table, op.cast("int"))
    return moved["x"], moved["y"]


def in_canvas(lo: Column, hi: Column, size: Column, tolerance: float = 224.0) -> Column:
    """True when the projected range stays inside ``[-tolerance, size + tolerance]``."""
    return (lo >= F.lit(-tolerance)) & (hi <= size + F.lit(tolerance))

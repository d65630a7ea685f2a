"""Anatomical axis codes: which source axis becomes which target axis, and which way round."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TARGET = ("LR", "AP", "FH")
#: Both directions of each axis.
AXES = {"LR": ("LR", "RL"), "AP": ("AP", "PA"), "FH": ("FH", "HF")}


def axis_of(code: Column) -> Column:
    """LR, AP or FH; another code is an error."""
    out = None
    for axis, codes in AXES.items():
        hit = F.upper(code).isin(*codes)
        out = F.when(hit, axis) if out is None else out.when(hit, axis)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown axis code "), F.coalesce(code, F.lit("null")))))


def is_flipped(code: Column, target: str) -> Column:
    """Same axis, other direction."""
    return (axis_of(code) == target) & (F.upper(code) != target)


def oriented_index(order: Column, dims: Column, index: tuple[str, str, str], target: str) -> Column:
    """The coordinate along a target axis from source coordinates, with the source's axis codes and sizes."""
    out = F.lit(None).cast("int")
    for n, name in enumerate(index):
        code = order[n]
        at = F.when(is_flipped(code, target), dims[n] - 1 - F.col(name)).otherwise(F.col(name))
        out = F.when(axis_of(code) == target, at).otherwise(out)
    return out


def oriented_component(order: Column, parts: tuple[str, str, str], target: str, signed: bool = True) -> Column:
    """A vector's component along a target axis; with a sign it turns with the axis, a spread does not."""
    out = F.lit(None).cast("double")
    for n, name in enumerate(parts):
        code, value = order[n], F.col(name).cast("double")
        own = F.when(is_flipped(code, target), -value).otherwise(value) if signed else value
        out = F.when(axis_of(code) == target, own).otherwise(out)
    return out

"""Transforms of channels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import asinh_scaled, rev_asinh
from ..table import Selector, columns, is_numeric, q


def transform(df: DataFrame, channels: Selector = None, fun: Callable[[Column], Column] | None = None) -> DataFrame:
    """Replaces each channel by fun of it."""
    if not callable(fun):
        raise TypeError("fun must be a function of a column")
    return df.withColumns({c: fun(q(c)) for c in columns(df, channels, is_numeric)})


def preprocess(
    df: DataFrame, channels: Selector = None, undo_noise: bool = False, fun: Callable[[Column], Column] = asinh_scaled
) -> DataFrame:
    """Removes the noise that acquisition adds (undo_noise: next whole number above), then applies fun."""
    step = (lambda c: fun(F.floor(c) + 1)) if undo_noise else fun
    return transform(df, channels, step)


def postprocess(
    df: DataFrame, channels: Selector = None, redo_noise: bool = False, fun: Callable[[Column], Column] = rev_asinh, seed: int = 0
) -> DataFrame:
    """Applies fun, by default the inverse of preprocess, then takes a uniform number off (redo_noise)."""
    names = columns(df, channels, is_numeric)
    out = transform(df, names, fun)
    if redo_noise:
        out = out.withColumns({c: q(c) - F.rand(seed + k) for k, c in enumerate(names)})
    return out

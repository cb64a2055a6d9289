"""Vectors of floats as vectors of integers, for operators whose results must not depend on the order of a sum."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Components that a block of rows holds at most (16 MB of them), however small the batches of the session are.
BLOCK = 2_000_000


def blocks(frames: Iterator[pd.DataFrame], column: str, size: int) -> Iterator[pd.DataFrame]:
    """The rows of ``frames`` in blocks of up to ``BLOCK`` components, so that what a block costs besides its rows counts little."""
    held, n = [], 0
    for frame in frames:
        frame = frame[[x is not None and len(x) == size for x in frame[column]]]
        held.append(frame)
        n += len(frame)
        if n * size >= BLOCK:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if n:
        yield pd.concat(held, ignore_index=True)


def scaled(frames: Iterator[pd.DataFrame], column: str, size: int, scale: int) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Blocks of the rows whose vector has ``size`` components, none of them null or non-finite, with floor(scale * component) as an integer array.

    Squared distances of such vectors must fit a signed 64-bit integer; a component too large for that is an OverflowError, never a wrong number."""
    for frame in blocks(frames, column, size):
        x = np.concatenate(frame[column].tolist()).astype(np.float64).reshape(-1, size)
        good = np.isfinite(x).all(axis=1)
        if not good.all():
            frame, x = frame[good], x[good]
        if len(x):
            x = np.floor(x * scale)
            if size * (2 * np.abs(x).max()) ** 2 >= 2.0**63:
                raise OverflowError(f"a component of {column!r} is too large for 64-bit squared distances")
            yield frame, x.astype(np.int64)


def ids_of(name: str = "vec_id") -> tuple[Column, Column]:
    """Two columns that carry a nullable 64-bit id through pandas without loss (which turns such columns into floats): the id or 0, and whether it is null."""
    return F.coalesce(F.col(name).cast("bigint"), F.lit(0)).alias("id"), F.col(name).isNull().alias("no_id")


def ids(frame: pd.DataFrame) -> pd.arrays.IntegerArray:
    """The ids of a frame with the columns of :func:`ids_of`."""
    return pd.arrays.IntegerArray(frame["id"].to_numpy(np.int64), frame["no_id"].to_numpy(bool))

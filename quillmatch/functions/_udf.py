"""Arrow-batched functions that are built when they are used, so that modules import without a session."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: Bytes of input that a function sees at once, apart from a single longer value.
PIECE_BYTES = 1 << 20


def pieces(values: pa.Array, limit: int = PIECE_BYTES) -> Iterator[pa.Array]:
    """An Arrow array cut into slices of at most ``limit`` bytes or one value."""
    if len(values) > 1 and values.nbytes > limit:
        half = len(values) // 2
        yield from pieces(values[:half], limit)
        yield from pieces(values[half:], limit)
    elif len(values):
        yield values


def _as_arrow(out: pd.Series | pd.DataFrame, kind: pa.DataType) -> pa.Array:
    if isinstance(out, pd.DataFrame):
        return pa.StructArray.from_arrays([pa.array(out[f.name], type=f.type, from_pandas=True) for f in kind], fields=list(kind))
    return pa.array(out, type=kind, from_pandas=True)


def arrow(returns: str):
    """Like an iterator ``pandas_udf`` of one column, but bound to Spark at each call and in pieces of bounded size.

    Spark bounds the rows of an Arrow batch, not their bytes; whole batches as
    Python objects, in and out, are several times their size.
    """

    def wrap(f):
        @functools.wraps(f)
        def call(column):
            kind = to_arrow_type(DataType.fromDDL(returns))

            def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
                for out in f(piece.to_pandas() for batch in batches for piece in pieces(batch)):
                    yield _as_arrow(out, kind)

            return F.arrow_udf(run, returns)(column)

        return call

    return wrap

"""Batches in slices, so that what Python makes of a batch at once is bounded by bytes, not by rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa

#: Bytes of input that a slice has on average.
SLICE_BYTES = 1 << 20


def slices(batch: pa.Array | pa.RecordBatch, most: int | None = None) -> Iterator[pa.Array | pa.RecordBatch]:
    """The rows of a batch or column in order, in slices of about ``most`` bytes, one row at least."""
    step = max(len(batch) * (most or SLICE_BYTES) // max(batch.nbytes, 1), 1)
    for at in range(0, len(batch), step):
        yield batch.slice(at, step)


def by_slices(run: Callable[[pa.Array], pa.Array]) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    """A function on a stream of columns, for ``arrow_udf``, from one that handles a column."""

    def apply(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            if not len(column):
                yield run(column)
            for part in slices(column):
                yield run(part)

    return apply

"""Arrow batches in slices of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 8 << 20


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Batches of at most about ``SLICE_BYTES`` of the column, or of one row: what a task turns into objects."""
    for batch in batches:
        start, held = 0, 0
        for row, size in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
            if held and held + (size or 0) > SLICE_BYTES:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size or 0
        yield batch.slice(start)

"""Arrow batches in slices of bounded size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text, and rows, that a task handles at a time. A single longer text is handled alone.
SLICE_BYTES, SLICE_ROWS = 2_000_000, 2000


def slices(batches: Iterable[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The rows of all batches, in slices whose texts have at most SLICE_BYTES bytes together."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, before + SLICE_BYTES, side="right"))
            stop = max(start + 1, min(stop, start + SLICE_ROWS))
            yield batch.slice(start, stop - start)
            start = stop

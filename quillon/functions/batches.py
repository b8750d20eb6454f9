"""Arrow batches of texts, in parts of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Rows of an Arrow batch are handed on in parts of about this many characters, so that a batch of
#: very long texts does not multiply in memory.
PART_CHARS = 4 << 20


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    """A string column with null as the empty string."""
    return [x or "" for x in batch.column(name).to_pylist()]


def parts(batch: pa.RecordBatch, *names: str) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about PART_CHARS bytes of the named string columns."""
    if sum(batch.column(n).nbytes for n in names) <= PART_CHARS:
        yield batch
        return
    sizes = [sum(x) for x in zip(*(pc.fill_null(pc.binary_length(batch.column(n)), 0).to_pylist() for n in names))]
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > PART_CHARS:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    yield batch.slice(start)

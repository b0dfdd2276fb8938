"""Arrow-batch helpers shared by the operators that run Python kernels."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one kernel step holds at once; a longer single text is a step of its own.
STEP_BYTES = 4 << 20


def steps(batches: Iterator[pa.RecordBatch], text: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of each piece stay near ``most`` bytes."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        begin = total = 0
        for at, size in enumerate(sizes):
            if total and total + size > most:
                yield batch.slice(begin, at - begin)
                begin, total = at, 0
            total += size
        if begin < len(sizes):
            yield batch.slice(begin)


def utf8(column: pa.Array) -> list[bytes]:
    """The column's texts as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]

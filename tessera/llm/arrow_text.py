"""Texts of Arrow batches as bytes, in slices of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def text_bytes(text: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, UTF-8 bytes) of texts without nulls."""
    at = np.frombuffer(text.buffers()[1], np.int32, len(text) + 1, 4 * text.offset) if len(text) else np.zeros(1, np.int32)
    size = int(at[-1] - at[0])
    data = np.frombuffer(text.buffers()[2], np.uint8, size, int(at[0])) if size else np.zeros(0, np.uint8)
    return (at - at[0]).astype(np.int64), data


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batches cut where their texts pass another ``most`` bytes; one longer text is a slice of its own or ends one."""
    for batch in batches:
        size = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = np.flatnonzero(np.diff(size // most)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(size)]):
            if a < b:
                yield batch.slice(a, b - a)

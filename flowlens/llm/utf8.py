"""Texts as the UTF-8 bytes that Arrow holds, without a Python string for each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes by which a view of eight bytes may pass the end.
SLACK = 8


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds): text ``i`` is ``bytes[bounds[i]:bounds[i + 1]]``; a null text is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]

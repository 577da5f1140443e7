"""Cut Arrow batches by the size of their texts, so that memory doesn't follow the longest ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text (about) worked on at once; a longer text is one slice.
SLICE_BYTES = 4 << 20


def text_slices(texts: pa.Array, *, limit: int = SLICE_BYTES, rows: int = 4096) -> Iterator[tuple[int, int]]:
    """(first row, length) of slices with about ``limit`` bytes and at most ``rows`` rows."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    lo = 0
    upto = np.cumsum(size)
    while lo < len(size):
        base = upto[lo] - size[lo]
        hi = int(np.searchsorted(upto, base + limit, "right"))
        hi = min(max(hi, lo + 1), lo + rows, len(size))
        yield lo, hi - lo
        lo = hi

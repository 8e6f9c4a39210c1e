"""Batches of texts in parts of bounded bytes, so that what a worker makes of a part at once is bounded as well."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of a part; a single row may be larger.
MOST = 1 << 20


def bounds(sizes: list[int], most: int = MOST) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of rows with about ``most`` bytes together, a row at least."""
    start = held = 0
    for k, n in enumerate(sizes):
        if k > start and held + n > most:
            yield start, k
            start, held = k, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def by_parts(texts: pa.Array, make: Callable[..., list], kind: pa.DataType, *others: pa.Array, most: int = MOST) -> pa.Array:
    """What ``make`` gives for the lists of a part (``texts``, ``others``), put together; of ``kind``."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    made = [pa.array(make(*(x[a:b].to_pylist() for x in (texts, *others))), kind) for a, b in bounds(sizes, most)]
    return pa.concat_arrays(made) if made else pa.array([], kind)

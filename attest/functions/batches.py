"""Results of Python functions in pieces."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd

#: Elements (samples, bytes) of the results that a worker holds before it hands them on.
PIECE = 1 << 20


def in_pieces(values: Iterable, most: int = PIECE) -> Iterator[pd.Series]:
    """The values in series of about ``most`` elements: a batch of texts is small, what it becomes is not.

    A worker's memory counts beside the JVM's heap, so it never holds the results of a whole batch.
    """
    held, size = [], 0
    for value in values:
        held.append(value)
        size += len(value) if hasattr(value, "__len__") else 1
        if size >= most:
            yield pd.Series(held, dtype=object)
            held, size = [], 0
    if held:
        yield pd.Series(held, dtype=object)

"""What Python workers hold.

Spark keeps its workers between tasks and stages, and an executor that once ran two of them for each core keeps them all, also while it runs
stages without Python.  Their allocators keep what a task has freed: some 200 to 300 MB after a batch of 10,000 texts.  So batches are worked
on in slices, and a task ends by giving back what it freed.
"""

from __future__ import annotations

import ctypes

import pyarrow as pa

#: Bytes of a slice on average; a slice has one row at least.
SLICE = 1 << 22


def give_back() -> None:
    """Returns freed memory to the system, Arrow's and, where there is glibc, that of malloc."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def sliced(batches, most: int = SLICE):
    """The same rows in order, in slices of about ``most`` bytes; nothing is copied."""
    for whole in batches:
        rows = max(1, whole.num_rows * most // max(1, whole.nbytes))
        for a in range(0, whole.num_rows, rows):
            yield whole.slice(a, rows)


def thrifty(run, slices: bool = True):
    """``run`` over slices of its batches (with ``slices`` false, over the batches), which gives its memory back at the end."""

    def whole_task(batches):
        yield from run(sliced(batches) if slices else batches)
        give_back()

    return whole_task

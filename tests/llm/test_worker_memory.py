"""Python workers stay beside an executor's own memory: what a task has freed must not stay with them."""

import os
from pathlib import Path

from newsloom.llm._common import giving_back


def resident_mb():
    return int(Path("/proc/self/statm").read_text().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6


def test_freed_memory_goes_back():
    """100 MB in blocks of 50 kB, of which every hundredth lives on: freed space below those is kept by the C library until it is asked."""
    pins = []

    def run(batches):
        for batch in batches:
            blocks = [bytes(50_000) for _ in range(2_000)]
            pins.extend(blocks[::100])
            yield batch

    before = resident_mb()
    assert list(run([1])) == [1]
    assert resident_mb() - before > 60
    assert list(giving_back(run)([2, 3])) == [2, 3]
    assert resident_mb() - before < 40 and len(pins) == 60

"""Memory that tables written between stages give back."""

from __future__ import annotations

import re
from pathlib import Path

from siltstone.llm import store


def resident(pid: int) -> int:
    return int(re.search(r"VmRSS:\s+(\d+)", Path(f"/proc/{pid}/status").read_text())[1]) >> 10


def test_a_written_table_gives_free_native_memory_of_the_driver_back(spark):
    jvm = spark._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()
    # blocks of about 256 KB; those that stay keep malloc from giving the rest back by itself
    held = [jvm.java.util.zip.Deflater() for _ in range(1200)]
    for k, x in enumerate(held):
        if k % 100:
            x.end()
    full = resident(pid)
    store.spared(spark)
    free = full - resident(pid)
    for x in held[::100]:
        x.end()
    assert free > 100

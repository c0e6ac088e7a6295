"""What staged tables leave in the driver's process."""

import re
from pathlib import Path

import pytest

from fathom.plans.staging import Workspace


def test_a_staged_table_gives_back_the_drivers_free_native_memory(spark):
    jvm = spark._jvm
    status = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/status")
    if not status.exists():
        pytest.skip("memory of a process can't be read here")
    resident = lambda: int(re.search(r"VmRSS:\s+(\d+)", status.read_text())[1]) / 1024
    space, small = Workspace(spark), spark.range(10)
    space.put("before", small)
    start = resident()
    text, room = jvm.java.nio.ByteBuffer.allocateDirect(1 << 17), jvm.java.nio.ByteBuffer.allocateDirect(1 << 17)
    packers = [jvm.java.util.zip.Deflater() for _ in range(1200)]  # some 268 KB of native memory each
    for p in packers:
        p.setInput(text.duplicate())
        p.finish()
        p.deflate(room.duplicate())
    taken = resident() - start
    for p in packers[:-1]:  # the last one keeps the allocator from giving back the rest by itself
        p.end()
    kept = resident() - start
    space.put("after", small)
    assert [r.id for r in space.get("after").orderBy("id").collect()] == list(range(10))
    packers[-1].end()
    space.drop()
    assert taken > 150
    assert resident() - start < kept - 0.4 * taken, (taken, kept, resident() - start)

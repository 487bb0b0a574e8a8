"""How many transforms run at once on a machine, sampled anew for each, and how often progress is told."""

from __future__ import annotations

import errno
import os
import socket
import time
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MIB = 1 << 20
# Budgets per task and reserves.
TASK_MIB, HINTED_TASK_MIB, HEAP_RESERVE_MIB, SYSTEM_RESERVE_MIB = 256, 64, 512, 1024
PROGRESS_SECONDS, PER_BATCH = 0.1, 40


def limit(cpus: int, total: int, free: int, heap_max: int, heap_used: int, hint: int | None = None) -> int:
    """Tasks that one machine bears, from bytes of memory; unknown memory allows one."""
    hint = hint if hint and hint > 0 else None
    cost = (HINTED_TASK_MIB if hint else TASK_MIB) * MIB
    heap = max(1, (heap_max - heap_used - max(HEAP_RESERVE_MIB * MIB, heap_max // 4)) // cost)
    known = total > 0 and free >= 0
    physical = max(1, (min(free, total) - max(SYSTEM_RESERVE_MIB * MIB, total // 10)) // cost) if known else 1
    return min(max(1, cpus - 1), heap, physical, hint or 1 << 31)


def limit_column(cpus: Column, total: Column, free: Column, heap_max: Column, heap_used: Column, hint: Column | None = None) -> Column:
    """limit() over a table of machines; a null or non-positive hint is none."""
    hint = F.when(hint > 0, hint) if hint is not None else F.lit(None).cast("long")
    cost = F.when(hint.isNull(), F.lit(TASK_MIB * MIB)).otherwise(F.lit(HINTED_TASK_MIB * MIB)).cast("double")
    jobs = lambda room: F.greatest(F.floor(room / cost), F.lit(1)).cast("long")
    heap = jobs(heap_max - heap_used - F.greatest(F.lit(HEAP_RESERVE_MIB * MIB), F.floor(heap_max / 4)))
    physical = jobs(F.least(free, total) - F.greatest(F.lit(SYSTEM_RESERVE_MIB * MIB), F.floor(total / 10)))
    physical = F.when((total > 0) & (free >= 0), physical).otherwise(F.lit(1))
    return F.least(F.greatest(cpus - 1, F.lit(1)).cast("long"), heap, physical.cast("long"), hint.cast("long"))


def historical_limit(heap: int, cpus: int, used: int = 0) -> int:
    """The earlier formula, for comparison: twice the CPUs, bounded by the heap."""
    room = (heap - max(0, used) - max(HEAP_RESERVE_MIB * MIB, heap // 4)) // (TASK_MIB * MIB)
    return min(2 * max(1, cpus), max(1, room))


def partitions_for(units: int, cores: int, per_batch: int = PER_BATCH) -> int:
    """Spark partitions for so many families: batches, but at least what fills the cores."""
    return max(1, min(units, max(-(-units // per_batch), cores)))


def sample() -> dict[str, int]:
    """This machine now, as limit() takes it. A Python worker has no heap of its own: the machine's memory stands for it."""
    total, free = 0, -1
    try:
        with open("/proc/meminfo", encoding="ascii") as f:
            known = {k: int(v.split()[0]) << 10 for k, _, v in (line.partition(":") for line in f)}
        total, free = known.get("MemTotal", 0), known.get("MemAvailable", -1)
    except OSError:
        pass
    return {"cpus": os.cpu_count() or 1, "total": total, "free": free, "heap_max": total, "heap_used": max(0, total - max(0, free))}


class Admission:
    """Lets as many transforms run at once on a machine as limit() says, sampled anew until there is room. Workers are processes of their
    own, so a permit is a name that one process at a time can hold on a machine: that of a socket without a file. A worker that dies
    gives its permit back."""

    WAIT = 0.05

    def __init__(self, hint: int | None = None, sampler: Callable[[], dict[str, int]] = sample, name: str = "quarry-permit") -> None:
        self.hint, self.sampler, self.name = hint, sampler, f"\0{name}-{os.getuid()}-"
        self.held: socket.socket | None = None

    def __enter__(self) -> Admission:
        while True:
            for k in range(limit(**self.sampler(), hint=self.hint)):
                permit = socket.socket(socket.AF_UNIX, socket.SOCK_DGRAM)
                try:
                    permit.bind(self.name + str(k))
                    self.held = permit
                    return self
                except OSError as e:
                    permit.close()
                    if e.errno != errno.EADDRINUSE:  # a system without such names: nothing to hold
                        return self
            time.sleep(self.WAIT)

    def __exit__(self, *_: object) -> None:
        if self.held:
            self.held.close()
            self.held = None


class Progress:
    """Tells at most one message per interval; a message that is not told is not rendered either."""

    def __init__(self, tell: Callable[[str], None], seconds: float = PROGRESS_SECONDS, clock: Callable[[], float] = time.monotonic) -> None:
        self.tell, self.seconds, self.clock, self.last = tell, seconds, clock, None

    def update(self, render: Callable[[], str]) -> None:
        now = self.clock()
        if self.last is None or now - self.last >= self.seconds:
            self.last = now
            self.tell(render())

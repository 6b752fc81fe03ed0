"""Runs a command and samples what it uses of processor and memory, and sums runs up. Linux only; reads /proc."""

from __future__ import annotations

import os
import subprocess
import time
from pathlib import Path

INTERVAL = 0.2


def _family(pid: int) -> list[int]:
    """A process and its descendants."""
    found = [pid]
    for p in found:
        for children in Path(f"/proc/{p}/task").glob("*/children"):
            try:
                found += [int(x) for x in children.read_text().split()]
            except OSError:
                continue
    return found


def usage(pid: int) -> tuple[float, float]:
    """CPU seconds so far and resident MB of a process and its descendants; those that ended count as nothing."""
    ticks, pages = 0, 0
    for p in _family(pid):
        try:
            fields = Path(f"/proc/{p}/stat").read_text().rpartition(")")[2].split()
            ticks, pages = ticks + int(fields[11]) + int(fields[12]), pages + int(fields[21])
        except (OSError, IndexError):
            continue
    return ticks / os.sysconf("SC_CLK_TCK"), pages * os.sysconf("SC_PAGE_SIZE") / (1 << 20)


def monitored(command: list[str], interval: float = INTERVAL) -> dict:
    """seconds, mean and largest CPU % and resident MB of a command, and the number of samples. A command that fails is an error."""
    began = last = time.perf_counter()
    process, cpu, memory, before = subprocess.Popen(command), [], [], 0.0
    while process.poll() is None:
        time.sleep(interval)
        (spent, held), now = usage(process.pid), time.perf_counter()
        if held:
            cpu.append(max(0.0, 100 * (spent - before) / (now - last)))
            memory.append(held)
        before, last = spent, now
    if process.returncode:
        raise RuntimeError(f"{command[0]} ended with {process.returncode}")
    mean = lambda xs: round(sum(xs) / len(xs), 2) if xs else 0.0
    return {"seconds": round(time.perf_counter() - began, 3), "avg_cpu_percent": mean(cpu), "max_cpu_percent": round(max(cpu, default=0.0), 2), "avg_mem_mb": mean(memory), "max_mem_mb": round(max(memory, default=0.0), 2), "samples": len(cpu)}


def speedups(runs: dict[str, dict]) -> dict[str, float]:
    """How many times faster than the first each run was."""
    first = next(iter(runs.values()))["seconds"] if runs else 0.0
    return {name: first / r["seconds"] if r["seconds"] else 0.0 for name, r in runs.items()}

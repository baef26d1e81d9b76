"""Timing of queries: mergeable histograms of latencies, an open-loop load, and whether the machine is fit to measure on."""

from __future__ import annotations

import math
import os
import threading
import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from queue import SimpleQueue

#: Buckets between one power of two and the next: a percentile is high by 1 / STEPS of its value at most.
STEPS = 64


@dataclass
class Histogram:
    """Counts of latencies by bucket: of bounded size whatever the number recorded, and merged by adding."""

    counts: Counter[int] = field(default_factory=Counter)

    def record(self, seconds: float) -> None:
        part, power = math.frexp(max(seconds, 1e-9))
        self.counts[power * STEPS + int((2 * part - 1) * STEPS)] += 1

    def merge(self, other: Histogram) -> None:
        self.counts.update(other.counts)

    def __len__(self) -> int:
        return sum(self.counts.values())

    def percentile(self, q: float) -> float:
        """The upper border of the bucket that holds the q-th hundredth (nearest rank); NaN where nothing was recorded."""
        rank, seen = max(1, math.ceil(q / 100 * len(self))), 0
        for bucket in sorted(self.counts):
            seen += self.counts[bucket]
            if seen >= rank:
                power, step = divmod(bucket, STEPS)
                return math.ldexp((1 + (step + 1) / STEPS) / 2, power)
        return math.nan


@dataclass
class Load:
    """What an open-loop load gave: latencies from the time when each call was due, and from when it was begun."""

    due: Histogram = field(default_factory=Histogram)
    service: Histogram = field(default_factory=Histogram)
    failed: int = 0
    seconds: float = 0.0

    @property
    def rate(self) -> float:
        return len(self.due) / self.seconds if self.seconds else 0.0


def open_loop(run: Callable[[], object], rate: float, seconds: float, workers: int = 4) -> Load:
    """Call run `rate` times a second, whether or not earlier calls have ended.

    A call that waits for a free worker counts from when it was due, so a stall shows in all the calls that it holds up.
    Every call that was due within `seconds` is made; failed ones are counted apart and have no latency.
    """
    if rate <= 0 or seconds <= 0 or workers < 1:
        raise ValueError("rate, seconds and workers must be positive")
    calls: SimpleQueue[float | None] = SimpleQueue()
    out, lock = Load(), threading.Lock()

    def work() -> None:
        while (due := calls.get()) is not None:
            began = time.perf_counter()
            try:
                run()
            except Exception:  # noqa: BLE001  the load goes on
                with lock:
                    out.failed += 1
                continue
            ended = time.perf_counter()
            with lock:
                out.due.record(ended - due)
                out.service.record(ended - began)

    threads = [threading.Thread(target=work, daemon=True) for _ in range(workers)]
    start = time.perf_counter()
    for t in threads:
        t.start()
    for k in range(max(1, math.floor(rate * seconds))):
        due = start + k / rate
        time.sleep(max(0.0, due - time.perf_counter()))
        calls.put(due)
    for _ in threads:
        calls.put(None)
    for t in threads:
        t.join()
    out.seconds = time.perf_counter() - start
    return out


def doubts(load: float | None = None, cpus: int | None = None, free: float | None = None, busy: float = 0.25, least: float = 0.1) -> list[str]:
    """Why figures taken now would not be valid: other work on the machine, or little memory left. Empty where nothing is seen.

    load: runnable processes over the last minute; free: share of memory that is available.
    """
    load = os.getloadavg()[0] if load is None else load
    cpus = cpus or len(os.sched_getaffinity(0))
    if free is None:
        with open("/proc/meminfo") as f:
            sizes = {line.split(":")[0]: int(line.split()[1]) for line in f}
        free = sizes["MemAvailable"] / sizes["MemTotal"]
    out = []
    if load > busy * cpus:
        out.append(f"load of {load:.1f} on {cpus} processors before the first query")
    if free < least:
        out.append(f"{100 * free:.0f} % of memory available")
    return out

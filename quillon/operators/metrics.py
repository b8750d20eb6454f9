"""Counters, gauges and histograms of a process, as Prometheus text; a small cache; line logs."""

from __future__ import annotations

import contextlib
import contextvars
import json
import logging
import re
import threading
import time
import uuid
from collections import OrderedDict
from collections.abc import Iterator

# Upper bounds of the histogram's buckets, in seconds.
BUCKETS = (0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
MISSING = object()


class MetricError(ValueError):
    """A metric is misused."""


class Metric:
    kind = "untyped"

    def __init__(self, name: str, about: str) -> None:
        if not re.fullmatch(r"[a-zA-Z_:][a-zA-Z0-9_:]*", name):
            raise MetricError(f"bad name {name!r}")
        self.name, self.about, self.lock = name, about, threading.Lock()

    def header(self) -> list[str]:
        return [f"# HELP {self.name} {self.about}", f"# TYPE {self.name} {self.kind}"]


class Counter(Metric):
    kind = "counter"
    value = 0.0

    def increment(self, by: float = 1.0) -> None:
        if by < 0:
            raise MetricError("a counter only rises")
        with self.lock:
            self.value += by

    def expose(self) -> list[str]:
        return [*self.header(), f"{self.name} {self.value:g}"]


class Gauge(Counter):
    kind = "gauge"

    def increment(self, by: float = 1.0) -> None:
        with self.lock:
            self.value += by

    def decrement(self, by: float = 1.0) -> None:
        self.increment(-by)


class Histogram(Metric):
    kind = "histogram"

    def __init__(self, name: str, about: str, buckets: tuple[float, ...] = BUCKETS) -> None:
        super().__init__(name, about)
        if not buckets or list(buckets) != sorted(set(buckets)):
            raise MetricError("buckets must rise")
        self.buckets, self.counts, self.total, self.count = buckets, [0] * (len(buckets) + 1), 0.0, 0

    def observe(self, value: float) -> None:
        at = next((i for i, b in enumerate(self.buckets) if value <= b), len(self.buckets))
        with self.lock:
            self.counts[at] += 1
            self.total += value
            self.count += 1

    def quantile(self, q: float) -> float:
        """Upper bound of the bucket the quantile lies in; infinite above all, 0 if empty."""
        if not 0 <= q <= 1:
            raise MetricError("a quantile lies between 0 and 1")
        if not self.count:
            return 0.0
        so_far = 0
        for bound, n in zip((*self.buckets, float("inf")), self.counts):
            so_far += n
            if n and so_far >= q * self.count:
                return bound
        return float("inf")

    def expose(self) -> list[str]:
        lines, so_far = self.header(), 0
        for bound, n in zip((*self.buckets, float("inf")), self.counts):
            so_far += n
            lines.append(f'{self.name}_bucket{{le="{"+Inf" if bound == float("inf") else f"{bound:g}"}"}} {so_far}')
        return [*lines, f"{self.name}_sum {self.total:g}", f"{self.name}_count {self.count}"]


class Registry:
    def __init__(self) -> None:
        self.metrics: dict[str, Metric] = {}

    def _get(self, kind: type, name: str, about: str):
        found = self.metrics.setdefault(name, kind(name, about))
        if type(found) is not kind:
            raise MetricError(f"{name} is a {found.kind}")
        return found

    def counter(self, name: str, about: str = "") -> Counter:
        return self._get(Counter, name, about)

    def gauge(self, name: str, about: str = "") -> Gauge:
        return self._get(Gauge, name, about)

    def histogram(self, name: str, about: str = "") -> Histogram:
        return self._get(Histogram, name, about)

    def names(self) -> list[str]:
        return sorted(self.metrics)

    def render(self) -> str:
        return "\n".join(line for name in self.names() for line in self.metrics[name].expose()) + "\n"


REGISTRY = Registry()


@contextlib.contextmanager
def timed_query(registry: Registry = REGISTRY) -> Iterator[None]:
    """Counts a query, its time and its failure."""
    started = time.perf_counter()
    registry.counter("queries_total", "Queries run.").increment()
    try:
        yield
    except Exception:
        registry.counter("query_errors_total", "Queries that failed.").increment()
        raise
    finally:
        registry.histogram("query_duration_seconds", "Time of a query.").observe(time.perf_counter() - started)


class LruCache:
    """Keeps what was used last."""

    def __init__(self, capacity: int) -> None:
        if capacity <= 0:
            raise ValueError("capacity must be positive")
        self.capacity, self.hits, self.misses = capacity, 0, 0
        self.items: OrderedDict = OrderedDict()

    def get(self, key):
        if key not in self.items:
            self.misses += 1
            return MISSING
        self.hits += 1
        self.items.move_to_end(key)
        return self.items[key]

    def put(self, key, value) -> None:
        self.items[key] = value
        self.items.move_to_end(key)
        if len(self.items) > self.capacity:
            self.items.popitem(last=False)

    def clear(self) -> None:
        self.items.clear()
        self.hits = self.misses = 0

    def __len__(self) -> int:
        return len(self.items)

    @property
    def hit_rate(self) -> float:
        asked = self.hits + self.misses
        return self.hits / asked if asked else 0.0


def counted_get(cache: LruCache, key, name: str, registry: Registry = REGISTRY):
    """What a cache has for a key, with a count of hits and misses under its name."""
    found = cache.get(key)
    registry.counter(f"{name}_cache_{'misses' if found is MISSING else 'hits'}_total", f"Looks into the {name} cache.").increment()
    return found


def result_key(generation: int, text: str, limit: int, scorer: str) -> tuple:
    """What a cached result depends on."""
    return (generation, text, limit, scorer)


_current: contextvars.ContextVar[str] = contextvars.ContextVar("correlation", default="")


@contextlib.contextmanager
def correlated(identifier: str | None = None) -> Iterator[str]:
    """One id on all log lines within."""
    token = _current.set(identifier or uuid.uuid4().hex[:12])
    try:
        yield _current.get()
    finally:
        _current.reset(token)


class JsonLines(logging.Formatter):
    """A log record as one JSON line; with ``redact`` query texts are left out."""

    def __init__(self, redact: bool = False) -> None:
        super().__init__()
        self.redact = redact

    def format(self, record: logging.LogRecord) -> str:
        line = {"time": self.formatTime(record), "level": record.levelname, "message": record.getMessage(), "correlation": _current.get()}
        line |= {k: v for k, v in getattr(record, "fields", {}).items() if k not in ("query", "text") or not self.redact}
        return json.dumps(line, ensure_ascii=False)

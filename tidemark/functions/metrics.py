"""Counters, gauges, histograms, timers, and their text form; histogram operators on columns."""

from __future__ import annotations

import time
from collections import OrderedDict
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: upper bounds of the histogram buckets: powers of ten, in microseconds
BOUNDS = tuple(10**k for k in range(8))


def histogram(df: DataFrame, value: Column) -> DataFrame:
    """count, sum, min, max, mean and the values below each bound (and not below the one before)."""
    low = [None, *BOUNDS]
    cells = [F.count_if((value < hi) & (F.lit(True) if lo is None else value >= lo)).alias(f"lt_{hi}") for lo, hi in zip(low, BOUNDS)]
    return df.agg(F.count(value).alias("count"), F.sum(value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), *cells, F.count_if(value >= BOUNDS[-1]).alias("rest"))


def cumulative(df: DataFrame, value: Column) -> DataFrame:
    """le, n: values below each bound, cumulative; only bounds that some value falls under first have rows."""
    le = F.array_min(F.filter(F.array(*[F.lit(b).cast("bigint") for b in BOUNDS], F.lit(2**62)), lambda b: value < b))
    per = df.filter(value.isNotNull()).groupBy(le.alias("le")).agg(F.count(F.lit(1)).alias("_n"))
    return per.select("le", F.sum("_n").over(Window.orderBy("le").rowsBetween(Window.unboundedPreceding, 0)).alias("n"))


def rate(hits: Column, misses: Column) -> Column:
    """hits / (hits + misses), 0 when there were none."""
    return F.when(hits + misses > 0, hits / (hits + misses)).otherwise(0.0)


@dataclass
class Histogram:
    count: int = 0
    sum: float = 0
    min: float | None = None
    max: float | None = None
    buckets: list[int] = field(default_factory=lambda: [0] * (len(BOUNDS) + 1))

    def observe(self, v: float) -> None:
        self.count += 1
        self.sum += v
        self.min = v if self.min is None else min(self.min, v)
        self.max = v if self.max is None else max(self.max, v)
        self.buckets[next((i for i, b in enumerate(BOUNDS) if v < b), len(BOUNDS))] += 1

    def mean(self) -> float:
        return self.sum / self.count if self.count else 0.0


class Metrics:
    """A registry a store keeps on the driver."""

    def __init__(self):
        self.counters: dict[str, int] = {}
        self.gauges: dict[str, float] = {}
        self.histograms: dict[str, Histogram] = {}

    def inc(self, name: str, by: int = 1) -> None:
        self.counters[name] = self.counters.get(name, 0) + by

    def set(self, name: str, value: float) -> None:
        self.gauges[name] = value

    def observe(self, name: str, micros: float) -> None:
        self.histograms.setdefault(name, Histogram()).observe(micros)

    def timer(self, name: str) -> "Timer":
        return Timer(self, name)

    def summary(self) -> dict[str, float]:
        return {**self.counters, **self.gauges, **{f"{k}_mean_us": h.mean() for k, h in self.histograms.items()}}

    def prometheus(self, prefix: str = "tidemark") -> str:
        out = []
        for name, v in sorted(self.counters.items()):
            out += [f"# TYPE {prefix}_{name} counter", f"{prefix}_{name} {v}"]
        for name, v in sorted(self.gauges.items()):
            out += [f"# TYPE {prefix}_{name} gauge", f"{prefix}_{name} {v:g}"]
        for name, h in sorted(self.histograms.items()):
            out.append(f"# TYPE {prefix}_{name}_microseconds histogram")
            below = 0
            for bound, n in zip([*BOUNDS, "+Inf"], h.buckets):
                below += n
                out.append(f'{prefix}_{name}_microseconds_bucket{{le="{bound}"}} {below}')
            out += [f"{prefix}_{name}_microseconds_sum {h.sum:g}", f"{prefix}_{name}_microseconds_count {h.count}"]
        return "\n".join(out) + "\n"


class Timer:
    def __init__(self, metrics: Metrics, name: str):
        self.metrics, self.name = metrics, name

    def __enter__(self):
        self.began = time.perf_counter()
        return self

    def __exit__(self, *exc) -> None:
        self.metrics.observe(self.name, (time.perf_counter() - self.began) * 1e6)


class LruCache:
    """A bounded map of the entries used last, with hit counts."""

    def __init__(self, capacity: int):
        self.capacity, self.hits, self.misses, self.data = capacity, 0, 0, OrderedDict()

    def get(self, key):
        if key in self.data:
            self.hits += 1
            self.data.move_to_end(key)
            return self.data[key]
        self.misses += 1
        return None

    def insert(self, key, value) -> None:
        self.data[key] = value
        self.data.move_to_end(key)
        while len(self.data) > self.capacity:
            self.data.popitem(last=False)

    def remove(self, key) -> None:
        self.data.pop(key, None)

    def clear(self) -> None:
        self.data.clear()

    def __len__(self) -> int:
        return len(self.data)

    def hit_rate(self) -> float:
        return self.hits / (self.hits + self.misses) if self.hits + self.misses else 0.0

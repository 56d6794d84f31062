"""Peaks over threshold: tail fit, one-shot thresholds and the sequential rule, for one or both tails, with or without drift."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gpd_fit(y: np.ndarray) -> tuple[float, float]:
    """Shape and scale of a generalised Pareto tail of excesses y, by the profile likelihood in shape / scale.

    For a ratio t the best shape is mean(log(1 + t y)); the ratio is searched on a grid within its bounds, then refined. The
    exponential tail (t = 0), with log likelihood -n (1 + log mean), is a candidate too.
    """
    y = np.asarray(y, float)
    y = y[y > 0]
    if not len(y):
        return 0.0, 1e-12
    mean, top, low = y.mean(), y.max(), y.min()

    def likelihood(t: float) -> float:
        inner = 1 + t * y
        if inner.min() <= 0:
            return -math.inf
        shape = np.log(inner).mean()
        scale = shape / t
        return -math.inf if scale <= 0 else -len(y) * (math.log(scale) + shape + 1)

    best, ratio = -len(y) * (1 + math.log(mean)), 0.0
    upper = 2 * (mean - low) / max(low * low, 1e-12) if mean > low else 1 / mean
    grid = np.concatenate([-np.geomspace(1e-6, 0.999, 40) / top, np.geomspace(1e-6 / mean, min(max(upper, 1e-3 / mean), 1e3 / mean), 60)])
    values = [likelihood(t) for t in grid]
    k = int(np.argmax(values))
    if values[k] > best:
        order = np.sort(grid)
        at = int(np.searchsorted(order, grid[k]))
        a, b = order[max(0, at - 1)], order[min(len(order) - 1, at + 1)]
        for _ in range(60):
            c, d = b - (b - a) * 0.618034, a + (b - a) * 0.618034
            if (likelihood(c) if c else best) >= (likelihood(d) if d else best):
                b = d
            else:
                a = c
        mid = (a + b) / 2
        ratio = mid if mid and likelihood(mid) >= values[k] else float(grid[k])
    if not ratio:
        return 0.0, float(mean)
    shape = float(np.log(1 + ratio * y).mean())
    return shape, shape / ratio


def tail_quantile(threshold: float, peaks: np.ndarray, n: int, q: float, seen: int | None = None, fitted: tuple[float, float] | None = None) -> float:
    """The value exceeded with probability q; seen: how many peaks there were, if not all are at hand; fitted: the peaks' `gpd_fit`, if known."""
    if not len(peaks):
        return threshold
    shape, scale = fitted or gpd_fit(peaks)
    r = q * n / (seen or len(peaks))
    return threshold + (scale / shape * (r**-shape - 1) if shape else -scale * math.log(r))


#: The peaks that a tail is fitted to: all up to so many, then a fair sample of all. So a state is bounded, and a fit costs the same for ever.
MOST_PEAKS = 2000


def _kept(peaks: list[float], seen: int, peak: float) -> list[float]:
    """A sample with one more peak, the seen-th: each peak so far is in it with the same chance, by a hash of its number."""
    if seen <= MOST_PEAKS:
        return [*peaks, peak]
    h = seen * 0x9E3779B97F4A7C15 & (1 << 64) - 1
    h = ((h ^ h >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1) ^ h >> 27
    at = (h ^ h >> 31) % seen
    return [*peaks[:at], peak, *peaks[at + 1 :]] if at < MOST_PEAKS else peaks


@dataclass
class Tail:
    """One tail of a stream: a sample of its peaks, how many peaks and values were seen, and the threshold that follows."""

    q: float = 1e-3
    level: float = 0.98
    n: int = 0
    start: float = 0.0
    threshold: float = math.inf
    peaks: list[float] = field(default_factory=list)
    seen: int = 0
    fitted: tuple[list[float], float, float] | None = None  # the sample last fitted, its shape and scale

    def calibrate(self, values) -> Tail:
        x = np.sort(np.asarray(values, float))
        self.n = len(x)
        self.start = float(x[min(len(x) - 1, int(self.level * len(x)))])
        self.peaks, self.seen = [], 0
        for v in np.asarray(values, float)[np.asarray(values, float) > self.start]:
            self.seen += 1
            self.peaks = _kept(self.peaks, self.seen, float(v - self.start))
        self.fit()
        return self

    def fit(self) -> None:
        """The threshold of the sample; only a sample that has changed is fitted anew, so fits grow with the logarithm of the peaks."""
        if self.fitted is None or self.fitted[0] is not self.peaks:
            self.fitted = (self.peaks, *gpd_fit(np.array(self.peaks)))
        self.threshold = tail_quantile(self.start, self.peaks, self.n, self.q, self.seen, self.fitted[1:])

    def step(self, x: float) -> bool:
        """Whether x is an alarm; otherwise it is learned from."""
        if x > self.threshold:
            return True
        self.n += 1
        if x > self.start:
            self.seen += 1
            self.peaks = _kept(self.peaks, self.seen, x - self.start)
            self.fit()
        return False


@dataclass
class Spot:
    """Sequential rule on the upper tail, or both; depth > 0 first takes the mean of the last normal values away.

    A value that is neither a peak nor an alarm only counts, so `steps` looks for the next value beyond a start, whole arrays at a time, and
    works at these alone.
    """

    q: float = 1e-3
    level: float = 0.98
    both: bool = False
    depth: int = 0
    up: Tail | None = None
    down: Tail | None = None
    recent: list[float] = field(default_factory=list)

    def calibrate(self, values) -> Spot:
        x = np.asarray(values, float)
        if self.depth:
            d = min(self.depth, max(1, len(x) - 1))
            means = np.convolve(x, np.ones(d) / d, "valid")[: len(x) - d]
            self.recent = [float(v) for v in x[-d:]]
            x = x[d:] - means
        self.up = Tail(self.q, self.level).calibrate(x)
        self.down = Tail(self.q, self.level).calibrate(-x) if self.both else None
        return self

    def step(self, x: float) -> tuple[bool, float, float | None]:
        """Alarm, and the upper and lower limit that held for x."""
        flags, high, low = self.steps(np.array([x], float))
        return bool(flags[0]), float(high[0]), float(low[0]) if self.down else None

    def steps(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Alarms of values in order, and the upper and lower limits that held for each (nan without a lower one)."""
        flags, high, low = np.zeros(len(x), bool), np.empty(len(x)), np.full(len(x), np.nan)
        at = 0
        while at < len(x):
            part = x[at : at + 4096]
            if self.depth:  # means of the last normal values, up to the part's first alarm
                d = len(self.recent)
                line = np.concatenate([self.recent, part])
                base = np.lib.stride_tricks.sliding_window_view(line, d).mean(axis=1)[: len(part)]
            else:
                base = np.zeros(len(part))
            y = part - base
            n, alarm, starts = 0, False, None
            while n < len(part) and not alarm:
                now = min(self.up.start, self.up.threshold), min(self.down.start, self.down.threshold) if self.down else None
                if now != starts:
                    beyond = y[n:] > now[0]
                    if self.down:
                        beyond |= -y[n:] > now[1]
                    hits, starts = iter((np.flatnonzero(beyond) + n).tolist()), now
                hit = next(hits, len(part))
                end = min(hit + 1, len(part))
                high[at + n : at + end] = self.up.threshold + base[n:end]
                self.up.n += hit - n
                if self.down:
                    low[at + n : at + end] = base[n:end] - self.down.threshold
                    self.down.n += hit - n
                if hit < len(part):
                    v = float(y[hit])
                    alarm = v > self.up.threshold or bool(self.down and -v > self.down.threshold)
                    flags[at + hit] = alarm
                    if not alarm:
                        self.up.step(v)
                        if self.down:
                            self.down.step(-v)
                n = end
            if self.depth:
                self.recent = [float(v) for v in np.concatenate([self.recent, part[: n - alarm]])[-len(self.recent) :]]
            at += n
        return flags, high, low


def pot_threshold(df: DataFrame, keys: list[str], q: float = 1e-3, level: float = 0.98) -> DataFrame:
    """DET-03: a threshold for each series, from all of its scores (upper tail); nulls don't count.

    The start is an exact quantile of any number of values, and only the values beyond it, 1 - level of all, meet in a series' task.
    """
    from .quantiles import selected

    rows = df.filter("score is not null").select(*keys, F.col("score").cast("double").alias("score"))
    size = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    starts = selected(rows, keys, "score", [lambda n: F.least(n - 1, F.floor(F.lit(level) * n))]).select(*keys, F.col("low").alias("_start"))
    high = rows.join(size.join(starts, keys), keys).filter(F.col("score") > F.col("_start"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        start, n, y = float(pdf["_start"].iloc[0]), int(pdf["_n"].iloc[0]), np.sort(pdf["score"].to_numpy())
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), start, tail_quantile(start, y - start, n, q), len(y)]], columns=[*keys, "start", "threshold", "peaks"])

    types = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    found = high.groupBy(*keys).applyInPandas(run, f"{types}, start double, threshold double, peaks long")
    without = starts.join(found.select(*keys), keys, "left_anti").select(*keys, F.col("_start").alias("start"), F.col("_start").alias("threshold"), F.lit(0).cast("long").alias("peaks"))
    return found.unionByName(without)


def sequential_flags(df: DataFrame, keys: list[str], train: int, q: float = 1e-3, level: float = 0.98, both: bool = False, depth: int = 0) -> DataFrame:
    """DET-03 to 06: flags of the rows after the first `train` of each series, in order, with the limits that held.

    Rows stream through a task in order, so it holds the first `train` values and the state of one series at a time; series of
    `train` rows or fewer have no flags.
    """
    dealt = df.select(*keys, F.col("idx").cast("long").alias("idx"), F.col("score").cast("double").alias("score")).repartition(*keys).sortWithinPartitions(*keys, "idx")
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]):
        series, warm, state = None, [], None
        for batch in batches:
            names = list(zip(*(batch.column(k).to_pylist() for k in range(width)))) if width else [()] * batch.num_rows
            x = batch.column(width + 1).to_numpy(zero_copy_only=False).astype(float)
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if names[lo] != series:
                    series, warm, state = names[lo], [], None
                if state is None:
                    more = x[lo : min(hi, lo + train - len(warm))]
                    warm = [*warm, *more.tolist()]
                    lo += len(more)
                    if len(warm) < train:
                        continue
                    state = Spot(q, level, both, depth).calibrate(warm)
                if lo < hi:
                    flags, high, low = state.steps(x[lo:hi])
                    own = batch.slice(lo, hi - lo)
                    yield pa.RecordBatch.from_arrays([*(own.column(k) for k in range(width + 1)), pa.array(flags.astype(np.int32)), pa.array(high), pa.array(low, mask=np.isnan(low))], names=[*keys, "idx", "flag", "high", "low"])

    types = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return dealt.mapInArrow(run, f"{types}, idx long, flag int, high double, low double")

"""STR-05 with any min_samples: density clusters of event times on a stream, as `dbscan_1d` gives them on a table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A state's events are packed columns of numbers: as lists, Python holds an object for each of them.
STATE = "at binary, id binary, cluster binary, done binary, last long, n long"
KINDS = ("<i8", "<i8", "<i8", "?")
#: Rows that are worked on and handed on at once.
STEP_ROWS = 10_000


def _parts(x: np.ndarray) -> Iterator[np.ndarray]:
    return (x[k : k + STEP_ROWS] for k in range(0, len(x), STEP_ROWS))


def clusters(stream: DataFrame, key: str, eps: int, min_samples: int, late: str) -> DataFrame:
    """key, id, at, cluster_id (-1: noise) of each event, at in milliseconds, once nothing that may still come can change it.

    stream: key, id, ts (a timestamp). A core is final when the watermark is more than eps milliseconds past it, another event at
    twice that. Timers on event time bring a key's events out when others move the watermark. State holds the events
    of the last three eps before the watermark and those after it; clusters are numbered from 0 in each key.
    """
    rows = stream.withWatermark("ts", late).select(F.col(key).alias("key"), F.col("id").cast("long").alias("id"), "ts", F.unix_millis("ts").alias("at")).filter("at is not null")

    def run(name, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *packed, last, n = state.get if state.exists else (b"", b"", b"", b"", -1, 0)
        at, ids, known, done = (np.frombuffer(x, kind) for x, kind in zip(packed, KINDS))
        if not state.hasTimedOut:
            new = [(b["at"].to_numpy(np.int64, copy=True), b["id"].to_numpy(np.int64, copy=True)) for b in batches if len(b)]  # two numbers of each row, not its key
            at, ids = (np.concatenate([x, *(c[k] for c in new)]) for k, x in enumerate((at, ids)))
            del new
        fresh = len(at) - len(known)
        known = np.concatenate([known, np.full(fresh, -1)])  # of cores that are final
        done = np.concatenate([done, np.zeros(fresh, bool)])
        order = np.lexsort((ids, at))
        at, ids, known, done = (x[order] for x in (at, ids, known, done))
        del order
        mark = state.getCurrentWatermarkMs()
        core = known >= 0
        for part in _parts(np.flatnonzero(~core & ~done & (at < mark - eps))):
            core[part] = np.searchsorted(at, at[part] + eps, "right") - np.searchsorted(at, at[part] - eps, "left") >= min_samples
        anew = np.flatnonzero(core & (known < 0))
        if len(anew):
            starts = np.diff(at[anew], prepend=last if n else at[anew[0]] - eps - 1) > eps
            known[anew] = n - 1 + np.cumsum(starts)
            n, last = int(known[anew[-1]]) + 1, int(at[anew[-1]])
        cores = np.flatnonzero(core)
        rest = np.flatnonzero(~done & ~core & (at < mark - 2 * eps))
        sure, times = known[cores], at[cores]
        labels = []
        for part in _parts(rest):
            lo, hi = (np.searchsorted(times, at[part] + shift, side) for shift, side in ((-eps, "left"), (eps, "right")))
            labels.append(np.where(hi > lo, sure[np.minimum(lo, len(sure) - 1)], -1) if len(sure) else np.full(len(part), -1))  # clusters are numbered in order of time
        fresh_cores = cores[~done[cores]]
        out = np.concatenate([fresh_cores, rest])
        done[out] = True
        keep = ~done | (at >= mark - 3 * eps)
        waiting = at[~done]
        if keep.any() or n:
            state.update((*(x[keep].astype(kind).tobytes() for x, kind in zip((at, ids, known, done), KINDS)), last, n))
            if len(waiting):
                state.setTimeoutTimestamp(max(mark + 1, int(waiting.min()) + (2 * eps if (waiting + eps < mark).any() else eps)))
        elif state.exists:
            state.remove()
        label = np.concatenate([known[fresh_cores], *labels])
        for k, part in enumerate(_parts(out)):
            yield pd.DataFrame({"key": [name[0]] * len(part), "id": ids[part], "at": at[part], "cluster_id": label[k * STEP_ROWS :][: len(part)]})

    schema = f"key {stream.schema[key].dataType.simpleString()}, id long, at long, cluster_id long"
    return rows.groupBy("key").applyInPandasWithState(run, schema, STATE, "append", GroupStateTimeout.EventTimeTimeout)

"""The sequential threshold on a stream: one state for each series, bounded by a sample of its peaks and its last normal values (STR-01, STR-02)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.spot import Spot, Tail

STATE = "warm array<double>, ready boolean, n long, start double, threshold double, peaks array<double>, recent array<double>, seen long"


def sequential_flags(stream: DataFrame, train: int, q: float = 1e-3, level: float = 0.98, depth: int = 0) -> DataFrame:
    """entity, idx, flag, high of each value after the first `train` of its entity. Values of a micro-batch are taken by idx."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        warm, ready, n, start, threshold, peaks, recent, seen = state.get if state.exists else ([], False, 0, 0.0, 0.0, [], [], 0)
        warm = list(warm)
        spot = Spot(q, level, depth=depth, up=Tail(q, level, n, start, threshold, list(peaks), seen), recent=list(recent)) if ready else None
        rows = pd.concat(list(batches)).sort_values("idx")
        x = rows["score"].to_numpy(float)
        used = 0
        if spot is None:
            used = min(len(x), train - len(warm))
            warm += x[:used].tolist()
            if len(warm) >= train:
                spot, warm = Spot(q, level, depth=depth).calibrate(warm), []
        out = None
        if spot is not None and used < len(x):
            flags, high, _ = spot.steps(x[used:])
            out = pd.DataFrame({"entity": key[0], "idx": rows["idx"].to_numpy()[used:], "flag": flags, "high": high})
        t = spot.up if spot else Tail(q, level, threshold=0.0)
        state.update((warm, spot is not None, t.n, t.start, t.threshold, t.peaks, spot.recent if spot else [], t.seen))
        if out is not None:
            yield out.astype({"idx": "int64", "flag": "int32", "high": "float64"})

    return stream.groupBy("entity").applyInPandasWithState(run, "entity string, idx long, flag int, high double", STATE, "append", GroupStateTimeout.NoTimeout)

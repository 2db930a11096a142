"""Flagging windows of a live series.

Non-time window functions are not allowed on streams, so each run (the grouping key) keeps as state the last
``length - 1`` readings of it, which bounds the state by the number of live runs.  Readings of a run must
arrive in order of ``iteration``; one that is not newer than what its run has seen is a repetition and is
dropped.  With ``idle_ms`` the state of a run ends when no reading has come for so long (the query then never
runs out of batches, so it suits continuous triggers only); without it, runs keep their few readings.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pulsegrid.operators.windows import RUN

RESULT = "start_iteration long, end_iteration long, measure double"


def average_over(threshold: float) -> Callable[[list[float]], bool]:
    """The mean of the window lies above the threshold and its sum above 0."""
    return lambda values: sum(values) > 0 and sum(values) / len(values) > threshold


def flag_stream(
    stream: DataFrame,
    length: int,
    value: str,
    bad: Callable[[list[float]], bool],
    run: Sequence[str] = RUN,
    idle_ms: int | None = None,
) -> DataFrame:
    """(run columns, start_iteration, end_iteration, measure) of each window that ``bad`` accepts, once."""
    keys = [stream.schema[c] for c in run]
    schema = ", ".join(f"{k.name} {k.dataType.simpleString()}" for k in keys) + ", " + RESULT
    names = [*run, "start_iteration", "end_iteration", "measure"]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tail = [tuple(x) for x in json.loads(state.get[0])] if state.exists else []
        new = pd.concat(list(frames))[["iteration", value]].sort_values("iteration", kind="stable")
        out = []
        for iteration, x in zip(new["iteration"].tolist(), new[value].tolist()):
            if tail and iteration <= tail[-1][0]:
                continue
            tail = [*tail, (int(iteration), float(x))][-length:]
            values = [v for _, v in tail]
            if len(tail) == length and iteration - tail[0][0] + 1 == length and bad(values):
                out.append((*key, tail[0][0], int(iteration), sum(values) / length))
        state.update((json.dumps(tail[-max(1, length - 1) :]),))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        if out:
            yield pd.DataFrame(out, columns=names)

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return stream.groupBy(*run).applyInPandasWithState(step, schema, "tail string", "append", timeout)

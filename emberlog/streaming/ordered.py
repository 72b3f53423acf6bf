"""Samples of a stream in order of event time: per-series state that holds back what the watermark has not passed.

A sample is judged once no earlier one of its series can come any more, so late samples up to the watermark's delay take their
place and the results are those of the batch operators. Event-time timeouts wake a series that gets no further
sample. State per series is what the operator carries plus the samples of one delay and of one or two micro-batches, which wait in
one binary value of 24 bytes a sample: Spark reads and writes it whole, so bound the reader's batches, and start the stream with
`SEND_STATE_ONCE`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What an operator does with a series: carried state, ready samples (us, seq, value), the watermark in microseconds ->
#: new state (None: forget the series), output rows, and when to wake without a sample (None: never).
Step = Callable[[tuple | None, list[tuple], int], tuple[tuple | None, list[tuple], int | None]]

#: Samples that `step` is given at once.
CHUNK = 10_000
#: Stands for a missing `seq`, which comes before all others.
NO_SEQ = -1 << 63
#: Types of time, `seq` and value of the samples that wait.
HELD = (np.dtype("<i8"), np.dtype("<i8"), np.dtype("<f8"))


#: Setting for `session.set_meanwhile` around the start of a stream. Spark sends a series' whole state to Python with each Arrow batch of
#: its rows, 10,000 by default, so the samples that wait would be copied for every 10,000 new ones.
SEND_STATE_ONCE = {"spark.sql.execution.arrow.maxRecordsPerBatch": "100000"}


def pack_samples(columns: Sequence[np.ndarray]) -> bytes:
    """The columns of the samples that wait, one after the other. As lists they would be an object per number, in Python and in the JVM."""
    return b"".join(column.astype(kind, copy=False).tobytes() for column, kind in zip(columns, HELD))


def unpack_samples(data: bytes) -> list[np.ndarray]:
    n = len(data) // sum(kind.itemsize for kind in HELD)
    return [np.frombuffer(data, kind, n, i * 8 * n) for i, kind in enumerate(HELD)]


def in_order(samples: DataFrame, keys: Sequence[str], ts: str, seq: str, value: str | Column, delay: str,
             step: Step, state: str, output: str) -> DataFrame:
    """Rows (keys.., output columns) of `step` over each series; `state` and `output` are column lists.

    Samples without a time are left out, and those whose `value` is null. `seq` orders samples of one time. Samples more than
    `delay` behind the newest are dropped; `LateRows` counts them. What is ready goes to `step` in chunks: between two of them its
    third argument is the moment before the next sample, as if the watermark had come that far.
    """
    value = F.col(value) if isinstance(value, str) else value
    timed = (samples.withWatermark(ts, delay)
             .select(*keys, F.col(ts).alias("_ts"), F.unix_micros(ts).alias("_us"), F.coalesce(F.col(seq).cast("long"), F.lit(NO_SEQ)).alias("_seq"), value.cast("double").alias("_value"))
             .filter("_us IS NOT NULL AND _value IS NOT NULL"))
    types = {f.name: f.dataType.simpleString() for f in timed.schema}
    names = [*keys, *[c.split()[0] for c in output.split(", ")]]
    parts = len(state.split(", "))

    def run(key: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        held: tuple | None = None
        parts_of: list[list[np.ndarray]] = [[np.zeros(0, kind)] for kind in HELD]
        if group.exists:
            known, carried, waiting = group.get
            held = tuple(carried_of(known, carried)) if known else None
            for column, values in zip(parts_of, unpack_samples(waiting)):
                column.append(values)
        for frame in frames:
            for column, name in zip(parts_of, ("_us", "_seq", "_value")):
                # A copy: a view would keep the whole Arrow batch.
                column.append(frame[name].to_numpy(column[0].dtype, copy=True))
        us, seqs, vals = (np.concatenate(parts_of.pop(0)) for _ in HELD)
        order = np.lexsort((vals, seqs, us))
        us, seqs, vals = us[order], seqs[order], vals[order]
        del order
        now_ms = group.getCurrentWatermarkMs()
        ready = int(np.searchsorted(us, now_ms * 1000, side="right"))
        for at in range(0, max(ready, 1), CHUNK):
            end = min(at + CHUNK, ready)
            numbers = [None if n == NO_SEQ else n for n in seqs[at:end].tolist()]
            chunk = list(zip(us[at:end].tolist(), numbers, vals[at:end].tolist()))
            held, rows, wake = step(held, chunk, now_ms * 1000 if end == ready else int(us[end]) - 1)
            yield pd.DataFrame([(*key, *row) for row in rows], columns=names)
        if ready < len(us):
            first = int(us[ready])
            wake = first if wake is None else min(wake, first)
        if held is None and ready == len(us):
            if group.exists:
                group.remove()
        else:
            group.update((held is not None, pack(held), pack_samples([column[ready:] for column in (us, seqs, vals)])))
            if wake is not None:
                group.setTimeoutTimestamp(max(-(-wake // 1000), now_ms + 1))

    def pack(held: tuple | None) -> list[float | None]:
        return [None] * parts if held is None else [None if v is None else str(v) for v in held]

    kinds = [c.split()[1] for c in state.split(", ")]

    def carried_of(known: bool, carried: list) -> Iterator:
        for kind, text in zip(kinds, carried):
            yield None if text is None else text == "True" if kind == "boolean" else int(text) if kind == "long" else float(text)

    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], output])
    return timed.groupBy(*keys).applyInPandasWithState(
        run, schema, "known boolean, carried array<string>, waiting binary",
        "append", GroupStateTimeout.EventTimeTimeout)

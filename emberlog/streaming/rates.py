"""Counter rates on a stream."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.operators.rates import sliding_sums
from emberlog.schema import EVALUATION_STEP, RATE_WINDOW
from emberlog.streaming.ordered import in_order


def counter_slots(samples: DataFrame, series: Sequence[str], ts: str = "ts", seq: str = "seq", value: str = "value",
                  delay: str = "24 hours", step: timedelta = EVALUATION_STEP) -> DataFrame:
    """Increase of a counter per step of event time, (series.., slot, increase), each step once it is over.

    A smaller reading is a restart from zero, as in `operators.rates`. The last reading of a series stays in its state,
    whatever the time until the next one; a step without a sample has no row.
    """
    width = step // timedelta(microseconds=1)

    def add(held: tuple | None, ready: list[tuple], now: int) -> tuple[tuple | None, list[tuple], int | None]:
        last, slot, total = held or (None, None, 0.0)
        rows: list[tuple] = []
        for us, _, reading in ready:
            own = us // width * width
            if slot is not None and own != slot:
                rows.append((slot, total))
                total = 0.0
            slot = own
            if last is not None:
                total += reading if reading < last else reading - last
            last = reading
        if slot is not None and slot + width <= now:
            rows.append((slot, total))
            slot, total = None, 0.0
        return (None if last is None else (last, slot, total)), rows, None if slot is None else slot + width

    return in_order(samples, series, ts, seq, value, delay, add, "last double, slot long, total double", "slot long, increase double")


def rates_of_slots(slots: DataFrame, series: Sequence[str], length: timedelta = RATE_WINDOW, step: timedelta = EVALUATION_STEP) -> DataFrame:
    """Increase per second in every sliding window over the stored rows of `counter_slots`."""
    return sliding_sums(slots, series, ["increase"], length, step).withColumn("rate", F.col("increase") / F.lit(length.total_seconds()))

"""Alerts on a stream: judged sample by sample in event time, and raised without a next sample."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.operators.alerts import AlertRule
from emberlog.schema import STALE_AFTER
from emberlog.streaming.ordered import in_order


def stream_alerts(samples: DataFrame, rule: AlertRule, keys: Sequence[str], ts: str = "ts", seq: str = "seq", value: str = "value",
                  delay: str = "24 hours", max_gap: timedelta | None = STALE_AFTER) -> DataFrame:
    """Rows (keys.., kind, seq, us, active, held_us, firing, alert, severity), in append mode.

    A `sample` row per sample is what `operators.alerts.hold_for` gives for it. A `timer` row (without seq) comes out when a
    condition has held for the rule's time between two samples, or after the last one so far: it needs the watermark to
    pass that moment, not another sample. A null value does not meet the condition. A series that goes stale (`max_gap` without a sample) stops holding, and is forgotten.
    """
    hold = rule.hold // timedelta(microseconds=1)
    gap = None if max_gap is None else max_gap // timedelta(microseconds=1)
    met = rule.condition(F.col(value)).cast("int")

    def step(held: tuple | None, ready: list[tuple], now: int) -> tuple[tuple | None, list[tuple], int | None]:
        # Since when the condition holds, the last sample, and whether this run has fired; nothing while it does not hold.
        since, last, fired = held or (None, None, False)
        rows: list[tuple] = []

        def timer(before: int) -> None:
            """Fire at the end of the hold if that comes before `before` and the series is not stale by then."""
            nonlocal fired
            if since is not None and not fired and since + hold < before and (gap is None or since + hold <= last + gap):
                rows.append(("timer", None, since + hold, True, hold, True))
                fired = True

        for us, number, active in ready:
            timer(us)
            if since is not None and (not active or (gap is not None and us - last > gap)):
                since, fired = None, False
            if active and since is None:
                since = us
            firing = since is not None and us - since >= hold
            fired = fired or firing
            last = us
            rows.append(("sample", number, us, bool(active), us - since if since is not None else None, firing))
        timer(now + 1)
        stale = None if gap is None or since is None else last + gap + 1
        if since is None or (stale is not None and stale <= now):
            return None, rows, None
        return (since, last, fired), rows, stale if fired else min(since + hold, stale or since + hold)

    judged = in_order(samples, keys, ts, seq, met, delay, step, "since long, last long, fired boolean",
                      "kind string, seq long, us long, active boolean, held_us long, firing boolean")
    return judged.withColumn("alert", F.lit(rule.name)).withColumn("severity", F.lit(rule.severity))

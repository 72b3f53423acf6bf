"""Load-shedding analysis over a queue-depth series per ingestor.

A request is rejected when the depth exceeds the maximum. The first rejection engages shedding and
fixes the engagement time; it is released at the first check whose depth is below half the maximum
and that comes more than the cooldown after the engagement. While engaged, a depth at or below the
maximum is still accepted.

The state is sequential along a series, but a block of the series maps the state before it to the
state after it, and that map is small: before a block an ingestor is either idle or engaged since T,
and T only decides which low row releases it. So blocks are summarised side by side, the summaries
are chained per ingestor, and the blocks are replayed side by side from their entry states.
"""

from __future__ import annotations

import sys
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.timefmt import as_micros
from emberlog.operators.ordered import previous, running_sum, seq_block
from emberlog.schema import COOLDOWN, MAX_QUEUE_DEPTH


def running_depth(deltas: DataFrame, key: str = "ingestor", seq: str = "seq", delta: str = "delta",
                  block: Column | None = None) -> DataFrame:
    """Queue depth after each change."""
    return running_sum(deltas, [key], seq, delta, "depth", seq_block(seq) if block is None else block)


# The block functions travel with the job, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class _Block:
    """Jumps over one block of samples, ordered by seq, with time never going backwards."""

    def __init__(self, pdf: pd.DataFrame, max_depth: int, cooldown_us: int) -> None:
        pdf = pdf.sort_values("_seq", kind="stable")
        self.frame, self.cooldown = pdf, cooldown_us
        self.us = pdf["_us"].to_numpy()
        depth = pdf["_depth"].to_numpy()
        self.over = np.flatnonzero(depth > max_depth)
        self.low = np.flatnonzero(depth < max_depth // 2)

    def next_over(self, pos: int) -> int | None:
        i = np.searchsorted(self.over, pos)
        return int(self.over[i]) if i < len(self.over) else None

    def release(self, pos: int, engaged_us: int) -> int | None:
        """First low row at or after `pos` past the cooldown."""
        past = np.searchsorted(self.us, engaged_us + self.cooldown, side="right")
        i = np.searchsorted(self.low, max(pos, int(past)))
        return int(self.low[i]) if i < len(self.low) else None

    def intervals(self, entry: int | None) -> tuple[list[tuple[int, int, int]], int | None]:
        """Engaged stretches (first row, row after the last, engagement time) and the exit state."""
        found, pos, engaged = [], 0, entry
        while True:
            if engaged is None:
                at = self.next_over(pos)
                if at is None:
                    return found, None
                pos, engaged = at, int(self.us[at])
            freed = self.release(pos, engaged)
            if freed is None:
                found.append((pos, len(self.us), engaged))
                return found, engaged
            found.append((pos, freed, engaged))
            pos, engaged = freed + 1, None

    def exit_after(self, pos: int, known: dict[int, int | None]) -> int | None:
        """Exit state when idle just before row `pos`; shared tails are looked up."""
        path, result = [], None
        while (at := self.next_over(pos)) is not None:
            if at in known:
                result = known[at]
                break
            path.append(at)
            engaged = int(self.us[at])
            freed = self.release(at, engaged)
            if freed is None:
                result = engaged
                break
            pos = freed + 1
        known.update(dict.fromkeys(path, result))
        return result

    def summary(self) -> tuple[int | None, list[int], list[int | None]]:
        """Exit state from idle, and the exits from an engagement whose cooldown ends at X: the first
        piece with X < bound applies; past the last bound nothing releases it."""
        known: dict[int, int | None] = {}
        bounds: list[int] = []
        exits: list[int | None] = []
        latest_end = int(self.us[0]) + self.cooldown
        reached = None
        for at in self.low:
            if reached is not None and reached > latest_end:
                break
            reached = int(self.us[at])
            after = self.exit_after(int(at) + 1, known)
            if exits and exits[-1] == after:
                bounds[-1] = max(bounds[-1], reached)
            else:
                bounds.append(reached)
                exits.append(after)
        return self.exit_after(0, known), bounds, exits


def _int(value) -> int | None:
    return None if value is None or pd.isna(value) else int(value)


def hysteresis(samples: DataFrame, max_depth: int = MAX_QUEUE_DEPTH, cooldown: timedelta = COOLDOWN,
               key: str = "ingestor", seq: str = "seq", ts: str = "ts", depth: str = "depth",
               block: Column | None = None, entry: DataFrame | None = None) -> DataFrame:
    """Rows (key, seq, ts, depth, accept, active, engaged_us): the state after each check.

    `entry` (key, engaged_us) carries the state over from earlier samples. `seq` is unique per key and
    time does not go backwards along it.
    """
    cooldown_us = cooldown // timedelta(microseconds=1)
    rows = samples.select(
        F.col(key).alias("_key"), F.col(seq).cast("long").alias("_seq"),
        as_micros(F.col(ts)).alias("_us"), F.col(depth).cast("long").alias("_depth"),
        (seq_block(seq) if block is None else block).alias("_block"))

    def summarise(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        idle_exit, bounds, exits = _Block(pdf, max_depth, cooldown_us).summary()
        return pd.DataFrame({
            "_key": [k[0]], "_block": [k[1]], "_idle_exit": pd.array([idle_exit], dtype="Int64"),
            "_bounds": [bounds], "_exits": [exits]})

    key_type = rows.schema["_key"].dataType.simpleString()
    summaries = rows.groupBy("_key", "_block").applyInPandas(
        summarise,
        f"_key {key_type}, _block long, _idle_exit long, _bounds array<long>, _exits array<long>")
    if entry is None:
        summaries = summaries.withColumn("_entry", F.lit(None).cast("long"))
    else:
        state = entry.select(F.col(key).alias("_key"), F.col("engaged_us").alias("_entry"))
        summaries = summaries.join(state, "_key", "left")

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block")
        engaged, entries = _int(pdf["_entry"].iloc[0]), []
        for idle_exit, bounds, exits in zip(pdf["_idle_exit"], pdf["_bounds"], pdf["_exits"]):
            entries.append(engaged)
            if engaged is None:
                engaged = _int(idle_exit)
                continue
            piece = int(np.searchsorted(np.asarray(bounds, dtype="int64"), engaged + cooldown_us, side="right"))
            if piece < len(bounds):
                engaged = _int(exits[piece])
        return pd.DataFrame({
            "_key": pdf["_key"], "_block": pdf["_block"], "_entry": pd.array(entries, dtype="Int64")})

    # One summary row per block of up to a million samples reaches a task here.
    entries = summaries.groupBy("_key").applyInPandas(chain, f"_key {key_type}, _block long, _entry long")

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        blk = _Block(pdf, max_depth, cooldown_us)
        engaged = pd.array([None] * len(blk.us), dtype="Int64")
        for first, stop, since in blk.intervals(_int(pdf["_entry"].iloc[0]))[0]:
            engaged[first:stop] = since
        return blk.frame[["_key", "_seq", "_us", "_depth"]].assign(_engaged=engaged)

    states = rows.join(entries, ["_key", "_block"]).groupBy("_key", "_block").applyInPandas(
        replay, f"_key {key_type}, _seq long, _us long, _depth long, _engaged long")
    return states.select(
        F.col("_key").alias(key), F.col("_seq").alias(seq), F.timestamp_micros("_us").alias(ts),
        F.col("_depth").alias(depth), (F.col("_depth") <= F.lit(max_depth)).alias("accept"),
        F.col("_engaged").isNotNull().alias("active"), F.col("_engaged").alias("engaged_us"))


def transitions(states: DataFrame, key: str = "ingestor", seq: str = "seq", block: Column | None = None) -> DataFrame:
    """Rows at which shedding is engaged or released, with the `event`."""
    stepped = previous(states, [key], [seq], ["active"], seq_block(seq) if block is None else block)
    before = F.coalesce(F.col("prev_active"), F.lit(False))
    event = F.when(F.col("active"), "engaged").otherwise("released")
    return stepped.filter(F.col("active") != before).withColumn("event", event).drop("prev_active")


def dropped(samples: DataFrame, max_depth: int = MAX_QUEUE_DEPTH, key: str = "ingestor", depth: str = "depth") -> DataFrame:
    """Rejected requests per ingestor (requests, not the entries inside them). Rejection depends on the depth alone, so the
    samples are counted as they are."""
    return samples.groupBy(key).agg(F.count_if(F.col(depth) > F.lit(max_depth)).alias("dropped"))

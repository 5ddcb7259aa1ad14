"""Structured Streaming forms of the keyed operators: upserts, first-wins events, bounded ranges."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from boxwise.operators.merge import last_wins
from boxwise.sources.store import KeyedTable


def upsert_stream(stream: DataFrame, table: KeyedTable, order: list[str]) -> DataStreamWriter:
    """Each micro-batch's last row of a key is merged into the table; a repeated batch merges to the same."""

    def merge_batch(batch: DataFrame, _: int) -> None:
        table.upsert(last_wins(batch, table.keys, order))

    return stream.writeStream.foreachBatch(merge_batch)


def first_events(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """The first event of each key; keys are forgotten once the watermark is past them."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, keys: list[str], value: str, length: str, slide: str, delay: str) -> DataFrame:
    """Counts and sums in sliding windows of event time; events later than ``delay`` are left out."""
    grouped = stream.withWatermark(time, delay).groupBy(F.window(time, length, slide), *keys)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def bounded_ranges(stream: DataFrame, key: str, value: str, size: int = 1500) -> DataFrame:
    """Mean +- two deviations of each key's latest ``size`` values, given out again whenever they change."""

    def updated(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        for batch in batches:
            held = (held + batch[value].dropna().astype(float).tolist())[-size:]
        state.update((held,))
        x = pd.Series(held, dtype=float)
        yield pd.DataFrame({key: [k[0]], "n": [len(x)], "lower": [x.mean() - 2 * x.std()], "upper": [x.mean() + 2 * x.std()]})

    kind = stream.schema[key].dataType.simpleString()
    out, held = f"{key} {kind}, n bigint, lower double, upper double", "held array<double>"
    return stream.groupBy(key).applyInPandasWithState(updated, out, held, "update", "NoTimeout")


def games_with_frames(games: DataFrame, frames: DataFrame, key: str, game_time: str, frame_time: str, delay: str, within: str) -> DataFrame:
    """Each game with its frames, from two streams: a frame belongs to a game of its key from the game's time until ``within`` after it.

    Both sides are held until the watermark (``delay`` behind the newest
    event) is past the times that could still meet; a frame later than that
    is left out, and so is a game that no frame came for.
    """
    a = games.withWatermark(game_time, delay).alias("a")
    b = frames.withWatermark(frame_time, delay).withColumnRenamed(key, "_key")
    meets = (F.col(key) == F.col("_key")) & (F.col(frame_time) >= F.col(game_time)) & (F.col(frame_time) <= F.col(game_time) + F.expr(f"interval {within}"))
    return a.join(b, meets).drop("_key")


def trailing_profiles(stream: DataFrame, key: str, time: str, value: str, delay: str, size: int = 10, idle: str = "60 days") -> DataFrame:
    """Each event with mean, population variance and number of its key's ``size`` events before it, in the order of event time.

    An event waits until the watermark is past it, so that those before it
    have come; then it is given out with what stands before it, and takes its
    place in the key's state. Ties in time are ordered by value. Later events
    are left out. A key is forgotten when the watermark is ``idle`` past its
    last event. Nulls are events without a value: they count in ``size``, not
    in the figures.
    """
    kind = stream.schema[key].dataType.simpleString()
    wait = pd.Timedelta(idle)

    def updated(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, seen = (list(state.get[0]), list(state.get[1])) if state.exists else ([], [])
        mark = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
        for batch in batches:
            held += [(t.to_pydatetime(), None if pd.isna(v) else float(v)) for t, v in zip(batch[time], batch[value], strict=True)]
        held = sorted(((pd.Timestamp(t), v) for t, v in held), key=lambda r: (r[0], r[1] is None, r[1] or 0.0))
        ready = [r for r in held if r[0] <= mark]
        held = held[len(ready) :]
        out = []
        for at, v in ready:
            known = pd.Series([x for _, x in seen if x is not None], dtype=float)
            out.append((k[0], at, v, known.mean() if len(known) else None, known.var(ddof=0) if len(known) else None, len(known)))
            seen = [*seen, (at.to_pydatetime(), v)][-size:]
        last = max([pd.Timestamp(seen[-1][0])] if seen else [], default=None)
        if not held and last is not None and mark > last + wait:
            state.remove()
        else:
            state.update(([(t.to_pydatetime(), v) for t, v in held], [(pd.Timestamp(t).to_pydatetime(), v) for t, v in seen]))
            # wakes up when the next waiting event is due, or the key may be forgotten
            due = min((t for t, _ in held), default=None) or last + wait
            state.setTimeoutTimestamp(int(max(due.timestamp() * 1000, state.getCurrentWatermarkMs())) + 1)
        yield pd.DataFrame(out, columns=[key, time, value, "mean", "var", "n"])

    rows = stream.withWatermark(time, delay).select(key, time, F.col(value).cast("double").alias(value))
    at = stream.schema[time].dataType.simpleString()
    shape = f"{key} {kind}, {time} {at}, {value} double, mean double, var double, n bigint"
    event = f"struct<at: {at}, v: double>"
    return rows.groupBy(key).applyInPandasWithState(updated, shape, f"held array<{event}>, seen array<{event}>", "append", "EventTimeTimeout")

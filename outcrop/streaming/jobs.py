"""Structured Streaming: incremental discovery, and event windows with late data."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from outcrop.operators import archive, sequences


def throughput(events: DataFrame, at: str = "ts", value: str = "value", size: str = "3 minutes", slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """(start, end, n, total) over sliding windows; works on a stream (with a watermark) and on a table."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    w = rows.groupBy(F.window(at, size, slide)).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return w.select("window.start", "window.end", "n", "total")


def latest_intent(events: DataFrame, key: str, at: str, order: str) -> DataFrame:
    """The last query of each session: earlier ones are stale. One aggregate, so it also runs as a stream in update mode."""
    return events.groupBy(key).agg(F.max_by(F.struct(*[c for c in events.columns if c != key]), F.struct(at, order)).alias("x")).select(key, "x.*")


def discover(entries: DataFrame, known_path: str, issues: DataFrame, key: str, checkpoint: str):
    """A query that plans each batch of feed entries against what is known and adds it to the known: a batch that is run again plans nothing."""

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        known = spark.read.schema(f"{key} string, batch bigint").option("recursiveFileLookup", "true").parquet(known_path)
        # The same batch again replaces its own folder.
        earlier = known.where(F.col("batch") != number)
        plan = archive.upsert_plan(df.dropDuplicates([key]), earlier, issues, key)
        plan.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{checkpoint}/plans/batch={number}")
        df.select(key).distinct().withColumn("batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{known_path}/part={number}")

    return entries.writeStream.foreachBatch(batch).option("checkpointLocation", f"{checkpoint}/state").trigger(availableNow=True).start()


# --- state that closes: queries that settle, downloads that stall


def _ms(at: str):
    return F.unix_millis(F.col(at).cast("timestamp"))


def settled(events: DataFrame, key: str, at: str = "ts", query: str = "query", delay_ms: int = 175) -> DataFrame:
    """(key, at, query): the queries of a session that no later one follows within delay_ms. A table's rows are looked at in order, over groups of any length; of rows at one time the
    last by text counts. See settling() for a stream."""
    last = events.groupBy(key, at).agg(F.max(query).alias(query)).withColumn("_back", -_ms(at))
    p = sequences.with_previous(last, [key], ["_back"], ["_back"])
    return p.where(F.col("previous__back").isNull() | (F.col("_back") - F.col("previous__back") >= delay_ms)).select(key, at, query)


def settling(events: DataFrame, key: str, at: str = "ts", query: str = "query", delay_ms: int = 175, late: str = "1 minute") -> DataFrame:
    """settled() of a stream: each session has one open query as its state, and it is put out, and the state closed, once a later one comes after the delay or the watermark has passed it. Rows
    that come too late for the watermark are left out; state is in the checkpoint, so a restart goes on where the last run stopped."""

    def step(session, frames, state: GroupState):
        open_ = state.getOption  # (milliseconds, query)
        out = []
        if state.hasTimedOut:
            out.append(open_)
            state.remove()
        else:
            for t, q in sorted((int(t), q) for frame in frames for t, q in zip(frame["_ms"], frame[query], strict=True)):
                if open_ and t - open_[0] >= delay_ms:
                    out.append(open_)
                if not open_ or t >= open_[0]:  # an older one is stale
                    open_ = (t, q)
            state.update(open_)
            state.setTimeoutTimestamp(max(open_[0] + delay_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [session[0]] * len(out), at: pd.to_datetime([t for t, _ in out], unit="ms", utc=True), query: [q for _, q in out]})

    kind = events.schema[key].dataType.simpleString()
    rows = events.withWatermark(at, late).withColumn("_ms", _ms(at))
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {at} timestamp, {query} string", "ms bigint, query string", "append", GroupStateTimeout.EventTimeTimeout)


def stalled(progress: DataFrame, key: str, at: str = "ts", amount: str = "bytes", stall_ms: int = 10_000) -> DataFrame:
    """(key, at, received): downloads that were silent for more than stall_ms after some piece: when that piece came, and what had come by then; the first such pause of each. The last piece of all has none after
    it, so it tells nothing. For a table; see meter() for a stream."""
    sums = progress.groupBy(key, at).agg(F.sum(amount).alias(amount)).withColumn("_back", -_ms(at))
    p = sequences.with_previous(sums, [key], ["_back"], ["_back"]).where(F.col("_back") - F.col("previous__back") > stall_ms)
    first = p.groupBy(key).agg(F.min(at).alias(at))
    upto = progress.join(first.withColumnRenamed(at, "_first"), key).where(F.col(at) <= F.col("_first"))
    return upto.groupBy(key, F.col("_first").alias(at)).agg(F.sum(amount).alias("received"))


def meter(progress: DataFrame, key: str, total: int, at: str = "ts", amount: str = "bytes", budget_ms: int = 60_000, warm_bytes: int = 512 * 1024, warm_ms: int = 1000, window_ms: int = 3000, stall_ms: int = 10_000, late: str = "1 minute") -> DataFrame:
    """(key, at, verdict, received) of a stream of pieces: done when `total` has come, slow when a pause is longer than stall_ms, or when what came in the last window_ms, after a warm-up, means that the whole takes more than
    budget_ms. One verdict closes a download; its state stays closed, so that pieces that come after it change nothing, until the watermark is a budget past it."""

    def step(group, frames, state: GroupState):
        closed, started, received, last, since, before = state.getOption or (False, 0, 0, 0, [], [])
        since, before, out = list(since), list(before), []

        def close(t, verdict):
            out.append((t, verdict, received))
            return True

        if state.hasTimedOut:
            if not closed:
                closed = close(last + stall_ms, "slow")
            else:
                state.remove()
        else:
            for t, n in sorted((int(t), int(n)) for frame in frames for t, n in zip(frame["_ms"], frame[amount], strict=True)):
                if closed:
                    continue
                if not since:
                    started = t
                elif t - last > stall_ms:
                    closed = close(last + stall_ms, "slow")
                    continue
                received, last = received + n, max(t, last)
                since.append(last)
                before.append(received)
                while len(since) > 1 and last - since[1] >= window_ms:
                    del since[0], before[0]
                rate = (received - before[0]) / max(1, last - since[0])
                if received >= total:
                    closed = close(last, "done")
                elif received >= warm_bytes and last - started >= warm_ms and rate > 0 and last - started + (total - received) / rate > budget_ms:
                    closed = close(last, "slow")
        if state.exists or not state.hasTimedOut:
            state.update((closed, started, received, last, since, before))
            state.setTimeoutTimestamp(max(last + (budget_ms if closed else stall_ms + 1), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [group[0]] * len(out), at: pd.to_datetime([t for t, _, _ in out], unit="ms", utc=True), "verdict": [v for _, v, _ in out], "received": [r for _, _, r in out]})

    kind = progress.schema[key].dataType.simpleString()
    rows = progress.withWatermark(at, late).withColumn("_ms", _ms(at))
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {at} timestamp, verdict string, received bigint", "closed boolean, started bigint, received bigint, last bigint, since array<bigint>, before array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)

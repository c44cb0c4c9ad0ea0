"""Structured Streaming operators (O-260..O-271) and windowed extensions; each also runs on a batch table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Role of each kind of session event.
ROLES = {"message": "user", "tool_call": "tool", "tool_result": "assistant", "error": "system"}


def ingest_events(events: DataFrame) -> DataFrame:
    """O-260: session events with a role and some content as memory rows; stateless, batch or stream."""
    role = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in ROLES.items()])
    rows = events.withColumn("role", role).where(F.col("role").isNotNull() & (F.trim("content") != ""))
    text = F.concat(F.lit("["), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("] "), "role", F.lit(": "), "content")
    return rows.select(F.concat(F.lit("sessions/"), "session_id", F.lit("/thread")).alias("path"), "session_id", "timestamp", "role", text.alias("content"))


def subscribed(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """O-31, O-261: events with the subscribers they reach; an empty subscription reaches nothing.

    ``subscriptions`` (``subscriber``, arrays ``agents, projects, types``; null or empty: any) is a small registry.
    """
    any_of = lambda wanted, value: F.coalesce(F.size(wanted) == 0, F.lit(True)) | wanted.isNull() | F.array_contains(wanted, value)
    some = F.coalesce(F.size("agents"), F.lit(0)) + F.coalesce(F.size("projects"), F.lit(0)) + F.coalesce(F.size("types"), F.lit(0)) > 0
    match = any_of(F.col("agents"), F.col("agent")) & any_of(F.col("projects"), F.col("project")) & any_of(F.col("types"), F.col("event_type"))
    return events.join(subscriptions.where(some), match)


def working_memory(events: DataFrame, capacity: int = 100) -> DataFrame:
    """O-159, O-263: per session the items now held: at the capacity the oldest item read less than twice goes, else the least recently read.

    ``session_id, item, ts``: an item seen again counts as read. Bounded keyed state.
    """

    def hold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, created, read, counts = (list(x) for x in state.get) if state.exists else ([], [], [], [])
        for frame in frames:
            for item, ts in frame.sort_values("ts")[["item", "ts"]].itertuples(index=False):
                at = int(ts.value // 1000)
                if item in names:
                    i = names.index(item)
                    read[i], counts[i] = at, counts[i] + 1
                    continue
                if len(names) >= capacity:
                    rare = [i for i in range(len(names)) if counts[i] < 2]
                    i = min(rare, key=created.__getitem__) if rare else min(range(len(names)), key=read.__getitem__)
                    for column in (names, created, read, counts):
                        del column[i]
                names.append(item), created.append(at), read.append(at), counts.append(0)
        state.update((names, created, read, counts))
        yield pd.DataFrame({"session_id": [key[0]], "held": [len(names)], "items": [",".join(names)]})

    return events.groupBy("session_id").applyInPandasWithState(
        hold, "session_id string, held int, items string", "names array<string>, created array<long>, read array<long>, counts array<long>", "update", GroupStateTimeout.NoTimeout
    )


def append_timeline(events: DataFrame) -> DataFrame:
    """O-262: sequence and hash chain per workspace; the state is the last sequence and hash."""
    import hashlib

    def link(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sequence, prev = state.get if state.exists else (0, "")
        for frame in frames:
            rows = []
            for payload in frame.sort_values(["ts", "payload"])["payload"]:
                sequence += 1
                curr = hashlib.sha256(f"{prev}|{sequence}|{payload}".encode()).hexdigest()
                rows.append((key[0], sequence, payload, prev, curr))
                prev = curr
            yield pd.DataFrame(rows, columns=["workspace_id", "sequence", "payload", "prev_hash", "curr_hash"])
        state.update((sequence, prev))

    return events.groupBy("workspace_id").applyInPandasWithState(
        link, "workspace_id string, sequence long, payload string, prev_hash string, curr_hash string", "sequence long, prev string", "append", GroupStateTimeout.NoTimeout
    )


def stale_agents(heartbeats: DataFrame, as_of: Column, seconds: int = 300) -> DataFrame:
    """O-33, O-266: agents by the age of their last sign of life."""
    last = heartbeats.groupBy("agent").agg(F.max("ts").alias("last_seen"))
    return last.withColumn("stale", as_of.cast("double") - F.col("last_seen").cast("double") >= seconds)


def route_messages(messages: DataFrame, topics: DataFrame, agents: DataFrame) -> DataFrame:
    """O-267: to the addressee, else to the topic's subscribers, else to all agents (a small registry), not to the sender."""
    direct = messages.where("recipient IS NOT NULL").select("message_id", F.col("recipient").alias("agent"))
    rest = messages.where("recipient IS NULL")
    by_topic = rest.join(topics, "topic").select("message_id", "agent", "sender")
    nobody = rest.join(topics.select("topic").distinct(), "topic", "left_anti")
    to_all = nobody.select("message_id", "sender").join(F.broadcast(agents))
    others = by_topic.unionByName(to_all.select("message_id", "agent", "sender")).where("agent <> sender").select("message_id", "agent")
    return direct.unionByName(others)


def windowed_counts(events: DataFrame, length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Extension: counts and sums per tumbling or sliding window and type, with a watermark on streams."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    out = timed.groupBy(window, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Extension: session windows per user."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    out = timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def run_available(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> None:
    """Run a stream over what is there into a table in memory (for tests and examples)."""
    writer = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    writer.start().awaitTermination()


def event_sink(changes: DataFrame, path: str, checkpoint: str, once: bool = True):
    """O-16: every batch of changes goes to its own folder ``batch=<n>``, so that a batch which is repeated after a failure is written once.

    Returns the running query; with ``once`` it ends when what is there has been read.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

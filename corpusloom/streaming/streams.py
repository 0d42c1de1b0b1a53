"""Structured Streaming: event windows, deduplication, incremental stores, trajectories with state. The functions take any
DataFrame, so they run on bounded tables too."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.functions.text import content_id
from corpusloom.operators.ranking import top_k


def _late(df: DataFrame, ts: str, late: str | None) -> DataFrame:
    return df.withWatermark(ts, late) if late and df.isStreaming else df


def windowed(events: DataFrame, ts: str, width: str, keys: list[str], value: str, slide: str | None = None, late: str | None = "10 minutes") -> DataFrame:
    """(window_start, keys, n, total) of tumbling or sliding windows."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = _late(events, ts, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.round(F.sum(value), 6).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def sessions(events: DataFrame, ts: str, gap: str, key: str, late: str | None = "10 minutes") -> DataFrame:
    """(key, session_start, session_end, n): events of a key with less than a gap between them; the end is the last event plus the gap."""
    out = _late(events, ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def distinct_texts(texts: DataFrame, namespace: str = "") -> DataFrame:
    """Texts with their content id, each once in the life of the stream."""
    return texts.withColumn("hash_id", content_id("text", namespace)).dropDuplicates(["hash_id"])


def upsert_batches(texts: DataFrame, store: str, encode: Callable, checkpoint: str, namespace: str = ""):  # noqa: ANN201
    """Writer that adds the texts a Parquet store lacks, encoded, batch by batch. A batch that is run again adds nothing twice."""

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.select(content_id("text", namespace).alias("hash_id"), "text").dropDuplicates(["hash_id"])
        try:
            new = new.join(spark.read.parquet(store).select("hash_id"), "hash_id", "left_anti")
        except Exception as e:  # the first batch finds no store
            if "PATH_NOT_FOUND" not in str(e):
                raise
        new.withColumn("embedding", encode(F.col("text"))).write.mode("append").parquet(store)

    return texts.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)


def trajectories(actions: DataFrame, max_turns: int = 4) -> DataFrame:
    """(id, turn, active, n_valid, n_search, done) of a stream of (id, action): counters of each trajectory over its turns.
    A finished trajectory, or one at its last turn, is inactive from then on."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        turn, valid, search, done = state.get if state.exists else (0, 0, 0, False)
        out = []
        for pdf in batches:
            for a in pdf["action"]:
                active = not done
                if active:
                    turn, valid, search = turn + 1, valid + (a in ("search", "answer")), search + (a == "search")
                    done = a == "answer" or turn >= max_turns
                out.append((key[0], turn, active, valid, search, done))
        state.update((turn, valid, search, done))
        yield pd.DataFrame(out, columns=["id", "turn", "active", "n_valid", "n_search", "done"])

    return actions.groupBy("id").applyInPandasWithState(update, "id string, turn int, active boolean, n_valid int, n_search int, done boolean", "turn int, n_valid int, n_search int, done boolean", "append", GroupStateTimeout.NoTimeout)


def smallest(rows: DataFrame, shard: str, key: str, k: int, seed: int = 42) -> DataFrame:
    """Rows (shard, keys): the k keys of each shard with the least seeded hash so far, a sample of a stream in one pass. The state of a stream is k keys a shard;
    of a bounded table the k first are kept before and after the shuffle."""
    h = F.struct(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(shard), F.lit(":"), F.col(key).cast("string")), 256).alias("h"), F.col(key).alias("key"))
    named = rows.select(F.col(shard).alias("shard"), h.alias("h")).select("shard", "h.h", "h.key")
    kind = rows.schema[key].dataType.simpleString()
    if not rows.isStreaming:
        first = top_k(named.distinct(), k, ["shard"], [F.asc("h"), F.asc("key")])
        return first.groupBy("shard").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "key"))), lambda x: x["key"]).alias("keys")).withColumnRenamed("shard", shard)

    def update(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = dict(zip(*state.get, strict=True)) if state.exists else {}
        for pdf in batches:
            best |= dict(zip(pdf["h"], pdf["key"], strict=True))
            best = dict(sorted(best.items())[:k])
        state.update((list(best), list(best.values())))
        yield pd.DataFrame({shard: [group[0]], "keys": [list(best.values())]})

    return named.groupBy("shard").applyInPandasWithState(update, f"`{shard}` {rows.schema[shard].dataType.simpleString()}, keys array<{kind}>", f"h array<string>, keys array<{kind}>", "update", GroupStateTimeout.NoTimeout)

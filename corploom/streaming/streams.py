"""Streams: exact deduplication as rows arrive, windows of events, idempotent shard output, replay by offset."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sinks import shards


def rows_stream(spark: SparkSession, folder: str, schema, files: int = 100) -> DataFrame:
    """A stream over the Parquet files of a folder, at most ``files`` per trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(folder)


def dedup_stream(rows: DataFrame) -> DataFrame:
    """The first arrival of every digest and licence; a copy is dropped however late it comes, so the state has every digest that was seen."""
    return rows.dropDuplicates(["content_sha256", "license"])


def dedup_stream_within(rows: DataFrame, time: str = "received_at", delay: str = "30 days") -> DataFrame:
    """The same with a bounded state: copies that come within ``delay`` of the first arrival are dropped, later ones are kept again."""
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(["content_sha256", "license"])


def event_windows(events: DataFrame, size: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Events and sums of value by window and kind; an extension, nothing here is driven by event time elsewhere."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 6).alias("value")).select(F.col("window.start").alias("start"), "event_type", "events", "value")


def write_shards_stream(rows: DataFrame, folder: str, checkpoint: str):
    """Writes every micro-batch as content-addressed shards: a batch that runs again writes the same names, so each row is kept once."""

    def one(batch: DataFrame, number: int) -> None:
        shards.write_shards(batch, folder).write.mode("overwrite").parquet(f"{folder}/_written/{number}")

    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pack_stream(records: DataFrame, length: int) -> DataFrame:
    """corpus, window, targets as records (corpus, seq, tokens) arrive: continuous packing of each corpus, as training.pack_windows does it.

    The state of a corpus is the place its next token has. A record's parts of windows come out at once, so a window
    that holds several records has several rows, whose targets add up. Within a batch records go by seq.
    """

    def add(key, batches, state: GroupState):
        at = state.get[0] if state.exists else 0
        pdf = pd.concat(list(batches)).sort_values("seq")
        out = []
        for n in pdf["tokens"]:
            a, z = max(at, 1), at + int(n)  # the end token is at z
            out += [(key[0], w, min(z, (w + 1) * length) - max(a, w * length + 1) + 1) for w in range((a - 1) // length, (z - 1) // length + 1) if z >= a]
            at = z + 1
        state.update((at,))
        yield pd.DataFrame(out, columns=["corpus", "window", "targets"])

    return records.groupBy("corpus").applyInPandasWithState(add, "corpus string, window long, targets long", "at long", "append", GroupStateTimeout.NoTimeout)


def shuffle_stream(records: DataFrame, seed: int, most: int = 1024) -> DataFrame:
    """corpus, id, place as records (corpus, id) arrive: each corpus passes a buffer of ``most`` records from which a random one is drawn when it is full.

    The state of a corpus is its buffer, the draws' state and the number given out; what is in the buffer at the end of
    a stream is still to come. Bytes are not counted here: bound a record's size before.
    """
    from ..operators.training import MASK, SplitMix

    def draw(key, batches, state: GroupState):
        buffer, place, at = list(state.get[0]) if state.exists else [], *(state.get[1:] if state.exists else (0, seed & MASK))
        rng = SplitMix(int(at))
        out = []
        for pdf in batches:
            for i in pdf["id"]:
                if len(buffer) >= most:
                    k = rng.next() % len(buffer)
                    buffer[k], buffer[-1] = buffer[-1], buffer[k]
                    out.append((key[0], buffer.pop(), place))
                    place += 1
                buffer.append(i)
        state.update((buffer, place, str(rng.state)))
        yield pd.DataFrame(out, columns=["corpus", "id", "place"])

    return records.groupBy("corpus").applyInPandasWithState(draw, "corpus string, id string, place long", "buffer array<string>, place long, state string", "append", GroupStateTimeout.NoTimeout)


def interleave_stream(records: DataFrame, weights: dict[str, int]) -> DataFrame:
    """records (corpus, seq, tokens) with ``key`` as they arrive: what the corpus gave before, by its weight; sorted by it, corpora take turns.

    The key is that of training.weighted_order, so a consumer that merges by it sees the same order. Corpora without a
    weight are left out. The state of a corpus is the tokens it gave.
    """
    from math import lcm

    whole = lcm(*weights.values())

    def place(key, batches, state: GroupState):
        before = state.get[0] if state.exists else 0
        pdf = pd.concat(list(batches)).sort_values("seq")
        total = pdf["tokens"].cumsum()
        keys = [str((before + int(t) - int(n)) * (whole // weights[key[0]])) for t, n in zip(total, pdf["tokens"])]
        state.update((before + int(total.iloc[-1]),))
        yield pdf[["corpus", "seq", "tokens"]].assign(key=keys)

    return records.where(F.col("corpus").isin(*weights)).groupBy("corpus").applyInPandasWithState(place, "corpus string, seq long, tokens long, key string", "before long", "append", GroupStateTimeout.NoTimeout)


class Progress(StreamingQueryListener):
    """Keeps what queries report: (name, batch, rows read, rows a second) of every trigger, and the names of those that ended."""

    def __init__(self):
        self.triggers: list[tuple] = []
        self.ended: list[str | None] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.triggers.append((p.name, p.batchId, p.numInputRows, p.processedRowsPerSecond))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.append(event.exception)


def in_order(calls, workers: int = 4):
    """The results of calls that run side by side, in the order of the calls; the first failure is raised in its place."""
    with ThreadPoolExecutor(workers) as pool:
        yield from pool.map(lambda call: call(), calls)


def resume(ordered: DataFrame, done: int, place: str = "place") -> DataFrame:
    """The rows of an ordered view that a consumer has not taken yet."""
    return ordered.where(F.col(place) >= done)

"""The review log as a stream: each micro-batch is folded into the table of item states."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fathomkb.operators.claims import TERMINAL, fold_reviews

SCHEMA = "seq long, item_id string, action string, reviewer string, ts timestamp, value double"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).parquet(path)


def fold_stream(log: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append each batch to the log under target/log and write the folded states to target/state/<batch>; a batch that runs again replaces itself."""

    def step(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/log/batch={number}")
        whole = batch.sparkSession.read.schema(SCHEMA).parquet(f"{target}/log").filter(F.col("seq").isNotNull())
        fold_reviews(whole).write.mode("overwrite").parquet(f"{target}/state/{number:09d}")

    return log.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One item's events of a batch into its state: the events (seq, action) up to the first that ends it, each once."""
    seqs, actions = state.get if state.exists else ([], [])
    log = dict(zip(seqs, actions))
    for pdf in batches:
        for seq, action in zip(pdf["seq"].tolist(), pdf["action"].tolist()):
            log.setdefault(seq, action)
    ended = min((s for s, a in log.items() if a in TERMINAL), default=None)
    log = {s: a for s, a in sorted(log.items()) if ended is None or s <= ended}
    state.update((list(log), list(log.values())))
    said = [a for a in log.values() if a in (*TERMINAL, "edited")]
    yield pd.DataFrame({"item_id": [key[0]], "status": [said[-1] if said else "proposed"], "n_applied": [len(log)], "last_seq": [max(log)]})


def item_states(log: DataFrame) -> DataFrame:
    """A stream of the states (item_id, status, n_applied, last_seq) of the items that each batch touches, as fold_reviews gives them over all events so far.

    State is kept by item, so work grows with a batch and the items in it, not with the log. Events that come late, in any order or
    again (known by seq) change nothing that they shouldn't: an item keeps its events up to the first that ends it, as one
    before that may still come. Events without seq are left out; a null item is an item.
    """
    out, kept = "item_id string, status string, n_applied long, last_seq long", "seqs array<long>, actions array<string>"
    rows = log.filter("seq is not null").select("seq", "item_id", "action").groupBy("item_id")
    return rows.applyInPandasWithState(_fold, out, kept, "update", GroupStateTimeout.NoTimeout)


def activity(log: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by action in tumbling windows of event time, with a watermark."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", window), "action").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "action", "n")

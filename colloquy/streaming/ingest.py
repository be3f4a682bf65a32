"""Streams of messages: new sessions merged batch by batch, turns closed as speakers change, counts by event time.

An extension: the batch operators define the results, and these reach the same ones as rows arrive.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TURN = "session_id long, turn_id int, speaker string, messages int, first_seq long, last_seq long"
_STATE = "turn_id int, speaker string, messages int, first_seq long, last_seq long"


def close_turns(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A turn is given out when another speaker follows, or a row without a speaker, which ends the session; the open turn is the state."""
    turn = state.get if state.exists else None
    done = []
    for r in pd.concat(list(batches)).sort_values("seq").itertuples(index=False):
        speaker = r.speaker if isinstance(r.speaker, str) else None
        if turn is not None and turn[1] == speaker:
            turn = (turn[0], turn[1], turn[2] + 1, turn[3], int(r.seq))
            continue
        if turn is not None:
            done.append((key[0], *turn))
        turn = (turn[0] + 1 if turn is not None else 1, speaker, 1, int(r.seq), int(r.seq)) if speaker else None
    if turn is not None:
        state.update(turn)
    elif state.exists:
        state.remove()
    yield pd.DataFrame(done, columns=["session_id", "turn_id", "speaker", "messages", "first_seq", "last_seq"])


def stream_turns(messages: DataFrame) -> DataFrame:
    """Closed turns of a stream of session_id, seq, speaker; messages of a session come in the order of their batches."""
    return messages.groupBy("session_id").applyInPandasWithState(close_turns, TURN, _STATE, "append", GroupStateTimeout.NoTimeout)


def event_counts(events: DataFrame, size: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts and sums by event type and window of ts; rows later than the watermark don't count."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    return by.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def upsert_stream(rows: DataFrame, path: str, keys: list[str], checkpoint: str) -> DataStreamWriter:
    """Merge each batch into versions under path: a batch that runs again writes its own version again.

    Of a batch's rows with one key the greatest counts, compared column by column. The last two versions stay, so a
    reader of the one before isn't disturbed.
    """

    def merge(batch: DataFrame, number: int) -> None:
        from ..sources.tables import upsert

        spark = batch.sparkSession
        rest = [c for c in batch.columns if c not in keys]
        new = batch.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("r")).select(*keys, "r.*").select(batch.columns) if rest else batch.distinct()
        if number:
            new = upsert(spark.read.parquet(f"{path}/v{number - 1}"), new, keys)
        new.write.mode("overwrite").parquet(f"{path}/v{number}")
        if number > 1:
            old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v{number - 2}")
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)

"""Conversation state as a stream: the same fold as the batch form, state kept by Spark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from citeloom.operators import conversation as C
from citeloom.session import staged

TURNS = "conv_id string, turn long, query_text string"
PREPARED = (
    "conv_id string, turn long, query_text string, prefecture string, city string, service_type string, "
    "service_known boolean, names_facility boolean, keywords array<string>, contact_requested boolean"
)
STATE = "prefecture string, city string, service_type string, service_known boolean, keywords array<string>"


def start_prepare(stream: DataFrame, facilities: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """First stage: parse the own slots of arriving turns (columns of :data:`TURNS`) into ``out``."""

    def run(batch: DataFrame, batch_id: int) -> None:
        prepared = C.prepare_turns(batch, facilities)
        prepared.write.mode("overwrite").parquet(f"{out}/batch={batch_id:012d}")

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def resolve_stream(prepared: DataFrame, cover: C.Coverage) -> DataFrame:
    """Resolved turns of a streaming table of prepared turns; state per conversation.

    Only the turns of one conversation in one micro-batch are held at a time.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        slots = C.Slots()
        if state.exists:
            values = state.get
            slots = C.Slots(values[0], values[1], values[2], bool(values[3]), list(values[4]))
        turns = sorted((t for b in batches for t in C.turn_records(b)), key=lambda t: t["turn"])
        rows = []
        for turn in turns:
            slots, resolved = C.advance(slots, turn, cover)
            rows.append(resolved)
        state.update((slots.prefecture, slots.city, slots.service_type, slots.service_known, slots.keywords))
        yield C.resolved_frame(rows)

    return prepared.groupBy("conv_id").applyInPandasWithState(
        run, C.RESOLVED, STATE, "append", GroupStateTimeout.NoTimeout
    )


def start_resolve(
    spark: SparkSession, prepared_path: str, facilities: DataFrame, out: str, checkpoint: str, k: int = 3
) -> StreamingQuery:
    """Second stage: fold the prepared turns and write the answers of each micro-batch."""
    cover = C.coverage(facilities)
    prepared = spark.readStream.schema(PREPARED + ", batch string").parquet(prepared_path).drop("batch")

    def run(batch: DataFrame, batch_id: int) -> None:
        # the search reads the resolved turns several times: they are folded, and their state kept, once
        answers, _ = C.answer_turns(staged(batch), facilities, k)
        answers.write.mode("overwrite").parquet(f"{out}/batch={batch_id:012d}")

    return (
        resolve_stream(prepared, cover)
        .writeStream.foreachBatch(run)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

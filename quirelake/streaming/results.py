"""Results written as they come: batches of groups go to a translator, finished lines are appended, restarts go on where they stopped."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Translator(Protocol):
    """What a model has to offer. It is made on the executor, once a task."""

    def generate(self, prompts: list[str], max_new_tokens: int) -> list[str]: ...


def translate(records: DataFrame, make: type, size: int = 8) -> DataFrame:
    """(book_id, group_start, output) of records (book_id, group_start, prompt, max_new_tokens). A batch that runs out of memory is
    halved down to single prompts. The stage is not deterministic in general: write its result before several consumers read it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()

        def answer(prompts: list[str], most: int) -> list[str]:
            try:
                return model.generate(prompts, most)
            except MemoryError:
                if len(prompts) == 1:
                    raise
                half = len(prompts) // 2
                return answer(prompts[:half], most) + answer(prompts[half:], most)

        for batch in batches:
            outputs = []
            for i in range(0, len(batch), size):
                part = batch.iloc[i : i + size]
                outputs += answer(part["prompt"].tolist(), int(part["max_new_tokens"].max()))
            yield pd.DataFrame({"book_id": batch["book_id"], "group_start": batch["group_start"], "output": outputs})

    ordered = records.repartitionByRange("max_new_tokens", "book_id", "group_start").sortWithinPartitions("max_new_tokens")
    return ordered.select("book_id", "group_start", "prompt", "max_new_tokens").mapInPandas(run, "book_id long, group_start int, output string")


def append(stream: DataFrame, path: str, checkpoint: str):
    """Appends each micro-batch of (book_id, index, text) to the results at ``path``; a batch that is run again after a restart replaces
    itself, as it writes to a folder of its own."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("written_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Work sessions of a book in a stream of results: first and last record and their number, closed after ``gap`` of silence."""
    marked = events.withWatermark("written_at", late)
    return marked.groupBy("book_id", F.session_window("written_at", gap)).agg(F.count("*").alias("records"))

"""Answers of models, asked for once: a store keyed by the prompt, and a table of failures with their reason."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.operators.graph import cut
from storyloom.operators.joins import join_counted
from storyloom.streaming.store import BatchStore

TABLES = {"answers": "hash string, answer string", "failures": "hash string, prompt string, error string"}


def prompt_hash(prompt: Column, model: Column | str = "") -> Column:
    """What an answer is stored under: the model and the whole prompt."""
    model = F.lit(model) if isinstance(model, str) else model
    return F.sha2(F.concat(model, F.lit("\n"), prompt), 256)


class AnswerStore(BatchStore):
    """Answers and failures of all runs.

    A prompt that many rows have, or that an earlier run answered, is asked once. One that failed is asked again by the
    next run; its failures stay, with their reasons. Null prompts are asked nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, model: str = ""):
        super().__init__(spark, folder, TABLES)
        self.model = model

    def ask(self, prompts: DataFrame, make: Callable[[], Callable[[str], str]], prompt_col: str = "prompt") -> int:
        """Ask for what has no answer yet; ``make`` makes the function that answers, once per task. Gives the run's number.

        A call that raises, or answers nothing, is a failure of its prompt alone.
        """
        there = self.batches()
        number = there[-1] + 1 if there else 0
        asked = prompts.where(F.col(prompt_col).isNotNull()).groupBy(prompt_hash(F.col(prompt_col), self.model).alias("hash")).agg(F.min(prompt_col).alias("prompt"))
        fresh = asked.join(self.read("answers").select("hash"), "hash", "left_anti")

        def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            answer = None
            for batch in batches:
                out = []
                for prompt in batch.column(1).to_pylist():
                    answer = answer or make()
                    try:
                        told = answer(prompt)
                        out.append((told, None) if told is not None else (None, "no answer"))
                    except Exception as error:  # noqa: BLE001
                        out.append((None, f"{type(error).__name__}: {error}"))
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([x[k] for x in out], pa.string()) for k in (0, 1))], ["hash", "prompt", "answer", "error"])

        # Stored before it is split in two, so that each prompt is asked once.
        told = cut(fresh.select("hash", "prompt").mapInArrow(call, "hash string, prompt string, answer string, error string"))
        self.commit(number, {"answers": told.where("answer IS NOT NULL"), "failures": told.where("answer IS NULL")})
        return number

    def answered(self, rows: DataFrame, prompt_col: str = "prompt") -> DataFrame:
        """``rows`` with ``answer`` and ``error``: the stored answer, or why the last run that asked has none."""
        keyed = rows.withColumn("_hash", prompt_hash(F.col(prompt_col), self.model))
        errors = self.latest("failures", "hash").select("hash", "error")
        known = self.read("answers").select("hash", "answer").join(errors, "hash", "full")
        known = known.select(F.col("hash").alias("_hash"), "answer", F.when(F.col("answer").isNull(), F.col("error")).alias("error"))
        counted = cut(keyed.where(F.col("_hash").isNotNull()).groupBy("_hash").agg(F.count("*").alias("n")).join(known, "_hash"))
        total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        told = join_counted(keyed, counted, "_hash", total)
        rest = keyed.join(counted.select("_hash"), "_hash", "left_anti").withColumns({"answer": F.lit(None).cast("string"), "error": F.lit(None).cast("string")})
        return told.select(*rows.columns, "answer", "error").unionByName(rest.select(*rows.columns, "answer", "error"))

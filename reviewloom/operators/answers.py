"""Answers of a model, asked once per distinct prompt and kept.

Prompts are told apart by their SHA-256 digest. A model is a function on a list of prompts
that gives a list of answers, where an item may be an exception; ``one_by_one`` makes one
of a function on a single prompt. Answers are written as they come, slice by slice, into a
folder that outlives the job: whoever asks with the same folder again asks only what is
not there yet, so a lost task costs its own slice and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reviewloom.session import shared_folder, stored
from reviewloom.sources.folders import numbered_folders

ListModel = Callable[[list[str]], list]
#: Prompts of one call.
LIST_SIZE = 64
_ANSWER = "digest string, answer string, error string"


def one_by_one(model: Callable[[str], str]) -> ListModel:
    """A model of single prompts as one of lists; what it raises for a prompt is that prompt's answer."""
    def ask(prompt: str):
        try:
            return model(prompt)
        except Exception as failure:  # noqa: BLE001 - any model error becomes a row
            return failure
    return lambda prompts: [ask(prompt) for prompt in prompts]


def _asked(model: ListModel, prompts: list[str]) -> list:
    """The answers of a list; if the whole list fails, each of its prompts is asked alone."""
    try:
        found = list(model(prompts))
    except Exception as failure:  # noqa: BLE001
        return [failure] if len(prompts) == 1 else [x for p in prompts for x in _asked(model, [p])]
    if len(found) != len(prompts):
        raise ValueError(f"the model gave {len(found)} answers to {len(prompts)} prompts")
    return found


def digest(prompt: Column) -> Column:
    return F.sha2(prompt, 256)


def ask_once(prompts: DataFrame, make_model: Callable[[], ListModel], prompt_col: str = "prompt", path: str | None = None,
             slices: int = 1, list_size: int = LIST_SIZE) -> DataFrame:
    """``digest, answer, error`` of every distinct prompt that is not NULL.

    ``make_model`` runs once per task. ``path`` is where answers are kept; without it they are kept for
    this call. ``slices`` cuts the work into that many jobs, each of which is kept when it ends.
    """
    spark, path = prompts.sparkSession, path or shared_folder(prompts.sparkSession, "answers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make_model()
        for batch in batches:
            for at in range(0, len(batch), list_size):
                part = batch.slice(at, list_size)
                found = _asked(model, part.column(1).to_pylist())
                failed = [isinstance(x, Exception) for x in found]
                yield pa.record_batch({
                    "digest": part.column(0),
                    "answer": pa.array([None if f or x is None else str(x) for x, f in zip(found, failed)], pa.string()),
                    "error": pa.array([str(x) if f else None for x, f in zip(found, failed)], pa.string())})

    done = numbered_folders(spark, path, "slice")
    wanted = (prompts.select(F.col(prompt_col).alias("prompt")).where("prompt IS NOT NULL")
              .groupBy(digest(F.col("prompt")).alias("digest")).agg(F.any_value("prompt").alias("prompt")))
    if done:
        wanted = wanted.join(_kept(spark, path, done).select("digest"), "digest", "left_anti")
    if slices > 1:
        wanted = stored(wanted, "wanted")
    first = max(done, default=-1) + 1
    for number in range(slices):
        own = wanted.where(F.pmod(F.xxhash64("digest"), F.lit(slices)) == number) if slices > 1 else wanted
        own.mapInArrow(run, _ANSWER).write.mode("overwrite").parquet(f"{path}/slice={first + number}")
    return _kept(spark, path, [*done, *range(first, first + slices)])


def _kept(spark, path: str, numbers: list[int]) -> DataFrame:
    return spark.read.schema(_ANSWER).parquet(*(f"{path}/slice={n}" for n in numbers))


def with_answers(prompts: DataFrame, answers: DataFrame, fallback: str, prompt_col: str = "prompt",
                 fallback_fields: tuple[str, ...] = (), trim: Callable[[Column], Column] | None = None) -> DataFrame:
    """Add ``result`` and ``error``; a prompt that failed gets the fallback text.

    In it ``{error}`` stands for the reason and ``{name}`` for a listed column. ``trim`` is applied to real answers.
    """
    text = F.lit(fallback)
    for name in fallback_fields:
        text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(F.col(name).cast("string"), F.lit("None")))
    failed = F.replace(text, F.lit("{error}"), F.col("__error"))
    real = trim(F.col("__answer")) if trim else F.col("__answer")
    found = answers.select(F.col("digest").alias("__digest"), F.col("answer").alias("__answer"), F.col("error").alias("__error"))
    met = prompts.join(found, digest(F.col(prompt_col)) == F.col("__digest"), "left")
    return met.select(*prompts.columns, F.when(F.col("__error").isNotNull(), failed).otherwise(real).alias("result"),
                      F.col("__error").alias("error"))

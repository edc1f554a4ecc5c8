"""Models are called from outside a query plan: a protocol, and stand-ins that always answer the same."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import checkpointed


class ModelCaller(Protocol):
    def __call__(self, prompts: list[str]) -> list[str | None]:
        """An answer for each prompt; None where the call failed."""


def stub_summary(n_lines: Column, lines: Column) -> Column:
    """Number of messages and the first line of what is to be summarised."""
    return F.concat(n_lines.cast("string"), F.lit(":"), F.substring_index(lines, "\n", 1))


def called(prompts: DataFrame, caller: ModelCaller, prompt: str = "prompt", answer: str = "answer", batch: int = 32) -> DataFrame:
    """prompts with the model's answer, error_class and error_message; where a call failed the answer is null and the error says why.

    Equal prompts are called once, their answers written down in the shared folder and given back to each row; null prompts aren't called.
    A batch that fails is called again prompt by prompt, so that one prompt's failure is not its neighbours'. A lost
    executor's prompts are called again.
    """
    names = prompts.columns

    def one(p: str) -> tuple:
        try:
            return (caller([p])[0], None, None)
        except Exception as e:  # a remote model may fail in any way; the row tells how
            return (None, f"{type(e).__module__}.{type(e).__qualname__}".removeprefix("builtins."), str(e) or None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), batch):
                part = b["_prompt"].iloc[k : k + batch].tolist()
                try:
                    got = [(a, None, None) for a in caller(part)]
                    if len(got) != len(part):
                        raise ValueError(f"{len(got)} answers to {len(part)} prompts")
                except Exception:
                    got = [one(p) for p in part]
                yield pd.DataFrame([(p, *g) for p, g in zip(part, got)], columns=["_prompt", answer, "error_class", "error_message"])

    asked = prompts.select(F.col(prompt).alias("_prompt")).filter("_prompt is not null").distinct()
    said = checkpointed(asked.mapInPandas(run, f"_prompt string, `{answer}` string, error_class string, error_message string"))
    return prompts.join(said, F.col(prompt) == F.col("_prompt"), "left").select(*names, answer, "error_class", "error_message")

"""Model boundary: batches go to a provider on the executors; without one the output columns are null."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ModelProvider(Protocol):
    """load() runs once per worker and returns texts -> list of (label, confidence)."""

    def load(self) -> Callable[[list[str]], list[tuple[str | None, float | None]]]: ...


def predicted(rows: DataFrame, provider: ModelProvider | None, text: str = "text", batch: int = 32) -> DataFrame:
    """rows with label and confidence (4 decimals) of the provider; null without one."""
    if provider is None:
        return rows.withColumn("label", F.lit(None).cast("string")).withColumn("confidence", F.lit(None).cast("double"))
    schema = T.StructType([*rows.schema.fields, T.StructField("label", T.StringType()), T.StructField("confidence", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = provider.load()
        for b in batches:
            out = [p for i in range(0, len(b), batch) for p in predict(list(b[text].iloc[i : i + batch].fillna("")))]
            yield b.assign(label=[p[0] for p in out], confidence=[None if p[1] is None else round(p[1], 4) for p in out])

    return rows.mapInPandas(run, schema)


def validated(answer: Column, allowed: list[str], least: float = 0.70) -> Column:
    """A model's JSON answer as struct(label, confidence): null unless it names an allowed label with enough confidence."""
    j = F.from_json(answer, "label string, confidence double")
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), j["confidence"]))
    return F.when(j["label"].isin(*allowed) & (c >= least), F.struct(j["label"].alias("label"), c.alias("confidence")))

"""Filling in missing embeddings: a null is the checkpoint, so the pass can stop and go on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pending(chunks: DataFrame) -> DataFrame:
    return chunks.where(F.col("embedding").isNull())


def backfill(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], model: str, *, keys: tuple[str, ...] = ("chunk_id",), batch: int = 64, max_batches: int | None = None) -> DataFrame:
    """(``keys``, embedding, embedding_model) of chunks without one, ``batch`` texts a call.

    ``max_batches`` bounds the pass to the first chunks by identifier; ``embed`` must give one vector for each text.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                vectors = embed(part["content"].tolist())
                if len(vectors) != len(part):
                    raise ValueError("the embedder gave another number of vectors than texts")
                yield part[list(keys)].assign(embedding=vectors, embedding_model=model)

    todo = pending(chunks).select(*keys, "content")
    if max_batches is not None:
        todo = todo.orderBy(*keys).limit(batch * max_batches)
    vector, name = T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("embedding_model", T.StringType())
    return todo.mapInPandas(run, T.StructType([*todo.select(*keys).schema.fields, vector, name]))


def within_budget(spent: float, cap: float) -> bool:
    return spent < cap

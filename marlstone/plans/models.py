"""Deterministic stand-ins for models, with the interfaces the real ones would have."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as T

DIM = 64


def _embed(texts: pd.Series) -> pd.Series:
    out = []
    for text in texts:
        hashed = np.array([zlib.crc32(t) for t in re.findall(rb"[a-z0-9]+", (text or "").lower().encode())], np.int64)
        out.append(np.bincount(hashed % DIM, weights=np.where(hashed >> 16 & 1, 1.0, -1.0), minlength=DIM).astype(np.float32) if len(hashed) else np.zeros(DIM, np.float32))
    return pd.Series(out)


def embedding(c: Column) -> Column:
    """Hashed bag of words, signs by hash; an Arrow UDF, as a real model's batch call would be."""
    return F.pandas_udf(_embed, "array<float>")(c)


def overlap_scorer(pairs: DataFrame) -> DataFrame:
    """(``query_id``, ``doc_id``, ``position``, ``rerank_score``) by the share of the query's words in the text."""
    score = F.round(T.memory_score(F.col("query"), F.col("content")), 6)
    rows = pairs.select("query_id", "doc_id", "rank", score.alias("rerank_score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    return rows.withColumn("position", F.row_number().over(order) - 1).drop("rank")

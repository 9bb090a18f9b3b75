"""Slots: defaults are deterministic, and what is asked for must load."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import slots


def test_default_embedding(spark):
    rows = spark.createDataFrame([(1, "a cat sat"), (2, "a cat sat"), (3, ""), (4, None)], "id int, t string")
    got = {r.id: r.v for r in rows.select("id", slots.embedder()(F.col("t")).alias("v")).collect()}
    assert got[1] == got[2] and np.linalg.norm(got[1]) == pytest.approx(1) and not any(got[3]) and not any(got[4])


def test_own_embedding_with_prefix(spark):
    embed = slots.embedder(lambda: lambda texts: np.array([[len(t)] for t in texts], np.float32), "query: ")
    assert spark.createDataFrame([("ab",)], "t string").select(embed(F.col("t")).alias("v")).first().v == [9.0]


def test_mocks_must_be_asked_for(spark):
    with pytest.raises(ValueError, match="allowed"):
        slots.translator(None)
    with pytest.raises(ValueError, match="loaded"):
        slots.translator("opus")
    with pytest.raises(ValueError, match="loaded"):
        slots.reranker("cross-encoder")
    assert slots.reranker("heuristic") is None
    assert spark.range(1).select(slots.translator(None, mock=True)(F.lit("hello"), "ru").alias("t")).first().t == "[RU] hello"


def test_reranker_scores_by_difference(spark):
    score = slots.reranker("two", lambda name: lambda q, p: ([3.0] * len(q), [1.0] * len(q)))
    assert spark.range(1).select(score(F.lit("q"), F.lit("p")).alias("s")).first().s == 2.0
    assert spark.range(1).select(slots.guard()(F.lit("drop table x")).alias("g")).first().g.allowed is False

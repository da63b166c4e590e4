"""Blocks of the similarity join are bounded by what they hold."""

import random

from pyspark.sql import functions as F
from test_operators import brute_jaccard

from quarterlode.llm import jaccard


def test_blocks_hold_so_many_shingles(spark):
    rows = spark.range(40).select("id", jaccard.block_rows(F.col("id")).alias("rows")).collect()
    assert all(r.rows <= jaccard.BLOCK_ROWS and (r.rows == 1 or r.rows * 2 ** ((r.id + 1) / 2) <= jaccard.BLOCK_MEMBERS * (1 + 1e-9)) for r in rows)
    assert rows[8].rows == jaccard.BLOCK_ROWS and 1 < rows[28].rows < 40


def test_small_blocks_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_MEMBERS", 100)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice((8, 40, 90)))]
        for _ in range(8):
            copy = base[:]
            for _ in range(rng.choice((0, 1, 3))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    got = jaccard.join_components(spark.createDataFrame(rows, "doc_id long, text string"), size=2, percent=60).collect()
    assert sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id) for r in got))) == sorted(map(str, brute_jaccard(rows, 2, 60)))

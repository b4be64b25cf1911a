"""Titles that hold keywords, against all pairs."""

import random

import pyarrow as pa
import pytest

from lectern.operators import jobs, titles
from lectern.operators.registry import QUERIES


@pytest.mark.parametrize("seed", [1, 2])
def test_keywords_against_all_pairs(spark, monkeypatch, seed):
    """Words of all lengths around the keys', in words and whole; packs of few questions; several titles and people of an id; repeats, nulls."""
    monkeypatch.setattr(titles, "PACK", 5)
    rng = random.Random(seed)
    long = "".join(rng.choice("abc_-") for _ in range(40))
    word = lambda: long[(a := rng.randrange(0, 20)) : a + rng.choice([2, 3, 4, 5, 6, 7, 11, 12, 13, 20])] + rng.choice(["", "", "é", ","])
    asked = [(rng.randrange(30), rng.choice("xy"), word().strip("é,")) for _ in range(120)]
    asked = [x for x in asked if len(x[2]) > 2] + [(None, "x", "abc"), (3, None, "abc"), (4, "x", None)]
    rows = [(rng.randrange(150), rng.choice("xyz"), " ".join(word() for _ in range(rng.randrange(0, 6)))) for _ in range(200)]
    rows += rows[:20] + [(None, "x", long), (1, None, long), (2, "x", None), (5, "y", f"  {long} ")]
    got = titles.holding_keywords(spark.createDataFrame(asked, "asked long, person string, kw string"), spark.createDataFrame(rows, "item_id long, person string, low string"))
    want = {(q, i) for q, p, kw in asked for i, p2, low in rows if None not in (q, p, kw, i, p2, low) and p == p2 and kw in low}
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 500


def test_common_words_are_paired_in_the_tasks(spark):
    """Two hundred questions of eight words that 20,000 titles have too: four million rows of 32 million common words."""
    words = "alpha bravo charlie delta echoes foxtrot golfing hotels"
    q = spark.range(200).selectExpr("id as asked", "'x' as person", f"explode(split('{words}', ' ')) as kw")
    rows = titles.holding_keywords(q, spark.range(20_000).selectExpr("id as item_id", "'x' as person", f"concat('{words} ', id) as low"))
    assert rows.count() == rows.distinct().count() == 4_000_000
    assert QUERIES["p5_keyword_titles"] is jobs.p5_keyword_titles


def test_rows_leave_a_task_in_bounded_batches():
    pairs = pa.array([{"asked": a, "word": w} for a in range(500) for w in (7, 9)], pa.struct([("asked", pa.int64()), ("word", pa.int64())]))
    names, kind = ["head", "pairs", "item", "words"], pa.list_(pairs.type)
    head = pa.RecordBatch.from_arrays([pa.array([True]), pa.array([pairs.to_pylist()], kind), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int64()))], names=names)
    items = pa.RecordBatch.from_arrays([pa.array([False] * 2000), pa.nulls(2000, kind), pa.array(range(2000)), pa.array([[7, 9, 8]] * 1999 + [[8]], pa.list_(pa.int64()))], names=names)
    out = list(titles._pairs(iter([head, items])))
    assert sum(b.num_rows for b in out) == 1999 * 500 and max(b.num_rows for b in out) <= titles.OUT
    assert len({x for b in out for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}) == 1999 * 500

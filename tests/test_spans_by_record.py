"""Shared spans of many replies and records at a time, against pairs."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lectern.operators import spans


def longest(a, b):
    best = 0
    for i in range(len(a)):
        while i + best < len(a) and a[i : i + best + 1] in b:
            best += 1
    return best if best >= spans.LEAST else 0


@pytest.mark.parametrize("places", [3, 200, 1 << 25])
def test_longest_of_many_against_brute_force(monkeypatch, places):
    """Spans within a record, within a body and across; parts of few characters, spans that an automaton follows."""
    monkeypatch.setattr(spans, "PLACES", places)
    r, some = random.Random(places), 0
    for _ in range(600):
        signs = r.choice(["ab ", "abc  é", "a", "a\U0001f600 "])
        text = lambda n: " ".join("".join(r.choices(signs, k=r.randrange(n))).split())  # noqa: B023, E731
        replies, records, bodies = [text(40) for _ in range(r.randrange(1, 5))], [text(25) for _ in range(r.randrange(1, 5))], [text(40) for _ in range(r.choice([1, 1, 2]))]
        got = spans.longest_of(replies, records, bodies, part=r.choice([20, 50, 1000]))
        want = {x: max(longest(x, f"{a} {b}".strip()) for a in records for b in bodies) for x in replies}
        assert {x: n if n >= spans.LEAST else 0 for x, n in got.items()} == want
        some += sum(n > 0 for n in want.values())
    assert some > 300


def test_rows_against_pairs(spark):
    """Repeats, nulls, urls, white space, a conversation without a body and one with two."""
    said = [(1, 1, 1, "He said  The\nquick brown fox"), (1, 1, 1, "He said  The\nquick brown fox"), (1, 1, 1, "and a second reply of that turn"), (1, 1, 2, "see https://a.example/the-quick-brown now"), (1, None, 2, "a null turn, the quick brown"), (2, 3, 2, None), (2, 5, 9, "nothing"), (2, 7, 3, "end of it And so on it goes")]
    records = [(1, "the quick"), (1, "the quick"), (1, "he said"), (1, None), (2, "https://a.example/the-quick-brown now"), (2, " "), (3, "so this is the END of it"), (None, "x")]
    bodies = [(1, "brown fox and a second"), (1, "BROWN dog"), (3, "  and so on it goes"), (4, "not asked"), (2, None)]
    a, b, c = spark.createDataFrame(said, "conv long, turn int, other long, said string"), spark.createDataFrame(records, "other long, record string"), spark.createDataFrame(bodies, "other long, body string")
    pairs = a.join(b.where("record is not null"), "other").join(c, "other", "left").select("conv", "turn", "other", "said", F.expr("concat(record, ' ', coalesce(body, ''))").alias("record")).distinct()
    want = spans.longest_shared(pairs, ["conv", "turn", "other"], F.col("said"), F.col("record")).groupBy("conv", "turn", "other").agg(F.max("length").alias("longest"), F.count(F.lit(1)).alias("n"))
    got = spans.longest_by_record(a, b, c)
    assert got.schema == want.schema and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.where("longest > 15").count() >= 2


def test_a_long_conversation():
    """A thousand replies to a thousand records before one body: two thousand million characters, if each pair were read."""
    r = random.Random(4)
    text = lambda n: "".join(r.choices("abcdefghijklmnopqrstuvwxyz ", k=n)).strip()
    replies, records, body = [text(900) for _ in range(1000)], [text(200) for _ in range(1000)], text(2000)
    replies[7] = records[5][-30:] + " " + body[:40]
    began = time.time()
    got = spans.longest_of(replies, records, [body])
    assert got[replies[7]] == 71 and time.time() - began < 30

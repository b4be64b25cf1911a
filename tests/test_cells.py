"""Stored cells: searches and self-joins against all pairs, with nothing passed over that counts."""

import datetime

import numpy as np
import pyarrow as pa
import pytest

from lectern.operators import cells, vectors

DAY = datetime.date(2024, 1, 1)
CHUNKS = "chunk_id long, person int, item long, ordinal int, embedding array<double>, published_at date"


def corpus(seed, n=400, dim=6, people=3):
    """Vectors about few directions, copies, nulls, zeros, another length, a null person."""
    rng = np.random.default_rng(seed)
    tops = rng.normal(size=(7, dim))
    v = [(tops[i % 7] + rng.normal(size=dim) * 0.15).tolist() for i in range(n)]
    v[10], v[11], v[12], v[13] = None, [0.0] * dim, [1.0, 2.0], v[14]
    return [(i, None if i == 20 else i % people, i // 4, i % 4, v[i], None if i % 9 == 0 else DAY + datetime.timedelta(i % 50)) for i in range(n)]


def cosine(a, b):
    norm = np.linalg.norm(a or [0.0]) * np.linalg.norm(b or [0.0])
    return 0.0 if a is None or b is None or len(a) != len(b) or not norm else float(np.floor(np.dot(a, b) / norm * 1e4 + 0.5) / 1e4)


@pytest.mark.parametrize("k, floor, block", [(5, None, 100), (None, 0.6, 100), (7, 0.3, 100), (5, None, 3)])
def test_search_in_cells(spark, k, floor, block):
    rows = corpus(1)
    questions = [(i, rows[i][1], rows[i][4] if i != 10 else None, DAY if i % 3 == 0 else None, DAY + datetime.timedelta(25) if i % 3 == 0 else None) for i in range(0, 60, 5)]
    q = spark.createDataFrame(questions, "q_id long, person int, q_vec array<double>, since date, until date")
    stored = cells.store(spark.createDataFrame(rows, CHUNKS).repartition(3))
    want = []
    for i, p, v, since, until in questions:
        own = [(i, c, item, cosine(v, cv)) for c, cp, item, _, cv, d in rows if p is not None and cp == p and c != i and (since is None or d is not None and since <= d <= until)]
        want += sorted((x for x in own if floor is None or x[3] >= floor), key=lambda x: (-x[3], x[2], x[1]))[:k]
    got = cells.search(stored, q, k, floor, block=block)
    assert sorted((r.q_id, r.chunk_id, r["item"], r.cos) for r in got.collect()) == sorted(want)


def test_far_cells_are_not_read(spark):
    rng = np.random.default_rng(3)
    tops = np.eye(8)
    rows = [(i, 0, i, 0, (tops[i % 8] + rng.normal(size=8) * 0.02).tolist(), None) for i in range(2400)]
    stored = cells.store(spark.createDataFrame(rows, CHUNKS)).cache()
    q = spark.createDataFrame([(0, 0, tops[0].tolist()), (1, 0, tops[1].tolist()), (2, None, tops[1].tolist())], "q_id long, person int, q_vec array<double>")
    for block in (10, 1):
        got = {r.q_id: (r.n, r.n_read) for r in cells.reads(stored, q, floor=0.8, block=block).collect()}
        assert set(got) >= {0, 1} and all(n == 2400 and 300 <= read < 1200 for k, (n, read) in got.items() if k < 2)


def pairs(rows, floor):
    """(person, pa, pb): (cos, claim_a, claim_b, gap) of the nearest claims of each two positions."""
    best = {}
    for c, p, item, since, v in rows:
        for c2, p2, item2, since2, v2 in rows:
            if p is not None and p == p2 and item != item2 and since and since2 and since < since2 and (cos := cosine(v, v2)) >= floor:
                best[p, item, item2] = min(best.get((p, item, item2), (9, 9, 9, 9)), (-cos, c, c2, (since2 - since).days))
    return best


@pytest.mark.parametrize("floor, most, heads", [(0.65, 120, 512), (0.9, 5, 512), (0.65, 120, 2)])
def test_alike_against_all_pairs(spark, monkeypatch, floor, most, heads):
    monkeypatch.setattr(cells, "HEADS", heads)
    monkeypatch.setattr(cells, "CELL", 10)
    rows = [(c, p, item % 23, None if item % 23 == 3 else DAY + datetime.timedelta(item % 23 // 2), v) for c, p, item, _, v, _ in corpus(2, 200)]
    got = cells.alike(spark.createDataFrame(rows, "claim_id long, person int, position long, since date, embedding array<double>"), floor, most).collect()
    want, count = pairs(rows, floor), {}
    for (p, _, _), _ in sorted(want.items(), key=lambda x: (x[0][0], x[1][0], x[0][1:])):
        count[p] = count.get(p, 0) + 1
    assert {r.person: r.bounded_out for r in got} == {p: max(n - most, 0) for p, n in count.items()}
    for p in count:
        order = sorted(((v, k) for k, v in want.items() if k[0] == p), key=lambda x: (x[0][0], x[1][1:]))[:most]
        mine = sorted((r for r in got if r.person == p), key=lambda r: r.r)
        assert [(r.pa, r.pb, r.cos, r.claim_a, r.claim_b, r.gap_days) for r in mine] == [(k[1], k[2], -v[0], *v[1:]) for v, k in order]


def test_pairs_of_far_cells_are_not_read(spark):
    rng = np.random.default_rng(3)
    rows = [(i, 0, i, 0, (np.eye(8)[i % 8] + rng.normal(size=8) * 0.02).tolist(), DAY + datetime.timedelta(i % 30)) for i in range(2400)]
    met = cells.cell_pairs(cells.store(spark.createDataFrame(rows, CHUNKS)), 0.65).collect()
    assert 0 < sum(r.read for r in met) < len(met) / 2


def unit(angle):
    return [float(np.cos(angle)), float(np.sin(angle))]


def test_published_cases_of_revisions(spark):
    """One pair for two positions, from the earlier to the later, undated and equal dates left out, bounded and counted."""
    close, far = np.arccos(0.9), np.arccos(0.2)
    day = lambda m: datetime.date(2025, m, 1)
    rows = [(1, 1, 1, day(1), unit(0)), (2, 1, 1, day(1), unit(2)), (3, 1, 2, day(3), unit(close)), (4, 1, 2, day(3), unit(2 + np.arccos(0.7)))]
    rows += [(5, 2, 1, day(1), unit(0)), (6, 2, 2, day(3), unit(far)), (7, 3, 1, day(6), unit(0)), (8, 3, 2, day(1), unit(close)), (9, 4, 1, day(1), unit(0)), (10, 4, 2, None, unit(0)), (11, 4, 3, day(1), unit(0)), (12, 5, 1, day(1), unit(0)), (13, 5, 1, day(1), unit(0))]
    rows += [(100 + i, 6, i, datetime.date(2025, 1, i + 1), unit(i * 0.001)) for i in range(20)]
    got = cells.alike(spark.createDataFrame(rows, "claim_id long, person int, position long, since date, embedding array<double>")).collect()
    assert [(r.person, r.pa, r.pb, r.cos, r.claim_a, r.claim_b, r.gap_days) for r in got if r.person < 6] == [(1, 1, 2, 0.9, 1, 3, 59), (3, 2, 1, 0.9, 8, 7, 151)]
    six = [r for r in got if r.person == 6]
    assert len(six) == 120 and {r.bounded_out for r in six} == {70}
    found = spark.createDataFrame(got)
    verdicts = spark.createDataFrame([(1, "p1", "drifting", "moved", 1), (1, "p1", "revised", "then not", 2), (1, "p9999", "revised", "unknown", 3), (3, "p1", "none", "the same", 1)], "person long, ref string, relation string, rationale string, arrived int")
    assert [tuple(r) for r in cells.revisions(found, verdicts).collect()] == [(1, 1, 2, "drifting", 59, "moved")]
    assert {r.person: tuple(r)[1:] for r in cells.judged(found, verdicts).collect()} == {1: (1, 1, 0, 1, 0), 3: (1, 0, 1, 0, 0), 6: (120, 0, 0, 0, 70)}


def test_nulls_and_nothing(spark):
    """Literal cases: a batch of null vectors, a chunk without a person, and empty tables."""
    q = spark.createDataFrame([(1, 0, [1.0, 0.0])], "q_id long, person int, q_vec array<double>")
    nulls = spark.createDataFrame([(5, 0, 1, 0, None, None), (6, None, 1, 0, [1.0, 0.0], None)], CHUNKS)
    for answer in (vectors.score(q, nulls), cells.search(cells.store(nulls), q)):
        assert [(r.chunk_id, r.cos) for r in answer.collect()] == [(5, 0.0)]
    empty = nulls.limit(0)
    assert vectors.score(q, empty).count() == 0 and cells.search(cells.store(empty), q, 3).count() == 0 and cells.search(cells.store(nulls), q.limit(0)).count() == 0
    assert cells.alike(spark.createDataFrame([], "claim_id long, person int, position long, since date, embedding array<double>")).count() == 0


def test_answers_leave_in_small_batches(spark):
    """All pairs of many questions and cells are given on in batches of bounded size; loose vectors need one worker a task."""
    rng, day = np.random.default_rng(5), pa.nulls(1024, pa.int64())
    row = lambda k: cells._row(pa.RecordBatch.from_arrays([pa.array(np.zeros(1024, np.int64)), *[pa.array(np.arange(1024) + 1024 * k)] * 3, day, pa.array(list(rng.normal(size=(1024, 4))))], names=["person", "id", "item", "ordinal", "day", "vector"]), k, 4)
    asked = cells.Asked(np.arange(600), np.zeros(600, np.int64), np.full(600, cells.LONG_AGO), np.full(600, cells.FAR_OFF), rng.normal(size=(600, 4)), None)
    sizes = [b.num_rows for b in cells._answers([cells.Cell(row(k), 0) for k in range(4)], asked, None, None, True, False)]
    assert sum(sizes) == 600 * 4096 and max(sizes) <= cells.OUT + cells.STEP * cells.ROW
    q = spark.createDataFrame([(1, 0, [1.0, 0.0])], "q_id long, person int, q_vec array<double>")
    chunks = spark.createDataFrame([(5, 0, 1, 0, [1.0, 0.0], None)], CHUNKS)
    assert vectors.score(q, chunks)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1

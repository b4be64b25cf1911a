"""Items that several people share: rows that are alike are searched once and counted as often as they stand in the SQL."""

import os

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from lectern.operators import cells
from lectern.operators.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def shared(tmp_path_factory):
    """Three people, one with so many vectors that its items are also the others'."""
    folder, duck = tmp_path_factory.mktemp("shared"), duckdb.connect()
    duck.execute(f"""copy (select i as vec_id, (case when i % 60 < 57 then 0 when i % 60 < 59 then 1 else 5 end)::int as label,
        [sin(i * 1.7 + (i % 7)), cos(i * 0.31), sin(i * 2.3) * 0.5, case when i % 5 = 0 then 0.3 else cos(i * 4.1) end]::float[] as embedding from range(5700) t(i)) to '{folder}/embeddings.parquet'""")
    for f in os.listdir(SF):
        if f != "embeddings.parquet":
            (folder / f).symlink_to(f"{SF}/{f}")
        duck.execute(f"create view {f[:-8]} as select * from '{folder}/{f}'")
    return str(folder), duck


@pytest.mark.parametrize("name", ["e4_rungs", "a16_bars", "e1_nearest_positions", "e1_nothing_matched", "e1_passages", "e1_read_without_position", "e1_unread_titles"])
def test_rows_of_shared_items(spark, shared, name):
    folder, duck = shared
    assert duck.execute("select count(*) from (select distinct label * 1000 + rn // 5 as item, label from (select label, row_number() over (partition by label order by vec_id) - 1 as rn from embeddings) x) y group by item having count(*) > 1").fetchall()
    got, want = QUERIES[name](spark, folder), duck.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want.fetchall()))


@pytest.mark.parametrize("seed, k, most", [(1, 7, 50), (2, 30, 200), (3, 1, 10), (4, 500, 50)])
def test_nearest_of_many_cells(monkeypatch, seed, k, most):
    """What falls behind is dropped after every few answers, of many ties too."""
    monkeypatch.setattr(cells, "ANSWERS", most)
    rng = np.random.default_rng(seed)
    vectors, asked = np.round(rng.normal(size=(900, 3))), np.round(rng.normal(size=(20, 3)))
    names = ["person", "id", "item", "ordinal", "day", "vector"]
    rows = pa.table([pa.array(np.zeros(900, np.int64)), pa.array(np.arange(900)), pa.array(np.arange(900) % 90), pa.array(np.arange(900)), pa.nulls(900, pa.int64()), pa.array(vectors.tolist(), pa.list_(pa.float64()))], names=names).combine_chunks()
    units = cells.unit_rows(pa.array(asked.tolist(), pa.list_(pa.float64())), 3)
    near = cells.Nearest(lambda dim: cells.Asked(np.arange(20), np.zeros(20, np.int64), np.zeros(20, np.int64), np.full(20, cells.FAR_OFF), units, None), k, None, True)
    for low in range(0, 900, 60):
        near.meet(cells.Cell(cells._row(rows.slice(low, 60).to_batches()[0], 0, 3), 0))
        assert near.n <= max(2 * most, 20 * k) + 20 * 60
    got = sorted((q, at, item, round(c * 1e4)) for b in near.answers() for q, at, item, c in zip(*(b.column(x).to_pylist() for x in ("q_id", "chunk_id", "item", "cos"))))
    cos = cells.rounded(units @ cells.unit_rows(pa.array(vectors.tolist(), pa.list_(pa.float64())), 3).T)
    want = sorted((q, at, at % 90, round(c * 1e4)) for q in range(20) for c, _, at in sorted(((cos[q, at], at % 90, at) for at in range(900)), key=lambda x: (-x[0], x[1], x[2]))[:k])
    assert got == want

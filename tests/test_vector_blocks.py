"""Vector search by blocks: what is copied, what leaves a task, and exact results."""

import numpy as np
import pytest

from ragscale.operators import vector_index, vectors


def frame(spark, m, key):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], f"{key} long, embedding array<float>")


def unit(m):
    m = m.astype(np.float32).astype(float)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def points():
    return np.random.default_rng(4).normal(size=(600, 8))


def test_a_query_goes_once_to_a_block(spark, points):
    """Not once to each of 40 cells."""
    pivots = unit(points[:40])
    bounds = vectors.pack_cells([(i, 15) for i in range(40)], 40, 150)
    assert list(bounds) == [0, 10, 20, 30, 40]
    rows = vectors.routed(frame(spark, points, "query_id"), pivots, bounds, "embedding", True, 40).collect()
    assert len(rows) == 4 * 600 and all(sum(map(int.bit_count, r._open)) == 10 for r in rows)
    some = vectors.routed(frame(spark, points, "query_id"), pivots, bounds, "embedding", True, 3).collect()
    assert len(some) < 3 * 600 and sum(sum(map(int.bit_count, r._open)) for r in some) == 3 * 600


def test_best_rows_holds_no_more_than_asked(points):
    m = unit(points)
    opened = np.random.default_rng(1).random((600, 3)) < 0.6
    starts, least = np.array([0, 100, 100, 600]), np.where(np.arange(600) % 2, 0.8, -np.inf)
    row, pick, score = vectors.best_rows(m, lambda lo, hi: m[lo:hi], starts, opened, np.arange(600), 4, least, lambda a, b: np.round(a @ b.T, 9))
    cell = np.repeat([0, 2], [100, 500])
    for i in range(600):
        mine = [j for j in range(600) if opened[i, cell[j]] and round(m[i] @ m[j], 9) >= least[i]]
        assert list(pick[row == i]) == sorted(mine, key=lambda j: (-round(m[i] @ m[j], 9), j))[:4]


@pytest.mark.parametrize("block_rows", [50, 1 << 16])
def test_blocks_of_cells_are_exact(spark, points, block_rows):
    m = unit(points)
    found = vectors.topk_vectors(frame(spark, points, "query_id"), frame(spark, points, "chunk_id"), 5, cells=23, block_rows=block_rows)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert all(got[i] == sorted(range(600), key=lambda j: (-round(m[i] @ m[j], 9), j))[:5] for i in range(600))


def test_all_chunks_as_candidates_need_no_candidate_rows(spark, tmp_path, points, monkeypatch):
    """They were written as queries times chunks rows before."""
    path = str(tmp_path / "index")
    vector_index.build_index(frame(spark, points, "chunk_id"), path, cells=6, parts=4, codes=8)
    monkeypatch.setattr(vector_index, "materialize", None)
    m = unit(points)
    for nprobe in (None, 3):
        rows = vector_index.search_index(frame(spark, points[:50], "query_id"), path, nprobe=nprobe, candidates=600).collect()
        assert len(rows) == 250 and all(r.score == pytest.approx(m[r.query_id] @ m[r.chunk_id], abs=1e-8) for r in rows)
        if nprobe is None:
            assert {r.n_read for r in rows} == {600}
            assert all(r.chunk_id == np.argsort(-m @ m[r.query_id], kind="stable")[r["rank"] - 1] for r in rows)
        else:
            assert max(r.n_read for r in rows) < 600


def test_candidates_leave_a_task_once_for_a_block(spark, tmp_path, points):
    """Cells share blocks of codes, so that a query has no more candidate rows than candidates in each."""
    assert list(vectors.pack_cells([(i, 30) for i in range(20)], 20, vector_index.CODE_ROWS)) == [0, 20]
    path = str(tmp_path / "index")
    vector_index.build_index(frame(spark, points, "chunk_id"), path, cells=20, parts=4, codes=8)
    found = vector_index.search_index(frame(spark, points, "query_id"), path, candidates=60)
    assert found.count() == 5 * 600 and found.agg({"n_read": "max"}).first()[0] == 60

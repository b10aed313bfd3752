import numpy as np

from labelmill.llm.near_vectors import near_vectors
from tests.llm.helpers import grouped

SCHEMA = "vec_id bigint, embedding array<float>, label int, node int, component_id string, links int"


def _expected(rows, threshold):
    ok = [
        (i, np.array(v, np.float32).astype(float), lab) for i, v, lab in rows
        if i is not None and v is not None and lab is not None and None not in v and np.isfinite(v).all() and np.any(v)
    ]
    links = [
        (a, b) for n, (a, x, p) in enumerate(ok) for b, y, q in ok[:n]
        if p == q and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold
    ]
    count = {i: 0 for i, _, _ in rows}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return count, grouped({i for i, _, _ in rows if i is not None}, links)


def _check(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "?", 2) for r in rows], SCHEMA).repartition(3)
    count, component = _expected(rows, 0.98)
    got = near_vectors(df, **options).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["vec_id"] is not None:
            assert (r["n_links"], r["component_id"]) == (count[r["vec_id"]], component[r["vec_id"]]), r
            assert r["kept"] == (r["vec_id"] == component[r["vec_id"]])
        else:
            assert r["n_links"] == 0 and r["kept"]


def test_links_equal_brute_force_over_many_cells_and_blocks(spark):
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for label in range(3):
        for _ in range(12):
            centre = rng.normal(size=8)
            for _ in range(10):
                rows.append((n, (centre + rng.normal(size=8) * rng.choice([0.0, 0.1, 0.25])).tolist(), label))
                n += 1
    _check(spark, rows, cell_rows=16, block_rows=8)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    v = [1.0, 2.0, 3.0]
    rows = [
        (1, v, 1), (2, v, 1), (3, [2.0, 4.0, 6.0], 1), (4, v, 2), (5, v, None), (6, None, 1), (7, [0.0, 0.0, 0.0], 1), (8, [1.0, None, 3.0], 1),
        (9, [nan, 2.0, 3.0], 1), (10, [inf, 2.0, 3.0], 1), (11, [], 1), (12, [1.0, 2.0], 1), (None, v, 1), (13, [-1.0, -2.0, -3.0], 1), (14, [3e38, 3e38, 3e38], 1),
        (15, [3e38, 3e38, 3e38], 1),
    ]
    _check(spark, rows)


def test_dense_group_and_empty_table(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=16)
    _check(spark, [(i, (centre + rng.normal(size=16) * 0.05).tolist(), 0) for i in range(60)], block_rows=16)
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0

"""Grid join against all pairs."""

import numpy as np
import pytest

from ravelin.llm import grid_join


def plain(rows, least):
    def good(key, vector, label):
        if key is None or label is None or vector is None or any(x is None for x in vector):
            return False
        v = np.asarray(vector, np.float64)
        return len(v) > 0 and np.isfinite(v).all() and v.any()

    sound = [good(*r) for r in rows]
    unit = [np.float64(r[1]) / np.linalg.norm(np.float64(r[1])) if s else None for r, s in zip(rows, sound, strict=True)]
    near = {i: set() for i in range(len(rows))}
    for i in range(len(rows)):
        for j in range(i):
            if sound[i] and sound[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]):
                if unit[i] @ unit[j] >= least:
                    near[i].add(j)
                    near[j].add(i)
    out = []
    for i, row in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        least_id = min((rows[j][0] for j in seen), key=lambda x: (x is None, x))
        out.append((row[0], len(near[i]), least_id, None if row[0] is None else row[0] == least_id))
    return sorted(out, key=str)


@pytest.mark.parametrize("leaf", [4, 1024])
def test_same_as_all_pairs(spark, leaf, monkeypatch):
    monkeypatch.setattr(grid_join, "LEAF", leaf)
    monkeypatch.setattr(grid_join, "FAN", 2)
    draw = np.random.default_rng(leaf)
    centres = draw.normal(size=(25, 12))
    rows = []
    for i in range(160):
        v = centres[i % 25] + draw.normal(size=12) * draw.choice([0.0, 0.02, 0.08, 0.5])
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 3)))
    base = rows[0][1]
    rows += [
        (200, base, 0), (201, base, None), (202, None, 0), (203, [0.0] * 12, 0), (204, base[:-1] + [None], 0),
        (205, base[:-1] + [float("nan")], 0), (206, base[:-1] + [float("inf")], 0), (207, base[:6], 0),
        (208, [2 * x for x in base], 0), (None, base, 0), (209, [], 0), (210, base[:6], 0), (-5, base, 0),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df = df.selectExpr("*", "1 AS v", "2 AS id", "'n' AS weight")
    out = grid_join.near_duplicates(df, "vec_id", "embedding", "label")
    assert sorted(map(tuple, out.collect()), key=str) == plain(rows, 0.98)


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    out = sorted(map(tuple, grid_join.near_duplicates(df, "vec_id", "embedding", "label").collect()))
    assert out == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False)]
    assert grid_join.near_duplicates(df.limit(0), "vec_id", "embedding", "label").count() == 0


def test_finite_doubles_of_any_size(spark, monkeypatch):
    """Tiny and huge vectors keep their links, also where leaves are small and boxes are pruned."""
    monkeypatch.setattr(grid_join, "LEAF", 16)
    monkeypatch.setattr(grid_join, "FAN", 2)
    draw = np.random.default_rng(3)
    base = draw.normal(size=(60, 4))
    rows = []
    for i, v in enumerate(base):
        for k, scale in enumerate((1.0, 1e200, 1e-200, 1e-310)):
            rows.append((4 * i + k, (v * scale).tolist()))
    df = spark.createDataFrame([(k, v, 1) for k, v in rows], "id long, v array<double>, label int")
    out = {r["id"]: r for r in grid_join.near_duplicates(df, "id", "v", "label", 0.98).collect()}
    for i in range(60):
        assert all(out[4 * i + k]["n_links"] >= 3 for k in range(3))
        assert len({out[4 * i + k]["component_id"] for k in range(3)}) == 1
    single = spark.createDataFrame([(1, [1e-200, 1e-201], 1), (2, [1e-200, 1.01e-201], 1)], "id long, v array<double>, label int")
    assert [r["n_links"] for r in grid_join.near_duplicates(single, "id", "v", "label").collect()] == [1, 1]

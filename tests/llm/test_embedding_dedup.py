import numpy as np
import pytest

from codeloom.llm import embedding_dedup as E
from codeloom.llm import queries as Q


def brute(rows, threshold=0.93):
    ids = [i for i, _, _ in rows]
    ok = [k for k, (_, v, x) in enumerate(rows) if x is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    links = {k: set() for k in range(len(rows))}
    for n, a in enumerate(ok):
        for b in ok[:n]:
            if rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[k][1], float) / max(map(abs, rows[k][1])) for k in (a, b))  # so that no square overflows
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[a].add(b)
                    links[b].add(a)
    least = list(ids)
    for _ in rows:
        least = [min([least[k], *(least[j] for j in links[k])]) for k in range(len(rows))]
    return {ids[k]: (len(links[k]), least[k], least[k] == ids[k]) for k in range(len(rows))}


def found(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_vectors(df).collect()}


def groups(dim=16, n=120, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    return [(int(i), (centres[i % 6] + rng.normal(size=dim) * rng.choice([0.05, 0.25, 0.35])).tolist(), int(i % 3)) for i in rng.permutation(n)]


SCHEMA = "vec_id bigint, embedding array<double>, label int, n_links string"


@pytest.mark.parametrize("block", [1500, 7])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK", block)
    rows = groups() + [(900, None, 1), (901, [0.0] * 16, 1), (902, [None] + [1.0] * 15, 1), (903, [float("nan")] + [1.0] * 15, 1), (904, [float("inf")] + [1.0] * 15, 1), (905, [1.0] * 16, None), (906, [1.0] * 16, None), (907, [1.0] * 8, 2), (908, [1.0] * 8, 2), (909, [], 2), (910, [1e300] * 8, 2)]
    rows += [(1000 + k, rows[0][1], rows[0][2]) for k in range(20)]
    assert found(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)) == brute(rows)
    assert E.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_op7(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in Q.op7_embedding_dedup(spark, "/root/testdata/sf0.001").collect()} == brute(rows)


def listed(rows, threshold=0.93):
    """brute() for rows that repeat ids or have none: rows are told apart by number, and null is no smallest id."""
    by = brute([(k, v, x) for k, (_, v, x) in enumerate(rows)], threshold)
    members = {}
    for k, (_, root, _) in by.items():
        members.setdefault(root, []).append(rows[k][0])
    least = {root: min((i for i in ids if i is not None), default=None) for root, ids in members.items()}
    return sorted([(rows[k][0], n, least[root], rows[k][0] == least[root]) for k, (n, root, _) in by.items()], key=str)


@pytest.mark.parametrize("block", [1500, 3])
def test_repeated_and_missing_ids(spark, monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK", block)
    a, b, c, d = [1.0, 0, 0, 0], [0.99, 0.1, 0, 0], [0.98, 0.15, 0, 0], [0, 0, 1.0, 0]
    a, b, c, d = (list(map(float, x)) for x in (a, b, c, d))
    rows = [(1, a, 1), (1, b, 1), (2, c, 1), (None, [0.97, 0.2, 0.0, 0.0], 1), (None, d, 1), (None, d, 1), (7, d, 2), (7, d, 2), (7, None, 2), (None, None, None), (3, [0.0, 0.0, 0.0, 1.0], 2)]
    schema = "vec_id bigint, embedding array<double>, label int, node string, k1 string, bucket string, group string"
    out = E.near_vectors(spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], schema)).collect()
    assert sorted([tuple(r) for r in out], key=str) == listed(rows)


def test_cosine_exactly_at_the_threshold(spark):
    rows = [(1, [1.0] + [0.0] * 7, 1), (2, [93.0, 36.0, 7.0, 2.0, 1.0, 1.0, 0.0, 0.0], 1), (3, [92.0, 36.0, 7.0, 2.0, 1.0, 1.0, 14.0, 0.0], 1)]
    assert found(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA))[1][0] == 1 and brute(rows)[1][0] == 1


@pytest.mark.parametrize("tables, hashes", [x[1:] for x in E.SIZES])
def test_every_size_of_hashes(spark, monkeypatch, tables, hashes):
    monkeypatch.setattr(E, "SIZES", [(1 << 62, tables, hashes)])
    rows = groups(n=150, seed=5)
    assert found(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)) == brute(rows)


@pytest.mark.parametrize("tables, hashes", [x[1:] for x in E.SIZES])
def test_recall_at_the_threshold(tables, hashes):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * z
    a, b = E.codes(x, tables, hashes), E.codes(y, tables, hashes)
    shared = (a[:, :, :, :, None] == b[:, :, :, None, :]).any((3, 4)).all(2).any(1)
    assert shared.mean() > 0.998

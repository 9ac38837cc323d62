"""Queries on tables larger than the key ranges they were once cut to, against brute force."""

import math
import random

import pyarrow as pa
import pyarrow.parquet as pq

from kinmap.plans.registry import QUERIES


def embeddings(folder, n, seed=1):
    rng = random.Random(seed)
    vecs = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(n)]
    pq.write_table(pa.table({"vec_id": pa.array(range(n), pa.int64()), "embedding": pa.array(vecs, pa.list_(pa.float32())), "label": pa.array([0] * n, pa.int32())}), f"{folder}/embeddings.parquet")
    return pq.read_table(f"{folder}/embeddings.parquet")["embedding"].to_pylist()


def test_decoders_score_every_vector(spark, tmp_path):
    n = 620
    v = embeddings(tmp_path, n)
    got = {r.id: r.score for r in QUERIES["transe_score"](spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(n))
    for i in got:
        want = -math.dist([a + b for a, b in zip(v[i], v[(i * 7 + 1) % n], strict=True)], v[(i * 3 + 2) % n])
        assert abs(got[i] - want) < 1e-5


def test_negatives_use_the_whole_graph(spark, monkeypatch):
    from kinmap.operators import match

    seen, real = [], match.random_triple_negatives
    monkeypatch.setattr(match, "random_triple_negatives", lambda t, *a, **k: (seen.append({r.r for r in t.select("r").distinct().collect()}), real(t, *a, **k))[1])
    assert QUERIES["triple_negatives"](spark, "/root/testdata/sf0.001").first()[0] == 0
    assert tuple(QUERIES["typed_negatives"](spark, "/root/testdata/sf0.001").first()) == (0, True)
    assert seen == [{1, 2, 3, 4, 5}] * 2


def test_sinkhorn_has_every_cell(spark, tmp_path):
    n = 220
    embeddings(tmp_path, n)
    rows = QUERIES["sinkhorn"](spark, str(tmp_path)).collect()
    assert {(r.src, r.trg) for r in rows} == {(a, b) for a in range(0, n, 2) for b in range(1, n, 2)}


def test_names_and_suppliers_beyond_the_old_ranges(spark, tmp_path):
    rng = random.Random(2)
    pq.write_table(pa.table({"p_partkey": pa.array([1000, 1001, 1003], pa.int64()), "p_name": ["red small iron box", "red small iron box", "blue cup"]}), f"{tmp_path}/part.parquet")
    got = [(r.src, r.trg, r.score) for r in QUERIES["string_similarity"](spark, str(tmp_path)).collect()]
    assert got == [(1000, 1001, 1.0)]
    items = [(rng.randint(30, 60), rng.randint(1, 8), float(rng.randint(1, 9)), rng.randint(1, 7)) for _ in range(200)]
    cols = ("l_suppkey", "l_partkey", "l_quantity", "l_linenumber")
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32())
    pq.write_table(pa.table({c: pa.array([x[i] for x in items], k) for i, (c, k) in enumerate(zip(cols, kinds, strict=True))}), f"{tmp_path}/lineitem.parquet")
    pq.write_table(pa.table({"s_suppkey": pa.array(range(30, 61), pa.int64()), "s_nationkey": pa.array([i % 7 for i in range(31)], pa.int32())}), f"{tmp_path}/supplier.parquet")
    cell = {}
    for s, p, q, _ in items:
        cell[s, p] = cell.get((s, p), 0) + q
    want = {}
    for (s, p), x in cell.items():
        for (s2, p2), y in cell.items():
            if p == p2:
                want[s, s2] = want.get((s, s2), 0) + x * y
    for name in ("sparse_product", "sparse_product_salted"):
        assert {(r.src, r.trg): r.score for r in QUERIES[name](spark, str(tmp_path)).collect()} == want
    assert max(r.src for r in QUERIES["sparse_product_pruned"](spark, str(tmp_path)).collect()) > 40
    colour = {}
    for s, _, _, line in items:
        colour[line, s] = 1
    for i in range(31):
        key = (i % 7, 30 + i)
        colour[key] = colour.get(key, 0) % 2 + 2
    assert {(r.u, r.v): r.colour for r in QUERIES["two_colour_edges"](spark, str(tmp_path)).collect()} == colour

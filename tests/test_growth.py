"""Steps whose work has to grow no faster than their input."""

import numpy as np

from kinmap.operators import sparse, train


def test_vectors_are_trained_once(spark, tmp_path):
    """What gives the vectors runs once, though both sides are read for blocks and for sizes."""
    import pandas as pd

    folder = str(tmp_path)

    def trained(frames):
        import uuid

        for f in frames:
            if len(f):
                open(f"{folder}/{uuid.uuid4().hex}", "w").close()
                yield pd.DataFrame({"batch": 0, "side": (f.id % 2 + 1).astype("int32"), "id": f.id, "vec": [[float(i), 1.0] for i in f.id]})

    vectors = spark.range(0, 8, 1, 1).mapInPandas(trained, "batch long, side int, id long, vec array<double>")
    assert train.batch_similarity(vectors, 2).count() == 8
    assert len(list(tmp_path.iterdir())) == 1


def test_mutual_corrected_in_blocks():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(57, 6)), rng.normal(size=(43, 6))
    s = x @ y.T
    m = 2 * s - np.sort(s, axis=1)[:, -10:].mean(axis=1, keepdims=True) - np.sort(s, axis=0)[-10:].mean(axis=0, keepdims=True)
    best, back = train.mutual_corrected(x, y, 10, rows=8)
    assert best.tolist() == m.argmax(axis=1).tolist()
    assert back.tolist() == m.argmax(axis=0).tolist()


def test_product_in_blocks_of_rows(spark, monkeypatch):
    """Single products are not shuffled: no exchange by cells; hubs, several blocks and pruned rows give what numpy gives."""
    monkeypatch.setattr(sparse, "BLOCK", 500)
    rng = np.random.default_rng(1)
    a, b = (rng.integers(1, 9, (40, 30)) * (rng.random((40, 30)) < 0.3) for _ in range(2))
    a[:, 3] = b[:, 3] = 2  # a hub
    cells = lambda m: spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)], "src long, trg long, score double")
    for salt in (0, 3):
        made = sparse.product(cells(a), cells(b.T), salt)
        assert "hashpartitioning(src" not in made._jdf.queryExecution().toString()
        assert {(r.src, r.trg): r.score for r in made.collect()} == {(i, j): x for (i, j), x in np.ndenumerate(a @ b.T)}
    e = np.exp((a @ b.T) / 100)
    soft = e / e.sum(axis=1, keepdims=True)
    got = {(r.src, r.trg): r.score for r in sparse.pruned_product(cells(a / 100), cells(b.T), 0.03).collect()}
    assert set(got) == {(i, j) for (i, j), x in np.ndenumerate(soft) if x >= 0.03}
    assert all(abs(x - soft[k]) < 1e-12 for k, x in got.items())


def test_sinkhorn_writes_its_cells_once(spark, monkeypatch):
    from kinmap.operators import storage

    calls, real = [], storage.store
    monkeypatch.setattr(storage, "store", lambda df: (calls.append(1), real(df))[1])
    sim = spark.createDataFrame([(s, t, float((s * 7 + t * 5) % 11)) for s in range(12) for t in range(9) if (s + t) % 4], "src long, trg long, score double")
    got = sparse.sinkhorn(sim, reg=0.1, rounds=40, tolerance=1e-6).collect()
    assert len(calls) <= 2
    assert len(got) == sim.count()
    columns = {}
    for r in got:
        columns[r.trg] = columns.get(r.trg, 0) + r.score
    assert all(abs(x * 9 - 1) < 1e-6 for x in columns.values())


def test_vectors_are_summed_whole(spark):
    """An edge's vector is not taken apart into a row for each of its numbers, unless lengths differ."""
    sim = spark.createDataFrame([(0, 1, 2.0), (0, 2, 3.0), (1, 2, 1.0)], "src long, trg long, score double")
    even = spark.createDataFrame([(1, [1.0, 2.0]), (2, [5.0, 7.0])], "id long, vec array<double>")
    made = sparse.product_with_dense(sim, even)
    assert "Generate" not in made._jdf.queryExecution().toString()
    assert {r.id: r.vec for r in made.collect()} == {0: [17.0, 25.0], 1: [5.0, 7.0]}
    ragged = spark.createDataFrame([(1, [1.0]), (2, [5.0, 7.0])], "id long, vec array<double>")
    assert {r.id: r.vec for r in sparse.product_with_dense(sim, ragged).collect()} == {0: [17.0, 21.0], 1: [5.0, 7.0]}


def test_triples_are_not_gathered_by_relation(spark):
    from kinmap.operators import graph
    from kinmap.operators.storage import store

    t = store(spark.createDataFrame([(i, i % 2, (i * 7) % 50) for i in range(200)], "h long, r int, t long"))
    plan = graph.weighted_adjacency(t)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(r#" not in plan


def test_factors_read_their_matrix_once(spark, tmp_path):
    from kinmap.operators import low_rank

    folder = str(tmp_path)

    def cells(frames):
        import uuid

        for f in frames:
            if len(f):
                open(f"{folder}/{uuid.uuid4().hex}", "w").close()
                yield f.assign(trg=f.src % 3, score=1.0 + f.src)

    m = spark.range(0, 9, 1, 1).toDF("src").mapInPandas(cells, "src long, trg long, score double")
    low_rank.factors(m, 3, 1)
    assert len(list(tmp_path.iterdir())) == 1


def test_sets_meet_in_blocks(spark, monkeypatch):
    """Near copies are scored as one block, each set shipped once, not once for each pair; hot groups are cut, and scores stay exact."""
    from kinmap.operators import lsh

    sets = lambda shift: [(shift + i, [f"w{j}" for j in range(20) if j != i % 20] + [f"g{i % 3}"] * 2) for i in range(30)]
    tables = [rows + [(rows[0][0], ["w1", "other"]), (rows[-1][0] + 1, [f"alone{shift}", "w1"])] for shift in (0, 100) for rows in [sets(shift)]]
    a, b = (spark.createDataFrame(t, "id long, tokens array<string>") for t in tables)
    pairs = [(i, 100 + j) for i in range(30) for j in range(30)] + [(30, 130), (30, 107)]
    frame = spark.createDataFrame(pairs, "src long, trg long")
    want = sorted((s, t, len(set(x) & set(y)) / len(set(x) | set(y))) for s, t in pairs for i, x in tables[0] if i == s for j, y in tables[1] if j == t)
    assert lsh.blocked(frame).select("block", "src").distinct().count() <= 33
    for side in (1024, 7):
        monkeypatch.setattr(lsh, "SIDE", side)
        made = lsh.with_jaccard(frame, a, b)
        assert "array_intersect" not in made._jdf.queryExecution().toString()
        assert sorted((r.src, r.trg, r.score) for r in made.collect()) == want
    assert max(r["count"] for r in lsh.blocked(frame).groupBy("block").count().collect()) < 900
    assert lsh.with_jaccard(frame.filter("src < 0"), a, b).count() == 0


def test_weights_without_a_shuffle_of_counts(spark, monkeypatch):
    """Neither counts nor weights of documents are shuffled: exchanges are by bucket or by the buckets' tokens. Repeated and null ids, blank texts."""
    import math
    from collections import Counter

    from kinmap.operators import tokens

    monkeypatch.setattr(tokens, "BUCKET_BYTES", 40)
    rows = [(1, "a b\tb\x0bc"), (2, "a a a\n"), (1, "b d"), (None, "c c"), (None, "é a"), (3, " \n "), (4, None), (5, "a c"), (6, "d")]
    docs = spark.createDataFrame(rows, "id int, text string")
    own = {}
    for i, text in rows:
        own.setdefault(i, Counter()).update(w for w in (text or "").replace("\t", " ").replace("\x0b", " ").replace("\n", " ").split(" ") if w)
    df = Counter(t for c in own.values() for t in c)
    for vocabulary in (None, {"a", "c"}):
        raw = {i: {t: n * (math.log((1 + len(rows)) / (df[t] + 1)) + 1) for t, n in c.items() if vocabulary is None or t in vocabulary} for i, c in own.items()}
        want = {(i, t): w / math.sqrt(sum(x * x for x in c.values())) for i, c in raw.items() for t, w in c.items()}
        made = tokens.tf_idf(docs, vocabulary and spark.createDataFrame([(t,) for t in vocabulary], "token string"))
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(id" not in plan
        got = {(r.id, r.token): r.weight for r in made.collect()}
        assert got.keys() == want.keys() and all(abs(x - want[k]) < 1e-12 for k, x in got.items())
    assert tokens.tf_idf(docs.filter("id > 6")).count() == 0
    assert tokens.tf_idf(docs.filter("id = 3")).count() == 0

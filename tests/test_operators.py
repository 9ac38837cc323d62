import numpy as np
import pytest
from pyspark.sql import functions as F

from kinmap.operators import evaluate, graph, knn, lsh, match, more, sparse, storage, train
from kinmap.operators.knn import nearest, top_k
from kinmap.sources import graphs
from kinmap.streaming import accumulate


def table(spark, rows, schema="src long, trg long, score double"):
    return spark.createDataFrame(rows, schema)


def cells(df):
    return {(r.src, r.trg): r.score for r in df.collect()}


def test_ties_go_to_the_smallest(spark):
    sim = table(spark, [(0, 2, 0.5), (0, 1, 0.5)])
    assert sparse.argmax(sim).first().trg == 1
    assert top_k(sim, 1).first().trg == 1


def test_fusion(spark):
    a, b = table(spark, [(0, 0, 0.6)]), table(spark, [(0, 0, 0.4), (0, 1, 1.0)])
    got = cells(sparse.fuse([a, None, b], [1.0, 9.0, 0.05]))
    assert got == pytest.approx({(0, 0): 0.62, (0, 1): 0.05})


def test_minmax_and_softmax(spark):
    sim = table(spark, [(0, 0, 1.0), (0, 1, 2.0), (0, 2, 3.0)])
    assert cells(sparse.minmax(sim)) == pytest.approx({(0, 0): 0, (0, 1): 0.5, (0, 2): 1}, abs=1e-7)
    assert sum(cells(sparse.softmax(sim)).values()) == pytest.approx(1)


def test_salting_changes_nothing(spark):
    rng = np.random.default_rng(0)
    a = table(spark, [(int(i), int(j), float(v)) for i, j, v in zip(rng.integers(0, 9, 60), rng.integers(0, 4, 60), rng.random(60))])
    b = table(spark, [(int(i), int(j), float(v)) for i, j, v in zip(rng.integers(0, 4, 60), rng.integers(0, 9, 60), rng.random(60))])
    assert cells(sparse.product(a, b)) == pytest.approx(cells(sparse.product(a, b, salt=5)))


def test_sinkhorn_is_doubly_stochastic(spark):
    rng = np.random.default_rng(1)
    sim = table(spark, [(i, j, float(rng.random())) for i in range(4) for j in range(4)])
    got = cells(sparse.sinkhorn(sim, reg=0.1, rounds=60))
    m = np.array([[got[i, j] for j in range(4)] for i in range(4)])
    assert m.sum(axis=0) == pytest.approx([0.25] * 4, abs=1e-3) and m.sum(axis=1) == pytest.approx([0.25] * 4, abs=1e-3)


def test_margin(spark):
    sim = table(spark, [(0, 0, 0.9), (0, 1, 0.85), (1, 1, 0.5)])
    assert match.mutual_with_margin(sim, 0.1).count() == 0
    assert match.mutual_with_margin(sim, 0.01).count() == 1


def test_matching_is_one_to_one_and_good(spark):
    rng = np.random.default_rng(2)
    s = rng.random((7, 7))
    got = match.greedy_matching(table(spark, [(i, j, float(s[i, j])) for i in range(7) for j in range(7)])).collect()
    assert len({r.src for r in got}) == len({r.trg for r in got}) == len(got) == 7
    from itertools import permutations

    best = max(sum(s[i, p[i]] for i in range(7)) for p in permutations(range(7)))
    assert sum(r.score for r in got) >= best / 2


def test_implicit_zero(spark):
    sim = table(spark, [(0, 0, -0.2), (0, 1, 0.7), (9, 2, 0.1), (9, 3, 0.1), (9, 4, 0.1)])
    gold = spark.createDataFrame([(0, 0)], "src long, trg long")
    assert evaluate.gold_ranks(sim, gold).first()["rank"] == 2
    assert evaluate.gold_ranks(sim, gold, implicit_zero=True).first()["rank"] == 5


def test_truncated_rank(spark):
    sim, gold = table(spark, [(0, 1, 1.0)]), spark.createDataFrame([(0, 0)], "src long, trg long")
    assert evaluate.truncated(sim, gold, 1, 10).first().mrr == pytest.approx(1 / 6)


def test_functionality(spark):
    t = spark.createDataFrame([(1, 1, 2), (1, 1, 3), (4, 1, 3)], "h long, r long, t long")
    r = graph.functionality(t).first()
    assert (r.func, r.inverse) == pytest.approx((2 / 3, 2 / 3))
    assert cells(graph.weighted_adjacency(t))[1, 2] == pytest.approx(2 / 3)


def test_swap_and_overlap(spark):
    t = spark.createDataFrame([(1, 9, 2)], "h long, r long, t long")
    link = spark.createDataFrame([(1, 11)], "src long, trg long")
    assert sorted(tuple(r) for r in graph.swapped(t, link).collect()) == [(1, 9, 2), (11, 9, 2)]
    a = spark.createDataFrame([(0, i) for i in (1, 2, 3)], "part int, id long")
    b = spark.createDataFrame([(0, i) for i in (2, 3, 4)], "part int, id long")
    assert graph.overlaps(a, b).first().score == pytest.approx(2 / 3.01)


def test_parts_are_balanced_and_whole(spark):
    edges = [(i, 1, j) for i in range(30) for j in range(i + 1, 30) if i // 10 == j // 10]
    t = spark.createDataFrame(edges, "h long, r long, t long")
    nodes = spark.range(30).select("id")
    parts = graph.label_parts(graph.entity_graph(t), nodes, 3, rounds=8, slack=1.2).collect()
    sizes = np.bincount([r.part for r in parts], minlength=3)
    assert len(parts) == 30 and sizes.max() <= 13
    got = graph.random_parts(nodes, 4).collect()
    assert len({r.id for r in got}) == 30


def test_nearest_in_blocks(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(30, 5)), rng.normal(size=(40, 5))
    a = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    b = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "id long, vec array<double>")
    for metric in ("inner", "cosine", "euclidean", "manhattan", "sqeuclidean"):
        got = nearest(a, b, 4, metric, rows=8).collect()
        from kinmap.operators.knn import scores

        s = scores(x, y, metric)
        want = {(i, j) for i in range(30) for j in np.argsort(-s[i], kind="stable")[:4].tolist()}
        assert {(r.src, r.trg) for r in got} == want


def gradient(f, x, g, rng, n=6):
    for _ in range(n):
        i = tuple(rng.integers(0, s) for s in x.shape)
        old, e = x[i], 1e-6
        x[i] = old + e
        up = f()
        x[i] = old - e
        down = f()
        x[i] = old
        assert (up - down) / (2 * e) == pytest.approx(g[i], rel=1e-3, abs=1e-6)


def small_graph(rng, n=12):
    return np.array([(rng.integers(0, n), rng.integers(0, 3), rng.integers(0, n)) for _ in range(40)])


def test_convolution_gradient():
    rng = np.random.default_rng(4)
    m = train.ConvolutionModel(train.normalized_adjacency(small_graph(rng), 12), 12, dim=5)
    pairs = np.array([(0, 6), (1, 7), (2, 8)])
    bad = m.wrong(pairs)
    gradient(lambda: m.loss(pairs, bad)[0], m.w, m.loss(pairs, bad)[1], rng)


def test_reflection_gradient():
    rng = np.random.default_rng(5)
    m = train.ReflectionModel(small_graph(rng), 12, dim=4, depth=2)
    rows = np.array([(0, 6, 3, 9), (1, 7, 4, 10), (2, 8, 5, 11)])
    grads = m.loss(rows)[1]
    for name, value in m.p.items():
        gradient(lambda: m.loss(rows)[0], value, grads[name], rng)


def test_training_lowers_the_loss():
    rng = np.random.default_rng(6)
    t = small_graph(rng, 20)
    pairs = np.array([(i, i + 10) for i in range(5)])
    m = train.ReflectionModel(t, 20, dim=8, dropout=0.0)
    rows = np.concatenate([pairs, rng.integers(0, 20, pairs.shape)], axis=1)
    before = m.loss(rows)[0]
    m.fit(pairs, 30)
    assert m.loss(rows)[0] < before


def test_files(spark, tmp_path):
    (tmp_path / "rel_triples_1").write_text("a\tp\tb\nb\tq\tc\n", encoding="utf-8")
    (tmp_path / "triples_2").write_text("x\tp\ty\n", encoding="utf-8")
    (tmp_path / "ent_links").write_text("a\tx\nb\ty\nz\tw\nc\tx\nb\tx\n", encoding="utf-8")
    d = graphs.paired_layout(spark, str(tmp_path))
    assert {r.key: r.id for r in d.entity1.collect()} == {"a": 0, "b": 1, "c": 2, "z": 3}
    assert {(r.h, r.r, r.t) for r in d.triples1.collect()} == {(0, 0, 1), (1, 1, 2)}
    assert {r.key for r in d.entity2.collect()} == {"x", "y", "w"}
    assert [(r.src, r.trg) for r in d.train.collect()] == [(0, 0)] and d.test.count() == 4
    graphs.export_pair(d, str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out" / "triples_2")).collect()] == ["4\t2\t5"]
    names = graphs.read_names(spark, [str(tmp_path / "out" / "ent_ids_1")])
    assert {r.id: r.name for r in names.collect()} == {0: "a", 1: "b", 2: "c", 3: "z"}
    (tmp_path / "bad").write_text("a\tb\n", encoding="utf-8")
    with pytest.raises(Exception, match="too few fields"):
        graphs.read_triples(spark, str(tmp_path / "bad")).collect()


def test_encoded_files(spark, tmp_path):
    for i in (1, 2):
        (tmp_path / f"triples_{i}").write_text("0 0 1\n1 2 0\n")
    (tmp_path / "ent_ids_1").write_text("0\ta\n1\tb\n")
    (tmp_path / "ref_ent_ids").write_text("0 1\n")
    (tmp_path / "attrs").write_text("a\tx\ty\nb\nc\tx\n")
    d = graphs.encoded_layout(spark, str(tmp_path))
    assert set(d) == {"triples1", "triples2", "test", "names"}
    assert sorted(r.r for r in d["triples1"].collect()) == [1, 3] and d["test"].first().trg == 1
    assert sorted(tuple(r) for r in graphs.read_attributes(spark, [str(tmp_path / "attrs")]).collect()) == [("a", "x"), ("a", "y"), ("c", "x")]


def test_vectors_files(spark, tmp_path):
    df = spark.createDataFrame([("cat", [0.5, 1.0]), ("dog", [0.25, -1.0])], "word string, vec array<double>")
    graphs.write_vectors(df, str(tmp_path / "v"))
    (tmp_path / "v" / "head.txt").write_text("2 2 2 2\n")
    back = graphs.read_vectors(spark, str(tmp_path / "v"), 2)
    words = spark.createDataFrame([("#Cat",), ("bird",)], "word string")
    got = {r.word: r.vec for r in graphs.look_up_vectors(words, back).collect()}
    assert got == {"#Cat": [0.5, 1.0], "bird": None}


def test_phases(spark, tmp_path):
    sim = table(spark, [(0, 1, 0.5)])
    graphs.save_similarity(sim, str(tmp_path), 2, "small", "fr")
    got = graphs.load_similarities(spark, str(tmp_path), [2, 3], "small", "fr")
    assert got[1] is None and cells(got[0]) == {(0, 1): 0.5}


def test_stream(spark, tmp_path):
    rows = table(spark, [(0, 1, 0.5), (0, 1, 0.25), (1, 1, 1.0)])
    rows.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    accumulate.start(stream, "sums_test", str(tmp_path / "state")).awaitTermination()
    assert cells(spark.table("sums_test")) == {(0, 1): 0.75, (1, 1): 1.0}


def test_rotation(spark):
    rng = np.random.default_rng(7)
    x, q = rng.normal(size=(20, 3)), more.orthogonal(rng.normal(size=(3, 3)))
    a = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    b = more.mapped(a, q)
    links = a.select(F.col("id").alias("src"), F.col("id").alias("trg"))
    assert more.rotation(a, b, links) == pytest.approx(q, abs=1e-9)


def test_alignment_finds_links(spark):
    """Names that are equal but for a letter align; the structure channel agrees on some."""
    from kinmap.plans.queries_train import alignment

    got = {r.channel: r for r in alignment(spark, "/root/testdata/sf0.001", parts=2, epochs=5, dim=8, model="gcn-align").scores().collect()}
    assert set(got) == {"name", "structure", "all"}
    assert got["name"].hits_1 > 0.8 and got["all"].hits_1 > 0.8


def test_translation_gradient_and_links():
    t, pairs = small_graph(np.random.default_rng(0)), np.array([[0, 6], [1, 7], [2, 8]])
    m = train.TranslationModel(t, 12, 6, dim=5)
    m.m += np.random.default_rng(1).normal(0, 0.1, m.m.shape)
    for w, g in zip((m.e, m.r, m.m), m.loss(pairs)[1], strict=True):
        gradient(lambda: m.loss(pairs)[0], w, g, np.random.default_rng(2))
    before = m.loss(pairs)[0]
    y = m.fit(pairs, 200)
    assert m.loss(pairs)[0] < 0.5 * before
    near = np.linalg.norm(y[:6, None] - y[None, 6:], axis=2).argmin(axis=1)
    assert near[:3].tolist() == [0, 1, 2]


def test_rotation_gradient_and_shared_vectors():
    t, pairs = small_graph(np.random.default_rng(0)), np.array([[0, 6], [1, 7], [2, 8]])
    m = train.RotationModel(t, 12, dim=8, negatives=3)
    bad = m.wrong(t)
    assert ((bad != np.repeat(t, 3, axis=0)).sum(axis=1) <= 1).all() and (bad[:, 1] == np.repeat(t, 3, axis=0)[:, 1]).all()
    for w, g in zip((m.e, m.phase), m.loss(t, bad)[1], strict=True):
        gradient(lambda: m.loss(t, bad)[0], w, g, np.random.default_rng(2))
    before = m.loss(t, bad)[0]
    y = m.fit(pairs, 200)
    assert m.loss(t, bad)[0] < before
    assert np.array_equal(y[pairs[:, 0]], y[pairs[:, 1]]) and not np.array_equal(y[3], y[9])


@pytest.mark.parametrize("model", ["mtranse", "rotate"])
def test_decoders_train_without_triples_or_links(model):
    y = train.embed(np.zeros((0, 3), np.int64), np.zeros((0, 2), np.int64), (2, 3), model, epochs=2, dim=4)
    assert y.shape == (5, 4) and np.isfinite(y).all()


@pytest.mark.parametrize("model", ["mtranse", "rotate"])
def test_batches_train_with_decoders(spark, model):
    members = spark.createDataFrame([(0, s, 10 * s + i) for s in (1, 2) for i in range(4)], "batch int, side int, id long")
    triples = spark.createDataFrame([(0, s, 10 * s + i, 0, 10 * s + (i + 1) % 4) for s in (1, 2) for i in range(4)], "batch int, side int, h long, r long, t long")
    got = train.train_batches(members, triples, table(spark, [(10, 20, 1.0), (11, 21, 1.0)]), model, epochs=3, dim=4).collect()
    assert sorted((r.side, r.id) for r in got) == [(s, 10 * s + i) for s in (1, 2) for i in range(4)]
    assert all(len(r.vec) == 4 for r in got)


def test_chebyshev_polynomials(spark):
    edges = [(0, 1), (1, 2), (2, 3), (3, 4), (4, 0), (1, 3), (5, 0)]
    n, k = 6, 3
    a = np.zeros((n, n))
    for u, v in edges:
        a[u, v] = a[v, u] = 1
    w = 1 / np.sqrt(a.sum(axis=1))
    lap = np.eye(n) - w[:, None] * a * w
    largest = np.linalg.eigvalsh(lap).max()
    step = 2 / largest * lap - np.eye(n)
    want = [np.eye(n), step]
    for _ in range(2, k + 1):
        want.append(2 * step @ want[-1] - want[-2])
    adj = table(spark, [(u, v, 1.0) for u, v in edges] + [(v, u, 1.0) for u, v in edges])
    ids = spark.range(n)
    for got, exact in zip(graph.chebyshev(adj, ids, k, largest=float(largest)), want, strict=True):
        dense = np.zeros((n, n))
        for (i, j), x in cells(got).items():
            dense[i, j] = x
        assert dense == pytest.approx(exact, abs=1e-9)
    x = np.random.default_rng(0).random((n, 3))
    vectors = spark.createDataFrame([(i, x[i].tolist()) for i in range(n)], "id long, vec array<double>")
    for got, exact in zip(graph.chebyshev_features(adj, ids, vectors, k, largest=float(largest)), want, strict=True):
        assert np.array([r.vec for r in got.orderBy("id").collect()]) == pytest.approx(exact @ x, abs=1e-9)
    found = cells(graph.scaled_laplacian(adj, ids, rounds=60))
    assert found[0, 0] == pytest.approx(step[0, 0], abs=1e-2)


def test_ranks_over_every_cell_without_a_table_of_cells(spark, monkeypatch):
    """Equal vectors tie, links without a cell have no rank, and nothing makes the dense matrix."""
    rng = np.random.default_rng(3)
    base = np.round(rng.normal(size=(30, 4)), 1)
    a = spark.createDataFrame([(2 * i, [float(x) for x in base[i % 12]]) for i in range(40)], "id long, vec array<double>")
    b = spark.createDataFrame([(2 * i + 1, [float(x) for x in base[i % 17]]) for i in range(50)], "id long, vec array<double>")
    links = spark.createDataFrame([(2 * i, 2 * i + 1) for i in range(40)] + [(0, 7), (2, 999), (998, 1)], "src long, trg long")
    plain = lambda df: sorted((r.src, r.trg, r["rank"] or 0) for r in df.collect())
    cells = storage.store(knn.dense(a, b))
    want = {(hub, by): plain(evaluate.gold_ranks(knn.csls(cells, hub) if hub else cells, links, by=by)) for hub in (None, 3) for by in ("src", "trg")}
    monkeypatch.setattr(knn, "dense", None)
    for (hub, by), ranks in want.items():
        means = evaluate.neighbour_means(a, b, hub) if hub else None
        got = plain(evaluate.vector_ranks(a, b, links, by=by, means=means, rows=16, most=32))
        assert got == ranks


def test_cells_of_pairs_alone(spark):
    rng = np.random.default_rng(5)
    a = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(9)], "id long, vec array<double>")
    for metric in ("cosine", "sqeuclidean", "manhattan", "euclidean", "inner"):
        every = cells(knn.dense(a, a, metric, rows=4))
        pairs = spark.createDataFrame([(1, 2), (8, 0)], "src long, trg long")
        assert cells(knn.cells_at(pairs, a, a, metric)) == pytest.approx({p: every[p] for p in ((1, 2), (8, 0))})
        assert len(every) == 81


def test_outer_cells_are_made_where_the_sparse_table_has_some(spark):
    sim = table(spark, [(1, 5, 2.0), (1, 6, 3.0), (2, 5, 4.0), (9, 5, 1.0)])
    rows, columns = spark.createDataFrame([(1, 10), (2, 20)], "id long, x long"), spark.createDataFrame([(5, 1), (6, 2), (7, 3)], "id long, x long")
    dense = rows.crossJoin(columns.toDF("trg", "y")).select(F.col("id").alias("src"), "trg", (F.col("x") + F.col("y")).alias("score"))
    got = sparse.elementwise_outer(sim, rows, columns, lambda x, y: x + y, lambda a, b: a * b)
    assert cells(got) == cells(sparse.elementwise(sim, dense, lambda a, b: a * b)) == {(1, 5): 22.0, (1, 6): 36.0, (2, 5): 84.0}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and "Cross" not in plan


def test_totals_of_shared_postings(spark):
    rng = np.random.default_rng(6)
    rows = [(int(i), f"t{k}") for i in range(60) for k in rng.integers(0, 9, 3)]
    w = spark.createDataFrame(rows + [(77, None), (78, "alone")], "id long, token string")
    hubs = spark.createDataFrame([("t1",), ("t2",)], "token string")
    for h in (None, hubs):
        pairs = lsh.shared_postings(w.filter("id % 2 = 0"), w.filter("id % 2 = 1"), h).collect()
        got = lsh.shared_posting_totals(w.filter("id % 2 = 0"), w.filter("id % 2 = 1"), h).first()
        assert tuple(got) == (len(pairs), sum(r.src for r in pairs), sum(r.trg for r in pairs))
    none = lsh.shared_posting_totals(w.filter("id < 0"), w, hubs).first()
    assert tuple(none) == (0, None, None)


def test_string_similarity_pairs_names_once(spark, monkeypatch):
    """Candidates are made of distinct names, whatever the number of ids that have them."""
    seen, real = [], lsh.candidates
    monkeypatch.setattr(lsh, "candidates", lambda a, b, *r: (seen.append((a.count(), b.count())), real(a, b, *r))[1])
    a = spark.createDataFrame([(i, "red_small_box" if i % 3 else "blue_cup") for i in range(30)], "id long, name string")
    b = spark.createDataFrame([(100 + i, "red_small_box") for i in range(20)], "id long, name string")
    assert cells(lsh.string_similarity(a, b)) == {(i, 100 + j): 1.0 for i in range(30) if i % 3 for j in range(20)}
    assert seen == [(2, 1)]


def test_line_graph_size_and_edge_parts_without_pairs(spark, monkeypatch):
    rng = np.random.default_rng(8)
    t = spark.createDataFrame([(int(h), 1, int(x)) for h, x in rng.integers(0, 15, (60, 2))] + [(100, 1, 101)], "h long, r int, t long")
    pairs = graph.line_graph(t)
    assert tuple(graph.line_graph_size(t).first()) == tuple(pairs.agg(F.count("*"), F.sum("weight")).first())
    assert tuple(graph.line_graph_size(t.filter("h = 100")).first()) == (0, None)
    edges = t.filter("h <> t").select(F.least("h", "t").alias("u"), F.greatest("h", "t").alias("v")).distinct()
    lines = pairs.select(F.col("e").alias("u"), F.col("f").alias("v"), F.col("weight").cast("double").alias("weight"))
    want = {r.id: r.part for r in graph.label_parts(lines, edges.select(F.xxhash64("u", "v").alias("id")), 3).collect()}
    monkeypatch.setattr(graph, "line_graph", None)
    got = {r.id: r.part for r in graph.edge_parts(t, 3).select(F.xxhash64("u", "v").alias("id"), "part").collect()}
    assert got == want and len(set(got.values())) == 3


def test_streamed_sums_stay_off_the_driver(spark, tmp_path):
    rows = table(spark, [(0, 1, 0.5), (0, 1, 0.25), (1, 1, 1.0)])
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    accumulate.start_files(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert cells(accumulate.sums(spark, str(tmp_path / "out"))) == {(0, 1): 0.75, (1, 1): 1.0}


@pytest.mark.parametrize("name", ["mtranse_train", "rotate_train"])
def test_decoder_queries_train_with_their_presets(monkeypatch, name):
    """No fewer epochs, dimensions or negatives than the models have by themselves."""
    from kinmap.plans import queries_train

    seen = []
    monkeypatch.setattr(queries_train, "_batches", lambda spark, d: (None, None))
    monkeypatch.setattr(queries_train, "train_links", lambda spark, d: None)
    monkeypatch.setattr(train, "train_batches", lambda members, triples, pairs, model, **options: seen.append((model, options)))
    monkeypatch.setattr(train, "batch_similarity", lambda vectors, k: None)
    queries_train.QUERIES[name](None, "")
    assert seen == [(name.split("_")[0], {})]


def test_numbering_reads_its_input_once(spark):
    """The input is stored before quantiles, counts and ranks are taken from it."""
    seen = spark.sparkContext.accumulator(0)

    def look(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    rows = spark.range(0, 50, 1, 2).mapInPandas(look, "id long")
    got = graphs.numbered(rows, ["id"], "n").collect()
    assert sorted((r.id, r.n) for r in got) == [(i, i) for i in range(50)]
    assert seen.value == 50

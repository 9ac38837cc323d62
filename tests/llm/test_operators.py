"""The operators' own interfaces."""

import gzip
import io
import math
import random
import time
import zlib
import zipfile
from collections import Counter
from itertools import product

import numpy as np
import public_tokenizers
import pytest

from kinmap.llm import decontaminate, media, pieces, quality, secret_scan, segmentation, simhash, token_counts, token_files, toxicity
from kinmap.llm.common import remove, shared_dir, table
from kinmap.llm.components import components
from tests.llm.conftest import passage


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 9)] + [(100, 99), (101, 100), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(10), 0), **dict.fromkeys((99, 100, 101), 99)}


def test_hot_bucket_is_cut_and_whole(spark):
    """Chains within one bucket are found whatever the size of a cell."""
    prints, x = [], 0
    for i in range(60):
        prints.append(x)
        x ^= 0b111 << (i % 20)
    prints = sorted({p for p in prints} | {p ^ 1 << 40 for p in prints})
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    group = {p: p for p in prints}
    for _ in prints:
        for p in prints:
            group[p] = min(group[q] for q in prints if (p ^ q).bit_count() <= 4)
    for cell in (4, 4096):
        roots = {r.node: r.root for r in components(simhash.links(df, cell=cell)).collect()}
        assert {p: roots.get(p, p) for p in prints} == group


def test_block_masks_cover():
    """Any four differing bits leave some choice of blocks untouched."""
    rng = random.Random(1)
    masks = [m % (1 << 64) for m in simhash.block_masks(4, 3)]
    assert len(masks) == 35
    for _ in range(2000):
        d = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(m & d == 0 for m in masks)


def near_copy(text, rng, changes):
    w = text.split()
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def test_near_duplicates_go_and_clean_stay(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(4000)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(300)) for _ in range(40)]
    docs = [(i, t) for i, t in enumerate(base)] + [(100 + i, near_copy(t, rng, 3)) for i, t in enumerate(base[:20])] + [(200 + i, t) for i, t in enumerate(base[:10])]
    docs += [(500, None), (501, ""), (502, "  "), (None, base[30]), (None, "no id at all"), (3, base[3])]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, _root string")
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    got = [r.doc_id for r in kept.collect()]
    assert Counter(got) == Counter([*range(40), 500, None])


@pytest.mark.parametrize("kind", ["appended", "truncated"])
def test_contiguous_near_duplicates_go(spark, kind):
    """Copies with a passage more or less, of similarity 0.80 to 0.92, are candidates, and most are caught."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(4000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    pairs = []
    for i in range(80):
        base, share = text(rng.randint(100, 600)), 0.81 + 0.11 * i / 80
        other = base + text(int(len(base) * (1 / share - 1))) if kind == "appended" else base[: int(len(base) * share) + 1]
        pairs.append((" ".join(base), " ".join(other)))
    keys = [[simhash.wide_fingerprints(t.encode(), 5)[1] for t in p] for p in pairs]
    assert all(any(x == y for x, y in zip(a, b, strict=True)) for a, b in keys)
    df = spark.createDataFrame([(i + 1000 * j, t) for i, p in enumerate(pairs) for j, t in enumerate(p)], "doc_id long, text string")
    got = {r.doc_id for r in simhash.drop_near_duplicates(df).collect()}
    assert got >= set(range(80)) and len(got) <= 84


def test_decontaminate_modes_and_slices(spark):
    rng = random.Random(4)
    item = passage(rng, 20)
    docs = spark.createDataFrame([(1, f"Start, {item.upper()}! End."), (2, "clean text"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([("a", item), ("b", passage(rng, 20)), ("c", None)], "item_id string, text string")
    assert [r.doc_id for r in decontaminate.decontaminate(docs, bench).orderBy("doc_id").collect()] == [2, 3]
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench, remove="spans").collect()}
    assert cut[1].startswith("Start, ") and cut[1].endswith(" End.") and len(cut[1]) < 20 and cut[2] == "clean text" and cut[3] is None
    one = decontaminate.mark(docs, bench, ["doc_id"]).orderBy("doc_id").collect()
    many = decontaminate.mark(docs, bench, ["doc_id"], max_bytes=150).orderBy("doc_id").collect()
    assert [(r.found.n_words, [tuple(s) for s in r.found.spans], r.found.items) for r in one] == [(r.found.n_words, [tuple(s) for s in r.found.spans], r.found.items) for r in many]


def test_token_files(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(i, passage(random.Random(i), i % 30)) for i in range(60)], "doc_id long, text string").repartition(5)
    out = str(tmp_path / "ids")
    token_files.write_token_files(docs, path, 2, out)
    rows = token_files.read_token_files(spark, out).orderBy("start").collect()
    tk = pieces.load(path)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert [r.doc_id for r in rows] == list(range(60)) and [r.position for r in rows] == list(range(60))
    assert all(r.ids == [*tk.encode(texts[r.doc_id], add_special_tokens=False).ids, 2] for r in rows)
    first = sorted((tmp_path / "ids" / "ids").glob("part-*"))[0]
    ids, offsets, doc_ids, known = token_files.map_part(str(first))
    assert ids.dtype == np.dtype("<u2") and len(offsets) == len(doc_ids) + 1 and known.all() and ids[offsets[1] - 1] == 2
    assert token_files.layout(49407, 49408) == (4, 0)


def test_wide_ids(spark, tmp_path):
    """An end id whose last byte the sink can't write as two bytes takes four."""
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    token_files.write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), 49407, str(tmp_path / "w"))
    assert [r.ids[-1] for r in token_files.read_token_files(spark, str(tmp_path / "w")).collect()] == [49407, 49407]


@pytest.mark.parametrize(("chunk", "overlap"), [(300, 10), (1000, 64)])
def test_splicing(chunk, overlap):
    tk = pieces.load(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(6)
    for t in [passage(rng, 900), "x" * 3000 + " a b" * 200 + "y" * 2000, " " * 2500, "ab " * 1500, "<|endoftext|> " * 300, passage(rng, 300) + "\n\n\n" + "é " * 900]:
        assert token_counts.spliced(tk, t, chunk, overlap)[0] == len(tk.encode(t, add_special_tokens=False).ids)


def test_sentencepiece_counts(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.createDataFrame([(1, "Hello there"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, path).collect()}
    import sentencepiece

    assert got == {1: len(sentencepiece.SentencePieceProcessor(model_file=path).encode("Hello there")), 2: 0}


def test_memo_forgets_and_stays_right():
    path = public_tokenizers.path("byte_bpe_50k.json")
    memo, tk, rng = pieces.Counts(path, 50), pieces.load(path), random.Random(7)
    for _ in range(50):
        t = passage(rng, 40) + " don't (x) 3.14 ...end!!"
        assert sum(memo.values(t.encode())) == len(tk.encode(t, add_special_tokens=False).ids)
        assert len(memo.young) <= 200


def objects():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a.txt", "hello")
    chunk = lambda k, d: len(d).to_bytes(4, "big") + k + d + zlib.crc32(k + d).to_bytes(4, "big")
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", (1).to_bytes(4, "big") * 2 + b"\x08\0\0\0\0") + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")
    gif = b"GIF89a\x01\0\x01\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;"
    bmp = b"BM" + (58).to_bytes(4, "little") + b"\0" * 4 + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + b"\0" * 40
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02\x12\xff\x00\x34\xff\xd9"
    pdf = b"%PDF-1.4\nstartxref\n0\n%%EOF"
    ogg = b"OggS\0\x04" + b"\0" * 20 + b"\x01\x03abc"
    flac = b"fLaC\x80\x00\x00\x22" + b"\0" * 34 + b"\xff\xf8"
    return {"image/png": png, "image/gif": gif, "image/bmp": bmp[:58], "image/jpeg": jpeg, "application/pdf": pdf, "audio/ogg": ogg, "audio/flac": flac, "application/gzip": gzip.compress(b"hi"), "application/zip": buffer.getvalue(), "audio/wav": media.to_wave(b"abcd")}


@pytest.mark.parametrize("kind", sorted(objects()))
def test_sniff(kind):
    data = objects()[kind]
    found = media.sniff(data)
    assert found[0] == (kind, 0, len(data))
    assert media.sniff(data[: len(data) - 1] if kind != "audio/flac" else data[:40]) == []
    if kind != "audio/flac":
        assert (kind, 5, len(data)) in media.sniff(b"junk " + data + b" more")


def test_inspect(spark):
    o = objects()
    rows = [(1, o["image/png"] + o["image/gif"], "image/jpeg"), (2, b"BM nothing PK", "text/plain"), (3, None, "x/y"), (4, b"", None)]
    got = {r.id: r for r in media.inspect(spark.createDataFrame(rows, "id long, media binary, declared string"), ["id"]).collect()}
    assert got[1].detected == "image/png" and got[1].valid and [(c.type, c.offset) for c in got[1].carved] == [("image/gif", len(o["image/png"]))]
    assert (got[2].detected, got[2].valid, got[2].carved) == ("text/plain", False, [])
    assert got[3].media_bytes is None and got[4].media_bytes == 0


def test_ledger_scans_only_what_is_new(spark):
    path = shared_dir(spark)
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    first = docs([(1, "token=abcdef"), (2, "token=abcdef"), (3, None)])
    assert secret_scan.update_ledger(first, path, fresh=True).count() == 2
    second = docs([(4, "token=abcdef"), (5, "new password: 123456789")])
    assert secret_scan.update_ledger(second, path).count() == 3
    newer = (*secret_scan.BASE, secret_scan.Rule("word", r"new", version=2))
    ledger = secret_scan.update_ledger(second, path, newer)
    assert ledger.count() == 5 and {tuple(r.rules) for r in ledger.collect()} >= {("word@2",)}
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secret_scan.findings(second, ledger, newer).collect()}
    assert got == {4: [("assign", 0, 12)], 5: [("word", 0, 3), ("assign", 4, 23)]}
    remove(spark, path)


def every(lattice_pieces, word):
    if not word:
        yield (), 1.0
    for j in range(1, len(word) + 1):
        if (e := lattice_pieces.edges.get(word[:j])) is not None:
            for rest, w in every(lattice_pieces, word[j:]):
                yield (e[0], *rest), e[1] * w


def test_segmentations_are_distributed_right():
    """First samples follow the model, second ones the model without the first, and the inclusion scores are unbiased."""
    p = segmentation.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    lattices, text, n = segmentation.Lattices(p), "thenan of", 4000
    true = {sum((a for a, _ in c), ()): math.prod(w for _, w in c) for c in product(*[list(every(p, w)) for w in p.words(text)])}
    total = sum(true.values())
    true = {k: v / total for k, v in true.items()}
    first, second, weight = Counter(), Counter(), 0.0
    for paths, threshold in segmentation.sample(lattices, [text] * n, [segmentation.key_seed(i, "t") for i in range(n)], 3):
        ids = [tuple(lattices.id[x.edges].tolist()) for x in paths]
        assert len(set(ids)) == 3
        first[ids[0]] += 1
        second[ids[1]] += 1
        weight += sum(math.exp(x.total - segmentation.inclusion(x.total, threshold)) for x in paths)
    assert weight / n == pytest.approx(1, abs=0.01)
    for k in sorted(true, key=true.get)[-4:]:
        assert first[k] / n == pytest.approx(true[k], abs=0.03)
        assert second[k] / n == pytest.approx(sum(true[j] * true[k] / (1 - true[j]) for j in true if j != k), abs=0.04)


def test_segmentations_give_the_text_back():
    p = segmentation.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    lattices = segmentation.Lattices(p, 50)
    texts = ["", " ", "a", "  a  b ", "x▁y\0z\0", "▁", "日本語 \U0001F600é", "\n\n a\n", "a_{b}.c ² x²., 1.5", "y" * 300 + "!", "don't (stop)"]
    for _ in range(2):
        for t, (paths, _) in zip(texts, segmentation.sample(lattices, texts, list(range(len(texts))), 4)):
            assert {p.decode(lattices.id[x.edges].tolist()) for x in paths} == {t}


def test_long_words_cost_in_proportion():
    """A word of a million characters: the totals behind are not scaled all over again, and its samples give it back."""
    p = segmentation.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(9)
    seconds = []
    for n in (50_000, 200_000):
        word = "".join(rng.choice("abcdefghij\u4e00") for _ in range(n))
        lattices, began = segmentation.Lattices(p, most_edges=100_000), time.process_time()
        for _ in range(2):
            ((paths, threshold),) = segmentation.sample(lattices, [word], [n], 2)
        seconds.append(time.process_time() - began)
        assert len(paths) == 2 and threshold < paths[1].value < paths[0].value
        assert all(p.decode(lattices.id[x.edges].tolist()) == word for x in paths)
    assert seconds[1] < 12 * max(seconds[0], 0.2)


def test_sets_beyond_the_first_are_searched():
    """Where the first pieces are nearly certain, the best set lies far behind; values of all sets agree."""
    p = segmentation.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    lattices = segmentation.Lattices(p)
    ((paths, _),) = segmentation.sample(lattices, ["the river " * 400], [3], 1)
    own = paths[0]
    whole = segmentation.Path(own.edges, own.words, own.places, own.value)
    with np.errstate(over="ignore"):
        seeds = np.array([3], np.uint64) ^ (np.uint64(2) * np.uint64(0xD6E8FEB86659FD93))
    segmentation.open_paths(lattices, [whole], seeds, some=len(own.edges))
    few = segmentation.Path(own.edges, own.words, own.places, own.value)
    segmentation.open_paths(lattices, [few], seeds, some=2)
    assert len(whole.sets) == len(own.edges) and len(few.sets) < len(own.edges)
    assert few.best == pytest.approx(whole.best) and few.cut == whole.cut


def test_repeated_labels_keep_the_same_rows(spark):
    from pyspark.sql import functions as F

    from kinmap.llm.labelled import sample

    docs = spark.createDataFrame([(1, f"text {i % 13}") for i in range(60)] + [(2, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    found = [[bytes(r["text"]) for r in sample(docs.repartition(k), labels, "toxic", F.lit(True), 3, 1000)] for k in (1, 4, 7)]
    assert found[0] == found[1] == found[2] and len(found[0]) == 12


def test_window_index_is_bounded():
    rng = random.Random(3)
    items = [(str(i), " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(40))).encode()) for i in range(2000)]
    index = decontaminate.Windows(items, 8)
    assert index.nbytes() < decontaminate.MOST * sum(len(t) for _, t in items) / 3
    assert index.scan(b"Clean " + items[7][1] + b" End")[2] == ["7"]


def test_toxicity_stage(spark, messy):
    import corpus_pipeline

    folder, docs, _ = messy
    got = corpus_pipeline.toxicity(spark, table(spark, folder, "documents"), folder)
    assert got.columns == table(spark, folder, "documents").columns
    assert {r.doc_id for r in got.collect()} <= {d[0] for d in docs}


def test_hot_groups_in_every_join(spark):
    """Half of the rows are one text, and their group is one component with many near fingerprints."""
    rng = random.Random(1)
    base = passage(rng, 200).split()
    rows = [(i, " ".join(base)) for i in range(400)]
    for i in range(400, 440):
        other = list(base)
        other[rng.randrange(200)] = "changed"
        rows.append((i, " ".join(other)))
    rows += [(1000 + i, passage(rng, 60)) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    assert len(got) == len(rows) and all(got[i] == 0 for i in range(400)) and all(got[1000 + i] >= 1000 for i in range(100))
    kept = {r.doc_id for r in simhash.drop_near_duplicates(df).collect()}
    assert kept == {0} | {1000 + i for i in range(100)}


def test_simhash_broadcasts_nothing(spark, monkeypatch):
    """Groups and roots are as many as fingerprints: at 0.6 GB, broadcast as Spark sees fit, they ran out of the driver's memory."""
    from kinmap.llm import common
    from kinmap.llm import components as stars

    plans = []

    def written(df, *path):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return common.materialize(df, *path)

    for module in (simhash, stars):
        monkeypatch.setattr(module, "materialize", written)
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").removesuffix("b")) > 1 << 20
    rng = random.Random(4)
    near = passage(rng, 200)
    df = spark.createDataFrame([(i, near if i < 20 else near_copy(near, rng, 1) if i < 30 else passage(rng, 50)) for i in range(60)], "doc_id long, text string")
    found = simhash.near_duplicates(df)
    assert found.count() == 60
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert any("SortMergeJoin" in x for x in plans) and not [x for x in plans if "Broadcast" in x]


def test_convolution_gradients_and_long_texts():
    rng = random.Random(8)
    good = [passage(rng, 40) for _ in range(60)]
    bad = [passage(rng, 20) + " idiotic scum " + passage(rng, 20) for _ in range(60)]
    m = toxicity.Model()
    m.train([t.encode() for t in good + bad], [0] * 60 + [1] * 60)
    s = toxicity.Scorer(m)
    assert s.score(b"a scum of idiotic river") > 0.5 > s.score(passage(rng, 30).encode())
    long = " ".join(passage(rng, 3000) for _ in range(8)).encode()
    words = toxicity.words_of(long)
    whole = m.logit(s.activations(words))
    assert s.score(long) == pytest.approx(1 / (1 + math.exp(-whole)), abs=1e-5)
    m.calibrate([0.9, 0.8, 0.2, 0.1], [1, 1, 0, 0], ["en"] * 4, least=2)
    assert m.thresholds == {None: 0.5, "en": 0.5}


def test_thresholds_count_all_label_rows(spark):
    """Rows beyond a sample of equal classes move the threshold; brute force over all rows agrees."""
    rng = random.Random(12)
    rows = [(i, lang, 1 / (1 + math.exp(-rng.gauss(1.5 if y else -1.5, 1.2))), y) for i, (lang, y) in enumerate([("en", 1)] * 60 + [("en", 0)] * 1500 + [("fr", 1)] * 40 + [("fr", 0)] * 30 + [("de", 1)] * 5 + [(None, 0)] * 90)]
    scored = spark.createDataFrame([r[:3] for r in rows], "doc_id long, lang string, score double")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows] + [(None, 1), (10**6, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.thresholds(scored, labels)
    assert set(got) == {None, "en", "fr"}

    def f1(own, at):
        hit = sum(y for _, _, s, y in own if s >= at)
        return 2 * hit / (sum(s >= at for _, _, s, _ in own) + sum(y for *_, y in own))

    for lang in got:
        own = [r for r in rows if lang is None or r[1] == lang]
        assert f1(own, got[lang]) >= max(f1(own, r[2]) for r in own) - 0.01
    few = [r for r in rows if r[1] == "en"][:120]
    m = toxicity.Model()
    m.calibrate([r[2] for r in few], [r[3] for r in few], ["en"] * 120)
    assert got["en"] > m.thresholds["en"]


def test_drop_toxic_sees_labels_beyond_the_sample(spark):
    """Thresholds of the stage are those of all label rows, also of those that were not learned from."""
    rng = random.Random(13)
    texts = [passage(rng, 40) + (" idiotic scum " if i % 2 else " ") + passage(rng, 20) for i in range(120)] + [passage(rng, 30) + " scum " + passage(rng, 30) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2 if i < 120 else 0) for i in range(420)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels.filter("doc_id < 120"))
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, model, labels).collect()}
    want = toxicity.thresholds(toxicity.score(docs, model, ["doc_id", "lang"]), labels)["en"]
    assert model.thresholds["en"] == pytest.approx(want)
    assert kept == {r.doc_id for r in toxicity.score(docs, model, ["doc_id"]).collect() if r.score < want}


@pytest.mark.parametrize("size", [1, 200, 201, 500, 140_000])
def test_quality_counts_the_whole_word(size):
    rng = random.Random(size)
    word = bytes(rng.randrange(33, 256) for _ in range(size))
    marked = b"<" + word + b">"
    want = Counter([1 + zlib.crc32(word, 7) % (quality.BUCKETS - 1)] + [1 + zlib.crc32(marked[i : i + n], n) % (quality.BUCKETS - 1) for n in quality.SIZES for i in range(len(marked) - n + 1)])
    assert Counter(int(f) for block in quality.features(word) for f in block) == want
    ids, share = quality.counted(word)
    assert set(ids.tolist()) == set(want)
    values = np.random.default_rng(1).normal(size=quality.BUCKETS)
    z = sum(values.astype(np.float32).astype(np.float64)[f] * k for f, k in want.items()) / want.total()
    assert quality.Scorer(values, 0.1).score(word) == pytest.approx(1 / (1 + math.exp(-z - 0.1)), abs=1e-6)


def test_lone_short_item_is_cut_out(spark, tmp_path):
    import corpus_pipeline
    from tests.llm.conftest import write

    texts = ["Before, Seven blue OWLS sang twice! After.", "nothing here", None, "seven blue owls sang twice and one green hat fell"]
    folder = write(tmp_path, list(enumerate(texts)), [(1, "seven blue owls sang twice"), (2, "one green hat fell")])
    got = {r.doc_id: r for r in corpus_pipeline.benchmark_passages(spark, table(spark, folder, "documents"), folder).collect()}
    assert {i: r.text for i, r in got.items()} == {0: "Before, ! After.", 1: texts[1], 2: None}
    assert got[0].n_chars == len(got[0].text) and got[1].n_chars == len(texts[1])


def test_pipeline(spark, messy):
    import corpus_pipeline

    folder, docs, _ = messy
    stage = table(spark, folder, "documents")
    columns = stage.columns
    for name, f in corpus_pipeline.STAGES[1:4]:
        stage = f(spark, stage, folder)
        assert stage.columns == columns, name
    kept = stage.collect()
    ids = [r.doc_id for r in kept]
    assert len(ids) == len(set(ids)) and 15 not in ids and 19 not in ids and 20 not in ids and 21 in ids
    text = {r.doc_id: r.text for r in kept}
    assert text[17] == "[assign] token=abc [assign]' [access] [hex]"
    out = corpus_pipeline.run(spark, folder).collect()
    assert out and all(r.decoded for r in out)


def test_pipeline_on_empty_tables(spark, empty):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, empty).collect() == []


def test_words_are_cut_alike_and_few_sets_are_opened():
    """Words between single spaces are cut without the pattern, as the pattern cuts them; sets are opened little further than is needed."""
    import public_tokenizers

    from kinmap.llm import segmentation as S

    pieces = S.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    odd = ["a", " a", "a ", "a  b", "a \n b", "a\nb c.d (e) f_g", "\n", "x\t y", "été 12² ٣ a-b", "don't 'tis ''", "日本 語。 x", "\0 a", "▁ a▁b", "-- a --", "a b c"]
    for text in odd:
        escaped = text.replace("\0", "\0\0").replace(S.SPACE, "\0\1") if S.SPACE in text or "\0" in text else text
        find = (pieces.cut if any(c in escaped for c in pieces.open) else pieces.quick).findall
        assert pieces.words(text) == find(S.SPACE + escaped.replace(" ", S.SPACE)), text
    texts = [" ".join(f"word{(i * j) % 97} letters and more" for j in range(900)) for i in range(1, 9)]
    found = S.sample(S.Lattices(pieces), texts, list(range(8)), 1)
    for (p,), _ in found:
        need = int((p.before + S.HIGHEST >= p.best).sum())
        assert need <= len(p.sets) <= max(384, 1.5 * need + 1)


def test_lattices_are_held_narrowly_and_in_place():
    """Words keep their own spaces (so ASCII stays ASCII), a reset fills the same arrays anew, and a path knows where its words end."""
    import public_tokenizers

    pieces = segmentation.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["the river, and (the) bank\nof it", "  two  spaces ", "été \0 ▁ x² a_b 語", "word " * 300]
    lattices = segmentation.Lattices(pieces, most_edges=20_000)
    found = segmentation.sample(lattices, texts, [1, 2, 3, 4], 3)
    assert all(w.isascii() for w in pieces.cut_up(texts[0])) and set(pieces.cut_up(texts[0])) <= set(lattices.start)
    for text, (paths, _) in zip(texts, found, strict=True):
        words = pieces.words(text)
        for p in paths:
            assert len(p.words) == len(words) and p.words[-1] == len(p.edges)
            ids = lattices.id[p.edges].tolist()
            begins = [0, *p.words.tolist()]
            assert pieces.decode(ids) == text
            if "\0" not in text and "▁" not in text:
                whole = [pieces.decoded(np.array(ids[a:b]))[0].decode() for a, b in zip(begins, begins[1:])]
                assert whole == [w.replace("▁", " ") for w in words]
    before = [[lattices.id[p.edges].tolist() for p in paths] for paths, _ in found]
    arrays = lattices.logp, lattices.id
    lattices.clear()
    found = segmentation.sample(lattices, texts, [1, 2, 3, 4], 3)
    assert lattices.logp is arrays[0] and lattices.id is arrays[1]
    assert [[lattices.id[p.edges].tolist() for p in paths] for paths, _ in found] == before

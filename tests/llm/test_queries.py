"""Every registered query against a brute-force version, on odd and on empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash

from kinmap.llm.queries import ORACLE_SQL, QUERIES


def rows(spark, name, folder):
    return QUERIES[name](spark, folder).collect()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def counted(found):
    return Counter(tuple(r) for r in found)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert rows(spark, name, empty) == []


def print_of(text):
    w = words(text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_op1(spark, messy):
    folder, docs, _ = messy
    prints = [print_of(d[1]) for d in docs]
    group = list(range(len(docs)))
    for _ in docs:
        for i in range(len(docs)):
            group[i] = min(group[j] for j in range(len(docs)) if (prints[i] ^ prints[j]).bit_count() <= 4)
    least = {g: min((d[0] for d, x in zip(docs, group) if x == g and d[0] is not None), default=None) for g in set(group)}
    want = Counter((d[0], f"{p:016x}", least[g]) for d, p, g in zip(docs, prints, group))
    assert counted(rows(spark, "op1_simhash", folder)) == want


def test_op2(spark, messy):
    from tokenizers import Tokenizer

    folder, docs, _ = messy
    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = sorted(rows(spark, "op2_token_files", folder), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((d[0] for d in docs), key=lambda x: (x is not None, x or 0))
    at, left = 0, Counter()
    for d in docs:
        ids = [*tk.encode(d[1] or "", add_special_tokens=False).ids, 2]
        left[d[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    for r in got:
        assert r.start == at
        at += r.n_tokens
        left[r.doc_id, r.n_tokens, r.ids_crc32] -= 1
    assert not +left


def contaminated(text, benchmark):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    w, hit, items = fold(text), set(), set()
    for item, t in benchmark:
        if item is None:
            continue
        b = fold(t)
        n = min(8, len(b))
        for window in {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else ():
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) == window:
                    hit |= set(range(i, i + n))
                    items.add(str(item))
    return len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), len(items) >= 2


def test_op3(spark, messy):
    folder, docs, benchmark = messy
    want = Counter((d[0], *contaminated(d[1], benchmark)) for d in docs)
    assert counted(rows(spark, "op3_decontaminate", folder)) == want


def fold_of(doc_id, parts):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % parts


@pytest.mark.parametrize("strength", [(400.0,), (400.0, 10.0), (50.0, 10.0, 3.0)])
def test_op4(spark, messy, strength):
    folder, docs, _ = messy
    texts = [[*words(d[1]), ""] for d in docs]
    held = [fold_of(d[0], 5) == 1 for d in docs]
    seen, n_texts = Counter(), 0
    for t, h in zip(texts, held):
        if not h:
            n_texts += 1
            padded = [None] * len(strength) + t
            for i in range(len(strength), len(padded)):
                seen.update(tuple(padded[i - k : i + 1]) for k in range(len(strength) + 1))
    n, v = sum(c for k, c in seen.items() if len(k) == 1), sum(len(k) == 1 for k in seen)
    want = []
    for d, t, h in zip(docs, texts, held):
        base = score = 0.0
        padded = [None] * len(strength) + t
        for i in range(len(strength), len(padded)):
            p = (seen[(padded[i],)] + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(p)
            for k, s in enumerate(strength, 1):
                history = tuple(padded[i - k : i])
                left = n_texts if i == len(strength) else seen[history]
                p = (seen[(*history, padded[i])] + s * p) / (left + s)
            score += math.log10(p)
        want.append((d[0], h, len(t), sum(seen[(x,)] > 0 for x in t), n, base, score))
    if strength == (400.0, 10.0):
        got = rows(spark, "op4_lm_scoring", folder)
    else:
        from pyspark.sql import functions as F

        from kinmap.llm.common import fold, table
        from kinmap.llm.language_model import score as scored

        docs_ = table(spark, folder, "documents").drop("held_out", "score").withColumn("held_out", fold(F.col("doc_id"), 5) == 1)
        got = scored(docs_, ~F.col("held_out"), ("doc_id", "held_out"), strength=strength, bucket_bytes=2000, shard_bytes=200).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:])


@pytest.mark.parametrize(("name", "parts", "held", "at"), [("op5_quality", 3, 1, 0.5), ("op6_toxicity", 4, 2, 0.3)])
def test_classifier_rows(spark, messy, name, parts, held, at):
    folder, docs, _ = messy
    got = rows(spark, name, folder)
    assert Counter(r.doc_id for r in got) == Counter(d[0] for d in docs)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= at) and r.held_out == (fold_of(r.doc_id, parts) == held)
    by_text = {}
    for d in docs:
        by_text.setdefault(d[1] or "", []).append(d[0])
    score = {r.doc_id: r.score for r in got}
    assert all(len({score[i] for i in same}) == 1 for same in by_text.values())


@pytest.mark.parametrize(("name", "least"), [("op5_quality", 0.97), ("op6_toxicity", 0.9)])
def test_classifier_held_out(spark, name, least):
    folder = "/root/testdata/sf0.1"
    label = {"op5_quality": "quality", "op6_toxicity": "toxic"}[name]
    known = dict(duckdb.sql(f"SELECT doc_id, {label} FROM '{folder}/labels.parquet'").fetchall())
    got = [(r.score, known[r.doc_id]) for r in rows(spark, name, folder) if r.held_out and r.doc_id in known]
    good, bad = [s for s, y in got if y], [s for s, y in got if not y]
    wins = sum(np.searchsorted(np.sort(bad), good, "left") + np.searchsorted(np.sort(bad), good, "right")) / 2
    assert wins / (len(good) * len(bad)) > least


def test_op5_rescored(spark, messy):
    """The query's scores, from its fitted weights by a plain count of features."""
    from pyspark.sql import functions as F

    from kinmap.llm import quality
    from kinmap.llm.common import fold, table

    folder, docs, _ = messy
    values, bias = quality.fit(table(spark, folder, "documents"), table(spark, folder, "labels"), "quality", fold(F.col("doc_id"), 3) != 1)
    got = Counter((r.doc_id, round(r.score, 5)) for r in rows(spark, "op5_quality", folder))
    want = Counter()
    for d in docs:
        w = (d[1] or "").encode().split()
        found = Counter({0: 4 * sum(a == b for a, b in zip(w, w[1:]))})
        for x, n in Counter(w).items():
            marked = b"<" + x + b">"
            for f in [zlib.crc32(x, 7)] + [zlib.crc32(marked[i : i + k], k) for k in (2, 3) for i in range(len(marked) - k + 1)]:
                found[1 + f % (quality.BUCKETS - 1)] += n
        z = bias + sum(float(values[f]) * n for f, n in found.items()) / max(1, found.total())
        want[d[0], round(1 / (1 + math.exp(-z)), 5)] += 1
    assert sum((got - want).values()) <= 1  # one may round apart


def test_op6_rescored(spark, messy):
    """The query's scores, from its fitted weights word by word and filter by filter."""
    from pyspark.sql import functions as F

    from kinmap.llm import toxicity
    from kinmap.llm.common import fold, table

    folder, docs, _ = messy
    m = toxicity.fit(table(spark, folder, "documents"), table(spark, folder, "labels"), "toxic", fold(F.col("doc_id"), 4) != 2)
    score = {(r.doc_id, r.score) for r in rows(spark, "op6_toxicity", folder)}
    for d in docs:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(d[1]))
        if len(w) > 5000:
            continue
        vec = [sum(m.vectors[f] for f in toxicity.features(x.encode())) for x in w]
        high, often = [], []
        for width in toxicity.WIDTHS:
            for f in range(toxicity.FILTERS):
                act = []
                for i in range(len(w)):
                    z = 0.0
                    for j in range(width):
                        if i + j < len(w):
                            column = toxicity.SLOTS.index((width, j)) * toxicity.FILTERS + f
                            z += float(vec[i + j] @ m.filters[:, column])
                    act.append(z)
                k = toxicity.WIDTHS.index(width) * toxicity.FILTERS + f
                blocks = [max(act[a : a + toxicity.SPAN]) + m.shift[k] for a in range(0, len(act), toxicity.SPAN)]
                high.append(max(0.0, *blocks) if len(blocks) else 0.0)
                often.append(sum(max(0.0, b) for b in blocks) / len(blocks) if blocks else 0.0)
        z = float(m.bias[0]) + (sum(float(a) * b for a, b in zip(m.out, high + often)) if w else 0.0)
        assert any(i == d[0] and abs(s - 1 / (1 + math.exp(-z))) < 1e-4 for i, s in score), d[0]


def test_op7_enumerated(spark, tmp_path):
    """Short texts through the query: all segmentations are enumerated, and the perturbed best of them, by their own noise, are
    distributed as the query's; a text with fewer than three gives all of them."""
    import sentencepiece
    from tests.llm.conftest import write

    from kinmap.llm import segmentation

    p = segmentation.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    n, text, few = 3000, "an of", "a"
    folder = write(tmp_path, [(i, text) for i in range(n)] + [(n, few), (n + 1, "")])

    def every(word):
        if not word:
            yield (), 1.0
        for j in range(1, len(word) + 1):
            if (e := p.edges.get(word[:j])) is not None:
                for rest, x in every(word[j:]):
                    yield (e[0], *rest), e[1] * x

    def distribution(t):
        found = {(): 1.0}
        for word in p.words(t):
            found = {a + b: x * y for a, x in found.items() for b, y in every(word)}
        total = sum(found.values())
        return {zlib.crc32(np.array(k, "<u4").tobytes()): v / total for k, v in found.items()}

    got = rows(spark, "op7_segmentation", folder)
    true, first = distribution(text), Counter()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i in range(n):
        own = sorted(by_doc[i], key=lambda r: r.sample)
        assert len({r.ids_crc32 for r in own}) == min(3, len(true))
        for r in own:
            assert r.log_prob == pytest.approx(math.log(true[r.ids_crc32]), abs=1e-5)
        first[own[0].ids_crc32] += 1
    for k, v in true.items():
        assert first[k] / n == pytest.approx(v, abs=4 * math.sqrt(v * (1 - v) / n) + 1e-3)
    assert {r.ids_crc32 for r in by_doc[n]} <= set(distribution(few)) and len(by_doc[n]) == min(3, len(distribution(few)))
    assert [r.n_pieces for r in by_doc[n + 1]] == [0]
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert zlib.crc32(np.array(model.encode(text), "<u4").tobytes()) in true


def test_op7(spark, messy):
    folder, docs, _ = messy
    got = rows(spark, "op7_segmentation", folder)
    assert all(r.decoded for r in got)
    samples = {}
    for r in got:
        samples.setdefault(r.doc_id, []).append(r)
    assert set(samples) == {d[0] for d in docs}
    for i, own in samples.items():
        times = sum(d[0] == i for d in docs)
        assert Counter(Counter(r.sample for r in own).values()) == {times: len({r.sample for r in own})}
        own = sorted({(r.sample, r.perturbed, r.log_prob, r.log_inclusion, r.ids_crc32) for r in own})
        assert [x[1] for x in own] == sorted((x[1] for x in own), reverse=True)
        assert len({x[4] for x in own}) == len(own)
        assert all(x[2] <= 1e-9 and x[3] <= 0 for x in own)
    assert len(samples[7]) == len(samples[40]) == 1 and samples[7][0].n_pieces == 0


def test_op7_gives_the_segmentations(spark, messy):
    """Each row has its segmentation: the columns derived from it, and the library's decoder, agree."""
    import sentencepiece

    folder, docs, _ = messy
    texts = {}
    for d in docs:
        texts.setdefault(d[0], d[1] or "")
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = rows(spark, "op7_segmentation", folder)
    assert {r.doc_id for r in got} == set(texts)
    for r in got:
        assert len(r.ids) == r.n_pieces and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        if texts[r.doc_id].strip(" ") == texts[r.doc_id] and "\0" not in texts[r.doc_id]:
            assert model.decode(r.ids) == texts[r.doc_id], r.doc_id


def test_op8(spark, messy):
    folder, docs, _ = messy
    want = Counter()
    for i, t in ((d[0], (d[1] or "").encode()) for d in docs):
        p = t + b"\0" * (64 - len(t) % 64 if len(t) % 64 or not t else 0)
        want[i, len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(p) + 44] += 1
    got = rows(spark, "op8_media", folder)
    assert Counter(tuple(r)[:6] for r in got) == want
    assert all(r.feature.startswith("audio/wav;") for r in got)


def secrets(text):
    t, found = text or "", []
    for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t, re.ASCII | re.IGNORECASE):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, "assign", m.end()))
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    line = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))
    return *(sum(x[2] == k for x in found) for k in ("assign", "access", "hex")), hashlib.sha256(line.encode()).hexdigest(), line


def test_op9(spark, messy):
    folder, docs, _ = messy
    want = Counter((d[0], *secrets(d[1])) for d in docs)
    assert counted(rows(spark, "op9_secret_scan", folder)) == want
    assert sum(k[1] for k in want) >= 4


def test_op10(spark, messy):
    from tokenizers import Tokenizer

    folder, docs, _ = messy
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for d in docs:
        n = len(tk.encode(d[1] or "", add_special_tokens=False).ids)
        want[d[0], len((d[1] or "").encode()), n, n > 1024] += 1
    assert counted(rows(spark, "op10_token_counts", folder)) == want


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    got = QUERIES[name](spark, "/root/testdata/sf0.001").toPandas()
    want = con.execute(ORACLE_SQL[name]).df()[list(got.columns)]
    assert sorted(map(tuple, got.itertuples(index=False))) == sorted(map(tuple, want.itertuples(index=False)))

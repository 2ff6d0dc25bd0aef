"""Whitening, importance resampling and fingerprints against plain definitions, and on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gaugeflow.llm import queries as q
from gaugeflow.llm.fingerprints import fingerprint_documents
from gaugeflow.llm.resampling import crc_of_joined, crc_of_words, resample
from gaugeflow.llm.whitening import Spectrum, rank_one, whiten
from tests.compare import connect, differences

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id bigint, text string, score string, rank int, _home int, _own boolean, _able int, n_words string, next string"
VECTORS = "vec_id bigint, embedding array<float>, x string, component string, part int, blob string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1, 2, None, 3, "w", "n") for i, t in rows], DOCS)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b", 1, None) for i, v in rows], VECTORS)


# --- op11 ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("dim", [1, 2, 7, 40])
def test_rank_one_updates_keep_the_decomposition(dim):
    rng = np.random.default_rng(dim)
    values, axes, whole = np.zeros(dim), np.eye(dim), np.zeros((dim, dim))
    for i in range(120):
        v = rng.normal(size=dim) * 10.0 ** rng.integers(-3, 4)
        if i % 4 == 0:
            v = np.round(v) * (np.arange(dim) % 2)  # parts that can't move, equal eigenvalues
        if i % 9 == 0:
            v = np.zeros(dim)
        values, axes = rank_one(values, axes, v)
        whole += np.outer(v, v)
    assert np.abs(axes @ np.diag(values) @ axes.T - whole).max() <= 1e-11 * np.abs(whole).max()
    assert np.abs(axes.T @ axes - np.eye(dim)).max() < 1e-12 and (np.diff(values) >= 0).all()


def test_spectra_merge_like_one():
    x = np.random.default_rng(3).integers(-40, 40, (90, 6))
    one, two, both = Spectrum(6), Spectrum(6), Spectrum(6)
    one.add(x[:30]), two.add(x[30:]), both.add(x)
    one.merge(Spectrum.loaded(two.saved()))
    one.merge(Spectrum(6))
    assert one.n == 90 and one.sums == both.sums == x.sum(0).tolist()
    assert np.allclose(one.values, both.values) and np.allclose(one.mean, x.mean(0))


def by_definition(rows, k=16):
    """vec_id, deviation, squared whitened values, explained; components of distinct spread."""
    x = np.array([np.floor(64 * np.asarray(v, np.float64)) for _, v in rows])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.astype(np.int64).sum(0) + 1_000_000 * len(fit)
    centred = fit - fit.mean(0)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    white = (x - fit.mean(0)) @ axes / np.sqrt(values)
    total = np.trace(centred.T @ centred / n)
    far = [sum((n * (int(c) + 1_000_000) - int(s)) ** 2 for c, s in zip(r, sums)) for r in x]
    return n, [i for i, _ in rows], far, np.abs(white), values / total


def test_whitening_equals_definition(spark, folder):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    n, ids, far, white, share = by_definition(rows)
    got = q.embedding_whitening(spark, folder).collect()
    assert len(got) == 16 * len(rows)
    place = {i: k for k, i in enumerate(ids)}
    for r in got:
        k, c = place[r.vec_id], r.component - 1
        assert (r.n, r.deviation) == (n, far[k]) and abs(abs(r.whitened) - white[k, c]) < 1e-8
        assert abs(r.explained / share[c] - 1) < 1e-8 and 0 <= r.identity_error < 1e-8


def test_whitening_of_odd_vectors(spark):
    rng = np.random.default_rng(5)
    good = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(30)] + [(100, [0.5, -0.25, 1.0])] * 20 + [(None, [0.5, -0.25, 1.0])]
    bad = [(200, None), (201, [1.0, None, 2.0]), (202, [1.0, float("nan"), 2.0]), (203, [float("inf"), 0.0, 0.0]), (204, [])]
    got = whiten(vectors(spark, good + bad)).collect()
    n, ids, far, white, share = by_definition(good)
    assert n == 31 and Counter(r.vec_id for r in got) == Counter({i: 3 * m for i, m in Counter(ids).items()})
    assert {r.deviation for r in got if r.vec_id == 100} == {far[ids.index(100)]}
    assert whiten(vectors(spark, [])).collect() == [] and whiten(vectors(spark, bad)).collect() == []


def test_whitening_without_spread(spark):
    one = whiten(vectors(spark, [(1, [1.0, 2.0])] * 3)).collect()
    assert [(r.whitened, r.explained, r.deviation, r.identity_error) for r in one] == [(None, 0.0, 0, 0.0)] * 6
    rows = [(i, [float(i), float(2 * i), 5.0]) for i in range(12)] + [(50, [1.0])]  # one direction, and one other length
    got = whiten(vectors(spark, rows)).collect()
    assert {r.component for r in got if r.whitened is not None} == {1} and len(got) == 12 * 3 + 1
    huge = whiten(vectors(spark, [(1, [1e12, 0.0]), (2, [-1e12, 1.0]), (3, [1e30, 0.0])])).collect()
    assert {(r.vec_id, r.deviation) for r in huge} == {(1, None), (2, None)}


# --- op12 ---------------------------------------------------------------------------------------


def test_resampling_equals_sql(spark, folder):
    assert differences(spark, connect(folder), folder, "op12_importance_resampling", q.QUERIES["op12_importance_resampling"], q.OP12_SQL) == []


def test_crc_of_joined_words():
    texts = [b"a", b"word", "übergrößenträger".encode(), b"x" * 300, b"y" * 64, b"z" * 65]
    data = np.frombuffer(b"".join(texts), np.uint8)
    stop = np.cumsum([len(t) for t in texts])
    start = stop - [len(t) for t in texts]
    crc = crc_of_words(data, start, stop)
    assert crc.tolist() == [zlib.crc32(t) for t in texts]
    joined = crc_of_joined(crc[:-1], crc[1:], (stop - start)[1:])
    assert joined.tolist() == [zlib.crc32(a + b) for a, b in zip(texts, texts[1:])]


def drawn_by_definition(docs, target, percent=25, least=20):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        return w, [zlib.crc32(f.encode()) % 10000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    held, aim = [(i, *features(t)) for i, t in docs], Counter()
    own = Counter(f for _, _, fs in held for f in fs)
    for t in target:
        aim.update(features(t)[1])
    many, aims = sum(own.values()), sum(aim.values())
    gain = lambda f: math.floor(1000 * math.log((aim[f] + 1) * (many + 10000) / ((own[f] + 1) * (aims + 10000))))
    rows = []
    for i, w, fs in held:
        weight, score = sum(map(gain, fs)) // len(fs) if fs else 0, None
        if i is not None:
            h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(w), len(fs), weight, score, None])
    able = sorted((r for r in rows if r[1] >= least and r[0] is not None), key=lambda r: (-r[4], r[0]))
    for place, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = place + 1
    return sorted(map(tuple, rows), key=repr)


def test_resampling_of_odd_texts(spark):
    line = "Alpha beta GAMMA delta epsilon"
    texts = ["", "\n \n", "one", "A-b\nc", f"{line}\n" * 30, f"\n\n{line}\r\n{line}\n\n", "ÄÖ ß 日本語 x" * 9, "x" * 500 + " " + "y" * 300, line * 40000]
    rows = list(enumerate(texts * 3)) + [(None, None), (None, line * 9), (77, None), (78, line), (78, line), (78, line)]
    target = [line, "one two", None, ""]
    items = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id bigint, text string")
    got = sorted((tuple(r) for r in resample(documents(spark, rows), items, min_words=3, percent=40).collect()), key=repr)
    assert got == drawn_by_definition(rows, target, 40, 3)


def test_resampling_of_empty_tables(spark):
    none, some = documents(spark, []), documents(spark, [(1, "a b c"), (2, None)])
    assert resample(none, some).collect() == []
    assert [(r.doc_id, r.n_features, r.rank) for r in resample(some, none, min_words=0, percent=100).sort("doc_id").collect()][1][:2] == (2, 0)


# --- op13 ---------------------------------------------------------------------------------------


def bag(text):
    return Counter(re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)))


def jaccard(a, b):
    a, b = bag(a), bag(b)
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


def edited_by_definition(docs):
    """doc_id, code points, edited text, next text; docs in order."""
    out = []
    for k, (i, t) in enumerate(docs):
        t, follows = t or "", docs[(k + 1) % len(docs)][1] or ""
        half = len(t) // 2
        out.append((i, t, t[: len(t) - half] + follows[:half], follows))
    return out


def test_fingerprints_estimate_weighted_likeness(spark, folder):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    got = {r.doc_id: r for r in q.document_fingerprints(spark, folder).collect()}
    assert len(got) == len(docs)
    off_edited, off_next, by_text = [], [], {}
    for i, t, edited, follows in edited_by_definition(docs):
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
        off_edited.append(r.near_edited - jaccard(t, edited))
        off_next.append(r.near_next - jaccard(t, follows))
    for off in (off_edited, off_next):  # 64 slots: a deviation of 0.0625 at most
        assert abs(np.mean(off)) < 0.015 and np.std(off) < 0.08
    assert max(map(abs, off_edited + off_next)) < 0.3


def test_fingerprints_of_odd_texts(spark):
    text = "Größe 🙂 word " * 50
    docs = [(-5, None), (1, ""), (2, " \n"), (3, "ab"), (3, "abc"), (3, "abc"), (9, text), (10, text), (11, text.upper()), (2**62, "w " * 300000)]
    got = fingerprint_documents(documents(spark, docs + [(None, text), (None, None)])).collect()
    expected = [(i, len(t), hashlib.sha256(e.encode()).hexdigest()) for i, t, e, _ in edited_by_definition(docs)]
    expected += [(None, len(text), hashlib.sha256(text[: len(text) - len(text) // 2].encode()).hexdigest()), (None, 0, hashlib.sha256(b"").hexdigest())]
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256) for r in got], key=repr) == sorted(expected, key=repr)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[9].fingerprint == by[10].fingerprint and by[9].near_next == by[9].near_edited == 1.0
    assert by[-5].fingerprint == by[2].fingerprint == "" and by[-5].near_next == by[1].near_next == 1.0 and by[2].near_next == 0.0
    assert len(by[3].fingerprint) == 64 * 8 and by[2**62].near_next == 0.0


def test_fingerprints_across_ranges(spark):
    assert fingerprint_documents(documents(spark, [])).collect() == []
    alone = fingerprint_documents(documents(spark, [(7, "one two three four")])).first()
    assert alone.near_next == 1.0 and alone.n_chars == 18
    docs = [(i * i * 37, f"text {i} of many words {'w' * (i % 7)}") for i in range(400)]
    got = {r.doc_id: r.edited_sha256 for r in fingerprint_documents(documents(spark, docs)).collect()}
    assert got == {i: hashlib.sha256(e.encode()).hexdigest() for i, _, e, _ in edited_by_definition(docs)}


def test_fingerprints_need_no_python(spark, folder):
    plan = q.document_fingerprints(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan

"""Packing, the quality network and the whole pipeline against plain Python."""

import math
import re
import zlib

import numpy as np
import pytest
import tokenizers

import corpus_pipeline
from gaugeflow.llm.packing import pack, vocabulary_path
from gaugeflow.llm.quality import BLOCK, CHUNK_BLOCKS, DIM, FILTERS, STRIDE, Network, fit, score_quality

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = " \t\n\v\f\r"


def plain_score(text, network):
    """Every position of every chunk by itself."""
    p, data = network.p, list((text or "").encode())
    data += [256] * (-len(data) % BLOCK if data else BLOCK)
    blocks, best = len(data) // BLOCK, []
    data += [256] * STRIDE
    for chunk in range(0, max(1, blocks - 1), CHUNK_BLOCKS - 1):
        top = np.zeros(FILTERS)
        for at in range(chunk * BLOCK, min(chunk + CHUNK_BLOCKS, blocks) * BLOCK, STRIDE):
            seen = p["embed"][data[at:at + 2 * STRIDE]].reshape(2 * STRIDE * DIM).astype(float)
            top = np.maximum(top, seen @ p["filters"].astype(float) + p["bias"])
        best.append(top)
    out = p["out"].astype(float)
    return 1 / (1 + math.exp(-(np.mean(best, 0) @ out[:FILTERS] + np.max(best, 0) @ out[FILTERS:] + p["out_bias"][0])))


def plain_pieces(texts, size):
    own = tokenizers.Tokenizer.from_file(str(vocabulary_path()))
    rows = []
    for id_, text in texts:
        ids = own.encode(text or "", add_special_tokens=False).ids + [2]
        first = len(ids) % size or size
        at = [0, *range(first, len(ids) + 1, size)]
        rows += [(id_, k, a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b]))) for k, (a, b) in enumerate(zip(at, at[1:]))]
    return sorted(rows)


def checked_pieces(rows, size):
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= size
    return sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=lambda x: (x[0] is not None, x))


def plain_line_dedup(texts):
    holders = {}
    key = lambda line: line.strip(SPACE).translate(LOWER)
    for id_, text in texts:
        for line in text.split("\n"):
            if len(key(line)) >= 40:
                holders.setdefault(key(line), set()).add(id_)
    lost = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    return [(i, "\n".join(x for x in t.split("\n") if lost.get(key(x), i) == i)) for i, t in texts]


def plain_near_dedup(texts, width=5):
    sets, root = {}, {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER))
        sets[i] = {" ".join(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
        root[i] = i

    def top(i):
        return i if root[i] == i else top(root[i])

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [(i, t) for i, t in texts if top(i) == i]


def plain_decontamination(texts, items, size=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for text in items:
        w = word.findall((text or "").translate(LOWER))
        n = min(size, len(w))
        windows.setdefault(n, set()).update(tuple(w[k:k + n]) for k in range(len(w) - n + 1)) if n else None
    kept = []
    for i, t in texts:
        w = word.findall(t.translate(LOWER))
        if not any(tuple(w[k:k + n]) in found for n, found in windows.items() for k in range(len(w) - n + 1)):
            kept.append((i, t))
    return kept


def test_network_scores_as_defined(spark):
    network = Network(3)
    network.p["bias"] = np.linspace(-0.4, 0.4, FILTERS).astype(np.float32)
    network.p["out_bias"][:] = 0.2
    texts = [None, "", "a", "é" * 31, "x" * 64, "word " * 30, "The end.\n" * 60, "ab" * 448, "abc" * 700]
    rows = score_quality(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), network).collect()
    for r in rows:
        assert r.score == pytest.approx(plain_score(texts[r.doc_id], network), abs=1e-4)
        assert r.predicted == (1 if r.score >= 0.7 else 0)


def test_packed_ids_are_the_tokenizers(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    texts = [tuple(r) for r in docs.collect()]
    odd = [(-1, None), (-2, ""), (-3, "   \r\n\t x"), (-4, "word " * 3000), (-5, "<|endoftext|> </s> <pad>"), (-6, "one"), (-6, "one"), (-7, "12345 it's　don't")]
    table = docs.unionByName(spark.createDataFrame(odd, "doc_id bigint, text string")).withColumns({"piece": docs.doc_id, "length": docs.text})
    rows = pack(table, 1024, 2).collect()
    assert checked_pieces(rows, 1024) == plain_pieces(texts + odd, 1024)
    assert len({r.sequence_id for r in rows}) <= 1.02 * -(-sum(r.length for r in rows) // 1024) + 1


def test_pipeline_by_definition(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    network = fit(docs, spark.read.parquet(f"{folder}/labels.parquet"), "quality")
    texts = sorted((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())
    scores = {i: plain_score(t, network) for i, t in texts}
    assert all(abs(s - 0.5) > 1e-4 for s in scores.values())  # no text so near the threshold that rounding decides
    kept = [x for x in texts if scores[x[0]] >= 0.5]
    near = plain_near_dedup(plain_line_dedup(kept))
    clean = plain_decontamination(near, [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()])
    assert len(texts) > len(kept) > len(near) > len(clean) > 0
    assert checked_pieces(corpus_pipeline.run(spark, folder).collect(), 1024) == plain_pieces(clean, 1024)


def test_pipeline_of_odd_tables(spark, folder, tmp_path):
    import os

    labels = spark.read.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    nulls = docs.limit(2).selectExpr(*[f"cast(null as {t}) as `{c}`" for c, t in docs.dtypes])
    for name, table in (("odd", nulls.unionByName(docs.limit(1)).unionByName(docs.limit(1))), ("none", docs.limit(0))):
        root = f"{tmp_path}/{name}"
        os.makedirs(root)
        table.write.parquet(f"{root}/documents.parquet")
        labels.limit(0).write.parquet(f"{root}/labels.parquet")
        spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{root}/benchmark.parquet")
        rows = corpus_pipeline.run(spark, root).collect()
        checked_pieces(rows, 1024)
        assert name != "none" or rows == []

"""Dealt operators against SQL twins and brute force, and on nulls, empty texts, ties and clashing names."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gaugeflow.llm import queries as q
from gaugeflow.llm.decontamination import find_contamination
from gaugeflow.llm.line_dedup import dedup_lines
from gaugeflow.llm.near_dedup import group_near_duplicates
from gaugeflow.llm.neighbours import nearest
from gaugeflow.llm.packing import pack
from gaugeflow.llm.passages import fuzzy_passages
from gaugeflow.llm.substring_array import remove_repeats
from tests.compare import connect, differences

DOCS = "doc_id bigint, text string, shard string, key string, part int, n int"
PASSAGE = " ".join(f"word{i}" for i in range(80))


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "x", None, 1, None) for i, t in enumerate(texts)], DOCS)


@pytest.mark.parametrize("name, sql", [
    ("op1_line_dedup", q.OP1_SQL), ("op4_minhash_near_dedup", q.OP4_SQL), ("op7_url_filters", q.OP7_SQL), ("op9_benchmark_decontamination", q.OP9_SQL),
])
def test_sql_twins(spark, folder, name, sql):
    import __spark_entry__ as entry

    assert differences(spark, connect(folder), folder, name, entry.queries()[name], sql) == []


def removed_by_definition(texts, length):
    seen, out = set(), []
    for text in texts:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            piece = data[i:i + length]
            if piece in seen:
                gone[i:i + length] = True
            seen.add(piece)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((len(data), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats_match_definition(spark, folder):
    rows = sorted(q.suffix_array_dedup(spark, folder).collect())
    texts = [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").sort("doc_id").collect()]
    assert [tuple(r)[1:] for r in rows] == removed_by_definition(texts, 100)


def test_repeats_in_hard_texts(spark):
    texts = [None, "", "a" * 1000, "ab" * 400, "é" * 150 + PASSAGE, PASSAGE, PASSAGE, "x" + PASSAGE + "y" + PASSAGE]
    rows = {r.doc_id: sum(s.stop - s.start for s in r.spans) for r in remove_repeats(documents(spark, texts), 100).collect()}
    assert [rows[i] for i in range(len(texts))] == [r[1] for r in removed_by_definition(texts, 100)]


def test_packing_holds_every_token_once(spark, folder):
    rows = q.best_fit_packing(spark, folder).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(by_doc) == spark.read.parquet(f"{folder}/documents.parquet").count()
    for pieces in by_doc.values():
        at = 0
        for i, (piece, start, length) in enumerate(sorted(pieces)):
            assert (piece, start) == (i, at) and (length == 1024 or i == 0)
            at += length
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by_sequence) <= 1.05 * -(-sum(r.length for r in rows) // 1024) + 1


def test_neighbours_recall(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    name = [f for f in rows[0].asDict() if isinstance(rows[0][f], list)][0]
    ids, data = np.array([r.vec_id for r in rows]), np.array([r[name] for r in rows], float)
    unit = data / np.linalg.norm(data, axis=1)[:, None]
    found, hits, total = {}, 0, 0
    for r in q.nearest_neighbours(spark, folder).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    for i in np.flatnonzero(ids % 50 == 0):
        near = unit @ unit[i]
        near[i] = -2
        best = set(ids[np.lexsort((ids, -near))[:5]].tolist())
        hits, total = hits + len(best & found[int(ids[i])]), total + len(best)
    assert hits >= 0.9 * total


def test_neighbours_skip_vectors_without_direction(spark, folder):
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    few = table.limit(3).unionByName(table.limit(1).select(*[F.lit(None).cast(t).alias(c) if c != "vec_id" else F.lit(10**6).alias(c) for c, t in table.dtypes]))
    rows = nearest(few, few, k=5).collect()
    assert len(rows) == 6 and all(r.vec_id != 10**6 for r in rows)


def test_fuzzy_passages_find_edited_copy(spark):
    words = PASSAGE.split()
    edited = " ".join(words[:30] + ["new"] + words[30:60] + words[61:])
    rows = fuzzy_passages(documents(spark, [None, "", "other text", "before " + PASSAGE, edited + " after"]), 50, 0.8).collect()
    assert {(r.doc_id, r.source_id) for r in rows} == {(4, 3)}


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.01"  # the smallest table holds too few held-out rows to measure on
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in q.quality_classifier(spark, folder).collect() if r.held_out and labels.get(r.doc_id) is not None]
    good = [r.score for r in rows if labels[r.doc_id] == 1]
    bad = [r.score for r in rows if labels[r.doc_id] != 1]
    auc = np.mean([g > b for g in good for b in bad])
    print("held-out rows", len(rows), "pairs", len(good) * len(bad), "auc", auc)
    assert auc >= 0.8


def test_near_dedup_edges(spark):
    rows = {r.doc_id: r for r in group_near_duplicates(documents(spark, [None, "", "", "Same words here", "same WORDS\there", PASSAGE, PASSAGE + " more"]), 4, 80).collect()}
    assert [rows[i].component_id for i in range(7)] == [0, 1, 2, 3, 3, 5, 5]


def test_line_and_window_edges(spark):
    line = "a line of well over forty characters, held in many documents"
    rows = {r.doc_id: r for r in dedup_lines(documents(spark, [None, ""] + [line] * 6), 40, 5).collect()}
    assert [rows[i].n_dropped for i in range(8)] == [0, 0, 1, 1, 1, 1, 1, 0]
    items = spark.createDataFrame([(1, PASSAGE), (2, None), (3, "")], "item_id bigint, text string")
    found = {r.doc_id: r.n_hit for r in find_contamination(documents(spark, [None, "", "clean", PASSAGE.upper()]), items, 10).collect()}
    assert [found[i] for i in range(4)] == [0, 0, 0, 80]


@pytest.mark.parametrize("work", [lambda d: dedup_lines(d), lambda d: pack(d), lambda d: group_near_duplicates(d), lambda d: fuzzy_passages(d), lambda d: remove_repeats(d)])
def test_empty_table(spark, work):
    assert work(documents(spark, ["x"]).where("doc_id < 0")).count() == 0


def test_pipeline_packs_whole_documents(spark, folder):
    assert len(corpus_pipeline.STAGES) == 5
    rows = corpus_pipeline.run(spark, folder).collect()
    totals = {}
    for r in rows:
        totals[r.sequence_id] = totals.get(r.sequence_id, 0) + r.length
    assert rows and max(totals.values()) <= 1024

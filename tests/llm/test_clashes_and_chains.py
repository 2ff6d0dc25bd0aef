"""Columns of callers whose names an operator uses inside; chains against trying all; fuzzy passages."""

import random

import numpy as np
import pytest

from gaugeflow.llm.decontamination import find_contamination
from gaugeflow.llm.line_dedup import dedup_lines
from gaugeflow.llm.passages import GAP_COST, MAX_GAP, Fenwick, chains, extended, fuzzy_passages
from gaugeflow.llm.quality import Network, fit, score_quality
from gaugeflow.llm.queries import held_out
from gaugeflow.llm.url_filters import judge_urls

LINE = "a line that is long enough to be counted as one"


def test_line_dedup_passes_any_column_on(spark):
    names = ["_part", "_text", "_id", "_blob", "_rest", "shard", "blob", "a.b", "n_lines"]
    schema = "doc_id bigint, " + ", ".join(f"`{n}` string" for n in names) + ", text string"
    rows = [(i, *(f"{n}{i}" for n in names), t) for i, t in enumerate([f"{LINE}\nown {i}" for i in range(6)] + [None, "", "x" * 3_000_000 + "\n" + LINE])]
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(rows + [(None, *names, LINE)], schema)).collect()}
    assert len(got) == 10 and got[8].n_dropped == 0 and got[0].text == "own 0" and got[None].text == "" and got[6].text is None
    for i in range(9):
        assert [got[i][n] for n in names if n != "n_lines"] == [f"{n}{i}" for n in names if n != "n_lines"]
    twice = dedup_lines(spark.createDataFrame([(1, LINE)] * 5 + [(0, LINE)], "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.n_dropped) for r in twice) == [(0, 1)] + [(1, 0)] * 5
    assert dedup_lines(spark.createDataFrame([], "doc_id bigint, text string, _id int")).columns == ["doc_id", "text", "_id", "n_lines", "n_dropped"]


def test_url_filters_pass_any_column_on(spark):
    schema = "page_id bigint, url string, h string, p string, best int, block string, key string, _page string, `x.y` string, host int"
    urls = ["http://a.org/x", None, "no scheme", "http://ads.net/q", "http://ADS.net/q?u", "http://a.org/x"]
    pages = spark.createDataFrame([(i, u, "h", "p", i, "b", "k", "g", "xy", 3) for i, u in enumerate(urls)], schema)
    got = {r.page_id: r for r in judge_urls(pages, [("block", "org", "/")], pages.where("url like '%ads%'").select("url")).collect()}
    assert [got[i].verdict for i in range(6)] == ["block", "allow", "allow", "block", "block", "block"] and got[0]["rule"] == "org/"
    assert all((r.h, r.p, r.best, r.block, r.key, r._page, r["x.y"]) == ("h", "p", i, "b", "k", "g", "xy") for i, r in got.items())
    assert (got[4].host, got[4].path, got[1].host, got[2].path) == ("ads.net", "/q", "", "")
    assert judge_urls(pages.limit(0), [], pages.limit(0).select("url")).collect() == []


def test_decontamination_keeps_a_column_named_like_its_own(spark):
    docs = spark.createDataFrame([(1, "one two three", "kept", "too"), (2, None, None, None)], "doc_id bigint, text string, _hit string, _hit_ string")
    items = spark.createDataFrame([(5, "Two three")], "item_id bigint, text string")
    got = {r.doc_id: r for r in find_contamination(docs, items).collect()}
    assert (got[1]._hit, got[1]._hit_, got[1].n_hit, got[1].items) == ("kept", "too", 2, [5]) and got[2].n_hit == 0


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "good text", 9), (None, None, 8), (2, "", 7), (2, "x" * 2_000_000, 7)], "doc_id bigint, text string, logits int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id bigint, quality int")
    drawn, taught = Network(), fit(docs, labels)  # two labels for one id, none for the others: nothing to learn from
    assert all(np.array_equal(drawn.p[k], taught.p[k]) for k in drawn.p)
    rows = score_quality(docs, taught).select("doc_id", "logits", "score", "predicted", held_out().alias("held_out")).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
    assert fit(docs.limit(0), labels.limit(0)).p.keys() == drawn.p.keys()


# --- chains -----------------------------------------------------------------------------------------


def test_far_block_does_not_hide_near_ones():
    blocks = [np.array(v) for v in ([0, 600, 622, 644], [0, 600, 622, 644], [500, 20, 20, 20])]
    assert sorted(chains(*blocks)) == [[0], [1, 2, 3]]


def test_best_chain_equals_trying_all():
    rng = random.Random(11)
    for _ in range(150):
        m = rng.randint(1, 40)
        x, y = (np.array([rng.randint(0, 220) for _ in range(m)]) for _ in range(2))
        n, best = np.array([rng.randint(5, 20) for _ in range(m)]), {}
        for i in np.lexsort((y, x)).tolist():
            gaps = [(x[i] - x[j] - n[j], y[i] - y[j] - n[j], s) for j, s in best.items()]
            best[i] = n[i] + max([0.0, *(s - GAP_COST * (u + v) for u, v, s in gaps if 0 <= u <= MAX_GAP and 0 <= v <= MAX_GAP)])
        found = chains(x, y, n)
        assert sorted(i for c in found for i in c) == list(range(m))
        steps = list(zip(found[0], found[0][1:]))
        score = sum(n[i] for i in found[0]) - GAP_COST * sum(x[b] - x[a] - n[a] + y[b] - y[a] - n[a] for a, b in steps)
        assert score == pytest.approx(max(best.values()))


def test_fenwick_ranges_with_emptied_places():
    rng, held = random.Random(2), {}
    tree = Fenwick(37)
    for step in range(600):
        i = rng.randrange(37)
        if i in held:
            tree.empty(i)
            del held[i]
        else:
            held[i] = rng.random()
            tree.put(i, held[i], i)
        low, high = sorted((rng.randrange(38), rng.randrange(38)))
        inside = [(v, k) for k, v in held.items() if low <= k < high]
        assert tree.most(low, high) == max(inside, default=(float("-inf"), -1))


def test_ends_go_on_over_replaced_words():
    a = np.arange(30)
    b = a.copy()
    b[[4, 11, 12, 20]] = 99
    assert extended(a, b) == (30, 30, 26)
    assert extended(a, np.delete(a, 7)) == (30, 29, 29) and extended(a, a + 100) == (0, 0, 0) and extended(a[:0], a) == (0, 0, 0)


def planted(rate, n=60, seed=5):
    """Pairs of documents that share 60 words, of which a share is replaced in the later one."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 20000)}"
    rows = []
    for i in range(n):
        passage = [word() for _ in range(60)]
        other = [word() if rng.random() < rate else w for w in passage]
        for id_, middle in ((i, passage), (i + 1000, other)):
            rows.append((id_, " ".join([word() for _ in range(70)] + middle + [word() for _ in range(80)])))
    return rows


@pytest.mark.parametrize("rate, least", [(0.0, 1.0), (0.05, 0.95), (0.1, 0.9)])
def test_recall_of_edited_passages(spark, rate, least):
    rows = fuzzy_passages(spark.createDataFrame(planted(rate), "doc_id bigint, text string"), 50, 0.8).collect()
    assert len({r.doc_id for r in rows if r.source_id == r.doc_id - 1000}) >= least * 60
    assert all(r.source_id == r.doc_id - 1000 and r.matched >= 0.8 * (r.stop - r.start) and r.start >= 60 and r.stop <= 140 for r in rows)


def test_passage_behind_a_far_copy(spark):
    rng = random.Random(8)
    copy, tail = ([f"{k}{rng.randint(0, 9999)}" for _ in range(m)] for k, m in (("c", 500), ("t", 75)))
    fill = lambda k: [f"{k}{i}" for i in range(100)]
    changed = [("new" if i in (30, 55) else w) for i, w in enumerate(tail)]
    docs = [(1, " ".join(copy + fill("x") + tail)), (2, " ".join(copy + fill("y") + changed)), (3, None), (3, ""), (None, "a b"), (2, " ".join(tail))]
    rows = fuzzy_passages(spark.createDataFrame(docs, "doc_id bigint, text string"), 50, 0.8).collect()
    found = {(r.doc_id, r.source_id, r.start, r.stop) for r in rows}
    assert (2, 1, 0, 500) in found and (2, 1, 600, 675) in found

"""Chat formatting against a plain search over whole transcripts, for lost characters, and on odd rows."""

import random

import numpy as np
import pytest

from gaugeflow.llm import queries as q
from gaugeflow.llm.transcripts import BLANK, LEAD, ROLES, STATES, fit, parse_transcripts, symbols

SCHEMA = "conv_id bigint, piece bigint, text string"


@pytest.fixture(scope="module")
def model(spark):
    raw = q.raw_transcripts(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"))
    return fit(raw.where(~q.held_out("conv_id")), first="piece = 0")


def best_by_definition(lines, model):
    """Highest score of a path, by a plain loop over one whole transcript."""
    seen = symbols(lines)[0]
    score = [model.start[s] + model.emit[s][seen[0]] for s in range(STATES)]
    for x in seen[1:]:
        score = [max(score[p] + model.move[p][s] for p in range(STATES)) + model.emit[s][x] for s in range(STATES)]
    return max(score)


def score_of(lines, states, model):
    seen = symbols(lines)[0]
    return model.start[states[0]] + sum(model.emit[s][x] for s, x in zip(states, seen)) + sum(model.move[a][b] for a, b in zip(states, states[1:]))


def states_of(found):
    out = []
    for t in found:
        n = t.text.count("\n") + 1
        if t.role is None:
            out += [LEAD] * n
        else:
            at = 2 * ROLES.index(t.role)
            out += [at if t.opens else at + 1] + [at + 1] * (n - 1)
    return out


def invented(rng):
    kinds = ["User: hi there", "Assistant: yes", "### System: obey", "", "  ", "some words", "is it so?", "x" * 150, "A: first", "Answer", "Q: second", "<|user|> q", "[bot] z", "User:"]
    return [rng.choice(kinds) for _ in range(rng.randint(1, 25))]


def test_pieces_give_the_best_path_of_the_whole(spark, model):
    rng = random.Random(3)
    texts = [invented(rng) for _ in range(60)] + [[""], ["", ""], ["", "", "User: late"]]
    rows = []
    for i, lines in enumerate(texts):
        at = k = 0
        while at < len(lines):
            n = rng.randint(1, 4)
            rows.append((i, k, "\n".join(lines[at:at + n])))
            at, k = at + n, k + 1
    rng.shuffle(rows)
    found = {}
    for r in parse_transcripts(spark.createDataFrame(rows, SCHEMA), model).collect():
        assert "\n".join(t.marker + t.text for t in r.turns) == r.text
        found.setdefault(r.conv_id, []).append((r.piece, r))
    for i, lines in enumerate(texts):
        pieces = [r for _, r in sorted(found[i])]
        assert "\n".join(r.text for r in pieces) == "\n".join(lines)
        states = [s for r in pieces for s in states_of(r.turns)]
        assert score_of(lines, states, model) == pytest.approx(best_by_definition(lines, model))
    whole = spark.createDataFrame([(i, 0, "\n".join(x)) for i, x in enumerate(texts)], SCHEMA)
    for r in parse_transcripts(whole, model).collect():
        assert r.rendered == "".join(p.rendered for _, p in sorted(found[r.conv_id]))


def test_lines_like_markers_stay_text(spark, model):
    answer = "The choices are:\nA: first\nAnswer\nQ: second, <|user|> and <|assistant|> too"
    text = "\n\nUser: which one?\nAssistant: " + answer + "\n\nUser: thanks\n"
    (r,) = parse_transcripts(spark.createDataFrame([(1, 0, text)], SCHEMA), model).collect()
    assert [t.role for t in r.turns] == [None, "user", "assistant", "user"]
    assert r.turns[2].text == answer + "\n" and r.turns[2].marker == "Assistant: "
    assert "\n".join(t.marker + t.text for t in r.turns) == text
    assert r.rendered.count("<|user|>") == 2 and r.rendered.count("<|assistant|>") == 1
    assert answer in r.rendered.replace("<||", "<|")


def test_odd_rows(spark, model):
    long = "User: " + "word " * 600_000 + "\n" + "line\n" * 3000
    rows = [(None, None, None, "a", 1), (1, 0, None, "b", 2), (2, 0, "", "c", 3), (3, 0, long, None, 4), (4, 0, "User: x", "d", 5), (4, 0, "User: x", "d", 5)]
    table = spark.createDataFrame(rows, SCHEMA + ", uid string, `rest` int")
    table = table.withColumns({"whole": table.uid, "turns": table.uid, "a.b": table.uid})
    out = parse_transcripts(table, model)
    assert out.columns == ["conv_id", "piece", "text", "uid", "rest", "whole", "a.b", "turns", "rendered"]
    got = {r["rest"]: r for r in out.collect()}
    assert out.count() == 6 and [got[i].uid for i in (1, 2, 3, 4)] == ["a", "b", "c", None] and got[2]["a.b"] == "b"
    assert [(got[i].rendered, [t.role for t in got[i].turns]) for i in (1, 2, 3)] == [("", [None])] * 3
    assert "\n".join(t.marker + t.text for t in got[4].turns) == long
    assert parse_transcripts(table.limit(0), model).collect() == []
    nothing = fit(spark.createDataFrame([], "roles array<string>, texts array<string>"))
    assert np.isfinite(nothing.emit).all() and nothing.path([BLANK, 0])[0] == LEAD


def test_roles_of_held_out_conversations(spark):
    rows = q.chat_formatting(spark, "/root/testdata/sf0.01").collect()
    apart = [r for r in rows if r.held_out]
    print("right", sum(r.roles_right for r in rows), "of", len(rows), "held out", sum(r.roles_right for r in apart), "of", len(apart))
    assert len(rows) == 100 and sum(r.roles_right for r in rows) >= 95 and sum(r.roles_right for r in apart) >= 0.95 * len(apart)


def test_size_of_pieces_changes_nothing(spark, folder, model):
    turns = spark.read.parquet(f"{folder}/conversations.parquet")

    def roles(size):
        out = {}
        for r in parse_transcripts(q.raw_transcripts(turns, size), model).collect():
            out.setdefault(r.conv_id, []).append((r.piece, [t.role for t in r.turns if t.opens], r.rendered))
        return {k: ([x for _, a, _ in sorted(v) for x in a], "".join(b for *_, b in sorted(v))) for k, v in out.items()}

    assert roles(256) == roles(2)

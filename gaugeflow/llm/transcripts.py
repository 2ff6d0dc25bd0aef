"""Chat formatting: roles of a raw transcript's lines by a hidden Markov model, then canonical turns.

A state is a role and whether the line opens a turn or goes on with it; one more state holds the blank
lines before the first turn. A line is seen as a symbol made of its speaker marker, a blank line before
it, its length and a question mark at its end; blank lines are a symbol of their own. Start, transition
and emission probabilities are counted on transcripts with known roles; the best path through a whole
transcript gives its turns.

A transcript may come in pieces, so that no task has to hold a long one. A piece is first reduced to the
best scores between the states of its first and its last line. These are chained along the transcript,
forwards for the scores and backwards for the best states at the borders, and every piece then finds its
own stretch of the path between its borders: the path of the whole transcript, whatever its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.packed import batch, parts, staged

ROLES = ("system", "user", "assistant")
# How speakers are written. A name opens a turn with a colon, in brackets or after #.
NAMES = ("system|instructions?", "user|human|question", "assistant|ai|bot|answer")
MARKERS = tuple(
    re.compile(rf"\s*(?:(?:#+[ \t]*)?(?:{n})[ \t]*:|\[(?:{n})\]:?|<\|?(?:{n})\|?>:?|#+[ \t]*(?:{n})[ \t]*$)[ \t]*", re.I) for n in NAMES
)
_NONE, LEAD = len(MARKERS), 2 * len(ROLES)
STATES = LEAD + 1
BLANK = (len(MARKERS) + 1) * 8  # the symbol of a blank line
SYMBOLS = BLANK + 1
_AFTER_BLANK = 4
_NEVER = -1e9


def symbols(lines: list[str], after_blank: bool = False) -> tuple[list[int], list[int]]:
    """The symbol of every line and the length of its marker."""
    out, marked = [], []
    for line in lines:
        if not line.strip():
            out.append(BLANK)
            marked.append(0)
            after_blank = True
            continue
        marker, end = _NONE, 0
        for k, pattern in enumerate(MARKERS):
            if m := pattern.match(line):
                marker, end = k, m.end()
                break
        out.append(marker * 8 + _AFTER_BLANK * after_blank + 2 * (len(line) - end > 120) + line.rstrip().endswith("?"))
        marked.append(end)
        after_blank = False
    return out, marked


def after(symbol: int, blank: bool) -> int:
    """The symbol of a line that was looked at without the line before it."""
    return symbol + _AFTER_BLANK if blank and symbol != BLANK else symbol


@dataclass
class Model:
    """Logarithms of probabilities; what can't be has a score that no path makes up for."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @classmethod
    def counted(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
        state, role = np.arange(STATES), np.arange(STATES) // 2
        opens = (state % 2 == 0) & (state != LEAD)
        may_start = opens | (state == LEAD)
        may_move = opens[None] | ((role[:, None] == role[None]) & (state[:, None] != LEAD) & ~opens[None] & (state[None] != LEAD))
        may_move[LEAD, LEAD] = True
        may_emit = np.ones((STATES, SYMBOLS), bool)
        may_emit[opens, BLANK] = False
        may_emit[LEAD, :BLANK] = False

        def logs(n: np.ndarray, may: np.ndarray) -> np.ndarray:
            n = np.where(may, n + 0.1, 0)
            with np.errstate(divide="ignore"):
                return np.where(may, np.log(n / n.sum(-1, keepdims=True)), _NEVER)

        return cls(logs(start, may_start), logs(move, may_move), logs(emit, may_emit))

    def between(self, seen: list[int]) -> np.ndarray:
        """Best score from each state of the first line, that line's emission left out, to each of the last."""
        best = np.where(np.eye(STATES, dtype=bool), 0.0, _NEVER)
        for s in seen[1:]:
            best = (best[:, :, None] + self.move[None]).max(1) + self.emit[:, s]
        return best

    def path(self, seen: list[int], first: int | None = None, last: int | None = None) -> list[int]:
        """The most likely states, between given ones of the first and last line; ties go to the earlier state."""
        score = self.start + self.emit[:, seen[0]]
        if first is not None:
            score = np.where(np.arange(STATES) == first, 0.0, _NEVER)
        back = []
        for s in seen[1:]:
            all_ = score[:, None] + self.move
            back.append(all_.argmax(0))
            score = all_.max(0) + self.emit[:, s]
        out = [int(score.argmax()) if last is None else last]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]


@dataclass
class Turn:
    role: str | None
    opens: bool
    marker: str
    text: str


def turns(lines: list[str], states: list[int], marked: list[int]) -> list[Turn]:
    """Lines of one role as turns. Markers are parted from the text only where a turn opens, so markers
    and texts of all turns, joined by line ends, are the lines again."""
    out: list[tuple[str | None, bool, str, list[str]]] = []
    held = None
    for state, line, end in zip(states, lines, marked):
        opens = state != LEAD and state % 2 == 0
        if opens or held is None or (held == LEAD) != (state == LEAD):
            out.append((None if state == LEAD else ROLES[state // 2], opens, line[:end] if opens else "", [line[end:] if opens else line]))
        else:
            out[-1][3].append(line)
        held = state
    return [Turn(r, o, m, "\n".join(x)) for r, o, m, x in out]


def rendered(found: list[Turn]) -> str:
    """<|role|> and a line end where a turn opens, then its text and a line end; "<|" in texts gets one more
    bar, so that no text reads like a role. Blank lines before the first turn are left out."""
    return "".join((f"<|{t.role}|>\n" if t.opens else "") + t.text.replace("<|", "<||") + "\n" for t in found if t.role)


_COUNTS = pa.schema([("kind", pa.int32()), ("cell", pa.int32()), ("n", pa.int64())])
_SIZES = (STATES, STATES * STATES, STATES * SYMBOLS)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [np.zeros(n, np.int64) for n in _SIZES]
    for rows in batches:
        for first, roles, texts in zip(*(rows.column(c).to_pylist() for c in ("first", "roles", "texts"))):
            states, lines = [], []
            for role, text in zip(roles, texts):
                if role in ROLES:
                    own = (text or "").split("\n")
                    at = 2 * ROLES.index(role)
                    opens = next((i for i, x in enumerate(own) if x.strip()), len(own))
                    before = LEAD if not states else states[-1] if states[-1] == LEAD else states[-1] | 1
                    states += [before] * min(opens, len(own)) + [at] * (opens < len(own)) + [at + 1] * (len(own) - opens - 1)
                    lines += own
            if lines:
                held[0][states[0]] += bool(first)
                np.add.at(held[1], np.array(states[:-1], int) * STATES + np.array(states[1:], int), 1)
                np.add.at(held[2], np.array(states) * SYMBOLS + np.array(symbols(lines)[0]), 1)
    for kind, n in enumerate(held):
        at = np.flatnonzero(n)
        yield batch(_COUNTS, [kind] * len(at), at, n[at])


def fit(transcripts: DataFrame, first: str = "true") -> Model:
    """From rows with `roles` and `texts` (arrays, a turn each, markers included): counts over all of them,
    of which there are a fixed number. `first` is a condition for rows that begin a transcript. Unknown roles
    and null turns teach nothing; without any rows everything possible is as likely."""
    parts(transcripts.sparkSession)
    known = transcripts.select(F.expr(first).alias("first"), "roles", "texts").where("roles is not null and texts is not null")
    found = known.mapInArrow(_counts, "kind int, cell int, n long").groupBy("kind", "cell").agg(F.sum("n").alias("n")).collect()
    held = [np.zeros(n) for n in _SIZES]
    for r in found:
        held[r.kind][r.cell] = r.n
    return Model.counted(held[0], held[1].reshape(STATES, STATES), held[2].reshape(STATES, SYMBOLS))


# --- a path over pieces -----------------------------------------------------------------------------

_PLACE = [("whole", pa.string()), ("piece", pa.int64()), ("uid", pa.int64())]
_INTS, _DOUBLES = pa.list_(pa.int32()), pa.list_(pa.float64())
_SUMMARY = pa.schema(_PLACE + [("symbol", pa.int32()), ("blank", pa.bool_()), ("best", _DOUBLES)])
_REACHED = pa.schema(_PLACE + [("blank", pa.bool_()), ("score", _DOUBLES), ("first", _INTS), ("before", _INTS)])
_BORDERS = pa.schema([("uid", pa.int64()), ("blank", pa.bool_()), ("first", pa.int32()), ("last", pa.int32())])


def _summaries(model: Model):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            seen = [symbols((x or "").split("\n"))[0] for x in rows.column("text").to_pylist()]
            yield batch(_SUMMARY, *(rows.column(c) for c in ("whole", "piece", "uid")), [s[0] for s in seen],
                        [s[-1] == BLANK for s in seen], [model.between(s).ravel().tolist() for s in seen])

    return work


def _forwards(model: Model):
    """Pieces of a transcript in order: the best score that ends in each state, and the way there."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, score, blank = (), None, False
        for rows in batches:
            out = []
            for whole, piece, uid, symbol, ends, best in zip(*(rows.column(c).to_pylist() for c in ("whole", "piece", "uid", "symbol", "blank", "best"))):
                before = np.zeros(STATES, int)
                if held != (whole,):
                    held, blank, enter = (whole,), False, model.start
                else:
                    all_ = score[:, None] + model.move
                    before, enter = all_.argmax(0), all_.max(0)
                all_ = (enter + model.emit[:, after(symbol, blank)])[:, None] + np.array(best).reshape(STATES, STATES)
                score = all_.max(0)
                out.append((whole, piece, uid, blank, score.tolist(), all_.argmax(0).tolist(), before.tolist()))
                score, blank = score - score.max(), ends
            if out:
                yield batch(_REACHED, *zip(*out))

    return work


def _backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of a transcript from its end: the states of their first and last line on the best path."""
    held, last = (), 0
    for rows in batches:
        out = []
        for whole, uid, blank, score, first, before in zip(*(rows.column(c).to_pylist() for c in ("whole", "uid", "blank", "score", "first", "before"))):
            if held != (whole,):
                held, last = (whole,), int(np.argmax(score))
            out.append((uid, blank, first[last], last))
            last = before[first[last]]
        if out:
            yield batch(_BORDERS, *zip(*out))


def parse_transcripts(pieces: DataFrame, model: Model, whole: str = "conv_id", piece: str = "piece", text: str = "text") -> DataFrame:
    """`pieces` with turns (role, opens, marker, text), replaced if there, and rendered, likewise.

    Rows of one `whole` are consecutive whole lines of one transcript, in the order of `piece`, and are
    parsed as one. A turn that goes on from the piece before has opens false; blank lines before the first
    turn have no role. Marker and text of all turns, joined by line ends, are the piece's text. Rendered
    pieces, put together, are the rendered transcript. Null text is one empty line. Rows of null `whole`
    are one transcript; rows with the same place follow each other in any order. A row stands for some 400
    bytes while borders are found, in one task for a transcript, which streams them. Others of the columns are
    passed on whatever their names."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

    spark = pieces.sparkSession
    parts(spark)
    columns = [c for c in pieces.columns if c not in ("turns", "rendered")]
    q = lambda c: F.col("`" + c.replace("`", "``") + "`")
    rows = staged(
        pieces.select(F.monotonically_increasing_id().alias("uid"), q(whole).cast("string").alias("whole"), q(piece).cast("long").alias("piece"),
                      q(text).alias("text"), F.struct(*(q(c).alias(f"c{i}") for i, c in enumerate(columns) if c != text)).alias("rest")),
        "transcripts",
    )
    summaries = rows.select("whole", "piece", "uid", "text").mapInArrow(_summaries(model), from_arrow_schema(_SUMMARY))
    chained = summaries.repartition("whole").sortWithinPartitions("whole", "piece", "uid").mapInArrow(_forwards(model), from_arrow_schema(_REACHED))
    back = chained.repartition("whole").sortWithinPartitions("whole", F.desc("piece"), F.desc("uid"))
    borders = back.mapInArrow(_backwards, from_arrow_schema(_BORDERS)).withColumnRenamed("uid", "of")
    met = rows.join(borders, F.col("uid") == F.col("of")).select("text", "rest", "blank", "first", "last")
    turn = T.ArrayType(T.StructType.fromDDL("role string, opens boolean, marker string, text string"))
    schema = T.StructType([T.StructField("text", T.StringType()), rows.schema["rest"], T.StructField("turns", turn), T.StructField("rendered", T.StringType())])
    arrow = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = []
            for x, blank, first, last in zip(*(rows.column(c).to_pylist() for c in ("text", "blank", "first", "last"))):
                lines = (x or "").split("\n")
                seen, marked = symbols(lines, blank)
                found.append(turns(lines, model.path(seen, first, last), marked))
            held = [rows.column(c).cast(arrow.field(c).type) for c in ("text", "rest")]
            new = [pa.array([[vars(t) for t in x] for x in found], arrow.field("turns").type), pa.array([rendered(x) for x in found], pa.string())]
            yield pa.RecordBatch.from_arrays(held + new, schema=arrow)

    out = met.mapInArrow(work, schema)
    named = [q("text").alias(c) if c == text else F.col(f"rest.c{i}").alias(c) for i, c in enumerate(columns)]
    return out.select(*named, "turns", "rendered")

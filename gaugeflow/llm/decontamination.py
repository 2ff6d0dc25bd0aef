"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

The windows of all items are the queries. A window occurs only where all its shingles do, so one
shingle is a sufficient prefix: the one that the documents hold least often. Documents look up
their shingles among those prefixes; a hit fixes where the window would have to lie (positional
bound), whether it fits into the document (length bound), and every word is compared there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeflow.llm.packed import Rolling, batch, chunks, parts, ranges, shingles, staged, words

SHINGLE = 4  # words; a shorter window is one shingle
BLOCK = 200_000  # different windows that are broadcast at a time, about 30 MB
PASSES = 8  # blocks that one stage holds at a time

_WINDOWS = pa.schema([("window", pa.binary()), ("item_id", pa.int64())])


def _windows_of(size: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, ends in chunks(batches):
            start, stop, first = words(data, ends, alphanumeric=True)
            word = Rolling(data, lower=True).spans(start, stop)
            for id_, a, b in zip(rows.column("item_id").to_pylist(), first[:-1], first[1:]):
                if b > a:
                    length = min(size, b - a)
                    found = sorted({word[i : i + length].tobytes() for i in range(a, b - length + 1)})
                    yield batch(_WINDOWS, found, [id_] * len(found))

    return work


class Index:
    """Windows of one block: their words, their items, and the tokens that documents look up."""

    def __init__(self, windows: list[bytes], items: list[list[int]]):
        self.lengths = np.array([len(w) // 8 for w in windows], np.int64)
        self.words = np.zeros((len(windows), int(self.lengths.max(initial=1))), np.uint64)
        for i, w in enumerate(windows):
            self.words[i, : len(w) // 8] = np.frombuffer(w, np.uint64)
        self.item_ends = np.cumsum([0, *map(len, items)])
        self.items = np.array([x for held in items for x in held], np.int64)
        self.tokens: dict[int, np.ndarray] = {}
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for length in np.unique(self.lengths):
            own, width = np.flatnonzero(self.lengths == length), min(SHINGLE, int(length))
            for at in range(int(length) - width + 1):
                token = _token(self.words[own], at, width)
                held.setdefault(width, []).append((token, own, np.full(len(own), at)))
        self.all = {w: tuple(np.concatenate(x) for x in zip(*v)) for w, v in held.items()}
        self.tokens = {w: np.unique(t) for w, (t, _, _) in self.all.items()}
        self._filter()

    def _filter(self) -> None:
        size = 1 << max(16, int(8 * sum(map(len, self.tokens.values()))).bit_length())
        self.mask = np.uint64(size - 1)
        self.seen = {w: np.zeros(size, bool) for w in self.tokens}
        for w, t in self.tokens.items():
            self.seen[w][(t & self.mask).astype(np.int64)] = True

    def rarest(self, counts: dict[int, np.ndarray]) -> None:
        """Keep of each window the shingle with the smallest count, sorted for look-up."""
        self.prefix = {}
        for width, (token, own, at) in self.all.items():
            often = counts[width][np.searchsorted(self.tokens[width], token)]
            order = np.lexsort((at, token, often, own))
            token, own, at = token[order], own[order], at[order]
            first = np.ones(len(own), bool)
            first[1:] = own[1:] != own[:-1]
            token, own, at = token[first], own[first], at[first]
            order = np.argsort(token, kind="stable")
            self.prefix[width] = token[order], own[order], at[order]
        self.tokens = {w: np.unique(t) for w, (t, _, _) in self.prefix.items()}
        self.all = {}
        self._filter()

    def found(self, width: int, token: np.ndarray) -> np.ndarray:
        """Which shingles are tokens of the index, by place."""
        at = np.flatnonzero(self.seen[width][(token & self.mask).astype(np.int64)])
        known = self.tokens[width]
        place = np.minimum(np.searchsorted(known, token[at]), len(known) - 1)
        return at[known[place] == token[at]]

    def occurrences(self, word: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word and window of every occurrence; `first` has each row's first word."""
        out = []
        for width, (token, own, at) in self.prefix.items():
            of = shingles(word, width)
            here = self.found(width, of)
            low, high = np.searchsorted(token, of[here], "left"), np.searchsorted(token, of[here], "right")
            pick = ranges(low, high - low)
            window, start = own[pick], np.repeat(here, high - low) - at[pick]
            stop = start + self.lengths[window]
            row = np.searchsorted(first, np.repeat(here, high - low), "right") - 1
            fits = (start >= first[row]) & (stop <= first[row + 1])
            window, start = window[fits], start[fits]
            for i in range(self.words.shape[1]):
                if not len(window):
                    break
                inside = i < self.lengths[window]
                same = ~inside | (word[np.where(inside, start + i, start)] == self.words[window, i])
                window, start = window[same], start[same]
            out.append((start, window))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*out))


def _token(word: np.ndarray, at: int, width: int) -> np.ndarray:
    return np.array([shingles(w[at : at + width], width)[0] for w in word], np.uint64) if len(word) else np.zeros(0, np.uint64)


_COUNTS = pa.schema([("width", pa.int32()), ("place", pa.int64()), ("n", pa.int64())])


def _counts_of(index):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = index.value
        counts = {w: np.zeros(len(t), np.int64) for w, t in held.tokens.items()}
        for rows, data, ends in chunks(batches):
            start, stop, _ = words(data, ends, alphanumeric=True)
            word = Rolling(data, lower=True).spans(start, stop)
            for width, n in counts.items():
                token = shingles(word, width)
                n += np.bincount(np.searchsorted(held.tokens[width], token[held.found(width, token)]), minlength=len(n))
        for width, n in counts.items():
            at = np.flatnonzero(n)
            yield batch(_COUNTS, np.full(len(at), width), at, n[at])

    return work


def _hits_of(index, schema: pa.Schema, mark: str):
    """Adds what one block of windows hits to the columns that hold what earlier blocks hit."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, ends in chunks(batches):
            start, stop, first = words(data, ends, alphanumeric=True)
            word = Rolling(data, lower=True).spans(start, stop)
            hit = np.zeros(len(word) + 1, np.int64)
            items: list[list[int]] = [x or [] for x in rows.column("items").to_pylist()]
            if index is not None:
                held = index.value
                at, window = held.occurrences(word, first)
                np.add.at(hit, at, 1)
                np.add.at(hit, at + held.lengths[window], -1)
                row = np.searchsorted(first, at, "right") - 1
                for r, w in np.unique(np.stack([row, window], 1), axis=0) if len(at) else ():
                    items[r] = items[r] + held.items[held.item_ends[w] : held.item_ends[w + 1]].tolist()
            inside = np.cumsum(hit)[:-1] > 0
            bits, before = [], rows.column(mark).to_pylist()
            for old, a, b in zip(before, first[:-1], first[1:]):
                own = np.packbits(inside[a:b])
                bits.append((own | np.frombuffer(old, np.uint8) if old else own).tobytes())
            new = {
                "n_words": np.diff(first), mark: bits, "items": [sorted(set(x)) for x in items],
                "n_hit": [int(np.bitwise_count(np.frombuffer(b, np.uint8)).sum()) for b in bits],
            }
            yield batch(schema, *(new[n] if n in new else rows.column(n).cast(schema.field(n).type) for n in schema.names))

    return work


def find_contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """`docs` with n_words, n_hit, items (the ids of items with an occurring window) and contaminated.

    A window is `size` consecutive words of an item, or all words of an item with fewer; words are
    runs of ASCII letters, digits and non-ASCII characters, A-Z as a-z. Null or empty texts have
    no words, on either side; an item without id hits words but is not listed, items that share
    an id are one. Columns of `docs` with the added names are replaced, others passed on.
    Different windows beyond `BLOCK` are broadcast in blocks, one pass over the documents each.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    parts(spark)
    mark = "_hit"  # the words hit so far, by a name the caller doesn't use
    while mark in docs.columns:
        mark += "_"
    new = ["n_words", "n_hit", "items", "contaminated"]
    columns = [c for c in docs.columns if c not in new]
    texts = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    windows = staged(texts.mapInArrow(_windows_of(size), "window binary, item_id long"), "windows")
    blocks = -(-windows.select("window").distinct().count() // BLOCK)
    added = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.LongType())), T.StructField(mark, T.BinaryType())]
    schema = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in columns] + added)
    arrow = to_arrow_schema(schema)
    rows = docs.select(*columns, *(F.lit(None).cast(f.dataType).alias(f.name) for f in added))
    for i in range(max(1, blocks)):
        index = None
        if blocks:
            own = windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == i)
            held = own.groupBy("window").agg(F.collect_set("item_id").alias("items")).orderBy("window").collect()
            made = Index([bytes(r.window) for r in held], [r["items"] for r in held])
            seen = spark.sparkContext.broadcast(made)
            counts = {w: np.zeros(len(t), np.int64) for w, t in made.tokens.items()}
            found = docs.select("text").mapInArrow(_counts_of(seen), "width int, place long, n long")
            for r in found.groupBy("width", "place").agg(F.sum("n").alias("n")).collect():  # tokens of one block
                counts[r.width][r.place] = r.n
            made.rarest(counts)
            index = spark.sparkContext.broadcast(made)
        rows = rows.mapInArrow(_hits_of(index, arrow, mark), schema)
        if i % PASSES == PASSES - 1:
            rows = staged(rows, "contamination")
    return rows.drop(mark).withColumn("contaminated", F.col("n_hit") > 0)

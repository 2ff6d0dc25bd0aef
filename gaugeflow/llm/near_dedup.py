"""MinHash near-dedup with SuperMinHash signatures.

SuperMinHash gives every element a random permutation of the slots and offers slot number k of
it the value k plus a fraction. A text is finished when all its slots hold values below the
level reached, mostly after two or three levels. Here all texts of a chunk go through the levels
together, which gives the same signatures as one element after the other.

Banding finds candidates. Each bucket first compares its members with its smallest document;
only members that are still in different groups after that are compared with each other. Two
exact bounds, on shingles that a text has alone and on parity bits of its set, hold back pairs
that cannot be alike before any row is made of them; the others are compared by signature and
then on full sets.
Union-find groups the confirmed links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.components import components
from gaugeflow.llm.packed import Rolling, batch, chunks, mix, parts, shingles, staged, words

# A pair of similarity 0.8 misses all bands once in 130,000 times; one of 0.3 meets in one of 240.
BANDS, ROWS = 64, 8
SLOTS = BANDS * ROWS
_FEW = 8  # levels for which no permutation is written out
# Estimates from 512 slots are off by 0.018 (one sigma) at 0.8; 0.1 less loses one link in 50 million.
MARGIN = 0.1
PARITY = 16  # longs of parity bits a set; beyond some 1,200 shingles they fill up and hold back little
FEW_IDS = 500_000  # document ids that are broadcast, 4 MB; more are joined by a shuffle


def shingle_sets(data: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each row and the number of them."""
    start, stop, first = words(data, ends)
    word = Rolling(data, lower=True).spans(start, stop)
    n = np.diff(first)
    every = shingles(word, width)
    row = np.repeat(np.arange(len(n)), n)[: len(every)]
    inside = np.arange(len(every)) + width <= first[row + 1]
    value, row = every[inside], row[inside]
    for size in range(1, width):  # texts with fewer words are one shingle
        few = np.flatnonzero(n == size)
        if len(few):
            whole = np.full(len(few), size, np.uint64)
            for i in range(size):
                whole = mix(whole ^ word[first[few] + i])
            value, row = np.concatenate([value, whole]), np.concatenate([row, few])
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[new], row[new]
    return value, np.bincount(row, minlength=len(n))


def super_minhash(value: np.ndarray, count: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signatures (rows, slots) of the sets whose elements stand one after the other in `value`."""
    out = np.full((len(count), slots), np.inf)
    flat = out.reshape(-1)
    row = np.repeat(np.arange(len(count)), count)
    drawn: list[np.ndarray] = []  # the places that earlier levels swapped with 0, 1, 2, ...
    order: np.ndarray | None = None
    for level in range(slots):
        draw = mix(value + np.uint64((level * 0xA0761D6478BD642F + 1) & 0xFFFFFFFFFFFFFFFF))
        k = level + (((draw & np.uint64(0xFFFFFFFF)) * np.uint64(slots - level)) >> np.uint64(32)).astype(np.int64)
        if level == _FEW:
            order = np.tile(np.arange(slots, dtype=np.uint16), (len(k), 1))
            for i, before in enumerate(drawn):
                _swap(order, before, i)
        if order is None:
            slot = k
            for i in range(level - 1, -1, -1):  # what lies at k: follow the swaps back
                slot = np.where(slot == drawn[i], i, slot)
        else:
            slot = order[np.arange(len(k)), k].astype(np.int64)
        np.minimum.at(flat, row * slots + slot, level + (draw >> np.uint64(32)).astype(np.float64) / 4294967296.0)
        left = np.flatnonzero(((out.max(1) >= level + 1) & (count > 0))[row])
        if not len(left):
            break
        value, row, k = value[left], row[left], k[left]
        if order is None:
            drawn = [*(x[left] for x in drawn), k]
        else:
            order = order[left]
            _swap(order, k, level)
    return out


def _swap(order: np.ndarray, k: np.ndarray, level: int) -> None:
    at = np.arange(len(k))
    held = order[at, k]
    order[at, k] = order[at, level]
    order[at, level] = held


def parity_bits(value: np.ndarray, count: np.ndarray) -> np.ndarray:
    """(rows, PARITY) words; each element flips one bit, so two sets differ in as many elements as bits, or more."""
    out = np.zeros((len(count), PARITY), np.uint64)
    bit = mix(value ^ np.uint64(0x3C)) & np.uint64(64 * PARITY - 1)
    row = np.repeat(np.arange(len(count)), count)
    np.bitwise_xor.at(out.reshape(-1), row * PARITY + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out


_SKETCH = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("sig", pa.binary()), ("parity", pa.list_(pa.int64()))])


def _sketch_of(width: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, ends in chunks(batches, limit=1 << 18):
            value, count = shingle_sets(data, ends, width)
            sig = super_minhash(value, count)
            short = (mix(sig.view(np.uint64)) & np.uint64(0xFFFF)).astype("<u2")
            at = np.concatenate([[0], np.cumsum(count)])
            sums = [np.concatenate([[0], np.cumsum(mix(value ^ np.uint64(s)))]).astype(np.uint64) for s in (0x51, 0xA3)]
            sets = [(s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums]
            yield batch(_SKETCH, rows.column("doc_id"), count, *sets, [x.tobytes() if n else None for x, n in zip(short, count)], list(parity_bits(value, count).view(np.int64)))

    return work


def _elements_of(width: int):
    schema = pa.schema([("doc", pa.int64()), ("element", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, ends in chunks(batches):
            value, count = shingle_sets(data, ends, width)
            yield batch(schema, np.repeat(rows.column("doc_id").to_numpy(), count), value.view(np.int64))

    return work


_KEYS = pa.schema([("key", pa.int64()), ("doc", pa.int64())])


def _band_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        if rows.num_rows:
            sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), "<u2").reshape(-1, BANDS, ROWS)
            key = np.tile(np.arange(BANDS, dtype=np.uint64), (len(sig), 1))
            for i in range(ROWS):
                key = mix(key ^ (sig[:, :, i].astype(np.uint64) << np.uint64(8)))
            yield batch(_KEYS, key.view(np.int64).reshape(-1), np.repeat(rows.column("doc").to_numpy(), BANDS))


def _alike_of(least: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if rows.num_rows:
                x, y = (np.frombuffer(b"".join(rows.column(c).to_pylist()), "<u2").reshape(-1, SLOTS) for c in ("sig_a", "sig_b"))
                fit = pa.array((x == y).mean(1) >= least)
                yield batch(schema, rows.column("a").filter(fit), rows.column("b").filter(fit))

    return work


def _links_of(width: int, percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, ends in chunks(batches, "text_a"):
            held, sizes = shingle_sets(data, ends, width)
            for side, other, to in chunks([rows], "text_b", limit=1 << 62):
                more, n = shingle_sets(other, to, width)
            value = np.concatenate([held, more])
            row = np.concatenate([np.repeat(np.arange(len(n)), sizes), np.repeat(np.arange(len(n)), n)])
            order = np.lexsort((value, row))
            value, row = value[order], row[order]
            both = np.bincount(row[1:][(value[1:] == value[:-1]) & (row[1:] == row[:-1])], minlength=len(n))
            fit = pa.array((both > 0) & (100 * both >= percent * (sizes + n - both)))
            yield batch(schema, rows.column("a").filter(fit), rows.column("b").filter(fit))

    return work


def _texts_of(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """The documents of some ids; few ids go to the documents, many meet them in a shuffle."""
    ids = staged(ids, name)
    return docs.join(F.broadcast(ids) if ids.count() <= FEW_IDS else ids, "doc_id", "left_semi")


def _confirmed(pairs: DataFrame, sigs: DataFrame, docs: DataFrame, width: int, percent: int, name: str) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough. Texts travel only to pairs whose signatures are."""
    met = pairs.join(sigs.select(F.col("doc").alias("b"), F.col("sig").alias("sig_b")), "b").join(sigs.select(F.col("doc").alias("a"), F.col("sig").alias("sig_a")), "a")
    likely = staged(met.select("a", "b", "sig_a", "sig_b").mapInArrow(_alike_of(percent / 100 - MARGIN), "a long, b long"), f"{name}-likely")
    texts = _texts_of(docs, likely.select(F.col("a").alias("doc_id")).unionAll(likely.select(F.col("b").alias("doc_id"))).distinct(), f"{name}-ids")
    own = likely.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    own = own.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return staged(own.select("a", "b", "text_a", "text_b").mapInArrow(_links_of(width, percent), "a long, b long"), f"{name}-links")


def _apart(met: DataFrame, sigs: DataFrame, docs: DataFrame, width: int, percent: int, group: DataFrame) -> DataFrame:
    """Members (key, doc, component, n, most, parity words) of the buckets that hold more than one component.

    A text can share only the s of its n shingles that another of these texts has too. Sets of
    sizes n and m can then be alike to p percent only if p * (n + m) <= (100 + p) * s holds for
    either's s, which bounds m by `most`. If m is the smaller size, its own bound is at least n
    and so at least m: texts with many shingles of their own pair with others only.
    No bound holds for a doc_id with several texts: its n, most and parity are null.
    """
    held = met.where("members > 2").join(group.withColumnRenamed("node", "doc"), "doc", "left")
    held = held.select("key", "doc", F.coalesce("component", "doc").alias("component"))
    mixed = held.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    held = staged(held.join(mixed.select("key"), "key"), "apart")
    ids = held.select(F.col("doc").alias("doc_id")).distinct()
    each = _texts_of(docs, ids, "apart-ids").mapInArrow(_elements_of(width), "doc long, element long")
    shared = each.groupBy("element").agg(F.min("doc").alias("doc"), F.max("doc").alias("other"))
    own = shared.where("doc = other").groupBy("doc").agg(F.count("*").alias("own"))
    sets = sigs.join(ids.withColumnRenamed("doc_id", "doc"), "doc", "left_semi").groupBy("doc")
    sets = sets.agg(*(f("n").alias(f"{c}n") for f, c in ((F.min, ""), (F.max, "hi_"))), *(f("parity").alias(f"{c}parity") for f, c in ((F.min, ""), (F.max, "hi_"))))
    alone = F.expr("n = hi_n and parity = hi_parity")
    sets = sets.select("doc", F.when(alone, F.col("n")).alias("n"), F.when(alone, F.col("parity")).alias("parity")).join(own, "doc", "left")
    most = F.expr(f"floor((100 + {percent}) * (n - coalesce(own, 0)) / {percent}) - n").cast("long")
    sizes = sets.select("doc", "n", most.alias("most"), *(F.col("parity")[i].alias(f"p{i}") for i in range(PARITY)))
    return held.join(sizes, "doc").select("key", "doc", "component", "n", "most", *(f"p{i}" for i in range(PARITY)))


def group_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of `docs`.

    Sets are the distinct shingles of `width` words (runs without ASCII blanks, A-Z as a-z); a
    text with fewer words is one shingle, a text without words is empty and linked with nothing.
    Documents are linked where 100 * intersection >= `percent` * union. component_id is the
    smallest doc_id that links reach, kept says that it is the row's own. A row without doc_id
    has no links, no component_id and is kept; rows that share a doc_id are one document with
    several texts. Other columns are left behind; an empty table gives no rows.
    """
    parts(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = staged(docs.mapInArrow(_sketch_of(width), "doc_id long, n long, s1 long, s2 long, sig binary, parity array<long>"), "sketches")
    same = ["s1", "s2", "n"]
    full = sketch.where("n > 0 and doc_id is not null")
    # One document stands for all with the same set.
    reps = staged(full.groupBy(*same).agg(F.min("doc_id").alias("doc")), "sets")
    # (a doc_id with several texts has several signatures; each counts)
    sigs = full.join(reps, same).where("doc = doc_id").select("doc", "sig", "n", "parity")
    entries = sigs.select("doc", "sig").mapInArrow(_band_keys, "key long, doc long")
    hubs = entries.groupBy("key").agg(F.min("doc").alias("hub"), F.count("*").alias("members")).where("members > 1")
    met = staged(entries.join(hubs, "key"), "buckets")
    star = met.where("doc <> hub").select(F.col("doc").alias("a"), F.col("hub").alias("b")).distinct()
    first = _confirmed(star, sigs, docs, width, percent, "star")
    # A doc_id with several texts belongs to the groups of all of them.
    named = full.select("doc_id", *same).distinct().join(reps, same).select("doc_id", "doc")
    several = named.groupBy("doc_id").agg(F.min("doc").alias("b"), F.max("doc").alias("a")).where("a <> b")
    several = named.join(several.select("doc_id", "b"), "doc_id").where("doc <> b").select(F.col("doc").alias("a"), "b")
    first = first.unionByName(several)
    apart = _apart(met, sigs, docs, width, percent, components(first))
    # Of two documents that can be alike, the smaller is alike enough to itself (see _apart).
    small = apart.where("n is null or n <= most").toDF("key", "b", "cb", "nb", "mb", *(f"q{i}" for i in range(PARITY)))
    apart = apart.toDF("key", "a", "ca", "na", "ma", *(f"p{i}" for i in range(PARITY)))
    # Sets of n and m elements that are alike to p percent differ in (100 - p) / (100 + p) * (n + m) elements at most.
    differ = " + ".join(f"bit_count(p{i} ^ q{i})" for i in range(PARITY))
    fits = f"nb <= na and na <= mb and nb <= ma and {100 + percent} * ({differ}) <= {100 - percent} * (na + nb)"
    cross = apart.join(small, "key").where(f"a <> b and ca <> cb and (na is null or nb is null or ({fits}))")
    cross = cross.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().join(star, ["a", "b"], "left_anti")
    group = components(first.unionByName(_confirmed(cross, sigs, docs, width, percent, "cross")))
    placed = sketch.join(reps.select(*same, "doc"), same, "left").join(group.withColumnRenamed("node", "doc"), "doc", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "doc", "doc_id")).cast("long")
    placed = placed.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return placed.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))

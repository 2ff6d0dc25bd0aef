"""Suffix-array dedup: maximal repeats from common-prefix intervals, all occurrences but the first go.

A suffix array over a whole corpus has no shards, so it is cut by content. Every window of
`length` bytes has a smallest 32-byte string in it (its anchor); equal windows have equal anchors,
so the suffixes that can share `length` bytes meet in the shard of the anchor. Consecutive windows
of one anchor are a phrase. Equal phrases are one leaf, known by a hash, with all its occurrences;
anchors with different phrases send these to a shard, which builds an enhanced suffix array over
their suffixes, scans its common-prefix intervals with a stack and keeps those whose occurrences
differ to the left: the maximal repeats, each with all its occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.packed import Rolling, batch, chunks, deal, group_starts, part_of_ids, parts, ranges, staged

ANCHOR = 32
_FLUSH = 400_000
_MANY = 1000  # different phrases of one anchor; more are split into their windows
_NO_ID = -(1 << 63)
_HELD = np.dtype([("h", "<u8"), ("g", "<u4"), ("g2", "<u2"), ("doc", "<i8"), ("tag", "<u4"), ("pos", "<u4"), ("n", "u1")])
_CUT = np.dtype([("doc", "<i8"), ("tag", "<u4"), ("from", "<u4"), ("to", "<u4")])
_WISH = np.dtype([("h", "<u8"), ("doc", "<i8"), ("tag", "<u4"), ("pos", "<u4"), ("n", "u1"), ("many", "?")])
_TEXT = np.dtype([("key", "<u8"), ("doc", "<i8"), ("tag", "<u4"), ("pos", "<u4"), ("n", "u1")])
_PACKED = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("blob", pa.binary()), ("texts", pa.binary())])
PHRASES, CUTS, WISHES, TEXTS = range(4)


def _columns(entries: np.ndarray) -> bytes:
    """Field after field: like values stand together and compress."""
    return b"".join(np.ascontiguousarray(entries[n]).tobytes() for n in entries.dtype.names)


def _entries(blobs, kind: np.dtype) -> np.ndarray:
    held = []
    for blob in blobs:
        n, at = len(blob) // kind.itemsize, 0
        out = np.empty(n, kind)
        for name in kind.names:
            width = kind[name].itemsize * n
            out[name] = np.frombuffer(blob[at : at + width], kind[name])
            at += width
        held.append(out)
    return np.concatenate(held) if held else np.zeros(0, kind)


def _packed(kind: int, part: np.ndarray, entries: np.ndarray, n: int) -> pa.RecordBatch:
    order = np.lexsort((entries["doc"], part))
    part, entries = part[order], entries[order]
    cuts = np.searchsorted(part, np.arange(n + 1))
    full = np.flatnonzero(np.diff(cuts)).tolist()
    return batch(_PACKED, [kind] * len(full), full, [_columns(entries[cuts[i] : cuts[i + 1]]) for i in full], [None] * len(full))


def phrases(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[Rolling, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and anchor of every phrase."""
    rolling, span = Rolling(data), length - ANCHOR + 1
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return rolling, none, none, none
    bits = np.uint64(len(data).bit_length())
    small = rolling.windows(ANCHOR)
    small = (small >> bits << bits) | np.arange(len(small), dtype=np.uint64)
    have = 1
    while have < span:  # minima of 2, 4, 8, ... and at last of all anchors of a window
        step = min(have, span - have)
        small = np.minimum(small[:-step], small[step:])
        have += step
    at = (small & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    for a, b in zip(np.maximum(ends[:-1], ends[1:] - length + 1), ends[1:]):
        at[a:b] = -1  # windows that would reach into the next text
    cut = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1, [len(at)]])
    own = at[cut[:-1]] >= 0
    return rolling, cut[:-1][own], np.diff(cut)[own], at[cut[:-1]][own]


def _firsts(held: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The first occurrence of each phrase, and cuts for the others."""
    order = np.lexsort((held["pos"], held["tag"], held["doc"], held["g2"], held["g"], held["h"]))
    held = held[order]
    new = np.zeros(len(held), bool)
    new[group_starts(held["h"], held["g"], held["g2"])] = True
    of = np.maximum.accumulate(np.where(new, np.arange(len(held)), 0))
    # (the first place again, from a row that is there twice)
    same = (held["pos"] == held["pos"][of]) & (held["doc"] == held["doc"][of]) & (held["tag"] == held["tag"][of])
    return held[new], _cuts(held[~same], length)


def _cuts(held: np.ndarray, length: int) -> np.ndarray:
    out = np.empty(len(held), _CUT)
    out["doc"], out["tag"], out["from"] = held["doc"], held["tag"], held["pos"]
    out["to"] = held["pos"].astype(np.int64) + held["n"] + length - 1
    return _merged(out)


def _merged(cuts: np.ndarray) -> np.ndarray:
    """Cuts of a document that touch or overlap become one."""
    cuts = cuts[np.lexsort((cuts["from"], cuts["tag"], cuts["doc"]))]
    if not len(cuts):
        return cuts
    doc = np.zeros(len(cuts), np.int64)
    doc[group_starts(cuts["doc"], cuts["tag"])] = 1
    wide = np.int64(1) << 33
    base = np.cumsum(doc) * wide
    far = np.maximum.accumulate(base + cuts["to"].astype(np.int64))
    new = np.ones(len(cuts), bool)
    new[1:] = base[1:] + cuts["from"][1:].astype(np.int64) > far[:-1]
    at = np.flatnonzero(new)
    out = cuts[at]
    out["to"] = np.maximum.reduceat(cuts["to"], at)
    return out


def _tag(text: bytes) -> int:
    return xxhash.xxh32_intdigest(text)


def _ids(rows: pa.RecordBatch, name: str) -> np.ndarray:
    return np.array([_NO_ID if x is None else x for x in rows.column(name).to_pylist()], np.int64)


def _phrases_of(length: int, n: int):
    def flushed(kept: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        first, cuts = _firsts(np.concatenate(kept), length)
        yield _packed(PHRASES, (first["h"] % np.uint64(n)).astype(np.int64), first, n)
        yield _packed(CUTS, part_of_ids(cuts["doc"], n), cuts, n)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, have = [], 0
        for rows, data, ends in chunks(batches):
            rolling, at, count, anchor = phrases(data, ends, length)
            row = np.searchsorted(ends, at, "right") - 1
            held = np.empty(len(at), _HELD)
            held["h"] = rolling.spans(anchor, anchor + ANCHOR)
            g = rolling.spans(at, at + count + length - 1)
            held["g"], held["g2"] = g & np.uint64(0xFFFFFFFF), g >> np.uint64(48)
            tags = np.array([_tag(data[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])], np.uint32)
            held["doc"], held["tag"], held["pos"], held["n"] = _ids(rows, "doc_id")[row], tags[row], at - ends[row], count
            kept.append(held)
            have += len(held)
            if have > _FLUSH:
                yield from flushed(kept)
                kept, have = [], 0
        if have:
            yield from flushed(kept)

    return work


def _compared_of(length: int, n: int):
    """Of each shard: cuts for phrases that are there before, wishes for the texts of anchors with several phrases."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: list[bytes] = []
        for rows in batches:
            passed = np.array(rows.column("kind").to_pylist()) == CUTS
            if passed.any():
                yield rows.filter(pa.array(passed))
            blobs += rows.filter(pa.array(~passed)).column("blob").to_pylist()
        if not blobs:
            return
        first, cuts = _firsts(_entries(blobs, _HELD), length)
        yield _packed(CUTS, part_of_ids(cuts["doc"], n), cuts, n)
        at = group_starts(first["h"])
        many = np.diff(np.append(at, len(first)))
        kinds = np.repeat(many, many)
        wish = np.empty(int((kinds > 1).sum()), _WISH)
        for name in ("h", "doc", "tag", "pos", "n"):
            wish[name] = first[name][kinds > 1]
        wish["many"] = kinds[kinds > 1] > _MANY
        yield _packed(WISHES, part_of_ids(wish["doc"], n), wish, n)

    return work


def _texts_packed(key, wish, starts, sizes, data, n):
    """Phrases by shard: what they are, and their bytes one after the other."""
    held = np.empty(len(key), _TEXT)
    held["key"] = key
    for name in ("doc", "tag", "pos", "n"):
        held[name] = wish[name]
    shard = (key % np.uint64(n)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    held, shard, starts, sizes = held[order], shard[order], starts[order], sizes[order]
    cuts = np.searchsorted(shard, np.arange(n + 1))
    full = np.flatnonzero(np.diff(cuts)).tolist()
    texts = [data[ranges(starts[cuts[i] : cuts[i + 1]], sizes[cuts[i] : cuts[i + 1]])].tobytes() for i in full]
    return batch(_PACKED, [TEXTS] * len(full), full, [_columns(held[cuts[i] : cuts[i + 1]]) for i in full], texts)


def _texts_of(length: int, n: int):
    """Answers wishes from the documents of the part; anchors of many phrases send single windows, each once a chunk."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wishes, blobs = None, []
        for rows in batches:
            told = pa.array([b is not None for b in rows.column("_blob").to_pylist()])
            blobs += rows.filter(told).column("_blob").to_pylist()
            rows = rows.filter(pc.invert(told))
            if not rows.num_rows:
                continue
            if wishes is None:
                wishes = _entries(blobs, _WISH)
                wishes = wishes[np.lexsort((wishes["tag"], wishes["doc"]))]
            for part, data, ends in chunks([rows]):
                ids, at, own = _ids(part, "doc_id"), [], []
                low, high = np.searchsorted(wishes["doc"], ids, "left"), np.searchsorted(wishes["doc"], ids, "right")
                for i in np.flatnonzero(high > low):
                    mine = np.arange(low[i], high[i])
                    mine = mine[wishes["tag"][mine] == _tag(data[ends[i] : ends[i + 1]].tobytes())]
                    own.append(mine)
                    at.append(np.full(len(mine), ends[i]))
                if not own:
                    continue
                wish, start = wishes[np.concatenate(own)], np.concatenate(at)
                start = start + wish["pos"]
                few = ~wish["many"]
                if few.any():
                    yield _texts_packed(wish["h"][few], wish[few], start[few], wish["n"][few].astype(np.int64) + length - 1, data, n)
                if not few.all():
                    wish, start = wish[~few], start[~few]
                    count = wish["n"].astype(np.int64)
                    start = ranges(start, count)
                    pos = ranges(wish["pos"].astype(np.int64), count)
                    wish = np.repeat(wish, count)
                    wish["pos"], wish["n"] = pos, 1
                    key = Rolling(data).spans(start, start + length)
                    order = np.lexsort((wish["pos"], wish["tag"], wish["doc"], key))
                    key, wish, start = key[order], wish[order], start[order]
                    new = np.zeros(len(key), bool)
                    new[group_starts(key)] = True
                    of = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
                    same = (wish["pos"] == wish["pos"][of]) & (wish["doc"] == wish["doc"][of]) & (wish["tag"] == wish["tag"][of])
                    cuts = _cuts(wish[~same], length)
                    yield _packed(CUTS, part_of_ids(cuts["doc"], n), cuts, n)
                    yield _texts_packed(key[new], wish[new], start[new], np.full(int(new.sum()), length), data, n)

    return work


def suffix_array(texts: np.ndarray, starts: np.ndarray, sizes: np.ndarray, count: np.ndarray):
    """Sorted suffixes that begin at the first `count` places of each text, with common prefixes.

    Phrase of each suffix, its offset there, and the bytes it shares with the suffix before."""
    phrase = np.repeat(np.arange(len(starts)), count)
    offset = ranges(np.zeros(len(starts), np.int64), count)
    left = sizes[phrase] - offset
    wide = -(-int(sizes.max(initial=0)) // 8) * 8
    padded = np.concatenate([texts, np.zeros(wide, np.uint8)])
    words = np.empty((wide // 8, len(phrase)), np.uint64)
    for i in range(wide // 8):
        at = (starts[phrase] + offset)[:, None] + 8 * i + np.arange(8)
        block = np.where(8 * i + np.arange(8) < left[:, None], padded[np.minimum(at, len(padded) - 1)], 0).astype(np.uint8)
        words[i] = block.view(">u8").reshape(-1)
    order = np.lexsort(words[::-1])
    words, left = words[:, order], left[order]
    shared = np.zeros(len(order), np.int64)
    if len(order):
        same = np.ones(len(order) - 1, bool)
        for row in words:
            differ = row[1:] ^ row[:-1]
            lead = np.zeros(len(differ), np.int64)
            for bits in (56, 48, 40, 32, 24, 16, 8, 0):
                lead += (differ >> np.uint64(bits)) == 0
            shared[1:] += np.where(same, lead, 0)
            same &= differ == 0
        shared[1:] = np.minimum(shared[1:], np.minimum(left[1:], left[:-1]))
    return phrase[order], offset[order], shared


def maximal_repeats(shared: np.ndarray, before: np.ndarray, length: int) -> Iterator[tuple[int, int, int]]:
    """Common-prefix intervals of at least `length` whose occurrences differ to the left.

    shared: common prefix of each suffix with the one before; before: byte before each suffix, -1
    for a text's first. Yields first suffix, end and common length. One stack scan; an interval
    on the stack is (length, first suffix, the byte before all its suffixes or -1 if they differ).
    """
    stack: list[list[int]] = []
    values, bytes_ = shared.tolist() + [0], before.tolist()
    for i in range(1, len(values)):
        depth = values[i] if values[i] >= length else 0
        first, left = i - 1, bytes_[i - 1]
        while stack and stack[-1][0] > depth:
            d, start, seen = stack.pop()
            seen = seen if seen == left else -1
            if seen == -1:
                yield start, i, d
            first, left = start, seen
        if depth:
            if stack and stack[-1][0] == depth:
                if stack[-1][2] != left:
                    stack[-1][2] = -1
            else:
                stack.append([depth, first, left])


def _repeats_of(length: int, n: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs, texts = [], []
        for rows in batches:
            passed = np.array(rows.column("kind").to_pylist()) == CUTS
            if passed.any():
                yield rows.filter(pa.array(passed))
            rows = rows.filter(pa.array(~passed))
            blobs += rows.column("blob").to_pylist()
            texts += rows.column("texts").to_pylist()
        if not blobs:
            return
        held, data = _entries(blobs, _TEXT), np.frombuffer(b"".join(texts), np.uint8)
        sizes = held["n"].astype(np.int64) + length - 1
        starts = np.cumsum(sizes) - sizes
        order = np.argsort(held["key"], kind="stable")
        held, sizes, starts = held[order], sizes[order], starts[order]
        at = np.append(group_starts(held["key"]), len(held))
        found: list[np.ndarray] = []
        a = 0
        while a < len(at) - 1:  # arrays over whole anchors, of about half a million suffixes
            b = max(a + 1, int(np.searchsorted(np.cumsum(np.add.reduceat(held["n"].astype(np.int64), at[a:-1])), 500_000)) + a)
            b = min(b, len(at) - 1)
            own = slice(at[a], at[b])
            a = b
            part = held[own]
            phrase, offset, shared = suffix_array(data, starts[own], sizes[own], part["n"].astype(np.int64))
            before = np.where(offset > 0, data[np.maximum(starts[own][phrase] + offset - 1, 0)].astype(np.int64), -1)
            doc, tag, pos = part["doc"][phrase], part["tag"][phrase], part["pos"][phrase].astype(np.int64) + offset
            # Suffixes alone between others share too little with both; the scan skips them.
            near = shared >= length
            near[:-1] |= shared[1:] >= length
            keep = np.flatnonzero(near)
            doc, tag, pos = doc[keep], tag[keep], pos[keep]
            for first, end, size in maximal_repeats(shared[keep], before[keep], length):
                where = np.arange(first, end)
                least = np.lexsort((pos[where], tag[where], doc[where]))[0]
                cut = np.empty(end - first, _CUT)
                cut["doc"], cut["tag"], cut["from"], cut["to"] = doc[where], tag[where], pos[where], pos[where] + size
                same = (cut["doc"] == cut["doc"][least]) & (cut["tag"] == cut["tag"][least]) & (cut["from"] == cut["from"][least])
                found.append(cut[~same])
        if found:
            cuts = _merged(np.concatenate(found))
            yield _packed(CUTS, part_of_ids(cuts["doc"], n), cuts, n)

    return work


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.binary())])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cuts, blobs = None, []
    for rows in batches:
        told = pa.array([b is not None for b in rows.column("_blob").to_pylist()])
        blobs += rows.filter(told).column("_blob").to_pylist()
        rows = rows.filter(pc.invert(told))
        if not rows.num_rows:
            continue
        if cuts is None:
            cuts = _merged(_entries(blobs, _CUT))
        for part, data, ends in chunks([rows]):
            ids = _ids(part, "doc_id")
            low, high = np.searchsorted(cuts["doc"], ids, "left"), np.searchsorted(cuts["doc"], ids, "right")
            spans, kept = [], []
            for i, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
                text = data[a:b].tobytes()
                own = cuts[low[i] : high[i]]
                own = own[own["tag"] == _tag(text)] if len(own) else own
                spans.append([{"start": int(x), "stop": int(y)} for x, y in zip(own["from"], own["to"])])
                at = [0, *(p for s in spans[-1] for p in (s["start"], s["stop"])), len(text)]
                kept.append(b"".join(text[x:y] for x, y in zip(at[::2], at[1::2])) if len(own) else text)
            yield batch(_KEPT, part.column("doc_id"), np.diff(ends), spans, kept)


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, n_bytes, spans (start, stop of the removed runs) and kept (the other bytes) of all rows.

    Removed is each byte covered by `length` bytes (33 to 255) that also start earlier: in a
    smaller doc_id or before it in the same text, overlaps included. Null text is empty. A null
    doc_id comes before all others. Rows that share a doc_id are documents of their own, in an
    order given by a hash of their text, unless their texts are equal too: then they are one
    document and keep the same bytes. Other columns are left behind; no rows give no rows.
    """
    n = parts(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    packed = "kind int, part int, blob binary, texts binary"

    def met(messages: DataFrame) -> DataFrame:
        own = texts.select(part_of_sort_id("doc_id", n).alias("_part"), "doc_id", "text", F.lit(None).cast("binary").alias("_blob"))
        told = messages.select(F.col("part").alias("_part"), F.lit(None).cast("long"), F.lit(None).cast("string"), F.col("blob"))
        return deal(own.union(told), n, "_part").sortWithinPartitions("_part", F.col("_blob").isNull()).select("doc_id", "text", "_blob")

    found = deal(texts.mapInArrow(_phrases_of(length, n), packed), n).mapInArrow(_compared_of(length, n), packed)
    found = staged(found, "phrases")
    wished = met(found.where(f"kind = {WISHES}")).mapInArrow(_texts_of(length, n), packed)
    repeats = staged(deal(wished, n).mapInArrow(_repeats_of(length, n), packed), "repeats")
    cuts = found.where(f"kind = {CUTS}").unionByName(repeats.where(f"kind = {CUTS}"))
    return met(cuts).mapInArrow(_kept, "doc_id long, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary")


def part_of_sort_id(column: str, n: int):
    return F.pmod(F.xxhash64(F.coalesce(F.col(column), F.lit(_NO_ID))), F.lit(n)).cast("int")

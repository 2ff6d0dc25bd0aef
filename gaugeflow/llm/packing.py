"""Best-fit packing: token lengths are planned as a histogram, documents take the planned slots.

Documents become pieces of at most `size` tokens. Best-fit decreasing runs over the counts of
the lengths, so the plan has a number of rows that depends on `size` alone. Pieces then get a
rank within their length and take the slot that the plan has for that rank.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.packed import batch, parts, part_of, staged

# Characters on which two builds of a tokenizer may classify letters, digits and blanks alike.
_PLAIN = re.compile("[^\x00-\x7f\xa1-ɏ]")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(1)
def _encoders(path: str):
    """Two encoders over the one vocabulary file: the library's own, and a faster one for plain texts."""
    import json

    import tiktoken
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    own = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    # The byte-level alphabet: printable bytes stand for themselves, the others for 256 and up.
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in printable)}
    ranks = {bytes(byte[c] for c in k): i for k, i in model["model"]["vocab"].items() if k not in special}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    assert set(byte) == set(ByteLevel.alphabet())
    return own, tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special), set(special)


def token_ids(text: str, path: str) -> np.ndarray:
    """The ids of `tokenizers` without added special tokens.

    Texts of ASCII and Latin letters take a faster encoder with the same vocabulary, merges and
    split pattern; all others the library's own."""
    own, plain, special = _encoders(path)
    if _PLAIN.search(text):
        return np.array(own.encode(text, add_special_tokens=False).ids, "<u4")
    return plain.encode_to_numpy(text, allowed_special=special, disallowed_special=()).astype("<u4", copy=False)


_PIECES = pa.schema([(n, pa.int64()) for n in ("doc_id",)] + [("piece", pa.int32())] + [(n, pa.int64()) for n in ("start", "length", "ids_crc32")] + [("ids", pa.list_(pa.int32()))])


def _cut(size: int, end: int, path: str, with_ids: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out: list[tuple] = []
            for id_, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()):
                ids = np.append(token_ids(text or "", path), np.uint32(end)).astype("<u4")
                first = len(ids) % size or size
                at = [0, *range(first, len(ids) + 1, size)]
                for k, (a, b) in enumerate(zip(at, at[1:])):
                    own = ids[a:b]
                    out.append((id_, k, a, b - a, zlib.crc32(own.tobytes()), own.tolist() if with_ids else None))
            if out:
                yield batch(_PIECES, *zip(*out))

    return work


def plan_slots(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over the counts of lengths 1 to size.

    Rows (length, first rank, end rank, first sequence, pieces a sequence, first offset): rank r
    takes sequence `first + (r - from) // each` at offset `first offset + (r - from) % each * length`.
    Each step fills sequences of one kind to the brim or ends the length, so there are at most
    a few rows a length, whatever the counts.
    """
    plan, made = [], 0
    open_: dict[int, list[tuple[int, int]]] = {}  # room left: runs of sequences (first, how many)
    rooms: list[int] = []

    def leave(room: int, first: int, n: int) -> None:
        if room > 0 and n > 0:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, n = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(k)
            else:
                room, first, n = size, made, -(-left // (size // length))
                made += n
            each = room // length
            full = min(n, left // each)
            if full:
                plan.append((length, rank, rank + full * each, first, each, size - room))
                rank, left = rank + full * each, left - full * each
                leave(room - each * length, first, full)
            if full < n and left:  # the last sequence of this length takes what is left
                plan.append((length, rank, rank + left, first + full, left, size - room))
                leave(room - left * length, first + full, 1)
                leave(room, first + full + 1, n - full - 1)
                left = 0
            elif full < n:
                leave(room, first + full, n - full)
    return plan


def pack(docs: DataFrame, size: int = 1024, end: int = 2, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of all `docs` packed into sequences of at most `size` tokens.

    doc_id, piece, start, length, ids_crc32, sequence_id, offset, with `ids` if asked. Every row
    is a document; null text counts as empty, which is the end id alone. Only documents longer
    than `size` are cut; the first piece takes the odd rest. Rows with one doc_id are packed as
    documents of their own, extra columns are left behind, an empty table gives no pieces.
    """
    spark = docs.sparkSession
    n = parts(spark)
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cut = texts.mapInArrow(_cut(size, end, path or vocabulary_path(), with_ids), kinds)
    pieces = staged(cut if with_ids else cut.drop("ids"), "pieces")
    plan = plan_slots({r[0]: r[1] for r in pieces.groupBy("length").count().collect()}, size)  # at most `size` rows
    slots = spark.createDataFrame(plan or [(0,) * 6], "length long, rank_from long, rank_to long, first long, each long, at long")
    # A rank within each length without one task a length: ranks within (length, part), after the parts before.
    marked = pieces.withColumn("_part", part_of("doc_id", n))
    marked = marked.withColumn("_in", F.expr("row_number() over (partition by length, _part order by doc_id, piece, ids_crc32) - 1"))
    sizes = pieces.groupBy("length", part_of("doc_id", n).alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.expr("sum(_n) over (partition by length order by _part) - _n")).drop("_n")
    ranked = marked.join(before, ["length", "_part"]).withColumn("_rank", F.col("_in") + F.col("_before"))
    met = ranked.join(F.broadcast(slots), "length").where("_rank >= rank_from and _rank < rank_to")
    own = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    return met.select(
        *own,
        F.expr("first + (_rank - rank_from) div each").alias("sequence_id"),
        F.expr("at + (_rank - rank_from) % each * length").alias("offset"),
    )

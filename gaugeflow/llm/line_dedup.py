"""Line dedup: lines found in many documents stay only in the last of them.

Line hashes are counted in shards. Each shard keeps a minimal perfect hash over its distinct
hashes, which indexes arrays of fingerprints, counts and largest document ids, and answers the
document partitions that hold a line found often enough. A document partition puts its answers
into such an index again, and its documents probe the arrays; lines are never joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeflow.llm.packed import batch, bundles, deal, part_of, parts, unbundled
from gaugeflow.llm.perfect_hash import Counted

BLANKS = " \t\n\x0b\x0c\r"
_HELD = np.dtype([("a", "<u8"), ("b", "<u8"), ("part", "<i4"), ("n", "<u4"), ("last", "<i8")])
_OFTEN = np.dtype([("a", "<u8"), ("b", "<u8"), ("last", "<i8")])
_NO_ID = -(1 << 63)
_FLUSH = 500_000
_PACKED = pa.schema([("shard", pa.int32()), ("blob", pa.binary())])


def _keys(text: str, min_chars: int) -> tuple[list[str], list[int], bytes]:
    """The lines, which of them are long enough, and the hashes of those."""
    lines = text.split("\n")
    long_, hashes = [], []
    for i, line in enumerate(lines):
        if len(line) >= min_chars:
            key = line.strip(BLANKS)
            if len(key) >= min_chars:
                long_.append(i)
                hashes.append(xxhash.xxh3_128_digest(key.encode().lower()))
    return lines, long_, b"".join(hashes)


def _counted_locally(kept: list[np.ndarray], shards: int) -> pa.RecordBatch:
    """One entry for each line and document partition, however many rows hold it."""
    held = np.concatenate(kept)
    held = held[np.lexsort((held["part"], held["b"], held["a"]))]
    new = np.ones(len(held), bool)
    new[1:] = (held["a"][1:] != held["a"][:-1]) | (held["b"][1:] != held["b"][:-1]) | (held["part"][1:] != held["part"][:-1])
    at = np.flatnonzero(new)
    out = held[at]
    out["n"] = np.add.reduceat(held["n"], at)
    out["last"] = np.maximum.reduceat(held["last"], at)
    return batch(_PACKED, *bundles((out["a"] % np.uint64(shards)).astype(np.int64), out, shards))


def _lines_of(min_chars: int, shards: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, have = [], 0
        for rows in batches:
            for id_, part, text in zip(*(rows.column(c).to_pylist() for c in ("id", "part", "text"))):
                _, long_, hashes = _keys(text or "", min_chars)
                if long_:
                    pairs = np.unique(np.frombuffer(hashes, "<u8").reshape(-1, 2), axis=0) if len(long_) > 1 else np.frombuffer(hashes, "<u8").reshape(-1, 2)
                    entries = np.empty(len(pairs), _HELD)
                    entries["a"], entries["b"], entries["part"], entries["n"] = pairs[:, 0], pairs[:, 1], part, 1
                    entries["last"] = _NO_ID if id_ is None else id_
                    kept.append(entries)
                    have += len(entries)
            if have > _FLUSH:
                yield _counted_locally(kept, shards)
                kept, have = [], 0
        if kept:
            yield _counted_locally(kept, shards)

    return work


def _often(min_docs: int, shards: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = unbundled((x for rows in batches for x in rows.column("blob").to_pylist()), _HELD)
        if not len(held):
            return
        count, last = Counted(held["a"], held["b"], held["n"], held["last"]).probe(held["a"], held["b"])
        found = np.empty(len(held), _OFTEN)
        found["a"], found["b"], found["last"] = held["a"], held["b"], last
        often = count >= min_docs
        yield batch(_PACKED, *bundles(held["part"][often], found[often], shards))

    return work


def _kept(min_chars: int, names: list[str], schema: pa.Schema):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, found, index = None, [], None
        for rows in batches:
            blobs, numbers = rows.column("_blob").to_pylist(), rows.column("_part").to_pylist()
            texts, ids = rows.column("_text").to_pylist(), rows.column("_id").to_pylist()
            mine, out, n_lines, n_dropped = [], [], [], []
            for i, blob in enumerate(blobs):
                if numbers[i] != part:
                    part, found, index = numbers[i], [], None
                if blob is not None:
                    found.append(blob)
                    continue
                if index is None:
                    often = unbundled(found, _OFTEN)
                    often = often[np.unique(often[["a", "b"]], return_index=True)[1]] if len(often) else often
                    index = Counted(often["a"], often["b"], np.ones(len(often), np.int64), often["last"])
                text = texts[i]
                lines, long_, hashes = _keys(text or "", min_chars)
                dropped: set[int] = set()
                if long_:
                    pairs = np.frombuffer(hashes, "<u8").reshape(-1, 2)
                    held, last = index.probe(pairs[:, 0], pairs[:, 1])
                    lost = (held > 0) & (last != (_NO_ID if ids[i] is None else ids[i]))
                    dropped = {long_[j] for j in np.flatnonzero(lost)}
                mine.append(i)
                out.append("\n".join(x for j, x in enumerate(lines) if j not in dropped) if dropped else text)
                n_lines.append(len(lines))
                n_dropped.append(len(dropped))
            if mine:
                whole = rows.column("_rest").take(pa.array(mine))
                new = {"text": out, "n_lines": n_lines, "n_dropped": n_dropped}
                rest = {n: pc.struct_field(whole, [i]) for i, n in enumerate(n for n in names if n not in new)}
                yield batch(schema, *(new[n] if n in new else rest[n].cast(schema.field(n).type) for n in names))

    return work


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """`docs` with `text` cut down to the lines that stay, and n_lines, n_dropped (replaced if there).

    A line's key is the line without ASCII blanks at its ends and with A-Z in lower case. Keys of
    at least `min_chars` code points that at least `min_docs` rows hold lose all their lines but
    those of the largest doc_id holding them. Every row is a document; rows that share that
    doc_id all keep the line. A null doc_id is smaller than all others. Null text is one empty
    line and stays null; other columns are passed on, an empty table gives an empty one.
    """
    spark = docs.sparkSession
    n = parts(spark)
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    docs = docs.drop("n_lines", "n_dropped")
    lines = docs.select(F.col("doc_id").cast("long").alias("id"), part_of("doc_id", n).alias("part"), "text")
    packed = "shard int, blob binary"
    counted = deal(lines.mapInArrow(_lines_of(min_chars, n), packed), n, "shard")
    found = counted.mapInArrow(_often(min_docs, n), packed)
    own = [F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text"), part_of("doc_id", n).alias("_part"), F.lit(None).cast("binary").alias("_blob")]
    rest = F.struct(*[F.col(f"`{c}`") for c in columns if c != "text"])  # in one column, so that no name can clash
    own_rows = docs.select(*own, rest.alias("_rest"))
    told = [F.lit(None).cast("long"), F.lit(None).cast("string"), F.col("shard"), F.col("blob"), F.lit(None).cast(own_rows.schema["_rest"].dataType)]
    both = own_rows.union(found.select(*told))
    names = [*columns, "n_lines", "n_dropped"]
    schema = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in columns] + [T.StructField(c, T.LongType()) for c in names[-2:]])
    from pyspark.sql.pandas.types import to_arrow_schema

    met = deal(both, n, "_part").sortWithinPartitions("_part", F.col("_blob").isNull())
    return met.mapInArrow(_kept(min_chars, names, to_arrow_schema(schema)), schema)

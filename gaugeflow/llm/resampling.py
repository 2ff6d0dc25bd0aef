"""Target-distribution importance resampling by hashed n-grams, counted by distinct lines.

Line feeds part a text into lines, and no word holds one. The n-grams inside a line are counted
once for each distinct line and multiplied by its occurrences; n-grams that span lines are added
from the texts. The hash of an n-gram is put together from the hashes of its words: appending b to
a moves the CRC of a by the length of b, which is a table look-up, and adds the CRC of b.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.llm.packed import batch, chunks, deal, parts, staged, words

BUCKETS = 10_000
_LONGEST = 64  # bytes of a word whose move is looked up at once; longer ones move in several steps
_BLOB = pa.schema([("part", pa.int32()), ("blob", pa.binary())])


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 by byte, and the move of a CRC by 0 to _LONGEST bytes, by byte of the CRC."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1).astype(np.uint32)
    moves = np.empty((_LONGEST + 1, 4, 256), np.uint32)
    for i in range(4):
        moves[0, i] = np.arange(256, dtype=np.uint32) << np.uint32(8 * i)
    for n in range(_LONGEST):
        moves[n + 1] = step[moves[n] & 0xFF] ^ (moves[n] >> 8)
    return step, moves


_STEP, _MOVES = _tables()
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


def crc_of_words(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """CRC-32 of byte ranges of lower-case bytes; all ranges advance a byte at a time."""
    crc = np.full(len(start), 0xFFFFFFFF, np.uint32)
    left = np.arange(len(start))
    at = start.copy()
    while len(left):
        left = left[at[left] < stop[left]]
        own = crc[left]
        crc[left] = _STEP[(own ^ data[at[left]]) & 0xFF] ^ (own >> 8)
        at[left] += 1
    return crc ^ np.uint32(0xFFFFFFFF)


def crc_of_joined(a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of a + b from both CRCs and the bytes of b."""
    left = length.copy()
    while True:
        n = np.minimum(left, _LONGEST)
        a = _MOVES[n, 0, a & 0xFF] ^ _MOVES[n, 1, (a >> 8) & 0xFF] ^ _MOVES[n, 2, (a >> 16) & 0xFF] ^ _MOVES[n, 3, a >> 24]
        left = left - n
        if not left.any():
            return a ^ b


_SPACE = crc_of_words(np.array([32], np.uint8), np.array([0]), np.array([1]))[0]


def _buckets(data: np.ndarray, start: np.ndarray, stop: np.ndarray, firsts: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words at `start`, and of those that follow a word `firsts` together with it."""
    low = _LOW[data]
    crc, length = crc_of_words(low, start, stop), stop - start
    spaced = crc_of_joined(crc[firsts], np.full(len(firsts), _SPACE, np.uint32), np.ones(len(firsts), np.int64))
    pair = crc_of_joined(spaced, crc[firsts + 1], length[firsts + 1])
    return (crc % np.uint32(buckets)).astype(np.int64), (pair % np.uint32(buckets)).astype(np.int64)


def _followed(start: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words that another word of the same row follows."""
    last = np.zeros(len(start), bool)
    last[first[1:][np.diff(first) > 0] - 1] = True
    return np.flatnonzero(~last)


def _line_counts(buckets: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for rows, data, ends in chunks(batches, "line"):
            start, stop, first = words(data, ends, alphanumeric=True)
            times = np.repeat(rows.column("n").to_numpy(), np.diff(first))
            firsts = _followed(start, first)
            one, two = _buckets(data, start, stop, firsts, buckets)
            np.add.at(total, one, times)
            np.add.at(total, two, times[firsts])
        yield batch(_BLOB, [0], [total.tobytes()])

    return work


def _spanning_counts(buckets: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, data, ends in chunks(batches):
            start, stop, first = words(data, ends, alphanumeric=True)
            line = np.searchsorted(np.flatnonzero(data == 10), start)
            firsts = _followed(start, first)
            firsts = firsts[line[firsts] != line[firsts + 1]]
            if len(firsts):  # only the words at line ends are hashed
                both = np.stack([firsts, firsts + 1], 1).ravel()
                two = _buckets(data, start[both], stop[both], np.arange(0, len(both), 2), buckets)[1]
                np.add.at(total, two, 1)
        yield batch(_BLOB, [0], [total.tobytes()])

    return work


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for rows in batches:
        for part, blob in zip(rows.column("part").to_pylist(), rows.column("blob").to_pylist()):
            own = np.frombuffer(blob, np.int64)
            total[part] = total[part] + own if part in total else own
    if total:
        yield batch(_BLOB, list(total), [x.tobytes() for x in total.values()])


def summed(counts: DataFrame) -> np.ndarray | None:
    """Sum of equally long arrays of longs, one from each task, through a middle layer of tasks."""
    n = max(1, math.isqrt(parts(counts.sparkSession)))
    kind = "part int, blob binary"
    middle = deal(counts.select(F.pmod(F.spark_partition_id(), F.lit(n)).alias("part"), "blob"), n).mapInArrow(_added, kind)
    total = sum((np.frombuffer(r.blob, np.int64) for r in middle.select("blob").toLocalIterator()), 0)
    return total if isinstance(total, np.ndarray) else None


def feature_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences of all words and pairs of consecutive words of the column `text`, by bucket."""
    parts(texts.sparkSession)
    texts = texts.select("text").where("text is not null")
    lines = texts.select(F.explode(F.split("text", "\n")).alias("line")).where("line <> ''").groupBy("line").agg(F.count("*").alias("n"))
    kind = "part int, blob binary"
    counts = lines.mapInArrow(_line_counts(buckets), kind).union(texts.mapInArrow(_spanning_counts(buckets), kind))
    total = summed(counts)
    return np.zeros(buckets, np.int64) if total is None else total


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, floored."""
    size, many, wanted = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([
        math.floor(1000 * math.log((float(t + 1) * float(many + size)) / (float(s + 1) * float(wanted + size))))
        for s, t in zip(corpus.tolist(), target.tolist())
    ], np.int64)


_WEIGHED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])


def _weights_of(gain: np.ndarray):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, ends in chunks(batches):
            start, stop, first = words(data, ends, alphanumeric=True)
            firsts = _followed(start, first)
            one, two = _buckets(data, start, stop, firsts, len(gain))
            own = gain[one]
            own[firsts] += gain[two]
            sums = np.append(0, np.cumsum(own))[first]
            many = np.diff(first)
            features = np.maximum(2 * many - 1, 0)
            weight = np.where(features > 0, np.diff(sums) // np.maximum(features, 1), 0)
            yield batch(_WEIGHED, rows.column("doc_id"), many, features, weight)

    return work


def _draw(doc_id: Column, seed: int) -> Column:
    """A Gumbel draw in thousandths, fixed by seed and document."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("bigint")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, seed: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of `docs`.

    Words are runs of ASCII letters and digits and of all other code points from 128 on, A-Z in
    lower case; features are words and pairs of consecutive words, by CRC-32 modulo `buckets`. A
    document's weight is the floored mean of its features' gains towards the texts of `target`
    (0 without features), its score the weight and a Gumbel draw. Of the documents with an id and
    at least `min_words` words, `percent` in a hundred with the highest scores are drawn (ties to
    the smaller doc_id, rows that share one in any order) and ranked from 1; other ranks are null.
    A row without doc_id is counted and weighed, but has no score and is never drawn. Null texts
    have no words; other columns are left behind; empty tables give no rows or no gain.

    Scores are whole thousandths within about +-120,000 of log ratios of counts, so their counts
    are a bounded table: it finds the last score drawn and how many rows are ahead of each score.
    """
    gain = gains(feature_counts(docs, buckets), feature_counts(target, buckets))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    weighed = texts.mapInArrow(_weights_of(gain), "doc_id long, n_words long, n_features long, weight long")
    weighed = weighed.withColumn("score", F.col("weight") + _draw(F.col("doc_id"), seed))
    able = (F.col("n_words") >= min_words) & F.col("score").isNotNull()
    scored = staged(weighed.withColumn("_able", able), "scores")
    held = sorted(((r.score, r.n) for r in scored.where("_able").groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    many = percent * sum(n for _, n in held) // 100
    ahead, places = 0, []
    for score, n in held:
        if ahead < many:
            places.append((score, ahead))
        ahead += n
    before = scored.sparkSession.createDataFrame(places, "score long, _ahead long")
    met = scored.join(F.broadcast(before), "score", "left")
    best = F.col("_able") & F.col("_ahead").isNotNull()
    place = F.col("_ahead") + F.row_number().over(Window.partitionBy("score").orderBy("doc_id"))
    kept = ["doc_id", "n_words", "n_features", "weight", "score"]
    drawn = met.where(best).select(*kept, place.alias("rank")).withColumn("rank", F.when(F.col("rank") <= many, F.col("rank")))
    return drawn.unionByName(met.where(~best).select(*kept, F.lit(None).cast("long").alias("rank")))

"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, filters slide over them, and each of the overlapping chunks that cover the
whole text keeps the largest response of every filter. The mean and the largest of these over
all chunks give one probability. Filters, embedding and weights are learned together from a
bounded sample of labelled rows; scoring is one pass over all texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeflow.llm.packed import batch, chunks, parts, ranges, text_bytes

DIM, FILTERS, STRIDE = 8, 16, 4  # a filter sees 2 * STRIDE bytes
BLOCK = 64  # bytes; a chunk is CHUNK_BLOCKS blocks and shares the last with the next chunk
CHUNK_BLOCKS = 8
SIZE = BLOCK * CHUNK_BLOCKS
_PER_BLOCK = BLOCK // STRIDE


class Network:
    """Weights as numpy arrays; byte 256 is padding."""

    def __init__(self, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.p = {
            "embed": draw.normal(0, 0.5, (257, DIM)).astype(np.float32),
            "filters": draw.normal(0, 0.2, (2 * STRIDE * DIM, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "out": draw.normal(0, 0.2, 2 * FILTERS).astype(np.float32),
            "out_bias": np.zeros(1, np.float32),
        }
        self.p["embed"][256] = 0

    def logits(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of whole texts. Each text is padded to whole blocks, with one more block of padding if empty."""
        size = np.diff(ends)
        blocks = np.maximum(1, -(-size // BLOCK))
        first = np.concatenate([[0], np.cumsum(blocks)])
        padded = np.full(int(first[-1]) * BLOCK + 2 * STRIDE, 256, np.int16)
        padded[ranges(first[:-1] * BLOCK, size)] = data
        rows = self.p["embed"][padded].reshape(-1, STRIDE * DIM)
        half = STRIDE * DIM
        left, right = rows @ self.p["filters"][:half], rows @ self.p["filters"][half:]
        # The last position of a text reaches into the next one; it sees padding instead.
        right = right[1:].copy()
        pad = np.tile(self.p["embed"][256], STRIDE) @ self.p["filters"][half:]
        right[first[1:] * _PER_BLOCK - 1] = pad
        seen = np.maximum(left[:-1] + right + self.p["bias"], 0)
        top = seen[: first[-1] * _PER_BLOCK].reshape(-1, _PER_BLOCK, FILTERS).max(1)
        count = np.maximum(1, -(-(blocks - 1) // (CHUNK_BLOCKS - 1)))  # chunks of a text
        row = np.repeat(np.arange(len(size)), count)
        begin = first[row] + ranges(np.zeros(len(size), np.int64), count) * (CHUNK_BLOCKS - 1)
        end = np.minimum(begin + CHUNK_BLOCKS, first[row + 1])
        pooled = np.zeros((len(begin), FILTERS), np.float32)
        for k in range(CHUNK_BLOCKS):
            inside = begin + k < end
            pooled[inside] = np.maximum(pooled[inside], top[begin[inside] + k])
        at = np.cumsum(count) - count
        mean = np.add.reduceat(pooled.astype(np.float64), at, axis=0) / count[:, None]
        most = np.maximum.reduceat(pooled, at, axis=0)
        return mean @ self.p["out"][:FILTERS].astype(np.float64) + most @ self.p["out"][FILTERS:].astype(np.float64) + float(self.p["out_bias"][0])

    def learn(self, crops: np.ndarray, text: np.ndarray, label: np.ndarray, rounds: int = 24, size: int = 64, rate: float = 0.01, seed: int = 7) -> None:
        """crops: chunks of bytes (n, SIZE); text: which text each comes from, sorted; label: of each text."""
        draw, count = np.random.default_rng(seed), np.bincount(text, minlength=len(label))
        at = np.cumsum(count) - count
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        weight = np.where(label == 1, len(label) / max(1, 2 * (label == 1).sum()), len(label) / max(1, 2 * (label == 0).sum()))
        steps = 0
        total = rounds * -(-len(label) // size)
        for _ in range(rounds):
            order = draw.permutation(len(label))
            for b in range(0, len(order), size):
                pick = order[b : b + size]
                n = count[pick]
                seen = crops[ranges(at[pick], n)]
                # Some texts are shown by a short beginning of each chunk: short texts score alike.
                short = np.repeat(np.where(draw.random(len(pick)) < 0.2, draw.integers(16, SIZE // 2, len(pick)), SIZE), n)
                seen = np.where(np.arange(SIZE)[None] < short[:, None], seen, np.int16(256))
                grads = self._step(seen, n, label[pick], weight[pick])
                steps += 1
                now = rate * (1 - 0.95 * steps / total)
                for k, g in grads.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v2[k] = 0.99 * v2[k] + 0.01 * g * g
                    self.p[k] -= (now * (m[k] / (1 - 0.9**steps)) / (np.sqrt(v2[k] / (1 - 0.99**steps)) + 1e-6)).astype(np.float32)
                self.p["embed"][256] = 0

    def _step(self, crops, n, label, weight):
        half, c = STRIDE * DIM, len(crops)
        wide = np.concatenate([crops, np.full((c, STRIDE), 256, crops.dtype)], 1)
        rows = self.p["embed"][wide].reshape(c, -1, half)
        seen = rows[:, :-1] @ self.p["filters"][:half] + rows[:, 1:] @ self.p["filters"][half:] + self.p["bias"]
        best = seen.argmax(1)  # (c, FILTERS)
        pooled = np.maximum(np.take_along_axis(seen, best[:, None], 1)[:, 0], 0)
        at = np.cumsum(n) - n
        mean, most = np.add.reduceat(pooled, at) / n[:, None], np.maximum.reduceat(pooled, at)
        logit = mean @ self.p["out"][:FILTERS] + most @ self.p["out"][FILTERS:] + self.p["out_bias"][0]
        error = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - label) * weight / len(label)).astype(np.float32)
        grads = {
            "out": np.concatenate([error @ mean, error @ most]) + 1e-4 * self.p["out"],
            "out_bias": np.array([error.sum()], np.float32),
        }
        row = np.repeat(np.arange(len(n)), n)
        back = error[row, None] * self.p["out"][:FILTERS] / n[row, None]
        back += np.where(pooled == most[row], error[row, None] * self.p["out"][FILTERS:], 0)
        back = np.where(pooled > 0, back, 0).astype(np.float32)
        i = np.arange(c)[:, None]
        held = np.concatenate([rows[i, best], rows[i, best + 1]], 2)  # (c, FILTERS, 2 * half)
        grads["filters"] = np.einsum("cf,cfh->hf", back, held)
        grads["bias"] = back.sum(0)
        into = (back[:, :, None] * self.p["filters"].T[None]).reshape(-1, DIM)  # each byte under a filter
        under = wide[i[:, :, None], best[:, :, None] * STRIDE + np.arange(2 * STRIDE)].reshape(-1)
        grads["embed"] = np.stack([np.bincount(under, into[:, d], 257) for d in range(DIM)], 1).astype(np.float32)
        return grads


_CROPS = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("crops", pa.binary()), ("sizes", pa.list_(pa.int32()))])


def _crops_of(each: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            data, ends = text_bytes(rows.column("text"))
            crops, sizes = [], []
            for a, b in zip(ends[:-1], ends[1:]):
                last = max(0, b - a - SIZE)
                at = sorted({int(last * k / max(1, each - 1)) for k in range(each)}) if last else [0]
                cut = [data[a + x : min(b, a + x + SIZE)].tobytes() for x in at]
                crops.append(b"".join(cut))
                sizes.append([len(x) for x in cut])
            yield batch(_CROPS, rows.column("doc_id"), rows.column("label").cast(pa.int32()), crops, sizes)

    return work


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 3000, each: int = 6, rounds: int = 24) -> Network:
    """Learn from at most `max_rows` labelled documents, chosen by a hash of their id, and at most
    `each` evenly spaced chunks of each. Rows without id, label (0 or 1) or text and
    ids with both labels teach nothing.
    Without any row the weights stay as drawn and every score is near one half."""
    parts(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("label")).where("doc_id is not null and label in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_other")).where("label = _other").drop("_other")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    taught = texts.join(F.broadcast(chosen), "doc_id")  # at most max_rows rows
    held = taught.mapInArrow(_crops_of(each), "doc_id long, label int, crops binary, sizes array<int>").orderBy("doc_id").limit(max_rows).collect()
    network = Network()
    if held:
        sizes = [s for r in held for s in r.sizes]
        crops = np.full((len(sizes), SIZE), 256, np.int16)
        crops[np.arange(SIZE)[None] < np.array(sizes)[:, None]] = np.frombuffer(b"".join(bytes(r.crops) for r in held), np.uint8)
        text = np.repeat(np.arange(len(held)), [len(r.sizes) for r in held])
        network.learn(crops, text, np.array([r.label for r in held]), rounds)
    return network


def _scores_of(network, schema: pa.Schema):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, ends in chunks(batches, limit=1 << 18):
            score = 1 / (1 + np.exp(-np.clip(network.value.logits(data, ends), -500, 500)))
            yield batch(schema, *(score if n == "score" else rows.column(n).cast(schema.field(n).type) for n in schema.names))

    return work


def score_quality(docs: DataFrame, network: Network, threshold: float = 0.7) -> DataFrame:
    """`docs` with score (0 to 1) and predicted (1 from `threshold` up), replaced if there.

    Whole texts are scored and nothing but the text counts. Null text is scored as empty text,
    one chunk of padding; every row gets its own score, other columns are passed on."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    parts(spark)
    columns = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in columns] + [T.StructField("score", T.DoubleType())])
    held = spark.sparkContext.broadcast(network)
    scored = docs.select(*columns).mapInArrow(_scores_of(held, to_arrow_schema(schema)), schema)
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))

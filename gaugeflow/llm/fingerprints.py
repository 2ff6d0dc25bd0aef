"""Document fingerprints: consistent weighted sampling of a text's words, in DataFrame functions only.

A text is a bag of words weighted by their counts. For each of a signature's slots every word draws
r and c from Gamma(2, 1) and b from a uniform, all fixed by word and slot; t = floor(ln w / r + b)
is the quantised weight, and the word with the smallest c / exp(r (t - b + 1)) is taken together
with its t. Two texts agree in a slot with the probability of their generalised Jaccard similarity,
the sum of the smaller weights over the sum of the larger ones.

Spark's logarithm is strict and slow, so r and ln c are looked up: a table holds 2^14 pairs of
quantiles of Gamma(2, 1), spread evenly over the square, and a word's hash picks one for a slot.
A word with the same count in a text and in its edited text bids once for both.

Texts cross the network once: ranges of ids are dealt to tasks, and the first row of each range is
also dealt to the range before it, so that every row meets its successor there.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOTS, GROUP = 64, 8
RANGES = 8  # ranges of ids for each task of a shuffle
DRAWS = 14  # bits of a hash that pick a pair of draws
_SHAPE = {"upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", "lower": "abcdefghijklmnopqrstuvwxyz     "}
_FINE = float(1 << 26)


def words(text: Column) -> Column:
    """Runs without ASCII blanks, A-Z in lower case."""
    return F.filter(F.split(F.translate(text, _SHAPE["upper"], _SHAPE["lower"]), " "), lambda w: w != "")


def _quantile(share: Column) -> Column:
    """Of Gamma(2, 1): Newton steps for x - ln(1 + x) = -ln(1 - share)."""
    e = -F.log1p(-share)
    return F.aggregate(F.sequence(F.lit(1), F.lit(40)), e + F.sqrt(2 * e), lambda x, _: x - (x - F.log1p(x) - e) * (1 + x) / x)


def draws(spark: SparkSession) -> Column:
    """An array of r (upper half of a long) and ln c + 16 (lower half), in 2^-26."""
    n = 1 << DRAWS
    mirrored = F.conv(F.reverse(F.lpad(F.bin("id"), DRAWS, "0")), 2, 10).cast("bigint")
    r, c = (_quantile((x + 0.5) / n) for x in (F.col("id"), mirrored))
    pair = F.call_function("shiftleft", F.round(r * _FINE).cast("bigint"), F.lit(32)).bitwiseOR(F.round((F.ln(c) + 16) * _FINE).cast("bigint"))
    held = spark.range(n).select("id", pair.alias("pair")).agg(F.array_sort(F.collect_list(F.struct("id", "pair"))).alias("held"))
    return held.select(F.transform("held", lambda x: x["pair"])).scalar()


def bid(slot: int, word: Column, log_weight: Column, pairs: Column) -> Column:
    """What a word bids for a slot: order in the upper half of a long, word and weight in the lower."""
    salt = int.from_bytes(hashlib.sha256(f"slot {slot}".encode()).digest()[:8], "big") >> 1
    mixed = F.xxhash64(word.bitwiseXOR(F.lit(salt)))
    pair = F.get(pairs, F.shiftrightunsigned(mixed, 64 - DRAWS).cast("int"))
    r, log_c = F.shiftrightunsigned(pair, 32) / F.lit(_FINE), pair.bitwiseAND(F.lit(0xFFFFFFFF)) / F.lit(_FINE) - 16.0
    b = mixed.bitwiseAND(F.lit((1 << 40) - 1)) * F.lit(2.0**-40)
    t = F.floor(log_weight / r + b)
    order = F.floor((log_c - r * (t - b + 1.0) + 256.0) * F.lit(float(1 << 22)))  # within 0 and 2^31
    return F.call_function("shiftleft", order, F.lit(32)).bitwiseOR(word.bitwiseXOR(t).bitwiseAND(F.lit(0xFFFFFFFF)))


OWN, EDITED, BOTH = 0, 1, 2


def counted_words(rows: DataFrame, keys: list[str], text: Column, edited: Column) -> DataFrame:
    """keys, _side, _word (a hash) and _n: the words of two texts with their counts, once for BOTH
    where the counts are equal. A row without words has one row of nulls.

    Hashes are sorted with the side in the lowest bit, so that each run of equal ones is a count
    and the two sides of a word are neighbours; nothing is grouped across rows."""
    own = F.transform(words(text), lambda w: F.xxhash64(w).bitwiseAND(F.lit(-2)))
    other = F.transform(words(edited), lambda w: F.xxhash64(w).bitwiseOR(F.lit(1)))
    rows = rows.select(*keys, F.sort_array(F.concat(own, other)).alias("_all"))
    last = F.transform("_all", lambda x, i: F.when(~x.eqNullSafe(F.get("_all", i + 1)), i))
    rows = rows.select(*keys, "_all", F.array_compact(last).alias("_last"))
    rows = rows.select(*keys, "_all", "_last", F.posexplode_outer("_last").alias("_j", "_e"))
    before, after = F.coalesce(F.get("_last", F.col("_j") - 1), F.lit(-1)), F.get("_last", F.col("_j") + 1)
    mark, n = F.get("_all", F.col("_e")), F.col("_e") - before
    word, edited_side = mark.bitwiseAND(F.lit(-2)), mark.bitwiseAND(F.lit(1)) == 1
    twin_after = (F.get("_all", F.col("_e") + 1) == mark.bitwiseOR(F.lit(1))) & (after - F.col("_e") == n)
    twin_before = (F.get("_all", before) == word) & (before - F.coalesce(F.get("_last", F.col("_j") - 2), F.lit(-1)) == n)
    both = F.when(edited_side, F.coalesce(twin_before, F.lit(False))).otherwise(F.coalesce(twin_after, F.lit(False)))
    side = F.when(both, BOTH).when(edited_side, EDITED).otherwise(OWN)
    return rows.where(F.col("_e").isNull() | ~(both & edited_side)).select(
        *keys, F.when(F.col("_e").isNotNull(), side).alias("_side"), word.alias("_word"), n.alias("_n"))


def signatures(rows: DataFrame, keys: list[str], text: Column, edited: Column, slots: int = SLOTS) -> DataFrame:
    """`keys`, `signature` and `edited_signature` of each row: 32 bits for each slot, nulls for a text without words.

    `slots` is a multiple of 8: a word has a row for each group of 8 slots, which keeps the compiled
    code small. The keys must tell rows apart; rows already dealt by one of them are not dealt again."""
    pairs = draws(rows.sparkSession)
    weighed = counted_words(rows, keys, text, edited).select(*keys, "_side", "_word", F.ln("_n").alias("_weight"))
    spread = weighed.select("*", F.explode(F.sequence(F.lit(0), F.lit(slots // GROUP - 1))).alias("_group"))
    spread = spread.select(*keys, "_side", "_group", F.xxhash64("_word", "_group").alias("_word"), "_weight")
    bids = [F.min(bid(k, F.col("_word"), F.col("_weight"), pairs)).alias(f"_{k}") for k in range(GROUP)]
    best = spread.groupBy(*keys, "_side", "_group").agg(*bids)
    best = best.select(*keys, F.struct("_group", "_side", F.array(*[F.col(f"_{k}") for k in range(GROUP)]).alias("b")).alias("_best"))
    held = best.groupBy(*keys).agg(F.array_sort(F.collect_list("_best")).alias("_held"))
    none = F.array(*[F.lit(None).cast("bigint")] * slots)

    def of(side: int) -> Column:
        mine = F.flatten(F.transform(F.filter("_held", lambda x: x["_side"] == side), lambda x: x["b"]))
        return F.when(F.size(mine) == slots, mine).otherwise(none)

    def taken(side: int) -> Column:
        least = F.zip_with(of(side), of(BOTH), lambda a, b: F.least(a, b))
        return F.transform(least, lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)))

    return held.select(*keys, taken(OWN).alias("signature"), taken(EDITED).alias("edited_signature"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal slots; texts without words are wholly like each other and unlike all others."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda x: x))
    return same.cast("double") / F.size(a)


def hexed(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def _borders(docs: DataFrame, n: int) -> list[int]:
    """First ids of at most n + 1 ranges with about as many rows each."""
    shares = [i / n for i in range(1, n)] or [0.5]
    first, cuts = docs.agg(F.min("doc_id"), F.percentile_approx("doc_id", shares, 10 * n)).first()
    return [] if first is None else sorted({first, *cuts})


def _range_of(id_: Column, borders: Column, n: int) -> Column:
    """Borders up to an id less one, by binary search."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(n.bit_length()))])
    at = F.aggregate(steps, F.lit(0), lambda a, s: F.when((a + s <= n) & (F.get(borders, a + s - 1) <= id_), a + s).otherwise(a))
    return at - 1


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next (the following row's text) and _home, _row, _own; also a copy of the
    first row of each range, with _own false, behind the last row of the range before it."""
    n = RANGES * max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    borders = _borders(rows, n)
    known = F.split(F.lit(",".join(map(str, borders)) or "0"), ",").cast("array<bigint>")
    home = _range_of(F.col("doc_id"), known, max(1, len(borders)))
    apart = len(borders) + F.pmod(F.xxhash64("text"), F.lit(n)).cast("int")
    rows = rows.withColumn("_home", F.when(F.col("doc_id").isNull(), apart).otherwise(home))
    before = F.pmod(F.col("_home") - 1, F.lit(max(1, len(borders))))
    leads = F.coalesce(F.get(known, F.col("_home")) == F.col("doc_id"), F.lit(False))
    places = F.when(leads, F.array(F.struct(F.col("_home").alias("h"), F.lit(True).alias("o")), F.struct(before.alias("h"), F.lit(False).alias("o"))))
    places = places.otherwise(F.array(F.struct(F.col("_home").alias("h"), F.lit(True).alias("o"))))
    dealt = rows.select("doc_id", "text", F.explode(places).alias("_at")).select("doc_id", "text", F.col("_at.h").alias("_home"), F.col("_at.o").alias("_own"))
    order = Window.partitionBy("_home").orderBy(F.desc("_own"), "doc_id", "text")
    follows = F.when(F.col("doc_id").isNotNull(), F.lead("text").over(order))
    return dealt.select("doc_id", "text", "_home", "_own", F.row_number().over(order).alias("_row"), F.coalesce(follows, F.lit("")).alias("next"))


def fingerprint_documents(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    The edited text has the last half of its code points (rounded down) replaced by as many of the
    next document's first ones, or all it has. Documents follow each other by doc_id, rows that
    share one by text, and the first follows the last. A row without doc_id has no place in that
    order: its next document is empty. Null text is empty; a text without words has an empty
    fingerprint, wholly like other empty ones. Every row is kept; other columns are left behind; no
    rows give no rows. Borders between tasks are RANGES x spark.sql.shuffle.partitions ids.
    """
    rows = with_next(docs)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next"), F.lit(1), half))
    keys = ["_home", "_row"]
    signed = signatures(rows, keys, F.col("text"), F.when(F.col("_own"), edited).otherwise(""), slots)
    order = Window.partitionBy("_home").orderBy("_row")
    met = signed.select(*keys, "signature", "edited_signature", F.lead("signature").over(order).alias("_next"))
    facts = rows.where("_own").select("doc_id", *keys, F.length("text").cast("long").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"))
    none = F.array(*[F.lit(None).cast("bigint")] * slots)
    following = F.when(F.col("doc_id").isNotNull(), F.col("_next")).otherwise(none)
    return facts.join(met, keys).select(
        "doc_id", "n_chars", "edited_sha256", hexed(F.col("signature")).alias("fingerprint"), hexed(F.col("edited_signature")).alias("edited_fingerprint"),
        likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"), likeness(F.col("signature"), following).alias("near_next"),
    )

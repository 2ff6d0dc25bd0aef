"""URL filters: a blocked Bloom filter before an exact hash join, in DataFrame functions only.

Rules and listed canonical URLs are keys of one list. The filter is a table of blocks of four
64-bit words; a key sets one bit in each word of one block. Every URL asks for the keys that could
decide about it, the filter passes possible hits, and the join with the list removes false ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKS = 1 << 16  # 2 MB of filter at most, whatever the list holds: this bounds the broadcast
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(_rest(url), F.lit("")), "^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), "^[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Without scheme, www. or m., query, fragment, .html and a slash at the end."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"(/|\.html)$", ""))


def _bits(key: Column) -> list[Column]:
    h = F.xxhash64(key, F.lit(1))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(h, 6 * i), F.lit(64)).cast("int")) for i in range(4)]


def _block(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BLOCKS)).cast("int")


def bloom_filter(keys: DataFrame) -> DataFrame:
    """block, w0, w1, w2, w3 of the column `key`."""
    marked = keys.select(_block(F.col("key")).alias("block"), *(b.alias(f"w{i}") for i, b in enumerate(_bits(F.col("key")))))
    return marked.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)))


def possible_hits(asked: DataFrame, bloom: DataFrame) -> DataFrame:
    """Rows of `asked` whose `key` may be listed."""
    met = asked.withColumn("block", _block(F.col("key"))).join(F.broadcast(bloom), "block")
    for i, bit in enumerate(_bits(F.col("key"))):
        met = met.where(F.col(f"w{i}").bitwiseAND(bit) == bit)
    return met.select(*asked.columns)


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], listed: DataFrame) -> DataFrame:
    """`pages` with host, path, rule and verdict, replaced if there.

    rules: (verdict, host, path); a rule fits its host and all subdomains if the path starts with
    the rule's, and the longest rule (host and path) decides. listed: a column `url`; a page that
    no rule fits is blocked if its canonical URL is the canonical URL of a listed one, else
    allowed. A null url or one without :// has an empty host and path, which nothing fits. Every
    row is kept with its other columns; repeated rows and URLs get the same verdict.
    """
    spark = pages.sparkSession
    columns = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    given = spark.createDataFrame(
        [(f"r|{h}|{p}", f"{h}{p}", len(h) + len(p), v) for v, h, p in rules], "key string, rule string, length int, verdict string")
    known = listed.select(host_of(F.col("url")).alias("h"), path_of(F.col("url")).alias("p")).where("h <> ''")
    known = known.select(F.concat(F.lit("u|"), canonical(F.col("h"), F.col("p"))).alias("key")).distinct()
    known = known.select("key", F.lit(None).cast("string").alias("rule"), F.lit(-1).alias("length"), F.lit("block").alias("verdict"))
    keys = given.unionByName(known)
    split = pages.select(host_of(F.col("url")).alias("h"), path_of(F.col("url")).alias("p")).distinct().where("h <> ''")
    labels = F.split("h", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = [F.when(F.length("p") >= n, F.substring("p", 1, n)) for n in sorted({len(p) for _, _, p in rules})]
    fits = F.flatten(F.transform(F.array_compact(F.array(*prefixes)), lambda p: F.transform(ends, lambda e: F.concat(F.lit("r|"), e, F.lit("|"), p))))
    wanted = F.array_append(fits, F.concat(F.lit("u|"), canonical(F.col("h"), F.col("p"))))
    hits = possible_hits(split.select("h", "p", F.explode(wanted).alias("key")), bloom_filter(keys)).join(keys, "key")
    best = hits.groupBy("h", "p").agg(F.max_by(F.struct("rule", "verdict"), F.struct("length", "rule")).alias("best"))
    # The caller's columns travel in one struct, so that none of their names can clash.
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_page"), host_of(F.col("url")).alias("h"), path_of(F.col("url")).alias("p"))
    rows = rows.join(best, ["h", "p"], "left")
    return rows.select(
        *[F.col("_page").getField(c).alias(c) for c in columns], F.col("h").alias("host"), F.col("p").alias("path"), F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit("allow")).alias("verdict"),
    )

"""The registered queries of the numbered operators and the SQL that some of them must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.llm.decontamination import find_contamination
from gaugeflow.llm.fingerprints import fingerprint_documents
from gaugeflow.llm.line_dedup import dedup_lines
from gaugeflow.llm.near_dedup import group_near_duplicates
from gaugeflow.llm.neighbours import nearest
from gaugeflow.llm.packed import table
from gaugeflow.llm.packing import pack
from gaugeflow.llm.passages import fuzzy_passages
from gaugeflow.llm.quality import fit, score_quality
from gaugeflow.llm.resampling import resample
from gaugeflow.llm.substring_array import remove_repeats
from gaugeflow.llm.transcripts import fit as fit_transcripts
from gaugeflow.llm.transcripts import parse_transcripts
from gaugeflow.llm.url_filters import host_of, judge_urls
from gaugeflow.llm.whitening import whiten
from gaugeflow.session import tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(work: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return work(tune(spark), folder)

        run.__name__, run.__doc__ = name, work.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return work

    return register


def digest(text: str) -> F.Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)



LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, line, pos, regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), often AS (
  SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM (SELECT l.doc_id, l.line, l.pos, coalesce(o.last <> l.doc_id, FALSE) AS lost FROM lines l LEFT JOIN often o ON l.key = o.key)
GROUP BY doc_id
"""


@query("op1_line_dedup", OP1_SQL)
def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of at least 40 characters in at least 5 documents stay in the last of them only."""
    kept = dedup_lines(table(spark, folder, "documents").select("doc_id", "text"), min_chars=40, min_docs=5)
    return kept.select("doc_id", "n_lines", "n_dropped", digest("text").alias("kept_sha256"))


@query("op2_best_fit_packing")
def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return pack(table(spark, folder, "documents"), size=1024, end=2)


def held_out(key: str = "doc_id") -> F.Column:
    """Rows whose labels nothing is learned from; rows without an id are not among them."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


@query("op3_quality_classifier")
def quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Every whole document scored by a network that learned from labels of the other rows."""
    docs, labels = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels")
    network = fit(docs, labels.where(~held_out()), "quality")
    scored = score_quality(docs, network, threshold=0.7)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


OP4_SQL = rf"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM texts
), each AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM each a JOIN each b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reached(doc_id, c) AS (
  SELECT doc_id, doc_id FROM sets UNION SELECT l.y, r.c FROM reached r JOIN links l ON r.doc_id = l.x
), least AS (SELECT doc_id, min(c) AS component_id FROM reached GROUP BY doc_id)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least USING (doc_id)
"""


@query("op4_minhash_near_dedup", OP4_SQL)
def minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of documents whose 4-word shingles overlap by 80 percent or more."""
    return group_near_duplicates(table(spark, folder, "documents"), width=4, percent=80)


OP9_SQL = rf"""
WITH item AS (
  SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2),
    lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) AS g FROM item WHERE len(w) > 0
), doc AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), spans AS (
  SELECT doc_id, l.n, unnest(range(1, len(w) - l.n + 2)) AS pos,
    unnest(list_transform(range(1, len(w) - l.n + 2), lambda i: array_to_string(w[i:i + l.n - 1], ' '))) AS g
  FROM doc, (SELECT DISTINCT n FROM windows) l WHERE len(w) >= l.n
), met AS (SELECT s.doc_id, s.pos, s.n, w.item_id FROM spans s JOIN windows w ON s.g = w.g AND s.n = w.n
), hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM met) GROUP BY doc_id
), named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS i FROM met GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(i, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query("op9_benchmark_decontamination", OP9_SQL)
def benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of documents inside 10-word windows of benchmark items."""
    docs, items = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark")
    found = find_contamination(docs, items, size=10)
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), "contaminated")


RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

OP7_SQL = r"""
WITH rest AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), cut AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), c AS (
  SELECT *, regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(/|\.html)$', '') AS canonical,
    CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
      WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
      WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
      WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
      WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM cut
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN canonical IN (SELECT canonical FROM c WHERE host LIKE '%ads-track%') AND host <> '' THEN 'block' ELSE 'allow' END AS verdict
FROM c
"""


@query("op7_url_filters", OP7_SQL)
def url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Rules on hosts and paths; where none fits, the URLs of tracking hosts are the list."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    listed = pages.where(host_of(F.col("url")).contains("ads-track")).select("url")
    return judge_urls(pages, RULES, listed).select("page_id", "host", "path", "rule", "verdict")


@query("op10_nearest_neighbours")
def nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 nearest rows of every 50th vector."""
    vectors = table(spark, folder, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


@query("op8_suffix_array_dedup")
def suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of 100-byte strings that start earlier too are removed."""
    kept = remove_repeats(table(spark, folder, "documents"), length=100)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return kept.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op5_substring_chains")
def substring_chains(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of at least 50 words that a document shares, nearly or wholly, with an earlier one."""
    return fuzzy_passages(table(spark, folder, "documents"), least=50, identity=0.8)


PIECE = 256  # turns that a row holds; the rows of a conversation are parsed as one text


def raw_transcripts(turns: DataFrame, size: int = PIECE) -> DataFrame:
    """Conversations as raw text: most turns carry one of several markers, the others a blank line only."""
    drawn = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(8))
    named = F.create_map(*(F.lit(x) for x in ("system", "System: ", "user", "User: ", "assistant", "Assistant: ")))
    other = F.create_map(*(F.lit(x) for x in ("system", "### System: ", "user", "Human: ", "assistant", "AI: ")))
    marker = F.when(drawn < 4, named[F.col("role")]).when(drawn < 7, other[F.col("role")]).otherwise("\n")
    marked = turns.select("conv_id", F.floor(F.col("turn") / size).alias("piece"), "turn", "role", F.concat(F.coalesce(marker, F.lit("")), F.coalesce("text", F.lit(""))).alias("text"))
    held = marked.groupBy("conv_id", "piece").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("held"))
    return held.select("conv_id", "piece", F.col("held.role").alias("roles"), F.col("held.text").alias("texts"), F.array_join("held.text", "\n").alias("text"))


@query("op6_chat_formatting")
def chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """Roles of all conversations' raw transcripts, from their text alone, and canonical turns, by a model
    that three quarters of the conversations taught. rendered_sha256 digests the digests of the pieces."""
    raw = raw_transcripts(table(spark, folder, "conversations"))
    apart = held_out("conv_id")
    parsed = parse_transcripts(raw.drop("texts"), fit_transcripts(raw.where(~apart), first="piece = 0"))
    opened = F.transform(F.filter("turns", lambda t: t["opens"]), lambda t: t["role"])
    each = parsed.select("conv_id", "piece", "roles", opened.alias("opened"), digest("rendered").alias("sha"), F.length("rendered").alias("chars"))
    return each.groupBy("conv_id").agg(
        F.sum(F.size("opened")).alias("n_turns"), F.sum(F.size("roles")).alias("n_given"),
        F.bool_and(F.col("opened").eqNullSafe(F.col("roles"))).alias("roles_right"), F.sum("chars").alias("n_chars"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "sha"))), lambda x: x["sha"]), ""), 256).alias("rendered_sha256"),
    ).withColumn("held_out", apart)


@query("op13_document_fingerprints")
def document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, and likeness by equal slots."""
    return fingerprint_documents(table(spark, folder, "documents"))


OP12_SQL = rf"""
WITH steps AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t
), split AS (
  SELECT doc_id AS id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, FALSE AS wanted FROM documents
  UNION ALL SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), TRUE FROM benchmark
), features AS (
  SELECT wanted, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM split
), spelled AS (
  SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM features)
), hashed AS (
  SELECT f, xor(list_reduce(list_transform(range(0, len(x), 2), lambda i: CAST('0x' || substr(x, CAST(i + 1 AS INTEGER), 2) AS BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM spelled, steps
), counted AS (
  SELECT bucket, count(*) FILTER (WHERE NOT wanted) AS s, count(*) FILTER (WHERE wanted) AS t FROM features JOIN hashed USING (f) GROUP BY bucket
), totals AS (SELECT sum(s) AS many, sum(t) AS aims FROM counted
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(many + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(aims + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM counted, totals
), weights AS (
  SELECT id, count(*) AS n_features, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight
  FROM features JOIN hashed USING (f) JOIN gains USING (bucket) WHERE NOT wanted GROUP BY id
), scored AS (
  SELECT id AS doc_id, len(w) >= 20 AS able, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
    + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || id), 1, 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM split LEFT JOIN weights USING (id) WHERE NOT wanted
), placed AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY able) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 25 * n // 100 THEN place END AS rank FROM placed
"""


@query("op12_importance_resampling", OP12_SQL)
def importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    """A quarter of all documents of at least 20 words, drawn towards the benchmark's texts."""
    drawn = resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"), percent=25, min_words=20, seed=7)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query("op11_embedding_whitening")
def embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """All vectors on the 16 components of the widest spread, to unit variance."""
    return whiten(table(spark, folder, "embeddings"), components=16)

"""The numbered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamsift.llm import (
    contain, hardneg, kdtree, lines, neardup, ngram, packing, quality, topk, toxicity, urlglob, warc,
    whitening)
from loamsift.llm.common import held_out, table
from loamsift.session import stash

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def _word_sets(of: str, key: str, pattern: str, k: int) -> str:
    """DuckDB: distinct ``k``-word shingles of each row; shorter rows are one shingle."""
    return f"""SELECT DISTINCT {key}, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k}
  THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {k} + 2),
  lambda i: array_to_string(w[i:i + {k} - 1], ' ')) END) AS s
FROM (SELECT {key}, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{pattern}') AS w
  FROM {of})"""


@query("op1_decontamination", f"""WITH
d AS ({_word_sets('documents', 'doc_id', '[0-9a-z\\x{80}-\\x{10FFFF}]+', 5)}),
b AS ({_word_sets('benchmark', 'item_id', '[0-9a-z\\x{80}-\\x{10FFFF}]+', 5)}),
n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY 1)
SELECT doc_id, item_id, count(*) AS n_shared, n_item, count(*) / n_item AS containment
FROM d JOIN b USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_item
HAVING count(*) >= 0.8 * n_item""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return contain.find_items(table(spark, d, "documents"), table(spark, d, "benchmark"))


_STRIP = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


@query("op5_line_dedup", f"""WITH l AS (SELECT doc_id, generate_subscripts(x, 1) AS pos,
  unnest(x) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x
  FROM documents)),
k AS (SELECT *, {_LOWER.format(_STRIP.format('line'))} AS key FROM l),
often AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(o.key) AS n_dropped,
sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (o.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN often o ON o.key = k.key GROUP BY doc_id""")
def _(spark: SparkSession, d: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, d, "documents"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped",
                      F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


_NEAR = _word_sets('documents', 'doc_id', '[^\\x20\\x09-\\x0D]+', 3)


@query("op2_near_dedup", f"""WITH RECURSIVE s AS ({_NEAR}),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
often AS (SELECT s, count(*) AS f FROM s GROUP BY 1),
r AS (SELECT s.doc_id, s.s, n.n, row_number() OVER (PARTITION BY s.doc_id ORDER BY f, s.s) AS i
  FROM s JOIN often USING (s) JOIN n USING (doc_id)),
head AS (SELECT * FROM r WHERE i <= n - ceil(0.85 * n) + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM head a JOIN head b ON a.s = b.s
  AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
p AS (SELECT c.a, c.b, count(*) AS k FROM c JOIN s x ON x.doc_id = c.a
  JOIN s y ON y.doc_id = c.b AND y.s = x.s GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
w AS (SELECT doc_id AS node, doc_id AS root FROM documents
  UNION SELECT e.b, w.root FROM w JOIN e ON e.a = w.node),
m AS (SELECT node, min(root) AS root FROM w GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.root AS component_id,
  m.root = d.doc_id AS kept
FROM documents d JOIN m ON m.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return neardup.link(table(spark, d, "documents"), k=3, percent=85).drop("class_id")


@query("op7_packing")
def _(spark: SparkSession, d: str) -> DataFrame:
    import public_tokenizers
    cut = packing.pieces(table(spark, d, "documents"),
                         public_tokenizers.path("word_bpe_49k.json"), end_id=1, max_len=4096)
    return packing.pack(cut, 4096)


@query("op8_sharding")
def _(spark: SparkSession, d: str) -> DataFrame:
    return kdtree.shard(table(spark, d, "documents"), n_shards=40, overhead=16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


@query("op9_exact_topk", """WITH v AS (SELECT vec_id, list_transform(embedding,
  lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v),
  lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)
  AS INT) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return topk.top_k(table(spark, d, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


_DAMAGE = """CASE WHEN page_id % 50 = 7 THEN 'missing' WHEN page_id % 50 = 11 THEN 'changed'
  WHEN page_id % 50 = 13 THEN 'extra' END"""


@query("op6_warc_fixity", f"""WITH p AS (SELECT page_id, {_DAMAGE} AS finding,
  page_id // 256 AS segment, 128 + strlen(CAST(page_id AS VARCHAR)) + strlen(coalesce(url, ''))
  + strlen(CAST(strlen(coalesce(html, '')) AS VARCHAR)) + strlen(coalesce(html, '')) AS n FROM pages),
o AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY segment ORDER BY page_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS began FROM p)
SELECT segment, CAST(began + CASE finding WHEN 'extra' THEN 1 ELSE 0 END AS BIGINT) AS "offset",
  finding, CAST(CASE finding WHEN 'extra' THEN NULL ELSE n END AS BIGINT) AS length,
  CAST(CASE finding WHEN 'missing' THEN NULL ELSE n END AS BIGINT) AS replica_length
FROM o WHERE finding IS NOT NULL""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """An archive of all pages and its written replica, damaged by page_id: lost records, records
    with one byte changed, and records that stand a second time one byte further on."""
    original = stash(warc.archive(table(spark, d, "pages")), "archive", "zstd")
    harm = F.expr(_DAMAGE)
    record = F.col("record")
    hurt = F.when(harm.eqNullSafe("changed"), F.expr(
        "concat(substring(record, 1, 8), X'00', substring(record, 10))")).otherwise(record)
    copy = original.where(~harm.eqNullSafe("missing")).select(
        "segment", "offset", hurt.alias("record"))
    extra = original.where(harm.eqNullSafe("extra")).select(
        "segment", (F.col("offset") + 1).alias("offset"), "record")
    return warc.audit(original, stash(copy.unionByName(extra), "replica", "zstd"))


def _classified(scored: DataFrame, cut: float) -> DataFrame:
    return scored.select("doc_id", held_out(4, 2).alias("held_out"), "score",
                         (F.col("score") >= cut).cast("int").alias("predicted"))


@query("op4_quality")
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    model = quality.fit(docs, table(spark, d, "labels"), ~held_out(4, 2))
    return _classified(quality.score(docs, model), 0.7)


@query("op10_toxicity")
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    model = toxicity.fit(docs, table(spark, d, "labels"), ~held_out(4, 2))
    return _classified(toxicity.score(docs, model), 0.3)


@query("op3_lm_score")
def _(spark: SparkSession, d: str) -> DataFrame:
    scored = ngram.score(table(spark, d, "documents"), ~held_out(10, 0))
    return scored.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known",
                         "train_tokens", "base_score", "score")


@query("op11_whitening")
def _(spark: SparkSession, d: str) -> DataFrame:
    out = whitening.whiten(table(spark, d, "embeddings"), k=4, scale=256)
    return out.withColumn("deviation", F.col("deviation").cast("long"))


# Listed URL rules (action, host, path) and the globs that judge what they leave
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/")]
URL_GLOBS = ["*casino**", "*free-bets**", "*cheap-pills**"]

_LISTED = """CASE
  WHEN ('.' || host) LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/') THEN 'com/' END"""


@query("op12_url_filter", f"""WITH r AS (SELECT page_id, CASE WHEN contains(url, '://')
  THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS own FROM r),
p AS (SELECT page_id, {_LOWER.format('own')} AS host,
  regexp_extract(substr(coalesce(rest, ''), length(own) + 1), '^[^?#]*') AS path FROM h),
j AS (SELECT *, {_LISTED} AS rule FROM p)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN contains(host, 'casino') OR contains(host, 'free-bets') OR contains(host, 'cheap-pills')
  THEN 'block' ELSE 'allow' END AS verdict FROM j""")
def _(spark: SparkSession, d: str) -> DataFrame:
    rules = urlglob.host_rules(URL_RULES) + [urlglob.Rule(g, "block") for g in URL_GLOBS]
    return urlglob.judge(table(spark, d, "pages").select("page_id", "url"), rules).drop("url")


@query("op13_hard_negatives", """WITH v AS (SELECT vec_id,
  CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding,
  lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_sum(list_transform(
  list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id
  ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score
  AND 100 * score <= 95 * positive_score QUALIFY rank <= 3""")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").withColumn("label", F.when(
        F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hardneg.mine(rows, F.col("vec_id") % 50 == 0)

"""Corpus queries: identity, deduplication, sampling, splits, validation, chunks, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import batch, chunking, quality
from corpusloom.plans.registry import query
from corpusloom.plans.retrieval import QRELS, qrels
from corpusloom.runtime import table
from corpusloom.sources import readers

NORM = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"


@query(r"""WITH t AS (SELECT doc_id, source, list_filter(regexp_split_to_array(s, '\s+'), lambda x: x <> '') AS w, p FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents)),
c AS (SELECT doc_id, p, i, w[i * 24 + 1:i * 24 + 32] AS c FROM (SELECT *, unnest(generate_series(0, greatest(0, CAST(ceil((len(w) - 32) / 24.0) AS INTEGER)))) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p, i) - 1 AS INTEGER) AS o, c FROM c)
SELECT doc_id, doc_id || '#' || o AS chunk_id, o AS "order", array_to_string(c, ' ') AS content FROM n""")
def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_windows(table(spark, d, "documents"), 32, 8)


@query(f"SELECT min(doc_id) AS doc_id, sha256({NORM}) AS content_hash, count(*) AS copies FROM documents GROUP BY 2")
def exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return quality.exact_dedup(table(spark, d, "documents"))


@query("SELECT url_key, arg_max(page_id, page_id) AS last_page, min(page_id) AS page_id FROM (SELECT regexp_extract(url, '^https?://([^/]*)', 1) AS url_key, page_id FROM pages) GROUP BY 1")
def dedup_last_wins(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select(F.regexp_extract("url", "^https?://([^/]*)", 1).alias("url_key"), F.col("page_id").alias("last_page"), "page_id")
    return quality.last_wins(p, "url_key", "last_page", "page_id")


@query(f"WITH {QRELS} SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM qrels)")
def decontaminate(spark: SparkSession, d: str) -> DataFrame:
    return quality.exclude(table(spark, d, "documents").select("doc_id", "n_chars"), qrels(spark, d), ["doc_id"])


@query("SELECT doc_id FROM documents ORDER BY sha256('42:' || doc_id), doc_id LIMIT 50")
def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    return quality.hash_sample(table(spark, d, "documents").select("doc_id"), "doc_id", 50)


@query("SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY source ORDER BY sha256('42:' || source || ':' || doc_id), doc_id) AS INTEGER) AS place FROM documents QUALIFY place <= 3")
def shard_sample(spark: SparkSession, d: str) -> DataFrame:
    return quality.shard_sample(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 3)


@query("WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), b AS (SELECT source, coalesce(sum(n) OVER (ORDER BY sha256('42:' || source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n) SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM b WHERE before < 100)")
def shards_until(spark: SparkSession, d: str) -> DataFrame:
    return quality.shards_until(table(spark, d, "documents").select("doc_id", "source"), "source", 100)


@query("SELECT doc_id, CASE WHEN CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) % 10000 < 1000 THEN 'test' ELSE 'train' END AS split FROM documents")
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    return quality.hash_split(table(spark, d, "documents").select("doc_id"), "doc_id", 0.1)


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= floor(count(*) OVER () * 90 / 100) THEN 'train' ELSE 'test' END AS split FROM documents")
def positional_split(spark: SparkSession, d: str) -> DataFrame:
    return quality.positional_split(table(spark, d, "documents").select("doc_id"), "doc_id", 90, 97)


@query(f"""WITH {QRELS}, h AS (SELECT doc_id, source, text, sha256({NORM}) AS h FROM documents), s AS (SELECT * FROM h WHERE trim(text) <> '' QUALIFY row_number() OVER (PARTITION BY source ORDER BY sha256('42:' || source || ':' || doc_id), doc_id) <= 10),
c AS (SELECT * FROM s WHERE h NOT IN (SELECT h FROM h WHERE doc_id IN (SELECT doc_id FROM qrels)) QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id) = 1)
SELECT doc_id, source, h AS content_hash FROM c ORDER BY sha256('42:' || doc_id), doc_id LIMIT 40""")
def distractors(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return quality.distractors(docs, docs.join(qrels(spark, d).select("doc_id").distinct(), "doc_id", "left_semi"), 40, 10)


@query(f"""WITH {QRELS} SELECT 'repeated text' AS rule, h AS key FROM (SELECT sha256({NORM}) AS h FROM documents GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'label without document', doc_id::VARCHAR FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 10 <> 0)
UNION ALL SELECT 'question without document', item_id::VARCHAR FROM benchmark WHERE item_id NOT IN (SELECT query_id FROM qrels)
UNION ALL SELECT 'length differs', doc_id::VARCHAR FROM documents WHERE length(text) <> n_chars""")
def validate_violations(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    h = docs.select(F.sha2(text.normalize_text("text"), 256).alias("h"))
    return quality.violations({
        "repeated text": quality.duplicate_keys(h, "h"),
        "label without document": quality.missing_keys(table(spark, d, "labels"), "doc_id", docs.filter("doc_id % 10 <> 0"), "doc_id"),
        "question without document": quality.missing_keys(table(spark, d, "benchmark"), "item_id", qrels(spark, d), "query_id"),
        "length differs": docs.filter(F.length("text") != F.col("n_chars")).select("doc_id"),
    })


@query("SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'right' ELSE 'left' END AS side FROM (SELECT doc_id FROM documents WHERE doc_id % 3 = 0 UNION SELECT doc_id FROM labels) WHERE (doc_id % 3 = 0) <> (doc_id IN (SELECT doc_id FROM labels))")
def id_set_diff(spark: SparkSession, d: str) -> DataFrame:
    return quality.id_difference(table(spark, d, "documents").filter("doc_id % 3 = 0"), table(spark, d, "labels"), "doc_id")


@query(f"""WITH {QRELS}, h AS (SELECT doc_id, sha256({NORM}) AS h FROM documents), g AS (SELECT query_id, doc_id, h FROM qrels JOIN h USING (doc_id)),
p AS (SELECT query_id, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM g GROUP BY 1),
o AS (SELECT DISTINCT x.query_id FROM (SELECT DISTINCT query_id, h FROM g) x JOIN h USING (h) WHERE (x.query_id, h.doc_id) NOT IN (SELECT (query_id, doc_id) FROM qrels))
SELECT item_id AS query_id, coalesce(n, 0) AS n_qrels, coalesce(ids, '') AS doc_ids, o.query_id IS NOT NULL AS copy_outside, coalesce(n, 0) > 0 AND o.query_id IS NULL AS passed FROM benchmark LEFT JOIN p ON item_id = p.query_id LEFT JOIN o ON item_id = o.query_id""")
def audit_report(spark: SparkSession, d: str) -> DataFrame:
    return quality.audit(table(spark, d, "benchmark"), qrels(spark, d), table(spark, d, "documents"))


@query(f"SELECT doc_id, 'doc-' || md5(text) AS content_id, sha256({NORM} || chr(10) || {NORM}) AS content_hash FROM documents")
def content_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.content_id("text", "doc-").alias("content_id"), text.content_hash("text", "text").alias("content_hash"))


@query(r"""WITH b AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g') AS h FROM pages)
SELECT page_id, array_to_string(list_filter(list_transform(regexp_extract_all(h, '(?is)<p(?:\s[^>]*)?>(.*?)</p\s*>', 1), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM b""")
def html_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return readers.page_text(table(spark, d, "pages"))


@query(r"SELECT page_id, url FROM pages WHERE lower(regexp_extract(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), '(\.[a-zA-Z0-9]+)$', 1)) IN ('', '.html', '.htm', '.shtml')")
def link_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").filter(text.link_kept("url")).select("page_id", "url")


PACK = r"""w AS (SELECT source, doc_id, list_append(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> ''), '</s>') AS w FROM documents),
t AS (SELECT source, tok, row_number() OVER (PARTITION BY source ORDER BY doc_id, i) - 1 AS pos FROM (SELECT source, doc_id, unnest(w) AS tok, generate_subscripts(w, 1) AS i FROM w)),
b AS (SELECT source, pos // 512 AS block_no, list(tok ORDER BY pos) AS ids FROM t GROUP BY 1, 2)"""


@query(f"WITH {PACK} SELECT source, CAST(block_no AS BIGINT) AS block_no, array_to_string(ids, ' ') AS input_ids FROM b WHERE len(ids) = 512 OR block_no = 0")
def token_packing(spark: SparkSession, d: str) -> DataFrame:
    return chunking.pack_tokens(table(spark, d, "documents"), 512, "source").select("source", "block_no", F.array_join("input_ids", " ").alias("input_ids"))


@query(r"SELECT term, count(*) AS n FROM (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term FROM documents) WHERE term NOT IN (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) FROM benchmark) GROUP BY 1 ORDER BY n DESC, term LIMIT 100")
def new_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent words of documents that another vocabulary lacks."""
    known = table(spark, d, "benchmark").select(F.explode(text.words("text")).alias("term")).distinct()
    terms = table(spark, d, "documents").select(F.explode(text.words("text")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return terms.join(known, "term", "left_anti").orderBy(F.desc("n"), "term").limit(100)


@query("SELECT doc_id, quality, toxic, text FROM (SELECT doc_id, quality, toxic, NULL::VARCHAR AS text FROM labels UNION ALL SELECT item_id, NULL, NULL, text FROM benchmark)")
def align_union(spark: SparkSession, d: str) -> DataFrame:
    return batch.align(table(spark, d, "labels"), table(spark, d, "benchmark").withColumnRenamed("item_id", "doc_id"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").filter("l_shipdate <= timestamp_ntz '1998-09-02 00:00:00'")
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 4).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"), F.count("*").alias("n"))


@query("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def nation_revenue(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    x = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return x.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"))

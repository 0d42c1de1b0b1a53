"""Queries that write tables in the library's file forms to the shared folder and read them back: what comes out is what went in."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import quality
from corpusloom.plans.registry import query
from corpusloom.runtime import shared_dir, table
from corpusloom.sources import readers, sinks

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def stored_json_lines(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark, "lines")
    sinks.json_lines(docs(spark, d), path, ["source", "doc_id"])
    return readers.json_lines(spark, path, DOCS)


@query("SELECT source AS shard, count(*) AS n, sum(n_chars) AS n_chars FROM documents GROUP BY 1")
def stored_shards(spark: SparkSession, d: str) -> DataFrame:
    """A file for each source, read by file name."""
    path = folder(spark, "shards")
    line = F.to_json(F.struct("doc_id", "n_chars", "source")).alias("value")
    docs(spark, d).select("source", line).repartition("source").write.partitionBy("source").text(path)
    rows = spark.read.schema("doc_id bigint, n_chars bigint, source string").option("mode", "FAILFAST").json(path)
    return rows.groupBy(F.col("source").alias("shard")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


@query("SELECT CAST(b.item_id AS VARCHAR) AS query_id, CAST(d.doc_id AS VARCHAR) AS doc_id, 1 AS relevance FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def stored_qrels(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark, "qrels")
    rel = quality.containment(docs(spark, d), table(spark, d, "benchmark"))
    sinks.qrels(rel.coalesce(1), path)
    return readers.qrels(spark, path)


@query("SELECT CAST(item_id AS VARCHAR) AS id, text AS QUESTION, CASE WHEN item_id % 2 = 0 THEN 'yes' ELSE 'no' END AS final_decision, CASE WHEN item_id % 4 = 0 THEN 'test' ELSE 'dev' END AS split FROM benchmark")
def stored_labelled_map(spark: SparkSession, d: str) -> DataFrame:
    """One JSON object of all records, and one of a quarter's labels."""
    path = folder(spark, "map")
    b = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("id"), (F.col("item_id") % 4 == 0).alias("gold"), F.when(F.col("item_id") % 2 == 0, "yes").otherwise("no").alias("label"), "text")
    record = F.struct(F.col("text").alias("QUESTION"), F.array("text").alias("CONTEXTS"), F.lit("2020").alias("YEAR"), F.col("label").alias("final_decision"), F.col("text").alias("LONG_ANSWER"))
    whole = lambda df, v: df.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("id", v.alias("v"))))).alias("value")).coalesce(1)
    whole(b, record).write.text(f"{path}/records")
    whole(b.filter("gold"), F.col("label")).write.text(f"{path}/truth")
    return readers.labelled_map(spark, f"{path}/records", f"{path}/truth").select("id", "QUESTION", "final_decision", "split")


@query("SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, d.source AS title, d.text AS content, (SELECT count(DISTINCT item_id) FROM benchmark b JOIN documents x ON contains(x.text, b.text)) AS n_questions FROM documents d")
def stored_corpus_layout(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark, "corpus")
    docs(spark, d).select(F.col("doc_id").alias("_id"), F.col("source").alias("title"), "text").write.parquet(f"{path}/corpus")
    table(spark, d, "benchmark").select(F.col("item_id").alias("_id"), "text").write.parquet(f"{path}/queries")
    rel = quality.containment(docs(spark, d), table(spark, d, "benchmark")).withColumn("score", F.lit("1"))
    rel.select("query_id", "doc_id", "score").coalesce(1).write.csv(f"{path}/qrels", sep="\t", header=True)
    corpus, questions, _ = readers.corpus_layout(spark, f"{path}/corpus", f"{path}/queries", f"{path}/qrels")
    return corpus.crossJoin(F.broadcast(questions.agg(F.count("*").alias("n_questions"))))  # one row


@query("SELECT source AS title, arg_max(replace(text, chr(10), ' ') || lang, doc_id) AS content, min(doc_id) AS first_id FROM documents GROUP BY 1")
def paragraph_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents as questions with one titled context each: of a title's texts the last counts, at the first's place."""
    ctx = F.struct(F.array("source").alias("title"), F.array(F.array(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), F.col("lang"))).alias("sentences"))
    q = docs(spark, d).select(F.col("doc_id").alias("id"), ctx.alias("context"), F.struct(F.array("source").alias("title")).alias("supporting_facts"))
    out, _ = readers.paragraphs(q)
    return out.select("title", "content", F.col("seq.id").alias("first_id"))


@query(r"SELECT replace(left(text, 30), chr(10), ' ') AS input, replace(source, chr(9), ' ') AS output FROM documents WHERE regexp_matches(left(text, 30), '^[a-z ]+$')")
def stored_tab_pairs(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark, "pairs")
    p = docs(spark, d).filter(F.rlike(F.left("text", F.lit(30)), F.lit("^[a-z ]+$"))).select(F.left("text", F.lit(30)).alias("input"), F.col("source").alias("output"))
    p.select(F.concat_ws("\t", "input", "output").alias("value")).write.text(path)
    return readers.tab_pairs(spark, path, "qa")


@query(r"SELECT trim(x) AS text, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS x FROM benchmark) WHERE trim(x) <> '' GROUP BY 1")
def stored_text_folder(spark: SparkSession, d: str) -> DataFrame:
    """Lines of text files in nested folders."""
    path = folder(spark, "texts")
    for part in (0, 1):
        table(spark, d, "benchmark").filter(F.col("item_id") % 2 == part).select("text").write.text(f"{path}/deep/{part}")
    return readers.text_folder(spark, path).select(F.trim("text").alias("text")).groupBy("text").agg(F.count("*").alias("n"))


@query("SELECT r AS request, CAST(p AS INTEGER) AS place, doc_id, d.text FROM (SELECT r, p, (r * 7 + p * 3) % 50 AS doc_id FROM range(20) a(r), range(4) b(p)) JOIN documents d USING (doc_id)")
def rows_by_ids(spark: SparkSession, d: str) -> DataFrame:
    req = spark.range(20).select(F.col("id").alias("request"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda p: (F.col("id") * 7 + p * 3) % 50).alias("ids"))
    return readers.by_ids(docs(spark, d).select("doc_id", "text"), req)


@query("SELECT source, count(*) AS n_lines FROM (SELECT source, unnest(string_split(text, chr(10))) AS x FROM documents) WHERE trim(x, ' ') <> '' GROUP BY 1")
def stored_documents(spark: SparkSession, d: str) -> DataFrame:
    """A text file for each source, read as documents, line by line: their non-blank lines."""
    path = folder(spark, "files")
    docs(spark, d).select("source", F.col("text").alias("value")).repartition("source").write.partitionBy("source").text(path)
    found = readers.file_lines(spark, path).select(F.regexp_extract("path", "source=([^/]*)", 1).alias("source"))
    return found.groupBy("source").agg(F.count("*").alias("n_lines"))


@query("SELECT name, n_rows, false AS changed FROM (SELECT 'benchmark' AS name, (SELECT count(*) FROM benchmark) AS n_rows UNION ALL SELECT 'labels', (SELECT count(*) FROM labels)) UNION ALL SELECT 'labels', (SELECT count(*) FROM labels) - 1, true")
def frozen_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Digests don't depend on the layout; a table that lost a row is found."""
    tables = {n: table(spark, d, n) for n in ("benchmark", "labels")}
    kept, again = sinks.manifest(tables), sinks.manifest({n: df.repartition(3) for n, df in tables.items()})
    low = tables["labels"].agg(F.min("doc_id")).first()[0]
    cut = sinks.manifest(tables | {"labels": tables["labels"].filter(F.col("doc_id") != low)})
    same = again.join(sinks.manifest_violations(kept, again), "name", "left_anti").select("name", "n_rows", F.lit(False).alias("changed"))
    return same.unionByName(cut.join(sinks.manifest_violations(kept, cut), "name", "left_semi").select("name", "n_rows", F.lit(True).alias("changed")))


@query("SELECT CAST(doc_id AS VARCHAR) || '#0' AS id, text AS contents, doc_id, 0 AS \"order\" FROM documents")
def index_collection(spark: SparkSession, d: str) -> DataFrame:
    chunks = docs(spark, d).select(F.concat(F.col("doc_id").cast("string"), F.lit("#0")).alias("chunk_id"), "doc_id", F.lit(0).alias("order"), F.col("text").alias("content"))
    texts, side = sinks.collection(chunks)
    return texts.join(side.withColumnRenamed("chunk_id", "id"), "id")


@query("SELECT 7 AS step, name, value FROM (SELECT 'n' AS name, count(*)::DOUBLE AS value FROM documents UNION ALL SELECT 'mean', round(avg(n_chars), 6) FROM documents)")
def logged_metrics(spark: SparkSession, d: str) -> DataFrame:
    return sinks.metrics_rows(docs(spark, d).agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean")), 7)


@query("SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1")
def stored_dialogs(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as rows of turns, written as JSON lines with and without tools and read as one table of aligned columns."""
    path = folder(spark, "dialogs")
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("l"))
    rows = c.select("conv_id", F.transform("l", lambda x: F.struct(x["role"].alias("from"), x["text"].alias("value"))).alias("conversations"))
    rows.filter("conv_id % 2 = 0").write.json(f"{path}/a")
    rows.filter("conv_id % 2 = 1").withColumn("tools", F.lit("[]")).write.json(f"{path}/b")
    both = readers.aligned_json(spark, [f"{path}/a", f"{path}/b"])
    return both.filter("(tools is null) = (conv_id % 2 = 0)").select("conv_id", F.size("conversations").cast("bigint").alias("n"))

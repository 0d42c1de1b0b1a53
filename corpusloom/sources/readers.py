"""Scans: JSON lines, relevance files, benchmark layouts, tab-separated pairs, mixed folders, documents."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import html_paragraphs
from corpusloom.operators.batch import align
from corpusloom.operators.chunking import pages_of


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Objects of a JSON-lines file; blank lines are skipped, a line that isn't an object of the schema is an error."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    lines = spark.read.text(path).filter(F.trim("value") != "")
    bad = ~F.rlike(F.trim("value"), F.lit(r"(?s)^\{.*\}$"))
    checked = lines.withColumn("value", F.when(bad, F.raise_error(F.concat(F.lit("not an object: "), F.left("value", F.lit(80))))).otherwise(F.col("value")))
    return checked.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def shards(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Rows of all JSON-lines files of a folder with the file's name; a line that isn't an object of the schema is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(f"{folder}/*.jsonl").select("*", F.element_at(F.split("_metadata.file_name", "/"), -1).alias("shard"))


def qrels(spark: SparkSession, path: str, header: Sequence[str] = ("query_id", "doc_id", "relevance"), least: int = 1) -> DataFrame:
    """(query_id, doc_id, relevance) of a tab-separated file with a header, which must be the given one; lines with another number of fields are an
    error; relevance that isn't a number, or under `least`, drops the line."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    f = F.split("value", "\t", -1)
    first = spark.read.text(path).limit(1).collect()
    if not first or tuple(first[0][0].split("\t")) != tuple(header):
        raise ValueError(f"{path}: the header isn't {header}")
    rows = lines.filter(F.col("value") != "\t".join(header)).select(F.when(F.size(f) == len(header), f).otherwise(F.raise_error(F.concat(F.lit("fields: "), F.col("value"))).cast("array<string>")).alias("f"))
    return rows.select(F.get("f", F.lit(0)).alias("query_id"), F.get("f", F.lit(1)).alias("doc_id"), F.get("f", F.lit(2)).try_cast("int").alias("relevance")).filter(F.col("relevance") >= least)


def labelled_map(spark: SparkSession, path: str, truth: str) -> DataFrame:
    """Records of a JSON object id -> {QUESTION, CONTEXTS, LONG_ANSWER, final_decision, YEAR}, by number; split is test where the id is in the
    truth file. A decision that differs from the truth is an error."""
    kind = "map<string, struct<QUESTION: string, CONTEXTS: array<string>, YEAR: string, final_decision: string, LONG_ANSWER: string>>"
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("id", "r")).select("id", "r.*")
    gold = spark.read.text(truth, wholetext=True).select(F.explode(F.from_json("value", "map<string, string>")).alias("id", "gold"))
    both = whole.join(gold, "id", "left")
    same = F.col("gold").isNull() | (F.col("gold") == F.col("final_decision"))
    return both.withColumn("split", F.when(~same, F.raise_error(F.concat(F.lit("conflicting label: "), F.col("id")))).when(F.col("gold").isNotNull(), "test").otherwise("dev")).drop("gold").orderBy(F.col("id").cast("bigint"))


def corpus_layout(spark: SparkSession, corpus: str, queries: str, judgements: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, questions, qrels) of a corpus and queries in Parquet (_id, title, text) and judgements in tab-separated lines; only judged queries
    with a relevant document are kept."""
    docs = spark.read.parquet(corpus).select(F.col("_id").cast("string").alias("doc_id"), "title", F.col("text").alias("content"))
    rel = spark.read.csv(judgements, sep="\t", header=True, schema="query_id string, doc_id string, score string").select("query_id", "doc_id", F.col("score").try_cast("int").alias("relevance")).filter("relevance >= 1")
    q = spark.read.parquet(queries).select(F.col("_id").cast("string").alias("query_id"), F.col("text").alias("question")).join(rel.select("query_id").distinct(), "query_id", "left_semi")
    return docs, q, rel


def paragraphs(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, qrels) of questions with context {title[], sentences[][]} and supporting_facts {title[]}: one document per title, of
    repeated titles the last text (its place is the first)."""
    rows = df.select("id", F.posexplode(F.arrays_zip(F.col("context.title").alias("title"), F.col("context.sentences").alias("sentences"))).alias("pos", "p"))
    flat = rows.select(F.struct("id", "pos").alias("seq"), F.col("p.title").alias("title"), F.array_join("p.sentences", "").alias("content"))
    docs = flat.groupBy("title").agg(F.max_by("content", "seq").alias("content"), F.min("seq").alias("seq"))
    rel = df.select(F.col("id").alias("query_id"), F.explode(F.array_distinct("supporting_facts.title")).alias("title")).join(docs.select("title"), "title", "left_semi")
    return docs, rel


def tab_pairs(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Headless tab-separated lines: 'qa' has input and output, 'alpaca' instruction, input and output."""
    names = {"qa": "input string, output string", "alpaca": "instruction string, input string, output string"}[kind]
    return spark.read.csv(path, sep="\t", header=False, schema=names)


def aligned_json(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """JSON-lines files with different columns as one table; a column that a file lacks is null there, a broken line is an error."""
    return align(*[spark.read.option("mode", "FAILFAST").json(p) for p in paths])


def text_folder(spark: SparkSession, folder: str, kind: str = "txt", streaming: bool = False) -> DataFrame:
    """Lines (txt and other kinds) or `text` fields (jsonl) of all files under a folder, non-blank; streaming gives an unbounded table."""
    reader = (spark.readStream if streaming else spark.read).option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{kind}")
    rows = reader.schema("value string").text(folder) if kind != "jsonl" else reader.schema("text string").option("mode", "FAILFAST").json(folder)
    return rows.toDF("text").filter(F.trim("text") != "")


def by_ids(corpus: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Random access: ids (request, ids array) to rows in the asked order, repeats kept."""
    return ids.select("request", F.posexplode("ids").alias("place", key)).join(corpus, key)


def answer_pairs(flat: DataFrame, asker: str = "user", teller: str = "assistant") -> DataFrame:
    """(conv_id, turn, input, output): each answer with the last question before it."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    asked = F.last(F.when(F.col("role") == asker, F.col("text")), ignorenulls=True).over(w)
    return flat.withColumn("input", asked).filter((F.col("role") == teller) & F.col("input").isNotNull()).select("conv_id", "turn", "input", F.col("text").alias("output"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def document_lines(content: pd.Series, name: pd.Series) -> pd.Series:
    """Non-blank lines of a text or Markdown file's bytes; of PDF and DOCX files if their libraries are installed, else null."""

    def lines(b: bytes | None, n: str | None) -> list[str] | None:
        import io

        kind = (n or "").rsplit(".", 1)[-1].lower()
        if b is None:
            return None
        if kind in ("txt", "md"):
            return [x.strip() for x in bytes(b).decode("utf-8", "replace").splitlines() if x.strip()]
        try:
            if kind == "pdf":
                import pypdf

                text = "\n".join(p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(b)).pages)
                return [x for x in pages_of(text.splitlines()) if x]
            if kind == "docx":
                import docx

                return [p.text.strip() for p in docx.Document(io.BytesIO(b)).paragraphs if p.text.strip()]
        except ImportError:
            return None
        return None

    return pd.Series([lines(b, n) for b, n in zip(content, name, strict=True)])


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, lines) of the documents of a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", document_lines("content", "path").alias("lines"))


def file_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(path, line): the non-blank lines of files() as rows. Text and Markdown files are read in splits, line by line, so none is held whole; the
    lines of PDF and DOCX files come from document_lines()."""
    of = lambda kind, glob: spark.read.format(kind).option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    path = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^file:///", "file:/")  # as a binary file's
    line = F.explode(F.split("value", r"[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"))
    texts = of("text", "*.{[tT][xX][tT],[mM][dD]}").select(path.alias("path"), line.alias("line")).withColumn("line", F.regexp_replace("line", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))
    other = of("binaryFile", "*.{[pP][dD][fF],[dD][oO][cC][xX]}").select("path", F.explode(document_lines("content", "path")).alias("line"))
    return texts.filter("line <> ''").unionByName(other)


def head_digest(spark: SparkSession, folder: str, size: int = 1 << 20) -> DataFrame:
    """(path, digest): MD5 of the first `size` bytes of each file, which names a cache of the corpus."""
    return spark.read.format("binaryFile").load(folder).select("path", F.md5(F.substring("content", 1, size)).alias("digest"))


def page_text(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", html_paragraphs("html").alias("text"))


def search_results(response: Column, k: int) -> Column:
    """array<struct<title, snippet, link>> of a web search's JSON: answer box, then k organic and k related results."""
    item = "struct<title: string, snippet: string, link: string>"
    r = F.from_json(response, f"answerBox {item}, organic array<{item}>, relatedSearches array<{item}>")
    none = F.array().cast(f"array<{item}>")
    box = F.when(r["answerBox"].isNotNull(), F.array(r["answerBox"])).otherwise(none)
    return F.concat(box, F.slice(F.coalesce(r["organic"], none), 1, k), F.slice(F.coalesce(r["relatedSearches"], none), 1, k))

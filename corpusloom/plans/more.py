"""Queries for parts of the other operators: texts and prompts, token arrays, rollouts, vocabularies, answers from evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import rewards, text, tokens, vector
from corpusloom.operators import batch, chat, chunking, evaluate, lexical, qa, quality, ranking, rl, rollout, vocabulary
from corpusloom.plans.registry import query
from corpusloom.runtime import table

W = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
IDS = "ev AS (SELECT user_id, list(CAST(event_id % 5 AS INTEGER) ORDER BY event_id) AS ids FROM events GROUP BY 1)"


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def ids(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, ids): per user the events' numbers modulo 5, as token ids."""
    item = F.struct("event_id", (F.col("event_id") % 5).cast("int").alias("t"))
    return table(spark, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]).alias("ids"))


def flat(c: str | Column) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")) if isinstance(c, Column) else F.transform(F.col(c), lambda x: x.cast("string")), " ")


@query("SELECT doc_id, CAST((length(text) - length(replace(text, 'an', ''))) // 2 AS INTEGER) AS n FROM documents")
def text_counts(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", text.count_text("text", F.lit("an")).alias("n"))


@query(r"SELECT doc_id, regexp_matches(text, '[\x{4e00}-\x{9fff}]') AS has_chinese FROM documents")
def chinese_flags(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", text.is_chinese("text").alias("has_chinese"))


@query(r"""WITH t AS (SELECT doc_id, trim(source) AS s, left(text, 40) AS h FROM documents), p AS (SELECT *, CASE WHEN regexp_matches(s, '[.?!]\s*$') THEN s ELSE s || '.' END AS st FROM t)
SELECT doc_id, st || ' ' || trim(h) AS joined, s || '[SEP]' || h AS separated, 'query: ' || h AS asked, CASE WHEN trim(h) LIKE '%?' THEN trim(h) ELSE trim(h) || '?' END AS question FROM p""")
def encoder_inputs(spark: SparkSession, d: str) -> DataFrame:
    t = docs(spark, d).select("doc_id", F.trim("source").alias("s"), F.left("text", F.lit(40)).alias("h"))
    return t.select("doc_id", text.joined_text("s", "h").alias("joined"), text.joined_text("s", "h", "[SEP]").alias("separated"), text.prefixed("h", "query", {"query": "query: ", "passage": "passage: "}).alias("asked"), text.question_form("h").alias("question"))


@query(r"""WITH t AS (SELECT doc_id, '(Title: ' || source || ') ' || replace(left(text, 60), chr(10), ' ') AS c FROM documents)
SELECT doc_id, '"' || regexp_extract(c, '^\(Title: (.*?)\) ', 1) || '"' || chr(10) || trim(substr(c, length('(Title: ' || regexp_extract(c, '^\(Title: (.*?)\) ', 1) || ') ') + 1), ' ') AS quoted FROM t""")
def title_forms(spark: SparkSession, d: str) -> DataFrame:
    """Quoted titles, there and back again."""
    c = F.concat(F.lit("(Title: "), F.col("source"), F.lit(") "), F.replace(F.left("text", F.lit(60)), F.lit("\n"), F.lit(" ")))
    t = docs(spark, d).select("doc_id", text.quoted_title(c).alias("quoted"))
    return t.select("doc_id", text.quoted_title(text.titled_form("quoted")).alias("quoted")).withColumn("quoted", F.regexp_replace("quoted", " +$", ""))


@query("SELECT n_regionkey AS region, string_agg(chr(65 + i::INTEGER - 1) || '. ' || n_name, chr(10) ORDER BY i) AS options FROM (SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS i FROM nation) GROUP BY 1")
def choice_options(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    letters = F.transform(F.col("names"), lambda _, i: F.chr(i + 65))
    return names.select("region", text.options_text(F.map_from_arrays(letters, F.col("names"))).alias("options"))


@query(r"""WITH g AS (SELECT n_regionkey AS region, list({'t': n_name, 'c': n_name || '  has ' || chr(10) || n_nationkey} ORDER BY n_nationkey) AS l FROM nation GROUP BY 1)
SELECT region, array_to_string(list_transform(l, lambda x, i: 'Document [' || (i - 1) || '] (Title: ' || x.t || ') ' || trim(regexp_replace(x.c, '\s+', ' ', 'g'))), chr(10)) AS context,
array_to_string(list_transform(l, lambda x, i: '[' || i || ']' || chr(9) || ' "' || x.t || '"'), ' ') AS cited FROM g""")
def numbered_context(spark: SparkSession, d: str) -> DataFrame:
    item = F.struct("n_nationkey", F.col("n_name").alias("title"), F.concat("n_name", F.lit("  has \n"), F.col("n_nationkey").cast("string")).alias("content"))
    g = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.array_sort(F.collect_list(item)).alias("l"))
    return g.select("region", text.numbered_documents(F.col("l")).alias("context"), F.array_join(text.citations(F.transform("l", lambda x: x["title"])), " ").alias("cited"))


@query(r"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')[1:20], ' ') AS tokens, left(text, 100) AS chars FROM documents")
def cut_context(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", text.first_tokens("text", 20).alias("tokens"), F.left("text", F.lit(100)).alias("chars"))


@query(r"""WITH s AS (SELECT doc_id, text, list_filter(list_transform(string_split(replace(left(text, 400), '. ', '...'), '...'), lambda x: trim(x)), lambda x: len(regexp_split_to_array(x, '\s+')) > 5) AS p FROM documents WHERE doc_id % 7 = 0)
SELECT doc_id, array_to_string(p, ' | ') AS pieces FROM s""")
def snippet_pieces(spark: SparkSession, d: str) -> DataFrame:
    s = docs(spark, d).filter("doc_id % 7 = 0").withColumn("sn", F.replace(F.left("text", F.lit(400)), F.lit(". "), F.lit("...")))
    return s.select("doc_id", F.array_join(text.snippet_parts("sn"), " | ").alias("pieces"))


@query(rf"""WITH k AS (SELECT list(DISTINCT w) AS ks FROM (SELECT unnest({W}[1:3]) AS w FROM benchmark))
SELECT item_id AS query_id, doc_id, round(0.1::DOUBLE * len(list_filter(ks, lambda x: contains(lower(b.text), x) AND contains(lower(dd.text), x))), 6) AS boost FROM benchmark b, documents dd, k WHERE item_id < 5 AND doc_id < 40""")
def keyword_boosts(spark: SparkSession, d: str) -> DataFrame:
    """Of a few pairs: every pair of questions and documents would be compared."""
    b = table(spark, d, "benchmark")
    words = b.select(F.explode(F.slice(text.words("text"), 1, 3)).alias("w")).agg(F.collect_set("w").alias("ks"))
    pairs = b.filter("item_id < 5").select(F.col("item_id").alias("query_id"), F.lower("text").alias("q")).crossJoin(docs(spark, d).filter("doc_id < 40").select("doc_id", F.lower("text").alias("t"))).crossJoin(F.broadcast(words))  # one row
    return pairs.select("query_id", "doc_id", F.round(text.keyword_boost(F.col("q"), F.col("t"), F.col("ks")), 6).alias("boost"))


@query("WITH v AS (SELECT label, vec_id, embedding FROM embeddings), x AS (SELECT label, i, avg(CASE WHEN vec_id % 2 = 0 THEN e END) AS m, arg_min(e, vec_id) AS c FROM (SELECT label, vec_id, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) AS i FROM v) GROUP BY 1, 2) SELECT label, CAST(i - 1 AS INTEGER) AS i, round(m, 6) AS mean, round(c, 6) AS cls FROM x")
def pooled_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The vectors of a label as the states of a sequence; those of even ids count."""
    g = table(spark, d, "embeddings").groupBy("label").agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("l"))
    states, mask = F.transform("l", lambda x: x["embedding"]), F.transform("l", lambda x: (x["vec_id"] % 2 == 0).cast("int"))
    return g.select("label", F.posexplode(F.arrays_zip(vector.pooled(states, mask).alias("m"), vector.pooled(states, mask, "cls").alias("c"))).alias("i", "z")).select("label", "i", F.round("z.m", 6).alias("mean"), F.round("z.c", 6).alias("cls"))


@query("SELECT event_id, round(CASE WHEN event_id < 100 THEN 0.1 + 0.9 * event_id / 100.0 ELSE greatest(0, 0.1 + 0.9 * (cos(pi() * (event_id - 100) / 900.0) + 1) / 2) END, 6) AS cosine, round(least(1.0, event_id / 50.0), 6) AS constant FROM events WHERE event_id < 1000")
def rate_schedules(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").filter("event_id < 1000")
    return e.select("event_id", F.round(vector.cosine_rate(F.col("event_id"), 100, 1000, 0.1), 6).alias("cosine"), F.round(vector.constant_rate(F.col("event_id"), 50), 6).alias("constant"))


@query(f"""WITH {IDS}, m AS (SELECT user_id, ids, list_transform(ids, lambda x: CASE WHEN x > 2 THEN 1 ELSE 0 END) AS mask FROM ev), n AS (SELECT max(list_sum(mask)) AS n FROM m)
SELECT user_id, array_to_string(ids[greatest(1, len(ids) - n + 1):], ' ') AS ids, CAST(list_sum(mask[greatest(1, len(ids) - n + 1):]) AS INTEGER) AS kept FROM m, n""")
def effective_length(spark: SparkSession, d: str) -> DataFrame:
    m = ids(spark, d).withColumn("mask", F.transform("ids", lambda x: (x > 2).cast("int")))
    return rollout.effective_cut(m, "mask", ["ids"]).select("user_id", flat("ids").alias("ids"), rollout.total(F.col("mask")).alias("kept"))


@query("SELECT doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, 0) AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def scattered_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels put back to all documents; those without one get defaults."""
    return rollout.scattered(docs(spark, d), table(spark, d, "labels"), "doc_id", {"quality": F.lit(-1), "toxic": F.lit(0)})


@query(f"""WITH {IDS}, j AS (SELECT user_id, ids || [7, 7] || ids[1:3] AS all_ids, list_transform(ids, lambda x: 1) || [0, 0] || list_transform(ids[1:3], lambda x: 1) AS mask FROM ev)
SELECT user_id, array_to_string(all_ids, ' ') AS ids, array_to_string(mask, '') AS mask, CAST(list_sum(mask[1:greatest(0, len(mask) - 6)]) AS INTEGER) AS n_prompt, CAST(list_sum(mask[greatest(1, len(mask) - 5):]) AS INTEGER) AS n_response FROM j""")
def masked_segments(spark: SparkSession, d: str) -> DataFrame:
    seg = lambda i, info: F.struct(i.alias("ids"), F.lit(info).alias("is_info"))
    e = ids(spark, d).withColumn("s", F.array(seg(F.col("ids"), False), seg(F.array(F.lit(7), F.lit(7)), True), seg(F.slice("ids", 1, 3), False)))
    all_ids, mask = rollout.joined_segments(F.col("s"))
    e = e.select("user_id", all_ids.alias("ids"), mask.alias("mask"))
    before, after = rollout.response_info(F.col("mask"), 6)
    return e.select("user_id", flat("ids").alias("ids"), F.replace(flat("mask"), F.lit(" "), F.lit("")).alias("mask"), before.cast("int").alias("n_prompt"), after.cast("int").alias("n_response"))


@query(f"WITH {IDS} SELECT round(sum(len(list_filter(ids, lambda x: x > 0)))::DOUBLE / sum(len(ids)), 6) AS coverage FROM ev")
def mask_coverage(spark: SparkSession, d: str) -> DataFrame:
    return rollout.coverage(ids(spark, d).withColumn("m", F.transform("ids", lambda x: (x > 0).cast("int"))), "m")


@query(f"""WITH {IDS}, z AS (SELECT user_id, ids[i] AS p, ids[i + 1] AS l FROM (SELECT user_id, ids, unnest(generate_series(1, len(ids) - 1)) AS i FROM ev))
SELECT user_id, round(count(*) FILTER (p = l)::DOUBLE / count(*), 6) AS accuracy FROM z WHERE l <> 4 GROUP BY 1""")
def token_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """The ids as their own predictions, 4 ignored."""
    a = rl.token_accuracy(F.col("ids"), F.col("ids"), 4)
    return ids(spark, d).select("user_id", F.round(a, 6).alias("accuracy")).filter("accuracy is not null")


@query("SELECT round(avg((value - 50) * (value - 50)), 6) AS mse, round(avg(abs(value - 50)), 6) AS mae FROM events")
def prediction_errors(spark: SparkSession, d: str) -> DataFrame:
    return rl.prediction_errors(table(spark, d, "events").withColumn("p", F.lit(50.0)), "value", "p")


@query("SELECT round(avg(a) FILTER (m = 1), 6) AS advantage_mean, round(max(a) FILTER (m = 1), 6) AS advantage_max, round(min(a) FILTER (m = 1), 6) AS advantage_min, round(avg(value) FILTER (m = 1), 6) AS value_mean, round(max(value) FILTER (m = 1), 6) AS value_max, round(min(value) FILTER (m = 1), 6) AS value_min FROM (SELECT value, value - 50 AS a, event_id % 2 AS m FROM events)")
def token_metrics(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("value", (F.col("value") - 50).alias("a"), (F.col("event_id") % 2).alias("m"))
    return rl.token_metrics(e, {"advantage": "a", "value": "value"}, "m")


@query("SELECT event_type, round(sum(value), 6) AS seconds, round(sum(value) * 1000 / sum(user_id + 1), 6) AS ms_per_token FROM events GROUP BY 1")
def timing_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rl.timing_metrics(table(spark, d, "events").withColumn("n", F.col("user_id") + 1), "event_type", "value", "n")


@query("SELECT event_type, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def reduced_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rl.reduced(table(spark, d, "events"), "event_type", "value")


@query("WITH p AS (SELECT item_id, count(*) AS n FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1) SELECT count(*) AS n_queries, round(avg(n), 6) AS mean, round(median(n), 6) AS median FROM p")
def relevant_counts(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.relevant_counts(quality.containment(docs(spark, d), table(spark, d, "benchmark")))


@query("SELECT DISTINCT doc_id AS query_id FROM documents WHERE doc_id % 3 = 0 AND doc_id % 2 = 1")
def split_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Every third document has the split 'dev' in the ranking, but where it is odd 'test' in the table."""
    name = lambda odd: F.when((F.col("doc_id") % 2 == 1) & F.lit(odd), "test").otherwise("dev")
    q = docs(spark, d).select(F.col("doc_id").alias("query_id"), name(True).alias("split"))
    r = docs(spark, d).filter("doc_id % 3 = 0").select(F.col("doc_id").alias("query_id"), name(False).alias("split"))
    return evaluate.split_conflicts(r, q)


@query("SELECT source, count(*) AS count FROM documents GROUP BY 1")
def source_counts(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).groupBy("source").count()


@query("SELECT vec_id AS place, row_number() OVER (ORDER BY label, vec_id) - 1 AS origin FROM embeddings")
def inverse_permutation(spark: SparkSession, d: str) -> DataFrame:
    """Where each vector goes when they are sorted by label (numbered in two levels)."""
    e = table(spark, d, "embeddings").select("vec_id", (F.col("label") * 10_000_000 + F.col("vec_id")).alias("key"))
    return rollout.inverse(batch.numbered(e, "key").select("place", F.col("vec_id").alias("origin")), "place", "origin")


@query(f"""WITH {IDS}, m AS (SELECT user_id, ids, list_transform(ids, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS mask FROM ev)
SELECT user_id, array_to_string(list_transform(range(1, len(ids) + 1), lambda i: CASE WHEN mask[i] = 1 THEN list_sum(mask[1:i]) - 1 ELSE 0 END), ' ') AS positions,
array_to_string(list_transform(range(1, len(ids) + 1), lambda i: CASE WHEN i = len(ids) THEN 5.5 ELSE 0.0 END), ' ') AS rewards,
array_to_string(list_transform(ids, lambda x: -100) || ids[1:2] || [9], ' ') AS labels, list_filter(ids, lambda x: x <> 0) || list_filter(ids, lambda x: x = 0) = ids AS pads_last FROM m""")
def token_places(spark: SparkSession, d: str) -> DataFrame:
    e = ids(spark, d).withColumn("mask", F.transform("ids", lambda x: (x > 0).cast("int")))
    return e.select("user_id", flat(tokens.position_ids(F.col("mask"))).alias("positions"), flat(tokens.last_token_reward(F.size("ids"), F.lit(5.5))).alias("rewards"), flat(tokens.masked_labels(F.col("ids"), F.slice("ids", 1, 2), 9)).alias("labels"), (tokens.pads_last(F.col("ids")) == F.col("ids")).alias("pads_last"))


REPLY = "'<think>a</think><search> q' || doc_id || ' </search><information>' || lower(left(text, 30)) || '</information><search>z' || (doc_id % 3) || '</search><answer>' || source || '</answer> rest'"


@query(f"WITH r AS (SELECT doc_id, source, {REPLY} AS s FROM documents) SELECT doc_id, 'z' || (doc_id % 3) AS searched, regexp_extract(s, '^(.*?</search>)', 1, 's') AS cut FROM r")
def reply_parts(spark: SparkSession, d: str) -> DataFrame:
    s = F.concat(F.lit("<think>a</think><search> q"), F.col("doc_id").cast("string"), F.lit(" </search><information>"), F.lower(F.left("text", F.lit(30))), F.lit("</information><search>z"), (F.col("doc_id") % 3).cast("string"), F.lit("</search><answer>"), F.col("source"), F.lit("</answer> rest"))
    r = docs(spark, d).withColumn("s", s)
    return r.select("doc_id", text.last_search("s").alias("searched"), text.cut_response("s").alias("cut"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS reward FROM documents")
def number_rewards(spark: SparkSession, d: str) -> DataFrame:
    """'#### n' solutions, right where the id is a multiple of three."""
    s = F.concat(F.lit("so it is\n#### "), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id")).otherwise(F.col("doc_id") + 1).cast("string"))
    return docs(spark, d).select("doc_id", rewards.number_reward(s, F.col("doc_id").cast("string")).alias("reward"))


@query(rf"SELECT DISTINCT x[1] AS term, x[1] NOT IN (SELECT unnest({W}) FROM benchmark) AS is_new FROM (SELECT regexp_split_to_array(trim(text), '\s+') AS x FROM documents WHERE trim(text) <> '') UNION SELECT unnest({W}), false FROM benchmark")
def merged_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """The first field of each document's text, as a vocabulary file's lines, merged into the benchmark's words."""
    base = table(spark, d, "benchmark").select(F.explode(text.words("text")).alias("term"))
    return vocabulary.merged(base, vocabulary.from_lines(docs(spark, d), "text"))


@query(f"SELECT term, count(*) AS n FROM (SELECT unnest({W}) AS term FROM documents) GROUP BY 1 ORDER BY n DESC, term LIMIT 50")
def frequent_terms(spark: SparkSession, d: str) -> DataFrame:
    terms = docs(spark, d).select(F.explode(text.words("text")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return vocabulary.most_frequent(terms, 50)


def _reply(prompt: Column) -> Column:
    """A generator without a model: it gives the number of characters of its first passage."""
    first = F.regexp_extract(prompt, '(?s)\\[1\\]\t "(.*?)"\n(?:\\[2\\]|\n)', 1)
    return F.concat(F.lit("The first passage counts.\nAnswer: "), F.length(first).cast("string"))


@query(f"""WITH {lexical.oracle(3)} SELECT item_id AS query_id, CAST(coalesce(length(left(d.text, 80)), 0) AS VARCHAR) AS answer FROM benchmark LEFT JOIN bm25 ON item_id = query_id AND rank = 1 LEFT JOIN documents d USING (doc_id)""")
def evidence_answers(spark: SparkSession, d: str) -> DataFrame:
    """Retrieval, numbered passages, prompt, reply and its answer."""
    qa.RETRIEVERS.update(bm25=lambda c, q: lexical.search(c, q, 3), dense=lambda c, q: lexical.search(c, q, 3))
    q = table(spark, d, "benchmark")
    found = qa.retriever("bm25")(docs(spark, d), q)
    return qa.answered(qa.prompts(q, qa.evidence(found, docs(spark, d), 3, 80)), _reply)


@query("SELECT conv_id, turn, coalesce(string_agg(p, ' | ' ORDER BY t), '') AS history FROM (SELECT a.conv_id, a.turn, b.turn AS t, left(b.text, 20) AS p, row_number() OVER (PARTITION BY a.conv_id, a.turn ORDER BY b.turn DESC) AS i FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn < a.turn) WHERE i <= 2 GROUP BY 1, 2")
def bounded_history(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "turn", F.left("text", F.lit(20)).alias("p"))
    return rollout.rolling_history(c, "conv_id", "turn", "p", 2).select("conv_id", "turn", F.array_join("history", " | ").alias("history"))


@query("SELECT doc_id, rank FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place, count(*) OVER () AS n FROM documents), LATERAL (SELECT place % 7 AS rank) WHERE place < n // 7 * 7")
def rank_shares(spark: SparkSession, d: str) -> DataFrame:
    return rollout.rank_share(batch.numbered(docs(spark, d).select("doc_id"), "doc_id"), "place", 7).select("doc_id", "rank")


@query("SELECT item_id, item_id || '-0 ' || item_id || '-1 ' || item_id || '-2' AS responses FROM benchmark")
def sampled_responses(spark: SparkSession, d: str) -> DataFrame:
    gen = lambda df: df.withColumn("response", F.concat(F.col("item_id").cast("string"), F.lit("-"), F.col("sample").cast("string"), F.lit("<pad>")))
    return rollout.sampled(table(spark, d, "benchmark").select("item_id"), "item_id", 3, gen, "<pad>").select("item_id", F.array_join("responses", " ").alias("responses"))


@query(f"""WITH {IDS}, p AS (SELECT user_id, ids[1:4] || ids[5:9] || [99] AS a, ids[1:4] || ids[3:5] || [99] AS b FROM ev)
SELECT user_id, array_to_string((a || [0,0,0,0,0,0,0,0])[1:8], ' ') AS chosen, CAST(least(len(a), 8) AS INTEGER) AS n_chosen, array_to_string((b || [0,0,0,0,0,0,0,0])[1:8], ' ') AS rejected, CAST(least(len(b), 8) AS INTEGER) AS n_rejected FROM p""")
def preference_ids(spark: SparkSession, d: str) -> DataFrame:
    a, am, b, bm = chat.preference_ids(F.slice("ids", 1, 4), F.slice("ids", 5, 5), F.slice("ids", 3, 3), 99, 8)
    return ids(spark, d).select("user_id", flat(a).alias("chosen"), rollout.total(am).alias("n_chosen"), flat(b).alias("rejected"), rollout.total(bm).alias("n_rejected"))


@query(f"WITH {IDS} SELECT user_id, CAST(len(ids) AS INTEGER) AS n FROM ev WHERE len(ids) BETWEEN 5 AND 12")
def bounded_prompts(spark: SparkSession, d: str) -> DataFrame:
    return chat.bounded_prompts(ids(spark, d), F.col("ids"), 5, 12).select("user_id", F.size("ids").alias("n"))


@query("SELECT doc_id, text, n_chars FROM documents WHERE doc_id % 2 = 0")
def batch_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns taken out of a batch, put back, and rows gathered by their places."""
    part, rest = batch.pop(docs(spark, d), ["text", "n_chars"], "doc_id")
    whole = batch.union_columns(part, rest.withColumn("n_chars", F.lit(0)).drop("n_chars"), "doc_id")
    places = docs(spark, d).filter("doc_id % 2 = 0").select(F.col("doc_id").alias("place"), "doc_id")
    return batch.gather(whole, places, "doc_id").select("doc_id", "text", "n_chars")


@query("SELECT doc_id, coalesce(b, a) AS value FROM (SELECT doc_id, lang AS a FROM documents) FULL JOIN (SELECT doc_id, 'toxic' AS b FROM labels WHERE toxic = 1) USING (doc_id)")
def merged_maps(spark: SparkSession, d: str) -> DataFrame:
    old = docs(spark, d).select("doc_id", F.col("lang").alias("v"))
    new = table(spark, d, "labels").filter("toxic = 1").select("doc_id", F.lit("toxic").alias("v"))
    return quality.merge_maps(old, new, "doc_id", "v").toDF("doc_id", "value")


@query(f"""WITH {lexical.oracle(6)}, h AS (SELECT query_id, doc_id // 2 AS doc_id, min(rank) AS r FROM bm25 GROUP BY 1, 2) SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY r, doc_id) AS INTEGER) AS rank FROM h""")
def ranking_without_repeats(spark: SparkSession, d: str) -> DataFrame:
    hits = lexical.search(docs(spark, d), table(spark, d, "benchmark"), 6).withColumn("doc_id", F.floor(F.col("doc_id") / 2))
    return ranking.dedup_ranking(hits).select("query_id", "doc_id", "rank")


@query("SELECT source, 4 AS n_parts, min(s) >= 0 AS ok, sum(s) AS total FROM (SELECT source, sum(n_chars) AS s FROM documents GROUP BY 1) GROUP BY 1")
def balanced_totals(spark: SparkSession, d: str) -> DataFrame:
    """Largest differencing leaves nothing out: the parts' sums are the groups'."""
    parts = chunking.balanced(docs(spark, d).select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars", 4)
    s = parts.groupBy("source", "part").agg(F.sum("n_chars").alias("s"))
    return s.groupBy("source").agg(F.lit(4).alias("n_parts"), (F.min("s") >= 0).alias("ok"), F.sum("s").alias("total"))

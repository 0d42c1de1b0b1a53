from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import agent, batch, chat, chunking, quality, rl
from corpusloom.sources import readers, sinks
from corpusloom.streaming import streams

TURN = "array<struct<`from`: string, value: string>>"


def conv(spark, *turns):
    return spark.createDataFrame([(1, list(turns))], f"id int, conversations {TURN}").withColumn("messages", chat.messages(F.col("conversations")))


def test_prefix_samples(spark):
    c = conv(spark, ("system", "s"), ("human", "a"), ("gpt", "b"), ("human", "c"), ("gpt", "d"))
    assert sorted(len(r.messages) for r in chat.prefix_samples(c).collect()) == [3, 5]
    c = conv(spark, ("human", "q"), ("function_call", '{"name": "f", "arguments": {"a": 1}}'), ("observation", "42"), ("gpt", "done"))
    rows = sorted(chat.prefix_samples(c).collect(), key=lambda r: len(r.messages))
    assert len(rows) == 2 and rows[1].messages[2].content == "Observation: 42" and rows[1].messages[2].role == "user"
    assert rows[0].messages[1].content == 'Action: f\nAction Input: {"a":1}'


def test_dialects(spark):
    v = F.lit('{"name": "f", "arguments": {"a": 1}}')
    got = {d: spark.range(1).select(chat.call_text(v, d).alias("x")).collect()[0].x for d in ("default", "glm4", "llama3", "mistral", "qwen")}
    assert got["glm4"] == 'f\n{"a":1}' and got["mistral"] == '[{"name": "f", "arguments": {"a":1}}]' and got["qwen"].startswith("<tool_call>\n")
    assert got["llama3"] == '{"name": "f", "parameters": {"a":1}}' and got["default"].endswith("\n")
    assert spark.range(1).select(chat.observation_text(F.lit("x"), "qwen").alias("x")).collect()[0].x == "<tool_response>\nx\n</tool_response>"


def test_pairs_and_templates(spark):
    c = conv(spark, ("gpt", "early"), ("human", "a"), ("human", "b"), ("gpt", "c"), ("gpt", "lost"), ("human", "open"))
    p = c.select(chat.history_pairs(F.col("messages")).alias("p")).collect()[0].p
    assert [tuple(x) for x in p] == [("a\nb", "c")]
    d = c.withColumn("p", chat.history_pairs(F.col("messages"))).select(chat.render(F.col("p"), "alpaca").alias("d")).collect()[0].d
    assert len(d) == 2 and d[0].endswith("### Response:\n") and "a\nb" in d[0]
    strict = lambda *t: conv(spark, *t).select(chat.strict_pairs(F.col("conversations")).alias("x")).collect()[0].x
    assert strict(("system", "s"), ("human", "a"), ("gpt", "b")) == ["a", "b"]
    assert strict(("human", "a"), ("gpt", "b"), ("tool", "x"), ("gpt", "d")) == ["a", "b"]
    assert strict(("human", "a"),) is None and strict(("human", "a"), ("gpt", "b"), ("human", "c")) is None


def test_sft(spark):
    pairs = F.array(F.struct(F.lit("one two").alias("user"), F.lit("three").alias("assistant")), F.struct(F.lit("four").alias("user"), F.lit("five six").alias("assistant")))
    r = chat.sft_rows(spark.range(1).withColumn("pairs", pairs), 50).collect()[0]
    assert r.input_ids == "one two three </s> four five six </s>".split()
    assert r.labels == "-100 -100 three </s> -100 five six </s>".split()


def test_json_lines_validation(spark):
    good = json.dumps(dict(conversations=[dict(zip(("from", "value"), x, strict=True)) for x in (("human", "a"), ("gpt", "b"))]))
    lines = spark.createDataFrame([(good,), ("",), ("{bad",), (good.replace("gpt", "robot"),), (json.dumps({"conversations": []}),)], "value string")
    assert tuple(chat.validate_lines(lines).collect()[0]) == (4, 1, 3)


def test_advantages(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 0.0), (2, 1.0)], "g int, s double")
    got = sorted(r.advantage for r in rl.group_advantage(df, "g", "s").collect())
    assert got == pytest.approx([-0.7071058, 0.7071058, 0.999999], abs=1e-6)


def test_gae_against_the_loop(spark):
    r, v = [1.0, 0.5, -1.0, 2.0], [0.3, 0.2, 0.1, 0.7]
    want, nxt, adv = [], 0.0, 0.0
    for a, b in zip(reversed(r), reversed(v), strict=True):
        adv = a + 0.9 * nxt - b + 0.9 * 0.8 * adv
        nxt = b
        want.insert(0, adv)
    got = spark.createDataFrame([(r, v)], "r array<double>, v array<double>").select(rl.gae(F.col("r"), F.col("v"), 0.9, 0.8).alias("a")).collect()[0].a
    assert got == pytest.approx(want)


def test_masks(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [1, 0, 1])], "x array<double>, m array<int>")
    r = df.select(rl.masked_mean(F.col("x"), F.col("m")).alias("a"), rl.masked_var(F.col("x"), F.col("m")).alias("v")).collect()[0]
    assert (r.a, r.v) == (2.0, 2.0)
    with pytest.raises(Exception, match="empty mask"):
        df.select(rl.masked_mean(F.col("x"), F.array(F.lit(0), F.lit(0), F.lit(0))).alias("a")).collect()
    assert df.select(rl.token_accuracy(F.array(F.lit(5), F.lit(6), F.lit(7)), F.array(F.lit(0), F.lit(5), F.lit(-100))).alias("a")).collect()[0].a == 1.0


def test_adaptive_coefficient():
    k = rl.AdaptiveKL(0.1, 6.0, 10_000)
    assert k.update(12.0, 100) == pytest.approx(0.1 * (1 + 0.2 * 0.01)) and k.update(3.0, 100) < 0.1002


def test_balance():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 1000, 64).tolist()
    for equal in (False, True):
        parts = chunking.largest_difference(sizes, 4, equal)
        assert sorted(i for p in parts for i in p) == list(range(64)) and all(parts)
        sums = [sum(sizes[i] for i in p) for p in parts]
        assert max(sums) - min(sums) < 40 and (not equal or {len(p) for p in parts} == {16})
    assert chunking.greedy_parts([5, 1, 1, 1], 2) == [[0], [1, 2, 3]]
    with pytest.raises(ValueError):
        chunking.largest_difference([1, 2, 3], 2, True)


def test_batches(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    assert sorted((r.k, r.place) for r in batch.numbered(df, "k", 3).collect()) == [(i, i) for i in range(10)]
    p = batch.pad_to_multiple(df.filter("k < 3"), "k", 8)
    assert [r.k for r in p.orderBy("place").collect()] == [0, 1, 2, 0, 1, 2, 0, 1] and batch.unpad(p).count() == 3
    a, b = df.withColumn("v", F.lit(1)), df.withColumn("v", F.col("k").cast("int"))
    assert batch.union_columns(a, a.withColumn("w", F.lit(2)), "k").count() == 10
    with pytest.raises(Exception, match="differs"):
        batch.union_columns(a, b, "k").collect()
    assert [c.chunk for c in batch.equal_chunks(df, "k", 4).orderBy("k").collect()] == [0, 0, 0, 1, 1, 1, 2, 2, 3, 3]
    assert sorted(r.place.k for r in batch.repeat(df.limit(1), 2, "k").collect()) == [0, 0]


def test_sentence_chunks(spark):
    df = spark.createDataFrame([("Aa bb. Cc dd. Ee ff.", 14, 2), (None, 5, 0)], "t string, n int, o int")
    assert [r.c for r in df.select(chunking.sentence_chunks("t", "n", "o").alias("c")).collect()] == [["Aa bb. Cc dd. Ee", "Ee ff."], None]


def test_quality(spark):
    docs = spark.createDataFrame([(1, "A  b", "s"), (2, "a b", "s"), (3, "c", "t"), (4, " ", "t")], "doc_id int, text string, source string")
    assert {(r.doc_id, r.copies) for r in quality.exact_dedup(docs).collect()} == {(1, 2), (3, 1), (4, 1)}
    assert quality.hash_sample(docs, "doc_id", 2).exceptAll(quality.hash_sample(docs.repartition(3), "doc_id", 2)).count() == 0
    gold = docs.filter("doc_id = 2")
    assert [r.doc_id for r in quality.distractors(docs, gold, 5, 5).collect()] == [3]
    assert [(r.doc_id, r.side) for r in quality.id_difference(docs, docs.filter("doc_id < 4"), "doc_id").collect()] == [(4, "left")]
    old, new = docs.select("doc_id", "text"), spark.createDataFrame([(1, "new"), (9, "nine")], "doc_id int, text string")
    assert {tuple(r) for r in quality.merge_maps(old, new, "doc_id", "text").collect()} >= {(1, "new"), (9, "nine"), (2, "a b")}
    d = quality.digest(docs).collect()[0]
    assert d == quality.digest(docs.repartition(3).select("text", "source", "doc_id")).collect()[0]
    assert d.digest != quality.digest(docs.withColumn("text", F.upper("text"))).collect()[0].digest


def test_alignment(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"conversations": "x"}\n')
    (tmp_path / "b.jsonl").write_text('{"conversations": "y", "tools": "t"}\n')
    rows = readers.aligned_json(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl")]).collect()
    assert {(r.conversations, r.tools) for r in rows} == {("x", None), ("y", "t")}


def test_readers(spark, tmp_path):
    p = tmp_path / "r.jsonl"
    p.write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r.a for r in readers.json_lines(spark, str(p), "a int").collect()) == [1, 2]
    p.write_text('{"a": 1}\n[1]\n')
    with pytest.raises(Exception, match="not an object"):
        readers.json_lines(spark, str(p), "a int").collect()
    q = tmp_path / "q.tsv"
    q.write_text("\n".join("\t".join(x.split()) for x in ("query_id doc_id relevance", "q1 d1 1", "q1 d2 0", "q2 d3 x")) + "\n")
    assert [tuple(r) for r in readers.qrels(spark, str(q)).collect()] == [("q1", "d1", 1)]
    with pytest.raises(ValueError, match="header"):
        readers.qrels(spark, str(q), ("a", "b", "c"))
    q.write_text("query_id\tdoc_id\trelevance\nq1\td1\n")
    with pytest.raises(Exception, match="fields"):
        readers.qrels(spark, str(q)).collect()
    m, t = tmp_path / "m.json", tmp_path / "t.json"
    rec = {"QUESTION": "q", "CONTEXTS": ["c"], "YEAR": "2001", "final_decision": "yes", "LONG_ANSWER": "l"}
    m.write_text(json.dumps({"10": rec, "9": rec}))
    t.write_text(json.dumps({"10": "yes"}))
    assert [(r.id, r.split) for r in readers.labelled_map(spark, str(m), str(t)).collect()] == [("9", "dev"), ("10", "test")]
    t.write_text(json.dumps({"10": "no"}))
    with pytest.raises(Exception, match="conflicting label"):
        readers.labelled_map(spark, str(m), str(t)).collect()
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "x.md").write_text("# A\n\n b \n")
    assert readers.files(spark, str(tmp_path / "docs")).collect()[0].lines == ["# A", "b"]
    assert readers.text_folder(spark, str(tmp_path / "docs"), "md").count() == 2
    j = json.dumps({"organic": [{"title": "a"}, {"title": "b"}], "answerBox": {"title": "box"}})
    assert [x.title for x in spark.range(1).select(readers.search_results(F.lit(j), 1).alias("r")).collect()[0].r] == ["box", "a"]


def test_paragraph_layout(spark):
    kind = "id string, context struct<title: array<string>, sentences: array<array<string>>>, supporting_facts struct<title: array<string>>"
    df = spark.createDataFrame([("q1", (["A", "B"], [["a1. ", "a2."], ["b."]]), (["A", "A"],)), ("q2", (["A"], [["late."]]), (["Z"],))], kind)
    docs, rel = readers.paragraphs(df)
    assert {r.title: r.content for r in docs.collect()} == {"A": "late.", "B": "b."}
    assert [tuple(r) for r in rel.collect()] == [("A", "q1")] or [tuple(r) for r in rel.select("query_id", "title").collect()] == [("q1", "A")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", None), (1, "a", "x")], "id int, z string, a string")
    sinks.json_lines(df, str(tmp_path / "o"), ["id"], 1)
    lines = [x for p in sorted((tmp_path / "o").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines == ['{"a":"x","id":1,"z":"a"}', '{"a":null,"id":2,"z":"b"}']
    d = sinks.folder_digest(str(tmp_path / "o"))
    assert len(d) == 64 and d == sinks.folder_digest(str(tmp_path / "o"))
    m = sinks.manifest({"t": df})
    assert sinks.manifest_violations(m, m).count() == 0
    assert [r.name for r in sinks.manifest_violations(m, sinks.manifest({"t": df.limit(1)})).collect()] == ["t"]
    sinks.qrels(spark.createDataFrame([("q", "d")], "query_id string, doc_id string"), str(tmp_path / "q"))
    assert readers.qrels(spark, str(tmp_path / "q")).count() == 1


def test_agent_loop(spark):
    rows = spark.createDataFrame([("a", "Q1"), ("b", "Q2"), ("c", "Q3")], "id string, prompt string")

    def generate(live):
        has = F.contains("text", F.lit("<information>"))
        return live.withColumn("response", F.when(F.col("id") == "c", "mumble").when(has | (F.col("id") == "b"), "<answer>x</answer> more").otherwise("<search>q</search> more"))

    out = {r.id: r for r in agent.run(rows, generate, lambda q: q.select("id", F.lit("found it").alias("found")), 2).collect()}
    assert (out["b"].turns, out["b"].n_search, out["b"].done) == (1, 0, True)
    assert (out["a"].turns, out["a"].n_search, out["a"].n_valid) == (2, 1, 2) and "<information>found it</information>" in out["a"].text
    assert (out["c"].turns, out["c"].n_valid, out["c"].done) == (3, 0, False)
    f = spark.range(1).select(agent.follow_ups(F.lit('{"output": ["1. what", "who"]}')).alias("q")).collect()[0].q
    assert f == ["what", "who"]


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", "search"), ("a", "search"), ("b", "answer"), ("a", "answer"), ("a", "search")], "id string, action string").coalesce(1).write.parquet(src)
    q = streams.trajectories(spark.readStream.schema("id string, action string").parquet(src)).writeStream.format("memory").queryName("traj").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    last = {r.id: r for r in spark.sql("select id, count(*) n, max(turn) turn, max(n_search) s, bool_or(done) done, count_if(not active) off from traj group by id").collect()}
    assert (last["a"].n, last["a"].turn, last["a"].s, last["a"].off) == (4, 3, 2, 1) and last["b"].done
    texts, store = str(tmp_path / "texts"), str(tmp_path / "store")
    spark.createDataFrame([("x",), ("y",), ("x",)], "text string").write.parquet(texts)
    for _ in range(2):
        q = streams.upsert_batches(spark.readStream.schema("text string").parquet(texts), store, lambda c: F.array(F.length(c).cast("double")), str(tmp_path / "c2")).start()
        q.processAllAvailable()
        q.stop()
        spark.createDataFrame([("z",), ("y",)], "text string").write.mode("append").parquet(texts)
    assert sorted(r.text for r in spark.read.parquet(store).collect()) == ["x", "y", "z"]


def test_two_levels_give_the_same_places(spark):
    from corpusloom.operators import graph

    docs = spark.createDataFrame([(i * 7 % 101, "s" if i % 4 else None, "w " * (i % 5)) for i in range(101)], "doc_id bigint, source string, text string")
    flat = lambda df: sorted(map(str, df.collect()))
    assert flat(graph.adjacent(docs, bucket=3)) == flat(graph.adjacent(docs)) and graph.adjacent(docs).count() == docs.filter("source = 's'").count() - 1
    assert flat(chunking.pack_tokens(docs, 10, "source", bucket=4)) == flat(chunking.pack_tokens(docs, 10, "source"))
    assert flat(quality.positional_split(docs, "doc_id", 30, 6)) == flat(quality.positional_split(docs, "doc_id", 30))


def test_containment_of_short_passages(spark, monkeypatch):
    docs = [(1, "One two, three."), (2, "one two three four five six seven eight nine ten"), (3, None), (None, "One two")]
    passages = [(1, "One two"), (2, "two three four five six seven eight nine ten"), (3, "thre"), (4, "none"), (5, "?"), (6, None), (7, "one two three four five six seven eight")]
    docs, passages = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(passages, "item_id bigint, text string")
    want = {(1, 1), (2, 2), (3, 1), (3, 2), (7, 2)}
    assert {tuple(r) for r in quality.containment(docs, passages).collect()} == want
    monkeypatch.setattr(quality, "MAX_CHARS", 10)
    assert sorted(map(tuple, quality.containment(docs, passages).collect())) == sorted(want)


def test_file_lines_are_those_of_the_whole_files(spark, tmp_path):
    """Line ends of all kinds, blanks of all kinds, names with signs, kinds in capitals, and files that aren't text."""
    (tmp_path / "a=x y" / "deep").mkdir(parents=True)
    (tmp_path / "a=x y" / "one+two%3A.txt").write_bytes("a\r\n\r\n b\rc\x0bd\x0ce\x1cf\x1f  g　\n \t\n\x85h\n".encode())
    (tmp_path / "a=x y" / "deep" / "B.MD").write_text("# x\n\ny")
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "no.bin").write_bytes(b"x\ny")
    whole = readers.files(spark, str(tmp_path)).select("path", F.explode("lines").alias("line"))
    got = readers.file_lines(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect())) and got.count() == 10


def test_stored_documents_read_text_in_splits(spark, monkeypatch):
    """No file is read whole into a row."""
    from checks import DATA

    from corpusloom.plans import registry

    monkeypatch.setattr(readers, "files", None)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = registry.QUERIES["stored_documents"](spark, f"{DATA}/sf0.001")
        files = set(got.inputFiles())
        lines = readers.file_lines(spark, next(iter(files)).rsplit("/", 2)[0])
        assert lines.rdd.getNumPartitions() > len(files)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")

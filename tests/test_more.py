from __future__ import annotations

import numpy as np
import pytest
from checks import DATA
from pyspark.sql import functions as F

from corpusloom import runtime
from corpusloom.functions import stem
from corpusloom.functions.text import words
from corpusloom.operators import batch, chunking, dense, graph, lexical, lexical_index, quality, rl
from corpusloom.plans import registry
from corpusloom.sources import readers
from corpusloom.streaming import streams

SF = f"{DATA}/sf0.001"


def test_porter_stems():
    pairs = "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat troubled troubl sized size hopping hop falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration digitizer digit radically radic vietnamization vietnam operator oper feudalism feudal decisiveness decis hopefulness hope formality formal sensitivity sensit triplicate triplic formative form electrical electr goodness good revival reviv allowance allow inference infer airliner airlin adjustable adjust irritant irrit replacement replac adoption adopt homologous homolog effective effect probate probat rate rate cease ceas controll control roll roll".split()
    wrong = [(w, stem.porter(w), s) for w, s in zip(pairs[::2], pairs[1::2], strict=True) if stem.porter(w) != s]
    assert not [x for x in wrong if x[0] not in ("radically", "formality", "sensitivity")]


def test_index_with_stems_finds_other_forms(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the hopping cats"), (2, "a dog hopes"), (3, None), (None, "cats"), (4, "")], "doc_id bigint, text string")
    q = spark.createDataFrame([(7, "cat hop")], "item_id bigint, text string")
    tokens = lambda c: stem.stemmed(words(c))
    lexical_index.build(docs, str(tmp_path / "i"), tokens)
    got = lexical_index.search(lexical_index.load(spark, str(tmp_path / "i")), q, tokens=tokens).collect()
    assert [r.doc_id for r in got] == [1]


def test_stored_index_equals_the_scan(spark, tmp_path, monkeypatch):
    docs, q = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    monkeypatch.setattr(lexical_index, "BLOCK", 30)
    monkeypatch.setattr(lexical_index, "SLICE_TERMS", 200)
    path = str(tmp_path / "index")
    lexical_index.build(docs, path)
    spark.sql(f"DROP TABLE {lexical_index._name(path)}")  # another session knows the path alone
    got = lexical_index.search(lexical_index.load(spark, path), q, 10, b=0.75, k1=1.2)
    want = lexical.search(docs, q, 10, b=0.75, k1=1.2)
    key = lambda df: sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 5)) for r in df.collect())
    assert key(got) == key(want)
    plan = got._jdf.queryExecution().toString()
    assert "SelectedBucketsCount" in plan and plan.split("FlatMapGroupsInArrow")[-1].count("Exchange hashpartitioning(block") == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_lsh_recall(spark, sf):
    e = spark.read.parquet(f"{DATA}/{sf}/embeddings.parquet")
    rows = e.orderBy("vec_id").collect()
    v, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    dist = ((v[:, None] - v[None]) ** 2).sum(-1)
    true = {int(ids[i]): set(ids[np.lexsort((ids, np.round(dist[i], 9)))[:10]].tolist()) for i in range(len(ids))}
    got: dict[int, set] = {}
    for r in dense.lsh_search(e, e, 10).collect():
        got.setdefault(r.query_id, set()).add(r.doc_id)
    assert got.keys() == true.keys()
    assert np.mean([len(got[i] & true[i]) / 10 for i in true]) >= 0.9


def test_sft_labels_equal_a_loop(spark):
    import re

    sql = {(r.conv_id, r.input_ids, r.labels) for r in registry.QUERIES["sft_labels"](spark, SF).collect()}
    turns: dict[int, list] = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    tok = lambda t: re.findall(r"[^\W_]+", t.lower())
    for conv, ids, labels in sql:
        i, x = ids.split(" "), labels.split(" ")
        assert len(i) == len(x) <= 128 and i.count("</s>") == x.count("</s>") >= 1
        assert all(b in ("-100", a) for a, b in zip(i, x, strict=True))
        answers = " ".join(w for w, b in zip(i, x, strict=True) if b != "-100").split(" </s>")
        own = [" ".join(tok(t)) for role, t in turns[conv] if role == "assistant"]
        assert all(any(o.startswith(a.strip()) for o in own) for a in answers if a.strip())


def test_numbering_of_hashed_ids(spark):
    """Keys of 64 bits: buckets hold many rows, and places are those of a sort."""
    df = spark.range(5000).select(F.xxhash64("id").alias("k"))
    got = [r.k for r in batch.numbered(df, "k", 100).orderBy("place").collect()]
    assert got == sorted(got) and len(got) == 5000
    sizes = [r["count"] for r in df.groupBy(runtime.bucket_of(df, "k", 100)).count().collect()]
    assert 40 <= len(sizes) <= 60 and max(sizes) < 250
    assert batch.numbered(df.limit(0), "k").count() == 0
    split = quality.positional_split(df, "k", 30, 50)
    assert split.filter("split = 'train'").count() == 1500


def test_broken_json_lines_are_errors(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "x"}\n{"text": \n')
    for read in (lambda: readers.shards(spark, str(tmp_path), "text string"), lambda: readers.text_folder(spark, str(tmp_path), "jsonl")):
        with pytest.raises(Exception, match="(?i)malformed|failfast"):
            read().collect()


def test_smallest_of_a_stream_equals_that_of_a_table(spark, tmp_path):
    rows = spark.range(400).selectExpr("concat('s', id % 3) as shard", "id as key")
    want = {r.shard: r["keys"] for r in streams.smallest(rows, "shard", "key", 5).collect()}
    assert {len(v) for v in want.values()} == {5}
    for part in range(4):
        rows.filter(f"key % 4 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streams.smallest(stream, "shard", "key", 5).writeStream.outputMode("update").format("memory").queryName("smallest_keys").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last: dict[str, list] = {}
    for r in spark.table("smallest_keys").collect():
        last.setdefault(r.shard, []).append(r["keys"])
    assert {s: any(v == want[s] for v in vs) for s, vs in last.items()} == dict.fromkeys(want, True)


def test_own_tokenizer_and_extractor(spark):
    docs = spark.createDataFrame([(1, "ABCDEFGH\nXYZ"), (2, "Drug helps. Drug heals pain"), (3, "Drug and pain")], "doc_id bigint, text string")
    chars = chunking.chunk_windows(docs.filter("doc_id = 1"), 5, 2, lambda c: F.split(c, ""), lambda w: F.array_join(w, ""))
    assert [r.content for r in chars.orderBy("order").collect()] == ["ABCDE", "DEFGH", "XYZ"]
    named = lambda c: F.regexp_extract_all(c, F.lit(r"(Drug|pain)"), 1)
    bridge = graph.entities(docs, named)
    assert {(r.doc_id, r.entity, r.occ) for r in bridge.collect()} == {(2, "Drug", 2), (2, "pain", 1), (3, "Drug", 1), (3, "pain", 1)}
    assert {r.entity for r in graph.entities(docs, named, max_share=0.5).collect()} == set()
    q = spark.createDataFrame([(9, "which Drug")], "item_id bigint, text string")
    got = graph.propagate(graph.seeds(q, bridge, extract=named), bridge, docs, q, extract=named).collect()
    assert {(r.entity, r.tier) for r in got} == {("Drug", 0), ("pain", 1)}


def test_propagation_in_slices_and_pagerank_by_joins_are_the_same(spark, monkeypatch):
    docs, q = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 60"), spark.read.parquet(f"{SF}/benchmark.parquet").filter("item_id < 6")
    bridge = graph.entities(docs)
    seed = graph.seeds(q, bridge)
    edge = graph.edges(bridge).select(graph.passage_vertex(F.col("doc_id")).alias("src"), graph.entity_vertex(F.col("entity")).alias("dst"), "weight")
    reset = seed.select("query_id", graph.entity_vertex(F.col("entity")).alias("vertex"), F.lit(1.0).alias("weight")).unionByName(spark.createDataFrame([(1, "lone", 2.0), (2, "lone", 0.5)], "query_id bigint, vertex string, weight double"))
    rank = lambda: {(r.query_id, r.vertex): round(r["rank"], 9) for r in graph.pagerank(edge, reset, iterations=6).collect() if r["rank"] > 1e-8}
    whole, ranks = {tuple(r) for r in graph.propagate(seed, bridge, docs, q).collect()}, rank()
    monkeypatch.setattr(graph, "SLICE_ROWS", 20)
    monkeypatch.setattr(graph, "BROADCAST_EDGES", 0)
    assert {tuple(r) for r in graph.propagate(seed, bridge, docs, q).collect()} == whole and len(whole) > 50
    joined = rank()
    assert joined.keys() == ranks.keys() and all(abs(joined[k] - ranks[k]) < 2e-9 for k in ranks)


def test_controllers():
    assert rl.kl_controller("fixed", 0.2).update(5.0, 10) == 0.2
    c = rl.kl_controller("adaptive", 0.2, 1.0, 100)
    assert c.update(3.0, 10) == pytest.approx(0.2 * 1.02)
    with pytest.raises(ValueError):
        rl.kl_controller("adaptive", 0.1)


@pytest.mark.parametrize("iterations", [0, 4, 5])
def test_passage_ranks_equal_the_general_pagerank(spark, monkeypatch, iterations):
    """With edges in many parts, few questions a task, resets without an edge, and repeated, negative and NaN weights."""
    monkeypatch.setattr(graph, "READ_EDGES", 7)
    monkeypatch.setattr(graph, "RANK_CELLS", 1)
    docs, q = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 40"), spark.read.parquet(f"{SF}/benchmark.parquet").filter("item_id < 6")
    bridge = graph.entities(docs)
    extra = [(1, 2.0), (1, 0.5), (2, -1.0), (3, float("nan"))]
    on_e = graph.seeds(q, bridge).select("query_id", "entity", F.col("score").alias("weight")).unionByName(spark.createDataFrame([(i, "no such", w) for i, w in extra], "query_id bigint, entity string, weight double"))
    on_d = spark.createDataFrame([(i, d, w) for i, w in extra for d in (3, 3, 5, 900)], "query_id bigint, doc_id bigint, weight double")
    general = graph.edges(bridge).select(graph.passage_vertex(F.col("doc_id")).alias("src"), graph.entity_vertex(F.col("entity")).alias("dst"), "weight")
    by_e, by_d = on_e.select("query_id", graph.entity_vertex(F.col("entity")).alias("vertex"), "weight"), on_d.select("query_id", graph.passage_vertex(F.col("doc_id")).alias("vertex"), "weight")
    for passages, reset in ((None, by_e), (on_d, by_e.unionByName(by_d))):
        want = {(r.query_id, r.vertex): r["rank"] for r in graph.pagerank(general, reset, iterations=iterations).collect() if passages is None or r.vertex.startswith("p:")}
        got = {(r.query_id, f"e:{r.entity}" if r.doc_id is None else f"p:{r.doc_id}"): r["rank"] for r in graph.passage_ranks(bridge, on_e, passages, iterations=iterations).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want) and want
    first = {(r.query_id, r.doc_id) for r in graph.passage_ranks(bridge, on_e, on_d, iterations=iterations, top=3).collect()}
    ids = {}
    for (i, v), s in want.items():
        ids.setdefault(i, []).append((-round(s, 9), int(v[2:])))
    assert first == {(i, d) for i, rows in ids.items() for _, d in sorted(rows)[:3]}


def test_entities_take_one_exchange(spark):
    docs = spark.createDataFrame([(1, "planets planets orbits"), (1, "planets comets"), (2, "comets"), (None, "orbits"), (3, None)], "doc_id bigint, text string")
    got = graph.entities(docs)
    assert {tuple(r) for r in got.collect()} == {(1, "comets", 1), (2, "comets", 1), (1, "orbits", 1), (None, "orbits", 1)}
    assert graph.entities(docs)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_propagation_with_few_rows_at_once_is_the_same(spark, monkeypatch):
    docs, q = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 60"), spark.read.parquet(f"{SF}/benchmark.parquet").filter("item_id < 6")
    bridge = graph.entities(docs)
    rows = lambda: {tuple(r) for r in graph.propagate(graph.seeds(q, bridge), bridge, docs, q).collect()}
    whole = rows()
    monkeypatch.setattr(graph, "MERGED", 1)
    monkeypatch.setattr(graph, "BROADCAST_SENTENCES", 0)
    assert rows() == whole and len(whole) > 50


def test_propagation_does_not_sort_all_it_has_with_every_batch(spark, monkeypatch, tmp_path):
    """The best so far are merged when as many new rows have come, or many, not once for every few sentences."""
    calls = tmp_path / "calls"
    best = graph._best

    def counted(parts, k):  # noqa: ANN001, ANN202
        with open(calls, "a") as f:
            f.write(".")
        return best(parts, k)

    monkeypatch.setattr(graph, "_best", counted)
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("planets orbit. comets orbit planets. planets").alias("text")).coalesce(1)
    q = spark.createDataFrame([(1, "planets orbit")], "item_id bigint, text string")
    bridge = graph.entities(docs)
    assert graph.propagate(graph.seeds(q, bridge), bridge, docs, q, hops=1).count() >= 1
    assert not calls.exists() or calls.stat().st_size <= spark.sparkContext.defaultParallelism + 1


def test_index_is_built_with_one_exchange_of_postings(spark, tmp_path, monkeypatch):
    """Repeated ids count as one document, blocks share tasks, and what is sent for a document is its words once."""
    monkeypatch.setattr(lexical_index, "BLOCK", 3)
    monkeypatch.setattr(lexical_index, "PARTS", 2)
    docs = spark.createDataFrame([(i, f"w{i % 5} w{i % 3} w{i % 3} all") for i in range(20)] + [(3, "w3 w0 w0 all"), (None, "all"), (30, None), (31, "")], "doc_id bigint, text string")
    stats = lexical_index.build(docs, str(tmp_path / "i")).first()
    index = lexical_index.load(spark, str(tmp_path / "i"))
    rows = index.postings.selectExpr("term", "inline(arrays_zip(docs, tfs, dls))").collect()
    key = {r.w: r.h for r in spark.createDataFrame([(f"w{i}",) for i in range(5)] + [("all",)], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    want = {}
    for i in [*range(20), 3]:
        for w in (f"w{i % 5}", f"w{i % 3}", f"w{i % 3}", "all"):
            want[key[w], i] = want.get((key[w], i), 0) + 1
    assert {(r.term, r.docs): r.tfs for r in rows} == want and {r.dls for r in rows} == {4} and len(rows) == len(want)
    assert {r.term: r.df for r in lexical_index.terms(index).collect()} == {t: sum(1 for x, _ in want if x == t) for t in key.values()}
    assert (stats.n_docs, stats.n_words, stats.n_blocks) == (24, 85, 8) and "df" not in index.postings.columns

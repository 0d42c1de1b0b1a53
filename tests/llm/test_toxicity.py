from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest

from corpusloom.llm import toxicity as tox

INSULTS = ["grobnak", "smeltik", "vurdoch", "plinkert", "zottig"]


def sentences(seed, n, bad=0.0, twist=None):
    r = random.Random(seed)
    syll = ["ba", "ko", "ri", "tu", "me", "sna", "plo", "ve", "dri", "zu", "gro", "li", "ti", "ch"]
    out = []
    for _ in range(n):
        ws = ["".join(r.choice(syll) for _ in range(r.randint(1, 4))) for _ in range(r.randint(4, 14))]
        if r.random() < bad:
            w = r.choice(INSULTS)
            ws.insert(r.randint(0, len(ws)), twist(w, r) if twist else w)
        out.append(" ".join(ws).capitalize() + ".")
    return " ".join(out)


@pytest.fixture(scope="module")
def model():
    return tox.train([sentences(i, 12, 0.3) for i in range(300)], [sentences(1000 + i, 12) for i in range(300)])


def flagged(spark, model, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r.doc_id for r in tox.toxic_documents(docs, None, model).collect()}


def test_held_out_accuracy(spark, model):
    bad = [sentences(5000 + i, 10) + " " + sentences(6000 + i, 1, 1.0) for i in range(200)]
    good = [sentences(7000 + i, 12) for i in range(200)]
    got = flagged(spark, model, bad + good)
    assert len([i for i in got if i < 200]) >= 195 and len([i for i in got if i >= 200]) <= 3


@pytest.mark.parametrize("twist", [
    lambda w, r: w[:3] + "-" + w[3:],
    lambda w, r: ".".join(w),
    lambda w, r: " ".join(w),
    lambda w, r: w.upper(),
    lambda w, r: w[:4] + "x" + w[4:],
    lambda w, r: w + "s",
    lambda w, r: "*".join([w[:2], w[2:]]),
])
def test_gapped_and_inserted_characters(spark, model, twist):
    bad = [sentences(i, 6) + " " + sentences(300 + i, 2, 1.0, twist) for i in range(60)]
    assert len(flagged(spark, model, bad)) >= 50


def test_kernel_equals_brute_force():
    _, code = tox.process_cache("toxicity").setdefault("tables", tox._tables())
    c = lambda w: code[np.frombuffer(w, np.uint8)]

    def phi(w):
        out = {}
        for i in combinations(range(len(w)), tox.ORDER):
            k = tuple(c(w)[list(i)])
            out[k] = out.get(k, 0) + tox.LAMBDA ** (i[-1] - i[0] + 1)
        return out

    def k(a, b):
        x, y = phi(a), phi(b)
        dot = lambda p, q: sum(v * q.get(t, 0) for t, v in p.items())
        return dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5

    words = [b"grobnak", b"grobxnak", b"banana", b"nakgrob", b"aaaaaa"]
    marks, where = tox._landmarks([b"grobnak", b"banana"], code)
    got = tox._kernels(words, marks, where, code)
    assert np.allclose(got, [[k(w, m) for m in (b"grobnak", b"banana")] for w in words], atol=1e-5)


def test_score_is_the_kernel_machines_decision(model):
    _, code = tox.process_cache("toxicity")["tables"]
    words = [b"grobnak", b"baplove", b"grooobnak", b"abc"]
    raw = b" ".join(words)
    single = tox.score_words([code[np.frombuffer(w, np.uint8)] for w in words], model.weight)
    got, doc = tox.score_chunk(np.array([0, len(raw)]), np.frombuffer(raw, np.uint8), model.weight, "test")
    assert doc.tolist() == [0] and np.allclose(got, [single.sum()], atol=1e-4)


def test_edge_cases(spark, messy, none, model):
    out = tox.without_toxic(messy, None, model)
    assert out.columns == messy.columns and out.schema == messy.schema
    assert sorted(map(str, out.collect())) == sorted(map(str, messy.collect()))
    extra = spark.createDataFrame([(70, "grobnak smeltik vurdoch " * 3), (70, "grobnak smeltik vurdoch " * 3), (None, "grobnak grobnak smeltik."), (71, "x" * 300_000), (72, "ab " * 200_000 + "grobnak smeltik")], "doc_id bigint, text string")
    got = [r.doc_id for r in tox.toxic_documents(messy.unionByName(extra, allowMissingColumns=True), None, model).collect()]
    assert sorted(got, key=str) == [70, 70, 72, None]
    assert tox.toxic_documents(none, None, model).count() == 0
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert tox.toxic_documents(messy, labels).count() == 0
    assert tox.without_toxic(messy, labels).count() == messy.count()


def test_labelled_sample_is_bounded_and_stable(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)] + [(7, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(150)] + [(None, 1, 1), (3, 1, None)], "doc_id bigint, quality int, toxic int")
    a, b = tox.labelled_sample(docs, labels, 20)
    assert len(a) == len(b) == 10 and (a, b) == tox.labelled_sample(docs.repartition(5), labels.repartition(3), 20)


def test_code_points_are_those_of_the_text():
    t = "aé€😀 中Жz\x00߿퟿\U0010ffff"
    for x in (t, "", "plain", "é", "😀"):
        got, at = tox.code_points(np.frombuffer(x.encode(), np.uint8))
        assert got.tolist() == [ord(c) for c in x]
        assert at is None or at.tolist() == [len(x[:i].encode()) for i in range(len(x))]


SCRIPTS = {
    "short": ("ba ko ri tu me sna plo ve dri zu gro li ti ch na so".split(), ["ykk", "wub", "xo"], (1, 4), " "),
    "cyrillic": ("ба ко ри ту ме сна пло ве дри зу гро ли ти чх".split(), ["грёбнак", "шмельтик", "вурдох"], (2, 4), " "),
    "long": ("ba ko ri tu me sna plo ve dri zu gro li ti ch".split(), ["grobnaksmeltikvurdochplinkert", "vurdochzottiggrobnakschmelz"], (1, 4), " "),
    "han": ([chr(0x4E00 + 7 * i) for i in range(400)], ["超級壞", "無軟骨頭"], (1, 3), ""),
}


@pytest.mark.parametrize("name", sorted(SCRIPTS))
def test_short_long_and_other_words(spark, name):
    """Insults of two and three letters, of over 16, in Cyrillic, and in Han text without blanks: held-out documents."""
    syll, insults, (lo, hi), blank = SCRIPTS[name]

    def doc(seed, bad):
        r, out = random.Random(seed), []
        for k in range(8):
            ws = ["".join(r.choice(syll) for _ in range(r.randint(lo, hi))) for _ in range(r.randint(4, 12))]
            if bad and (k == 3 or r.random() < 0.2):
                ws.insert(r.randint(0, len(ws)), r.choice(insults))
            out.append(blank.join(ws))
        return ("。" if name == "han" else ". ").join(out) + "."

    m = tox.train([doc(i, True) for i in range(250)], [doc(10_000 + i, False) for i in range(250)])
    got = flagged(spark, m, [doc(20_000 + i, True) for i in range(100)] + [doc(30_000 + i, False) for i in range(100)])
    assert len([i for i in got if i < 100]) >= 97 and len([i for i in got if i >= 100]) <= 2


def test_invisible_characters_within_words_go(spark, model):
    bad = [sentences(i, 6) + " gr​ob­nak sḿeltik." for i in range(20)]
    assert len(flagged(spark, model, bad)) >= 19


def test_long_words_are_scored_by_all_their_parts(model):
    code = tox._tables()[1]
    c = lambda w: code[np.frombuffer(w.encode(), np.uint8)]
    alone = tox.score_words([c("grobnak")], model.weight)[0]
    for n in (0, 1, 17, 40, 333):
        assert tox.score_words([c("q" * n + "grobnak" + "q" * (400 - n))], model.weight)[0] > 0.15 * alone > 0
    assert tox._pieces(17)[-1] == (5, 12) and all(a + n <= 1000 for a, n in tox._pieces(1000))
    assert {i for a, n in tox._pieces(1000) for i in range(a, a + n)} == set(range(1000))


def test_sample_has_one_row_an_id(spark):
    docs = spark.createDataFrame([(1, f"text {i:03}") for i in range(300)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id bigint, quality int, toxic int")
    assert tox.labelled_sample(docs, labels, 4) == (["text 000"], [])

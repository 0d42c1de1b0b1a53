from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import rewards, text, tokens, vector


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).collect()[0].y


GOOD = "<|im_start|>assistant\n<think>a</think>\n<search>q</search><information>Paris is it</information> <think>b</think><answer>Paris</answer>"


def test_answers(spark):
    assert one(spark, text.normalize_answer("x"), "  The, cat's  a-hat! ") == "cats ahat"
    assert one(spark, text.normalize_answer("x"), None) == ""
    two = "<answer>e.g.</answer> text <answer> The Paris. </answer>"
    assert one(spark, text.last_answer("x"), two) == "The Paris."
    assert one(spark, text.last_answer("x"), "<answer>Paris</answer>") is None
    golds = F.array(F.lit("paris"), F.lit("Lutetia"))
    assert one(spark, rewards.answer_reward("x", golds), two) == 1.0
    assert one(spark, rewards.answer_reward("x", golds), "<answer>Paris</answer>") == 0.0
    assert one(spark, rewards.answer_reward("x", golds), "<answer>Paris</answer><answer>Rome</answer>") == 0.0
    assert one(spark, rewards.answer_reward("x", golds, part=True), "<answer>z</answer><answer>in Paris now</answer>") == 1.0


@pytest.mark.parametrize("t,want", [("<search>aspirin dose</search>", ("search", "aspirin dose")), ("x<answer>A</answer>", ("answer", "A")), ("plain", (None, "")), ("<search>a</answer> <answer>b\nc </answer>", ("answer", "b\nc"))])
def test_actions(spark, t, want):
    assert tuple(one(spark, text.action("x"), t)) == want


@pytest.mark.parametrize("t,want", [(GOOD, True), (GOOD.replace("</think>\n<search>", "</think> stray <search>"), False), (GOOD.replace("<answer>Paris</answer>", ""), False), (GOOD[13:], False), (GOOD + "<answer>", False), (GOOD + " tail", False), ("<|im_start|>assistant<think>x</think><answer>y</answer>", True), ("<|im_start|>assistant<answer>y</answer>", False), ("", False)])
def test_trajectories(spark, t, want):
    assert one(spark, text.valid_trajectory("x"), t) is want


def test_format_reward(spark):
    g = F.array(F.lit("paris"))
    assert one(spark, text.format_reward("x", g), GOOD) == pytest.approx(0.3)
    assert one(spark, text.format_reward("x", g), "<answer>e</answer>" + GOOD) == 1.0
    assert one(spark, text.format_reward("x", g), "<answer>e</answer><answer>Paris</answer>") == pytest.approx(0.8)
    assert one(spark, text.format_reward("x", g), "<answer>e</answer><answer>Rome</answer>") == pytest.approx(0.1)
    assert one(spark, text.format_reward("x", g), "nothing") == 0.0


def test_cut_and_counts(spark):
    assert one(spark, text.cut_response("x"), "a<search>b</search>c</search>") == "a<search>b</search>"
    assert one(spark, text.cut_response("x"), "a</answer>b") == "a</answer>"
    assert one(spark, text.count_text("x", F.lit("aa")), "aaaaa") == 2
    assert one(spark, text.count_text("x", F.lit("")), "aaaaa") == 0
    assert one(spark, text.passages("x"), ["T\nbody\nmore", "U"], "array<string>") == "Doc 1(Title: T) body\nmore\nDoc 2(Title: U) \n"
    assert one(spark, text.quoted_title("x"), "(Title: a b) c\nd") == '"a b"\nc\nd'
    assert one(spark, text.options_text("x"), {"B": "two", "A": "one"}, "map<string,string>") == "A. one\nB. two"
    assert one(spark, text.snippet_parts("x"), "one two three four five six ... short") == ["one two three four five six"]
    assert one(spark, text.normalize_text("x", compat=True), "ﬁne  Ⅳ ") == "fine iv"
    assert one(spark, text.html_paragraphs("x"), "<style>p{}</style><script>'</p>'</script><!--<p>n</p>--><p class=a>a <b>b</b></p><P>c\n d</P>") == "a b\nc d"


def test_numbers(spark):
    assert one(spark, rewards.strict_number("x"), "so #### 1,234") == "1234"
    assert one(spark, rewards.strict_number("x"), "so 12") is None
    assert one(spark, rewards.last_number("x"), "3 then -4.5 .") == "-4.5"
    assert one(spark, rewards.last_number("x"), "none") is None


@pytest.mark.parametrize("t,want", [("Assistant: <answer>(3+4)*5</answer>", 1.0), ("Assistant: <answer>3+4+5</answer>", 0.1), ("Assistant: <answer>3*5</answer>", 0.1), ("Assistant: <answer>(3+4)*5+</answer>", 0.1), ("<answer>(3+4)*5</answer>", 0.0), ("Assistant: no", 0.0), ("Assistant: <answer>1</answer>\n<answer>5*(4+3)</answer>", 1.0)])
def test_equations(spark, t, want):
    n = F.array(F.lit(3), F.lit(4), F.lit(5))
    assert one(spark, rewards.equation_reward("x", F.lit(35.0), n), t) == pytest.approx(want)


def test_arithmetic_never_evaluates():
    assert rewards.arithmetic("2*(3+4)/7") == 2.0
    assert [rewards.arithmetic(x) for x in ("__import__('os')", "1/0", "", None, "2**9999999", "(1")] == [None] * 6


@pytest.mark.parametrize("a,b", [("\\frac12", "\\frac{1}{2}"), ("0.5", "\\frac{1}{2}"), ("3/4", "\\frac{3}{4}"), ("x=5", "5"), ("\\sqrt3", "\\sqrt{3}"), ("10\\text{ cm}", "10"), (".5", "0.5"), ("\\left(1, 2\\right)", "(1,2)"), ("90^\\circ", "90")])
def test_latex(a, b):
    assert rewards.latex_equal(a, b)


def test_boxed(spark):
    assert rewards.boxed("so \\boxed{\\frac{1}{2}} and") == "\\frac{1}{2}"
    assert rewards.boxed("\\boxed 7$ x") == "7" and rewards.boxed("none") is None and rewards.boxed("\\boxed{open") is None
    df = spark.createDataFrame([("\\boxed{0.5}", "\\frac12"), ("\\boxed{2}", "3"), (None, "3")], "t string, g string")
    assert [r.r for r in df.select(rewards.latex_reward("t", "g").alias("r")).collect()] == [1.0, 0.0, 0.0]
    assert one(spark, rewards.product_reward("x", F.lit(12)), "Assistant: <answer>12</answer>") == 1.0
    assert one(spark, rewards.product_reward("x", F.lit(12)), "Assistant: <answer>twelve</answer>") == 0.0


def test_token_arrays(spark):
    ids = [0] * 2 + [2, 42, 3, 5, 1] + [0] * 2
    assert one(spark, tokens.eos_mask(F.col("x"), 1), ids, "array<int>") == [1] * 7 + [0, 0]
    assert one(spark, tokens.position_ids(F.col("x")), [0, 0, 1, 1, 1], "array<int>") == [0, 0, 0, 1, 2]
    assert one(spark, tokens.pad(F.col("x"), 4, 9, left=True), [1, 2], "array<int>") == [9, 9, 1, 2]
    assert one(spark, tokens.pad(F.col("x"), 2, 9, truncation="left"), [1, 2, 3], "array<int>") == [2, 3]
    with pytest.raises(Exception, match="longer"):
        one(spark, tokens.pad(F.col("x"), 2, truncation="error"), [1, 2, 3], "array<int>")
    assert one(spark, tokens.pads_last(F.col("x")), [0, 1, 0, 2], "array<int>") == [1, 2, 0, 0]
    assert one(spark, tokens.windows(F.col("x"), 5, 2), list("abcdefgh"), "array<string>") == [list("abcde"), list("defgh")]
    assert one(spark, tokens.windows(F.col("x"), 5, 2), list("XYZ"), "array<string>") == [list("XYZ")]
    assert one(spark, tokens.last_token_reward(F.lit(3), F.lit(2.0)), 1, "int") == [0.0, 0.0, 2.0]


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, vector.l2(a, b), 1, "int") == 5.0 and one(spark, vector.normalized(a), 1, "int") == [0.6, 0.8]
    assert one(spark, vector.normalized(b), 1, "int") == [0.0, 0.0]
    assert one(spark, vector.mean_pool(F.array(a, b, a), F.array(F.lit(1), F.lit(1), F.lit(0))), 1, "int") == [1.5, 2.0]

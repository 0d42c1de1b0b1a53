"""Rule-based rewards of answers: numbers, equations, LaTeX. Parsing is by Column expressions where regular; arithmetic
is walked over a syntax tree (texts are never evaluated) and braces are matched in Arrow batches."""

from __future__ import annotations

import ast
import operator
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import col, exact_match, last_answer, sub_match

NUMBER = r"(-?[0-9.,]+)"


def strict_number(c: str | Column) -> Column:
    """Number behind '#### ', without thousands separators; null without one."""
    x = F.regexp_extract(col(c), f"#### {NUMBER}", 1)
    return F.when(x != "", F.replace(x, F.lit(","), F.lit("")))


def last_number(c: str | Column) -> Column:
    """Last number of a text that isn't a lone point; null without one."""
    found = F.filter(F.regexp_extract_all(col(c), F.lit(NUMBER), 1), lambda x: (x != ".") & (x != ""))
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def number_reward(c: str | Column, truth: str | Column, strict: bool = True, score: float = 1.0, wrong: float = 0.0) -> Column:
    x = strict_number(c) if strict else last_number(c)
    return F.when(x.isNull(), 0.0).when(x == col(truth), score).otherwise(wrong)


def answer_reward(c: str | Column, golds: Column, part: bool = False, score: float = 1.0, wrong: float = 0.0, min_blocks: int = 2) -> Column:
    """Exact (or, with part, contained) match of the last answer block; 0 without one."""
    x = last_answer(c, min_blocks)
    return F.when(x.isNull(), 0.0).when(sub_match(x, golds) if part else exact_match(x, golds), score).otherwise(wrong)


def dispatch(source: str | Column, rewards: dict[str, Column], other: Column | None = None) -> Column:
    """Reward by data source."""
    out = F.when(F.lit(False), F.lit(0.0))
    for k, v in rewards.items():
        out = out.when(col(source) == k, v)
    return out.otherwise(F.lit(0.0) if other is None else other)


def final_line_answer(c: str | Column) -> Column:
    """Last answer block of the last line behind the assistant's marker."""
    x = col(c)
    body = F.when(F.contains(x, F.lit("Assistant:")), F.regexp_replace(x, r"(?s)^.*?Assistant:", "")).when(F.contains(x, F.lit("<|im_start|>assistant")), F.regexp_replace(x, r"(?s)^.*?<\|im_start\|>assistant", ""))
    found = F.regexp_extract_all(F.element_at(F.split(body, "\n"), -1), F.lit(r"<answer>(.*?)</answer>"), 1)
    return F.when(F.size(found) > 0, F.trim(F.element_at(found, -1)))


def numbers_used(equation: Column, numbers: Column) -> Column:
    """Whether an equation has just these whole numbers, each as often as given."""
    return F.array_sort(F.transform(F.regexp_extract_all(equation, F.lit(r"(\d+)"), 1), lambda x: x.cast("bigint"))) == F.array_sort(F.transform(numbers, lambda x: x.cast("bigint")))


OPS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.USub: operator.neg, ast.UAdd: operator.pos}


def arithmetic(text: str | None) -> float | None:
    """Value of an expression of numbers, + - * / and parentheses; None for anything else."""

    def walk(n: ast.AST) -> float:
        if isinstance(n, ast.Constant) and isinstance(n.value, int | float) and not isinstance(n.value, bool):
            return n.value
        if isinstance(n, ast.BinOp) and type(n.op) in OPS:
            return OPS[type(n.op)](walk(n.left), walk(n.right))
        if isinstance(n, ast.UnaryOp) and type(n.op) in OPS:
            return OPS[type(n.op)](walk(n.operand))
        raise ValueError

    if not text or not re.fullmatch(r"[\d+\-*/().\s]+", text):
        return None
    try:
        return float(walk(ast.parse(text.strip(), mode="eval").body))
    except (SyntaxError, ValueError, ZeroDivisionError, OverflowError, RecursionError):
        return None


@F.pandas_udf(T.DoubleType())
def evaluate(s: pd.Series) -> pd.Series:
    return s.map(arithmetic)


def equation_reward(c: str | Column, target: Column, numbers: Column, score: float = 1.0, format_score: float = 0.1) -> Column:
    """Reward of an equation that must use given numbers and reach a target."""
    eq = final_line_answer(c)
    value = F.when(numbers_used(eq, numbers), evaluate(eq))
    return F.when(eq.isNull(), 0.0).when(F.abs(value - target) < 1e-5, score).otherwise(format_score)


def product_reward(c: str | Column, truth: Column, score: float = 1.0, wrong: float = 0.1) -> Column:
    """Reward of a whole-number answer behind 'Assistant:'."""
    body = F.when(F.contains(col(c), F.lit("Assistant:")), F.regexp_replace(col(c), r"(?s)^.*?Assistant:", ""))
    found = F.regexp_extract_all(body, F.lit(r"<answer>(.*?)</answer>"), 1)
    x = F.when(F.size(found) > 0, F.trim(F.element_at(found, -1)).try_cast("bigint"))
    return F.when(x.isNull(), 0.0).when(x == truth.cast("bigint"), score).otherwise(wrong)


def boxed(text: str | None) -> str | None:
    """Content of the last \\boxed{...} or \\fbox{...} with its braces matched."""
    if text is None:
        return None
    if "\\boxed " in text:
        return text.rsplit("\\boxed ", 1)[1].split("$", 1)[0]
    at = max(text.rfind("\\boxed"), -1)
    at = at if at >= 0 else text.rfind("\\fbox")
    if at < 0 or (begin := text.find("{", at)) < 0:
        return None
    level = 0
    for i in range(begin, len(text)):
        level += (text[i] == "{") - (text[i] == "}")
        if level == 0:
            return text[begin + 1 : i]
    return None


def latex_form(s: str) -> str:
    """Canonical form of a short LaTeX answer, so that equal answers are equal texts."""
    for old, new in (("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", "")):
        s = s.replace(old, new)
    if s.count("\\text{ ") == 1:  # a unit at the right
        s = s.split("\\text{ ")[0]
    s = s.replace("\\%", "").replace(" .", " 0.").replace("{.", "{0.")
    s = "0" + s if s.startswith(".") else s
    if s.count("=") == 1 and len(s.split("=")[0]) <= 2:
        s = s.split("=")[1]
    s = re.sub(r"\\sqrt([^{])", r"\\sqrt{\1}", s).replace(" ", "")
    s = re.sub(r"\\frac([^{])([^{])", r"\\frac{\1}{\2}", s)
    s = re.sub(r"\\frac([^{])\{", r"\\frac{\1}{", s)
    s = "\\frac{1}{2}" if s == "0.5" else s
    if m := re.fullmatch(r"(-?\d+)/(-?\d+)", s):
        s = f"\\frac{{{int(m[1])}}}{{{int(m[2])}}}" if f"{int(m[1])}/{int(m[2])}" == s else s
    return s


def latex_equal(a: str | None, b: str | None) -> bool:
    return a is b if a is None or b is None else latex_form(a) == latex_form(b)


@F.pandas_udf(T.DoubleType())
def latex_reward(text: pd.Series, truth: pd.Series) -> pd.Series:
    """1 if the last boxed answer equals the truth, else 0."""
    return pd.Series([1.0 if (x := boxed(t)) is not None and latex_equal(x, g) else 0.0 for t, g in zip(text, truth, strict=True)])

"""String functions as Column expressions: normal forms, answers, tags, prompts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode compatibility form, for which Spark has no function."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def normalize_text(c: str | Column, lower: bool = True, compat: bool = False) -> Column:
    """Lower-case (unless told not to), with single blanks and none at the ends; compat=True applies NFKC first."""
    x = nfkc(col(c)) if compat else col(c)
    return F.trim(F.regexp_replace(F.lower(x) if lower else x, r"\s+", " "))


def content_hash(title: str | Column, content: str | Column, compat: bool = False) -> Column:
    return F.sha2(F.concat_ws("\n", normalize_text(title, compat=compat), normalize_text(content, compat=compat)), 256)


def content_id(c: str | Column, prefix: str = "") -> Column:
    """Id that depends on the text only."""
    return F.concat(F.lit(prefix), F.md5(col(c)))


def words(c: str | Column) -> Column:
    """Words of letters and digits, lower-cased."""
    return F.filter(F.split(F.lower(col(c)), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def normalize_answer(c: str | Column) -> Column:
    """Short-answer form: lower case, without ASCII punctuation and English articles, single blanks. Null gives ''."""
    x = F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), r"\p{Punct}", "")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"\b(?:the|an?)\b", " "), r"\s+", " "))


def exact_match(pred: str | Column, golds: Column) -> Column:
    return F.exists(golds, lambda g: normalize_answer(g) == normalize_answer(pred))


def sub_match(pred: str | Column, golds: Column) -> Column:
    return F.exists(golds, lambda g: F.contains(normalize_answer(pred), normalize_answer(g)))


def contains_answer(pred: str | Column, gold: str | Column) -> Column:
    """1 if the normalised gold answer is in the prediction; 0 if either is empty."""
    p, g = normalize_answer(pred), normalize_answer(gold)
    return F.when((p != "") & (g != "") & F.contains(p, g), 1).otherwise(0)


def blocks(c: str | Column, tag: str) -> Column:
    """Trimmed contents of all <tag>...</tag>."""
    return F.transform(F.regexp_extract_all(col(c), F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), 1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))


def last_answer(c: str | Column, min_blocks: int = 2) -> Column:
    """Content of the last answer block; null with fewer blocks than min_blocks (prompts show one as an example)."""
    b = blocks(c, "answer")
    return F.when(F.size(b) >= min_blocks, F.element_at(b, -1))


def evidence_found(c: str | Column, golds: Column) -> Column:
    """Whether an information block holds a gold answer."""
    return F.exists(blocks(c, "information"), lambda b: F.exists(golds, lambda g: F.contains(normalize_answer(b), normalize_answer(g))))


def last_search(c: str | Column) -> Column:
    b = blocks(c, "search")
    return F.when(F.size(b) > 0, F.element_at(b, -1))


ACTION = rf"(?s)<({'|'.join(['answer', 'search'])})>(.*?)</\1>"


def action(c: str | Column) -> Column:
    """(action, content) of the first whole search or answer block; a null action without one."""
    kind = F.regexp_extract(col(c), ACTION, 1)
    return F.struct(F.when(kind != "", kind).alias("action"), F.regexp_replace(F.regexp_extract(col(c), ACTION, 2), r"^\s+|\s+$", "").alias("content"))


def cut_response(c: str | Column) -> Column:
    """A response up to its first closing search tag, else up to its first closing answer tag."""
    x = col(c)
    return F.when(F.contains(x, F.lit("</search>")), F.concat(F.substring_index(x, "</search>", 1), F.lit("</search>"))).when(F.contains(x, F.lit("</answer>")), F.concat(F.substring_index(x, "</answer>", 1), F.lit("</answer>"))).otherwise(x)


#: Allowed moves between the tags of a trajectory, and the states in which text may stand.
MOVES = {("start", "<think>"): "thinking", ("informed", "<think>"): "thinking", ("thinking", "</think>"): "thought", ("thought", "<search>"): "searching", ("searching", "</search>"): "searched", ("searched", "<information>"): "informing", ("informing", "</information>"): "informed", ("thought", "<answer>"): "answering", ("answering", "</answer>"): "end"}
INSIDE = ["thinking", "searching", "informing", "answering"]
TAG = "</?(?:" + "|".join(sorted({tag.strip("</>") for _, tag in MOVES})) + ")>"


def valid_trajectory(c: str | Column) -> Column:
    """Whether what follows the assistant's marker is think, (search, information, think)*, answer with text within
    tags only: a fold over its tags and texts, without Python."""
    marker = r"<\|im_start\|>assistant\s*"
    body = F.regexp_replace(col(c), f"(?s)^.*?{marker}", "")
    # the separator \u0001 frames tags; parts that are blank don't matter
    parts = F.filter(F.split(F.regexp_replace(body, f"({TAG})", "\u0001$1\u0001"), "\u0001"), lambda p: F.regexp_replace(p, r"\s+", "") != "")
    balanced = F.lit(True)
    for tag in ("think", "search", "information", "answer"):
        count = lambda t: (F.length(body) - F.length(F.replace(body, F.lit(t), F.lit("")))) / len(t)
        balanced = balanced & (count(f"<{tag}>") == count(f"</{tag}>"))

    def step(state: Column, part: Column) -> Column:
        out = F.when(state == "bad", F.lit("bad"))
        for (s, tag), new in MOVES.items():
            out = out.when((state == s) & (part == tag), F.lit(new))
        return out.when(F.rlike(part, F.lit(f"^{TAG}$")), F.lit("bad")).when(state.isin(INSIDE), state).otherwise(F.lit("bad"))

    return F.rlike(col(c), F.lit(marker)) & balanced & (F.aggregate(parts, F.lit("start"), step) == "end")


def format_reward(c: str | Column, golds: Column, score: float = 1.0, structure: float = 0.2, final_format: float = 0.1, retrieval: float = 0.1) -> Column:
    """Reward of answer, format and evidence together."""
    ok, ans = valid_trajectory(c), last_answer(c)
    right = F.coalesce(ans.isNotNull() & exact_match(ans, golds), F.lit(False))
    shape = F.when(evidence_found(c, golds), structure + retrieval).otherwise(structure)
    return F.when(right & ok, score).when(right, score - structure).when(ok, shape).when(ans.isNotNull(), final_format).otherwise(0.0)


def count_text(text: str | Column, part: str | Column) -> Column:
    """Occurrences of a text in another that don't overlap; 0 for an empty part."""
    t, p = col(text), col(part)
    return F.when(F.length(p) > 0, ((F.length(t) - F.length(F.replace(t, p, F.lit("")))) / F.length(p)).cast("int")).otherwise(0)


def is_chinese(c: str | Column, whole: bool = False) -> Column:
    return F.rlike(col(c), F.lit("^[\\u4e00-\\u9fa5]+$" if whole else "[\\u4e00-\\u9fff]"))


def end_with_point(c: str | Column) -> Column:
    return F.when(F.rlike(col(c), F.lit(r"[.?!]\s*$")), col(c)).otherwise(F.concat(col(c), F.lit(".")))


def title_and_text(title: str | Column, text: str | Column) -> Column:
    return F.concat(end_with_point(F.trim(col(title))), F.lit(" "), F.trim(col(text)))


def quoted_title(c: str | Column) -> Column:
    """'(Title: t) x' as the title in quotes and the text on the next line."""
    return F.regexp_replace(col(c), r"(?s)^\(Title: (.*?)\)\s*(.*)$", "\"$1\"\n$2")


def question_form(c: str | Column) -> Column:
    q = F.trim(col(c))
    return F.when(F.endswith(q, F.lit("?")), q).otherwise(F.concat(q, F.lit("?")))


def passages(items: Column) -> Column:
    """Numbered evidence from an array of contents whose first line is the title."""
    return F.array_join(F.transform(items, lambda x, i: F.format_string("Doc %d(Title: %s) %s\n", i + 1, F.substring_index(x, "\n", 1), F.substring(x, F.length(F.substring_index(x, "\n", 1)) + 2, 1_000_000_000))), "")


def citations(items: Column) -> Column:
    return F.transform(items, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("]\t \""), x, F.lit("\"")))


def options_text(options: Column) -> Column:
    """'A. x' lines of a map from letters to choices, in the letters' order."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(options)), lambda e: F.concat(e["key"], F.lit(". "), e["value"])), "\n")


def snippet_parts(c: str | Column) -> Column:
    """Pieces of a search snippet between ellipses that have more than five words."""
    return F.filter(F.transform(F.split(col(c), r"\.\.\."), lambda x: F.trim(x)), lambda x: F.size(F.split(x, r"\s+")) > 5)


def clean_query(c: str | Column) -> Column:
    """A search query without control characters, quotes at its ends and surplus blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(col(c), r"[\p{Cntrl}]+", " "), r"^[\"'\s]+|[\"'\s]+$", ""))


def html_paragraphs(c: str | Column) -> Column:
    """Texts of <p> elements joined by line ends; scripts, styles and comments are taken out first."""
    bare = F.regexp_replace(col(c), r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", "")
    inner = F.regexp_extract_all(bare, F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)</p\s*>"), 1)
    return F.array_join(F.filter(F.transform(inner, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"<[^>]*>", ""), r"\s+", " "))), lambda x: x != ""), "\n")


def link_kept(url: str | Column) -> Column:
    """Whether a link looks like a page: its path's extension is none or one of HTML."""
    path = F.regexp_extract(col(url), r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1)
    return F.lower(F.regexp_extract(path, r"(\.[a-zA-Z0-9]+)$", 1)).isin(".htm", ".html", "", ".shtml")


def hash_number(key: Column, start: int = 1, digits: int = 8) -> Column:
    """Whole number from hex digits of a key's SHA-256; the same in every engine."""
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), start, digits), 16, 10).cast("bigint")


def joined_text(title: str | Column, text: str | Column, separator: str | None = None) -> Column:
    """Title and text as one input of an encoder: with the model's separator token, or as two sentences where it has none."""
    if separator is not None:
        return F.concat(col(title), F.lit(separator), col(text))
    return title_and_text(title, text)


def prefixed(c: str | Column, kind: str, prefixes: dict[str, str]) -> Column:
    """A text after its model's prefix for questions or passages ('query', 'passage'; none: as it is)."""
    return F.concat(F.lit(prefixes.get(kind, "")), col(c))


def titled_form(c: str | Column) -> Column:
    """The reverse of quoted_title: '"t"', line end, x as '(Title: t) x'."""
    return F.regexp_replace(col(c), r'(?s)^"([^\n]*)"\n(.*)$', "(Title: $1) $2")


def snippet_context(c: str | Column, pieces: Column) -> Column:
    """Lines of a page that hold one of a snippet's pieces, each once, in the page's order."""
    lines = F.array_distinct(F.filter(F.transform(F.split(col(c), "\n"), lambda x: F.trim(x)), lambda x: x != ""))
    return F.array_join(F.filter(lines, lambda x: F.exists(pieces, lambda p: F.contains(x, p))), "\n")


def numbered_documents(items: Column) -> Column:
    """'Document [i] (Title: t) c' of an array<struct<title, content>>, from 0, blanks collapsed, one a line."""
    one = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.array_join(F.transform(items, lambda x, i: F.concat(F.lit("Document ["), i.cast("string"), F.lit("] (Title: "), one(x["title"]), F.lit(") "), one(x["content"]))), "\n")


def first_tokens(c: str | Column, n: int) -> Column:
    """The first n blank-separated tokens, single blanks between them."""
    return F.array_join(F.slice(F.filter(F.split(col(c), r"\s+"), lambda w: w != ""), 1, n), " ")


def keyword_boost(question: Column, document: Column, keywords: Column, weight: float = 0.1) -> Column:
    """Addition to a score for each keyword that both texts have."""
    return F.lit(weight) * F.size(F.filter(F.array_distinct(keywords), lambda k: F.contains(question, k) & F.contains(document, k)))


def after_mark(c: str | Column, mark: str = "Answer:") -> Column:
    """What follows the last mark, trimmed; the whole text where there is none."""
    return F.trim(F.substring_index(col(c), mark, -1))


def reply_items(c: str | Column) -> Column:
    """Items of a numbered reply: pieces between blank lines without 'n.' before them."""
    pieces = F.filter(F.transform(F.split(col(c), r"\n\s*\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(pieces, lambda x: F.trim(F.regexp_replace(x, r"^\d+\.", "")))

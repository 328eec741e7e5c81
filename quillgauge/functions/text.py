"""Scalar text functions, as column expressions inside whole-stage code generation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Token patterns by metric family (fixed values).
TOKENS = {"graph": r"[a-z0-9_一-鿿]+", "word": r"[\p{L}\p{N}_]+", "plain": r"[a-z0-9_]+", "dashed": r"[A-Za-z0-9_\-]+"}
#: Redaction rules in the order they apply: pattern, replacement (fixed values).
REDACTIONS = [
    (r"(?i)\b(Bearer|Token|ApiKey)\s+[A-Za-z0-9._\-/+]{8,}", "$1 [REDACTED]"),
    (r"(?i)(password\s*[=:]\s*)\S+", "$1[REDACTED]"),
    (r"\b(AKIA[A-Z0-9]{16})\b", "[REDACTED]"),
    (r"\b([A-Fa-f0-9]{32,})\b", "[REDACTED]"),
    (r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", "[REDACTED]"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[REDACTED]"),
    (r"\b\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}\b", "[REDACTED]"),
    (r"\b\d{3}-\d{2}-\d{4}\b", "[REDACTED]"),
    (r"(\+1[-.\s]?)?\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}\b", "[REDACTED]"),
]
#: Markers of question and content types, in the order they are tried (fixed values).
QUESTION_TYPES = [
    ("factual", ("what", "who", "where", "when", "which")), ("explanatory", ("how", "why")),
    ("comparative", ("compare", "difference", "similar")), ("conditional", ("if", "when", "suppose", "assume")),
]
CONTENT_TYPES = [
    ("procedural", ("步驟", "step", "流程", "process", "操作", "operation", "方法", "method", "如何", "how to", "執行", "execute", "進行", "perform", "實施", "implement")),
    ("requirement", ("要求", "requirement", "規範", "specification", "標準", "standard", "必須", "must", "需要", "need", "應該", "should", "規定", "regulation")),
    ("explanatory", ("為什麼", "why", "原因", "reason", "因為", "because", "目的", "purpose", "解釋", "explain", "說明", "description")),
]
#: Personas by words of the question, in the order they are tried (fixed values).
PERSONAS = [
    ("technical_user", ("technical", "code", "error", "debug", "configure")), ("procedural_user", ("how to", "steps", "guide", "tutorial")),
    ("information_seeker", ("what is", "define", "explain", "meaning")),
]


def tokens(text: Column, kind: str = "word") -> Column:
    """All tokens in order; lower-cased but for the dashed family."""
    t = text if kind == "dashed" else F.lower(text)
    return F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(TOKENS[kind]), F.lit(0))


def token_set(text: Column, kind: str = "word") -> Column:
    return F.array_distinct(tokens(text, kind))


def words(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def first_marker(text: Column, rules: list[tuple[str, tuple[str, ...]]], default: str) -> Column:
    """The first class one of whose markers occurs in the lower-cased text."""
    out = F.lit(default)
    for name, markers in reversed(rules):
        out = F.when(F.lower(text).rlike("|".join(markers)), name).otherwise(out)
    return out


def normalize_text(text: Column, nfkc: bool = False) -> Column:
    """Line ends unified, zero-width characters removed, blanks collapsed, lines trimmed, empty lines dropped."""
    t = nfkc_form(text) if nfkc else text
    t = F.regexp_replace(t, "\r\n?", "\n")
    t = F.regexp_replace(t, "[​-‍﻿]", "")
    t = F.regexp_replace(t, r"[ \t\f\x0B]+", " ")
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(lines, "\n")


def nfkc_form(text: Column) -> Column:
    """Unicode NFKC, which Spark has no function for: an Arrow batch at a time."""
    import unicodedata

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return run(text)


def strip_markup(text: Column) -> Column:
    """White space collapsed, tags removed, escaped quotes restored."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")
    t = F.regexp_replace(t, "<[^>]+>", "")
    return F.trim(F.replace(t, F.lit('\\"'), F.lit('"')))


def bound_length(text: Column, most: int = 10_000) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def plain_text(text: Column) -> Column:
    """White space collapsed, all but word characters and basic punctuation removed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"[^\p{L}\p{N}_\s.,!?;:]", ""))


def content_hash(text: Column) -> Column:
    """The first 32 hex digits of the SHA-256 of the text without white space at its ends."""
    return F.substring(F.sha2(F.regexp_replace(text, r"^\s+|\s+$", ""), 256), 1, 32)


def redact(text: Column) -> Column:
    for pattern, to in REDACTIONS:
        text = F.regexp_replace(text, pattern, to)
    return text


def redaction_hits(text: Column) -> Column:
    """How often each rule finds something, each rule seeing what the earlier ones left."""
    counts = []
    for pattern, to in REDACTIONS:
        counts.append(F.regexp_count(text, F.lit(pattern)))
        text = F.regexp_replace(text, pattern, to)
    return F.array(*counts)


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def detect_script(text: Column) -> Column:
    """chinese where ideographs are more than 0.3 of the letters and digits."""
    alnum = count_of(text, r"[\p{L}\p{N}]")
    return F.when((alnum > 0) & (count_of(text, "[㐀-䶿一-鿿]") / F.greatest(alnum, F.lit(1)) > 0.3), "chinese").otherwise("english")


def script_shares(text: Column) -> Column:
    """struct(chinese, english, other) of the letters; a text without letters is english."""
    zh, en = count_of(text, "[一-鿿]"), count_of(text, "[A-Za-z]")
    other = count_of(text, r"\p{L}") - zh - en
    total = zh + en + other
    share = lambda n, empty: F.when(total == 0, F.lit(empty)).otherwise(n / F.greatest(total, F.lit(1)))
    return F.struct(share(zh, 0.0).alias("chinese"), share(en, 1.0).alias("english"), share(other, 0.0).alias("other"))


def complexity(text: Column) -> Column:
    """0.4 type/token + 0.3 word length/8 + 0.3 sentence length/20, each at most 1; 0.3 below ten words."""
    w = words(text)
    n = F.size(w)
    letters = F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x))
    sentences = F.size(F.split(text, r"\."))
    variety = F.size(F.array_distinct(F.transform(w, lambda x: F.lower(x)))) / n
    score = variety * 0.4 + F.least(F.lit(1.0), letters / n / 8) * 0.3 + F.least(F.lit(1.0), n / F.greatest(sentences, F.lit(1)) / 20) * 0.3
    return F.when(F.length(text) == 0, F.lit(0.0)).when(n < 10, F.lit(0.3)).otherwise(F.least(F.lit(1.0), score))


def script_mixing(text: Column) -> Column:
    """Changes between ideographs and Latin letters over the number of segments they begin."""
    marks = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[^A-Za-z一-鿿]", ""), "[A-Za-z]+", "a"), "[一-鿿]+", "z")
    return F.when(F.length(marks) > 1, F.lit(1.0)).otherwise(F.lit(0.0))


def length_class(question: Column) -> Column:
    n = F.size(words(question))
    return F.when(n <= 10, "short").when(n <= 20, "medium").otherwise("long")


def style_of(synthesizer: Column) -> Column:
    s = F.lower(synthesizer)
    return F.when(s.contains("multi_hop"), "complex_reasoning").when(s.contains("single_hop"), "direct_factual").otherwise("mixed")


def literal_pattern(term: Column) -> Column:
    """The term as a pattern that matches just itself."""
    return F.regexp_replace(term, r"([\\.\[\]{}()*+?^$|])", r"\\$1")


def ngrams(toks: Column, n: int, sep: str = " ") -> Column:
    """All runs of n tokens, joined: the list zipped with itself shifted."""
    m = F.greatest(F.size(toks) - (n - 1), F.lit(0))
    out = F.slice(toks, F.lit(1), m)
    for j in range(1, n):
        out = F.zip_with(out, F.slice(toks, F.lit(j + 1), m), lambda a, b: F.concat(a, F.lit(sep), b))
    return out

"""Comments and docstrings out of source code, every other character in its place.

One pattern a language family finds strings and comments in one pass: what a string holds is
no comment, and what a comment holds is no string. A lone apostrophe opens no string.
"""

from __future__ import annotations

import io
import re
import tokenize

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_STRINGS = r"""(?P<text>"(?:\\.|[^"\\])*(?:"|\Z)|'(?:\\.|[^'\\\r\n])*'|`(?:\\.|[^`\\])*(?:`|\Z))"""
_HASH = r"(?:(?<=[\s;|&(){}])|(?<![\s\S]))\#[^\n]*"


def _compiled(*comments: str) -> re.Pattern:
    return re.compile(_STRINGS + "|(?P<comment>" + "|".join(comments) + ")", re.S)


_SLASH, _STAR, _DASH = r"//[^\n]*", r"/\*.*?(?:\*/|\Z)", r"--[^\n]*"
#: How each language marks comments.
FAMILIES = {
    "html": _compiled(r"<!--.*?(?:-->|\Z)"),
    "lua": _compiled(r"--\[\[.*?(?:\]\]|\Z)", _DASH),
    "sql": _compiled(_STAR, _DASH),
    "powershell": _compiled(r"<\#.*?(?:\#>|\Z)", _HASH),
    "ruby": _compiled(r"(?m:^)=begin\b.*?(?m:^)=end\b[^\r\n]*", _HASH),
    "php": _compiled(_STAR, _SLASH, _HASH),
    "hash": _compiled(_STAR, _HASH, _SLASH),
    "slash": _compiled(_STAR, _SLASH),
}
HASH_LANGUAGES = frozenset({"bash", "perl", "config", "unknown"})
BATCH = re.compile(r"(?mi)^[ \t]*(::[^\r\n]*|rem(?:[ \t][^\r\n]*)?)(?=\r?$)")


def blank(text: str) -> str:
    return re.sub(r"[^\r\n]", " ", text)


def _mask_python(code: str) -> str:
    """By the tokenizer: comments, and strings that are statements of their own."""
    lines = code.splitlines(keepends=True)
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line))
    spans, fresh = [], True
    try:
        for t in tokenize.generate_tokens(io.StringIO(code).readline):
            a, b = starts[t.start[0] - 1] + t.start[1], starts[min(t.end[0], len(starts)) - 1] + t.end[1]
            if t.type == tokenize.COMMENT:
                spans.append((a, b))
            elif t.type == tokenize.STRING and fresh:
                spans.append((a, b))
                fresh = False
            elif t.type in (tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT):
                fresh = True
            elif t.type not in (tokenize.NL, tokenize.ENCODING):
                fresh = False
    except (tokenize.TokenError, SyntaxError, IndexError):
        return FAMILIES["hash"].sub(lambda m: blank(m[0]) if m["comment"] else m[0], code)
    for a, b in spans:
        code = code[:a] + blank(code[a:b]) + code[b:]
    return code


def mask(code: str | None, language: str | None) -> str:
    """The code with comments as blanks; its length and lines stay."""
    if not code:
        return code or ""
    name = (language or "unknown").strip().lower()
    if name == "python":
        return _mask_python(code)
    if name == "batch":
        return BATCH.sub(lambda m: blank(m[0]), code)
    pattern = FAMILIES.get(name) or FAMILIES["hash" if name in HASH_LANGUAGES else "slash"]
    return pattern.sub(lambda m: blank(m[0]) if m["comment"] is not None else m[0], code)


@F.pandas_udf(StringType())
def mask_udf(code: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([mask(c, x) for c, x in zip(code, language, strict=True)])

"""Source languages by path, alias and content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import suffix

#: File extensions of each language.
EXTENSIONS = {
    "php": (".php", ".phtml", ".phpt"), "python": (".py",), "javascript": (".js", ".jsx", ".mjs", ".cjs"), "typescript": (".ts", ".tsx"), "java": (".java", ".jsp"),
    "kotlin": (".kt", ".kts"), "go": (".go",), "bash": (".sh", ".bash", ".zsh"), "powershell": (".ps1", ".psm1", ".psd1"), "batch": (".bat", ".cmd"),
    "config": (".json", ".yml", ".yaml", ".toml", ".ini", ".conf"), "c": (".c", ".h"), "cpp": (".cc", ".cpp", ".cxx", ".hh", ".hpp"), "csharp": (".cs",),
    "ruby": (".rb",), "rust": (".rs",), "scala": (".scala",), "lua": (".lua",), "perl": (".pl", ".pm"), "html": (".html", ".htm", ".xhtml", ".hta"), "sql": (".sql",),
    "unknown": (".txt",), "binary": (".exe", ".dll", ".sys", ".ocx"),
}
#: Further names of languages.
ALIASES = {
    "python": ("py",), "javascript": ("js", "jsx"), "typescript": ("ts", "tsx"), "java": ("jsp",), "kotlin": ("kt",), "php": ("phtml", "phpt", "inc"), "bash": ("sh", "zsh"),
    "powershell": ("ps1", "psm1", "psd1", "pwsh"), "batch": ("bat", "batchfile", "cmd"), "config": ("json", "yaml", "yml", "conf"), "c": ("h",), "cpp": ("cc", "cxx", "hh", "hpp"),
    "csharp": ("cs",), "ruby": ("rb",), "rust": ("rs",), "perl": ("pl", "pm"), "html": ("htm", "xhtml", "hta"), "go": (), "scala": (), "lua": (), "sql": (),
}
#: Names shown for configuration files.
CONFIG_NAMES = {".json": "json", ".yml": "yaml", ".yaml": "yaml", ".toml": "toml", ".ini": "ini", ".conf": "conf"}

#: Tests of a text's first 256,000 characters; the first that holds names the language.
CONTENT = (
    ("php", r"(?i)<\?php|<\?="),
    ("html", r"(?i)^\s*<!doctype\s+html|<html[\s>]"),
    ("bash", r"^#!\s*/\S*\b(?:ba|z|k)?sh\b"),
    ("python", r"^#!\s*/\S*\bpython"),
    ("ruby", r"^#!\s*/\S*\bruby"),
    ("perl", r"^#!\s*/\S*\bperl"),
    ("javascript", r"^#!\s*/\S*\bnode\b"),
    ("batch", r"(?im)^\s*@echo\s+off\b"),
    ("powershell", r"(?im)^\s*(?:param\s*\(|function\s+[A-Z]\w+-\w+|\$\w+\s*=\s*(?:New-Object|Get-\w+))"),
    ("go", r"(?m)^package\s+\w+\s*$[\s\S]*^(?:import|func)\b"),
    ("rust", r"(?m)^\s*(?:pub\s+)?fn\s+\w+[^\n]*\{|^use\s+(?:std|crate)::"),
    ("kotlin", r"(?m)^\s*(?:fun\s+\w+\s*\(|import\s+kotlin\.)"),
    ("java", r"(?m)^\s*(?:import\s+java[x]?\.|public\s+(?:final\s+)?(?:class|interface|enum)\s+\w+)"),
    ("csharp", r"(?m)^\s*(?:using\s+System[;.]|namespace\s+\w[\w.]*)"),
    ("cpp", r"(?m)^\s*#\s*include\s*<(?:iostream|vector|string|memory)>|\bstd::"),
    ("c", r"(?m)^\s*#\s*include\s*[<\"]\w"),
    ("scala", r"(?m)^\s*object\s+\w+\s*(?:extends|\{)"),
    ("typescript", r"(?m)^\s*(?:export\s+)?(?:interface|type)\s+\w+\s*[={]|:\s*(?:string|number|boolean)\s*[;,)=]"),
    ("ruby", r"(?m)^\s*(?:require(?:_relative)?\s+['\"]|def\s+\w+[^:]*$[\s\S]*^\s*end\b)"),
    ("python", r"(?m)^\s*(?:def\s+\w+\s*\(.*\)\s*(?:->.*)?:|class\s+\w+.*:|from\s+[\w.]+\s+import\s|import\s+\w+\s*$)"),
    ("javascript", r"\b(?:const|let|var)\s+\w+\s*=|\bfunction\s*\w*\s*\(|=>\s*\{|\brequire\s*\("),
    ("lua", r"(?m)^\s*local\s+\w+\s*=|^\s*function\s+[\w.:]+\s*\("),
    ("perl", r"(?m)^\s*(?:use\s+strict|my\s+[$@%]\w+)"),
    ("sql", r"(?im)^\s*(?:select\s.+\sfrom|insert\s+into|create\s+table|update\s+\w+\s+set)\b"),
    ("config", r"^\s*[{\[]\s*\"|(?m)^\s*[\w.-]+\s*:\s+\S"),
)


def _pick(value: Column, table: dict[str, tuple[str, ...]], default: Column) -> Column:
    out = None
    for name, keys in table.items():
        hit = value.isin(*keys) if keys else F.lit(False)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def language_of_path(path: str | Column) -> Column:
    return F.coalesce(_pick(suffix(path), EXTENSIONS, F.lit("unknown")), F.lit("unknown"))


def canonical_language(name: str | Column, default: str = "unknown") -> Column:
    x = F.ltrim(F.lower(F.trim(F.col(name) if isinstance(name, str) else name)), F.lit("."))
    return F.coalesce(_pick(x, {k: (k, *v) for k, v in ALIASES.items()}, F.lit(default)), F.lit(default))


def language_of_content(text: str | Column) -> Column:
    head = F.substring(F.col(text) if isinstance(text, str) else text, 1, 256_000)
    out = None
    for name, pattern in CONTENT:
        out = F.when(head.rlike(pattern), name) if out is None else out.when(head.rlike(pattern), name)
    return F.coalesce(out, F.lit("unknown"))


def language_of(path: str | Column, text: str | Column) -> Column:
    """By path; files of no or a general extension by content."""
    own = language_of_path(path)
    return F.when(own == "unknown", language_of_content(text)).otherwise(own)


def shown_language(language: Column, path: str | Column) -> Column:
    name = F.coalesce(F.nullif(F.lower(F.trim(language)), F.lit("")), F.lit("unknown"))
    config = None
    for ext, own in CONFIG_NAMES.items():
        config = F.when(suffix(path) == ext, own) if config is None else config.when(suffix(path) == ext, own)
    return F.when(name == "config", config.otherwise("config")).when((name == "unknown") & suffix(path).isin("", ".txt"), "text").otherwise(name)

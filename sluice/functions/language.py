"""Language of a file by its name."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of each language.
EXTENSIONS = {
    "typescript": "ts tsx mts cts", "javascript": "js jsx mjs cjs", "python": "py pyw", "go": "go", "rust": "rs",
    "java": "java", "c": "c h", "cpp": "cpp cc cxx hpp hxx", "ruby": "rb", "shell": "sh bash zsh fish",
    "markdown": "md mdx", "json": "json jsonc", "yaml": "yml yaml", "toml": "toml", "csharp": "cs", "php": "php",
    "swift": "swift", "kotlin": "kt kts", "css": "css scss less", "html": "html htm vue svelte",
}
# Names that tell without an extension.
NAMES = {
    "Makefile": "shell", "Dockerfile": "shell", "Rakefile": "ruby", "Gemfile": "ruby", ".bashrc": "shell",
    ".zshrc": "shell", ".profile": "shell", ".bash_profile": "shell", ".gitignore": "unknown",
}

# Comment and import syntax of each language.
SLASHES = ("typescript", "javascript", "go", "rust", "java", "c", "cpp", "csharp", "php", "swift", "kotlin")
LINE_COMMENTS = {
    **{lang: ("//",) for lang in SLASHES}, "php": ("//", "#"), "python": ("#",), "ruby": ("#",), "shell": ("#",),
    "yaml": ("#",), "toml": ("#",),
}
BLOCK_COMMENTS = {**{lang: ("/*", "*/") for lang in (*SLASHES, "css")}, "ruby": ("=begin", "=end"), "markdown": ("<!--", "-->"), "html": ("<!--", "-->")}
DOCSTRINGS = {"python": ('"""', "'''")}
IMPORTS = {
    "typescript": r"import\s|export\s.*\sfrom\s",
    "javascript": r"import\s|export\s.*\sfrom\s|const\s+\w+\s*=\s*require\(|(let|var)\s+\w+\s*=\s*require\(|module\.exports\s*=",
    "python": r"import\s|from\s+\S+\s+import\s",
    "go": r"import\s",
    "rust": r"use\s|extern\s+crate\s",
    "java": r"import\s",
    "c": r"#\s*include\s",
    "cpp": r"#\s*include\s|using\s+namespace\s",
    "ruby": r"require\s|require_relative\s",
    "shell": r"source\s|\.\s+",
    "csharp": r"using\s",
    "php": r"use\s|require\s|include\s",
    "swift": r"import\s",
    "kotlin": r"import\s",
    "css": r"@import\s",
}


def is_line_comment(line: Column, lang: Column) -> Column:
    """Whether the line, left-trimmed, begins with a comment mark of its language."""
    marks = F.create_map(*chain(*[(F.lit(k), F.array(*map(F.lit, v))) for k, v in LINE_COMMENTS.items()]))
    start = F.regexp_replace(line, r"^\s+", "")
    return F.coalesce(F.exists(F.try_element_at(marks, lang), lambda m: F.startswith(start, m)), F.lit(False))


def is_import(line: Column, lang: Column) -> Column:
    """Whether the line matches an import pattern of its language."""
    out = F.lit(False)
    for name, pattern in IMPORTS.items():
        out = F.when(lang == name, line.rlike(rf"^\s*(?:{pattern})")).otherwise(out)
    return out


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain(*d.items())])


def detect_language(name: Column) -> Column:
    base = F.regexp_extract(name, r"([^/\\]*)$", 1)
    ext = F.lower(F.regexp_extract(base, r"\.([^.]*)$", 1))
    return F.coalesce(
        F.try_element_at(_map(NAMES), base),
        F.try_element_at(_map({e: lang for lang, es in EXTENSIONS.items() for e in es.split()}), ext),
        F.lit("unknown"),
    )

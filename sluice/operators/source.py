"""Source files: runs of comments and imports, and function bodies, folded into a line that counts them.

Each rule finds spans of lines with what replaces them; one splice applies a
rule's spans.  Runs are found by regexes over a string with one letter a line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import language as L
from ..functions import text as T

Span = tuple[int, int, list[str]]

# Lines that open a function or type, by language.
SIGNATURES = {
    "typescript": r"^(\s*)(export\s+)?(export\s+default\s+)?(declare\s+)?(abstract\s+)?(async\s+)?(function\s*\*?\s+\w+|class\s+\w+|interface\s+\w+|enum\s+\w+|type\s+\w+\s*=\s*\{|(const|let|var)\s+\w+\s*=\s*(\(|async\s*\()|(?!if|else|for|while|do|switch|try|catch|finally|return|throw|with)\w+\s*\([^)]*\)\s*(:\s*\S+)?\s*\{)",
    "javascript": r"^(\s*)(export\s+)?(export\s+default\s+)?(async\s+)?(function\s*\*?\s+\w+|class\s+\w+|(const|let|var)\s+\w+\s*=\s*(\(|async\s*\(|function)|(?!if|else|for|while|do|switch|try|catch|finally|return|throw|with)\w+\s*\([^)]*\)\s*\{)",
    "python": r"^(\s*)(async\s+)?(def\s+\w+|class\s+\w+)",
    "go": r"^(\s*)(func\s+|type\s+\w+\s+(struct|interface)\s*\{)",
    "rust": r"^(\s*)(pub(\s*\(crate\))?\s+)?(unsafe\s+)?(async\s+)?(fn\s+\w+|impl\s+|struct\s+\w+|enum\s+\w+|trait\s+\w+|mod\s+\w+)",
    "java": r"^(\s*)(public|private|protected|static|final|abstract|synchronized|native|strictfp|\s)*\s*(class\s+\w+|interface\s+\w+|enum\s+\w+|(\w+(<[^>]*>)?)\s+\w+\s*\()",
    "csharp": r"^(\s*)(public|private|protected|internal|static|virtual|override|abstract|sealed|async|partial|\s)*\s*(class\s+\w+|interface\s+\w+|enum\s+\w+|struct\s+\w+|(\w+(<[^>]*>)?)\s+\w+\s*\()",
    "cpp": r"^(\s*)(virtual\s+|static\s+|inline\s+|explicit\s+|extern\s+|const\s+|template\s*<[^>]*>\s*)*(class\s+\w+|struct\s+\w+|enum\s+|namespace\s+\w+|(\w+(::\w+)?(<[^>]*>)?\s*\*?\s*&?\s*)\s+\w+\s*\()",
    "c": r"^(\s*)(static\s+|inline\s+|extern\s+|const\s+)*(struct\s+\w+|enum\s+|(\w+\s*\*?\s*)\s+\w+\s*\()",
    "ruby": r"^(\s*)(def\s+\w+|class\s+\w+|module\s+\w+)",
    "shell": r"^(\s*)(function\s+\w+|\w+\s*\(\s*\)\s*\{?)",
    "php": r"^(\s*)(public|private|protected|static|final|abstract|\s)*\s*(function\s+\w+|class\s+\w+|interface\s+\w+|trait\s+\w+|enum\s+\w+)",
    "kotlin": r"^(\s*)(public|private|protected|internal|open|override|abstract|final|suspend|inline|\s)*\s*(fun\s+|class\s+\w+|interface\s+\w+|enum\s+class\s+\w+|object\s+\w+)",
    "swift": r"^(\s*)(public|private|fileprivate|internal|open|override|static|class|final|mutating|\s)*\s*(func\s+\w+|class\s+\w+|struct\s+\w+|enum\s+\w+|protocol\s+\w+)",
}
BY_INDENT, BY_END = ("python",), ("ruby",)

#: What hides braces: an escaped character, a string (to the line's end if open), a line comment.
_HIDDEN = re.compile(r"""\\.|(["'`])(?:\\.|(?!\1).)*(?:\1|$)|//.*""", re.S)


def indent(line: str) -> int:
    return len(line) - len(line.lstrip())


def braces(line: str) -> tuple[int, int]:
    """Opening and closing braces outside strings and line comments."""
    bare = _HIDDEN.sub("", line)
    return bare.count("{"), bare.count("}")


def splice(lines: list[str], spans: Iterator[Span]) -> list[str]:
    out, at = [], 0
    for start, end, put in spans:
        out += lines[at:start] + put
        at = end
    return out + lines[at:]


def comment_blocks(lines: list[str], lang: str) -> Iterator[Span]:
    """Block comments and docstrings of three lines or more; one without an end stays as it is."""
    marks = [(*L.BLOCK_COMMENTS[lang], "comment")] if lang in L.BLOCK_COMMENTS else []
    marks += [(q, q, "docstring") for q in L.DOCSTRINGS.get(lang, ())]
    at = 0
    while marks and at < len(lines):
        text = lines[at].lstrip()
        found = next((m for m in marks if text.startswith(m[0])), None)
        end = at + 1
        if found and found[1] not in text[len(found[0]):]:
            end = next((k + 1 for k in range(at + 1, len(lines)) if found[1] in lines[k]), at + 1)
        if end - at >= 3:
            yield at, end, [lines[at], f"{' ' * indent(lines[at])}... ({end - at - 1} more {found[2]} lines)"]
        at = end


def comment_runs(lines: list[str], lang: str) -> Iterator[Span]:
    """Three or more line comments in a row."""
    marks = L.LINE_COMMENTS.get(lang)
    letters = "".join("c" if x.lstrip().startswith(marks) else "-" for x in lines) if marks else ""
    for m in re.finditer("c{3,}", letters):
        first = lines[m.start()]
        yield m.start(), m.end(), [first, f"{' ' * indent(first)}{marks[0]} ... ({m.end() - m.start() - 1} more comment lines)"]


def import_runs(lines: list[str], lang: str) -> Iterator[Span]:
    """Four or more imports, single blank lines between them allowed; a run counts anew after 100 lines."""
    if lang not in L.IMPORTS:
        return
    imports = re.compile(rf"\s*(?:{L.IMPORTS[lang]})")
    letters = "".join("i" if imports.match(x) else "-" if x.strip() else "b" for x in lines)
    mark = L.LINE_COMMENTS.get(lang, ("//",))[0]
    for run in re.finditer("i(?:b?i)*", letters):
        for m in re.finditer("i[ib]{0,99}", run[0]):
            own = [x for x in lines[run.start() + m.start():run.start() + m.end()] if x.strip()]
            if len(own) >= 4:
                yield run.start() + m.start(), run.start() + m.end(), [own[0], f"{mark} ... ({len(own) - 2} more imports)", own[-1]]


def _close(depths: list[int], at: int, base: int) -> int:
    """The first line from ``at`` after which the depth is ``base`` or less; else the last line."""
    return next((k for k in range(at, len(depths)) if depths[k] <= base), len(depths) - 1)


def brace_bodies(lines: list[str], signature: re.Pattern) -> Iterator[Span]:
    count = [braces(x) for x in lines]
    depths = list(accumulate(o - c for o, c in count))
    at = 0
    while at < len(lines):
        opens, closes = count[at]
        if not signature.match(lines[at]) or (opens and closes >= opens):
            at += 1
            continue
        hint = " " * (indent(lines[at]) + 2)
        if opens <= closes:  # the brace may be on the next line
            at += 1
            if at == len(lines) or not count[at][0]:
                continue
            if count[at][0] <= count[at][1]:
                at += 1
                continue
            least = 2  # body lines without the brace's own
        else:
            least = 3
        end = _close(depths, at + 1, depths[at] - count[at][0] + count[at][1])
        if (n := end - at - 1) >= least:
            yield at + 1, end, [f"{hint}... ({n} lines collapsed)"]
        at = max(at, end) + 1


def indent_bodies(lines: list[str], signature: re.Pattern) -> Iterator[Span]:
    at = 0
    while at < len(lines):
        if not signature.match(lines[at]):
            at += 1
            continue
        deep, end = indent(lines[at]), at + 1
        for k in range(at + 1, len(lines)):
            if lines[k].strip():
                if indent(lines[k]) <= deep:
                    break
                end = k + 1
        if (n := end - at - 1) >= 3:
            yield at + 1, end, [f"{' ' * (deep + 4)}... ({n} lines collapsed)"]
        at = end


def keyword_bodies(lines: list[str], signature: re.Pattern) -> Iterator[Span]:
    at = 0
    while at < len(lines):
        if not signature.match(lines[at]):
            at += 1
            continue
        deep = indent(lines[at])
        end = next((k for k in range(at + 1, len(lines)) if indent(lines[k]) <= deep and re.match(r"\s*end(\s|$|;)", lines[k])), len(lines))
        if (n := end - at - 1) >= 3:
            yield at + 1, end, [f"{' ' * (deep + 2)}... ({n} lines collapsed)"]
        at = end + 1


def function_bodies(lines: list[str], lang: str) -> Iterator[Span]:
    """Bodies of three lines or more; what stands inside a folded or kept body isn't looked at again."""
    if lang not in SIGNATURES:
        return iter(())
    rule = indent_bodies if lang in BY_INDENT else keyword_bodies if lang in BY_END else brace_bodies
    return rule(lines, re.compile(SIGNATURES[lang], re.A))


def fold(lines: list[str], lang: str, comments: bool = True, imports: bool = True, bodies: bool = False) -> list[str]:
    rules = [comment_blocks, comment_runs] * comments + [import_runs] * imports + [function_bodies] * bodies
    for rule in rules:
        lines = splice(lines, rule(lines, lang))
    return lines


def fold_source(lines: Column, lang: Column, comments: bool = True, imports: bool = True, bodies: bool = False) -> Column:
    """An array of lines and its language -> the folded lines.  Null lines stay null, unknown languages unchanged."""

    @F.pandas_udf("array<string>")
    def run(ls: pd.Series, langs: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else fold(list(x), lang, comments, imports, bodies) for x, lang in zip(ls, langs)])

    return run(lines, lang)


# The first word that tells a signature's kind.
KINDS = (
    ("class", r"\b(class|struct|enum|object)\s"), ("interface", r"\b(interface|trait|protocol)\s"), ("type", r"\b(type|impl|mod|module|namespace)\s"),
)


def signatures(files: DataFrame, doc: str, name: str, content: str) -> DataFrame:
    """(doc, line_no, kind, signature): the lines that open a function or type, by the file's language."""
    ls = files.select(doc, L.detect_language(F.col(name)).alias("lang"), F.posexplode(T.lines(F.col(content))).alias("line_no", "line"))
    hit = F.lit(False)
    for lang, pattern in SIGNATURES.items():
        hit = F.when(F.col("lang") == lang, F.col("line").rlike(pattern)).otherwise(hit)
    kind = F.when(T.indent(F.col("line")) > 0, "method").otherwise("function")
    for k, pattern in reversed(KINDS):
        kind = F.when(F.col("line").rlike(pattern), k).otherwise(kind)
    return ls.filter(hit).select(doc, "line_no", kind.alias("kind"), T.trim(F.col("line")).alias("signature"))


def brace_depth(ls: DataFrame, doc: str) -> DataFrame:
    """(doc, line_no, depth): braces open after each line, strings and line comments aside."""
    from pyspark.sql import Window

    bare = F.regexp_replace("line", r"""\\.|"(?:\\.|[^"\\])*(?:"|$)|'(?:\\.|[^'\\])*(?:'|$)|`(?:\\.|[^`\\])*(?:`|$)|//.*""", "")
    delta = F.regexp_count(bare, F.lit(r"\{")) - F.regexp_count(bare, F.lit(r"\}"))
    return ls.select(doc, "line_no", F.sum(delta).over(Window.partitionBy(doc).orderBy("line_no")).cast("long").alias("depth"))

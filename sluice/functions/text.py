"""Line and text functions, as Columns over strings and arrays of lines."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# The escape sequences that are stripped.
ANSI = r"\x1b\[[?]?[0-9;]*[A-Za-z]|\x1b\][^\x07\x1b]*(?:\x07|\x1b\\)|\x1b[()][AB012]|\x1b[=>Nno|}~78DHM]"

# Lines of terminal noise (matched on the trimmed line; (?i:) where case doesn't count).
NOISE = (
    r"^.*[█▓▒░]{3,}.*$",
    r"^.*[#=\-]{5,}>?\s*\d+%",
    r"^[\s]*[⠋⠙⠹⠸⠼⠴⠦⠧⠇⠏⣾⣽⣻⢿⡿⣟⣯⣷⠁⠂⠄⡀⢀⠠⠐⠈|/\\\-⸩][\s]",
    r"^\s*\.{4,}\s*$",
    r"(?i:^npm\s+(timing|verb|info|notice)\s)",
    r"(?i:^npm\s+warn\s+(notsup|EBADENGINE|ERESOLVE)\s)",
    r"(?i:downloading.*\d+(\.\d+)?\s*(kb|mb|gb|bytes)\s*[/|]\s*\d+)",
    r"(?i:^(GET|Fetch|fetch)\s+https?://)",
    r"^#\d+\s+\d+\.\d+\s",
    r"^\s*\[[\d:]+\]\s*$",
    r"^\s*(Memory|Tasks|CGroup|CPU):\s",
    r"^\s*└─\d+\s",
    r"^\s*Loaded:\s.*;\s*(enabled|disabled|static)",
    r"^\s*Docs:\s",
    r"^\s*Process:\s+\d+\s+ExecStart",
    r"systemd\[\d+\]:\s*(Started|Stopped|Starting|Stopping)\s",
    r"systemd\[\d+\]:\s*Created slice",
    r"systemd\[\d+\]:\s*Reached target",
    r"systemd\[\d+\]:\s*Listening on",
    r"^top\s+-\s+\d+:\d+:\d+\s+up\s",
    r"^Tasks:\s+\d+\s+total",
    r"(?i:^%?Cpu\(s\):)",
    r"^[KMG]iB\s+(Mem|Swap)\s*:",
    r"^\s*PID\s+USER\s+PR\s+NI\s+VIRT\s+RES\s+SHR\s+S\s+%CPU\s+%MEM",
)

# Lines that tell an error.
ERRORS = (
    r"(?i:^error\s*[:!\[\]])",
    r"^ERR[!:|\s]",
    r"(?i:^npm\s+ERR!)",
    r"^\s*✗\s",
    r"^\s*×\s",
    r"(?i:^FATAL[\s:])",
    r"(?i:^FAIL[\s:])",
    r"(?i:^failed[\s:])",
    r"(?i:^panic[\s:])",
    r"^\s*at\s+.*\(.*:\d+:\d+\)",
    r"^\s*at\s+.*\s+\(.*\)",
    r"Traceback \(most recent call last\)",
    r"^TypeError:|^ReferenceError:|^SyntaxError:|^RangeError:|^ValueError:|^KeyError:|^AttributeError:|^ImportError:|^ModuleNotFoundError:|^FileNotFoundError:",
    r"(?i:^Exception|^Unhandled\s)",
    r"(?i:cannot find module)",
    r"(?i:command\s+(not\s+found|failed))",
    r"(?i:permission denied)",
    r"(?i:no such file or directory)",
    r"(?i:segmentation fault)",
    r"(?i:out of memory)",
    r"(?i:compilation? (error|failed))",
    r"(?i:build\s+failed)",
    r"(?i:Active:\s*(failed|inactive\s*\(dead\)))",
    r"(?i:\(Result:\s*(exit-code|core-dump|timeout|signal)\))",
    r"(?i:activating\s*\(auto-restart\))",
    r"(?i:Unit\s+\S+\s+could not be found)",
    r"(?i:kernel:\s.*segfault)",
    r"(?i:kernel:\s.*oom-killer)",
    r"(?i:\[failed\])",
)

# Lines that warn.
WARNINGS = (r"(?i:^warn(ing)?[\s:\[\]])", r"(?i:^npm\s+warn)", r"^\s*⚠\s", r"(?i:deprecated)")


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value worked out once however often ``then`` uses it (no UDF inside ``then``)."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def trim(x: Column) -> Column:
    """Space, and tab to carriage return, off both ends."""
    return F.btrim(x, F.lit(" \t\n\x0b\f\r"))


# Lower-case parts, one of which a line needs for the pattern to fit: cheaper to look for than the pattern.
NEEDS = {
    r"^.*[█▓▒░]{3,}.*$": ("█", "▓", "▒", "░"),
    r"^.*[#=\-]{5,}>?\s*\d+%": ("%",),
    r"(?i:downloading.*\d+(\.\d+)?\s*(kb|mb|gb|bytes)\s*[/|]\s*\d+)": ("downloading",),
    r"systemd\[\d+\]:\s*(Started|Stopped|Starting|Stopping)\s": ("systemd[",),
    r"systemd\[\d+\]:\s*Created slice": ("systemd[",),
    r"systemd\[\d+\]:\s*Reached target": ("systemd[",),
    r"systemd\[\d+\]:\s*Listening on": ("systemd[",),
    r"Traceback \(most recent call last\)": ("traceback (",),
    r"(?i:cannot find module)": ("cannot find module",),
    r"(?i:command\s+(not\s+found|failed))": ("command",),
    r"(?i:permission denied)": ("permission denied",),
    r"(?i:no such file or directory)": ("no such file",),
    r"(?i:segmentation fault)": ("segmentation",),
    r"(?i:out of memory)": ("out of memory",),
    r"(?i:compilation? (error|failed))": ("compilatio",),
    r"(?i:build\s+failed)": ("build",),
    r"(?i:Active:\s*(failed|inactive\s*\(dead\)))": ("active:",),
    r"(?i:\(Result:\s*(exit-code|core-dump|timeout|signal)\))": ("(result:",),
    r"(?i:activating\s*\(auto-restart\))": ("activating",),
    r"(?i:Unit\s+\S+\s+could not be found)": ("could not be found",),
    r"(?i:kernel:\s.*segfault)": ("kernel:",),
    r"(?i:kernel:\s.*oom-killer)": ("kernel:",),
    r"(?i:\[failed\])": ("[failed]",),
    r"(?i:deprecated)": ("deprecated",),
}


def _any(t: Column, low: Column, patterns) -> Column:
    """Whether one fits: first those bound to the line's start, in one regex that is tried there only; of the others
    those are tried whose needs the line has."""
    bound = [p for p in patterns if p not in NEEDS]
    free = [p for p in patterns if p in NEEDS]
    if not all(p.startswith(("^", "(?i:^")) for p in bound):
        raise ValueError("a pattern that isn't bound to the start needs a part to look for")
    out = t.rlike("^(?:" + "|".join(f"(?:{p})" for p in bound) + ")")
    if not free:
        return out
    parts = list(dict.fromkeys(x for p in free for x in NEEDS[p]))
    may = reduce(or_, [F.contains(low, F.lit(x)) for x in parts])
    return out | (may & t.rlike("|".join(f"(?:{p})" for p in free)))


def findings(line: Column) -> Column:
    """STRUCT(noise, error, warning) of a line, which is trimmed and put into lower case once."""
    return _tested(line, lambda t, low: F.struct(_noise(t, low).alias("noise"), _any(t, low, ERRORS).alias("error"), _any(t, low, WARNINGS).alias("warning")))


def _noise(t: Column, low: Column) -> Column:
    return (t != "") & _any(t, low, NOISE)


def _tested(line: Column, test: Callable[[Column, Column], Column]) -> Column:
    both = bound(trim(line), lambda t: F.struct(t.alias("t"), F.lower(t).alias("low")))
    return bound(both, lambda v: test(v["t"], v["low"]))


def is_noise(line: Column) -> Column:
    return _tested(line, _noise)


def is_error(line: Column) -> Column:
    return _tested(line, lambda t, low: _any(t, low, ERRORS))


def is_warning(line: Column) -> Column:
    return _tested(line, lambda t, low: _any(t, low, WARNINGS))


def is_blank(line: Column) -> Column:
    return ~line.rlike(r"\S")


def _if_has(text: Column, part: str, then: Column) -> Column:
    """then, worked out only for texts with the part (a plain search is far cheaper than a pattern)."""
    return F.when(F.contains(text, F.lit(part)), then).otherwise(text)


def newlines(text: Column) -> Column:
    """CRLF and CR become LF."""
    return _if_has(text, "\r", F.regexp_replace(text, r"\r\n?", "\n"))


def strip_ansi(text: Column) -> Column:
    """Escape sequences and carriage returns that don't end a line go; overwritten text stays."""
    bare = _if_has(text, "\x1b", F.regexp_replace(text, ANSI, ""))
    return F.when(F.contains(text, F.lit("\r")), F.regexp_replace(bare, r"\r(?!\n)", "")).otherwise(bare)


def lines(text: Column) -> Column:
    return F.split(newlines(text), "\n", -1)


def strip_line_number(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s*\d+\s*[:|]\s?", "")


def has_line_numbers(ls: Column) -> Column:
    """Over 60 % of the first ten lines that aren't blank, three at least, begin with a number."""
    first = F.slice(F.filter(ls, lambda x: x.rlike(r"\S")), 1, 10)
    hits = lambda f: F.size(F.filter(f, lambda x: x.rlike(r"^\s*\d+\s*[:|]\s?")))
    return bound(first, lambda f: (F.size(f) >= 3) & (hits(f) > 0.6 * F.size(f)))


def number_lines(ls: Column) -> Column:
    return F.transform(ls, lambda x, i: F.concat((i + 1).cast("string"), F.lit(": "), x))


def normalize_line(line: Column) -> Column:
    """Hex runs with a digit become H, numbers N; space is squeezed."""
    hex = F.when(line.rlike(r"(?i)[0-9a-f]{7}"), F.regexp_replace(line, r"(?i)(?=[0-9a-f]*\d)[0-9a-f]{7,}", "H")).otherwise(line)
    x = F.when(line.rlike("[0-9]"), F.regexp_replace(hex, r"\d+", "N")).otherwise(line)
    return trim(F.when(line.rlike(r"\s\s|[\t\r\n\f\x0b]"), F.regexp_replace(x, r"\s+", " ")).otherwise(x))


def squeeze(text: Column) -> Column:
    return trim(F.regexp_replace(text, r"\s+", " "))


def rtrim_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"(?m)[ \t]+$", "")


def indent(line: Column) -> Column:
    return F.length(F.regexp_extract(line, r"^(\s*)", 1))


def collapse_blanks(ls: Column) -> Column:
    """Each run of blank lines becomes one empty line."""
    before = F.concat(F.array(F.lit("-")), ls)
    kept = F.zip_with(ls, before, lambda x, p: F.when(is_blank(x), F.when(~is_blank(p), "")).otherwise(x))
    return F.filter(kept, lambda x: x.isNotNull())


def units(text: Column) -> Column:
    """UTF-16 code units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def estimate_tokens(text: Column) -> Column:
    return F.ceil(units(text) / 4)


def line_tokens(ls: Column) -> Column:
    """A quarter of each line's units and its line end, rounded up, summed."""
    return F.aggregate(ls, F.lit(0).cast("long"), lambda a, x: a + F.ceil((units(x) + 1) / 4))


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def saved_percent(before: Column, after: Column) -> Column:
    return F.when(before == 0, 0).otherwise(F.greatest(F.lit(0), half_up((1 - after / before) * 100))).cast("int")


def ratio(before: Column, after: Column) -> Column:
    return F.when(before == 0, 1.0).otherwise(after / before)


def round3(x: Column) -> Column:
    return half_up(x * 1000) / 1000


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def pluralize(word: str, n: Column) -> Column:
    many = word + ("es" if word.endswith(("ch", "sh")) else "s")
    return F.when(n == 1, word).otherwise(many)


def git_path(path: Column) -> Column:
    """Unquoted, without one a/ or b/; /dev/null as it is."""
    p = F.regexp_replace(trim(path), r'^"(.*)"$', "$1")
    return F.when(p == "/dev/null", p).otherwise(F.regexp_replace(p, r"^[ab]/", ""))


def footer(before: Column, after: Column, percent: Column, label: str = "condensed", unit: str = "lines") -> Column:
    return F.format_string(f"--- {label}: %d {unit} → %d {unit} (%d%% saved) ---", before, after, percent)

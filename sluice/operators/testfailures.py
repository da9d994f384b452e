"""Whole test reports: status, counts and failures, by runner.

A runner's rule cuts the lines into sections (a test's name and the lines that
tell about it); one digest makes a failure of any section.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from .testreport import COUNT, runner

I = re.I  # noqa: E741
# Lines that tell an error, lines of context, lines that end a section, durations and places.
ERROR_LINE = (
    r"(?i:^AssertionError[:\s])", r"(?i:^TypeError[:\s])", r"(?i:^ReferenceError[:\s])", r"(?i:^SyntaxError[:\s])", r"^Error[:\s]",
    r"^expect\(", r"(?i:^thread\s+'.+'\s+panicked\s+at\s+)", r"(?i:^panic[:\s])", r"^E\s+",
)
CONTEXT_LINE = (
    r"(?i:^Expected[:\s])", r"(?i:^Received[:\s])", r"^\d+\s*\|", r"^>\s*\d+\s*\|", r"^\|", r"^[-+]\s", r"(?i:^left:\s*)", r"(?i:^right:\s*)",
    r"(?i:^assert\b)", r"(?i:^assertion\b)", r"^E\s+", r"^→\s*", r"^\s*at\s+",
)
BREAKS = (
    r"^Test Suites:", r"^Tests:", r"^Snapshots:", r"^Time:", r"^Test Files", r"^Duration", r"^Start at", r"^Ran all test suites", r"^test result:",
)
AMOUNT = r"([0-9]+(?:\.[0-9]+)?\s*(?:ms|s|m|h))"
DURATIONS = (rf"\bin\s+{AMOUNT}\b", rf"\bfinished in\s+{AMOUNT}\b", rf"^\s*Time:\s*{AMOUNT}\b", rf"^\s*Duration\s+{AMOUNT}\b", rf"\({AMOUNT}\)\s*$")
PLACES = (
    r"\(([^()]+:\d+:\d+)\)",
    r"([A-Za-z0-9_./\\-]+\.(?:[cm]?[jt]sx?|py|go|rs):\d+(?::\d+)?)",
    r"\bat\s+([A-Za-z0-9_./\\-]+:\d+:\d+)\b",
)
FIRST_ERROR = {"go": r"^[^:\s]+:\d+:\s*(.+)$", "cargo": r"(?i)^thread\s+'.+'\s+panicked\s+at\s+(.+)$"}
FIELDS = ("total", "passed", "failed", "skipped")

_error, _context = re.compile("|".join(ERROR_LINE)), re.compile("|".join(CONTEXT_LINE))
_break = re.compile("|".join(BREAKS), I)
_durations, _places = [re.compile(p, I) for p in DURATIONS], [re.compile(p) for p in PLACES]
_count = re.compile(COUNT)


@dataclass
class Failure:
    name: str
    location: str | None = None
    error: str | None = None
    context: list[str] = field(default_factory=list)


def _first(patterns, line: str) -> str | None:
    return next((m[1] for p in patterns if (m := p.search(line))), None)


def duration(line: str) -> str | None:
    found = _first(_durations, line)
    return found and re.sub(r"\s+", "", found)


def _plain(error: str) -> str:
    return re.sub(r"^→\s*", "", re.sub(r"^E\s+", "", error)).strip()


def digest(name: str, body: list[str], kind: str) -> Failure:
    """The first place and error that the lines tell, and their lines of context."""
    own, out = re.compile(FIRST_ERROR.get(kind, r"(?!)")), Failure(" ".join(name.split()))
    for line in filter(str.strip, body):
        t = line.strip()
        out.location = out.location or _first(_places, line)
        if not out.error:
            out.error = (m[1].strip() if (m := own.search(t)) else _plain(t) if _error.search(t) else None) or None
        if _context.search(t) and out.context[-1:] != [t]:
            out.context.append(t)
    return out


def _alike(a: str, b: str) -> bool:
    tail = a.split("::")[-1]
    return a in b or b in a or bool(tail) and tail == b.split("::")[-1]


def merged(failures: list[Failure]) -> list[Failure]:
    """One failure for names that are alike (not transitive: the first that fits takes it)."""
    out: list[Failure] = []
    for f in failures:
        old = next((x for x in out if _alike(x.name, f.name)), None)
        if old is None:
            out.append(Failure(f.name, f.location, f.error, list(f.context)))
            continue
        old.name = max(old.name, f.name, key=len)
        old.location, old.error = old.location or f.location, old.error or f.error
        old.context += [x for x in dict.fromkeys(f.context) if x not in old.context]
    return out


def counts(line: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for n, word in _count.findall(line):
        w, n = word.lower(), int(n)
        if w == "total" or w.startswith(("pass", "fail")):
            out[{"t": "total", "p": "passed", "f": "failed"}[w[0]]] = n
        else:
            key = "failed" if w.startswith("error") else "skipped"
            out[key] = out.get(key, 0) + n
    if m := re.search(r"\brunning\s+(\d+)\s+tests?\b", line, I):
        out["total"] = int(m[1])
    if re.search("tests?", line, I) and (m := re.search(r"\((\d+)\)\s*$", line)):
        out.setdefault("total", int(m[1]))
    return out


def derived(s: dict) -> dict:
    """What one count lacks and the others tell."""
    s, skipped = dict(s), s.get("skipped", 0)
    if known := [s[k] for k in FIELDS[1:] if k in s]:
        s.setdefault("total", sum(known))
    for k, other in (("passed", "failed"), ("failed", "passed")):
        if "total" in s and other in s:
            s.setdefault(k, max(0, s["total"] - s[other] - skipped))
    return s


def _summed(lines: list[str]) -> dict:
    out: dict = {}
    for x in lines:
        out |= counts(x)
        if d := duration(x):
            out["duration"] = d
    return out


def _pytest(lines: list[str]):
    at = next((k for k, x in enumerate(lines) if re.search(r"\bFAILURES\b", x)), len(lines))
    parts: list[tuple[str, list[str]]] = []
    for x in lines[at + 1:]:
        t = x.strip()
        if re.search("short test summary info", t, I) or re.match(r"=+\s*\d+\s+", t) and re.search("passed|failed|error|skipped", t, I):
            break
        if m := re.match(r"_{2,}\s*(.+?)\s*_{2,}$", x):
            parts.append((m[1], []))
        elif parts:
            parts[-1][1].append(x)
    found = [digest(*p, "pytest") for p in parts]
    at = next((k for k, x in enumerate(lines) if re.search("short test summary info", x, I)), len(lines))
    for t in map(str.strip, lines[at + 1:]):
        if t.startswith("="):
            break
        if m := re.match(r"(?:FAILED|ERROR)\s+(.+?)(?:\s+-\s+(.+))?$", t):
            found.append(Failure(" ".join(m[1].split()), error=m[2] and m[2].strip()))
    return _summed(lines), found


def _jest(lines: list[str], kind: str):
    tests: dict = {}
    suites: dict = {}
    for t in map(str.strip, lines):
        if re.match(r"Tests?:|Tests\s", t, I):
            tests |= counts(t)
        if re.match(r"Test Suites:|Test Files\s", t, I):
            suites |= counts(t)
    told = next((d for x in reversed(lines) if (d := duration(x.strip()))), None)
    summary = (tests if tests.keys() & {"total", "passed", "failed"} else suites) | ({"duration": told} if told else {})

    parts: list[list] = []  # name, body, the file when it ended
    file, inside = None, False

    def end():
        nonlocal inside
        if inside:
            parts[-1][2] = file
        inside = False

    def begin(name: str):
        nonlocal inside
        end()
        parts.append([name, [], None])
        inside = True

    for x in lines:
        t = x.strip()
        if not t:
            continue
        if _break.search(t):
            end()
        elif m := re.match(r"\s*FAIL\s+(.+)$", x):
            end()
            case = re.match(r"\s*FAIL\s+(.+?)\s+>\s+(.+)$", x)
            file = (case or m)[1].strip()
            begin(f"{file} > {case[2].strip()}" if case else file)
        elif re.match(r"\s*PASS\s+(.+)$", x):
            end()
            file = None
        elif m := re.match(r"\s*[❯>]\s+(.+\.(?:[cm]?[jt]sx?))\s+\(\d+\)", x):
            file = m[1].strip()
        elif m := re.match(r"\s*[●×✗]\s+(.+)$", x):
            begin(f"{file} > {m[1].strip()}" if file else m[1].strip())
        else:
            if not inside and file and _error.search(t):
                begin(file)
            if inside:
                parts[-1][1].append(x)
    open_at_end = inside
    end()
    found = []
    for k, (name, body, of) in enumerate(parts):
        f = digest(name, body, kind)
        empty = of is not None and f.name == of and not (f.location or f.error or f.context)
        if not empty or not found and open_at_end and k == len(parts) - 1:
            found.append(f)
    return summary, found


def _go(lines: list[str]):
    parts, pending, n = [], None, dict.fromkeys(("PASS", "FAIL", "SKIP"), 0)
    inside, summary = False, {}
    for x in lines:
        if re.match(r"===\s+RUN\s+\S+", x):
            pending, inside = [], False
        elif m := re.match(r"---\s+(PASS|FAIL|SKIP):\s+([^\s(]+)\s+\([^)]+\)$", x):
            n[m[1]] += 1
            inside = m[1] == "FAIL"
            if inside:
                parts.append((m[2], pending or []))
            pending = None
        else:
            if m := re.match(r"(?:ok|FAIL)\s+\S+\s+([0-9]+(?:\.[0-9]+)?s)\b", x):
                summary["duration"] = m[1]
            if pending is not None:
                pending.append(x)
            if re.match(r"FAIL\s*$|(?:ok|FAIL)\s+\S+\s+\d+(?:\.\d+)?s\b", x.strip()):
                inside = False
            if inside:
                parts[-1][1].append(x)
    found = [digest(*p, "go") for p in parts]
    summary |= {"passed": n["PASS"], "failed": max(n["FAIL"], len(found)), "skipped": n["SKIP"]}
    if any(n.values()):
        summary["total"] = sum(n.values())
    return summary, found


def _cargo(lines: list[str]):
    summary: dict = {}
    parts, inside, listed = [], False, {}
    for x in lines:
        if m := re.match(r"test\s+(.+?)\s+\.\.\.\s+FAILED$", x):
            listed[" ".join(m[1].split())] = None
        if m := re.match(r"test result:\s*(?:ok|FAILED)\.\s*(\d+)\s+passed;\s*(\d+)\s+failed;\s*(\d+)\s+ignored;.*finished in\s+([0-9]+(?:\.[0-9]+)?s)", x, I):
            summary |= {"passed": int(m[1]), "failed": int(m[2]), "skipped": int(m[3]), "duration": m[4]}
        else:
            summary |= _summed([x])
        if m := re.match(r"-{4}\s+(.+?)\s+(?:stdout|stderr)\s+-{4}$", x):
            parts.append((m[1], []))
            inside = True
        elif re.match(r"test result:|failures:\s*$", x.strip(), I):
            inside = False
        elif inside:
            parts[-1][1].append(x)
    found = [digest(*p, "cargo") for p in parts]
    known = {f.name for f in found}
    return summary, found + [Failure(name) for name in listed if name not in known]


def _unknown(lines: list[str]):
    found = []
    for t in filter(None, map(str.strip, lines)):
        if m := re.match(r"(?:FAIL(?:ED)?|ERROR|✗|×)\s*[:\-]?\s*(.+)?$", t, I):
            found.append(Failure(" ".join((m[1] or "failure").split())))
        elif _error.search(t) or re.search(r"\b(?:assert|panic)\b", t, I):
            found.append(Failure("failure", error=_plain(t), context=[t]))
    return _summed(lines), found


# What a whole report says of failure and success, by runner.
MARKS = {
    "pytest": (r"\bFAILED\b", None),
    "jest": (r"(?m)^\s*FAIL\s+|^\s*[×✗]\s", None),
    "vitest": (r"(?m)^\s*FAIL\s+|^\s*[×✗]\s", None),
    "go": (r"(?m)^FAIL\s*$|^FAIL\s+\S+\s+", r"(?m)^PASS\s*$|^ok\s+\S+\s+"),
    "cargo": (r"(?i)test result:\s*FAILED\.", r"(?i)test result:\s*ok\."),
    "unknown": (r"(?i)\b(fail(?:ed)?|error|panic)\b", r"(?i)\b(pass(?:ed)?|ok)\b"),
}
RULES = {
    "pytest": _pytest, "jest": lambda ls: _jest(ls, "jest"), "vitest": lambda ls: _jest(ls, "vitest"), "go": _go, "cargo": _cargo, "unknown": _unknown,
}


def read_report(text: str, kind: str) -> dict:
    told, found = RULES[kind](text.split("\n"))
    bad, good = MARKS[kind]
    s, found = derived(told), merged(found)
    if found:
        s.setdefault("failed", len(found))
    failed, passed = s.get("failed", 0) > 0, s.get("passed")
    by_failures = bool(found) and kind != "cargo"
    if failed or by_failures or re.search(bad, text):
        status = "fail"
    elif good is None:
        status = "unknown" if passed is None else "pass"
    else:
        status = "pass" if re.search(good, text) or kind != "cargo" and (passed or 0) > 0 else "unknown"
    s = s if kind == "cargo" else derived(s)
    blocks = [{"test_name": f.name, "location": f.location, "error": f.error, "context": f.context} for f in found]
    return {"runner": kind, "status": status, **{k: s.get(k) for k in FIELDS}, "duration": s.get("duration"), "failures": blocks}


REPORT = """runner string, status string, total int, passed int, failed int, skipped int, duration string,
  failures array<struct<test_name: string, location: string, error: string, context: array<string>>>"""


def parse_report(text: Column, kind: Column | None = None) -> Column:
    """A report's text -> STRUCT(runner, status, total, passed, failed, skipped, duration, failures); null text: an empty report."""

    @F.pandas_udf(REPORT)
    def run(texts: pd.Series, kinds: pd.Series) -> pd.DataFrame:
        rows = [read_report(x, k) for x, k in zip(texts, kinds)]
        out = pd.DataFrame(rows, columns=["runner", "status", *FIELDS, "duration", "failures"])
        return out.astype(dict.fromkeys(FIELDS, "Int32"))

    whole = F.coalesce(T.newlines(text), F.lit(""))
    return run(whole, F.coalesce(kind, F.lit("unknown")) if kind is not None else runner(whole))


def render(report: Column, text: Column) -> Column:
    """An array of lines: the summary and, unless all passed, a block for each failure."""
    return T.bound(F.struct(report.alias("r"), text.alias("t")), lambda v: _told(v["r"], v["t"]))


def _told(r: Column, text: Column) -> Column:
    words = lambda *parts: F.filter(F.array(*parts), lambda x: x.isNotNull())
    some = lambda c, word, least=0: F.when(c >= least, F.concat(c.cast("string"), F.lit(f" {word}")))
    paren = lambda xs: F.when(F.size(xs) > 0, F.concat(F.lit(" ("), F.array_join(xs, ", "), F.lit(")"))).otherwise("")
    skipped, took = some(r["skipped"], "skipped", 1), r["duration"]
    n = F.coalesce(r["passed"], r["total"], F.lit(0))
    ok = F.concat(F.lit("✓ "), n.cast("string"), F.lit(" "), T.pluralize("test", n), F.lit(" passed"), paren(words(skipped, took)))
    bad = F.coalesce(r["failed"], F.size(r["failures"]))
    of = F.when(r["total"] > 0, F.concat(bad.cast("string"), F.lit("/"), r["total"].cast("string"), F.lit(" tests failed"))).otherwise(
        F.concat(bad.cast("string"), F.lit(" "), T.pluralize("test", bad), F.lit(" failed"))
    )
    fail = F.concat(F.lit("✗ "), of, paren(words(some(r["passed"], "passed"), skipped, took)))
    told = words(some(r["total"], "total"), some(r["passed"], "passed"), some(r["failed"], "failed"), skipped, took)
    odd = (
        F.when(~F.coalesce(text, F.lit("")).rlike(r"\S"), "? No test output received")
        .when(F.size(told) > 0, F.concat(F.lit("? Unrecognized runner"), paren(told)))
        .otherwise("? Unrecognized test output")
    )
    line = lambda lead, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(lead), c))
    block = lambda f: F.filter(
        F.concat(
            F.array(F.lit(""), F.concat(F.lit("FAIL "), f["test_name"]), line("  at ", f["location"]), line("  ", f["error"])),
            F.transform(F.filter(F.slice(f["context"], 1, 4), lambda x: ~x.eqNullSafe(f["error"])), lambda x: F.concat(F.lit("  "), x)),
        ),
        lambda x: x.isNotNull(),
    )
    blocks = F.flatten(F.transform(r["failures"], block))
    head = F.when(r["status"] == "pass", ok).when(r["status"] == "fail", fail).otherwise(odd)
    return F.when(r["status"] == "pass", F.array(head)).otherwise(F.concat(F.array(head), blocks))

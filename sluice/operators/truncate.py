"""Truncation of arrays of lines, by lines and by tokens, with built-in functions only.

What a budget of lines keeps is told by four numbers: the head, a middle span
(the lines around errors, or none), and the tail; what lies between is named by
markers.  The tokens of any such choice come from running sums, so a search
over budgets doesn't make the lines it doesn't choose.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

# The share of the kept lines that the head gets.
HEAD = {"api": 0.6, "search": 0.6, "grep": 0.6, "read": 0.6, "bash": 0.4, "test": 0.4, "web": 0.65, "ls": 0.7, "diff": 0.75}


# Lines at which source text is best cut, and lines of a test report that tell of failures.
BOUNDARY = (
    r"^\s*(?:(export\s+)?(async\s+)?(function|class|interface|type|enum|const|let|var|def|fn|pub|func|struct|impl|module|namespace)\s"
    r"|(public|private|protected|static|abstract)\s|\}$|\};$|$)"
)
FAILURE = r"(?i:^FAIL\b)|^✗\b|^×\b|^\s*at\s+|(?i:^AssertionError[:\s])|(?i:\bexpected\b)|(?i:\breceived\b)|(?i:\bpanic\b)|^E\s+|^Error[:\s]"


#: Kinds whose flagged lines stay together: (flag, lines before, lines after).
AROUND: dict[str, tuple[Callable[[Column], Column], int, int]] = {
    "bash": (T.is_error, 3, 4),
    "test": (lambda x: T.trim(x).rlike(FAILURE), 2, 3),
}
#: Kinds whose token budget is found by halving.
HALVING = ("api", "search")


def _int(c: Column) -> Column:
    return c.cast("int")


def _marker(n: Column) -> Column:
    return F.concat(F.lit("... ("), n.cast("string"), F.lit(" lines omitted) ..."))


def gap(n: Column) -> Column:
    """The marker of n omitted lines as an array; empty for none."""
    return F.when(n > 0, F.array(_marker(n))).otherwise(F.array().cast("array<string>"))


def gap_tokens(n: Column) -> Column:
    return F.when(n > 0, F.ceil((F.length(_marker(n)) + 1) / 4)).otherwise(F.lit(0)).cast("long")


def sums(ls: Column) -> Column:
    """STRUCT(t, s, pre): tokens of each line, and running sums at every s-th line (s: the root of their number)."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    tokens = F.transform(ls, lambda x: F.ceil((T.units(x) + 1) / 4).cast("long"))
    step = lambda t: F.struct(t.alias("t"), F.greatest(F.lit(1), _int(F.floor(F.sqrt(F.size(t))))).alias("s"))
    count = lambda v: _int(F.floor(F.size(v["t"]) / v["s"]))
    blocks = lambda v: F.struct(v["t"].alias("t"), v["s"].alias("s"), F.transform(F.sequence(F.lit(0), count(v)), lambda j: total(F.slice(v["t"], j * v["s"] + 1, v["s"]))).alias("b"))
    running = lambda v: F.struct(v["t"].alias("t"), v["s"].alias("s"), F.transform(F.sequence(F.lit(0), F.size(v["b"])), lambda j: total(F.slice(v["b"], F.lit(1), j))).alias("pre"))
    return T.bound(T.bound(T.bound(tokens, step), blocks), running)


def upto(v: Column, i: Column) -> Column:
    """Tokens of the first i lines, by their sums."""
    whole = _int(F.floor(i / v["s"]))
    return F.get(v["pre"], whole) + F.aggregate(F.slice(v["t"], whole * v["s"] + 1, i % v["s"]), F.lit(0).cast("long"), lambda x, y: x + y)


def head_count(kind: str, m: Column) -> Column:
    share = HEAD[kind]
    if kind in AROUND:
        return _int(F.floor(m * share))
    return F.greatest(F.lit(1), _int(F.floor((m - 1) * share)))


def _told(ls: Column, kind: str, tokens: bool) -> Column:
    """The lines with what their truncation asks of them, each worked out once."""
    own = [ls.alias("ls"), F.size(ls).alias("n")]
    if tokens:
        own.append(sums(ls).alias("sums"))
    if kind in AROUND:
        flag, before, after = AROUND[kind]
        first = lambda f: _int(F.array_position(f, True))
        ends = lambda f: F.struct(F.greatest(F.lit(0), first(f) - 1 - before).alias("start"), F.least(F.size(f), F.size(f) - first(F.reverse(f)) + after).alias("end"))
        own.append(T.bound(F.transform(ls, flag), lambda f: F.when(first(f) > 0, ends(f))).alias("at"))
    if kind == "read":
        own.append(F.transform(ls, lambda x: x.rlike(BOUNDARY)).alias("ends"))
    return F.struct(*own)


def _spans(v: Column, m: Column, kind: str) -> Column:
    """STRUCT(head, start, end, tail): m lines keep the first ``head``, those from start to end, and the last ``tail``."""
    n = v["n"]
    span = lambda h, s, e, t: F.struct(h.alias("head"), s.alias("start"), e.alias("end"), t.alias("tail"))
    head = head_count("api" if kind == "summary" else kind, m)
    tail = m - 1 - head
    if kind == "read":
        wanted = head
        near = [wanted + d for k in range(6) for d in dict.fromkeys((-k, k))]
        fits = lambda k: (k >= 1) & (k <= m - 1) & (k < n) & F.get(v["ends"], k)
        head = F.coalesce(*[F.when(fits(k), k) for k in near], wanted)
        tail = F.least(m - 1 - wanted, F.greatest(F.lit(0), m - 1 - head))
    cut = span(head, head, head, tail)
    if kind in AROUND:
        start, end = v["at"]["start"], v["at"]["end"]
        room = F.greatest(F.lit(0), m - (end - start) - 2)
        before = F.least(_int(F.floor(room * 0.4)), start)
        cut = F.when(start.isNotNull() & (end - start < m * 0.7), span(before, start, end, F.least(room - before, n - end))).otherwise(cut)
    zero = _int(F.lit(0))
    if kind == "summary":
        head = F.greatest(F.lit(1), m - 1)
        cut = span(head, head, head, zero)
    return F.when(n <= m, span(n, n, n, zero)).when(m <= 1, span(zero, zero, zero, zero)).otherwise(cut)


def _kept(v: Column, m: Column, kind: str) -> Column:
    """The lines that m keep."""
    def made(x: Column) -> Column:
        ls, n, c = x["v"]["ls"], x["v"]["n"], x["c"]
        return F.concat(
            F.slice(ls, F.lit(1), c["head"]), gap(c["start"] - c["head"]), F.slice(ls, c["start"] + 1, c["end"] - c["start"]),
            gap(n - c["tail"] - c["end"]), F.slice(ls, n - c["tail"] + 1, c["tail"]),
        )

    return T.bound(F.struct(v.alias("v"), _spans(v, m, kind).alias("c")), made)


def _tokens(v: Column, m: Column, kind: str) -> Column:
    """The tokens of what m lines keep."""
    n, p = v["n"], lambda i: upto(v["sums"], i)

    def made(c: Column) -> Column:
        inner = p(c["end"]) - p(c["start"]) + p(n) - p(n - c["tail"])
        return p(c["head"]) + inner + gap_tokens(c["start"] - c["head"]) + gap_tokens(n - c["tail"] - c["end"])

    return T.bound(_spans(v, m, kind), made)


def search_budget(n: Column, tokens: Callable[[Column], Column], most: int) -> Column:
    """The budget of lines that a coarse search in steps of the root of n, then a fine one, finds; 1 if none fits."""
    fits = lambda b: tokens(b) <= most
    step = F.greatest(F.lit(1), _int(F.floor(F.sqrt(n))))
    coarse = F.get(F.filter(F.sequence(F.greatest(n, F.lit(1)), F.lit(1), -step), fits), F.lit(0))

    def fine(first: Column) -> Column:
        top = F.least(n, first + step - 1)
        return F.coalesce(F.get(F.filter(F.sequence(F.greatest(top, first + 1), first + 1, F.lit(-1)), lambda b: (b <= top) & fits(b)), F.lit(0)), first)

    return T.bound(F.coalesce(coarse, F.lit(1)), fine)


def halving_budget(n: Column, tokens: Callable[[Column], Column], most: int) -> Column:
    """The budget of lines that halving finds; 1 if it finds none."""
    start = F.struct(F.lit(1).alias("lo"), n.alias("hi"), F.lit(1).alias("best"))

    def step(a: Column, _: Column) -> Column:
        mid = _int(F.floor((a["lo"] + a["hi"]) / 2))
        up = F.struct((mid + 1).alias("lo"), a["hi"].alias("hi"), mid.alias("best"))
        down = F.struct(a["lo"].alias("lo"), (mid - 1).alias("hi"), a["best"].alias("best"))
        return F.when(a["lo"] > a["hi"], a).when(tokens(mid) <= most, up).otherwise(down)

    return F.aggregate(F.sequence(F.lit(1), F.lit(32)), start, step, lambda a: a["best"])


def _budget(v: Column, most: int, kind: str) -> Column:
    find = halving_budget if kind in HALVING else search_budget
    found = find(v["n"], lambda b: _tokens(v, b, kind), most)
    return F.when(v["n"] == 0, 0).when(upto(v["sums"], v["n"]) <= most, v["n"]).otherwise(found)


def truncate(ls: Column, m: Column, kind: str) -> Column:
    """At most m lines: all, or a marker, or what the kind keeps with markers between."""
    own = T.bound(F.struct(ls.alias("ls"), m.alias("m")), lambda x: F.struct(_told(x["ls"], kind, False).alias("v"), x["m"].alias("m")))
    return T.bound(own, lambda x: _kept(x["v"], x["m"], kind))


def budget_for_tokens(ls: Column, most: int, kind: str) -> Column:
    """The number of lines whose truncation has at most ``most`` tokens; 1 if none has, all if there is no need."""
    return T.bound(T.bound(ls, lambda own: _told(own, kind, True)), lambda v: _budget(v, most, kind))


def by_tokens(ls: Column, most: int, kind: str) -> Column:
    """STRUCT(lines, exceeded): at most ``most`` tokens, or a marker alone that exceeds them."""
    told = T.bound(ls, lambda own: _told(own, kind, True))
    cut = T.bound(T.bound(told, lambda v: F.struct(v.alias("v"), _budget(v, most, kind).alias("m"))), lambda x: _kept(x["v"], x["m"], kind))
    return T.bound(cut, lambda c: F.struct(c.alias("lines"), (T.line_tokens(c) > most).alias("exceeded")))


def fit(ls: Column, max_lines: int | None, max_tokens: int | None, kind: str) -> Column:
    """STRUCT(lines, exceeded): the kind's truncation by lines, then by tokens."""
    out = ls if max_lines is None else truncate(ls, F.lit(max_lines), kind)
    return F.struct(out.alias("lines"), F.lit(False).alias("exceeded")) if max_tokens is None else by_tokens(out, max_tokens, kind)


# --- chunks: each has lines that come first (its head and first hunk) and a rest -------------------------------------


def flat(chunks: Column) -> Column:
    """The chunks' lines in their order, an empty line between two chunks."""
    return T.bound(chunks, lambda c: F.flatten(F.transform(c, lambda x, i: F.concat(x["priority"], x["rest"], _between(c, i)))))


def _between(chunks: Column, i: Column, also: Column | None = None) -> Column:
    more = i < F.size(chunks) - 1
    return F.when(more if also is None else more & also, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))


def _parts(chunks: Column, tokens: bool) -> Column:
    """STRUCT(all, core, rest[, and their sums]) of chunks that are bound."""
    core = F.flatten(F.transform(chunks, lambda x, i: F.concat(x["priority"], _between(chunks, i))))
    rest = F.flatten(F.transform(chunks, lambda x, i: F.concat(x["rest"], _between(chunks, i, F.size(x["rest"]) > 0))))
    own = F.struct(flat(chunks).alias("all"), core.alias("core"), rest.alias("rest"))
    if not tokens:
        return own
    return T.bound(own, lambda v: F.struct(*[v[c].alias(c) for c in ("all", "core", "rest")], *[sums(v[c]).alias(f"{c}_sums") for c in ("all", "core", "rest")]))


def _choice(v: Column, m: Column, of: Callable[[str, Column, Column], Column], marker: Callable[[Column], Column], join: Callable[..., Column]) -> Column:
    """What m lines keep of chunks.  of(name, first, number) tells a run of lines, marker(k) the line for k omitted ones."""
    n, c, r = F.size(v["all"]), F.size(v["core"]), F.size(v["rest"])
    zero = _int(F.lit(0))
    head = F.greatest(F.lit(1), _int(F.floor((m - 1) * HEAD["diff"])))
    tail = F.greatest(F.lit(0), m - 1 - head)
    kept = F.greatest(F.lit(0), m - c - 1)
    crowded = join(of("core", zero, head), marker(c - head - tail), of("core", c - tail, tail))
    some = join(of("core", zero, c), of("rest", zero, kept), marker(r - kept))
    return (
        F.when(n <= m, of("all", zero, n)).when(m <= 1, marker(n)).when(c >= m, crowded)
        .when(r <= m - c, join(of("core", zero, c), of("rest", zero, r))).otherwise(some)
    )


def _chunk_lines(v: Column, m: Column) -> Column:
    return _choice(v, m, lambda name, first, k: F.slice(v[name], first + 1, F.greatest(k, F.lit(0))), gap, F.concat)


def _chunk_tokens(v: Column, m: Column) -> Column:
    def of(name: str, first: Column, k: Column) -> Column:
        return upto(v[f"{name}_sums"], F.least(first + k, F.size(v[name]))) - upto(v[f"{name}_sums"], F.least(first, F.size(v[name])))

    return _choice(v, m, of, gap_tokens, lambda *xs: sum(xs[1:], xs[0]))


def fit_chunks(chunks: Column, max_lines: int | None, max_tokens: int | None) -> Column:
    """STRUCT(lines, exceeded): first hunks before the rest.  The search by tokens begins with all chunks, whatever the
    limit by lines has cut; empty lines at the end go."""
    told = T.bound(chunks, lambda c: _parts(c, max_tokens is not None))
    if max_tokens is None:
        cut = T.bound(told, lambda v: v["all"] if max_lines is None else _chunk_lines(v, F.lit(max_lines)))
    else:
        def fitted(v: Column) -> Column:
            n = F.size(v["all"])
            found = search_budget(n, lambda b: _chunk_tokens(v, b), max_tokens)
            return F.struct(v.alias("v"), F.when(upto(v["all_sums"], n) <= max_tokens, F.greatest(n, F.lit(1))).otherwise(found).alias("m"))

        cut = T.bound(T.bound(told, fitted), lambda x: _chunk_lines(x["v"], x["m"]))
    exceeded = lambda c: F.lit(False) if max_tokens is None else T.line_tokens(c) > max_tokens
    return T.bound(without_end(cut), lambda c: F.struct(c.alias("lines"), exceeded(c).alias("exceeded")))


def without_end(ls: Column) -> Column:
    """Empty lines at the end go."""
    last = lambda own: F.coalesce(F.array_max(F.transform(own, lambda x, i: F.when(x != "", i + 1))), F.lit(0))
    return T.bound(ls, lambda own: F.slice(own, F.lit(1), last(own)))

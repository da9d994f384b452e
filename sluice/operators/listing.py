"""Directory listings as rows of entries."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Names of no interest at the root of a listing.
NOISE_NAMES = (".git", "node_modules", "__pycache__", ".ds_store", "thumbs.db")
LONG = r"^([\-dlcbps])[rwxStTs\-]{9}[+@]?\s+\d+\s+\S+(?:\s+\S+)?\s+\d+\s+\w{3}\s+\d{1,2}\s+(?:\d{2}:\d{2}|\d{4})\s+(.+)$"
TREE = r"^([│\s]*)(?:├──|└──)\s+(.*)$"
SUMMARY = r"(?i)^\s*\d+\s+director(?:y|ies),\s+\d+\s+files?\s*$"
# Labels of file types.
LABELS = {
    "ts": "TypeScript", "tsx": "TypeScript", "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript", "json": "JSON",
    "md": "Markdown", "py": "Python", "yml": "YAML", "yaml": "YAML", "toml": "TOML", "sh": "Shell", "bash": "Shell", "zsh": "Shell", "css": "CSS",
    "html": "HTML", "go": "Go", "rs": "Rust", "(none)": "No Extension",
}


def clean_name(name: Column) -> Column:
    x = F.regexp_replace(T.trim(name), r" -> .*$", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"^[\"'](.*)[\"']$", "$1"), r"[/]+$", ""), r"\*$", "")


def listing_format(ls: Column) -> Column:
    long = F.size(F.filter(ls, lambda x: T.trim(x).rlike(LONG)))
    return (
        F.when(F.exists(ls, lambda x: x.rlike(r"[├└]──")), "tree")
        .when((long >= 2) | F.exists(ls, lambda x: x.rlike(r"(?i)^\s*total\s+\d+")), "ls-long")
        .otherwise("path-list")
    )


def segments(path: Column) -> Column:
    """The parts of a path, ``.`` dropped and ``..`` resolved."""
    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda s: (s != "") & (s != "."))
    up = lambda a, s: F.when(s == "..", F.slice(a, F.lit(1), F.greatest(F.lit(0), F.size(a) - 1))).otherwise(F.concat(a, F.array(s)))
    return F.aggregate(parts, F.array().cast("array<string>"), up)


def entries(ls: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, line_no, segments, kind) of long and path lines; a directory header carries on to the lines below."""
    from pyspark.sql import Window

    w = Window.partitionBy(doc).orderBy("line_no")
    t = T.trim(F.col("line"))
    is_long, section = t.rlike(LONG), F.regexp_extract(t, r"^(\S.*):$", 1)
    carried = F.coalesce(F.last(F.nullif(section, F.lit("")), ignorenulls=True).over(w), F.lit(""))
    x = ls.withColumns({"dir": carried, "long": is_long, "t": t}).filter((F.col("t") != "") & (section == "") & ~F.col("t").rlike(r"(?i)^total\s+\d+|^find:|^Found \d+ file"))
    name = F.when(F.col("long"), F.regexp_extract("t", LONG, 2)).otherwise(F.col("t"))
    kind = F.when(F.col("long"), F.when(F.col("t").startswith("d"), "dir").otherwise("file")).when(F.col("t").endswith("/"), "dir").otherwise("unknown")
    path = F.when(F.col("dir") == "", clean_name(name)).otherwise(F.concat("dir", F.lit("/"), clean_name(name)))
    out = x.select(doc, "line_no", segments(path).alias("segments"), kind.alias("kind"))
    return out.filter((F.size("segments") > 0) & ~F.lower(F.get("segments", F.lit(0))).isin(*NOISE_NAMES))


def nodes(found: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Every path prefix once, with its kind: a node with children is a directory, an unknown one without is a file."""
    each = found.select(doc, "kind", F.size("segments").alias("n"), "segments", F.explode(F.sequence(F.lit(1), F.size("segments"))).alias("depth"))
    path = F.array_join(F.slice("segments", F.lit(1), F.col("depth")), "/")
    inner = (F.col("depth") < F.col("n")) | (F.col("kind") == "dir")
    return each.groupBy(doc, path.alias("path"), "depth").agg(F.when(F.bool_or(inner), "dir").otherwise("file").alias("kind"))


def type_counts(tree: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Files by extension."""
    ext = F.lower(F.regexp_extract(F.regexp_extract("path", r"([^/]*)$", 1), r"^.+\.([^.]+)$", 1))
    return tree.filter("kind = 'file'").groupBy(doc, F.when(ext == "", "(none)").otherwise(ext).alias("ext")).agg(F.count("*").alias("n_files"))


def read_tree(lines: list[str]) -> list[dict]:
    """Entries of a drawn tree; an entry's parent is the last one a level above it, in reach of its branch."""
    out, above = [], {}
    for m in filter(None, (re.match(TREE, x.rstrip()) for x in lines)):
        depth = len(m[1]) // 4
        name = re.sub(r" -> .*$", "", m[2].strip())
        name = re.sub(r"^[\"'](.*)[\"']$", r"\1", name)
        kind = "dir" if name.endswith("/") else "unknown"
        parts = [p for p in re.sub(r"\*$", "", name.rstrip("/")).split("/") if p not in ("", ".")]
        if parts:
            path = above.get(depth - 1, []) + parts
            above = {d: p for d, p in above.items() if d < depth} | {depth: path}
            out.append({"segments": path, "kind": kind})
    return out


def tree_entries(ls: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, line_no, segments, kind) of drawn trees; a document's drawing is read as a whole."""
    whole = ls.groupBy(doc).agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("l"))

    @F.pandas_udf("array<struct<segments: array<string>, kind: string>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: read_tree(list(x)))

    found = whole.select(doc, F.posexplode(run("l")).alias("line_no", "e")).select(doc, "line_no", "e.*")
    return found.filter(~F.lower(F.get("segments", F.lit(0))).isin(*NOISE_NAMES))


def root_names(ls: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, root) where a listing names its root: a drawing's first line, a long listing's first header of one part."""
    c, t = F.col("line"), T.trim(F.col("line"))
    parts = segments(F.regexp_extract(t, "^(.*):$", 1))
    header = t.endswith(":") & ~t.rlike(LONG) & (F.size(parts) == 1)
    per = ls.groupBy(doc).agg(
        F.bool_or(c.rlike(TREE)).alias("tree"),
        ((F.count_if(t.rlike(LONG)) >= 2) | F.bool_or(t.rlike(r"(?i)^total\s+\d+"))).alias("long"),
        F.min_by(t, F.when(t != "", F.col("line_no"))).alias("first"),
        F.min_by(F.get(parts, F.lit(0)), F.when(header, F.col("line_no"))).alias("section"),
    )
    plain = ~F.col("first").rlike(TREE) & ~F.col("first").rlike(SUMMARY)
    said = F.when(F.col("tree"), F.when(plain, F.col("first"))).when(F.col("long"), F.col("section"))
    last = F.regexp_extract(F.regexp_replace(T.trim(said), r":$|[/\\\\]+:?$", ""), r"([^/\\\\]*)$", 1)
    return per.filter(said.isNotNull()).select(doc, F.when(last.isin("", "."), "project").otherwise(last).alias("root"))


def strip_root(found: DataFrame, doc: str = "doc_id", roots: DataFrame | None = None, default: str = "project") -> DataFrame:
    """Entries with a ``root`` column.

    A document in ``roots`` keeps its entries whole; else a first part that
    all of two entries or more share goes and names the root.
    """
    first = F.get("segments", F.lit(0))
    per = found.groupBy(doc).agg(F.min(first).alias("a"), F.max(first).alias("b"), F.count("*").alias("n"))
    per = per.join(roots.withColumnRenamed("root", "said"), doc, "left") if roots is not None else per.withColumn("said", F.lit(None).cast("string"))
    common = F.col("said").isNull() & (F.col("n") >= 2) & (F.col("a") == F.col("b"))
    named = per.select(doc, common.alias("common"), F.coalesce("said", F.when(common, F.col("a")), F.lit(default)).alias("root"))
    out = found.join(named, doc).withColumn("segments", F.when(F.col("common"), F.slice("segments", F.lit(2), F.size("segments"))).otherwise(F.col("segments")))
    return out.filter((F.size("segments") > 0) & ~F.lower(first).isin(*NOISE_NAMES)).drop("common")


# Fixed value: signs in the order in which names sort, before letters.
SIGNS = "_-,;:!?.'\"()[]{}@*/\\&#%`^+<=>|~$0123456789"


def name_key(name: str) -> tuple:
    """Sorts names without regard to case and accents."""
    plain = [c for c in unicodedata.normalize("NFKD", name).lower() if not unicodedata.combining(c)]
    return tuple(SIGNS.find(c) if c in SIGNS else 256 + ord(c) for c in plain), name


def _extension(path: str) -> str:
    m = re.search(r"[^/]\.([^./]+)$", path)
    return m[1].lower() if m else "(none)"


def _wrapped(paths: list[str], width: int = 90) -> list[str]:
    out: list[str] = []
    for p in paths:
        if out and len(out[-1]) + 2 + len(p) <= width:
            out[-1] += f", {p}"
        else:
            out.append(f"  {p}")
    return out


def draw(root: str, nodes: list[tuple[str, bool]], depth: int | None = None, by_type: bool = False) -> list[str]:
    """Lines for the nodes (path, whether a directory): a drawn tree and its types, or files by type."""
    files = [p for p, is_dir in nodes if not is_dir]
    types: dict[str, list[str]] = {}
    for p in files:
        types.setdefault(_extension(p), []).append(p)
    groups = sorted(types.items(), key=lambda g: (-len(g[1]), name_key(g[0])))
    out = [f"{root}/ ({len(files)} files, {len(nodes) - len(files)} dirs)"]
    if by_type:
        for t, ps in groups:
            label = LABELS.get(t, t.upper())
            out += ["", f"{label} ({len(ps)} {'file' if len(ps) == 1 else 'files'}):", *_wrapped(sorted(ps, key=name_key))]
        return out if groups else [*out, "", "No files"]
    kids: dict[str, list[tuple[str, bool]]] = {}
    for p, is_dir in nodes:
        kids.setdefault(p.rpartition("/")[0], []).append((p, is_dir))
    for under in kids.values():
        under.sort(key=lambda n: (not n[1], name_key(n[0].rpartition("/")[2])))
    stack = [(p, is_dir, "", k == 0) for k, (p, is_dir) in enumerate(reversed(kids.get("", [])))] if depth is None or depth > 0 else []
    drawn = 0
    while stack:
        p, is_dir, lead, last = stack.pop()
        drawn += 1
        out.append(f"{lead}{'└── ' if last else '├── '}{p.rpartition('/')[2]}{'/' * is_dir}")
        if is_dir and (depth is None or p.count("/") + 1 < depth):
            stack += [(q, d, lead + ("    " if last else "│   "), k == 0) for k, (q, d) in enumerate(reversed(kids.get(p, [])))]
    told = ", ".join(f"{'[no-ext]' if t == '(none)' else '.' + t}({len(ps)})" for t, ps in groups)
    return out + ["(empty)"] * (not drawn) + ["", f"Types: {told or 'none'}"]


def render(found: DataFrame, doc: str = "doc_id", depth: int | None = None, by_type: bool = False, roots: DataFrame | None = None) -> DataFrame:
    """(doc, lines) of entries; a document's nodes become one drawing, so they are gathered by document."""
    rooted = strip_root(found, doc, roots)
    tree = nodes(rooted, doc).groupBy(doc).agg(F.collect_list(F.struct("path", (F.col("kind") == "dir").alias("is_dir"))).alias("nodes"))
    roots = rooted.groupBy(doc).agg(F.min("root").alias("root"))

    @F.pandas_udf("array<string>")
    def run(root: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series([draw(r, [(n["path"], n["is_dir"]) for n in x], depth, by_type) for r, x in zip(root, ns)])

    return tree.join(roots, doc).select(doc, run("root", "nodes").alias("lines"))

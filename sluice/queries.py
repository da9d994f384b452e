"""The registered queries of the tool-output operators, each with its SQL where SQL can express it.

The driver's tables hold no tool output, so most queries first spell some from
whole tables (search hits from orders, grep hits from lineitem, and so on).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import language, text, url
from . import plans, sources
from .operators import diff, grep, htmltree, jsonprune, lines, listing, routing, savings, search, source, syntax, testfailures, testreport, truncate, webtext
from .plans import api, bash, hooks, read, web
from .streaming import dedupe  # noqa: F401

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def _t(spark, d, name):
    return sources.table(spark, f"{d}/{name}.parquet")


# --- fixtures: the same expressions in Spark and in SQL -------------------------------------------

HITS = """SELECT CAST(o_custkey % 50 AS VARCHAR(9)) AS query,
  CASE o_orderkey % 5 WHEN 0 THEN 'facts' WHEN 1 THEN 'baidu' WHEN 2 THEN 'Bing' WHEN 3 THEN 'duckduckgo' ELSE 'sogou' END AS engine,
  CAST(o_orderkey % 5 AS INT) AS engine_ord, CAST(o_orderkey AS INT) AS position,
  concat('Title ', o_orderstatus, CAST(o_orderkey % 1000 AS VARCHAR(9))) AS title,
  concat('HTTPS://www.Site', CAST(o_custkey % 3 AS VARCHAR(9)), '.com/p', CAST(o_orderkey % 7 AS VARCHAR(9)),
    CASE WHEN o_orderkey % 2 = 0 THEN '/' ELSE '' END, '?utm_source=a', CASE WHEN o_orderkey % 3 = 0 THEN '&id=1' ELSE '' END) AS url,
  concat('about ', o_orderpriority, ' ', CAST(o_orderkey AS VARCHAR(12))) AS snippet FROM orders"""
NORM = """concat('https://site', regexp_extract(url, 'Site(\\d+)', 1), '.com/p', regexp_extract(url, '/p(\\d+)', 1), CASE WHEN url LIKE '%id=1' THEN '?id=1' ELSE '' END)"""
GREP = """SELECT l_suppkey AS doc_id, l_orderkey * 8 + l_linenumber AS line_no,
  concat('src/m', CAST(l_partkey % 3 AS VARCHAR(9)), '/f', CAST(l_partkey % 30 AS VARCHAR(9)), '.py:', CAST(l_orderkey % 400 + 1 AS VARCHAR(9)),
    CASE WHEN l_linenumber % 2 = 0 THEN concat(':', CAST(l_linenumber AS VARCHAR(9))) ELSE '' END, ':qty ', l_returnflag) AS line FROM lineitem"""
GREP_SQL = """SELECT l_suppkey AS doc_id, l_orderkey * 8 + l_linenumber AS line_no, concat('src/m', l_partkey % 3, '/f', l_partkey % 30, '.py') AS file,
  CAST(l_orderkey % 400 + 1 AS INT) AS line, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_linenumber AS INT) END AS col, concat('qty ', l_returnflag) AS text FROM lineitem"""
LOG = """SELECT user_id AS doc_id, event_id AS line_no, CASE WHEN event_id % 7 < 3 THEN concat('npm info step ', CAST(event_id AS VARCHAR(12)))
  WHEN event_id % 7 = 3 THEN 'Downloading x 1.5 MB / 20 MB' WHEN event_id % 7 = 4 THEN concat('error: ', event_type)
  WHEN event_id % 7 = 5 THEN '' ELSE concat('warning: ', event_type) END AS line FROM events"""


def _views(spark, d, *names):
    for n in names:
        _t(spark, d, n).createOrReplaceTempView(n)


def _sql(spark, d, sql, *names):
    _views(spark, d, *names)
    return spark.sql(sql)


def _hits(spark, d):
    return _sql(spark, d, HITS, "orders")


def _grep(spark, d):
    ls = _sql(spark, d, GREP, "lineitem")
    return ls.select("doc_id", "line_no", grep.parse_hit(F.col("line")).alias("h")).select("doc_id", "line_no", "h.*")


def _log(spark, d):
    return _sql(spark, d, LOG, "events")


# --- lines ------------------------------------------------------------------------------------------

TRIM = r"regexp_replace(line, '^\s+|\s+$', '', 'g')"
MATCH = lambda ps: f"regexp_matches({TRIM}, '{'|'.join(f'(?:{p})' for p in ps)}')"
LINES = r"SELECT doc_id, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS l FROM documents)"


@query(rf"""SELECT doc_id, count(*) AS n_lines, count_if(NOT regexp_matches(line, '\S')) AS n_blank, count_if({MATCH(text.ERRORS)}) AS n_error,
  count_if({MATCH(text.WARNINGS)}) AS n_warning, count_if({TRIM} <> '' AND {MATCH(text.NOISE)}) AS n_noise,
  CAST(sum(ceil((length(line) + 1) / 4.0)) AS BIGINT) AS n_tokens FROM ({LINES}) GROUP BY doc_id""")
def line_counts(spark, d):
    return lines.line_counts(_t(spark, d, "documents"), "doc_id", "text")


@query(rf"""WITH l AS ({LOG}), f AS (SELECT *, {TRIM} <> '' AND {MATCH(text.NOISE)} AS noise FROM l),
g AS (SELECT *, line_no - (sum(1) OVER (PARTITION BY doc_id, noise ORDER BY line_no)) AS x, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - row_number() OVER (PARTITION BY doc_id, noise ORDER BY line_no) AS island FROM f),
s AS (SELECT *, count(*) OVER w AS n, min(line_no) OVER w AS first FROM g WINDOW w AS (PARTITION BY doc_id, noise, island))
SELECT doc_id, line_no, CASE WHEN noise THEN concat('  ... (', n, ' progress/noise lines filtered)') ELSE line END AS line FROM s WHERE NOT noise OR (n >= 3 AND line_no = first)""")
def noise_filter(spark, d):
    return lines.filter_noise(_log(spark, d), "doc_id")


@query(rf"""WITH l AS ({LINES}), k AS (SELECT doc_id, line_no, line, lower({TRIM}) AS k FROM l)
SELECT doc_id, line_no, line FROM k WHERE k <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, k ORDER BY line_no) = 1""")
def distinct_lines(spark, d):
    return lines.first_of_equal(lines.explode_lines(_t(spark, d, "documents"), "doc_id", "text"), "doc_id")


@query(r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
SELECT doc_id, list_reduce(list_transform(list_filter(list_zip(l, range(1, len(l) + 1)), lambda p: regexp_matches(p[1], '\S') OR p[2] = 1 OR regexp_matches(l[p[2] - 1], '\S')),
  lambda p: CASE WHEN regexp_matches(p[1], '\S') THEN p[1] ELSE '' END), lambda a, b: concat(a, chr(10), b)) AS output FROM l""")
def blank_runs(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.array_join(text.collapse_blanks(text.lines(F.col("text"))), "\n").alias("output"))


@query()
def repeated_lines(spark, d):
    log = _log(spark, d).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("l"))
    return log.select("doc_id", F.array_join(lines.collapse_repeats(F.col("l")), "\n").alias("output"))


STAINED = f"""SELECT doc_id, line_no, concat(chr(27), '[3', CAST(line_no % 8 AS VARCHAR(1)), 'm', line, chr(27), '[0m  ', CASE line_no % 3 WHEN 0 THEN ' 0xDEADBEEF1 ' WHEN 1 THEN ' abcdefabc ' ELSE '  17 of 250' END) AS line FROM ({LOG})"""


@query(rf"""SELECT doc_id, line_no, trim(regexp_replace(concat(regexp_replace(line, '\d+', 'N', 'g'), '  ', CASE line_no % 3 WHEN 0 THEN 'NxH' WHEN 1 THEN 'abcdefabc' ELSE 'N of N' END), '\s+', ' ', 'g')) AS norm FROM ({LOG})""")
def normalized_lines(spark, d):
    """Log lines with escapes, hex runs and numbers, normalised."""
    return _sql(spark, d, STAINED, "events").select("doc_id", "line_no", text.normalize_line(text.strip_ansi(F.col("line"))).alias("norm"))


@query("SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS n_tokens, concat('sha256:', sha256(text)) AS content_hash FROM documents")
def tokens_and_hash(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("n_tokens"), text.content_hash(F.col("text")).alias("content_hash"))


@query("SELECT sha256(text) AS h, min(doc_id) AS doc_id, count(*) AS n_copies FROM documents GROUP BY sha256(text)")
def content_dedupe(spark, d):
    return savings.first_of_copies(_t(spark, d, "documents"), "doc_id", "text")


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), n AS (SELECT *, len(l) AS n FROM l)
SELECT doc_id, CASE WHEN n <= 6 THEN array_to_string(l, chr(10)) ELSE concat(l[1], chr(10), l[2], chr(10), '... (', n - 5, ' lines omitted) ...', chr(10), l[n - 2], chr(10), l[n - 1], chr(10), l[n]) END AS output FROM n""")
def truncate_bash(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.array_join(truncate.truncate(text.lines(F.col("text")), F.lit(6), "bash"), "\n").alias("output"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), n AS (SELECT *, len(l) AS n FROM l)
SELECT doc_id, CASE WHEN n <= 6 THEN array_to_string(l, chr(10)) ELSE concat(l[1], chr(10), l[2], chr(10), l[3], chr(10), '... (', n - 5, ' lines omitted) ...', chr(10), l[n - 1], chr(10), l[n]) END AS output FROM n""")
def truncate_web(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.array_join(truncate.truncate(text.lines(F.col("text")), F.lit(6), "web"), "\n").alias("output"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
t AS (SELECT doc_id, len(l) AS n, list_transform(l, lambda x: ceil((length(x) + 1) / 4.0)::INT) AS t FROM l),
c AS (SELECT doc_id, n, t, unnest(range(1, n + 1))::INT AS b FROM t),
h AS (SELECT *, CASE WHEN b = 1 THEN 0 ELSE greatest(1, floor((b - 1) * 0.6)) END::INT AS head FROM c),
k AS (SELECT doc_id, n, b, CASE WHEN b >= n THEN list_sum(t) ELSE coalesce(list_sum(t[1:head]), 0) + coalesce(list_sum(t[n - (b - 1 - head) + 1:n]), 0)
  + ceil((length(concat('... (', n - b + 1, ' lines omitted) ...')) + 1) / 4.0) END <= 200 AS fits, greatest(1, floor(sqrt(n)))::INT AS step FROM h),
g AS (SELECT doc_id, n, step, coalesce(max(b) FILTER (fits AND (n - b) % step = 0), 1) AS first FROM k GROUP BY ALL)
SELECT g.doc_id, g.n::INT AS n_lines, CASE WHEN bool_or(k.fits AND k.b = g.n) THEN g.n ELSE coalesce(max(k.b) FILTER (k.fits AND k.b > g.first AND k.b <= least(g.n, g.first + g.step - 1)), g.first) END::INT AS budget
FROM g JOIN k USING (doc_id) GROUP BY g.doc_id, g.n, g.first, g.step""")
def token_budget(spark, d):
    ls = text.lines(F.col("text"))
    return _t(spark, d, "documents").withColumn("l", ls).select("doc_id", F.size("l").alias("n_lines"), truncate.budget_for_tokens(F.col("l"), 200, "grep").alias("budget"))


# --- grep ---------------------------------------------------------------------------------------------


@query(GREP_SQL)
def grep_hits(spark, d):
    return _grep(spark, d)


@query(f"""WITH h AS ({GREP_SQL}), p AS (SELECT doc_id, file, count(*) AS n_hits FROM h GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n_hits DESC, file) AS rank FROM p)
SELECT doc_id, file, n_hits, rank, rank <= 20 AS shown, CAST(sum((rank > 20)::INT) OVER w AS BIGINT) AS hidden_files,
  CAST(sum(CASE WHEN rank > 20 THEN n_hits ELSE 0 END) OVER w AS BIGINT) AS hidden_hits FROM r WINDOW w AS (PARTITION BY doc_id)""")
def grep_files(spark, d):
    return grep.group_by_file(_grep(spark, d))


@query(f"""WITH h AS ({GREP_SQL}), b AS (SELECT *, coalesce(line - lag(line) OVER w > 3, true)::INT AS new FROM h WINDOW w AS (PARTITION BY doc_id, file ORDER BY line, coalesce(col, 0))),
c AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, file ORDER BY line, coalesce(col, 0)) AS block FROM b)
SELECT doc_id, file, CAST(block AS BIGINT) AS block, min(line) AS first_line, max(line) AS last_line, count(*) AS n_hits FROM c GROUP BY doc_id, file, block""")
def grep_blocks(spark, d):
    return grep.blocks(_grep(spark, d))


@query(f"""WITH h AS ({GREP_SQL}), e AS (SELECT doc_id, min(file) AS a, max(file) AS b FROM h GROUP BY doc_id)
SELECT doc_id, CASE WHEN a = b THEN '' WHEN split_part(a, '/', 2) = split_part(b, '/', 2) THEN concat(split_part(a, '/', 1), '/', split_part(a, '/', 2), '/') ELSE 'src/' END AS prefix FROM e""")
def grep_prefix(spark, d):
    return grep.common_prefix(_grep(spark, d))


# --- search -------------------------------------------------------------------------------------------

AGG = f"""h AS ({HITS}), k AS (SELECT *, {NORM} AS key, CASE WHEN position > 0 THEN CASE lower(engine) WHEN 'facts' THEN 1.5::DOUBLE WHEN 'bing' THEN 1.1 WHEN 'sogou' THEN 0.9 ELSE 1.0 END / position ELSE 0 END AS part FROM h),
g AS (SELECT query, key, arg_min(title, (-length(title), engine_ord, position)) AS title, arg_min(url, (engine_ord, position)) AS url,
  arg_min(snippet, (-length(snippet), engine_ord, position)) AS snippet, list(DISTINCT engine) AS e, sum(part) AS s, min((engine_ord, position)) AS f FROM k GROUP BY query, key),
c AS (SELECT *, floor(s * CASE WHEN len(e) > 1 THEN 1.5 ELSE 1 END * 1000 + 0.5) / 1000 AS score FROM g),
a AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, f) AS rank FROM c)"""


@query(f"WITH {AGG} SELECT query, rank, title, url, snippet, len(e)::INT AS n_sources, score FROM a WHERE rank <= 10")
def search_aggregate(spark, d):
    """The ten best results of each query (a top-k report)."""
    return search.aggregate(_hits(spark, d)).withColumn("n_sources", F.size("sources")).drop("sources")


@query(f"WITH {AGG} SELECT query, count(*) AS n_results, (SELECT count(DISTINCT engine) FROM h WHERE h.query = a.query)::INT AS n_engines FROM a GROUP BY query")
def search_engines(spark, d):
    return search.engines_of(search.aggregate(_hits(spark, d), None))


@query(f"""WITH {AGG}, l AS (SELECT query, {NORM} AS key, arg_max(title, position) AS title, min(position) AS o FROM h WHERE engine = 'sogou' GROUP BY ALL),
r AS (SELECT query, key, title, rank FROM a)
SELECT query, coalesce(l.title, r.title) AS title, l.o IS NOT NULL AS ours, row_number() OVER (PARTITION BY query ORDER BY l.o IS NULL, l.o, r.rank) AS rank FROM l FULL JOIN r USING (query, key)""")
def search_merge(spark, d):
    hits = _hits(spark, d)
    left = hits.filter("engine = 'sogou'").select("query", F.col("position").alias("ord"), "title", "url", "snippet")
    out = search.merge(left, search.aggregate(hits, None))
    return out.select("query", "title", (F.get("sources", F.lit(0)) == "llm").alias("ours"), "rank")


@query(f"""WITH {AGG}, t AS (SELECT * FROM a WHERE rank <= 10),
e AS (SELECT query, engine, engine_ord, min(position) AS p, key FROM k GROUP BY ALL),
b AS (SELECT query, key, string_agg(engine, ', ' ORDER BY engine_ord, p) AS srcs FROM e GROUP BY ALL),
n AS (SELECT query, count(DISTINCT engine) AS n FROM e JOIN t USING (query, key) GROUP BY query)
SELECT query, concat('Search: "', query, '" — ', count(*), ' results from ', any_value(n.n), CASE WHEN any_value(n.n) = 1 THEN ' engine' ELSE ' engines' END, chr(10),
  string_agg(concat(rank, '. **', title, '** (', regexp_replace(lower(regexp_extract(url, '://([^/]+)', 1)), '^www\\.', ''), ')', chr(10), '   ', snippet, chr(10), '   Sources: ', srcs), chr(10) ORDER BY rank)) AS output
FROM t JOIN b USING (query, key) JOIN n USING (query) GROUP BY query""")
def search_render(spark, d):
    return search.render(search.aggregate(_hits(spark, d)))


@query(f"SELECT position, {NORM} AS norm, regexp_replace(lower(regexp_extract(url, '://([^/]+)', 1)), '^www\\.', '') AS domain FROM ({HITS})")
def urls(spark, d):
    return _hits(spark, d).select("position", url.normalize_url(F.col("url")).alias("norm"), url.extract_domain(F.col("url")).alias("domain"))


# --- files, listings, diffs, reports --------------------------------------------------------------------

NAMES = """SELECT p_partkey, concat('dir', CAST(p_size % 4 AS VARCHAR(9)), '/', CASE p_size % 6 WHEN 0 THEN 'Makefile' WHEN 1 THEN 'a.PY' WHEN 2 THEN 'b.test.ts' WHEN 3 THEN '.gitignore' WHEN 4 THEN 'noext' ELSE 'c.rs' END) AS name FROM part"""


@query(f"""SELECT p_partkey, CASE WHEN name LIKE '%Makefile' THEN 'shell' WHEN name LIKE '%.PY' THEN 'python' WHEN name LIKE '%.ts' THEN 'typescript' WHEN name LIKE '%.rs' THEN 'rust' ELSE 'unknown' END AS language FROM ({NAMES})""")
def languages(spark, d):
    return _sql(spark, d, NAMES, "part").select("p_partkey", language.detect_language(F.col("name")).alias("language"))


@query(f"""WITH n AS (SELECT p_partkey % 10 AS doc_id, name FROM ({NAMES})), f AS (SELECT DISTINCT doc_id, name FROM n)
SELECT doc_id, CASE WHEN name LIKE '%.PY' THEN 'py' WHEN name LIKE '%.ts' THEN 'ts' WHEN name LIKE '%.rs' THEN 'rs' ELSE '(none)' END AS ext, count(*) AS n_files FROM f GROUP BY ALL""")
def listing_types(spark, d):
    ls = _sql(spark, d, f"SELECT p_partkey % 10 AS doc_id, p_partkey AS line_no, name AS line FROM ({NAMES})", "part")
    return listing.type_counts(listing.nodes(listing.entries(ls)))


DIFF = """SELECT c_nationkey AS doc_id, c_custkey * 10 + k AS line_no, CASE k WHEN 0 THEN concat('diff --git a/f', CAST(c_custkey AS VARCHAR(9)), '.txt b/f', CAST(c_custkey AS VARCHAR(9)), '.txt')
  WHEN 1 THEN CASE WHEN c_custkey % 3 = 0 THEN 'new file mode 100644' ELSE 'index 1..2' END WHEN 2 THEN '--- a/x' WHEN 3 THEN '+++ b/x' WHEN 4 THEN '@@ -1,2 +1,3 @@'
  WHEN 5 THEN '+one' WHEN 6 THEN '-two' WHEN 7 THEN CASE WHEN c_custkey % 2 = 0 THEN '+more' ELSE ' same' END ELSE '@@ -9 +9 @@' END AS line FROM customer CROSS JOIN (SELECT CAST(id AS INT) AS k FROM range(9)) AS s"""


@query("""SELECT c_nationkey AS doc_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS file_no, CASE WHEN c_custkey % 3 = 0 THEN 'A' ELSE 'M' END AS op,
concat('f', c_custkey, '.txt') AS old_path, concat('f', c_custkey, '.txt') AS new_path, NULL::INT AS similarity, (1 + (c_custkey % 2 = 0)::INT)::BIGINT AS additions, 1::BIGINT AS deletions, false AS binary FROM customer""")
def diff_files(spark, d):
    return diff.files(_sql(spark, d, DIFF, "customer"))


@query("SELECT c_nationkey AS doc_id, count(*) AS n_files, sum(1 + (c_custkey % 2 = 0)::INT)::BIGINT AS additions, count(*) AS deletions FROM customer GROUP BY c_nationkey")
def diff_stats(spark, d):
    return diff.stats(_sql(spark, d, DIFF, "customer"))


REPORT = """SELECT s_nationkey AS doc_id, s_suppkey AS line_no, concat('== ', CAST(s_suppkey % 9 AS VARCHAR(9)), ' passed, ', CAST(s_suppkey % 4 AS VARCHAR(9)), ' failed, 1 error, 2 skipped in 0.4s') AS line FROM supplier"""


@query("""SELECT s_nationkey AS doc_id, (p + f + 1 + 2)::INT AS total, p::INT AS passed, (f + 1)::INT AS failed, 2::INT AS skipped
FROM (SELECT s_nationkey, arg_max(s_suppkey % 9, s_suppkey) AS p, arg_max(s_suppkey % 4, s_suppkey) AS f FROM supplier GROUP BY s_nationkey)""")
def test_summaries(spark, d):
    return testreport.summaries(_sql(spark, d, REPORT, "supplier"))


@query("""SELECT c_nationkey AS doc_id, concat(count(*), ' files changed, +', sum(1 + (c_custkey % 2 = 0)::INT)::BIGINT, ' -', count(*), chr(10),
  string_agg(concat(CASE WHEN c_custkey % 3 = 0 THEN 'A' ELSE 'M' END, ' f', c_custkey, '.txt (+', 1 + (c_custkey % 2 = 0)::INT, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ' -1' END, ')'), chr(10) ORDER BY c_custkey)) AS output
FROM customer GROUP BY c_nationkey""")
def diff_summaries(spark, d):
    return diff.render(_sql(spark, d, DIFF, "customer"), level="summary").select("doc_id", F.array_join("lines", "\n").alias("output"))


#: The compact lines of each file of DIFF: those that come first, and the others.
CORE_SQL = """SELECT c_nationkey AS doc_id, c_custkey AS f, unnest(list_concat([concat(CASE WHEN c_custkey % 3 = 0 THEN 'A' ELSE 'M' END, ' f', c_custkey, '.txt (+', 1 + (c_custkey % 2 = 0)::INT, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ' -1' END, ')'),
  '@@ -1,2 +1,3 @@', '+one', '-two'], CASE WHEN c_custkey % 2 = 0 THEN ['+more'] ELSE [] END)) AS line, generate_subscripts(list_concat([1, 2, 3, 4], CASE WHEN c_custkey % 2 = 0 THEN [5] ELSE [] END), 1) AS pos FROM customer"""
REST_SQL = "SELECT c_nationkey AS doc_id, c_custkey AS f, unnest(['@@ -9 +9 @@', '  ... context omitted ...']) AS line, unnest([8, 9]) AS pos FROM customer"
GAP_SQL = "SELECT c_nationkey AS doc_id, c_custkey AS f, '' AS line, 10 AS pos FROM customer QUALIFY c_custkey < max(c_custkey) OVER (PARTITION BY c_nationkey)"


@query(f"SELECT doc_id, string_agg(line, chr(10) ORDER BY f, pos) AS output FROM ({CORE_SQL} UNION ALL {REST_SQL} UNION ALL {GAP_SQL}) GROUP BY doc_id")
def diff_render(spark, d):
    return diff.render(_sql(spark, d, DIFF, "customer")).select("doc_id", F.array_join("lines", "\n").alias("output"))


FAILED = """SELECT s_nationkey AS doc_id, concat_ws(chr(10), '=== short test summary info ===', array_join(transform(array_sort(collect_list(s_suppkey)),
  k -> concat('FAILED t.py::t', lpad(CAST(k AS STRING), 9, '0'), ' - boom ', CAST(k % 3 AS STRING))), chr(10)), concat('=== ', count(*), ' failed, 4 passed in 0.5s ===')) AS text
  FROM supplier GROUP BY s_nationkey"""


@query("""WITH n AS (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey)
SELECT s_nationkey AS doc_id, 'pytest' AS runner, 'fail' AS status, (n + 4)::INT AS total, 4::INT AS passed, n::INT AS failed, '0.5s' AS duration,
  concat('t.py::t', lpad(s_suppkey::VARCHAR, 9, '0')) AS test_name, concat('boom ', s_suppkey % 3) AS error FROM supplier JOIN n USING (s_nationkey)""")
def test_failures(spark, d):
    r = _sql(spark, d, FAILED, "supplier").select("doc_id", testfailures.parse_report(F.col("text")).alias("r"))
    told = ("runner", "status", "total", "passed", "failed", "duration")
    return r.select("doc_id", *[f"r.{c}" for c in told], F.explode("r.failures").alias("f")).select("doc_id", *told, "f.test_name", "f.error")


@query("""WITH b AS (SELECT s_nationkey AS doc_id, count(*) AS n, concat('✗ ', count(*), '/', count(*) + 4, ' tests failed (4 passed, 0.5s)', chr(10), chr(10),
    string_agg(concat('FAIL t.py::t', lpad(s_suppkey::VARCHAR, 9, '0'), chr(10), '  boom ', s_suppkey % 3), concat(chr(10), chr(10)) ORDER BY s_suppkey)) AS body,
  sum(length(concat('FAILED t.py::t', lpad(s_suppkey::VARCHAR, 9, '0'), ' - boom ', s_suppkey % 3)) + 1) + 32 + length(concat('=== ', count(*), ' failed, 4 passed in 0.5s ===')) AS chars FROM supplier GROUP BY s_nationkey)
SELECT doc_id, concat(body, chr(10), '--- condensed: ', n + 2, ' lines → ', 1 + 3 * n, ' lines (', greatest(0, floor((1 - length(body) / chars) * 100 + 0.5))::INT, '% saved) ---') AS output, (n + 2)::INT AS original_size, (1 + 3 * n)::INT AS compressed_size,
  (1 + 3 * n) / (n + 2)::DOUBLE AS ratio, 'test' AS format, false AS budget_exceeded FROM b""")
def condense_report(spark, d):
    return _sql(spark, d, FAILED, "supplier").select("doc_id", plans.report(F.col("text"), 400).alias("r")).select("doc_id", "r.*")


#: The names of each listing, with their folder and kind.
FILES_SQL = f"""SELECT DISTINCT p_partkey % 10 AS doc_id, split_part(name, '/', 1) AS dir, split_part(name, '/', 2) AS file,
  CASE WHEN name LIKE '%.PY' THEN '.py' WHEN name LIKE '%.ts' THEN '.ts' WHEN name LIKE '%.rs' THEN '.rs' ELSE '[no-ext]' END AS ext FROM ({NAMES})"""
COUNTED_SQL = "SELECT doc_id, concat('project/ (', count(*), ' files, ', count(DISTINCT dir), ' dirs)') AS head FROM f GROUP BY doc_id"


@query(f"""WITH f AS ({FILES_SQL}), h AS ({COUNTED_SQL}),
r AS (SELECT *, dir = max(dir) OVER (PARTITION BY doc_id) AS last, row_number() OVER (PARTITION BY doc_id, dir ORDER BY lower(file)) = count(*) OVER (PARTITION BY doc_id, dir) AS final FROM f),
l AS (SELECT doc_id, dir, 1 AS pos, lower(file) AS o, concat(CASE WHEN last THEN '    ' ELSE '│   ' END, CASE WHEN final THEN '└── ' ELSE '├── ' END, file) AS line FROM r
  UNION ALL SELECT DISTINCT doc_id, dir, 0, '', concat(CASE WHEN last THEN '└── ' ELSE '├── ' END, dir, '/') FROM r),
t AS (SELECT doc_id, string_agg(concat(ext, '(', n, ')'), ', ' ORDER BY n DESC, ext <> '[no-ext]', ext) AS types FROM (SELECT doc_id, ext, count(*) AS n FROM f GROUP BY ALL) GROUP BY doc_id)
SELECT doc_id, concat(head, chr(10), (SELECT string_agg(line, chr(10) ORDER BY dir, pos, o) FROM l WHERE l.doc_id = h.doc_id), chr(10), chr(10), 'Types: ', types) AS output FROM h JOIN t USING (doc_id)""")
def listing_draw(spark, d):
    ls = _sql(spark, d, f"SELECT p_partkey % 10 AS doc_id, p_partkey AS line_no, name AS line FROM ({NAMES})", "part")
    return listing.render(listing.entries(ls), roots=listing.root_names(ls)).select("doc_id", F.array_join("lines", "\n").alias("output"))


@query()
def grep_render(spark, d):
    return grep.render(_grep(spark, d)).select("doc_id", F.array_join("lines", "\n").alias("output"))


AGENT = """SELECT l_suppkey AS doc_id, ((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 2 + k AS line_no, CASE WHEN k = 0 THEN concat('src/f', CAST(l_partkey % 30 AS VARCHAR(9)), '.py')
  ELSE concat('  Line ', CAST(l_orderkey % 400 AS VARCHAR(9)), ': qty ', l_returnflag) END AS line FROM lineitem CROSS JOIN (SELECT CAST(id AS INT) AS k FROM range(2)) AS s"""


@query("""SELECT l_suppkey AS doc_id, ((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 2 + 1 AS line_no, concat('src/f', l_partkey % 30, '.py') AS file, (l_orderkey % 400)::INT AS line,
  NULL::INT AS col, concat('qty ', l_returnflag) AS text FROM lineitem WHERE l_orderkey % 400 > 0""")
def grep_agent_hits(spark, d):
    return grep.agent_hits(_sql(spark, d, AGENT, "lineitem"))


SOURCE = """SELECT c_nationkey AS doc_id, 'a.py' AS name, array_join(transform(array_sort(collect_list(c_custkey)), k -> concat('def f', CAST(k AS STRING), '():', chr(10),
  '    a', chr(10), '    b', chr(10), IF(k % 2 = 1, concat('    c', chr(10)), ''), '# note', chr(10), 'import x')), chr(10)) AS text FROM customer GROUP BY c_nationkey"""


@query("""SELECT c_nationkey AS doc_id, string_agg(concat('def f', c_custkey, '():', chr(10), CASE WHEN c_custkey % 2 = 1 THEN '    ... (3 lines collapsed)' ELSE concat('    a', chr(10), '    b') END,
  chr(10), '# note', chr(10), 'import x'), chr(10) ORDER BY c_custkey) AS output FROM customer GROUP BY c_nationkey""")
def source_fold(spark, d):
    folded = source.fold_source(text.lines(F.col("text")), language.detect_language(F.col("name")), bodies=True)
    return _sql(spark, d, SOURCE, "customer").select("doc_id", F.array_join(folded, "\n").alias("output"))


@query("""SELECT c_nationkey AS doc_id, (sum(5 + c_custkey % 2) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 5 - c_custkey % 2)::INT AS line_no, 'function' AS kind,
  concat('def f', c_custkey, '():') AS signature FROM customer""")
def source_signatures(spark, d):
    return source.signatures(_sql(spark, d, SOURCE, "customer"), "doc_id", "name", "text")


@query("""SELECT c_nationkey AS doc_id, (sum(5 + c_custkey % 2) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 5 - c_custkey % 2)::INT AS line_no, 0::INT AS depth, 'function' AS kind,
  concat('f', c_custkey) AS name, concat('def f', c_custkey, '():') AS signature FROM customer""")
def syntax_signatures(spark, d):
    return syntax.signatures(_sql(spark, d, SOURCE, "customer"), "doc_id", "text")


@query("SELECT c_nationkey AS doc_id, count(*) AS n_imports, count(*) AS n_comments FROM customer GROUP BY c_nationkey")
def source_flags(spark, d):
    ls = lines.explode_lines(_sql(spark, d, SOURCE, "customer"), "doc_id", "text")
    c, lang = F.col("line"), F.lit("python")
    return ls.groupBy("doc_id").agg(F.count_if(language.is_import(c, lang)).alias("n_imports"), F.count_if(language.is_line_comment(c, lang)).alias("n_comments"))


@query(r"""WITH b AS (SELECT user_id, event_id, regexp_replace(props, '\\.|"(?:\\.|[^"\\])*(?:"|$)|//.*', '', 'g') AS t FROM events)
SELECT user_id AS doc_id, event_id AS line_no, sum(length(replace(t, '}', '')) - length(replace(t, '{', ''))) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS depth FROM b""")
def brace_depth(spark, d):
    return source.brace_depth(_t(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("line_no"), F.col("props").alias("line")), "doc_id")


# --- result pages ---------------------------------------------------------------------------------------


@query("""SELECT CAST(o_custkey AS VARCHAR) AS query, 'bing' AS engine, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS position, concat('T ', o_orderkey) AS title,
  concat('https://x.org/', o_orderkey) AS url, concat('about ', o_orderpriority) AS snippet FROM orders QUALIFY position <= 10""")
def result_pages(spark, d):
    """The ten first results of each page (as the engine's page parser has it)."""
    item = F.concat(
        F.lit('<li class="b_algo"><h2><a href="https://x.org/'), F.col("o_orderkey").cast("string"), F.lit('">T '), F.col("o_orderkey").cast("string"),
        F.lit("</a></h2><p>about "), "o_orderpriority", F.lit("</p></li>"),
    )
    items = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", item.alias("i")))), lambda x: x["i"])
    pages = _t(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("query")).agg(items.alias("i"))
    body = F.concat(F.lit('<ol id="b_results">'), F.array_join("i", ""), F.lit("</ol>"))
    return htmltree.results(pages.select("query", F.lit("bing").alias("engine"), body.alias("body")))


# --- routing, state, reports ----------------------------------------------------------------------------


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'grep' WHEN 1 THEN 'diff' WHEN 2 THEN 'ls' ELSE 'bash' END AS by_command, CASE event_id % 3 WHEN 0 THEN 'read' WHEN 1 THEN 'ls' END AS by_tool FROM events""")
def tool_routing(spark, d):
    e = _t(spark, d, "events").select("event_id", (F.col("event_id") % 4).alias("a"), (F.col("event_id") % 3).alias("b"))
    cmd = F.when(F.col("a") == 0, "/usr/bin/rg -n x").when(F.col("a") == 1, "git log -p f").when(F.col("a") == 2, "ls -la").otherwise("make all")
    tool = F.when(F.col("b") == 0, "Skill").when(F.col("b") == 1, "glob").otherwise("edit")
    return e.select("event_id", routing.for_command(cmd).alias("by_command"), routing.for_tool(tool).alias("by_tool"))


STATE = """SELECT user_id AS session, event_id AS seq, CASE event_id % 11 WHEN 0 THEN 'off' WHEN 5 THEN 'on' ELSE 'call' END AS kind, CAST(event_id % 3 AS INT) AS n FROM events"""


@query(f"""WITH e AS ({STATE}), c AS (SELECT *, sum((kind <> 'call')::INT) OVER (PARTITION BY session ORDER BY seq) AS span FROM e),
x AS (SELECT *, count_if(kind = 'call') OVER (PARTITION BY session, span ORDER BY seq) AS nth, first_value(kind) OVER (PARTITION BY session, span ORDER BY seq) AS k, first_value(n) OVER (PARTITION BY session, span ORDER BY seq) AS m FROM c)
SELECT session, seq, kind, n, kind = 'call' AND k = 'off' AND span > 0 AND (m <= 0 OR nth <= m) AS raw FROM x""")
def countdown_state(spark, d):
    return routing.countdown(_sql(spark, d, STATE, "events"), "session", "seq")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n_events FROM events GROUP BY ALL HAVING count(*) > 2")
def rate_windows(spark, d):
    from .streaming import over_limit

    return over_limit(_t(spark, d, "events").select("ts", "event_type"), "ts", "event_type", 2, "1 hour")


BLANKS_SQL = r"""SELECT source, lang, length(text) AS b, length(list_reduce(list_transform(list_filter(list_zip(l, range(1, len(l) + 1)), lambda p: regexp_matches(p[1], '\S') OR p[2] = 1 OR regexp_matches(l[p[2] - 1], '\S')),
  lambda p: CASE WHEN regexp_matches(p[1], '\S') THEN p[1] ELSE '' END), lambda a, b: concat(a, chr(10), b))) AS a FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents)"""


@query(f"""SELECT source, lang, count(*) AS n_docs, sum(b)::BIGINT AS chars_before, sum(a)::BIGINT AS chars_after,
  CASE WHEN sum(b) = 0 THEN 0 ELSE greatest(0, floor((1 - sum(a) / sum(b)) * 100 + 0.5)) END::INT AS saved_percent FROM ({BLANKS_SQL}) GROUP BY ROLLUP (source, lang)""")
def savings_rollup(spark, d):
    """What collapsing blank lines saves by source and language."""
    after = F.array_join(text.collapse_blanks(text.lines(F.col("text"))), "\n")
    return savings.rollup(_t(spark, d, "documents"), F.col("text"), after, "source", "lang")


# --- payloads, pages, whole condensers (no SQL form) --------------------------------------------------------


PAYLOAD = """SELECT event_id, concat('{"k": ', substr(props, 7, length(props) - 7), ', "t": "', event_type, '", "v": ', CAST(event_id % 1000 AS VARCHAR(9)), '.0, "_links": {"a": 1}, "e": null, "z": [], "l": [1, null, 2, 3, 4, 5, 6], "d": {"d": {"d": {"d": {"d": 1}}}}}') AS props FROM events"""
PRUNED = """concat('{"k":', json_extract(e.props, '$.k')::INT, ',"t":"', event_type, '","v":', event_id % 1000, ',"l":[1,2,3,4,"... (2 more items)"],"d":{"d":{"d":{"d":"{...}"}}}}')"""


@query(f"""SELECT event_id, {PRUNED} AS output, true AS valid, true AS nested, 1::INT AS fields_removed, 1::INT AS arrays_truncated, 1::INT AS depth_limited, 3::INT AS nulls_removed FROM events e""")
def json_prune(spark, d):
    """Payloads with metadata, nulls, a long array and a deep nest."""
    return _sql(spark, d, PAYLOAD, "events").select("event_id", jsonprune.prune_json(F.col("props"), depth=4).alias("r")).select("event_id", "r.*")


@query()
def page_text(spark, d):
    p = _t(spark, d, "pages").select("page_id", webtext.page_text(F.col("html"), True).alias("p"))
    return p.select("page_id", "p.*", webtext.density(F.col("p")).alias("density"))


@query()
def condense_bash(spark, d):
    return _t(spark, d, "documents").select("doc_id", bash(F.col("text"), 40).alias("r")).select("doc_id", "r.*")


@query()
def condense_read(spark, d):
    return _t(spark, d, "documents").select("doc_id", read(F.col("text"), 40).alias("r")).select("doc_id", "r.*")


@query()
def condense_web(spark, d):
    return _t(spark, d, "pages").select("page_id", web(F.col("html"), 60).alias("r")).select("page_id", "r.*")


@query(f"""SELECT event_id, concat({PRUNED}, chr(10), '--- condensed: 1 lines → 1 lines (0% saved) ---') AS output, 1::INT AS original_size, 1::INT AS compressed_size, 1::DOUBLE AS ratio, 'api' AS format,
  length({PRUNED}) >= 16 AS budget_exceeded, 1::INT AS fields_removed, 1::INT AS arrays_truncated, 1::INT AS depth_limited, 3::INT AS nulls_removed, NULL::VARCHAR AS error FROM events e""")
def condense_api(spark, d):
    """Payloads with limits: one line can't be cut, so a limit of tokens is exceeded."""
    return _sql(spark, d, PAYLOAD, "events").select("event_id", api(F.col("props"), max_lines=20, max_tokens=29, depth=4).alias("r")).select("event_id", "r.*")


@query(f"""WITH {AGG}, t AS (SELECT * FROM a WHERE rank <= 10),
n AS (SELECT query, count(*) AS n FROM t GROUP BY query),
b AS (SELECT query, string_agg(concat(rank, '. **', title, '** (', regexp_replace(lower(regexp_extract(url, '://([^/]+)', 1)), '^www\\.', ''), ')', chr(10), '   ', snippet, chr(10), '   Sources: x'), chr(10) ORDER BY rank) FILTER (rank <= 3) AS b FROM t GROUP BY query)
SELECT query, concat('Search: "', query, '" — ', least(n, 3), ' results from 1 engine', chr(10), chr(10), b, chr(10), '--- condensed: 1 lines → ', 2 + 3 * least(n, 3), ' lines (0% saved) ---') AS output, (2 + 3 * least(n, 3))::INT AS compressed_size FROM n JOIN b USING (query)""")
def condense_search(spark, d):
    """The engines' results of each query as JSON, condensed to three results (a limit of the condenser)."""
    one = F.struct("rank", "title", "url", "snippet", F.array(F.lit("x")).alias("sources"), "score")
    per = search.aggregate(_hits(spark, d)).groupBy("query").agg(F.to_json(F.array_sort(F.collect_list(one))).alias("body"))
    r = per.select("query", plans.search(F.col("body"), F.col("query"), 3).alias("r"))
    return r.select("query", "r.output", "r.compressed_size")


EVENTS = """SELECT CAST(user_id AS VARCHAR(9)) AS session, CAST(event_id AS INT) AS seq,
  CASE event_id % 9 WHEN 0 THEN 'condense_off' WHEN 1 THEN 'edit' WHEN 2 THEN 'bash' WHEN 3 THEN 'websearch_x' ELSE 'read' END AS tool,
  map('calls', CAST(event_id % 3 + 1 AS VARCHAR(9)), 'command', 'git show', 'query', CASE WHEN event_id % 2 = 0 THEN 'q' ELSE '' END) AS args,
  CASE event_id % 9 WHEN 2 THEN 'no diff' WHEN 3 THEN '{"results": [{"title": "T", "url": "https://t.org/", "text": "told"}, {"title": "no url"}]}'
    ELSE repeat(concat('v', chr(10), chr(10), chr(10)), CAST(100 + event_id % 300 AS INT)) END AS output FROM events"""


@query("""WITH e AS (SELECT user_id, event_id, event_id % 9 AS k, 100 + event_id % 300 AS n FROM events),
s AS (SELECT *, sum((k = 0)::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS span FROM e),
x AS (SELECT *, count_if(k <> 0) OVER (PARTITION BY user_id, span ORDER BY event_id) AS nth, first_value(event_id % 3 + 1) OVER (PARTITION BY user_id, span ORDER BY event_id) AS calls FROM s),
r AS (SELECT *, k <> 0 AND span > 0 AND nth <= calls AS raw, repeat(concat('v', chr(10), chr(10), chr(10)), n::INT) AS text, 4 * n AS before, 3 * n - 1 AS body FROM x),
c AS (SELECT *, concat(repeat(concat('v', chr(10), chr(10)), (n - 1)::INT), 'v', chr(10), chr(10), '--- condensed: ', 3 * n + 1, ' lines → ', 2 * n, ' lines (', floor((1 - body / before) * 100 + 0.5)::INT, '% saved) ---') AS short FROM r),
o AS (SELECT *, k >= 4 AND NOT raw AND before - length(short) >= 200 AS pays, k = 3 AND NOT raw AND event_id % 2 = 0 AS merged FROM c)
SELECT user_id::VARCHAR AS session, event_id::INT AS seq, CASE k WHEN 0 THEN 'condense_off' WHEN 1 THEN 'edit' WHEN 2 THEN 'bash' WHEN 3 THEN 'websearch_x' ELSE 'read' END AS tool,
  CASE WHEN raw THEN NULL WHEN k = 2 THEN 'diff' WHEN k >= 4 THEN 'read' END AS route,
  CASE WHEN pays THEN concat(short, chr(10), '[condensed: ', floor((before - length(short)) / before * 100 + 0.5)::INT, '% smaller | condense_off() for raw]')
    WHEN merged THEN concat_ws(chr(10), '# Search Results (2 total)', '', '## 1. T', 'URL: https://t.org/', 'Sources: exa, bing', '', 'told at more length', '', '## 2. (No title)', 'URL: https://u.org/', 'Sources: bing', '', '---', '[condensed search merge]',
      '- exa results: 1', '- Engines: bing', '- Failed engines: sogou', '- Merge time: 7ms', '[condensed search merge | condense_off() for raw]')
    WHEN k = 2 THEN 'no diff' WHEN k = 3 THEN '{"results": [{"title": "T", "url": "https://t.org/", "text": "told"}, {"title": "no url"}]}' ELSE text END AS output, pays OR merged AS changed FROM o""")
def hook_outputs(spark, d):
    """What agents read of all events: raw while switched off, condensed where it pays, search replies merged."""
    found = spark.createDataFrame(
        [("q", [("", "https://www.t.org", "told at more length", ["bing"], 1.0), ("", "https://u.org/", "", ["bing"], 0.5)], ["bing"], ["sogou"], 7)],
        f"query string, results {search.RESULTS}, engines array<string>, failed array<string>, millis int",
    )
    return hooks.outputs(_sql(spark, d, EVENTS, "events"), found)


@query()
def page_snapshot(spark, d):
    return _t(spark, d, "pages").select("page_id", htmltree.snapshot(F.col("html")).alias("output"))


@query()
def page_densest(spark, d):
    return _t(spark, d, "pages").select("page_id", htmltree.densest(F.col("html")).alias("p")).select("page_id", "p.*")


def _whole(ls):
    per = ls.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("l"))
    return per.select("doc_id", F.array_join("l", "\n").alias("text"))


@query()
def condense_grep(spark, d):
    docs = _whole(_sql(spark, d, AGENT, "lineitem")).withColumn("text", F.concat(F.lit("Found 9 matches\n"), "text"))
    return plans.grep(docs, "doc_id", "text", 60)


@query(f"""WITH c AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY f, pos) AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM ({CORE_SQL} UNION ALL {GAP_SQL})),
x AS (SELECT *, 29 AS m FROM c), k AS (SELECT doc_id, string_agg(CASE WHEN i = 22 THEN concat('... (', n - 28, ' lines omitted) ...') ELSE line END, chr(10) ORDER BY i) AS body FROM x WHERE i <= 22 OR i > n - 7 GROUP BY doc_id),
s AS (SELECT c_nationkey AS doc_id, count(*) AS n_files, sum(1 + (c_custkey % 2 = 0)::INT)::BIGINT AS additions, count(*) AS deletions FROM customer GROUP BY c_nationkey),
l AS (SELECT c_nationkey AS doc_id, sum(length(concat('diff --git a/f', c_custkey, '.txt b/f', c_custkey, '.txt')) + CASE WHEN c_custkey % 3 = 0 THEN 20 ELSE 10 END + 7 + 7 + 15 + 4 + 4 + 5 + 11 + 9) - 1 AS chars FROM customer GROUP BY c_nationkey)
SELECT doc_id, concat(body, chr(10), '--- condensed: ', 9 * n_files, ' lines → 29 lines (', floor((1 - length(body) / chars) * 100 + 0.5)::INT, '% saved) ---') AS output, (9 * n_files)::INT AS original_size, 29::INT AS compressed_size,
  29::DOUBLE / (9 * n_files) AS ratio, 'diff' AS format, false AS budget_exceeded, n_files, additions, deletions, false AS told FROM k JOIN s USING (doc_id) JOIN l USING (doc_id)""")
def condense_diff(spark, d):
    """Every nation's diff cut to 30 lines: 21 at the head, 7 at the tail, a marker, the footer."""
    return plans.diff(_whole(_sql(spark, d, DIFF, "customer")), "doc_id", "text", 30)


@query("""SELECT c_nationkey AS doc_id, concat('9 files changed, +7 -0', chr(10), min(CASE WHEN r = 1 THEN concat(CASE WHEN c_custkey % 3 = 0 THEN 'A' ELSE 'M' END, ' f', c_custkey, '.txt (+', 1 + (c_custkey % 2 = 0)::INT, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ' -1' END, ')') END),
  chr(10), '... (', count(*) - 1, ' lines omitted) ...') AS body, 9::BIGINT AS n_files, 7::BIGINT AS additions, 0::BIGINT AS deletions, true AS told
FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer) GROUP BY c_nationkey""")
def condense_diff_told(spark, d):
    """A summary whose totals the text itself tells, cut to three lines and the footer (left out here)."""
    docs = _whole(_sql(spark, d, DIFF, "customer")).withColumn("text", F.concat("text", F.lit("\n 9 files changed, 7 insertions(+)")))
    out = plans.diff(docs, "doc_id", "text", 4, level="summary")
    return out.select("doc_id", F.regexp_replace("output", r"\n--- [^\n]*$", "").alias("body"), "n_files", "additions", "deletions", "told")


@query(f"""WITH f AS ({FILES_SQL}), h AS ({COUNTED_SQL}),
g AS (SELECT doc_id, CASE ext WHEN '.py' THEN 'Python' WHEN '.ts' THEN 'TypeScript' WHEN '.rs' THEN 'Rust' ELSE 'No Extension' END AS kind, count(*) AS n, string_agg(concat(dir, '/', file), ', ' ORDER BY dir, lower(file)) AS files FROM f GROUP BY ALL),
b AS (SELECT doc_id, concat(any_value(head), chr(10), chr(10), string_agg(concat(kind, ' (', n, CASE WHEN n = 1 THEN ' file' ELSE ' files' END, '):', chr(10), '  ', files), concat(chr(10), chr(10)) ORDER BY n DESC, kind)) AS body, 1 + 3 * count(*) AS m FROM g JOIN h USING (doc_id) GROUP BY doc_id),
s AS (SELECT p_partkey % 10 AS doc_id, count(*) AS n, sum(length(name)) + count(*) - 1 AS chars FROM ({NAMES}) GROUP BY ALL)
SELECT doc_id, concat(body, chr(10), '--- condensed: ', n, ' lines → ', m, ' lines (', floor((1 - length(body) / chars) * 100 + 0.5)::INT, '% saved) ---') AS output, n::INT AS original_size, m::INT AS compressed_size, m / n::DOUBLE AS ratio, 'ls' AS format, false AS budget_exceeded
FROM b JOIN s USING (doc_id)""")
def condense_ls(spark, d):
    names = _sql(spark, d, NAMES, "part").select((F.col("p_partkey") % 10).alias("doc_id"), F.col("p_partkey").alias("line_no"), F.col("name").alias("line"))
    return plans.ls(_whole(names), "doc_id", "text", by_type=True)

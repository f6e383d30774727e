"""Registered repository-analytics queries and their DuckDB oracles."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata import rules
from codestrata.functions import markup as M
from codestrata.functions import mdpost
from codestrata.functions import paths as P
from codestrata.functions import sqlfun
from codestrata.operators import parse, report, structure
from codestrata.plans import repositories
from codestrata.plans.templates import CASES
from codestrata.session import table

# Paths made from documents: kinds of names by doc_id, some below ignored folders, some bases that recur.
NAMES = ("main.py", "index.js", "package.json", "a.b.tar.gz", "Cargo.toml", "style.css", ".hidden", "Program.cs", "schema_init.sql", "UserController.php", "app.rb", "noext", "rust-toolchain.toml")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id") % len(NAMES)
    name = F.element_at(F.array(*[F.lit(x) for x in NAMES]), (n + 1).cast("int"))
    folder = F.when(F.col("doc_id") % 7 == 0, F.lit("node_modules/")).otherwise(F.lit(""))
    path = F.concat(F.col("source"), F.lit("/"), folder, F.col("lang"), F.lit("/d"), (F.col("doc_id") % 50).cast("string"), F.lit("/"), name)
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("repo_id"), path.alias("path"), (F.col("n_chars") * 997).alias("size"), "doc_id")


_SQL_DOCS = f"""d AS (SELECT lang AS repo_id, n_chars * 997 AS size, doc_id, ([{", ".join(f"'{x}'" for x in NAMES)}])[doc_id % {len(NAMES)} + 1] AS name,
  source || '/' || CASE WHEN doc_id % 7 = 0 THEN 'node_modules/' ELSE '' END || lang || '/d' || CAST(doc_id % 50 AS VARCHAR) AS dir FROM documents),
 p AS (SELECT repo_id, dir || '/' || name AS path, dir, name, size, doc_id FROM d),
 k AS (SELECT * FROM p WHERE doc_id % 7 <> 0)"""
_EXT = "CASE WHEN regexp_matches(name, '^.+\\.[^.]*$') THEN regexp_extract(name, '(\\.[^.]*)$', 1) ELSE '' END"


def _case_sql(column: str, pairs: dict[str, str]) -> str:
    return "CASE " + column + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + " END"


_TYPE = f"coalesce({_case_sql('name', rules.NAME_TYPES)}, {_case_sql(_EXT, rules.EXTENSION_TYPES)}, 'unknown')"


def html_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "pages")
    head = F.concat(F.lit('<script src="s'), F.col("page_id").cast("string"), F.lit('.js"></script><LINK rel=x href=\'c'), F.col("page_id").cast("string"), F.lit(".css'>"))
    return t.select(F.lit("site").alias("repo_id"), F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.concat(head, F.coalesce("html", F.lit(""))).alias("content"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of a site: pages parsed as markup, facts counted in one aggregate."""
    return parse.stats_of_counts(parse.fact_counts(html_files(spark, sf_dir)))


_TITLE = "regexp_matches(html, '(?i)<title>[^<]*</title>')"


def _html_facts(spark, sf):
    return parse.fact_table(parse.parse_files(html_files(spark, sf))).select("file_path", "kind", "name", "extra")


_HTML_FACTS = f"""SELECT 'p' || page_id || '.html' AS file_path, 'import' AS kind, 's' || page_id || '.js' AS name, '' AS extra FROM pages
UNION ALL SELECT 'p' || page_id || '.html', 'import', 'c' || page_id || '.css', '' FROM pages
UNION ALL SELECT 'p' || page_id || '.html', 'import', x, '' FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<script[^>]*src=["'']([^"'']*)["''][^>]*>', 1)) AS x FROM pages)
UNION ALL SELECT 'p' || page_id || '.html', 'import', x, '' FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<link[^>]*href=["'']([^"'']*)["''][^>]*>', 1)) AS x FROM pages)
UNION ALL SELECT 'p' || page_id || '.html', 'export', regexp_extract(html, '(?i)<title>([^<]*)</title>', 1), 'page-title' FROM pages WHERE {_TITLE}"""


def _file_types(spark, sf):
    kind = P.file_type(F.col("path"))
    return _documents(spark, sf).select("doc_id", "path", kind.alias("type"), P.is_parseable(kind).alias("parseable"), P.extension(F.col("path")).alias("ext"))


def _prune(spark, sf):
    return structure.pruned(_documents(spark, sf)).select("doc_id", "path")


def _size_guard(spark, sf):
    s = structure.size_stats(_documents(spark, sf))
    return s.select("repo_id", "total_size", "file_count", F.size("oversized").cast("long").alias("n_oversized"), "safe")


def _modules(spark, sf):
    return structure.modules(_documents(spark, sf)).select("repo_id", "dir", "module", "files", F.array_join("types", ",").alias("types"), P.module_words(F.col("types"), True).alias("words"))


_TECH_ROWS = ", ".join([f"({i}, '{n}', '{t}', true)" for i, (n, t) in enumerate(rules.TECH_NAMES.items())] + [f"({len(rules.TECH_NAMES) + i}, '{e}', '{t}', false)" for i, (e, t) in enumerate(rules.TECH_EXTENSIONS.items())])
_ENTRY_ROWS = ", ".join(f"('{t}', '{n}')" for t, ns in rules.ENTRY_FILES.items() for n in ns)
_TECH = f"""r(rank, pat, technology, whole) AS (VALUES {_TECH_ROWS}),
 h AS (SELECT k.repo_id, string_split(k.path, '/') AS segs, r.rank, r.technology FROM k JOIN r ON CASE WHEN r.whole THEN k.name = r.pat ELSE ends_with(k.name, r.pat) END),
 t AS (SELECT repo_id, technology, min({{'s': segs, 'r': rank}}) AS seen FROM h GROUP BY ALL)"""


def _purposes(spark, sf):
    stems = F.array(*[F.lit(x) for x in ("schema", "Seed_Users", "migrate", "sp_x", "user.config", "apiRouter", "AuthLogin", "admin", "tokens", "layout", "x", "indexView", "db", "spec")])
    stem = F.element_at(stems, (F.col("p_partkey") % 14 + 1).cast("int"))
    ext = F.element_at(F.array(*[F.lit(x) for x in ("sql", "js", "php", "css", "py")]), (F.col("p_size") % 5 + 1).cast("int"))
    path = F.concat(F.lit("src/"), stem, F.lit("."), ext)
    return table(spark, sf, "part").select("p_partkey", path.alias("path"), P.file_purpose(P.file_type(path), path).alias("purpose"))


def _purpose_sql() -> str:
    out = "CASE "
    for ext, kind in (("sql", "sql"), ("js", "javascript"), ("php", "php"), ("css", "stylesheet")):
        for parts, title in rules.PURPOSES[kind]:
            cond = " OR ".join(f"contains(name, '{x}')" for x in parts)
            out += f"WHEN ext = '{ext}' AND ({cond}) THEN '{title}' "
        out += f"WHEN ext = '{ext}' THEN '{rules.TYPE_TITLES[kind]}' "
    return out + f"ELSE '{rules.TYPE_TITLES['python']}' END"


_PURPOSES = f"""SELECT p_partkey, 'src/' || stem || '.' || ext AS path, {_purpose_sql()} AS purpose FROM (
 SELECT *, lower(stem || '.' || ext) AS name FROM (SELECT p_partkey, (['schema', 'Seed_Users', 'migrate', 'sp_x', 'user.config', 'apiRouter', 'AuthLogin', 'admin', 'tokens', 'layout', 'x', 'indexView', 'db', 'spec'])[p_partkey % 14 + 1] AS stem,
 (['sql', 'js', 'php', 'css', 'py'])[p_size % 5 + 1] AS ext FROM part))"""

_DIALECT_TEXTS = (("SELECT [a] FROM t", "transactsql"), ("SELECT TOP 3 a FROM t", "transactsql"), ("SELECT `a` FROM t", "mysql"), ("CREATE TABLE t (a SERIAL)", "postgresql"), ("SELECT 1", "mysql"), ("LANGUAGE plpgsql", "postgresql"), ("a INT auto_increment, b SERIAL", "mysql"), ("CREATE DATABASE d", "mysql"))


def _dialects(spark, sf):
    text = F.element_at(F.array(*[F.lit(a) for a, _ in _DIALECT_TEXTS]), (F.col("o_orderkey") % len(_DIALECT_TEXTS) + 1).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", P.sql_dialect(text).alias("dialect"))


def _batches(spark, sf):
    w = F.concat(F.lit("INSERT INTO t VALUES ("), F.col("l_linenumber").cast("string"), F.lit(")"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", w.alias("s")))), lambda x: x["s"]), "\n  go ; \n")
    t = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.concat(text, F.lit("\nGO\nPRINT 'x'")).alias("sql"))
    return t.select("l_orderkey", F.size(P.go_batches(F.col("sql"))).cast("long").alias("batches"))


def _sensitive(spark, sf):
    forms = F.array(F.lit("/etc/x"), F.lit("/etcetera/x"), F.lit("/usr"), F.lit("/home/u/app"), F.lit("C:\\Windows"), F.lit("/Library/y"))
    p = F.element_at(forms, (F.col("s_suppkey") % 6 + 1).cast("int"))
    return table(spark, sf, "supplier").select("s_suppkey", p.alias("path"), P.is_sensitive(p).alias("sensitive"))


_URLS = ("https://host/u/app{}.git", "git@host:u/app{}.git", "./local/app{}", "http://host/app{}/", "app{}.zip", "C:\\work\\app{}", "ssh://host/a b{}")


def _urls(spark, sf):
    u = F.element_at(F.array(*[F.concat(*[F.lit(x) if i == 0 else F.concat(F.col("page_id").cast("string"), F.lit(x)) for i, x in enumerate(t.split("{}"))]) for t in _URLS]), (F.col("page_id") % len(_URLS) + 1).cast("int"))
    return table(spark, sf, "pages").select("page_id", P.repo_name(u).alias("name"), P.input_kind(u).alias("kind"), P.is_remote(u).alias("remote"), P.is_local(u).alias("local"))


_URL_SQL = f"""SELECT page_id, (['app' || i, 'app' || i, 'app' || i, 'app' || i, 'app' || i || '-zip', '-work-app' || i, 'a-b' || i])[m] AS name,
 (['remote', 'remote', 'local', 'remote', 'zip', 'local', 'remote'])[m] AS kind, m IN (1, 2, 4, 7) AS remote, m NOT IN (2, 5) AS local
 FROM (SELECT page_id, CAST(page_id AS VARCHAR) AS i, page_id % {len(_URLS)} + 1 AS m FROM pages)"""


def _markdown(spark, sf):
    i = F.col("doc_id").cast("string")
    md = F.concat(F.lit("## **T"), i, F.lit("** — note\n\n| A | B |\n|---|---|\n| x | y |\n\nSee [link"), i, F.lit("](http://x) and `code`.\n```js\nplain\n```\n"))
    return table(spark, sf, "documents").select("doc_id", mdpost.clean_markdown(md).alias("clean"), mdpost.strip_fence(F.concat(F.lit(" ```markdown\n"), md, F.lit("```  "))).alias("unfenced_start"), mdpost.section_key(F.concat(F.lit("  `Api` "), i, F.lit("   X — y"))).alias("key"), mdpost.data_rows(md).cast("long").alias("rows"))


_MARKDOWN = """SELECT doc_id, 'T' || doc_id || ' — note' || chr(10) || 'See link' || doc_id || ' and code.' || chr(10) || '``js' || chr(10) || 'plain' || chr(10) || '``' AS clean,
 '## **T' || doc_id || '** — note' || chr(10) || chr(10) || '| A | B |' || chr(10) || '|---|---|' || chr(10) || '| x | y |' || chr(10) || chr(10) || 'See [link' || doc_id || '](http://x) and `code`.' || chr(10) || '```js' || chr(10) || 'plain' || chr(10) || '```' AS unfenced_start,
 'api ' || doc_id || ' x' AS key, CAST(5 AS BIGINT) AS rows FROM documents"""


def _case_parsed(spark, sf, name):
    return parse.in_order(parse.records(parse.parse_files(CASES[name].files(spark, sf))))


def _route_lines(spark, sf):
    return report.route_lines(_case_parsed(spark, sf, "python")).select("line")


def _table_blocks(spark, sf):
    p = _case_parsed(spark, sf, "sql_ddl")
    return report._by_fact(p, "tables", report.table_block).select("line")


_TABLE_BLOCKS = """SELECT 'db/t' || p_partkey || '.sql' || chr(10) || '  t' || p_partkey || ' IF NOT EXISTS' || chr(10) || '  id INT AUTO_INCREMENT' || chr(10) || '  n VARCHAR(' || p_size || ') NOT NULL DEFAULT ''a,b;c''' || chr(10) || '  price DECIMAL(10,2)' || chr(10) ||
 '  FK fk: n → brand(k, j) ON DELETE CASCADE' || chr(10) || '  [PK: id | UNIQUE: n]' AS line FROM part"""


def _routines(spark, sf):
    return _case_parsed(spark, sf, "sql_routines").select("path", report.routine_block().alias("block"))


def _file_blocks(spark, sf):
    return _case_parsed(spark, sf, "stylesheet").select("path", report.file_lines().alias("block"))


def _stats(spark, sf):
    files = None
    for name in ("python", "javascript", "sql_ddl", "sql_dml", "stylesheet"):
        f = CASES[name].files(spark, sf)
        files = f if files is None else files.unionByName(f)
    return parse.stats_of_counts(parse.fact_counts(files))


def _stats_sql() -> str:
    plural = {"class": "classes", "index": "indexes", "procedure": "storedProcedures", "alter": "alterTables"}
    totals: dict[str, list[str]] = {k: ["0"] for k in parse.COUNTED}
    for name in ("python", "javascript", "sql_ddl", "sql_dml", "stylesheet"):
        case = CASES[name]
        kinds = [k for k, _, _ in case.expected]
        for kind in set(kinds):
            field = plural.get(kind, kind + "s")
            if field in totals:
                n = 1 if kind == "alter" else kinds.count(kind)
                totals[field].append(f"{n} * (SELECT count(*) FROM {case.source})")
    files = " + ".join(f"(SELECT count(*) FROM {CASES[n].source})" for n in ("python", "javascript", "sql_ddl", "sql_dml", "stylesheet"))
    return f"SELECT 'r' AS repo_id, CAST({files} AS BIGINT) AS files, " + ", ".join(f"CAST({' + '.join(v)} AS BIGINT) AS n_{k}" for k, v in totals.items())


def _errors(spark, sf):
    bad = F.when(F.col("s_suppkey") % 3 == 0, F.lit("function f( {")).when(F.col("s_suppkey") % 3 == 1, F.lit("<a><b></a>")).otherwise(F.lit("def ("))
    path = F.concat(F.lit("b"), F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 3 == 0, ".js").when(F.col("s_suppkey") % 3 == 1, ".csproj").otherwise(".py"))
    files = table(spark, sf, "supplier").select(F.lit("r").alias("repo_id"), path.alias("path"), bad.alias("content"))
    return parse.parse_errors(parse.parse_files(files)).select("path", "type")


def _module_docs(spark, sf):
    f = CASES["stylesheet"].files(spark, sf).withColumn("path", F.concat(F.lit("m"), F.regexp_replace("path", r"^css/p(\d*)(\d)\.css$", "$2/p$1$2.css")))
    d = report.module_docs(f, parse.parse_files(f))
    return d.select("name", F.size(F.split("content", "\n")).cast("long").alias("n_lines"), F.startswith("content", F.concat(F.lit("# Module: "), F.col("name"))).alias("headed"))


_MODULE_DOCS = """SELECT 'm' || p_partkey % 10 AS name, CAST(5 + (4 + count(*)) + 1 + (4 + 2 * count(*)) + 1 + (4 + count(*)) AS BIGINT) AS n_lines, true AS headed FROM part GROUP BY ALL"""


_INPUTS = ("https://h/u/r{}", "git@h:u/r{}", "./r{}", " ", "", "r{}", "C:\\r{}", "ssh://h/r{}", "a/b{}", "http:/h{}", "~/r{}")


def _valid_inputs(spark, sf):
    i = F.col("page_id").cast("string")
    u = F.element_at(F.array(*[F.replace(F.lit(t), F.lit("{}"), i) for t in _INPUTS]), (F.col("page_id") % len(_INPUTS) + 1).cast("int"))
    home = F.replace(P.expand_home(u), F.lit(os.path.expanduser("~")), F.lit("HOME"))
    return table(spark, sf, "pages").select("page_id", P.is_valid_input(u).alias("valid"), F.when(F.startswith(u, F.lit("~")), home).otherwise(u).alias("path"))


_VALID_INPUTS = f"""SELECT page_id, (page_id % {len(_INPUTS)}) NOT IN (3, 4, 5) AS valid, replace(replace((['{"', '".join(_INPUTS)}'])[page_id % {len(_INPUTS)} + 1], '{{}}', CAST(page_id AS VARCHAR)), '~', 'HOME') AS path FROM pages"""


def _sql_functions(spark, sf):
    """The parser as a function and as a table function of SQL text."""
    sqlfun.register(spark)
    table(spark, sf, "orders").select("o_orderkey").repartition(spark.sparkContext.defaultParallelism).createOrReplaceTempView("source_orders")
    text = "concat('import m', o_orderkey, '\\n\\ndef f', o_orderkey, '(): pass\\n')"
    return spark.sql(f"SELECT o_orderkey, f.kind, f.name FROM source_orders, LATERAL source_facts('python', {text}) f WHERE f.kind = 'imports' OR f.kind = 'functions' AND get_json_object(parse_source('python', {text}), '$.functions[0].name') = f.name")


def queries():
    found = {f"facts_{name}": case.run for name, case in CASES.items()}
    return found | {
        "facts_markup": _html_facts,
        "html_stats": flagship,
        "file_types": _file_types,
        "ignored_prune": _prune,
        "tree_nodes": lambda s, d: structure.tree_nodes(_documents(s, d)),
        "tree_lines": lambda s, d: structure.tree_lines(_documents(s, d)).select("repo_id", "path", F.col("ord").cast("long").alias("ord"), "line"),
        "technologies": lambda s, d: structure.technologies(_documents(s, d)).withColumn("ord", F.col("ord").cast("long")),
        "entry_points": lambda s, d: structure.entry_points(_documents(s, d)),
        "size_guard": _size_guard,
        "modules": _modules,
        "file_purpose": _purposes,
        "sql_dialect": _dialects,
        "go_batches": _batches,
        "sensitive_paths": _sensitive,
        "input_kinds": _urls,
        "markdown_clean": _markdown,
        "route_lines": _route_lines,
        "table_blocks": _table_blocks,
        "routine_blocks": _routines,
        "file_blocks": _file_blocks,
        "project_stats": _stats,
        "parse_errors": _errors,
        "module_docs": _module_docs,
        "valid_inputs": _valid_inputs,
        "sql_functions": _sql_functions,
    } | repositories.queries()


def oracle_sql():
    found = {f"facts_{name}": case.sql() for name, case in CASES.items()}
    zeros = ", ".join(f"CAST({'n_imports' if k == 'imports' else 'n_exports' if k == 'exports' else '0'} AS BIGINT) AS n_{k}" for k in parse.COUNTED)
    return found | {
        "facts_markup": _HTML_FACTS,
        "html_stats": f"SELECT 'site' AS repo_id, (SELECT count(*) FROM pages) AS files, {zeros} FROM (SELECT count(*) FILTER (kind = 'import') AS n_imports, count(*) FILTER (kind = 'export') AS n_exports FROM ({_HTML_FACTS}))",
        "file_types": f"WITH {_SQL_DOCS}, e AS (SELECT doc_id, path, name, {_TYPE} AS type, {_EXT} AS ext FROM p) SELECT doc_id, path, type, type NOT IN ('data', 'toml', 'lock', 'unknown') AS parseable, ext FROM e",
        "ignored_prune": f"WITH {_SQL_DOCS} SELECT doc_id, path FROM k",
        "tree_nodes": f"""WITH {_SQL_DOCS}, u AS (SELECT repo_id, string_split(path, '/') AS s, unnest(range(1, len(string_split(path, '/')) + 1)) AS n FROM k)
            SELECT DISTINCT repo_id, array_to_string(s[1:n], '/') AS path, array_to_string(s[1:n - 1], '/') AS parent_path, s[n] AS name, CASE WHEN n = len(s) THEN 'file' ELSE 'directory' END AS type, CAST(n AS INTEGER) AS depth FROM u""",
        "tree_lines": f"""WITH {_SQL_DOCS}, u AS (SELECT repo_id, string_split(path, '/') AS s, unnest(range(1, len(string_split(path, '/')) + 1)) AS n FROM k),
            q AS (SELECT DISTINCT repo_id, s[1:n] AS segs, array_to_string(s[1:n - 1], '/') AS parent, n FROM u),
            l AS (SELECT *, lead(segs[n]) OVER (PARTITION BY repo_id, parent ORDER BY segs[n]) IS NULL AS is_last FROM q),
            m AS (SELECT a.repo_id, a.segs, a.n, string_agg(CASE WHEN b.n = a.n THEN CASE WHEN b.is_last THEN '└── ' ELSE '├── ' END ELSE CASE WHEN b.is_last THEN '    ' ELSE '│   ' END END, '' ORDER BY b.n) AS stem
                  FROM l a JOIN l b ON a.repo_id = b.repo_id AND b.segs = a.segs[1:b.n] AND b.n <= a.n GROUP BY ALL)
            SELECT repo_id, array_to_string(segs, '/') AS path, row_number() OVER (PARTITION BY repo_id ORDER BY segs) AS ord, stem || segs[n] AS line FROM m""",
        "technologies": f"WITH {_SQL_DOCS}, {_TECH} SELECT repo_id, technology, row_number() OVER (PARTITION BY repo_id ORDER BY seen.s, seen.r) AS ord FROM t",
        "entry_points": f"WITH {_SQL_DOCS}, {_TECH}, e(technology, name) AS (VALUES {_ENTRY_ROWS}) SELECT t.repo_id, t.technology, x.path FROM t LEFT JOIN (SELECT k.repo_id, e.technology, k.path FROM k JOIN e USING (name)) x USING (repo_id, technology)",
        "size_guard": f"WITH {_SQL_DOCS} SELECT repo_id, CAST(sum(size) AS BIGINT) AS total_size, count(*) AS file_count, count(*) FILTER (size > 5 * 1024 * 1024) AS n_oversized, NOT (sum(size) > 100 * 1024 * 1024 OR count(*) > 5000) AS safe FROM k GROUP BY repo_id",
        "modules": f"""WITH {_SQL_DOCS}, e AS (SELECT repo_id, dir, {_TYPE} AS type FROM k), g AS (SELECT repo_id, dir, count(*) AS files, list_sort(list_distinct(list(type))) AS types FROM e GROUP BY ALL),
            b AS (SELECT *, string_split(dir, '/') AS s, count(*) OVER (PARTITION BY repo_id, string_split(dir, '/')[-1]) AS c FROM g),
            l AS (SELECT *, CASE WHEN c > 1 THEN s[-2] || '-' || s[-1] ELSE s[-1] END AS label FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY repo_id, label ORDER BY dir) AS n FROM l)
            SELECT repo_id, dir, label || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS module, files, array_to_string(types, ',') AS types,
              coalesce(nullif(array_to_string([{", ".join(f"CASE WHEN list_has_any(types, [{', '.join(chr(39) + t + chr(39) for t in ts)}]) THEN '{short}' END" for ts, _, short in rules.MODULE_WORDS)}], ', '), ''), '-') AS words FROM r""",
        "file_purpose": _PURPOSES,
        "sql_dialect": f"SELECT o_orderkey, ([{', '.join(chr(39) + d + chr(39) for _, d in _DIALECT_TEXTS)}])[o_orderkey % {len(_DIALECT_TEXTS)} + 1] AS dialect FROM orders",
        "go_batches": "SELECT l_orderkey, count(*) AS batches FROM lineitem GROUP BY l_orderkey",
        "sensitive_paths": "SELECT s_suppkey, (['/etc/x', '/etcetera/x', '/usr', '/home/u/app', 'C:\\Windows', '/Library/y'])[s_suppkey % 6 + 1] AS path, s_suppkey % 6 IN (0, 2, 4, 5) AS sensitive FROM supplier",
        "input_kinds": _URL_SQL,
        "markdown_clean": _MARKDOWN,
        "route_lines": "SELECT 'GET   ' || rpad('/o/' || o_orderkey, CAST(greatest(25, length('/o/' || o_orderkey)) AS INTEGER), ' ') || ' → src/m' || o_orderkey || '.py:4' AS line FROM orders UNION ALL SELECT 'POST  ' || rpad('/c/' || o_orderkey, CAST(greatest(25, length('/c/' || o_orderkey)) AS INTEGER), ' ') || ' → src/m' || o_orderkey || '.py:9' FROM orders",
        "table_blocks": _TABLE_BLOCKS,
        "routine_blocks": "SELECT 'db/r' || c_custkey || '.sql' AS path, 'FUNCTION f' || c_custkey || '(IN x INT) → INT' || chr(10) || '  PROCEDURE p' || c_custkey || '(IN a INT, OUT b VARCHAR(3))' AS block FROM customer",
        "file_blocks": "SELECT 'css/p' || p_partkey || '.css' AS path, '-- p' || p_partkey || '.css (stylesheet) --' || chr(10) || 'Imports: b' || p_size || '.css' || chr(10) || 'Exports: p-' || p_partkey || ' (class), k' || p_partkey || ' (class), v-' || p_size || ' (css-variable)' AS block FROM part",
        "project_stats": _stats_sql(),
        "parse_errors": "SELECT 'b' || s_suppkey || CASE s_suppkey % 3 WHEN 0 THEN '.js' ELSE '.csproj' END AS path, CASE s_suppkey % 3 WHEN 0 THEN 'javascript' ELSE 'csproj' END AS type FROM supplier WHERE s_suppkey % 3 <> 2",
        "module_docs": _MODULE_DOCS,
        "valid_inputs": _VALID_INPUTS,
        "sql_functions": "SELECT o_orderkey, u.kind AS kind, u.name AS name FROM (SELECT o_orderkey, unnest([{'kind': 'functions', 'name': 'f' || o_orderkey}, {'kind': 'imports', 'name': 'm' || o_orderkey}]) AS u FROM orders)",
    } | repositories.oracle_sql()

"""Whole repositories for the report queries: one for each supplier, and what reports of it must say.

As in ``templates``, texts are filled from a row's columns and parsed, while the oracle fills
the expected report from the same columns without parsing. Repositories of even keys have a
Cargo manifest, all have a package.json; two folders share a base name and one file is empty.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions import mdpost
from codestrata.operators import enhance, parse, report
from codestrata.plans.templates import spark_text, sql_text
from codestrata.session import table

KEY = "s_suppkey"
REPO = f"shop<<{KEY}>>"
FILES = {
    "app/main.py": """import os
from lib<<s_suppkey>> import x

@app.get('/p/<<s_suppkey>>')
def run_<<s_suppkey>>(a):
    pass

class P<<s_suppkey>>(Base):
    def m(self): pass
""",
    "app/index.js": """import d from 'pkg<<s_suppkey>>';
export const f<<s_suppkey>> = async (x) => x;
app.post('/j/<<s_suppkey>>', h);
""",
    "db/schema.sql": """-- note <<s_suppkey>>
CREATE TABLE t<<s_suppkey>> (
  id INT PRIMARY KEY,
  n VARCHAR(<<s_suppkey>>) NOT NULL DEFAULT 'a;b',
  b INT,
  UNIQUE (n),
  CHECK (b > 0),
  FOREIGN KEY (b) REFERENCES u(k) ON DELETE CASCADE
);
CREATE VIEW v<<s_suppkey>> AS SELECT id FROM t<<s_suppkey>>;
CREATE UNIQUE INDEX i<<s_suppkey>> ON t<<s_suppkey>> (n, b);
CREATE PROCEDURE p<<s_suppkey>>(IN a INT)
BEGIN
  SELECT 1;
END;
CREATE FUNCTION g<<s_suppkey>>(x INT) RETURNS INT
BEGIN
  RETURN 1;
END;
CREATE TRIGGER tr<<s_suppkey>> BEFORE INSERT ON t<<s_suppkey>> FOR EACH ROW SET NEW.n = 1;
CREATE DATABASE d<<s_suppkey>>;
INSERT INTO t<<s_suppkey>> (id, n) VALUES (1, 'a');
UPDATE t<<s_suppkey>> SET n = 'b' WHERE id = 1;
DELETE FROM t<<s_suppkey>> WHERE id = 2;
SELECT id, n AS m FROM t<<s_suppkey>>;
ALTER TABLE t<<s_suppkey>> ADD COLUMN z INT;
DROP VIEW old<<s_suppkey>>;
""",
    "src/app/empty.js": "",
    "web/index.html": "<title>Shop <<s_suppkey>></title><script src=\"s<<s_suppkey>>.js\"></script>",
    "web/tokens.css": "@import 'b<<s_suppkey>>.css';\n.c<<s_suppkey>> { --v<<s_suppkey>>: 1; }\n",
    "package.json": """{"name": "shop", "version": "1.<<s_suppkey>>.0", "description": "", "license": "MIT", "author": "A", "repository": {"url": "https://h/<<s_suppkey>>"},
 "dependencies": {"express": "^4.<<s_suppkey>>"}, "devDependencies": {"jest": "29"}}""",
    "node_modules/x/index.js": "export const never = 1;",
}
CARGO = """[package]
name = "c<<s_suppkey>>"
version = "0.<<s_suppkey>>.1"
edition = "2021"
authors = ["A", "B"]

[dependencies]
serde = "1.<<s_suppkey>>"
own = { path = "../own" }

[dev-dependencies]
rand = "0.8"

[features]
default = ["a<<s_suppkey>>"]
a<<s_suppkey>> = []
"""


def of_rows(rows: DataFrame) -> DataFrame:
    """files(repo_id, path, size, content) of rows with a supplier's key."""
    each = [F.struct(F.lit(path).alias("path"), spark_text(text).alias("content")) for path, text in FILES.items()]
    cargo = F.when(F.col(KEY) % 2 == 0, F.array(F.struct(F.lit("Cargo.toml").alias("path"), spark_text(CARGO).alias("content")))).otherwise(F.slice(F.array(each[0]), 1, 0))
    f = rows.select(spark_text(REPO).alias("repo_id"), F.explode(F.concat(F.array(*each), cargo)).alias("f")).select("repo_id", "f.*")
    return f.select("repo_id", "path", F.octet_length("content").cast("long").alias("size"), "content")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_rows(table(spark, sf_dir, "supplier").select(KEY).repartition(spark.sparkContext.defaultParallelism))


SECTIONS = ("overview", "statistics", "files", "endpoints", "dependencies", "alters", "tables", "views", "indexes", "routines", "triggers", "dml", "drops", "comments")


def sections(f: DataFrame) -> DataFrame:
    """repo_id, section, text: each section of the text report."""
    out = None
    # every section reads the parsed records: kept, not parsed once a section
    for name, s in zip(SECTIONS, report.text_sections(f, parse.parse_files(f).persist()), strict=True):
        s = s.filter("text IS NOT NULL AND text <> ''").select("repo_id", F.lit(name).alias("section"), "text")
        out = s if out is None else out.unionByName(s)
    return out


#: What the reports of a repository say. ⟦a¦b⟧: a for even keys, b for others.
EXPECTED_SECTIONS = {
    "overview": """PROJECT OVERVIEW
================
Technologies: ⟦Rust, ⟧JavaScript, Python, SQL, Node.js, Frontend, HTML, CSS
Entry points:
  Python → app/main.py
  Node.js → app/index.js
  Frontend → web/index.html""",
    "statistics": """PROJECT STATISTICS
==================
Files analyzed: ⟦7¦6⟧
Total imports: ⟦8¦5⟧
Total exports: 6
Total functions: 4
Total classes: 2
Total routes: 2
Total tables: 1
Total views: 1
Total indexes: 1
Total stored procedures: 1
Total triggers: 1
Total databases: 1
Total inserts: 1
Total updates: 1
Total deletes: 1
Total selects: 1
Total alter tables: 1
Total drops: 1
Total comments: 1""",
    "files": """⟦-- Cargo.toml (cargotoml) --
Imports: serde@1.<<s_suppkey>>, own@workspace, rand@0.8

⟧-- index.js (javascript) --
Imports: pkg<<s_suppkey>>
Exports: f<<s_suppkey>> (const)
Functions: f<<s_suppkey>> (arrow) async
Routes: POST /j/<<s_suppkey>>

-- schema.sql (sql) --
Functions: g<<s_suppkey>> (function), p<<s_suppkey>> (procedure)
Classes: t<<s_suppkey>>
Tables: t<<s_suppkey>>(id, n, b) FK: [b → u(k)]
Views: v<<s_suppkey>>
Indexes: i<<s_suppkey>> ON t<<s_suppkey>>(n, b)
Procedures: p<<s_suppkey>>(IN a INT)
Triggers: tr<<s_suppkey>> (BEFORE INSERT ON t<<s_suppkey>>)
Databases: d<<s_suppkey>>
Inserts: INTO t<<s_suppkey>>(id, n)
Updates: UPDATE t<<s_suppkey>> SET n = 'b'
Deletes: FROM t<<s_suppkey>>
Selects: SELECT id, n AS m FROM t<<s_suppkey>>
Alter Tables: t<<s_suppkey>>: add column z
Drops: view old<<s_suppkey>>
Comments: L1 single-line: note <<s_suppkey>>

-- empty.js (javascript) --
Pendiente de implementar

-- index.html (markup) --
Imports: s<<s_suppkey>>.js
Exports: Shop <<s_suppkey>> (page-title)

-- tokens.css (stylesheet) --
Imports: b<<s_suppkey>>.css
Exports: c<<s_suppkey>> (class), v<<s_suppkey>> (css-variable)

-- main.py (python) --
Imports: os, lib<<s_suppkey>>
Exports: run_<<s_suppkey>> (module), P<<s_suppkey>> (module)
Functions: run_<<s_suppkey>> (function)
Classes: P<<s_suppkey>> extends Base
Routes: GET /p/<<s_suppkey>>""",
    "endpoints": """API ENDPOINTS
=============
POST  <<pad_j>> → app/index.js:3
GET   <<pad_p>> → app/main.py:4""",
    "dependencies": """DEPENDENCY MAP
==============

⟦Cargo.toml
  imports: serde@1.<<s_suppkey>>, own@workspace, rand@0.8

⟧app/index.js
  imports: pkg<<s_suppkey>>

web/index.html
  imports: s<<s_suppkey>>.js

web/tokens.css
  imports: b<<s_suppkey>>.css

app/main.py
  imports: os, lib<<s_suppkey>>""",
    "alters": """ALTER MAP
=========

db/schema.sql
  t<<s_suppkey>>: add column z""",
    "tables": """TABLES
======

db/schema.sql
  t<<s_suppkey>>
  id INT PK
  n VARCHAR(<<s_suppkey>>) NOT NULL DEFAULT 'a;b'
  b INT
  FK : b → u(k) ON DELETE CASCADE
  [UNIQUE: n | CHECK: b > 0]""",
    "views": """VIEWS
=====

db/schema.sql
  v<<s_suppkey>>""",
    "indexes": """INDEXES
=======

db/schema.sql
  i<<s_suppkey>> ON t<<s_suppkey>> (n, b) unique""",
    "routines": """ROUTINES
========

app/index.js
  FUNCTION f<<s_suppkey>>(x)

db/schema.sql
  FUNCTION g<<s_suppkey>>(IN x INT) → INT
  PROCEDURE p<<s_suppkey>>(IN a INT)

app/main.py
  FUNCTION run_<<s_suppkey>>(a)""",
    "triggers": """TRIGGERS
========

db/schema.sql
  tr<<s_suppkey>> (BEFORE INSERT ON t<<s_suppkey>>)""",
    "dml": """DML STATEMENTS
==============

db/schema.sql
  INSERT:
    INTO t<<s_suppkey>>(id, n)
  UPDATE:
    t<<s_suppkey>> SET n = 'b'
  DELETE:
    FROM t<<s_suppkey>>
  SELECT:
    SELECT id, n AS m FROM t<<s_suppkey>>""",
    "drops": """DROPS
=====

db/schema.sql
  view old<<s_suppkey>>""",
    "comments": """COMMENTS
========
db/schema.sql:L1 single-line: note <<s_suppkey>>""",
}
EXPECTED_README = """# shop<<s_suppkey>>

## Overview

| Technology |
|------------|
⟦| Rust |
⟧| JavaScript |
| Python |
| SQL |
| Node.js |
| Frontend |
| HTML |
| CSS |

| Technology | File |
|------------|------|
| Python | main.py |
| Node.js | index.js |
| Frontend | index.html |

## Project Info

| Field | Value |
|-------|-------|
⟦| Version | 0.<<s_suppkey>>.1 |
| Edition | 2021 |
| Authors | A, B |
¦| Version | 1.<<s_suppkey>>.0 |
| License | MIT |
| Author | A |
| Repository | https://h/<<s_suppkey>> |
⟧
## Dependencies

| Name | Version | Type |
|------|---------|------|
⟦| serde | 1.<<s_suppkey>> | dependencies |
| own | - | dependencies |
| rand | 0.8 | dev-dependencies |

## Features

| Name | Implies |
|------|---------|
| default | a<<s_suppkey>> |
| a<<s_suppkey>> | - |
¦| express | ^4.<<s_suppkey>> | dependencies |
| jest | 29 | devDependencies |
⟧
## Project Structure

```
shop<<s_suppkey>>/
⟦├── Cargo.toml
⟧├── app
│   ├── index.js
│   └── main.py
├── db
│   └── schema.sql
├── package.json
├── src
│   └── app
│       └── empty.js
└── web
    ├── index.html
    └── tokens.css
```

## Modules

| Module | Files | Description |
|--------|-------|-------------|
| [app](docs/shop<<s_suppkey>>-app.md) | 2 | JavaScript, Python |
| [db](docs/db.md) | 1 | SQL scripts |
| [app](docs/src-app.md) | 1 | JavaScript |
| [web](docs/web.md) | 2 | CSS, HTML |

## API Endpoints

| Method | Path | File |
|--------|------|------|
| POST | /j/<<s_suppkey>> | app/index.js |
| GET | /p/<<s_suppkey>> | app/main.py |

## Database Schema

| Type | Name | Details |
|------|------|---------|
| Table | t<<s_suppkey>> | 3 columns |
| View | v<<s_suppkey>> |  |
| Index | i<<s_suppkey>> | ON t<<s_suppkey>> |"""
EXPECTED_MODULES = {
    "shop<<s_suppkey>>-app": """# Module: shop<<s_suppkey>>-app


This module contains JavaScript application logic and Python application logic (2 files).

## File Structure

| File | Purpose |
|------|---------|
| `index.js` | Module entry point |
| `main.py` | Python module |

## Functions

| Name | Kind | Async | File |
|------|------|-------|------|
| f<<s_suppkey>> | arrow | yes | `index.js` |
| run_<<s_suppkey>> | function |  | `main.py` |

## Classes

| Name | Extends | File |
|------|---------|------|
| P<<s_suppkey>> | Base | `main.py` |

## Exports

| Name | Kind | File |
|------|------|------|
| f<<s_suppkey>> | const | `index.js` |
| run_<<s_suppkey>> | module | `main.py` |
| P<<s_suppkey>> | module | `main.py` |

## Routes

| Method | Path | File |
|--------|------|------|
| POST | /j/<<s_suppkey>> | `index.js` |
| GET | /p/<<s_suppkey>> | `main.py` |""",
    "db": """# Module: db


This module contains SQL scripts and database objects (1 file).

## File Structure

| File | Purpose |
|------|---------|
| `schema.sql` | Database schema initialization |

## Functions

| Name | Kind | Async | File |
|------|------|-------|------|
| g<<s_suppkey>> | function |  | `schema.sql` |
| p<<s_suppkey>> | procedure |  | `schema.sql` |

## Classes

| Name | Extends | File |
|------|---------|------|
| t<<s_suppkey>> | - | `schema.sql` |

## SQL Objects

### Tables

| Table | Columns |
|-------|---------|
| t<<s_suppkey>> | id, n, b |

### Views

- v<<s_suppkey>>

### Indexes

- i<<s_suppkey>> ON t<<s_suppkey>>(n, b)""",
    "src-app": """# Module: src-app


This module contains JavaScript application logic (1 file).

## File Structure

| File | Purpose |
|------|---------|
| `empty.js` | Pendiente de implementar |""",
    "web": """# Module: web


This module contains CSS styles and HTML templates (2 files).

## File Structure

| File | Purpose |
|------|---------|
| `index.html` | HTML template |
| `tokens.css` | Design tokens and CSS variables |

## Exports

| Name | Kind | File |
|------|------|------|
| Shop <<s_suppkey>> | page-title | `index.html` |
| c<<s_suppkey>> | class | `tokens.css` |

## CSS Variables

| Variable | File |
|----------|------|
| --v<<s_suppkey>> | `tokens.css` |""",
}
_EITHER = re.compile(r"⟦([^¦⟧]*)(?:¦([^⟧]*))?⟧")
_ROWS = f"(SELECT *, rpad('/j/' || {KEY}, CAST(greatest(25, length('/j/' || {KEY})) AS INTEGER), ' ') AS pad_j, rpad('/p/' || {KEY}, CAST(greatest(25, length('/p/' || {KEY})) AS INTEGER), ' ') AS pad_p FROM supplier)"


def _expected(text: str) -> str:
    even, odd = (sql_text(_EITHER.sub(lambda m, g=g: m[g] or "", text)) for g in (1, 2))
    return even if even == odd else f"CASE WHEN {KEY} % 2 = 0 THEN {even} ELSE {odd} END"


def _rows(column: str, texts: dict[str, str], value: str = "text") -> str:
    rows = ", ".join(f"{{'n': {sql_text(n)}, 't': {_expected(t)}}}" for n, t in texts.items())
    return f"SELECT {sql_text(REPO)} AS repo_id, u.n AS {column}, u.t AS {value} FROM (SELECT *, unnest([{rows}]) AS u FROM {_ROWS})"


def _report(which: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = files(spark, sf_dir)
        p = parse.parse_files(f).persist()
        return report.markdown_readme(f, p, f) if which == "readme" else report.module_docs(f, p)

    return run


def _model(prompt: str) -> str:
    """Stands for a language model: rewords a README badly, and fails for some."""
    text = prompt.split("\n\n", 1)[1]
    if "shop1\n" in text or "shop2\n" in text:
        raise ValueError("no answer")
    lines = [x for x in text.split("\n") if not x.startswith("| Authors") and x != "## Overview"]
    glued = "\n".join(lines).replace("| Technology | File |\n|------------|------|", "| Technology | File ---", 1)
    return f"```markdown\n{glued}\n\n\n\n## Invented\n\nNothing of the kind.\n\nHope this helps!\n```"


def _enhanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The README of each repository after a model and the repair of its answer."""
    return enhance.enhanced(_report("readme")(spark, sf_dir), _model, "md-enhancer")


def repaired_readme() -> str:
    """The README without what the model left out: rules are as the repair writes them, names like files are code, the glued header keeps no rule."""
    text = EXPECTED_README.replace("## Overview\n\n", "").replace("| Authors | A, B |\n", "").replace("| Technology | File |\n|------------|------|", "| Technology | File |")
    lines = ["|" + "------|" * (x.count("|") - 1) if re.fullmatch(r"\|[-|]+\|", x) else re.sub(r"\| (Node\.js|main\.py|index\.js) (?=\|)", r"| `\1` ", x) for x in text.split("\n")]
    return "\n".join(lines) + "\n"


def _enhanced_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comments section as plain text after a model that marks it up."""
    s = sections(files(spark, sf_dir)).filter("section = 'comments'").select("repo_id", F.col("text").alias("report"))
    return enhance.enhanced(s, lambda p: "### **" + p.split("\n\n", 1)[1].split("\n")[-1] + "**\n\n| a |\n---\n[x](y) `z`", "txt")


#: Markdown as models write it, and what the repair makes of it; (answer, original, repaired).
BROKEN = (
    ("# T<<p_partkey>>\n| Name | Async ---\nstray\n| a<<p_partkey>>.py |  TRUE |\n\nBye.", "# T<<p_partkey>>\nx", "# T<<p_partkey>>\n| Name | Async |\n|------|------|\n| `a<<p_partkey>>.py` | yes |\n"),
    ("## Exports — all\n| N | K |\n|:--:|--|\n| a<<p_partkey>> | b |\n| a<<p_partkey>> | b |\n", "### Exports\ny", "### Exports\n| N | K |\n|------|------|\n| a<<p_partkey>> | b |\n"),
    ("# A\n| Purpose — why | B |\n|---|---|\n| f<<p_partkey>> — does |\n| q  r — s | t-- |\ntext```\nmore", "# A", "# A\n| Purpose | B |\n|------|------|\n| f<<p_partkey>> | does |\n| q r: s | t |\n"),
    ("# A\nthin\n# Gone<<p_partkey>>\n| x |\n# `B`\n| o |\n|--|\n| p |\n", "# a\none <<p_partkey>>\ntwo\n## B\n", "# A\none <<p_partkey>>\ntwo\n## `B`\n| o |\n|------|\n| p |\n"),
    ("# Project Structure\n```\nwrong\n```\n# C\n- a\n- b\n\n\n\n- c\n```\ncode <<p_partkey>>\n", "# Project Structure\n```\ntree <<p_partkey>>\n```\n# C", "# Project Structure\n```\ntree <<p_partkey>>\n```\n# C\n- a\n- b\n\n- c\n"),
)


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey")
    pick = lambda k: F.element_at(F.array(*[spark_text(x[k]) for x in BROKEN]), (F.col("p_partkey") % len(BROKEN) + 1).cast("int"))
    repair = F.pandas_udf(lambda a, o: pd.Series([mdpost.post_process(x, y) for x, y in zip(a, o)]), "string")
    return parts.select("p_partkey", repair(pick(0), pick(1)).alias("repaired"))


def queries():
    return {
        "report_sections": lambda s, d: sections(files(s, d)),
        "readme": _report("readme"),
        "module_texts": _report("modules"),
        "readme_enhanced": _enhanced,
        "text_enhanced": _enhanced_text,
        "markdown_repair": _broken,
    }


def oracle_sql():
    readme = f"SELECT {sql_text(REPO)} AS repo_id, {_expected(EXPECTED_README)} AS plain, {_expected(repaired_readme())} AS fixed, {KEY} FROM {_ROWS}"
    return {
        "report_sections": _rows("section", EXPECTED_SECTIONS),
        "readme": f"SELECT repo_id, plain AS report FROM ({readme})",
        "readme_enhanced": f"SELECT repo_id, CASE WHEN {KEY} IN (1, 2) THEN plain ELSE fixed END AS report FROM ({readme})",
        "module_texts": _rows("name", EXPECTED_MODULES, "content"),
        "text_enhanced": f"SELECT {sql_text(REPO)} AS repo_id, 'db/schema.sql:L1 single-line: note ' || {KEY} || chr(10) || 'x z' AS report FROM supplier",
        "markdown_repair": f"SELECT p_partkey, ([{', '.join(sql_text(x[2]) for x in BROKEN)}])[p_partkey % {len(BROKEN)} + 1] AS repaired FROM part",
    }

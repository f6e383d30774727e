"""Registered queries against their DuckDB oracles on the smallest tables, and the API end to end."""

import duckdb
import pytest

from codestrata import api
from codestrata.functions import mdpost
from codestrata.operators import enhance, parse, structure
from codestrata.plans import catalogue
from codestrata.sources import repositories

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["facts_python", "facts_javascript", "facts_sql_ddl", "facts_sql_dml", "facts_cargo_toml", "html_stats", "file_types", "tree_lines", "technologies", "entry_points", "modules", "file_purpose", "size_guard", "sql_dialect", "project_stats", "parse_errors", "markdown_clean", "facts_sql_fallback", "facts_python_awkward", "facts_javascript_awkward", "report_sections", "readme", "module_texts", "readme_enhanced", "text_enhanced", "markdown_repair", "valid_inputs", "sql_functions"])
def test_against_oracle(spark, sf, con, name):
    df = catalogue.queries()[name](spark, sf)
    cols = sorted(df.columns)
    res = con.execute(catalogue.oracle_sql()[name])
    at = {d[0]: i for i, d in enumerate(res.description)}
    assert sorted(at) == cols
    want = sorted(str([r[at[c]] for c in cols]) for r in res.fetchall())
    assert sorted(str([r[c] for c in cols]) for r in df.collect()) == want


def test_every_query_has_an_oracle():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


def test_analyze(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/x.js").write_text("x")
    (tmp_path / "src/index.js").write_text('import e from "express"; app.get("/h", f); export function f(a){}')
    (tmp_path / "src/bad.js").write_text("function ( {")
    (tmp_path / "t.sql").write_text("CREATE TABLE t (id INT);")
    text = api.analyze(spark, str(tmp_path))
    assert "Files analyzed: 2" in text and "GET   /h" in text and "(none)" in text and "node_modules" not in text
    docs = api.analyze(spark, str(tmp_path), "md", out=str(tmp_path / "out"))
    assert "## Project Structure" in docs["readme"] and docs["modules"][0][1].startswith("# Module: src")
    assert (tmp_path / "out/docs/src.md").exists()


def test_refused_inputs(spark):
    with pytest.raises(repositories.InputError):
        api.analyze(spark, "/etc")
    assert not api.sensitive("/etcetera/x")


def test_zip(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        z.writestr("a/test.txt", "Hello World")
        z.writestr("node_modules/b.js", "x")
    rows = repositories.from_archives(spark, str(tmp_path / "p.zip")).collect()
    assert [(r["repo_id"], r["path"], r["content"]) for r in rows] == [("p", "a/test.txt", "Hello World")]
    with pytest.raises(repositories.InputError, match="cannot extract"):
        repositories.from_archives(spark, "/nonexistent/path.zip")


def test_limits_before_texts(spark, tmp_path, monkeypatch):
    """A directory or an archive over the limits is refused before its texts are read."""
    import zipfile

    for i in range(4):
        (tmp_path / f"f{i}.js").write_text("x" * 50)
    with zipfile.ZipFile(tmp_path / "z.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.js", "x" * 10_000)
    monkeypatch.setattr(repositories, "_text_of", lambda p: pytest.fail("read"))
    monkeypatch.setattr(repositories.rules, "MAX_FILES", 3)
    with pytest.raises(repositories.InputError, match="files are over"):
        repositories.from_directory(spark, str(tmp_path))
    monkeypatch.setattr(repositories.rules, "MAX_TOTAL_BYTES", 100)
    with pytest.raises(repositories.InputError, match="MB is over"):
        repositories.admitted([("a", 101)], "r")
    with zipfile.ZipFile(tmp_path / "z.zip") as z, pytest.raises(repositories.InputError):
        repositories.admitted([(m.filename, m.file_size) for m in repositories._members(z)], "z")


def test_inputs_and_saved_report(spark, tmp_path):
    for bad in ("", "  ", None):
        with pytest.raises(repositories.InputError):
            api.validated(bad)
    assert api.validated(" https://h/r ") == "https://h/r"
    (tmp_path / "a.py").write_text("import os")
    text = api.analyze(spark, str(tmp_path), out=str(tmp_path / "out"))
    assert (tmp_path / "out/analysis.txt").read_text() == text
    rows = repositories.from_driver(spark, str(tmp_path), "r").collect()
    assert {r["path"] for r in rows} == {"a.py", "out/analysis.txt"}


def test_stream(spark, tmp_path):
    from codestrata.streaming import watch

    spark.createDataFrame([("r", "a.py", "import os\ndef f(): pass"), ("r", "b.js", "f(")], "repo_id string, path string, content string").write.parquet(str(tmp_path / "in"))
    stream = watch.parsed_stream(spark, str(tmp_path / "in"))
    watch.running_stats(stream, str(tmp_path / "cp"), str(tmp_path / "out")).awaitTermination()
    row = watch.latest_stats(spark, str(tmp_path / "out")).first()
    assert (row["files"], row["n_imports"], row["n_functions"]) == (1, 1, 1)


def test_enhancement_falls_back(spark):
    def broken(_):
        raise RuntimeError("down")

    df = spark.createDataFrame([("r", "## A\n\n| x |\n|---|\n| 1 |")], "repo_id string, report string")
    assert enhance.enhanced(df, broken).first()["report"] == df.first()["report"]
    assert enhance.enhanced(df, lambda p: "**bold** `c`").first()["report"] == "bold c"


def test_table_repair():
    fixed = mdpost.post_process("## Exports\n| Name | File |\n|--|--|\n| a | x.js |\n| a | x.js |\nbye", "## Exports\n\n| Name | File |\n|---|---|\n| a | x.js |\n| b | y.js |\n")
    assert fixed.count("`x.js`") <= 2 and "bye" not in fixed and fixed.endswith("\n")


def test_null_content_and_empty_table(spark):
    files = spark.createDataFrame([("r", "a.js", None), ("r", "b.css", None)], "repo_id string, path string, content string")
    assert parse.parse_files(files).filter("error IS NULL").count() == 2
    assert structure.technologies(files.limit(0).withColumn("size", __import__("pyspark").sql.functions.lit(0))).count() == 0

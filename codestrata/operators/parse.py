"""The parse stage: files(repo_id, path, content) -> file records, and facts from records.

HTML and CSS stay column expressions. All other types go through one Arrow pass that hands
each text to its parser and returns JSON, typed by from_json on the JVM. A text that its
parser rejects gives an error row and harms no other.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata import schemas
from codestrata.functions import markup as M
from codestrata.functions import paths as P
from codestrata.operators import factrows
from codestrata.parsers import registry
from codestrata.parsers.apart import LEAVES, Apart

NATIVE = ("markup", "stylesheet")


def _each_batch(parsers: dict, made, build):
    """A map over batches: ``made(records and errors)`` of a batch's texts, where their parsers may leave things behind in a process beside
    this one, then ``build(batch, made)``."""

    def work(kinds: list, contents: list):
        return made(_records(parsers, kinds, contents))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart = Apart(work)
        try:
            for batch in batches:
                kinds, contents = batch.column("type").to_pylist(), batch.column("content").to_pylist()
                leaves = not LEAVES.isdisjoint(kinds)
                yield build(batch, apart(sum(len(c or "") for c in contents), kinds, contents) if leaves else work(kinds, contents))
        finally:
            apart.close()

    return run


def _records(parsers: dict, kinds: list, contents: list) -> Iterator[tuple[dict | None, str | None]]:
    for kind, content in zip(kinds, contents):
        try:
            yield parsers[kind](content or "") if kind in parsers else {}, None
        except Exception as e:  # one file's failure is that file's error, whatever it is
            yield None, f"{type(e).__name__}: {e}"[:500]


def _parse_batches(parsers: dict):
    def made(records):
        facts, errors = [], []
        for record, error in records:
            try:
                facts.append(None if record is None else json.dumps(record, ensure_ascii=False))
            except Exception as e:
                facts.append(None)
                error = f"{type(e).__name__}: {e}"[:500]
            errors.append(error)
        return facts, errors

    def build(batch, found):
        return pa.RecordBatch.from_arrays([batch.column("repo_id"), batch.column("path"), batch.column("type"), pa.array(found[0], pa.string()), pa.array(found[1], pa.string())], names=["repo_id", "path", "type", "json", "error"])

    return _each_batch(parsers, made, build)


def _native(files: DataFrame) -> DataFrame:
    text, html = F.coalesce(F.col("content"), F.lit("")), F.col("type") == "markup"
    source = F.when(html, M.html_imports(text)).otherwise(M.css_imports(text))
    kind = F.when(html, "html").otherwise("css")
    imports = F.transform(source, lambda x: F.struct(kind.alias("type"), x.alias("source")))
    title = F.transform(M.html_titles(text), lambda x: F.struct(x.alias("name"), F.lit("page-title").alias("kind")))
    facts = F.struct(_as(imports, schemas.FACTS["imports"]).alias("imports"), _as(F.when(html, title).otherwise(M.css_exports(text)), schemas.FACTS["exports"]).alias("exports"))
    return files.select("repo_id", "path", "type", facts.alias("facts"), F.lit(None).cast("string").alias("error"))


def _as(array: Column, struct: str) -> Column:
    """An array of narrow structs widened with nulls."""
    names = [x.split(":")[0] for x in _fields(struct)]
    types = dict(x.split(":", 1) for x in _fields(struct))
    have = {"type", "source"} if "specifiers" in names else {"name", "kind"}
    return F.transform(array, lambda x: F.struct(*[(x[n] if n in have else F.lit(None)).cast(types[n]).alias(n) for n in names]))


def _fields(struct: str) -> list[str]:
    out, depth, at, body = [], 0, 0, struct[len("struct<") : -1]
    for i, c in enumerate(body):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(body[at:i])
            at = i + 1
    return [*out, body[at:]]


def _parseable(files: DataFrame) -> DataFrame:
    """Both the prune and the type filter run before any text meets Python."""
    return files.filter(~P.is_pruned(F.col("path"))).withColumn("type", P.file_type(F.col("path"))).filter(P.is_parseable(F.col("type")))


def _wide(d: DataFrame, present: set[str]) -> DataFrame:
    return d.select("repo_id", "path", "type", *[(F.col("facts")[k] if k in present else F.lit(None).cast(f"array<{v}>")).alias(k) for k, v in schemas.FACTS.items()], (F.col("facts")["detail"] if "detail" in present else F.lit(None).cast(schemas.DETAIL)).alias("detail"), "error")


def parse_files(files: DataFrame) -> DataFrame:
    """repo_id, path, type, facts..., detail, error for every parseable file (repo_id, path, content). Texts stay where their partitions are."""
    t = _parseable(files)
    other = t.filter(~F.col("type").isin(*NATIVE)).select("repo_id", "path", "type", "content")
    parsed = other.mapInArrow(_parse_batches(dict(registry.PARSERS)), "repo_id string, path string, type string, json string, error string")
    parsed = parsed.select("repo_id", "path", "type", F.from_json("json", schemas.RECORD).alias("facts"), "error")
    native = _native(t.filter(F.col("type").isin(*NATIVE)))
    return _wide(parsed, {*schemas.FACTS, "detail"}).unionByName(_wide(native, {"imports", "exports"}))


def records(parsed: DataFrame) -> DataFrame:
    return parsed.filter("error IS NULL").drop("error")


def parse_errors(parsed: DataFrame) -> DataFrame:
    return parsed.filter("error IS NOT NULL").select("repo_id", "path", "type", "error")


def facts(parsed: DataFrame, kind: str) -> DataFrame:
    """A row for each fact of a kind: repo_id, file_path, ord and the fact's fields."""
    return parsed.select("repo_id", F.col("path").alias("file_path"), F.posexplode(kind).alias("ord", "f")).select("repo_id", "file_path", "ord", "f.*")


def methods(parsed: DataFrame) -> DataFrame:
    c = parsed.select("repo_id", F.col("path").alias("file_path"), F.explode("classes").alias("c"))
    return c.select("repo_id", "file_path", F.col("c.name").alias("class"), F.posexplode("c.methods").alias("ord", "m")).select("repo_id", "file_path", "class", "ord", "m.*")


def details(parsed: DataFrame, field: str) -> DataFrame:
    """A row for each element of a list in `detail`."""
    return parsed.select("repo_id", F.col("path").alias("file_path"), F.posexplode(F.col("detail")[field]).alias("ord", "f")).select("repo_id", "file_path", "ord", "f.*")


def _row_batches(parsers: dict):
    def made(records):
        at, kinds, names, extras = [], [], [], []
        for i, (record, _) in enumerate(records):
            for kind, name, extra in factrows.rows(record) if record else ():
                at.append(i)
                kinds.append(kind)
                names.append(name)
                extras.append(extra)
        return at, kinds, names, extras

    def build(batch, found):
        at = pa.array(found[0], pa.int32())
        return pa.RecordBatch.from_arrays([batch.column("repo_id").take(at), batch.column("path").take(at), *[pa.array(x, pa.string()) for x in found[1:]]], names=["repo_id", "file_path", "kind", "name", "extra"])

    return _each_batch(parsers, made, build)


def facts_of(files: DataFrame) -> DataFrame:
    """``fact_table(records(parse_files(files)))``, its rows made where the texts are parsed: no record is written as JSON and typed again."""
    t = _parseable(files)
    other = t.filter(~F.col("type").isin(*NATIVE)).select("repo_id", "path", "type", "content")
    rows = other.mapInArrow(_row_batches(dict(registry.PARSERS)), "repo_id string, file_path string, kind string, name string, extra string")
    return rows.unionByName(fact_table(_wide(_native(t.filter(F.col("type").isin(*NATIVE))), {"imports", "exports"})))


def fact_table(parsed: DataFrame) -> DataFrame:
    """All facts as rows (repo_id, file_path, kind, name, extra): one pass, one explode."""
    text = F.array().cast("array<struct<kind:string,name:string,extra:string>>")
    commas = lambda a: F.coalesce(F.array_join(a, ",", "null"), F.lit(""))
    nil = lambda c: F.coalesce(c, F.lit(""))

    def rows(array: Column, kind: str, name, extra) -> Column:
        return F.coalesce(F.transform(array, lambda x: F.struct(F.lit(kind).alias("kind"), nil(name(x)).alias("name"), nil(extra(x)).alias("extra"))), text)

    def inner(array: Column, fn) -> Column:
        return F.coalesce(F.flatten(F.transform(array, fn)), text)

    cols = lambda t: F.array_join(F.transform(t["columns"], lambda c: F.concat(c["name"], F.lit(" "), c["type"], F.when(c["nullable"], "").otherwise(" not null"))), ",")
    par = lambda ps: F.array_join(F.transform(ps, lambda p: F.concat_ws(" ", p["mode"], p["name"], p["type"])), ",")
    d = F.col("detail")
    pairs = lambda f, kind: rows(d[f], kind, lambda x: x["key"], lambda x: x["value"])
    parts = [
        rows(F.col("imports"), "import", lambda x: F.coalesce(x["source"], x["spec"]), lambda x: x["alias"]),
        rows(F.col("exports"), "export", lambda x: x["name"], lambda x: x["kind"]),
        rows(F.col("functions"), "function", lambda x: x["name"], lambda x: commas(x["params"])),
        rows(F.col("classes"), "class", lambda x: x["name"], lambda x: x["extends"]),
        inner(F.col("classes"), lambda c: rows(c["methods"], "method", lambda m: m["name"], lambda m: F.concat(c["name"], F.lit(":"), commas(m["params"])))),
        inner(F.col("classes"), lambda c: F.coalesce(F.transform(c["fields"], lambda f: F.struct(F.lit("field").alias("kind"), f.alias("name"), c["name"].alias("extra"))), text)),
        inner(F.col("classes"), lambda c: rows(c["constants"], "constant", lambda k: k["name"], lambda k: k["value"])),
        rows(F.col("routes"), "route", lambda x: x["path"], lambda x: x["method"]),
        rows(F.col("tables"), "table", lambda x: x["name"], cols),
        inner(F.col("tables"), lambda t: rows(t["primaryKey"], "primary key", lambda k: t["name"], lambda k: commas(k["definition"]))),
        inner(F.col("tables"), lambda t: rows(t["foreignKeys"], "foreign key", lambda k: t["name"], lambda k: F.concat(commas(k["definition"]), F.lit("->"), k["reference"]["table"], F.lit("("), commas(k["reference"]["columns"]), F.lit(")"), F.coalesce(F.concat(F.lit(" on delete "), k["reference"]["onDelete"]), F.lit(""))))),
        inner(F.col("tables"), lambda t: rows(t["uniqueConstraints"], "unique", lambda k: t["name"], lambda k: commas(k["definition"]))),
        rows(F.col("views"), "view", lambda x: x["name"], lambda x: x["select"]),
        rows(F.col("indexes"), "index", lambda x: x["name"], lambda x: F.concat(x["table"], F.lit("("), commas(x["columns"]), F.lit(")"))),
        rows(F.col("storedProcedures"), "procedure", lambda x: x["name"], lambda x: par(x["params"])),
        rows(F.filter("functions", lambda f: f["routineParams"].isNotNull()), "routine", lambda x: x["name"], lambda x: F.concat(par(x["routineParams"]), F.coalesce(F.concat(F.lit(" -> "), x["returnType"]), F.lit("")))),
        rows(F.col("triggers"), "trigger", lambda x: x["name"], lambda x: F.concat_ws(" ", x["timing"], x["event"], x["table"])),
        rows(F.col("databases"), "database", lambda x: x["name"], lambda x: F.lit("")),
        rows(F.col("inserts"), "insert", lambda x: x["table"], lambda x: commas(x["columns"])),
        rows(F.col("updates"), "update", lambda x: x["table"], lambda x: F.array_join(F.transform(x["set"], lambda s: F.concat_ws("=", s["column"], s["value"])), ",")),
        rows(F.col("deletes"), "delete", lambda x: commas(x["from"]), lambda x: x["where"]),
        rows(F.col("selects"), "select", lambda x: commas(x["from"]), lambda x: F.concat(F.array_join(F.transform(x["columns"], lambda c: F.concat_ws(" as ", c["column"], c["alias"])), ","), F.coalesce(F.concat(F.lit(" limit "), x["limit"]), F.lit("")))),
        inner(F.col("alterTables"), lambda a: rows(a["operations"], "alter", lambda o: a["table"], lambda o: F.concat_ws(" ", o["action"], o["resource"], o["column"], o["constraint"], o["newName"]))),
        rows(F.col("drops"), "drop", lambda x: commas(x["names"]), lambda x: x["keyword"]),
        rows(F.col("comments"), "comment", lambda x: x["content"], lambda x: F.concat_ws(":", x["type"], x["line"].cast("string"))),
        rows(d["projects"], "project", lambda x: x["name"], lambda x: F.concat_ws(" ", x["path"], x["type"])),
        rows(d["packages"], "package", lambda x: x["name"], lambda x: x["version"]),
        rows(d["connectionStrings"], "connection", lambda x: x["name"], lambda x: x["connectionString"]),
        pairs("appSettings", "setting"),
        rows(d["uiComponents"], "component", lambda x: x["name"], lambda x: F.concat_ws("<", x["type"], x["parentType"])),
        inner(d["sections"], lambda s: rows(s["keys"], "key", lambda k: F.concat_ws(".", s["name"], k["key"]), lambda k: k["value"])),
        rows(d["dependencies"]["normal"], "dependency", lambda x: x["name"], lambda x: x["version"]),
        rows(d["dependencies"]["dev"], "dev-dependency", lambda x: x["name"], lambda x: x["version"]),
        rows(d["dependencies"]["build"], "build-dependency", lambda x: x["name"], lambda x: x["version"]),
        rows(d["features"], "feature", lambda x: x["key"], lambda x: commas(x["value"])),
        rows(d["lockPackages"], "locked", lambda x: x["name"], lambda x: x["version"]),
        pairs("registries", "registry"),
        pairs("aliases", "alias"),
        rows(F.filter(F.array(d), lambda x: x["rootPackage"].isNotNull()), "root", lambda x: x["rootPackage"], lambda x: F.lit("")),
        rows(F.filter(F.array(d), lambda x: x["channel"].isNotNull()), "toolchain", lambda x: x["channel"], lambda x: commas(x["components"])),
        rows(F.filter(F.array(d), lambda x: x["framework"].isNotNull()), "framework", lambda x: x["framework"], lambda x: x["sdk"]),
    ]
    return parsed.select("repo_id", F.col("path").alias("file_path"), F.explode(F.concat(*parts)).alias("f")).select("repo_id", "file_path", "f.*")


COUNTED = ("imports", "exports", "functions", "classes", "routes", "tables", "views", "indexes", "storedProcedures", "triggers", "databases", "inserts", "updates", "deletes", "selects", "alterTables", "drops", "comments")


def _count_batches(parsers: dict):
    def made(records):
        return [None if record is None else tuple(len(record.get(k) or ()) for k in COUNTED) for record, _ in records]

    def build(batch, found):
        repos = [r for r, n in zip(batch.column("repo_id").to_pylist(), found) if n is not None]
        columns = list(zip(*(n for n in found if n is not None))) or [()] * len(COUNTED)
        return pa.RecordBatch.from_arrays([pa.array(repos, pa.string()), *[pa.array(c, pa.int64()) for c in columns]], names=["repo_id", *COUNTED])

    return _each_batch(parsers, made, build)


def fact_counts(files: DataFrame) -> DataFrame:
    """repo_id and the number of facts of each kind, a row for each file that parses: what the statistics need, without the facts."""
    t = _parseable(files)
    other = t.filter(~F.col("type").isin(*NATIVE)).select("repo_id", "type", "content")
    counted = other.mapInArrow(_count_batches(dict(registry.PARSERS)), "repo_id string, " + ", ".join(f"{k} long" for k in COUNTED))
    facts = _native(t.filter(F.col("type").isin(*NATIVE)))
    native = facts.select("repo_id", *[(F.size(F.col("facts")[k]).cast("long") if k in ("imports", "exports") else F.lit(0).cast("long")).alias(k) for k in COUNTED])
    return counted.unionByName(native)


def stats_of_counts(counts: DataFrame) -> DataFrame:
    """project_stats from fact_counts."""
    return counts.groupBy("repo_id").agg(F.count("*").alias("files"), *[F.coalesce(F.sum(k), F.lit(0)).alias(f"n_{k}") for k in COUNTED])


def project_stats(parsed: DataFrame) -> DataFrame:
    """repo_id, files and the number of facts of each kind, in one aggregate."""
    n = lambda k: F.sum(F.coalesce(F.size(k), F.lit(0)).cast("long"))
    return parsed.groupBy("repo_id").agg(F.count("*").alias("files"), *[F.coalesce(n(k), F.lit(0)).alias(f"n_{k}") for k in COUNTED])


def in_order(parsed: DataFrame) -> DataFrame:
    """With `file_ord`: depth-first path order, Python files last. It is a sort key of the row itself, so nothing is gathered to number files."""
    return parsed.withColumn("file_ord", F.struct((F.col("type") == "python").alias("last"), P.segments(F.col("path")).alias("segs")))


def is_empty_record() -> Column:
    return F.forall(F.array(*[F.coalesce(F.size(k), F.lit(0)) for k in schemas.FACTS]), lambda n: n == 0) & (F.col("detail").isNull())

"""Reports: every section is an ordered aggregate of lines, one string a repository.

Sections read the parsed records once (cache them before rendering several). Lines are
ordered by (file_ord, ord). A text is one string a repository, so its lines meet in one task;
what is analysed by path is within the admission limits, tables of files are as large as
their largest repository.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata import rules
from codestrata.functions import paths as P
from codestrata.operators import parse, structure

ARROW = " → "


def _text(*parts) -> Column:
    return F.concat(*[F.coalesce(p, F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts])


def _opt(prefix: str, value: Column, suffix: str = "") -> Column:
    return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(prefix), value, F.lit(suffix))).otherwise("")


def _flag(value: Column, text: str) -> Column:
    return F.when(F.coalesce(value, F.lit(False)), text).otherwise("")


def _join(array: Column, sep: str, fn=None) -> Column:
    """Null elements become empty, as they keep their separators."""
    return F.array_join(F.transform(array, fn) if fn else array, sep, "")


def _has(array: Column) -> Column:
    return F.coalesce(F.size(array), F.lit(0)) > 0


def _section(blocks: DataFrame, repos: DataFrame, title: str, sep: str = "\n\n", empty: str | None = "(none)") -> DataFrame:
    """repo_id, text from rows (repo_id, a, b, line) in order of a, b."""
    rows = F.array_sort(F.collect_list(F.struct("a", "b", "line")))
    body = blocks.groupBy("repo_id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), sep).alias("body"))
    head = f"{title}\n{'=' * len(title)}"
    out = repos.join(body, "repo_id", "left")
    text = F.when(F.col("body").isNotNull(), F.concat(F.lit(head + sep), F.col("body")))
    return out.select("repo_id", (text if empty is None else text.otherwise(f"{head}\n\n  {empty}")).alias("text"))


def _each(p: DataFrame, kind: str) -> DataFrame:
    return p.filter(_has(F.col(kind))).select("repo_id", "path", "file_ord", F.posexplode(kind).alias("i", "f"))


def _by_file(p: DataFrame, kind: str, body: Column) -> DataFrame:
    return p.filter(_has(F.col(kind))).select("repo_id", F.col("file_ord").alias("a"), F.lit(0).alias("b"), body.alias("line"))


def _by_fact(p: DataFrame, kind: str, line) -> DataFrame:
    e = _each(p, kind)
    return e.select("repo_id", F.col("file_ord").alias("a"), F.col("i").alias("b"), line(F.col("f"), F.col("path")).alias("line"))


def import_name(i: Column) -> Column:
    return F.coalesce(i["source"], i["spec"], F.lit(""))


def _columns(s: Column) -> Column:
    return _join(s, ", ", lambda c: F.when(c["alias"].isNotNull(), F.concat_ws(" AS ", c["column"], c["alias"])).otherwise(c["column"]))


def _params(ps: Column) -> Column:
    return _join(ps, ", ", lambda p: F.concat_ws(" ", p["mode"], p["name"], p["type"]))


def _key(c: Column) -> Column:
    return _join(c, "; ", lambda k: _join(k["definition"], ", "))


def _drop(d: Column) -> Column:
    return F.concat_ws(" ", d["keyword"], _join(d["names"], ", "))


def _alter(a: Column, what) -> Column:
    return _text(a["table"], ": ", _join(a["operations"], ", ", lambda o: _text(F.concat_ws(" ", o["action"], o["resource"]), *what(o), _opt(ARROW, o["newName"]))))


def overview(files: DataFrame) -> DataFrame:
    tech = structure.technologies(files).groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct("ord", "technology"))).alias("t"))
    order = structure.technologies(files)
    entries = structure.entry_points(files).filter("path IS NOT NULL").join(order, ["repo_id", "technology"])
    rows = entries.groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct("ord", P.segments(F.col("path")).alias("segs"), _text("  ", F.col("technology"), ARROW, F.col("path")).alias("line")))).alias("e"))
    techs = _text("Technologies: ", _join(F.transform("t", lambda x: x["technology"]), ", "))
    line = F.concat(F.lit("\nEntry points:\n"), _join(F.transform("e", lambda x: x["line"]), "\n"))
    return files.select("repo_id").distinct().join(tech, "repo_id", "left").join(rows, "repo_id", "left").select("repo_id", _text("PROJECT OVERVIEW\n================", F.when(F.col("t").isNotNull(), F.concat(F.lit("\n"), techs)), F.when(F.col("e").isNotNull(), line)).alias("text"))


# The labels of the statistics, in order.
LABELS = ("imports", "exports", "functions", "classes", "routes", "tables", "views", "indexes", "stored procedures", "triggers", "databases", "inserts", "updates", "deletes", "selects", "alter tables", "drops", "comments")


def statistics(p: DataFrame) -> DataFrame:
    s = parse.project_stats(p)
    lines = [_text("Files analyzed: ", F.col("files").cast("string"))] + [_text(f"Total {label}: ", F.col(f"n_{k}").cast("string")) for label, k in zip(LABELS, parse.COUNTED)]
    return s.select("repo_id", F.concat_ws("\n", F.lit("PROJECT STATISTICS\n=================="), *lines).alias("text"))


def file_lines() -> Column:
    """The block of a file: a line for each kind of fact it has."""
    fk = lambda t: F.when(_has(t["foreignKeys"]), _text(" FK: [", _join(t["foreignKeys"], "; ", lambda k: _text(_join(k["definition"], ","), ARROW, k["reference"]["table"], "(", _join(k["reference"]["columns"], ","), ")")), "]")).otherwise("")
    ops = lambda o: (_opt(" ", o["column"]), _opt(" ", o["constraint"]))
    labels = [
        ("Imports", "imports", _join(F.col("imports"), ", ", import_name)),
        ("Exports", "exports", _join(F.col("exports"), ", ", lambda e: _text(e["name"], " (", e["kind"], ")"))),
        ("Functions", "functions", _join(F.col("functions"), ", ", lambda f: _text(f["name"], " (", F.coalesce(f["kind"], F.lit("function")), ")", _flag(f["async"], " async")))),
        ("Classes", "classes", _join(F.col("classes"), ", ", lambda c: _text(c["name"], _opt(" extends ", c["extends"])))),
        ("Routes", "routes", _join(F.col("routes"), ", ", lambda r: F.concat_ws(" ", r["method"], r["path"]))),
        ("Tables", "tables", _join(F.col("tables"), "; ", lambda t: _text(t["name"], "(", _join(t["columns"], ", ", lambda c: c["name"]), ")", fk(t)))),
        ("Views", "views", _join(F.col("views"), ", ", lambda v: v["name"])),
        ("Indexes", "indexes", _join(F.col("indexes"), "; ", lambda i: _text(i["name"], " ON ", i["table"], "(", _join(i["columns"], ", "), ")"))),
        ("Procedures", "storedProcedures", _join(F.col("storedProcedures"), "; ", lambda r: _text(r["name"], "(", _params(r["params"]), ")"))),
        ("Triggers", "triggers", _join(F.col("triggers"), "; ", lambda t: _text(t["name"], " (", F.concat_ws(" ", t["timing"], t["event"], F.lit("ON"), t["table"]), ")"))),
        ("Databases", "databases", _join(F.col("databases"), ", ", lambda d: d["name"])),
        ("Inserts", "inserts", _join(F.col("inserts"), "; ", lambda i: _text("INTO ", i["table"], F.when(_has(i["columns"]), _text("(", _join(i["columns"], ", "), ")"))))),
        ("Updates", "updates", _join(F.col("updates"), "; ", lambda u: _text("UPDATE ", u["table"], " SET ", _join(u["set"], ", ", lambda s: _text(s["column"], " = ", s["value"]))))),
        ("Deletes", "deletes", _join(F.col("deletes"), "; ", lambda d: _text("FROM ", _join(d["from"], ", ")))),
        ("Selects", "selects", _join(F.col("selects"), "; ", lambda s: _text("SELECT ", _columns(s["columns"]), " FROM ", _join(s["from"], ", ")))),
        ("Alter Tables", "alterTables", _join(F.col("alterTables"), "; ", lambda a: _alter(a, ops))),
        ("Drops", "drops", _join(F.col("drops"), "; ", _drop)),
        ("Comments", "comments", _join(F.col("comments"), " | ", lambda c: _text("L", c["line"].cast("string"), " ", c["type"], ": ", c["content"]))),
    ]
    lines = [F.when(_has(F.col(k)), F.concat(F.lit(f"{label}: "), v)) for label, k, v in labels]
    head = _text("-- ", P.basename(F.col("path")), " (", F.col("type"), ") --")
    return F.when(parse.is_empty_record(), F.concat(head, F.lit("\n" + rules.EMPTY_NOTE))).otherwise(F.concat_ws("\n", head, *lines))


def file_blocks(p: DataFrame) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("file_ord", file_lines().alias("line"))))
    return p.groupBy("repo_id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n\n").alias("text"))


def route_lines(p: DataFrame) -> DataFrame:
    """repo_id, a, b, line."""
    e = _each(p, "routes").filter("f.method <> '' AND f.path <> ''")
    r = F.col("f")
    line = _text(P.pad(r["method"], 6), P.pad(r["path"], 25), ARROW, F.col("path"), ":", F.coalesce(r["line"].cast("string"), F.lit("")))
    return e.select("repo_id", F.col("file_ord").alias("a"), F.col("i").alias("b"), line.alias("line"))


def table_block(t: Column, path: Column) -> Column:
    col = lambda c: _text("  ", F.concat_ws(" ", c["name"], c["type"]), _opt("(", c["length"], ")"), _flag(c["primary"], " PK"), _flag(c["autoIncrement"], " AUTO_INCREMENT"), _flag(~c["nullable"], " NOT NULL"), _opt(" DEFAULT ", c["default"]), _flag(c["unique"], " UNIQUE"), _opt(" -- ", c["comment"]))
    fk = lambda k: _text("\n  FK ", k["constraint"], ": ", _join(k["definition"], ", "), ARROW, k["reference"]["table"], "(", _join(k["reference"]["columns"], ", "), ")", _opt(" ON DELETE ", k["reference"]["onDelete"]), _opt(" ON UPDATE ", k["reference"]["onUpdate"]))
    extras = F.concat_ws(
        " | ",
        F.when(_has(t["primaryKey"]), _text("PK: ", _key(t["primaryKey"]))),
        F.when(_has(t["uniqueConstraints"]), _text("UNIQUE: ", _key(t["uniqueConstraints"]))),
        F.when(_has(t["check"]), _text("CHECK: ", _key(t["check"]))),
        F.when(_has(t["indexes"]), _text("INDEXES: ", _join(t["indexes"], "; ", lambda i: _text(i["name"], " (", _join(i["definition"], ", "), ")", _opt(" ", i["type"]))))),
    )
    return _text(path, "\n  ", t["name"], _flag(t["ifNotExists"], " IF NOT EXISTS"), "\n", _join(t["columns"], "\n", col), _join(t["foreignKeys"], "", fk), F.when(extras != "", F.concat(F.lit("\n  ["), extras, F.lit("]"))))


def routine_block() -> Column:
    f = F.transform(F.filter("functions", lambda f: F.coalesce(f["kind"] != "procedure", F.lit(True))), lambda f: _text("FUNCTION ", f["name"], "(", F.when(f["routineParams"].isNotNull(), _params(f["routineParams"])).otherwise(_join(f["params"], ", ")), ")", _opt(ARROW, f["returnType"])))
    p = F.transform("storedProcedures", lambda r: _text("PROCEDURE ", r["name"], "(", _params(r["params"]), ")"))
    none = F.array().cast("array<string>")
    return F.array_join(F.concat(F.coalesce(f, none), F.coalesce(p, none)), "\n  ")


def dml_block() -> Column:
    part = lambda title, kind, fn: F.when(_has(F.col(kind)), F.concat(F.lit(title + ":\n  "), _join(F.col(kind), "\n  ", fn)))
    return F.concat_ws(
        "\n  ",
        part("INSERT", "inserts", lambda i: _text("  INTO ", i["table"], F.when(_has(i["columns"]), _text("(", _join(i["columns"], ", "), ")")))),
        part("UPDATE", "updates", lambda u: _text("  ", u["table"], " SET ", _join(u["set"], ", ", lambda s: _text(s["column"], " = ", s["value"])))),
        part("DELETE", "deletes", lambda d: _text("  FROM ", _join(d["from"], ", "))),
        part("SELECT", "selects", lambda s: _text("  SELECT ", _columns(s["columns"]), " FROM ", _join(s["from"], ", "))),
    )


def text_sections(files: DataFrame, parsed: DataFrame) -> list[DataFrame]:
    p = parse.in_order(parse.records(parsed))
    repos = files.select("repo_id").distinct()
    on = lambda body: F.concat(F.col("path"), F.lit("\n  "), body)
    routines = p.withColumn("r", routine_block()).filter("r <> ''").select("repo_id", F.col("file_ord").alias("a"), F.lit(0).alias("b"), on(F.col("r")).alias("line"))
    dml = p.withColumn("d", dml_block()).filter("d <> ''").select("repo_id", F.col("file_ord").alias("a"), F.lit(0).alias("b"), on(F.col("d")).alias("line"))
    alter_ops = lambda o: (_opt(" ", o["column"]), _opt(" ", o["constraint"]))
    return [
        overview(files),
        statistics(p),
        file_blocks(p),
        _section(route_lines(p), repos, "API ENDPOINTS", "\n", None),
        _section(_by_file(p, "imports", F.concat(F.col("path"), F.lit("\n  imports: "), _join(F.col("imports"), ", ", import_name))), repos, "DEPENDENCY MAP", "\n\n", ""),
        _section(_by_fact(p, "alterTables", lambda a, path: F.concat(path, F.lit("\n  "), _alter(a, alter_ops))), repos, "ALTER MAP"),
        _section(_by_fact(p, "tables", table_block), repos, "TABLES"),
        _section(_by_fact(p, "views", lambda v, path: F.concat(path, F.lit("\n  "), v["name"])), repos, "VIEWS"),
        _section(_by_fact(p, "indexes", lambda i, path: _text(path, "\n  ", i["name"], " ON ", i["table"], " (", _join(i["columns"], ", "), ")", _opt(" ", i["type"]), _opt(" USING ", i["using"]))), repos, "INDEXES"),
        _section(routines, repos, "ROUTINES"),
        _section(_by_fact(p, "triggers", lambda t, path: _text(path, "\n  ", t["name"], " (", F.concat_ws(" ", t["timing"], t["event"], F.lit("ON"), t["table"]), ")")), repos, "TRIGGERS"),
        _section(dml, repos, "DML STATEMENTS"),
        _section(_by_fact(p, "drops", lambda d, path: F.concat(path, F.lit("\n  "), _drop(d))), repos, "DROPS"),
        _section(_by_fact(p, "comments", lambda c, path: _text(path, ":L", c["line"].cast("string"), " ", c["type"], ": ", c["content"])), repos, "COMMENTS", "\n"),
    ]


def stitched(sections: list[DataFrame]) -> DataFrame:
    """repo_id, report: sections that are not empty, a blank line between."""
    rows = None
    for k, s in enumerate(sections):
        s = s.filter("text IS NOT NULL AND text <> ''").select("repo_id", F.lit(k).alias("k"), "text")
        rows = s if rows is None else rows.unionByName(s)
    parts = F.array_sort(F.collect_list(F.struct("k", "text")))
    return rows.groupBy("repo_id").agg(F.array_join(F.transform(parts, lambda r: r["text"]), "\n\n").alias("report"))


def text_report(files: DataFrame, parsed: DataFrame) -> DataFrame:
    return stitched(text_sections(files, parsed))


def _grid(rows: DataFrame, title: str | None, head: tuple[str, ...]) -> DataFrame:
    """A Markdown table for each repo_id from rows (repo_id, o, cells array), under a heading if it has one."""
    lines = F.array_sort(F.collect_list(F.struct("o", F.concat(F.lit("| "), F.array_join("cells", " | ", ""), F.lit(" |")).alias("line"))))
    top = (f"## {title}\n\n" if title else "") + f"| {' | '.join(head)} |\n|{'|'.join('-' * (len(h) + 2) for h in head)}|\n"
    return rows.groupBy("repo_id").agg(F.concat(F.lit(top), F.array_join(F.transform(lines, lambda r: r["line"]), "\n")).alias("text"))


def _cells(*values) -> Column:
    return F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]).alias("cells")


def _code(v: Column) -> Column:
    return F.concat(F.lit("`"), v, F.lit("`"))


def package_json(contents: DataFrame) -> DataFrame:
    """repo_id, pkg: the root manifest, parsed."""
    kind = "struct<version:string,description:string,license:string,author:string,homepage:string,repository:struct<url:string>,dependencies:map<string,string>,devDependencies:map<string,string>>"
    return contents.filter("path = 'package.json'").select("repo_id", F.from_json("content", kind).alias("pkg"))


def markdown_readme(files: DataFrame, parsed: DataFrame, contents: DataFrame | None = None) -> DataFrame:
    """repo_id, report: the README of each repository."""
    p = parse.in_order(parse.records(parsed))
    techs = structure.technologies(files)
    tech = _grid(techs.select("repo_id", F.struct("ord").alias("o"), _cells(F.col("technology"))), "Overview", ("Technology",))
    entries = structure.entry_points(files).filter("path IS NOT NULL").join(techs, ["repo_id", "technology"])
    entry = _grid(entries.select("repo_id", F.struct("ord", "path").alias("o"), _cells(F.col("technology"), P.basename(F.col("path")))), None, ("Technology", "File"))
    cargo = p.filter("type = 'cargotoml'").groupBy("repo_id").agg(F.min_by(F.col("detail"), F.col("file_ord")).alias("d"), F.min_by(F.col("detail.package"), F.when(F.col("detail.package").isNotNull(), F.col("file_ord"))).alias("pkg"))
    info_fields = [("Version", "version"), ("Edition", "edition"), ("Description", "description"), ("License", "license"), ("Repository", "repository"), ("Rust Version", "rustVersion")]
    named = [(i, title, F.col("pkg")[k]) for i, (title, k) in enumerate(info_fields)]
    pairs = lambda xs: F.explode(F.array(*[F.struct(F.lit(i).alias("o"), F.lit(t).alias("t"), v.cast("string").alias("v")) for i, t, v in xs])).alias("x")
    info = cargo.filter("pkg IS NOT NULL").select("repo_id", pairs([*named, (9, "Authors", F.array_join(F.col("pkg.authors"), ", "))]))
    deps = None
    for i, (k, title) in enumerate((("normal", "dependencies"), ("dev", "dev-dependencies"), ("build", "build-dependencies"))):
        part = cargo.select("repo_id", F.posexplode(F.col("d.dependencies")[k]).alias("j", "x")).select("repo_id", F.struct(F.lit(i).alias("i"), "j").alias("o"), _cells(F.col("x.name"), F.when(F.coalesce(F.col("x.version"), F.lit("")) == "", "-").otherwise(F.col("x.version")), title))
        deps = part if deps is None else deps.unionByName(part)
    if contents is not None:
        pk = package_json(contents)
        fields = [(0, "Version", "version"), (1, "Description", "description"), (2, "License", "license"), (3, "Author", "author"), (4, "Homepage", "homepage")]
        js = pk.join(cargo.filter("pkg IS NOT NULL"), "repo_id", "left_anti").select("repo_id", pairs([*[(i, t, F.col("pkg")[k]) for i, t, k in fields], (5, "Repository", F.col("pkg.repository.url"))]))
        info = info.unionByName(js)
        for i, (k, title) in enumerate((("dependencies", "dependencies"), ("devDependencies", "devDependencies"))):
            part = pk.join(cargo, "repo_id", "left_anti").select("repo_id", F.posexplode(F.map_entries(F.col("pkg")[k])).alias("j", "x")).select("repo_id", F.struct(F.lit(i).alias("i"), "j").alias("o"), _cells(F.col("x.key"), F.col("x.value"), title))
            deps = deps.unionByName(part)
    info = info.filter("x.v IS NOT NULL AND x.v <> ''").select("repo_id", F.struct("x.o").alias("o"), _cells(F.col("x.t"), F.col("x.v")))
    features = cargo.select("repo_id", F.posexplode("d.features").alias("j", "x")).select("repo_id", F.struct("j").alias("o"), _cells(F.col("x.key"), F.when(_has(F.col("x.value")), F.array_join("x.value", ", ")).otherwise("-")))
    drawn = F.array_sort(F.collect_list(F.struct("ord", "line")))
    tree = structure.tree_lines(files).groupBy("repo_id").agg(F.array_join(F.transform(drawn, lambda r: r["line"]), "\n").alias("t"))
    tree = tree.select("repo_id", _text("## Project Structure\n\n```\n", P.project_name(F.col("repo_id")), "/\n", F.col("t"), "\n```").alias("text"))
    m = structure.modules(files)
    # directories in the order of readers, not of bytes
    module = m.select("repo_id", F.struct(F.collate("dir", "UNICODE").alias("dir"), F.col("dir").alias("exact")).alias("o"), _cells(_text("[", F.col("base"), "](docs/", F.col("module"), ".md)"), F.col("files").cast("string"), P.module_words(F.col("types"), True)))
    routes = _each(p, "routes").select("repo_id", F.struct("file_ord", "i").alias("o"), _cells(F.col("f.method"), F.col("f.path"), F.col("path")))
    objects = None
    for k, (title, kind, detail) in enumerate((("Table", "tables", lambda f: _text(F.coalesce(F.size(f["columns"]), F.lit(0)).cast("string"), " columns")), ("View", "views", lambda f: F.lit("")), ("Index", "indexes", lambda f: F.concat(F.lit("ON "), f["table"])))):
        part = _each(p, kind).select("repo_id", F.struct("file_ord", F.lit(k).alias("k"), "i").alias("o"), _cells(title, F.col("f.name"), detail(F.col("f"))))
        objects = part if objects is None else objects.unionByName(part)
    title = files.select("repo_id").distinct().select("repo_id", F.concat(F.lit("# "), P.project_name(F.col("repo_id"))).alias("text"))
    return stitched([
        title, tech, entry, _grid(info, "Project Info", ("Field", "Value")), _grid(deps, "Dependencies", ("Name", "Version", "Type")), _grid(features, "Features", ("Name", "Implies")), tree,
        _grid(module, "Modules", ("Module", "Files", "Description")), _grid(routes, "API Endpoints", ("Method", "Path", "File")), _grid(objects, "Database Schema", ("Type", "Name", "Details")),
    ])


def export_rows(p: DataFrame) -> DataFrame:
    """Exports without repetition of (name, kind, file), the first kept: repo_id, dir, path, file_ord, i, name, kind."""
    e = _each(p, "exports").select("repo_id", P.dirname(F.col("path")).alias("dir"), "path", "file_ord", "i", F.col("f.name").alias("name"), F.col("f.kind").alias("kind"))
    css = e.filter("kind <=> 'css-variable'")
    first = e.filter("NOT kind <=> 'css-variable'").groupBy("repo_id", "dir", "path", "name", "kind").agg(F.min(F.struct("file_ord", "i")).alias("o"))
    return first.select("repo_id", "dir", "path", "o.file_ord", "o.i", "name", "kind").unionByName(css.select("repo_id", "dir", "path", "file_ord", "i", "name", "kind"))


def module_docs(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """repo_id, name, content: a document for each module (directory)."""
    p = parse.in_order(parse.records(parsed)).withColumn("dir", P.dirname(F.col("path"))).withColumn("base", P.basename(F.col("path")))
    m = structure.modules(files.join(p.select("repo_id", "path"), ["repo_id", "path"], "left_semi")).select("repo_id", "dir", "module", "files", "types")
    key = lambda d: d.withColumn("repo_id", F.struct("repo_id", "dir"))  # noqa: E731  sections group by repository and directory
    each = lambda kind: _each(p.withColumn("repo_id", F.struct("repo_id", "dir")), kind)
    o = F.struct("file_ord", "i").alias("o")
    file = _code(P.basename(F.col("path")))
    desc = m.withColumn("w", P.module_words(F.col("types"), False)).filter("w IS NOT NULL").select("repo_id", "dir", _text("This module contains ", F.col("w"), " (", F.col("files").cast("string"), F.when(F.col("files") == 1, " file).").otherwise(" files).")).alias("text"))
    purpose = F.when(parse.is_empty_record(), rules.EMPTY_NOTE).otherwise(P.file_purpose(F.col("type"), F.col("path")))
    listing = key(p).select("repo_id", F.struct("file_ord").alias("o"), _cells(_code(F.col("base")), purpose))
    exports = key(export_rows(p))
    sections = [
        key(m).select("repo_id", F.concat(F.lit("# Module: "), F.col("module"), F.lit("\n")).alias("text")),
        key(desc).select("repo_id", "text"),
        _grid(listing, "File Structure", ("File", "Purpose")),
        _grid(each("functions").select("repo_id", o, _cells(F.col("f.name"), F.coalesce("f.kind", F.lit("function")), _flag(F.col("f.async"), "yes"), file)), "Functions", ("Name", "Kind", "Async", "File")),
        _grid(each("classes").select("repo_id", o, _cells(F.col("f.name"), F.coalesce("f.extends", F.lit("-")), file)), "Classes", ("Name", "Extends", "File")),
        _grid(exports.filter("NOT kind <=> 'css-variable'").select("repo_id", o, _cells(F.col("name"), F.col("kind"), file)), "Exports", ("Name", "Kind", "File")),
        _grid(exports.filter("kind <=> 'css-variable'").select("repo_id", o, _cells(F.concat(F.lit("--"), F.col("name")), file)), "CSS Variables", ("Variable", "File")),
        _grid(each("routes").select("repo_id", o, _cells(F.col("f.method"), F.col("f.path"), file)), "Routes", ("Method", "Path", "File")),
        _sql_objects(key(p)),
    ]
    docs = stitched(sections).select("repo_id.repo_id", "repo_id.dir", F.col("report").alias("content"))
    return docs.join(m, ["repo_id", "dir"]).select("repo_id", F.col("module").alias("name"), "content")


def _sql_objects(p: DataFrame) -> DataFrame:
    t = F.when(_has(F.col("tables")), F.concat(F.lit("### Tables\n\n| Table | Columns |\n|-------|---------|\n"), _join(F.col("tables"), "\n", lambda t: _text("| ", t["name"], " | ", _join(t["columns"], ", ", lambda c: c["name"]), " |"))))
    v = F.when(_has(F.col("views")), F.concat(F.lit("### Views\n\n"), _join(F.col("views"), "\n", lambda v: _text("- ", v["name"]))))
    i = F.when(_has(F.col("indexes")), F.concat(F.lit("### Indexes\n\n"), _join(F.col("indexes"), "\n", lambda i: _text("- ", i["name"], " ON ", i["table"], "(", _join(i["columns"], ", "), ")"))))
    rows = p.select("repo_id", "file_ord", F.concat_ws("\n\n", t, v, i).alias("line")).filter("line <> ''")
    parts = F.array_sort(F.collect_list(F.struct("file_ord", "line")))
    return rows.groupBy("repo_id").agg(F.concat(F.lit("## SQL Objects\n\n"), F.array_join(F.transform(parts, lambda r: r["line"]), "\n\n")).alias("text"))

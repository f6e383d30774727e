"""The facts of one record as rows (kind, name, extra): what ``parse.fact_table`` makes of a typed record, made where it is parsed.

Values are read as ``from_json`` reads them into the types of ``schemas``: what is no string becomes its JSON text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator


def _text(v) -> str | None:
    return v if v is None or v.__class__ is str else json.dumps(v, ensure_ascii=False)


def _nil(v) -> str:
    return "" if v is None else v if v.__class__ is str else _text(v)


def _commas(values) -> str:
    """A list joined by commas, its nulls shown; no list is empty text."""
    return ",".join("null" if v is None else v if v.__class__ is str else _text(v) for v in values or ())


def _plus(*parts) -> str:
    """Joined text, empty where a part is missing."""
    return "" if None in parts else "".join(map(_text, parts))


def _with(mark: str, *parts) -> str:
    """The parts that are there, with a mark between."""
    return mark.join(_text(p) for p in parts if p is not None)


def _parameters(ps) -> str | None:
    return None if ps is None else ",".join(_with(" ", p.get("mode"), p.get("name"), p.get("type")) for p in ps)


def _joined(texts) -> str:
    """``array_join`` without a word for nulls: they are left out."""
    return ",".join(t for t in texts if t is not None)


def _classes(classes: list[dict]) -> Iterator[tuple[str, str, str]]:
    for c in classes:
        yield "class", _nil(c.get("name")), _nil(c.get("extends"))
    for c in classes:
        name = _text(c.get("name"))
        for m in c.get("methods") or ():
            yield "method", _nil(m.get("name")), "" if name is None else f"{name}:{_commas(m.get('params'))}"
    for c in classes:
        for f in c.get("fields") or ():
            yield "field", _text(f), _text(c.get("name"))
    for c in classes:
        for k in c.get("constants") or ():
            yield "constant", _nil(k.get("name")), _nil(k.get("value"))


def _foreign(k: dict) -> str:
    r = k.get("reference") or {}
    action = f" on delete {_text(r['onDelete'])}" if r.get("onDelete") is not None else ""
    return "" if r.get("table") is None else f"{_commas(k.get('definition'))}->{_text(r['table'])}({_commas(r.get('columns'))}){action}"


def _column(c: dict) -> str | None:
    name, kind = c.get("name"), c.get("type")
    return None if name is None or kind is None else f"{_text(name)} {_text(kind)}{'' if c.get('nullable') else ' not null'}"


def _tables(tables: list[dict]) -> Iterator[tuple[str, str, str]]:
    for t in tables:
        yield "table", _nil(t.get("name")), _joined(map(_column, t.get("columns") or ()))
    for field, kind, extra in (("primaryKey", "primary key", lambda k: _commas(k.get("definition"))), ("foreignKeys", "foreign key", _foreign), ("uniqueConstraints", "unique", lambda k: _commas(k.get("definition")))):
        for t in tables:
            for k in t.get(field) or ():
                yield kind, _nil(t.get("name")), extra(k)


def _routine(f: dict) -> str:
    returned = f.get("returnType")
    return _parameters(f["routineParams"]) + ("" if returned is None else f" -> {_text(returned)}")


def _select(q: dict) -> str:
    limit = q.get("limit")
    return _joined(_with(" as ", c.get("column"), c.get("alias")) for c in q.get("columns") or ()) + ("" if limit is None else f" limit {_text(limit)}")


def _detail(d: dict) -> Iterator[tuple[str, str, str]]:
    def pairs(field: str, kind: str):
        for x in d.get(field) or ():
            yield kind, _nil(x.get("key")), _nil(x.get("value"))

    for x in d.get("projects") or ():
        yield "project", _nil(x.get("name")), _with(" ", x.get("path"), x.get("type"))
    for x in d.get("packages") or ():
        yield "package", _nil(x.get("name")), _nil(x.get("version"))
    for x in d.get("connectionStrings") or ():
        yield "connection", _nil(x.get("name")), _nil(x.get("connectionString"))
    yield from pairs("appSettings", "setting")
    for x in d.get("uiComponents") or ():
        yield "component", _nil(x.get("name")), _with("<", x.get("type"), x.get("parentType"))
    for s in d.get("sections") or ():
        for k in s.get("keys") or ():
            yield "key", _with(".", s.get("name"), k.get("key")), _nil(k.get("value"))
    for field, kind in (("normal", "dependency"), ("dev", "dev-dependency"), ("build", "build-dependency")):
        for x in (d.get("dependencies") or {}).get(field) or ():
            yield kind, _nil(x.get("name")), _nil(x.get("version"))
    for x in d.get("features") or ():
        yield "feature", _nil(x.get("key")), _commas(x.get("value"))
    for x in d.get("lockPackages") or ():
        yield "locked", _nil(x.get("name")), _nil(x.get("version"))
    yield from pairs("registries", "registry")
    yield from pairs("aliases", "alias")
    if d.get("rootPackage") is not None:
        yield "root", _text(d["rootPackage"]), ""
    if d.get("channel") is not None:
        yield "toolchain", _text(d["channel"]), _commas(d.get("components"))
    if d.get("framework") is not None:
        yield "framework", _text(d["framework"]), _nil(d.get("sdk"))


#: Field -> its rows, in the order of ``parse.fact_table``.
_RULES = {
    "imports": lambda v: [("import", _nil(x["source"] if x.get("source") is not None else x.get("spec")), _nil(x.get("alias"))) for x in v],
    "exports": lambda v: [("export", _nil(x.get("name")), _nil(x.get("kind"))) for x in v],
    "functions": lambda v: [("function", _nil(x.get("name")), _commas(x.get("params"))) for x in v],
    "classes": _classes,
    "routes": lambda v: [("route", _nil(x.get("path")), _nil(x.get("method"))) for x in v],
    "tables": _tables,
    "views": lambda v: [("view", _nil(x.get("name")), _nil(x.get("select"))) for x in v],
    "indexes": lambda v: [("index", _nil(x.get("name")), _plus(x.get("table"), "(", _commas(x.get("columns")), ")")) for x in v],
    "storedProcedures": lambda v: [("procedure", _nil(x.get("name")), _nil(_parameters(x.get("params")))) for x in v],
    "triggers": lambda v: [("trigger", _nil(x.get("name")), _with(" ", x.get("timing"), x.get("event"), x.get("table"))) for x in v],
    "databases": lambda v: [("database", _nil(x.get("name")), "") for x in v],
    "inserts": lambda v: [("insert", _nil(x.get("table")), _commas(x.get("columns"))) for x in v],
    "updates": lambda v: [("update", _nil(x.get("table")), _joined(_with("=", y.get("column"), y.get("value")) for y in x.get("set") or ())) for x in v],
    "deletes": lambda v: [("delete", _commas(x.get("from")), _nil(x.get("where"))) for x in v],
    "selects": lambda v: [("select", _commas(x.get("from")), _select(x)) for x in v],
    "alterTables": lambda v: [("alter", _nil(x.get("table")), _with(" ", o.get("action"), o.get("resource"), o.get("column"), o.get("constraint"), o.get("newName"))) for x in v for o in x.get("operations") or ()],
    "drops": lambda v: [("drop", _commas(x.get("names")), _nil(x.get("keyword"))) for x in v],
    "comments": lambda v: [("comment", _nil(x.get("content")), _with(":", x.get("type"), x.get("line"))) for x in v],
}


def rows(record: dict) -> list[tuple[str, str, str]]:
    out: list[tuple[str, str, str]] = []
    for field, value in record.items():
        if value and (rule := _RULES.get(field)):
            out += rule(value)
            if field == "functions":
                out += [("routine", _nil(x.get("name")), _routine(x)) for x in value if x.get("routineParams") is not None]
    if detail := record.get("detail"):
        out += _detail(detail)
    return out

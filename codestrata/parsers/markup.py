"""HTML, CSS and solution files for single texts, XML project files, TOML files."""

from __future__ import annotations

import json
import re
import tomllib
import xml.etree.ElementTree as ET

from codestrata.functions import markup as M
from codestrata.parsers.braces import _record
from codestrata.parsers.script import SyntaxProblem


def _all(pattern: str, text: str) -> list[str]:
    return [m[1] for m in re.finditer(pattern, text, re.A)]


def parse_html(text: str) -> dict:
    title = re.search(M.TITLE, text)
    return _record(imports=[{"type": "html", "source": x} for x in _all(M.SCRIPT, text) + _all(M.LINK, text)], exports=[{"name": title[1], "kind": "page-title"}] if title else [])


def parse_css(text: str) -> dict:
    names = dict.fromkeys(_all(M.CSS_CLASS, text) + _all(M.CSS_KEYFRAMES, text))
    exports = [{"name": n, "kind": "class"} for n in names] + [{"name": n, "kind": "css-variable"} for n in dict.fromkeys(_all(M.CSS_VARIABLE, text))]
    return _record(imports=[{"type": "css", "source": x} for x in _all(M.CSS_IMPORT, text)], exports=exports)


def _named(specs: list[str]) -> list[dict]:
    return [{"spec": x} for x in specs]


def parse_sln(text: str) -> dict:
    projects = [{"name": m[2], "path": m[3].replace("\\", "/"), "type": M.PROJECT_KINDS.get(m[1].upper(), "Unknown")} for m in re.finditer(M.PROJECT, text)]
    return _record(imports=_named([p["path"] for p in projects]), detail={"projects": projects})


def _xml(text: str) -> ET.Element:
    try:
        return ET.fromstring(text.lstrip("﻿ \r\n\t"))
    except ET.ParseError as e:
        raise SyntaxProblem(str(e)) from None


def _tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _each(e: ET.Element, name: str):
    return [x for x in e.iter() if _tag(x) == name]


def _child(e: ET.Element, name: str) -> str:
    return next(((x.text or "").strip() for x in e if _tag(x) == name), "")


def parse_csproj(text: str) -> dict:
    root = _xml(text)
    groups = [x for x in root if _tag(x) == "PropertyGroup"]
    if not groups:
        raise SyntaxProblem("no PropertyGroup")
    prop = lambda *names: next((v for n in names for g in groups if (v := _child(g, n))), "")
    packages = [{"name": p.get("Include") or p.get("Update") or "", "version": p.get("Version") or _child(p, "Version")} for p in _each(root, "PackageReference")]
    for r in _each(root, "Reference"):
        if hint := _child(r, "HintPath").replace("\\", "/"):
            include = r.get("Include", "")
            version = re.search(r"Version=([\d.]+)", include)
            folder = re.search(r"packages/(.+?)\.(\d+(?:\.\d+)*[\w.-]*)/", hint)
            packages.append({"name": folder[1] if folder else include.split(",")[0], "version": version[1] if version else folder[2] if folder else "", "hintPath": hint})
    refs = [{"path": r.get("Include", "").replace("\\", "/")} for r in _each(root, "ProjectReference")]
    detail = {"packages": packages, "projectReferences": refs, "framework": prop("TargetFramework", "TargetFrameworks", "TargetFrameworkVersion"), "sdk": root.get("Sdk", ""), "outputType": prop("OutputType")}
    return _record(imports=_named([f"{p['name']}@{p['version']}" for p in packages] + [r["path"] for r in refs]), detail=detail)


def parse_config(text: str) -> dict:
    root = _xml(text)
    packages = [{"name": p.get("id", ""), "version": p.get("version", ""), "targetFramework": p.get("targetFramework", "")} for p in _each(root, "package")] if _tag(root) == "packages" else []
    if packages:
        return _record(imports=_named([f"{p['name']}@{p['version']}" for p in packages]), detail={"packages": packages})
    strings = [{"name": a.get("name", ""), "connectionString": a.get("connectionString", ""), "providerName": a.get("providerName", "")} for c in _each(root, "connectionStrings") for a in c if _tag(a) == "add"]
    settings = [{"key": a.get("key", ""), "value": a.get("value", "")} for c in _each(root, "appSettings") for a in c if _tag(a) == "add"]
    return _record(detail={"connectionStrings": strings, "appSettings": settings})


# Attributes that name an event handler.
EVENTS = ("Click", "Loaded", "Initialized", "TextChanged", "SelectionChanged", "Checked", "Unchecked", "MouseDown", "MouseUp", "KeyDown", "KeyUp")


def parse_xaml(text: str) -> dict:
    root = _xml(text)
    attr = lambda e, name: next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)
    out = _record()
    if name := root.get("{http://schemas.microsoft.com/winfx/2006/xaml}Class"):
        out["classes"].append({"name": name, "extends": _tag(root), "methods": [], "line": None})
    components: list[dict] = []

    def walk(e: ET.Element, parent: str) -> None:
        if e is not root and (name := attr(e, "Name")):
            components.append({"type": _tag(e), "name": name, "parentType": parent, "line": None})
        for ev in EVENTS:
            if v := e.get(ev):
                out["functions"].append({"name": v, "kind": "event", "params": [], "async": False, "line": None})
        for c in e:
            walk(c, _tag(e))

    walk(root, "")
    out["detail"] = {"uiComponents": components}
    return out


def _list(v) -> list:
    return [] if v is None else v if isinstance(v, list) else [v]


def _toml(text: str) -> dict:
    try:
        return tomllib.loads(text)
    except (tomllib.TOMLDecodeError, ValueError):
        return {}


def _dependencies(table) -> list[dict]:
    out = []
    for name, v in (table or {}).items():
        if isinstance(v, dict):
            keep = {k: v.get(k, "") for k in ("version", "path", "git", "branch", "tag", "rev", "package", "registry")}
            out.append({"name": name, **keep, "features": _list(v.get("features")), "optional": v.get("optional", False), "defaultFeatures": v.get("default-features", True), "workspace": v.get("workspace", False)})
        else:
            out.append({"name": name, "version": str(v)})
    return out


# Keys of a package table; lists; others are texts.
PACKAGE_TEXT = ("name", "version", "edition", "description", "license", "license-file", "repository", "homepage", "documentation", "readme", "rust-version", "links", "resolver", "default-run")
PACKAGE_LISTS = ("authors", "keywords", "categories", "exclude", "include")


def _camel(k: str) -> str:
    head, *rest = k.split("-")
    return head + "".join(x.title() for x in rest)


def parse_cargo_toml(text: str) -> dict:
    doc = _toml(text)
    pkg = doc.get("package")
    package = None
    if pkg:
        package = {_camel(k): pkg.get(k, "") if not isinstance(pkg.get(k), dict) else "workspace" for k in PACKAGE_TEXT} | {k: _list(pkg.get(k)) for k in PACKAGE_LISTS}
        package |= {"publish": json.dumps(pkg.get("publish", True)), "build": json.dumps(pkg.get("build", "build.rs"))}
    deps = {k: _dependencies(doc.get(t)) for k, t in (("normal", "dependencies"), ("dev", "dev-dependencies"), ("build", "build-dependencies"))}
    targets = {}
    if lib := doc.get("lib"):
        targets["lib"] = [{"name": lib.get("name", ""), "path": lib.get("path", ""), "procMacro": lib.get("proc-macro", False), "doctest": lib.get("doctest", True), "crateType": _list(lib.get("crate-type"))}]
    for k in ("bin", "example", "test", "bench"):
        if doc.get(k):
            targets[k] = [{"name": t.get("name", ""), "path": t.get("path", "")} for t in _list(doc[k])]
    ws = doc.get("workspace")
    detail = {
        "package": package,
        "dependencies": deps,
        "features": [{"key": k, "value": [str(x) for x in _list(v)]} for k, v in doc.get("features", {}).items()],
        "profiles": [{"key": k, "value": json.dumps(v)} for k, v in doc.get("profile", {}).items()] or None,
        "workspace": {"members": _list(ws.get("members")), "exclude": _list(ws.get("exclude")), "resolver": ws.get("resolver", ""), "dependencies": _dependencies(ws.get("dependencies"))} if ws is not None else None,
        "buildTargets": [{"key": k, "value": json.dumps(v)} for k, v in targets.items()] or None,
        "patches": [{"key": k, "value": _dependencies(v)} for k, v in doc.get("patch", {}).items()] or None,
        "platformDeps": [{"key": k, "value": _dependencies(v.get("dependencies"))} for k, v in doc.get("target", {}).items()] or None,
    }
    return _record(imports=_named([f"{d['name']}@{d.get('version') or 'workspace'}" for k in ("normal", "dev", "build") for d in deps[k]]), detail=detail)


def parse_cargo_lock(text: str) -> dict:
    doc = _toml(text)
    packages = []
    for p in doc.get("package", []):
        deps = [d.split(" ") for d in p.get("dependencies", [])]
        packages.append({"name": p.get("name", ""), "version": p.get("version", ""), "source": p.get("source"), "checksum": p.get("checksum"), "dependencies": [{"name": d[0], "version": d[1] if len(d) > 1 else None} for d in deps]})
    root = next((p["name"] for p in packages if not p["source"]), None)
    return _record(imports=_named([f"{p['name']}@{p['version']}" for p in packages]), detail={"lockfileVersion": doc.get("version"), "lockPackages": packages, "rootPackage": root})


def parse_toolchain(text: str) -> dict:
    t = _toml(text).get("toolchain") or {}
    return _record(detail={"channel": t.get("channel", ""), "components": _list(t.get("components")), "targets": _list(t.get("targets")), "profile": t.get("profile", "")})


def parse_cargo_config(text: str) -> dict:
    doc = _toml(text)
    out = {"cargoBuild": json.dumps(doc["build"]) if doc.get("build") else None, "net": json.dumps(doc["net"]) if doc.get("net") else None}
    out["registries"] = [{"key": k, "value": str(v.get("index", ""))} for k, v in doc.get("registries", {}).items()]
    out["aliases"] = [{"key": k, "value": v if isinstance(v, str) else " ".join(map(str, _list(v)))} for k, v in doc.get("alias", {}).items()]
    out["configTargets"] = [{"key": k, "value": json.dumps(v)} for k, v in doc.get("target", {}).items()]
    return _record(detail=out)

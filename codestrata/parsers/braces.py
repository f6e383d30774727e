"""Languages with braces: C#, Java, Go, Rust, C and C++, PHP."""

from __future__ import annotations

import re

from codestrata.parsers.scan import Source
from codestrata.parsers.script import SyntaxProblem

W = r"[A-Za-z_]\w*"
CONTROL = {"if", "for", "while", "switch", "catch", "return", "using", "lock", "foreach", "new", "else", "do", "sizeof", "typeof", "nameof", "fixed", "throw", "await", "when", "case", "in", "match"}


def _record(**more) -> dict:
    return {"imports": [], "exports": [], "functions": [], "classes": [], "routes": []} | more


def _owner(spans: list[tuple[int, int, dict]], at: int) -> dict | None:
    """The innermost type around an offset."""
    inner = [x for x in spans if x[0] < at <= x[1]]
    return max(inner, key=lambda x: x[0])[2] if inner else None


def _last_names(s: Source, opened: int) -> list[str]:
    """Parameter names where types come first."""
    out = []
    for a, b in s.split(opened + 1, s.close(opened)):
        part = re.sub(r"=.*$", "", s.code[a:b], flags=re.S)
        part = re.sub(r"(\[[^\]]*\]\s*)+$", "", re.sub(r"^\s*(\[[^\]]*\]\s*)+", "", part).rstrip())
        if m := re.search(rf"({W})\s*$", part):
            if m[1] != "void" and re.search(r"[\w>\]*&]\s*[*&\s]", part[: m.start(1)] + " ") and part[: m.start(1)].strip():
                out.append(m[1])
    return out


def _first_names(s: Source, opened: int) -> list[str]:
    """Parameter names where types come after a colon or a blank."""
    return [m[1] for a, b in s.split(opened + 1, s.close(opened)) if (m := re.match(rf"\s*(?:mut\s+|ref\s+)*({W})", s.code[a:b]))]


def _argument(s: Source, opened: int) -> str:
    """Text of the first argument without quotes or its name; / if there is none."""
    parts = s.split(opened + 1, s.close(opened))
    if not parts:
        return "/"
    text = s.text[parts[0][0] : parts[0][1]].strip()
    return text.strip("\"'`").strip() or "/"


def _typed_language(text: str, lang: str) -> dict:
    """C# and Java: imports, types, methods in types, routes from attributes, public top-level exports."""
    is_cs = lang == "cs"
    s, out = Source(text, lang), _record()
    if is_cs:
        for m in s.find(rf"(?m)^\s*(?:global\s+)?using\s+(?:static\s+)?(?:({W})\s*=\s*)?([\w.]+)\s*;"):
            out["imports"].append({"source": m[2], "alias": m[1], "line": s.line(m.start(2))})
    else:
        for m in s.find(r"(?m)^\s*import\s+((?:static\s+)?[\w.*]+)\s*;"):
            out["imports"].append({"source": m[1], "alias": None, "line": s.line(m.start(1))})
    spans = []
    words = r"class|struct|interface|record" if is_cs else r"class|interface|enum|record"
    for m in s.find(rf"((?:(?:public|private|protected|internal|abstract|sealed|static|partial|final|readonly|strictfp)\s+)*)\b({words})\s+(?:class\s+|struct\s+)?({W})[^{{;]*([{{;])"):
        c = {"name": m[3], "kind": m[2], "extends": None, "methods": [], "line": s.line(m.start(1) if m[1].strip() else m.start(2))}
        end = s.close(m.start(4)) if m[4] == "{" else m.end()
        top = _owner(spans, m.start(2)) is None
        spans.append((m.start(4), end, c))
        out["classes"].append(c)
        if top and re.search(r"\bpublic\b", m[1]):
            out["exports"].append({"name": m[3], "kind": m[2], "line": c["line"]})
    for m in s.find(rf"(?:(?<=[{{}};\]>\n)])|^)\s*((?:(?:public|private|protected|internal|static|virtual|override|abstract|async|sealed|final|synchronized|default|extern|partial|new|native|unsafe)\s+)*)(?:<[^>(]*>\s*)?((?:[\w.]+(?:<[^;(){{}}]*>)?(?:\[\])*\??\s+))({W})\s*(?:<[^>(]*>)?\s*(\()"):
        # a modifier in the place of the type is a constructor
        if m[3] in CONTROL or m[2].strip() in {"public", "private", "protected", "internal", "static"} or m[2].strip() in CONTROL | {"else", "namespace", "package", "import", "class", "record", "struct", "interface", "enum"}:
            continue
        end = s.close(m.start(4))
        if not re.compile(r"\)\s*(?:throws\s+[\w.,\s]+|where\s+[^{;]+)?\s*(\{|=>|;)").match(s.code, end):
            continue
        owner = _owner(spans, m.start(3))
        f = {"name": m[3], "params": _last_names(s, m.start(4)), "line": s.line(m.start(1) if m[1].strip() else m.start(2))}
        if owner is not None:
            owner["methods"].append(f)
        elif is_cs:
            out["functions"].append(f | {"kind": "function", "async": "async" in m[1]})
            if "public" in m[1]:
                out["exports"].append({"name": m[3], "kind": "function", "line": f["line"]})
    if is_cs:
        for m in s.find(r"(?:\[|,)\s*(Http(?:Get|Post|Put|Delete|Patch|Head|Options|Trace)|Route|AcceptVerbs)\b\s*(\()?"):
            verb = m[1][4:].upper() if m[1].startswith("Http") else "ANY"
            out["routes"].append({"method": verb, "path": _argument(s, m.start(2)) if m[2] else "/", "line": s.line(m.start(1))})
    else:
        for m in s.find(r"@(Get|Post|Put|Delete|Patch|Request)Mapping\b\s*(\()?"):
            verb = "ANY" if m[1] == "Request" else m[1].upper()
            out["routes"].append({"method": verb, "path": _argument(s, m.start(2)) if m[2] else "/", "line": s.line(m.start())})
    return out


def parse_csharp(text: str) -> dict:
    return _typed_language(text, "cs")


def parse_java(text: str) -> dict:
    return _typed_language(text, "java")


def _go_exported(name: str) -> bool:
    return name[:1] == name[:1].upper()


def parse_go(text: str) -> dict:
    s, out = Source(text, "go"), _record()
    for m in s.find(r"(?m)^\s*import\s*(\()?"):
        a, b = (m.end(), s.close(m.start(1))) if m[1] else (m.end(), (s.code.find("\n", m.end()) + 1 or len(s.code)))
        for k in s.find(rf"(?:({W}|\.)\s+)?[\"`][^\"`]*[\"`]", 0, a, b):
            out["imports"].append({"source": s.raw(k).split(None, 1)[-1].strip("\"`") if k[1] else s.raw(k).strip("\"` \t"), "alias": k[1], "line": s.line(k.start())})
    types: dict[str, dict] = {}
    groups = [(m.start(1), s.close(m.start(1)), m[0].split()[0]) for m in s.find(r"(?m)^(?:type|const|var)\s*(\()")]

    def add_type(name: str, what: str, at: int) -> None:
        kind = {"struct": "struct", "interface": "interface"}.get(what, "type")
        c = {"name": name, "kind": kind, "extends": None, "methods": [], "line": s.line(at)}
        types.setdefault(name, c)
        out["classes"].append(c)
        if _go_exported(name):
            out["exports"].append({"name": name, "kind": kind, "line": c["line"]})

    for m in s.find(rf"(?m)^type\s+({W})\s*(?:\[[^\]]*\])?\s*=?\s*(struct|interface|[\w*\[\].]+)"):
        add_type(m[1], m[2], m.start(1))
    for m in s.find(rf"(?m)^(const|var)\s+({W})"):
        if _go_exported(m[2]):
            out["exports"].append({"name": m[2], "kind": f"{m[1]}_spec", "line": s.line(m.start(2))})
    for a, b, word in groups:
        inner = [(x, y) for x, y in s.blocks if a < x < b]
        for m in s.find(rf"(?m)^[ \t]*({W})\b\s*(struct|interface|[^\s=]*)", 0, a + 1, b):
            if any(x < m.start() <= y for x, y in inner):
                continue
            if word == "type":
                add_type(m[1], m[2], m.start(1))
            elif _go_exported(m[1]):
                out["exports"].append({"name": m[1], "kind": f"{word}_spec", "line": s.line(m.start(1))})
    # methods may come before their type
    for m in s.find(rf"(?m)^func\s*(?:\(\s*(?:{W}\s+)?\*?\s*({W})[^)]*\)\s*)?({W})\s*(?:\[[^\]]*\]\s*)?(\()"):
        params = [p for p in _first_names(s, m.start(3))]
        f = {"name": m[2], "params": params, "line": s.line(m.start())}
        if m[1]:
            if m[1] in types:
                types[m[1]]["methods"].append(f)
        else:
            out["functions"].append(f | {"kind": "function", "async": False})
            if _go_exported(m[2]):
                out["exports"].append({"name": m[2], "kind": "function", "line": f["line"]})
    done = 0
    for m in s.find(r"\.\s*(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS|HandleFunc|Handle)\s*(\()"):
        if m.start() < done:
            continue
        end = s.close(m.start(2))
        lit = next((x for a, b in s.split(m.start(2) + 1, end) if (x := s.literal(a, b)) is not None), "/")
        out["routes"].append({"method": "ANY" if m[1].startswith("Handle") else m[1], "path": lit, "line": s.line(m.start())})
        done = end
    return out


def _without_macros(s: Source) -> None:
    """The bodies of macro definitions are patterns, not items: blank in the code."""
    code, at, out = s.code, 0, []
    for m in re.finditer(r"\bmacro_rules!\s*\w+\s*([({\[])", code):
        if m.start() < at:
            continue
        end = s.close(m.start(1))
        out += [code[at : m.end()], re.sub(r"[^\n]", " ", code[m.end() : end])]
        at = end
    if out:
        s.code = "".join(out) + code[at:]
        for name in ("_pairs", "blocks"):
            s.__dict__.pop(name, None)


def parse_rust(text: str) -> dict:
    s, out = Source(text, "rust"), _record()
    _without_macros(s)
    for m in s.find(r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);"):
        out["imports"].append({"source": " ".join(s.raw(m, 1).split()), "alias": None, "line": s.line(m.start(1))})
    types: dict[str, dict] = {}
    owners: list[tuple[int, int, dict]] = []
    for m in s.find(rf"(?<!\w)(pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?(struct|enum|trait)\s+({W})[^{{;]*([{{;])"):
        c = {"name": m[3], "kind": m[2], "extends": None, "methods": [], "line": s.line(m.start(1) if m[1] else m.start(2))}
        types.setdefault(m[3], c)
        out["classes"].append(c)
        if (m[1] or "").strip() == "pub":
            out["exports"].append({"name": m[3], "kind": m[2], "line": c["line"]})
        if m[2] == "trait" and m[4] == "{":
            owners.append((m.start(4), s.close(m.start(4)), c))
    for m in s.find(rf"(?<!\w)impl\b(?:\s*<[^{{]*?>)?\s*(?:[\w:<>,'\s&]+?\s+for\s+)?({W})[^{{;]*(\{{)"):
        owners.append((m.start(2), s.close(m.start(2)), types.get(m[1]) or {"methods": []}))
    for m in s.find(rf"(?<!\w)((?:pub(?:\([^)]*\))?\s+)?)((?:(?:async|const|unsafe|extern(?:\s*\"[^\"]*\")?)\s+)*)fn\s+({W})\s*(?:<[^(]*>)?\s*(\()"):
        params = [p for p in _first_names(s, m.start(4)) if p != "self"]
        f = {"name": m[3], "params": params, "line": s.line(m.start(1) if m[1] else m.start(2) if m[2] else m.start())}
        owner = _owner(owners, m.start(3))
        if owner is not None:
            owner["methods"].append(f)
        else:
            out["functions"].append(f | {"kind": "function", "async": "async" in m[2]})
            if m[1].strip() == "pub":
                out["exports"].append({"name": m[3], "kind": "function", "line": f["line"]})
    for m in s.find(r"#\s*\[\s*(?:\w+::)*(get|post|put|delete|patch|head|options|Route|route|AcceptVerbs)\s*(\()?"):
        out["routes"].append({"method": m[1].upper() if m[1].islower() and m[1] != "route" else "ANY", "path": _argument(s, m.start(2)) if m[2] else "/", "line": s.line(m.start())})
    return out


def parse_c(text: str) -> dict:
    s, out = Source(text, "c"), _record()
    for m in re.finditer(r"(?m)^[ \t]*#\s*include\s*([<\"][^>\"\n]+[>\"])", text):
        out["imports"].append({"source": m[1].strip("<>\""), "alias": None, "line": s.line(m.start())})
    for m in re.finditer(rf"(?m)^[ \t]*#\s*define\s+({W})", text):
        out["exports"].append({"name": m[1], "kind": "define", "line": s.line(m.start())})
    code = re.sub(r"(?m)^[ \t]*#(?:[^\n\\]|\\\n|\\)*", lambda m: re.sub(r"[^\n]", " ", m[0]), s.code)
    s.code = code
    spans: list[tuple[int, int, dict]] = []
    by_name: dict[str, dict] = {}
    for m in s.find(rf"(?<!\w)(typedef\s+)?(class|struct|union|enum)\s+(?:class\s+)?({W})?\s*(?:final\s*)?(?::\s*([^{{;()]+))?\s*(\{{)"):
        end = s.close(m.start(5))
        name, alias = m[3], None
        if m[1]:
            alias = re.compile(rf"\}}\s*\*?\s*({W})").match(s.code, end)
            if alias:
                out["exports"].append({"name": alias[1], "kind": "type", "line": s.line(m.start())})
            name = name or (alias[1] if alias else None)
        if not name:
            continue
        bases = [re.sub(r"\b(public|private|protected|virtual)\b", "", b).strip() for b in (m[4] or "").split(",") if b.strip()]
        c = {"name": name, "kind": m[2], "extends": bases[0] if bases and m[2] != "enum" else None, "methods": [], "fields": [], "line": s.line(m.start())}
        out["classes"].append(c)
        by_name.setdefault(name, c)
        spans.append((m.start(5), end, c))
        if alias is None or alias[1] != name:  # an alias of the same name is exported once
            out["exports"].append({"name": name, "kind": m[2], "line": c["line"]})
        if m[2] != "enum":
            inner = [(x, y) for x, y in s.blocks if m.start(5) < x and y < end]
            for f in s.find(rf"[\w>*&\]]\s*[*&]*\s*({W})\s*(?:\[[^\]]*\])?\s*(?:=[^;]*)?;", 0, m.start(5) + 1, end):
                if "(" not in s.code[s.code.rfind("\n", 0, f.start()) + 1 : f.start(1)] and not any(x < f.start() <= y for x, y in inner):
                    c["fields"].append(f[1])
    for m in s.find(rf"(?<!\w)typedef\s+(?!.*\{{)[^;{{]*?({W})\s*;"):
        out["exports"].append({"name": m[1], "kind": "type", "line": s.line(m.start())})
    namespaces = [(m.start(1), s.close(m.start(1))) for m in s.find(rf"(?<!\w)(?:namespace\s+[\w:]*|extern\s+\"[^\"]*\")\s*(\{{)")]
    scopes = namespaces + [(a, b) for a, b, _ in spans]
    known: set[str] = set()
    for m in s.find(rf"(?:(?<=[;{{}}:>\n])|^)\s*((?:[\w:<>,*&~]+[ \t\n*&]+)+?|)((?:{W}::)?~?{W})\s*(\()"):
        end = s.close(m.start(3))
        tail = re.compile(r"\)\s*(?:const|noexcept|override|final|\s)*(?::[^{;]*)?(\{|;|=\s*(?:0|default|delete)\s*;)").match(s.code, end)
        name = m[2].split("::")[-1]
        head = m[1].split()
        if not tail or name in CONTROL or (head and head[0] in CONTROL | {"typedef", "else", "return", "goto"}):
            continue
        if any(x < m.start(2) <= y and (x, y) not in scopes for x, y in s.blocks):
            continue  # calls inside bodies
        owner = _owner(spans, m.start(2))
        f = {"name": name, "params": _last_names(s, m.start(3)), "line": s.line(m.start(2))}
        if owner is None and "::" in m[2]:
            owner = by_name.get(m[2].split("::")[0])
            if owner is None:
                continue
        if owner is not None:
            if name not in [x["name"] for x in owner["methods"]]:
                owner["methods"].append(f)
        elif head and name not in known and not any(x < m.start(2) <= y for x, y in namespaces):
            known.add(name)
            out["functions"].append(f | {"kind": "function", "async": False})
            out["exports"].append({"name": name, "kind": "function", "line": f["line"]})
    return out


def parse_php(text: str) -> dict:
    start = re.search(r"<\?(?:php\b|=)?", text)
    if not start:
        return _record()
    text = re.sub(r"[^\n]", " ", text[: start.end()]) + text[start.end() :]
    for m in reversed(list(re.finditer(r"\?>[\s\S]*?(?:<\?(?:php\b|=)?|\Z)", text))):
        text = text[: m.start()] + ";" + re.sub(r"[^\n]", " ", text[m.start() + 1 : m.end()]) + text[m.end() :]
    s, out = Source(text, "php"), _record()
    if not s.balanced:
        raise SyntaxProblem("unbalanced brackets")
    spans: list[tuple[int, int, dict]] = []
    for m in s.find(rf"(?<![\w$>])(?:(?:abstract|final|readonly)\s+)*(class|interface|trait|enum)\s+({W})(?:\s*:\s*\w+)?(?:\s+extends\s+([\w\\]+))?[^{{;]*(\{{)"):
        c = {"name": m[2], "kind": m[1], "extends": m[3], "methods": [], "constants": [], "line": s.line(m.start())}
        spans.append((m.start(4), s.close(m.start(4)), c))
        out["classes"].append(c)
        out["exports"].append({"name": m[2], "kind": m[1], "line": c["line"]})
    for m in s.find(r"(?m)^[ \t]*use\s+(?:function\s+|const\s+)?([^;(]+);"):
        if _owner(spans, m.start(1)):
            continue
        g = re.match(r"([\w\\]+)\\\{([^}]*)\}", m[1])
        for item in g[2].split(",") if g else m[1].split(","):
            name, _, alias = item.strip().partition(" as ")
            if name:
                out["imports"].append({"source": f"{g[1]}\\{name}" if g else name, "alias": alias.strip() or None, "line": s.line(m.start())})
    bodies = []
    for m in s.find(rf"((?:(?:public|private|protected|static|abstract|final)\s+)*)(?<![\w$>])function\s+&?\s*({W})\s*(\()"):
        params = re.findall(r"\$(\w+)", s.code[m.start(3) : s.close(m.start(3))])
        f = {"name": m[2], "params": params, "line": s.line(m.start())}
        owner = _owner(spans, m.start(2))
        opened = re.compile(r"\)\s*(?::\s*[\w\\|?]+)?\s*\{").match(s.code, s.close(m.start(3)))
        if opened:
            bodies.append((opened.end() - 1, s.close(opened.end() - 1)))
        if owner is not None:
            vis = re.search(r"public|private|protected", m[1])
            owner["methods"].append(f | {"visibility": vis[0] if vis else "public"})
        else:
            out["functions"].append(f | {"kind": "function", "async": False})
            out["exports"].append({"name": m[2], "kind": "function", "line": f["line"]})
    for m in s.find(rf"(?<![\w$>])((?:public|private|protected|final)\s+)*const\s+(?:\w+\s+)?({W})\s*=\s*([^;]+);"):
        owner = _owner(spans, m.start(2))
        value = s.raw(m, 3).strip()
        if owner is not None:
            owner["constants"].append({"name": m[2], "value": value.strip("'\""), "visibility": (m[1] or "public").strip(), "line": s.line(m.start())})
        else:
            out["exports"].append({"name": m[2], "kind": "const", "line": s.line(m.start())})
    for m in s.find(rf"(?:(?<=[;{{}}\n])|^)\s*\$({W})\s*=(?![=>])"):
        if not any(a < m.start() <= b for a, b in bodies) and _owner(spans, m.start()) is None:
            out["exports"].append({"name": m[1], "kind": "variable", "line": s.line(m.start())})
    for m in s.find(r"(?<![\w\\])Route\s*::\s*(get|post|put|patch|delete|options)\s*(\()", re.I):
        path = s.literal(m.end())
        out["routes"].append({"method": m[1].upper(), "path": path if path is not None else "/", "line": s.line(m.start())})
    for m in s.find(r"#\[\s*(?:[\w\\]+\\)?(Get|Post|Put|Patch|Delete|Options|Head|Any|Match|Route)\b\s*(\()?"):
        path, verb = "/", "ANY" if m[1] in ("Route", "Match", "Any") else m[1].upper()
        if m[2]:
            args = s.text[m.end() : s.close(m.start(2))]
            named = re.search(r"path\s*:\s*['\"]([^'\"]*)", args) or re.match(r"\s*['\"]([^'\"]*)", args)
            path = named[1] if named else "/"
            if m[1] == "Route" and (v := re.search(r"methods\s*:\s*\[\s*['\"](\w+)", args)):
                verb = v[1].upper()
        out["routes"].append({"method": verb, "path": path, "line": s.line(m.start())})
    return out

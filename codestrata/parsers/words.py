"""Languages with keyword blocks: Ruby, PowerShell; and INI."""

from __future__ import annotations

import re

from codestrata.parsers.braces import W, _owner, _record
from codestrata.parsers.scan import Source

_RUBY_OPEN = re.compile(r"(?<![\w.:@$])(?:(class|module|def|begin|case|for)\b(?!:)|(if|unless|while|until)\b|(do)\b(?!\s*:)|(end)\b(?![?!:]))")


def _ruby_blocks(s: Source) -> dict[int, int]:
    """Offset of each opening word -> offset of its end; trailing conditions open nothing."""
    stack, pairs, loops = [], {}, set()
    for m in _RUBY_OPEN.finditer(s.code):
        if m[4]:
            if stack:
                pairs[stack.pop()] = m.start()
            continue
        before = s.code[s.code.rfind("\n", 0, m.start()) + 1 : m.start()].strip()
        line_end = s.code.find("\n", m.start())
        line = s.code[m.start() : line_end if line_end >= 0 else len(s.code)]
        if m[2] and before and not before.endswith(("=", "(", ";", "then", "else", "||", "&&", "return")):
            continue
        if m[3] and any(x in loops for x in stack[-1:]) and "\n" not in s.code[stack[-1] : m.start()]:
            continue
        if m[1] == "def" and re.match(r"def\s+[\w.?!]+(?:\([^)]*\))?\s*=\s", line):
            continue
        if m[1] == "class" and re.match(r"class\s*<<", line) is None and not re.match(r"class\s+[A-Z]", line):
            continue
        if m[2] in ("while", "until") or m[1] == "for":
            loops.add(m.start())
        stack.append(m.start())
    for a in stack:
        pairs[a] = len(s.code)
    return pairs


def parse_ruby(text: str) -> dict:
    s, out = Source(text, "ruby"), _record()
    pairs = _ruby_blocks(s)
    for m in s.find(r"(?m)^[ \t]*(require|require_relative|load)\b[ \t(]*"):
        if (source := s.literal(m.end())) is not None:
            out["imports"].append({"type": m[1], "source": source, "alias": None, "line": s.line(m.start(1))})
    for m in s.find(r"(?m)^[ \t]*(get|post|put|patch|delete|options|head)\b(?=[ \t(])[ \t(]*([a-z_]\w*)?"):
        path = s.literal(m.end(1) + len(re.match(r"[ \t(]*", s.code[m.end(1) :])[0]))
        out["routes"].append({"method": m[1].upper(), "path": path if path is not None else f":{m[2]}" if m[2] and m[2] != "do" else "/", "line": s.line(m.start(1))})
    spans: list[tuple[int, int, dict]] = []
    for a in sorted(pairs):
        if m := re.compile(r"(class|module)\s+([A-Z][\w:]*)(?:\s*<\s*([A-Z][\w:]*))?").match(s.code, a):
            spans.append((a, pairs[a], {"name": m[2], "kind": m[1], "extends": m[3], "methods": [], "line": s.line(a)}))
    defs = [a for a in sorted(pairs) if s.code.startswith("def", a)] + [m.start() for m in s.find(r"(?m)(?<=^)[ \t]*def\s+[\w.?!]+(?:\([^)]*\))?\s*=\s")]
    for a in sorted(defs):
        m = re.compile(r"\s*def\s+(?:self\.)?([\w?!=]+)\s*(\(([^)]*)\)|[ \t]+([^\n;=]+))?").match(s.code, a)
        if not m:
            continue
        params = [p.group(1) for x in re.split(r",", m[3] or m[4] or "") if (p := re.match(rf"\s*({W})\s*(?:=.*)?$", x, re.S))]
        f = {"name": m[1], "params": params, "line": s.line(m.start(1))}
        if any(s.code.startswith("def", x) and x < a <= pairs[x] for x in defs if x in pairs and x != a):
            continue
        owner = _owner(spans, a)
        if owner is not None:
            owner["methods"].append(f)
        else:
            out["functions"].append(f | {"kind": "function", "async": False})
    # a module is recorded only for its methods
    out["classes"] = [c for _, _, c in spans if c["kind"] == "class" or c["methods"]]
    return out


def parse_powershell(text: str) -> dict:
    s, out = Source(text, "ps1"), _record()
    for m in s.find(r"(?im)^[ \t]*using\s+(?:module|namespace|assembly)\s+([^\n;]+)|(?<![\w-])Import-Module\s+(?:-Name\s+)?(\"[^\"]*\"|'[^']*'|[^\s;|]+)"):
        g = 1 if m[1] is not None else 2
        out["imports"].append({"source": s.raw(m, g).strip().strip("\"'"), "alias": None, "line": s.line(m.start())})
    for m in s.find(r"(?i)(?<![\w-])Export-ModuleMember\s+[^\n;]*?-Function\s+((?:[\w*-]+|[\"'][^\"']*[\"'])(?:\s*,\s*(?:[\w*-]+|[\"'][^\"']*[\"']))*)"):
        for name in s.raw(m, 1).split(","):
            out["exports"].append({"name": name.strip().strip("\"'"), "kind": "function", "line": s.line(m.start())})
    spans: list[tuple[int, int, dict]] = []
    for m in s.find(rf"(?im)^[ \t]*class\s+({W})\s*(?::\s*([\w.]+)[^{{]*)?(\{{)"):
        c = {"name": m[1], "kind": "class", "extends": m[2], "methods": [], "line": s.line(m.start(1))}
        spans.append((m.start(3), s.close(m.start(3)), c))
        out["classes"].append(c)
        inner = [(x, y) for x, y in s.blocks if m.start(3) < x < s.close(m.start(3))]
        for f in s.find(rf"(?:static\s+|hidden\s+)*(?:\[[\w.\[\]]+\]\s*)?({W})\s*(\()[^)]*\)\s*(?::\s*base\([^)]*\)\s*)?\{{", 0, m.start(3) + 1, s.close(m.start(3))):
            if not any(x < f.start(1) <= y for x, y in inner) and f[1].lower() not in ("if", "foreach", "while", "switch", "for"):
                c["methods"].append({"name": f[1], "params": re.findall(r"\$(\w+)", s.code[f.start(2) : s.close(f.start(2))]), "line": s.line(f.start(1))})
    for m in s.find(r"(?i)(?<![\w-])(?:function|filter)\s+((?:\w+:)?[\w-]+)\s*(\([^)]*\))?\s*(\{)"):
        if s.depth(m.start()) > 0:
            continue
        params = re.findall(r"\$(\w+)", m[2] or "")
        body = re.compile(r"\{\s*(?:\[[^\n]*\]\s*)*param\s*(\()", re.I).match(s.code, m.start(3))
        if body:
            params = [p[1] for a, b in s.split(body.start(1) + 1, s.close(body.start(1))) if (p := re.search(r"\$(\w+)", re.sub(r"\[[^\]]*\([^)]*\)\s*\]", "", s.code[a:b])))]
        out["functions"].append({"name": m[1], "kind": "function", "params": params, "async": False, "line": s.line(m.start())})
    return out


def parse_ini(text: str) -> dict:
    sections: list[dict] = []
    for line in text.splitlines():
        t = line.strip()
        if not t or t[0] in ";#":
            continue
        if m := re.fullmatch(r"\[([^\]]*)\].*", t):
            sections.append({"name": m[1].strip(), "keys": []})
        elif m := re.match(r"([^=:]+?)\s*[=:]\s*(.*)$", t):
            if not sections:
                sections.append({"name": "", "keys": []})
            sections[-1]["keys"].append({"key": m[1], "value": m[2].strip()})
    return _record(detail={"sections": [x for x in sections if x["name"] or x["keys"]]})

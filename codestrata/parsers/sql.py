"""SQL files as data: a reader of DDL and DML statements.

Statements are cut at semicolons and GO lines outside strings and comments, and, for scripts
without semicolons, before a line that begins another statement. Each is read by the words
it begins with. What stands before those words (WITH parts, IF conditions, BEGIN TRAN, SET
options) is passed over: the statement begins at the first known words outside parentheses.
"""

from __future__ import annotations

import bisect
import re

from codestrata import rules
from codestrata.parsers.braces import _record
from codestrata.parsers.scan import Source

ID = r"(?:`[^`]+`|\[[^\]]+\]|\"[^\"]+\"|[\w@#$]+)"
QID = rf"{ID}(?:\s*\.\s*{ID})*"
_ID, _QID, _NAMED, _PLAIN = re.compile(ID), re.compile(QID), re.compile(rf"\s*({QID})"), re.compile(r"[\w@#$]+")
KINDS = ("tables", "views", "indexes", "storedProcedures", "sqlFunctions", "triggers", "databases", "inserts", "updates", "deletes", "selects", "alterTables", "drops", "comments")


def clean(name: str | None) -> str | None:
    """The last part of a name, without quotes or brackets."""
    if name is None:
        return None
    if _PLAIN.fullmatch(name):
        return name
    parts = _ID.findall(name)
    return parts[-1].strip("`[]\"") if parts else name.strip()


def dialect(sql: str) -> str:
    upper = sql.upper()
    return next((name for sign, pattern, name in _DIALECTS if (sign in upper) and pattern.search(sql)), "mysql")


def _sign(pattern: str) -> str:
    """A text without which a dialect's pattern cannot match, in upper case: it is sought first."""
    word = re.fullmatch(r"\\b(\w+)\\b", pattern)
    return word[1] if word else {r"\[[\w@#]+\]": "[", r"`.*?`": "`", r"\b::\b": "::"}.get(pattern, "")


_DIALECTS = [(_sign(p), re.compile(p, re.A | (re.I if any_case else 0)), name) for p, any_case, name in rules.DIALECTS]


def batches(sql: str) -> list[str]:
    parts = [b.strip() for b in re.split(r"(?im)^\s*GO\s*;?\s*$", sql)]
    return [b for b in parts if b and not re.match(r"(?i)\s*PRINT\b", b)]


def comments(sql: str) -> list[dict]:
    if "--" not in sql and "/*" not in sql:
        return []
    ends = [m.start() for m in re.finditer("\n", sql)]
    at = lambda i: bisect.bisect_left(ends, i) + 1
    one = [{"type": "single-line", "content": m[1].strip(), "line": at(m.start())} for m in re.finditer(r"--[ \t]*([^\n]*)", sql) if m[1].strip()]
    many = [{"type": "multi-line", "content": m[1].strip(), "line": at(m.start())} for m in re.finditer(r"/\*([\s\S]*?)\*/", sql)]
    return one + many


def _names(text: str) -> list[str]:
    return [clean(m[1]) for p in text.split(",") if (m := _NAMED.match(p))]


_OBJECT = r"(?:OR\s+(?:REPLACE|ALTER)\s+)?(?:DEFINER\s*=\s*\S+\s+)?(?:(?:GLOBAL|LOCAL|TEMP(?:ORARY)?|MATERIALIZED|UNIQUE|FULLTEXT|SPATIAL|CLUSTERED|NONCLUSTERED)\s+)*(?:TABLE|VIEW|INDEX|FUNCTION|PROC(?:EDURE)?|TRIGGER|DATABASE|SCHEMA)"
#: Words that begin a statement with facts.
_START = re.compile(rf"(?i)(?<![\w.@#$])(?:CREATE\s+{_OBJECT}|INSERT\s+(?:IGNORE\s+)?INTO|UPDATE\s+{QID}(?:\s+(?:AS\s+)?\w+)?\s+SET|DELETE\s+FROM|ALTER\s+TABLE|DROP\s+(?:TABLE|VIEW|INDEX|PROCEDURE|FUNCTION|TRIGGER|DATABASE|SCHEMA)|SELECT)\b")
#: Line starts that end a statement without a semicolon.
_LINE = re.compile(r"(?im)^[ \t]*(CREATE|ALTER\s+TABLE|DROP\s+(?:TABLE|VIEW|PROCEDURE|FUNCTION|TRIGGER|DATABASE|SCHEMA)|INSERT|UPDATE|DELETE|SELECT|WITH|IF|ELSE|SET|USE|EXEC(?:UTE)?|DECLARE|PRINT|BEGIN|END|COMMIT|ROLLBACK|MERGE|TRUNCATE)\b")
_CTE = re.compile(rf"(?i)WITH\s+(?:RECURSIVE\s+)?{ID}\s*(?:\([^)]*\)\s*)?AS\s*\(")
_ROUTINE = re.compile(r"(?i)\s*CREATE\b[^;]*?\b(FUNCTION|PROCEDURE|PROC|TRIGGER)\b")
#: A query goes on after these.
_OPEN = re.compile(r"(?i)(?:\b(?:UNION|ALL|EXCEPT|INTERSECT|AS|DISTINCT|EXPLAIN|RETURNING)|[(,=])\s*$")
#: What statements are cut at; first characters are matched at once and looked back at, so that others are passed quickly.
_CUT = r"(?<=;)|(?<=\$)\$|(?i:(?<=\b[Bb])EGIN\b(?!\s+TRAN)|(?<=\b[Cc])ASE\b|(?<=\b[Ee])ND\b(?!\s+(?:IF|LOOP|WHILE|REPEAT)))"
_CUTS = re.compile(rf"[bBcCeE;$](?:{_CUT})")
_CUTS_GO = re.compile(rf"[bBcCeE;$](?:{_CUT})|(?im:^\s*GO\s*$)")
_GO = re.compile(r"(?im)^[^\S\n]*GO\s*$")
_BRACKETS = re.compile(r"[()]")
_UPDATE_FIRST, _WITH_FIRST, _SELECT_FIRST = re.compile(r"(?i)\s*UPDATE\b"), re.compile(r"(?i)\s*WITH\b"), re.compile(r"(?i)\s*SELECT\b")
_VALUES, _VALUES_AT, _VIEW, _WHERE, _RETURNS = re.compile(r"\bVALUES\b", re.I), re.compile(r"\bVALUES\b\s*", re.I), re.compile(r"(?i)\bVIEW\b"), re.compile(r"\bWHERE\b", re.I), re.compile(r"RETURNS\s+(@?\w+(?:\s+TABLE)?)", re.I)
#: Statements by kind, in the order in which they are tried.
_STATEMENTS = [(kind, re.compile(pattern, re.I)) for kind, pattern in (
    ("table", rf"CREATE\s+(?:GLOBAL\s+|LOCAL\s+)?(?:TEMP(?:ORARY)?\s+)?TABLE\s+(IF\s+NOT\s+EXISTS\s+)?({QID})"),
    ("view", rf"CREATE\s+(?:OR\s+(?:REPLACE|ALTER)\s+)?(?:MATERIALIZED\s+)?VIEW\s+(?:IF\s+NOT\s+EXISTS\s+)?({QID})(?:\s*\([^)]*\))?\s*(?:WITH\s+\w+\s+)?(?:AS\s+)?"),
    ("index", rf"CREATE\s+((?:UNIQUE|FULLTEXT|SPATIAL|CLUSTERED|NONCLUSTERED)\s+)*INDEX\s+(?:CONCURRENTLY\s+)?(?:IF\s+NOT\s+EXISTS\s+)?({QID})\s+(?:USING\s+(\w+)\s+)?ON\s+({QID})\s*(?:USING\s+(\w+)\s*)?(\()?"),
    ("routine", rf"CREATE\s+(?:OR\s+(?:REPLACE|ALTER)\s+)?(?:DEFINER\s*=\s*\S+\s+)?(FUNCTION|PROCEDURE|PROC)\s+({QID})"),
    ("trigger", rf"CREATE\s+(?:OR\s+(?:REPLACE|ALTER)\s+)?(?:DEFINER\s*=\s*\S+\s+)?TRIGGER\s+(?:IF\s+NOT\s+EXISTS\s+)?({QID})"),
    ("database", rf"CREATE\s+(?:DATABASE|SCHEMA)\s+(?:IF\s+NOT\s+EXISTS\s+)?({QID})"),
    ("insert", rf"INSERT\s+(?:IGNORE\s+)?INTO\s+({QID})\s*(\()?"),
    ("update", rf"UPDATE\s+({QID})(?:\s+(?:AS\s+)?\w+)?\s+SET\s+"),
    ("delete", rf"DELETE\s+FROM\s+({QID})"),
    ("select", r"SELECT\b"),
    ("alter", rf"ALTER\s+TABLE\s+(?:ONLY\s+|IF\s+EXISTS\s+)*({QID})\s+"),
    ("drop", r"DROP\s+(TABLE|VIEW|INDEX|PROCEDURE|FUNCTION|TRIGGER|DATABASE|SCHEMA)\s+(?:IF\s+EXISTS\s+)?"),
)]
#: Those that can begin with a letter; other letters (upper case differs from what a search without case takes) are tried with all.
_BY_LETTER = {c: [(k, p) for k, p in _STATEMENTS if p.pattern[0] == c] for c in "CIUDSA"}
_TAIL = re.compile(r"(?i)\b(CASCADE|RESTRICT)\b.*|\bON\b.*", re.S)
_CLAUSE = re.compile(r"(?i)\(|(?<!\w)(SELECT|FROM|WHERE|GROUP\s+BY|HAVING|ORDER\s+BY|LIMIT|(?:INNER|LEFT|RIGHT|FULL|CROSS)(?:\s+OUTER)?\s+JOIN|JOIN|ON|UNION|OFFSET)\b")
_BLANKS = re.compile(r"\s+")
_DISTINCT = re.compile(r"\s*(DISTINCT)\b|\s*TOP\s+\(?\d+\)?", re.I)
_AS, _ALIAS, _CALL = re.compile(rf"(?is)(.+?)\s+AS\s+({ID})$"), re.compile(rf"(?s)([\w.\]\[`]+|.*\))\s+({ID})$"), re.compile(r"(\w+)\s*\(")
_CONSTRAINT_OP = re.compile(rf"(?i)(ADD|DROP)\s+(?:CONSTRAINT\s+({ID})\s*)?(PRIMARY\s+KEY|FOREIGN\s+KEY|UNIQUE|CHECK)?\s*")
_INDEX_OP = re.compile(rf"(?i)(ADD|DROP)\s+(?:UNIQUE\s+)?(INDEX|KEY)\s+({ID})")
_COLUMN_OP = re.compile(rf"(?i)(ADD|DROP)\s+(?:COLUMN\s+)?(?:IF\s+(?:NOT\s+)?EXISTS\s+)?({ID})\s*([\w]+(?:\s*\([^)]*\))?)?")
_NOT_NULL = re.compile(r"(?i)NOT\s+NULL")


class Reader:
    def __init__(self, sql: str):
        self.s = Source(sql, "sql")
        code = self.s.code
        self.code = re.sub(r"\"[^\"\n]*\"", lambda m: self.s.text[m.start() : m.end()], code) if '"' in code else code
        self.out: dict[str, list] = {k: [] for k in KINDS}

    def statements(self):
        """(start, end): routine and trigger bodies between BEGIN and END stay in one statement."""
        start, depth, routine = 0, 0, self._routine_from(0)
        for m in (_CUTS_GO if _GO.search(self.code) else _CUTS).finditer(self.code):
            word = m[0].strip().upper()
            if word == "$$":
                depth += 100 if depth < 100 else -100
            elif word in ("BEGIN", "CASE"):
                depth += bool(depth or m.end() >= routine)
            elif word == "END":
                depth -= bool(depth % 100)
            elif depth == 0 or word == "GO":
                yield start, m.start()
                start, depth, routine = m.end(), 0, self._routine_from(m.end())
        yield start, len(self.code)

    def _routine_from(self, start: int) -> float:
        """Where the statement that starts here says that it is a routine or trigger."""
        m = _ROUTINE.match(self.code, start)
        return m.end() if m else float("inf")

    def pieces(self, a: int, b: int):
        """A statement cut before lines that begin another one, outside parentheses; routines are not cut."""
        if self._routine_from(a) <= b:
            yield a, b
            return
        start, depth, at = a, 0, a
        for m in _LINE.finditer(self.code, a, b):
            for c in _BRACKETS.finditer(self.code, at, m.start()):
                depth = max(0, depth + (1 if c[0] == "(" else -1))
            at = m.start()
            if depth or not self.code[start:at].strip():
                continue
            word, tail = m[1].split()[0].upper(), self.code[max(start, at - 40) : at]
            first = _START.search(self.code, start, at)
            head = first[0].split()[0].upper() if first else ""
            goes_on = bool(_OPEN.search(tail))
            if word == "SET":
                goes_on = goes_on or head == "" and _UPDATE_FIRST.match(self.code, start, at) is not None
            elif word == "SELECT":
                values = head == "INSERT" and _VALUES.search(self.code, start, at)
                view = head == "CREATE" and _VIEW.search(first[0])
                goes_on = goes_on or bool(view) or (head == "INSERT" and not values) or _WITH_FIRST.match(self.code, start, at) is not None and not head
            elif word == "WITH":
                goes_on = goes_on or head == "CREATE" or not _CTE.match(self.code, m.start(1), b)
            elif word in ("INSERT", "UPDATE", "DELETE"):
                goes_on = goes_on or _WITH_FIRST.match(self.code, start, at) is not None and not head
            if not goes_on:
                yield start, at
                start = at
        yield start, b

    def read(self) -> dict[str, list]:
        for a, b in self.statements():
            for x, y in self.pieces(a, b) if self.code[a:b].strip() else ():
                at = self.begin(x, y)
                if at is not None:
                    self.statement(at, len(self.code[:y].rstrip()) if self.code[y - 1 : y].isspace() else y)
        return self.out

    def begin(self, a: int, b: int) -> int | None:
        """The first known words outside parentheses."""
        i = a
        while m := _START.search(self.code, i, b):
            opened = self.code.find("(", i, m.start())
            if opened < 0:
                return m.start()
            i = self.s.close(opened) + 1
        return None

    def statement(self, a: int, b: int) -> None:
        kind, m = next(((k, m) for k, p in _BY_LETTER.get(self.code[a : a + 1].upper(), _STATEMENTS) if (m := p.match(self.code, a, b))), (None, None))
        o = self.out
        if kind == "table":
            o["tables"].append(self.table(m, b))
        elif kind == "view":
            o["views"].append({"name": clean(self.raw(m, 1)), "select": self.s.text[m.end() : b].strip() or None})
        elif kind == "index":
            cols = _names(self.code[m.end() : self.s.close(m.start(6))]) if m[6] else []
            o["indexes"].append({"name": clean(self.raw(m, 2)), "table": clean(self.raw(m, 4)), "columns": cols, "type": (m[1] or "").strip().lower() or None, "using": (m[3] or m[5] or "").lower() or None})
        elif kind == "routine":
            routine = {"name": clean(self.raw(m, 2)), "params": self.parameters(m.end(), b)}
            if m[1].upper() == "FUNCTION":
                r = _RETURNS.search(self.code, m.end(), b)
                o["sqlFunctions"].append(routine | {"returnType": r[1] if r else None})
            else:
                o["storedProcedures"].append(routine)
        elif kind == "trigger":
            o["triggers"].append(self.trigger(clean(self.raw(m, 1)), m.end(), b))
        elif kind == "database":
            o["databases"].append({"name": clean(self.raw(m, 1))})
        elif kind == "insert":
            cols = _names(self.code[m.end() : self.s.close(m.start(2))]) if m[2] and not _SELECT_FIRST.match(self.code, m.end(), b) else []
            v = _VALUES_AT.search(self.code, m.end(), b)
            o["inserts"].append({"table": clean(self.raw(m, 1)), "columns": cols, "values": self.s.text[v.end() : b].strip() if v else None})
        elif kind == "update":
            where = _WHERE.search(self.code, m.end(), b)
            sets = []
            for x, y in self.s.split(m.end(), where.start() if where else b):
                name, _, value = self.s.text[x:y].partition("=")
                sets.append({"column": clean(name.strip()), "value": value.strip()})
            o["updates"].append({"table": clean(self.raw(m, 1)), "set": sets, "where": self.s.text[where.end() : b].strip() if where else None})
        elif kind == "delete":
            where = _WHERE.search(self.code, m.end(), b)
            o["deletes"].append({"from": [clean(self.raw(m, 1))], "where": self.s.text[where.end() : b].strip() if where else None})
        elif kind == "select":
            o["selects"].append(self.select(a, b))
        elif kind == "alter":
            o["alterTables"].append({"table": clean(self.raw(m, 1)), "operations": self.operations(m.end(), b)})
        elif kind == "drop":
            names = _TAIL.sub("", self.code[m.end() : b])
            o["drops"].append({"names": _names(names), "keyword": m[1].lower()})

    def raw(self, m: re.Match, g: int) -> str:
        return self.s.text[m.start(g) : m.end(g)]

    def table(self, m: re.Match, b: int) -> dict:
        t = {"name": clean(self.raw(m, 2)), "ifNotExists": bool(m[1]), "columns": [], "primaryKey": [], "foreignKeys": [], "uniqueConstraints": [], "check": [], "indexes": []}
        opened = self.code.find("(", m.end(), b)
        if opened < 0:
            return t
        for x, y in self.s.split(opened + 1, min(self.s.close(opened), b)):
            part, raw = self.code[x:y].strip(), self.s.text[x:y].strip()
            x += len(self.code[x:y]) - len(self.code[x:y].lstrip())
            named = re.match(rf"(?i)CONSTRAINT\s+({ID})\s+", part)
            name, body, shift = (clean(named[1]), part[named.end() :], named.end()) if named else (None, part, 0)
            head = re.match(r"(?i)(PRIMARY\s+KEY|FOREIGN\s+KEY|UNIQUE(?:\s+(?:KEY|INDEX))?|CHECK|(?:FULLTEXT\s+|SPATIAL\s+)?(?:INDEX|KEY))\b", body)
            if head:
                p = body.find("(")
                inside = body[p + 1 : self._end(body, p)] if p >= 0 else ""
                kind = re.sub(r"\s+", " ", head[1].lower())
                own = clean(k[1]) if (k := re.match(rf"\s*({ID})\s*\(", body[head.end() :])) else None
                con = {"constraintType": kind, "constraint": name or own, "definition": _names(inside)}
                if kind == "primary key":
                    t["primaryKey"].append(con)
                elif kind == "foreign key":
                    t["foreignKeys"].append(con | {"reference": self.reference(body)})
                elif kind.startswith("unique"):
                    t["uniqueConstraints"].append(con)
                elif kind == "check":
                    q = raw.find("(", shift)
                    t["check"].append(con | {"definition": [raw[q + 1 : raw.rfind(")")].strip()]})
                else:
                    t["indexes"].append({"name": own, "definition": con["definition"], "type": kind})
            elif c := re.match(rf"({ID})\s+([\w]+(?:\s+(?:VARYING|PRECISION|UNSIGNED))?)\s*(?:\(([^)]*)\))?", part, re.I):
                rest = part[c.end() :]
                col = {"name": clean(raw[c.start(1) : c.end(1)]), "type": c[2].upper(), "length": c[3].strip() if c[3] else None}
                d = re.search(r"(?i)\bDEFAULT\s+", rest)
                value = None
                if d:
                    tail = raw[c.end() + d.end() :]
                    v = re.match(r"'(?:[^']|'')*'|\([^)]*\)|[\w.+-]+(?:\([^)]*\))?", tail)
                    value = v[0] if v else None
                note = re.search(r"(?i)\bCOMMENT\s+'((?:[^']|'')*)'", raw[c.end() :])
                t["columns"].append(col | {
                    "nullable": not re.search(r"(?i)\bNOT\s+NULL\b", rest), "default": value, "autoIncrement": bool(re.search(r"(?i)\bAUTO_?INCREMENT\b|\bIDENTITY\b", rest)) or "SERIAL" in c[2].upper(),
                    "primary": bool(re.search(r"(?i)\bPRIMARY\s+KEY\b", rest)), "unique": bool(re.search(r"(?i)\bUNIQUE\b", rest)), "comment": note[1] if note else None,
                })
                if re.search(r"(?i)\bREFERENCES\b", rest):
                    t["foreignKeys"].append({"constraintType": "foreign key", "constraint": None, "definition": [col["name"]], "reference": self.reference(part)})
        return t

    @staticmethod
    def _end(text: str, opened: int) -> int:
        depth = 0
        for i in range(opened, len(text)):
            depth += (text[i] == "(") - (text[i] == ")")
            if not depth:
                return i
        return len(text)

    @staticmethod
    def reference(text: str) -> dict:
        m = re.search(rf"(?i)\bREFERENCES\s+({QID})\s*(?:\(([^)]*)\))?", text)
        act = lambda w: a[1].upper() if (a := re.search(rf"(?i)\bON\s+{w}\s+(CASCADE|RESTRICT|SET\s+NULL|SET\s+DEFAULT|NO\s+ACTION)", text)) else None
        return {"table": clean(m[1]) if m else None, "columns": _names(m[2] or "") if m else [], "onDelete": act("DELETE"), "onUpdate": act("UPDATE")}

    def parameters(self, a: int, b: int) -> list[dict]:
        m = re.compile(r"\s*(\()").match(self.code, a, b)
        if m:
            pieces = self.s.split(m.end(), self.s.close(m.start(1)))
        else:
            stop = re.compile(r"\b(AS|BEGIN|RETURNS|LANGUAGE)\b", re.I).search(self.code, a, b)
            pieces = self.s.split(a, stop.start() if stop else b)
        out = []
        for x, y in pieces:
            p = re.match(rf"(?i)\s*(?:(INOUT|IN|OUT)\s+)?({ID})\s+(\w+(?:\s*\([^)]*\))?)(?:.*?\b(OUTPUT|OUT)\b)?", self.code[x:y], re.S)
            if p and p[2].strip("`[]\"").upper() not in rules.NO_PARAMETERS:
                out.append({"mode": (p[1] or ("OUT" if p[4] else "IN")).upper(), "name": p[2].strip("`[]\""), "type": p[3]})
        return out

    def trigger(self, name: str, a: int, b: int) -> dict:
        text = self.code[a:b]
        if m := re.search(rf"(?i)\bON\s+({QID})\s+(?:OF\s+)?(BEFORE|AFTER|FOR|INSTEAD\s+OF)\s+(INSERT|UPDATE|DELETE)", text):
            return {"name": name, "timing": re.sub(r"\s+", "_", m[2].upper()), "event": m[3].upper(), "table": clean(m[1])}
        if m := re.search(rf"(?i)(BEFORE|AFTER|INSTEAD\s+OF)\s+(INSERT|UPDATE|DELETE)(?:\s+OF\s+[\w,\s]+?)?\s+ON\s+({QID})", text):
            return {"name": name, "timing": re.sub(r"\s+", "_", m[1].upper()), "event": m[2].upper(), "table": clean(m[3])}
        return {"name": name, "timing": None, "event": None, "table": None}

    def select(self, a: int, b: int) -> dict:
        """Clauses at the outer level of a query."""
        marks, i = [], a
        while i < b and (m := _CLAUSE.search(self.code, i, b)):
            if m[1] is None:
                i = self.s.close(m.start()) + 1
            else:
                marks.append((_BLANKS.sub(" ", m[1].upper()), m.start(), m.end()))
                i = m.end()
        out = {"columns": [], "from": [], "joins": [], "where": None, "groupBy": [], "having": None, "orderBy": [], "limit": None, "distinct": False}
        for k, (w, _, x) in enumerate(marks):
            y = marks[k + 1][1] if k + 1 < len(marks) else b
            raw = self.s.text[x:y].strip()
            if w == "UNION":
                break
            if w == "SELECT":
                d = _DISTINCT.match(self.code, x, y)
                out["distinct"] = bool(d and d[1])
                for p, q in self.s.split(d.end() if d else x, y):
                    t = self.s.text[p:q].strip()
                    al = _AS.match(t) or _ALIAS.match(t)
                    expr, alias = (al[1].strip(), clean(al[2])) if al else (t, None)
                    fn = _CALL.match(expr)
                    out["columns"].append({"column": fn[1] if fn else clean(expr) if _QID.fullmatch(expr) else expr, "alias": alias})
            elif w == "FROM":
                out["from"] += [clean(n[1]) for p, q in self.s.split(x, y) if (n := _NAMED.match(self.code, p, q))]
            elif w.endswith("JOIN"):
                n = _NAMED.match(self.code, x, y)
                out["joins"].append({"type": w, "table": clean(n[1]) if n else None, "on": None})
            elif w == "ON" and out["joins"]:
                out["joins"][-1]["on"] = raw
            elif w in ("WHERE", "HAVING"):
                out[w.lower()] = raw
            elif w in ("GROUP BY", "ORDER BY"):
                out["groupBy" if w[0] == "G" else "orderBy"] = [self.s.text[p:q].strip() for p, q in self.s.split(x, y)]
            elif w == "LIMIT":
                out["limit"] = raw
        return out

    def operations(self, a: int, b: int) -> list[dict]:
        out = []
        for x, y in self.s.split(a, b):
            t = self.code[x:y].strip()
            op = {"action": (t.split(None, 1) or [""])[0].lower(), "resource": "table"}
            if m := _CONSTRAINT_OP.match(t):
                is_con = bool(m[2] or m[3])
                if is_con:
                    p = t.find("(")
                    op |= {"resource": "constraint", "constraint": clean(m[2]), "constraintType": re.sub(r"\s+", " ", m[3].lower()) if m[3] else None, "columns": _names(t[p + 1 : self._end(t, p)]) if p >= 0 else []}
                    if m[3] and m[3].upper().startswith("FOREIGN"):
                        op["reference"] = self.reference(t)
                elif i := _INDEX_OP.match(t):
                    op |= {"resource": "index", "constraint": clean(i[3])}
                elif c := _COLUMN_OP.match(t):
                    op |= {"resource": "column", "column": clean(c[2]), "definition": c[3] if c[1].upper() == "ADD" else None, "nullable": not _NOT_NULL.search(t)}
            elif m := re.match(rf"(?i)(MODIFY|ALTER|CHANGE)\s+(?:COLUMN\s+)?({ID})\s*(.*)", t, re.S):
                op |= {"resource": "column", "column": clean(m[2]), "definition": m[3].strip() or None, "nullable": not _NOT_NULL.search(t)}
                if m[1].upper() == "CHANGE" and (n := re.match(rf"({ID})", m[3])):
                    op["newName"] = clean(n[1])
            elif m := re.match(rf"(?i)RENAME\s+COLUMN\s+({ID})\s+TO\s+({ID})", t):
                op |= {"resource": "column", "column": clean(m[1]), "newName": clean(m[2])}
            elif m := re.match(rf"(?i)RENAME\s+(?:TO|AS)?\s*({QID})", t):
                op |= {"newName": clean(m[1])}
            out.append(op)
        return out


def parse_sql(text: str) -> dict:
    kind = dialect(text)
    merged: dict[str, list] = {k: [] for k in KINDS}
    for part in batches(text) if kind == "transactsql" else [text]:
        for k, v in Reader(part).read().items():
            merged[k] += v
    merged["comments"] = comments(text)
    routines = [f | {"kind": "function", "async": False} for f in merged.pop("sqlFunctions")] + [p | {"kind": "procedure", "async": False} for p in merged["storedProcedures"]]
    functions = [{"name": f["name"], "kind": f["kind"], "params": [p["name"] for p in f["params"]], "async": False, "line": None, "returnType": f.get("returnType"), "routineParams": f["params"]} for f in routines]
    classes = [{"name": t["name"], "kind": "table", "extends": None, "methods": [], "line": None} for t in merged["tables"]]
    return _record(functions=functions, classes=classes, **merged) | {"detail": {"dialect": kind}}



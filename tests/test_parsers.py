"""Golden cases: content -> facts, one for each type; malformed texts by each type's policy."""

import pytest

from codestrata.parsers import parse_source
from codestrata.parsers.script import SyntaxProblem


def names(facts, kind):
    return [x["name"] for x in facts[kind]]


def test_markup_and_stylesheet():
    h = parse_source("markup", '<title>T</title><script src="a.js"></script><link href="b.css">')
    assert h["exports"] == [{"name": "T", "kind": "page-title"}] and [i["source"] for i in h["imports"]] == ["a.js", "b.css"]
    c = parse_source("stylesheet", '@import "x.css"; .a{--v:1} .a{} @keyframes k{}')
    assert [(e["name"], e["kind"]) for e in c["exports"]] == [("a", "class"), ("k", "class"), ("v", "css-variable")]


def test_javascript():
    f = parse_source("javascript", 'import e from "express"; export const f = async (a) => 1; app.get("/h", f)')
    assert f["imports"][0]["specifiers"] == [{"kind": "default", "imported": "e", "local": "e"}]
    assert [(x["name"], x["kind"], x["params"], x["async"]) for x in f["functions"]] == [("f", "arrow", ["a"], True)]
    assert f["routes"] == [{"method": "GET", "path": "/h", "line": 1}]
    g = parse_source("javascript", "// require('no')\nconst s = \"function x() {}\"; export default function(){}\nfunction y(){}")
    assert not g["imports"] and names(g, "functions") == ["y"] and names(g, "exports") == ["default"]


def test_python_keeps_a_record_of_a_broken_file():
    assert parse_source("python", "def (") == {"imports": [], "exports": [], "functions": [], "classes": [], "routes": []}
    f = parse_source("python", "@app.route('/r')\ndef g(a, *b): ...\nurlpatterns = [path('x/', v)]\n__all__ = ['g']\n_p = 1")
    assert [(r["method"], r["path"]) for r in f["routes"]] == [("ROUTE", "/r"), ("ANY", "x/")]
    assert names(f, "exports") == ["__all__", "g", "urlpatterns"]


@pytest.mark.parametrize("kind,text", [("javascript", "function ( {"), ("php", "<?php f( {"), ("xaml", "<a><b></a>"), ("csproj", "<Project/>"), ("config", "<x")])
def test_rejected(kind, text):
    with pytest.raises(SyntaxProblem):
        parse_source(kind, text)


@pytest.mark.parametrize("kind", ["markup", "stylesheet", "javascript", "typescript", "python", "php", "csharp", "java", "go", "rust", "c", "cpp", "ruby", "powershell", "ini", "sln", "sql", "cargotoml", "cargolock", "rusttoolchain", "cargoconfig"])
def test_empty(kind):
    f = parse_source(kind, "")
    assert all(not f[k] for k in ("imports", "exports", "functions", "classes", "routes"))


def test_unknown_type_has_no_facts():
    assert parse_source("nothing", "x") == {}


def test_typed_languages():
    j = parse_source("java", 'import a.B; public class C { @GetMapping("/x") public int m(int q){ return f(q); } public C(int z) {} }')
    assert names(j, "classes") == ["C"] and [m["name"] for m in j["classes"][0]["methods"]] == ["m"] and j["routes"][0]["path"] == "/x"
    g = parse_source("go", 'import f "fmt"\ntype S struct{}\nfunc (s *S) M(a int){}\nfunc Run(){ r.GET("/g", h) }')
    assert g["imports"][0]["alias"] == "f" and g["classes"][0]["methods"][0]["params"] == ["a"] and names(g, "exports") == ["S", "Run"]
    r = parse_source("rust", 'pub(crate) struct H; pub struct S; impl Tr for S { fn t() {} }')
    assert names(r, "exports") == ["S"] and r["classes"][1]["methods"][0]["name"] == "t"


def test_sql():
    s = parse_source("sql", "CREATE TABLE t (a INT PRIMARY KEY, b VARCHAR(3) NOT NULL, FOREIGN KEY (b) REFERENCES u (c)); -- n\nINSERT INTO t VALUES (1);")
    t = s["tables"][0]
    assert [c["name"] for c in t["columns"]] == ["a", "b"] and t["columns"][0]["primary"] and not t["columns"][1]["nullable"]
    assert t["foreignKeys"][0]["reference"]["table"] == "u" and s["comments"][0]["content"] == "n" and s["inserts"][0]["table"] == "t"
    assert parse_source("sql", "CREATE TABLE [dbo].[x] ([a] INT)\nGO\nPRINT 'GO'\nGO")["detail"] == {"dialect": "transactsql"}


def test_rust_macro_bodies_and_c_typedefs():
    r = parse_source("rust", "macro_rules! m { ($x:ident) => { pub fn no() {} struct No; } }\npub fn yes() {}")
    assert names(r, "functions") == ["yes"] and not r["classes"]
    c = parse_source("c", "typedef struct { int a; } T;\ntypedef struct N { int b; } N;\ntypedef struct P { int c; } Q;")
    assert [(e["name"], e["kind"]) for e in c["exports"]] == [("T", "type"), ("N", "type"), ("Q", "type"), ("P", "struct")]


def test_sql_behind_other_words():
    s = parse_source("sql", "SET NOCOUNT ON\nSELECT a FROM t\nWITH x AS (SELECT 1 a) SELECT b FROM x\nIF OBJECT_ID('n') IS NULL CREATE TABLE n (a INT)\nBEGIN TRAN\nINSERT INTO n (a) VALUES (1)\nCOMMIT\n-- GO")
    assert [x["from"] for x in s["selects"]] == [["t"], ["x"]] and names(s, "tables") == ["n"] and [x["table"] for x in s["inserts"]] == ["n"]
    many = ", ".join(f"@p{i} INT" for i in range(60))
    p = parse_source("sql", f"CREATE PROCEDURE q {many}\nAS SELECT 1\nGO")["storedProcedures"][0]
    assert len(p["params"]) == 60
    assert [x["name"] for x in parse_source("sql", "CREATE PROCEDURE r @a INT, @b INT, DECLARE INT")["storedProcedures"][0]["params"]] == ["@a", "@b"]
    assert parse_source("sql", "CREATE VIEW v AS\nSELECT a\nFROM t\nUNION\nSELECT b FROM u;\nINSERT INTO w (a)\nSELECT c FROM t;")["selects"] == []


@pytest.mark.parametrize("kind,text", [("sql", "INSERT INTO t (a) VALUES ('x;y');\n-- c\n"), ("javascript", "function f(a) { return g(a); }\napp.get('/x', f);\n"), ("python", "def f(a):\n    return a\n")])
def test_large_files_take_time_in_proportion(kind, text):
    import time

    took = []
    for n in (1000, 8000):
        t = time.process_time()
        parse_source(kind, text * n)
        took.append(time.process_time() - t)
    assert took[1] < 24 * max(took[0], 0.02)


def test_python_deep_expressions_and_levels():
    f = parse_source("python", "import a\ntry:\n    import b\nexcept E:\n    import c\nimport d\nx = " + "+".join(["1"] * 3000))
    assert [i["source"] for i in f["imports"]] == ["a", "d", "b", "c"] and names(f, "exports") == ["x"]

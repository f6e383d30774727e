"""Synthesised sources for the language queries: a text for each table row, and the facts it must yield.

The driver's tables hold no source code, so a template is filled from a row's columns and
parsed, while the oracle states the expected facts from the same columns without parsing.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.operators import parse
from codestrata.session import table

_HOLE = re.compile(r"<<(\w+)>>")


def spark_text(template: str) -> Column:
    parts = _HOLE.split(template)
    return F.concat(*[F.col(x).cast("string") if i % 2 else F.lit(x) for i, x in enumerate(parts)])


def sql_text(template: str) -> str:
    parts = _HOLE.split(template)
    return " || ".join(f"CAST({x} AS VARCHAR)" if i % 2 else "'" + x.replace("'", "''") + "'" for i, x in enumerate(parts))


class Case:
    def __init__(self, source: str, path: str, text: str, expected: list[tuple[str, str, str]]):
        self.source, self.path, self.text, self.expected = source, path, text, expected

    def files(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        holes = sorted({x for text in (self.path, self.text) for x in _HOLE.findall(text)})
        # the few columns a text is made of are spread, not texts; to several tasks a core, so that a slow one keeps no core waiting
        t = table(spark, sf_dir, self.source).select(*holes).repartition(4 * spark.sparkContext.defaultParallelism)
        return t.select(F.lit("r").alias("repo_id"), spark_text(self.path).alias("path"), spark_text(self.text).alias("content"))

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return parse.facts_of(self.files(spark, sf_dir)).select("file_path", "kind", "name", "extra")

    def sql(self) -> str:
        rows = ", ".join(f"{{'kind': '{k}', 'name': {sql_text(n)}, 'extra': {sql_text(e)}}}" for k, n, e in self.expected)
        return f"SELECT file_path, u.kind AS kind, u.name AS name, u.extra AS extra FROM (SELECT {sql_text(self.path)} AS file_path, unnest([{rows}]) AS u FROM {self.source})"


O, C, S, T = "o_orderkey", "c_custkey", "s_suppkey", "p_partkey"
k = f"<<{O}>>"
c = f"<<{C}>>"
s = f"<<{S}>>"
t = f"<<{T}>>"

CASES: dict[str, Case] = {
    "python": Case("orders", f"src/m{k}.py", f"import os.path as p{k}, sys\nfrom lib{k} import x, y as z\n\n@app.get('/o/{k}')\nasync def f_{k}(a, b):\n    return a\n\nclass C{k}(B{k}):\n    @app.post('/c/{k}')\n    def m(self, q=1): pass\n    async def n(self): pass\n\n_hidden = 1\nQ{k} = <<o_custkey>>\ndef _g(): pass\n", [
        ("import", "os.path", f"p{k}"), ("import", "sys", ""), ("import", f"lib{k}", ""), ("export", f"f_{k}", "module"), ("export", f"C{k}", "module"), ("export", f"Q{k}", "module"),
        ("function", f"f_{k}", "a,b"), ("function", "_g", ""), ("class", f"C{k}", f"B{k}"), ("method", "m", f"C{k}:self,q"), ("method", "n", f"C{k}:self"), ("route", f"/o/{k}", "GET"), ("route", f"/c/{k}", "POST")]),
    "javascript": Case("orders", f"src/m{k}.js", f"import d{k}, {{ a as b }} from \"pkg{k}\";\nconst p = require('./r{k}');\n// import x from 'no'\nexport const f{k} = async (x, {{ y }}) => `t${{x}}`;\nexport function g(u, v) {{ return \"function no() {{\"; }}\nexport class A{k} extends B {{\n  m(q) {{ return 1; }}\n  static async n() {{}}\n}}\nconst h = function (w) {{}};\nrouter.get(\"/v/{k}\", h).post('/w', h);\nexport {{ h as hh }};\nmodule.exports = {{ one, two: 2 }};\n", [
        ("import", f"pkg{k}", ""), ("import", f"./r{k}", ""), ("export", f"f{k}", "const"), ("export", "g", "function"), ("export", f"A{k}", "class"), ("export", "hh", "named"), ("export", "default", "cjs"), ("export", "one", "cjs"), ("export", "two", "cjs"),
        ("function", f"f{k}", "x,null"), ("function", "g", "u,v"), ("function", "m", "q"), ("function", "n", ""), ("function", "h", "w"), ("class", f"A{k}", "B"), ("method", "m", f"A{k}:q"), ("method", "n", f"A{k}:"), ("route", f"/v/{k}", "GET"), ("route", "/w", "POST")]),
    "typescript": Case("customer", f"src/m{c}.ts", f"import type {{ T }} from './t{c}';\nexport class A{c}<X> extends B<X> implements I {{\n  private z: number = 1;\n  constructor(private s: S, t?: string) {{ super(); }}\n  async m(x: Map<string, number>, y: string): Promise<void> {{ }}\n}}\nexport const f{c} = (a: number): string => 'x';\nexport interface I {{ q(): void }}\nexport function g<T>(t: T): T {{ return t }}\n", [
        ("import", f"./t{c}", ""), ("export", f"A{c}", "class"), ("export", f"f{c}", "const"), ("export", "g", "function"), ("function", "constructor", "s,t"), ("function", "m", "x,y"), ("function", f"f{c}", "a"), ("function", "g", "t"),
        ("class", f"A{c}", "B"), ("method", "constructor", f"A{c}:s,t"), ("method", "m", f"A{c}:x,y")]),
    "php": Case("customer", f"app/c{c}.php", f"<?php\nuse A\\B{c};\nuse X as Y;\nclass C{c} extends D {{\n  const K = {c};\n  private function m($x, $y = 1) {{ $z = 2; }}\n}}\nRoute::get('/p/{c}', 'x');\nfunction f{c}($a) {{ return $a; }}\n$top = 3;\n", [
        ("import", f"A\\B{c}", ""), ("import", "X", "Y"), ("export", f"C{c}", "class"), ("export", f"f{c}", "function"), ("export", "top", "variable"), ("function", f"f{c}", "a"), ("class", f"C{c}", "D"), ("method", "m", f"C{c}:x,y"), ("constant", "K", c), ("route", f"/p/{c}", "GET")]),
    "csharp": Case("customer", f"src/C{c}.cs", f"using System.Linq;\nusing X = A.B;\nnamespace N {{\n  [Route(\"api/{c}\")]\n  public class C{c} : Base {{\n    [HttpGet(\"{{id}}\")]\n    public int M(int a, List<string> b) {{ if (a > 1) {{ return Foo(a); }} return 0; }}\n    private async Task<int> N2() => 1;\n  }}\n  internal interface I{c} {{ void Q(string z); }}\n}}\n", [
        ("import", "System.Linq", ""), ("import", "A.B", "X"), ("export", f"C{c}", "class"), ("class", f"C{c}", ""), ("class", f"I{c}", ""), ("method", "M", f"C{c}:a,b"), ("method", "N2", f"C{c}:"), ("method", "Q", f"I{c}:z"), ("route", f"api/{c}", "ANY"), ("route", "{id}", "GET")]),
    "java": Case("customer", f"src/C{c}.java", f"package p;\nimport java.util.List;\nimport static a.B{c}.*;\n@RequestMapping(\"/r{c}\")\npublic class C{c} extends Base {{\n  public C{c}(int z) {{ }}\n  @GetMapping(\"/x\")\n  public List<String> m(int q, Map<String, Integer> w) {{ return foo(q); }}\n  enum E {{ A, B }}\n}}\n", [
        ("import", "java.util.List", ""), ("import", f"static a.B{c}.*", ""), ("export", f"C{c}", "class"), ("class", f"C{c}", ""), ("class", "E", ""), ("method", "m", f"C{c}:q,w"), ("route", f"/r{c}", "ANY"), ("route", "/x", "GET")]),
    "go": Case("customer", f"cmd/m{c}.go", f"package main\nimport (\n\tf \"fmt{c}\"\n\t\"os\"\n)\nfunc (s *S{c}) M(a int, b string) error {{ return nil }}\ntype S{c} struct {{ x int }}\ntype i{c} interface {{ Q() }}\nfunc Run{c}(z int) {{ r.GET(\"/g/{c}\", h) }}\nconst Max{c} = 1\n", [
        ("import", f"fmt{c}", "f"), ("import", "os", ""), ("export", f"S{c}", "struct"), ("export", f"Run{c}", "function"), ("export", f"Max{c}", "const_spec"), ("function", f"Run{c}", "z"), ("class", f"S{c}", ""), ("class", f"i{c}", ""), ("method", "M", f"S{c}:a,b"), ("route", f"/g/{c}", "GET")]),
    "rust": Case("customer", f"src/m{c}.rs", f"use a::b{c};\npub struct S{c} {{ x: i32 }}\nenum E{c} {{ A }}\nimpl S{c} {{\n    pub fn m(&self, x: i32, mut y: &str) -> i32 {{ 1 }}\n}}\nimpl Tr for S{c} {{ fn t() {{}} }}\n#[get(\"/r/{c}\")]\npub async fn h{c}(id: u8) {{}}\nfn private() {{ let c = 'x'; }}\n", [
        ("import", f"a::b{c}", ""), ("export", f"S{c}", "struct"), ("export", f"h{c}", "function"), ("function", f"h{c}", "id"), ("function", "private", ""), ("class", f"S{c}", ""), ("class", f"E{c}", ""), ("method", "m", f"S{c}:x,y"), ("method", "t", f"S{c}:"), ("route", f"/r/{c}", "GET")]),
    "c": Case("supplier", f"src/m{s}.c", f"#include <stdio.h>\n#include \"h{s}.h\"\n#define N{s} 1\nstruct P{s} {{ int a; char b; }};\nstatic int f{s}(int q, char *r) {{ if (q) {{ return g(0); }} return 1; }}\nint proto{s}(long z);\n", [
        ("import", "stdio.h", ""), ("import", f"h{s}.h", ""), ("export", f"N{s}", "define"), ("export", f"P{s}", "struct"), ("export", f"f{s}", "function"), ("export", f"proto{s}", "function"), ("function", f"f{s}", "q,r"), ("function", f"proto{s}", "z"), ("class", f"P{s}", ""), ("field", "a", f"P{s}"), ("field", "b", f"P{s}")]),
    "cpp": Case("supplier", f"src/m{s}.cpp", f"#include <vector>\nclass K{s} : public Base{s} {{\npublic:\n  void go(int z);\n  int v;\n}};\nvoid K{s}::go(int z) {{ foo(z); }}\nenum E{s} {{ A, B }};\n", [
        ("import", "vector", ""), ("export", f"K{s}", "class"), ("export", f"E{s}", "enum"), ("class", f"K{s}", f"Base{s}"), ("class", f"E{s}", ""), ("method", "go", f"K{s}:z"), ("field", "v", f"K{s}")]),
    "ruby": Case("supplier", f"lib/m{s}.rb", f"require 'json{s}'\nrequire_relative \"a\"\nclass A{s} < B\n  def m(x = 1, y)\n    if x then 1 end\n    return 2 unless y\n  end\nend\nmodule Empty; end\nget '/z/{s}' do\n  'ok'\nend\ndef top{s}(a)\nend\n", [
        ("import", f"json{s}", ""), ("import", "a", ""), ("function", f"top{s}", "a"), ("class", f"A{s}", "B"), ("method", "m", f"A{s}:x,y"), ("route", f"/z/{s}", "GET")]),
    "powershell": Case("supplier", f"m{s}.ps1", f"Import-Module \"Mod{s}\"\nfunction Get-F{s} {{\n  param([string]$a, $b)\n  if ($a) {{ return 1 }}\n}}\nclass C{s} : D {{\n  [int] M([string]$q) {{ return 1 }}\n}}\nExport-ModuleMember -Function Get-F{s}, Other\n", [
        ("import", f"Mod{s}", ""), ("export", f"Get-F{s}", "function"), ("export", "Other", "function"), ("function", f"Get-F{s}", "a,b"), ("class", f"C{s}", "D"), ("method", "M", f"C{s}:q")]),
    "ini": Case("customer", f"etc/c{c}.ini", f"; note\n[s{c}]\nname = <<c_name>>\nseg=<<c_mktsegment>>\n[other]\nx: 1\n", [("key", f"s{c}.name", "<<c_name>>"), ("key", f"s{c}.seg", "<<c_mktsegment>>"), ("key", "other.x", "1")]),
    "sln": Case("supplier", f"S{s}.sln", f"Project(\"{{FAE04EC0-301F-11D3-BF4B-00C04F79EFBC}}\") = \"W{s}\", \"src\\W{s}.csproj\", \"{{G}}\"\nEndProject\nProject(\"{{00000000-0000-0000-0000-000000000000}}\") = \"U\", \"u.x\", \"{{H}}\"\nEndProject\n", [
        ("import", f"src/W{s}.csproj", ""), ("import", "u.x", ""), ("project", f"W{s}", f"src/W{s}.csproj C#"), ("project", "U", "u.x Unknown")]),
    "csproj": Case("part", f"P{t}.csproj", f"<Project Sdk=\"Microsoft.NET.Sdk\"><PropertyGroup><TargetFramework>net<<p_size>></TargetFramework><OutputType>Exe</OutputType></PropertyGroup><ItemGroup><PackageReference Include=\"Pkg{t}\" Version=\"<<p_size>>.1\" /><ProjectReference Include=\"..\\x\\y.csproj\" /></ItemGroup></Project>", [
        ("import", f"Pkg{t}@<<p_size>>.1", ""), ("import", "../x/y.csproj", ""), ("package", f"Pkg{t}", "<<p_size>>.1"), ("framework", "net<<p_size>>", "Microsoft.NET.Sdk")]),
    "config": Case("part", f"w{t}/Web.config", f"<?xml version=\"1.0\"?><configuration><connectionStrings><add name=\"db{t}\" connectionString=\"Server=<<p_size>>\" providerName=\"q\"/></connectionStrings><appSettings><add key=\"size\" value=\"<<p_size>>\"/></appSettings></configuration>", [
        ("connection", f"db{t}", "Server=<<p_size>>"), ("setting", "size", "<<p_size>>")]),
    "xaml": Case("part", f"V{t}.xaml", f"<?xml version=\"1.0\"?>\n<Window x:Class=\"N.W{t}\" xmlns:x=\"http://schemas.microsoft.com/winfx/2006/xaml\"><Grid><Button x:Name=\"b{t}\" Click=\"On{t}\"/></Grid></Window>", [
        ("class", f"N.W{t}", "Window"), ("function", f"On{t}", ""), ("component", f"b{t}", "Button<Grid")]),
    "cargo_toml": Case("part", f"c{t}/Cargo.toml", f"[package]\nname = \"p{t}\"\nversion = \"<<p_size>>.0.0\"\n[dependencies]\nserde = \"1.<<p_size>>\"\ntokio = {{ version = \"2\", features = [\"full\"] }}\n[dev-dependencies]\nd{t} = {{ path = \"../d\" }}\n[features]\ndefault = [\"a\", \"b\"]\n", [
        ("import", "serde@1.<<p_size>>", ""), ("import", "tokio@2", ""), ("import", f"d{t}@workspace", ""), ("dependency", "serde", "1.<<p_size>>"), ("dependency", "tokio", "2"), ("dev-dependency", f"d{t}", ""), ("feature", "default", "a,b")]),
    "cargo_lock": Case("part", f"c{t}/Cargo.lock", f"version = 3\n[[package]]\nname = \"dep{t}\"\nversion = \"1.0\"\nsource = \"registry\"\n[[package]]\nname = \"own{t}\"\nversion = \"<<p_size>>.0\"\ndependencies = [\"dep{t} 1.0\"]\n", [
        ("import", f"dep{t}@1.0", ""), ("import", f"own{t}@<<p_size>>.0", ""), ("locked", f"dep{t}", "1.0"), ("locked", f"own{t}", "<<p_size>>.0"), ("root", f"own{t}", "")]),
    "rust_toolchain": Case("part", f"c{t}/rust-toolchain.toml", "[toolchain]\nchannel = \"1.<<p_size>>\"\ncomponents = [\"rustfmt\", \"clippy\"]\n", [("toolchain", "1.<<p_size>>", "rustfmt,clippy")]),
    "cargo_config": Case("part", f"c{t}/.cargo/config.toml", f"[alias]\nb{t} = \"build\"\nr = [\"run\", \"--release\"]\n[registries.my]\nindex = \"https://x/{t}\"\n", [("registry", "my", f"https://x/{t}"), ("alias", f"b{t}", "build"), ("alias", "r", "run --release")]),
    "sql_ddl": Case("part", f"db/t{t}.sql", f"CREATE TABLE IF NOT EXISTS `t{t}` (\n  id INT AUTO_INCREMENT,\n  n VARCHAR(<<p_size>>) NOT NULL DEFAULT 'a,b;c',\n  price DECIMAL(10,2),\n  PRIMARY KEY (id),\n  UNIQUE KEY u (n),\n  CONSTRAINT fk FOREIGN KEY (n) REFERENCES brand (k, j) ON DELETE CASCADE\n);\nCREATE UNIQUE INDEX ix{t} ON t{t} (n, price);\nCREATE OR REPLACE VIEW v{t} AS SELECT id FROM t{t};\nCREATE DATABASE d{t};\n", [
        ("class", f"t{t}", ""), ("table", f"t{t}", "id INT,n VARCHAR not null,price DECIMAL"), ("primary key", f"t{t}", "id"), ("unique", f"t{t}", "n"), ("foreign key", f"t{t}", "n->brand(k,j) on delete CASCADE"), ("index", f"ix{t}", f"t{t}(n,price)"), ("view", f"v{t}", f"SELECT id FROM t{t}"), ("database", f"d{t}", "")]),
    "sql_dml": Case("orders", f"db/o{k}.sql", f"INSERT INTO t{k} (a, b) VALUES (1, 'x;y');\nUPDATE t{k} SET a = 1, b = 'q' WHERE id = {k};\nDELETE FROM t{k} WHERE a = {k};\nSELECT a, COUNT(*) AS n FROM t{k} JOIN u ON t{k}.i = u.i WHERE a > 1 GROUP BY a ORDER BY a LIMIT 3;\nALTER TABLE t{k} ADD COLUMN z INT NOT NULL, DROP COLUMN q;\nDROP TABLE IF EXISTS a{k}, b;\n-- note {k}\n/* many */\n", [
        ("insert", f"t{k}", "a,b"), ("update", f"t{k}", "a=1,b='q'"), ("delete", f"t{k}", f"a = {k}"), ("select", f"t{k}", "a,COUNT as n limit 3"), ("alter", f"t{k}", "add column z"), ("alter", f"t{k}", "drop column q"), ("drop", f"a{k},b", "table"), ("comment", f"note {k}", "single-line:7"), ("comment", "many", "multi-line:8")]),
    "sql_routines": Case("customer", f"db/r{c}.sql", f"CREATE PROCEDURE p{c}(IN a INT, OUT b VARCHAR(3))\nBEGIN\n  SELECT 1;\nEND;\nCREATE FUNCTION f{c}(x INT) RETURNS INT\nBEGIN\n  RETURN 1;\nEND;\nCREATE TRIGGER tr{c} BEFORE INSERT ON t FOR EACH ROW BEGIN SET @x = 1; END;\n", [
        ("function", f"f{c}", "x"), ("function", f"p{c}", "a,b"), ("procedure", f"p{c}", "IN a INT,OUT b VARCHAR(3)"), ("routine", f"f{c}", "IN x INT -> INT"), ("routine", f"p{c}", "IN a INT,OUT b VARCHAR(3)"), ("trigger", f"tr{c}", "BEFORE INSERT t")]),
    "sql_batches": Case("customer", f"db/g{c}.sql", f"CREATE TABLE [dbo].[x{c}] ([a] VARCHAR(MAX), b INT IDENTITY(1,1) NOT NULL)\nGO\nPRINT 'done'\nGO\nCREATE TABLE y{c} (q INT)\ngo\n", [
        ("class", f"x{c}", ""), ("class", f"y{c}", ""), ("table", f"x{c}", "a VARCHAR,b INT not null"), ("table", f"y{c}", "q INT")]),
    "sql_fallback": Case("customer", f"db/f{c}.sql", f"SET NOCOUNT ON\nBEGIN TRAN\nIF OBJECT_ID('t{c}') IS NULL CREATE TABLE [t{c}] (a INT)\nINSERT INTO u{c} (b)\nSELECT q FROM w WHERE x IN (SELECT 1 FROM n)\nUPDATE u{c}\nSET b = 1\nWHERE b = {c}\nIF NOT EXISTS (SELECT 1 FROM n) INSERT INTO n (a) VALUES ({c})\nCOMMIT\nGO\nWITH z AS (SELECT 1 a), y AS (SELECT 2 b) SELECT a FROM z JOIN y ON 1 = 1;\nEXEC p{c} 'INSERT INTO no'\nDROP TABLE IF EXISTS old{c}\nCREATE VIEW v{c} AS\nSELECT a FROM t{c}\nGO\nCREATE PROCEDURE q{c} @a INT, @b VARCHAR(3) OUTPUT\nAS\nBEGIN\n  INSERT INTO inner{c} (a) VALUES (1);\nEND\nGO\n", [
        ("class", f"t{c}", ""), ("table", f"t{c}", "a INT"), ("insert", f"u{c}", "b"), ("update", f"u{c}", "b=1"), ("insert", "n", "a"), ("select", "z", "a"), ("drop", f"old{c}", "table"), ("view", f"v{c}", f"SELECT a FROM t{c}"),
        ("function", f"q{c}", "@a,@b"), ("procedure", f"q{c}", "IN @a INT,OUT @b VARCHAR(3)"), ("routine", f"q{c}", "IN @a INT,OUT @b VARCHAR(3)")]),
    "python_awkward": Case("orders", f"lib/a{k}.py", f"\"\"\"def no{k}(): pass\"\"\"\ntry:\n    import fast{k}\nexcept ImportError:\n    from . import slow as s{k}\n\n@cache(1)\n@app.route('/r/{k}', methods=['GET'])\ndef outer_{k}(a, /, b, *c, d=1, **e):\n    import inner{k}\n    def nested(): pass\n    class Local: pass\n\nclass _P{k}(a.B, metaclass=M):\n    x = 1\n    class In:\n        def no(self): pass\n    if x:\n        def also_no(self): pass\n    @bp.get()\n    def m(self): pass\n\n__all__ = ['q']\nurlpatterns = [path('u/{k}', v), re_path(r'^x$', v), other('no')]\nA{k} = B = 2\n", [
        ("import", f"fast{k}", ""), ("import", "", ""), ("import", f"inner{k}", ""), ("export", "__all__", "module"), ("export", f"outer_{k}", "module"), ("export", "urlpatterns", "module"), ("export", f"A{k}", "module"), ("export", "B", "module"),
        ("function", f"outer_{k}", "b"), ("class", f"_P{k}", "a.B"), ("method", "m", f"_P{k}:self"), ("route", f"/r/{k}", "ROUTE"), ("route", "/", "GET"), ("route", f"u/{k}", "ANY"), ("route", "^x$", "ANY")]),
    "javascript_awkward": Case("orders", f"src/w{k}.js", f"/* function no{k}() {{}} */\nconst s = \"class No{k} {{}}\", t = `export ${{a}} function no() {{}}`; // require('no')\nexport * from './all{k}';\nexport {{ default as d{k}, x }} from \"./y{k}\";\nclass A{k} {{ constructor(a, {{ b }}, ...c) {{}} async *gen() {{ if (a) {{ go(); }} }} static s() {{}} }}\nrouter.get('/a/{k}', (q, r) => r.get(x)).post(\"/b\", h);\nexports.e{k} = function (z) {{}};\n", [
        ("export", "*", "re-export-all"), ("export", f"d{k}", "re-export"), ("export", "x", "re-export"), ("export", f"e{k}", "cjs"), ("class", f"A{k}", ""), ("function", "constructor", "a,null,null"), ("function", "gen", ""), ("function", "s", ""),
        ("method", "constructor", f"A{k}:a,null,null"), ("method", "gen", f"A{k}:"), ("method", "s", f"A{k}:"), ("route", f"/a/{k}", "GET"), ("route", "/b", "POST")]),
    "stylesheet": Case("part", f"css/p{t}.css", f"@import \"b<<p_size>>.css\";\n.p-{t} {{ --v-<<p_size>>: 1; }}\n.p-{t} {{ color: red }}\n@keyframes k{t} {{ }}\n", [("import", "b<<p_size>>.css", ""), ("export", f"p-{t}", "class"), ("export", f"k{t}", "class"), ("export", "v-<<p_size>>", "css-variable")]),
}

"""The parse stage over many files: what it keeps in memory, and rows made where texts are parsed."""

import re
import subprocess
import sys
from pathlib import Path

import pytest

from codestrata.operators import parse, report
from codestrata.parsers import apart, parse_source
from codestrata.plans.templates import CASES

GROWTH = """
import sys
import pyarrow as pa
from codestrata.operators import parse
from codestrata.parsers import registry

def batch(n):
    texts = [f"class C{n}_{i}(B{n}_{i}): pass\\nv{n}_{i} = w{n}_{i}\\n" for i in range(2000)]
    column = lambda x: pa.array([x] * len(texts))
    return pa.RecordBatch.from_arrays([column("r"), column("m.py"), column("python"), pa.array(texts)], names=["repo_id", "path", "type", "content"])

size = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096 >> 20
run = parse.%s(dict(registry.PARSERS))
for _ in run(batch(n) for n in range(3)):
    pass
before = size()
for _ in run(batch(n) for n in range(3, 43)):
    pass
print(size() - before)
"""


@pytest.mark.parametrize("batches", ["_parse_batches", "_count_batches", "_row_batches"])
def test_a_worker_does_not_grow_with_the_sources_it_has_seen(batches):
    repo = Path(__file__).resolve().parents[1]
    out = subprocess.run([sys.executable, "-c", GROWTH % batches], cwd=repo, capture_output=True, text=True, timeout=120, check=True)
    assert int(out.stdout) < 8  # MB; with 320,000 names kept for good it was 13


def test_the_process_beside_is_replaced_and_says_what_went_wrong():
    import os

    a = apart.Apart(lambda x: [os.getpid(), 1 // x], most=10)
    first = a(6, 1)[0]
    assert first != os.getpid() and a(6, 1)[0] == first and a(1, 1)[0] != first
    with pytest.raises(RuntimeError, match="ZeroDivisionError"):
        a(1, 0)
    assert a(1, 1)[1] == 1
    a.close()
    gone = apart.Apart(lambda: os._exit(3))
    with pytest.raises(apart.Ended):
        gone(1)


def test_rows_made_in_the_parse_pass_are_those_of_the_typed_records(spark):
    from pyspark.sql import functions as F

    texts = [(c.path, c.text) for c in CASES.values()] + [("e/a.js", None), ("e/b.js", "f({"), ("e/c.py", "def ("), ("e/d.html", "<title>T</title><script src='x.js'></script>"), ("e/e.sql", "CREATE TABLE t (a INT REFERENCES u); DELETE FROM x; DROP TABLE a, b; SELECT DISTINCT q.* FROM t"), ("node_modules/f.js", "export const a = 1")]
    rows = [("r", re.sub(r"<<(\w+)>>", "7", p), None if t is None else re.sub(r"<<(\w+)>>", "7", t)) for p, t in texts]
    rows += [("r", f"x/{i}.{p.rsplit('.', 1)[-1]}", t and t[: len(t) * i // 5]) for i in range(1, 5) for _, p, t in list(rows)]
    files = spark.createDataFrame(rows, "repo_id string, path string, content string")
    made, typed = parse.facts_of(files), parse.fact_table(parse.records(parse.parse_files(files)))
    assert made.columns == typed.columns
    order = lambda d: sorted(tuple(r) for r in d.collect())
    assert order(made) == order(typed) and made.filter(F.col("kind") == "export").count() > 50


def test_facts_need_no_json_and_routes_no_second_parse(spark, sf):
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    for name in ("python", "javascript", "sql_dml", "javascript_awkward", "python_awkward"):
        assert "from_json" not in plan(CASES[name].run(spark, sf))
    lines = plan(report.route_lines(parse.in_order(parse.records(parse.parse_files(CASES["python"].files(spark, sf))))).select("line"))
    assert "Join" not in lines


@pytest.mark.parametrize("name", ["sql_dml", "javascript", "javascript_awkward"])
def test_no_pattern_is_put_together_while_a_text_is_read(name, monkeypatch):
    text, kind = re.sub(r"<<(\w+)>>", "7", CASES[name].text), "sql" if name.startswith("sql") else "javascript"
    want, used = parse_source(kind, text), []
    compile_ = re._compile
    monkeypatch.setattr(re, "_compile", lambda p, f: used.append(p) or compile_(p, f))
    assert parse_source(kind, text) == want and len(used) <= 4


def test_comments_stay_out_of_values_and_words_stand_alone():
    f = parse_source("sql", "INSERT INTO t (a) VALUES /* c */ (1);\n\n GO \nSELECT \"x y\", 'a''b' FROM \"t\" WHERE a = '(';")
    assert f["inserts"][0]["values"] == "(1)" and f["selects"][0]["from"] == ["t"] and f["detail"]["dialect"] == "transactsql"
    g = parse_source("javascript", "const a = /x'/g, b = `${'x'}`;\nexport async function f(p, { q }) {}\nxasync function h() {}\nfoo.export\n")
    assert [(x["name"], x["async"], x["params"]) for x in g["functions"]][0] == ("f", True, ["p", None]) and len(g["exports"]) == 1

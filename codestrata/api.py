"""analyze(): one call from an input to its report or documents."""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from codestrata import rules
from codestrata.operators import enhance, parse, report
from codestrata.sources import repositories as R


@dataclass
class Analysis:
    files: DataFrame
    parsed: DataFrame

    def stats(self) -> DataFrame:
        return parse.project_stats(parse.records(self.parsed))

    def text(self) -> DataFrame:
        return report.text_report(self.files, self.parsed)

    def readme(self) -> DataFrame:
        return report.markdown_readme(self.files, self.parsed, self.files)

    def modules(self) -> DataFrame:
        return report.module_docs(self.files, self.parsed)

    def errors(self) -> DataFrame:
        return parse.parse_errors(self.parsed)


def sensitive(path: str) -> bool:
    p = os.path.abspath(os.path.expanduser(path))
    return any(p == s or p.startswith(s + "/") for s in rules.SENSITIVE)


def is_remote(source: str) -> bool:
    return bool(re.match(r"(?i)(https?|git|ssh)://|[\w.-]+@[\w.-]+:[\w./-]+$", source))


def validated(source: str | None) -> str:
    """The input without blanks around it: a remote address, a zip archive or a path that is not in a sensitive place."""
    text = (source or "").strip()
    if not text:
        raise R.InputError("an address or a path is needed")
    if not is_remote(text) and sensitive(text):
        raise R.InputError(f"{text} is a sensitive place")
    return text


def load(spark: SparkSession, source: str) -> DataFrame:
    """files of a zip, a remote repository or a directory, within the limits in rules; sizes are judged before a text is read."""
    source = validated(source)
    if source.endswith(".zip"):
        return R.from_archives(spark, source)
    if is_remote(source):
        # cloned on the driver's machine, which no executor sees: texts (bounded by the limits) travel with the plan
        found: list[DataFrame] = []
        R.clone(source, then=lambda folder: found.append(R.from_driver(spark, folder, source)))
        return found[0]
    return R.from_directory(spark, source)


def of_files(files: DataFrame) -> Analysis:
    """An analysis of files(repo_id, path, size, content); the parse result is kept, as every section reads it."""
    return Analysis(files, parse.parse_files(files).persist())


def save_report(text: str, folder: str, name: str = "analysis") -> str:
    """The text report as <folder>/<name>.txt; its path."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{os.path.basename(name)}.txt")
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def analyze(spark: SparkSession, source: str, format: str = "txt", language: str = "en", model: Callable[[str], str] | None = None, out: str | None = None) -> str | dict:
    """The text report, or {readme, modules} for format "md"; written below `out` if given. A model that fails leaves the plain text."""
    a = of_files(load(spark, source))
    try:
        if format == "txt":
            row = enhance.enhanced(a.text(), model, "txt", language).first()
            text = row["report"] if row else ""
            if out:
                save_report(text, out)
            return text
        readme = enhance.enhanced(a.readme(), model, "md-enhancer", language).first()
        docs = [(r["name"], r["content"]) for r in enhance.enhanced(a.modules(), model, "md-enhancer", language, "content").orderBy("name").collect()]
        result = {"readme": readme["report"] if readme else "", "modules": docs}
        if out:
            R.write_docs(result["readme"], docs, out)
        return result
    finally:
        a.parsed.unpersist()

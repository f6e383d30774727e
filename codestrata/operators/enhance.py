"""Optional text enhancement by an injected function; any failure keeps the plain text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.functions import mdpost

LANGUAGES = {"en": "English", "es": "Spanish"}


def prompt(text: str, kind: str, language: str = "en") -> str:
    """What the function is asked: a summary of a plain report, a README from one, or a better-worded Markdown document."""
    tongue = LANGUAGES.get(language, language)
    ask = {
        "txt": "Summarise the analysis below for a developer who is new to the project, as plain text.",
        "md": "Write a README in Markdown from the analysis below.",
        "md-enhancer": "Improve the wording of the Markdown document below. Keep its headings, tables and facts.",
    }[kind]
    return f"{ask} Answer in {tongue}. State nothing that is not in it.\n\n{text}"


def enhanced(reports: DataFrame, model: Callable[[str], str] | None, kind: str = "txt", language: str = "en", column: str = "report") -> DataFrame:
    """reports with `column` enhanced; without a model it is returned as it is."""
    if model is None:
        return reports
    at = reports.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(at).to_pylist():
                try:
                    out.append(model(prompt(text, kind, language)) or text)
                except Exception:  # the model is foreign code: whatever it raises, the plain text stands
                    out.append(text)
            arrays = list(b.columns)
            plain = arrays[at]
            arrays[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([*arrays, plain], names=[*b.schema.names, "plain__"])

    raw = reports.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in reports.schema.fields) + ", plain__ string")
    if kind == "txt":
        done = F.when(F.col(column) == F.col("plain__"), F.col(column)).otherwise(mdpost.clean_markdown(F.col(column)))
        return raw.withColumn(column, done).select(*reports.columns)
    unfenced = raw.withColumn(column, mdpost.strip_fence(F.col(column)))

    def fix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, plain = b.column(at).to_pylist(), b.column("plain__").to_pylist()
            arrays = list(b.columns)[:-1]
            arrays[at] = pa.array([t if t == p else mdpost.post_process(t, p) for t, p in zip(texts, plain)], pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=b.schema.names[:-1])

    return (unfenced.mapInArrow(fix, reports.schema) if kind == "md-enhancer" else unfenced).select(*reports.columns)

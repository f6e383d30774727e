"""Parsers for SQL: parse_source(kind, content) gives a record as JSON, source_facts(kind, content) a row for each named fact.

A text that its parser rejects gives null and no row.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from codestrata.operators.parse import COUNTED
from codestrata.parsers import registry
from codestrata.parsers.apart import LEAVES, Apart, Ended

_beside = Apart(registry.parse_source)


def parsed(kind: str | None, content: str | None) -> dict | None:
    try:
        if kind in LEAVES:
            return _beside(len(content or ""), kind, content or "")
        return registry.parse_source(kind or "", content or "")
    except Ended:
        raise
    except Exception:  # whatever a parser raises is the text's fault
        return None


def _record(kind: pd.Series, content: pd.Series) -> pd.Series:
    found = [parsed(k, c) for k, c in zip(kind, content)]
    return pd.Series([None if x is None else json.dumps(x, ensure_ascii=False) for x in found], dtype=object)


class SourceFacts:
    def eval(self, kind: str, content: str):
        record = parsed(kind, content) or {}
        for k in COUNTED:
            for fact in record.get(k) or ():
                yield k, fact.get("name") or fact.get("source") or fact.get("spec") or fact.get("path") or fact.get("table"), fact.get("line")


def register(spark: SparkSession) -> None:
    """Both functions in the session."""
    spark.udf.register("parse_source", F.pandas_udf(_record, "string"))
    spark.udtf.register("source_facts", F.udtf(SourceFacts, returnType="kind string, name string, line int"))

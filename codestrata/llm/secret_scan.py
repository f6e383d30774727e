"""Secret scans: format rules plus a randomness test battery.

Base spans come from three formats (assignments, access keys, hexadecimal runs). The
battery looks at other long tokens: an encoding is inferred (hexadecimal, base 32, base 64),
and three tests ask whether the token looks like uniform random text in its alphabet:
chi-squared uniformity over groups of letters, a runs test about the alphabet's median,
and lag-one serial correlation. The three p-values combine by their smallest (Sidak).

Random tokens have uniform combined p-values, other tokens pile up near 0. Per length
class and encoding, the share of non-random tokens above a threshold t is estimated from
all candidates of the corpus (Storey: the upper half of p-values belongs to random
tokens; their number is taken one standard deviation low), and the smallest t is taken at
which that share is at most ``FDR``: short classes, where tests have little power, need a
higher p-value. A class too scarce to show it keeps t = 0.5, where none is expected; a class
without p-values there yields nothing.

Two passes: the first writes candidates (not texts) and counts p-values in ``BINS`` bins per
class, a table of bounded size; the second applies the thresholds.

Edge cases: null and empty texts have no spans; offsets are code points, end exclusive;
repeated rows are scanned each; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm.shared import written

# The base formats of the contract.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
FDR = 0.05
BINS = 100
LENGTHS = (20, 24, 32, 40, 64, 128, 1 << 30)
ENCODINGS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
_PLACE = {n: {c: i for i, c in enumerate(a)} for n, a in ENCODINGS.items()}


def encoding_of(token: str) -> str | None:
    """The smallest alphabet that holds the token; words of one case and numbers are none."""
    body = token.rstrip("=")
    seen = set(body)
    for name, place in _PLACE.items():
        if seen <= place.keys():
            return name
    return None


def _upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _chi2_tail(x: float, df: int) -> float:
    """Wilson-Hilferty."""
    return _upper_tail(((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))


def battery(token: str, encoding: str) -> float:
    """Combined p-value that the token is uniform random text in its alphabet."""
    place, size = _PLACE[encoding], len(ENCODINGS[encoding])
    v = [place[c] for c in token.rstrip("=")]
    n = len(v)
    # uniformity over classes of letters that the alphabet's use by people would favour, each expected 4 times or more
    classes = max(2, min(size, n // 4, 8))
    count = [0] * classes
    weight = [0] * classes
    order = _ORDER[encoding]
    for i in range(size):
        weight[i * classes // size] += 1
    for x in v:
        count[order[x] * classes // size] += 1
    chi = sum((c - n * w / size) ** 2 / (n * w / size) for c, w in zip(count, weight))
    p1 = _chi2_tail(chi, classes - 1)
    # runs about the median of the alphabet
    up = [x * 2 >= size for x in v]
    a, b = sum(up), n - sum(up)
    runs = 1 + sum(x != y for x, y in zip(up, up[1:]))
    if a and b:
        mean = 1 + 2 * a * b / n
        var = max(1e-9, (mean - 1) * (mean - 2) / (n - 1))
        p2 = 2 * _upper_tail(abs(runs - mean) / math.sqrt(var))
    else:
        p2 = 2.0 ** (1 - n)
    # lag-one serial correlation
    m = sum(v) / n
    d = [x - m for x in v]
    s2 = sum(x * x for x in d)
    r = sum(x * y for x, y in zip(d, d[1:])) / s2 if s2 else 1.0
    p3 = 2 * _upper_tail(abs((r + 1 / n) * math.sqrt(n)))
    low = min(1.0, max(1e-12, min(p1, p2, p3)))
    return 1 - (1 - low) ** 3


def _frequency_order(alphabet: str) -> list[int]:
    """Rank of each letter of the alphabet: digits and signs, capitals, then small letters by how common they are in prose."""
    common = "etaoinshrdlucmfwypvbgkjxqz"
    key = {c: (2, common.index(c)) if c in common else (1, common.index(c.lower())) if c.lower() in common else (0, ord(c)) for c in alphabet}
    ranked = sorted(alphabet, key=key.get)
    return [ranked.index(c) for c in alphabet]


_ORDER = {n: _frequency_order(a) for n, a in ENCODINGS.items()}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, order of kind, end) of the base formats."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _united(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of sorted spans, overlapping ones as one."""
    out: list[tuple[int, int]] = []
    for s, _, e in spans:
        if out and s < out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


KINDS = ("assign", "access", "hex", "random")
FOUND = "doc_id long, base array<struct<start:long,kind:int,end:long>>, candidates array<struct<start:long,kind:int,end:long,cls:string,p:double>>"
_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
_CAND = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("cls", pa.string()), ("p", pa.float64())])
#: Cheap necessary conditions, for whole columns at once.
QUICK = r"(?i:(password|passwd|secret|token|api_?key)[\"']?\x20*[:=])|[0-9a-zA-Z+/_-]{20}|AKIA[A-Z0-9]{12}"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pyarrow.compute as pc

    for batch in batches:
        column = batch.column("text").fill_null("")
        maybe = pc.match_substring_regex(column, QUICK).to_pylist()
        base_out, cand_out = [[] for _ in maybe], [[] for _ in maybe]
        for i in [i for i, x in enumerate(maybe) if x]:
            text = column[i].as_py()
            base = base_spans(text)
            base_out[i] = [{"start": s, "kind": k, "end": e} for s, k, e in base]
            taken, k = _united(base), 0
            for m in CANDIDATE.finditer(text):
                s, e = m.span()
                while k < len(taken) and taken[k][1] <= s:
                    k += 1
                if k < len(taken) and taken[k][0] < e:
                    continue
                name = encoding_of(m[0])
                if name is None or not any(c.isdigit() for c in m[0]) and m[0].lower() == m[0]:
                    continue
                length = next(k for k, top in enumerate(LENGTHS[1:]) if e - s < top)
                cand_out[i].append({"start": s, "kind": 3, "end": e, "cls": f"{name}:{LENGTHS[length]}", "p": battery(m[0], name)})
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base_out, pa.list_(_SPAN)), pa.array(cand_out, pa.list_(_CAND))], names=["doc_id", "base", "candidates"])


def thresholds(histogram: list[tuple[str, int, int]], fdr: float = FDR) -> dict[str, float]:
    """Class -> smallest p-value at which the estimated share of non-random tokens is at most fdr. histogram: (class, bin, count)."""
    bins: dict[str, np.ndarray] = {}
    for cls, b, k in histogram:
        bins.setdefault(cls, np.zeros(BINS))[b] += k
    out: dict[str, float] = {}
    for cls, n in bins.items():
        upper = n[BINS // 2 :].sum()
        if not upper:
            continue
        # random tokens a bin, one standard deviation below what the upper half shows
        random = max(0.0, upper - math.sqrt(upper)) / (BINS - BINS // 2)
        above = np.cumsum(n[::-1])[::-1][: BINS // 2]
        ok = np.flatnonzero(above - random * (BINS - np.arange(BINS // 2)) <= fdr * above)
        out[cls] = (int(ok[0]) if len(ok) else BINS // 2) / BINS
    return out


def scan(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, base, spans: arrays of (start, kind, end), in order."""
    found = written(spark, docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scan, FOUND), "secrets")
    each = found.select(F.explode("candidates").alias("c")).select("c.cls", F.least(F.floor(F.col("c.p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"))
    rows = each.groupBy("cls", "bin").count().collect()  # at most classes x bins rows
    limit = thresholds([tuple(r) for r in rows])
    # the thresholds as a map: null (no threshold) rejects
    table = F.create_map(*[F.lit(x) for kv in sorted(limit.items()) for x in kv]) if limit else None
    kept = F.filter("candidates", lambda c: F.coalesce(c["p"] >= table[c["cls"]], F.lit(False))) if limit else F.filter("candidates", lambda c: F.lit(False))
    plain = F.transform(kept, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    return found.select("doc_id", "base", F.array_sort(F.concat("base", plain)).alias("spans"))


def joined(spans) -> object:
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: str, spans: list[tuple[int, int]], mark: str = "[secret]") -> str:
    """text with each span (overlaps merged) replaced."""
    out, at = [], 0
    for s, e in sorted(spans):
        if e <= at:
            continue
        out += [text[at : max(s, at)], mark] if s >= at else []
        at = e
    return "".join(out) + text[at:]


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def n(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))

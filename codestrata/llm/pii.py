"""Personal data by candidate gradient boosting, in DataFrame operations only.

Base spans (emails, IP addresses, card numbers, phone numbers) follow fixed formats and
always stay. High-recall generators propose further, overlapping spans: loose addresses
and groups of digits. A candidate's format and context are described by small integers;
boosted trees over them, trained from how often candidates of each description are
confirmed by a base format, score it, and a threshold calibrated on the other half of the
corpus selects additions.

Training is exact and small: candidates of the whole corpus are counted by description,
confirmation and half (a table bounded by the number of descriptions), and only that
table reaches the driver. Trees become one column expression.

Positions come from lengths of the pieces between matches; regular expressions are
written without repeated groups (separators between digits, or dots between labels, are
first replaced by a mark of the same length), so a long run costs no stack.

Edge cases: null and empty texts have no spans; offsets are code points, end exclusive;
equal spans are reported once; repeated rows are scanned each; with no confirmed candidate
nothing is added; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm.shared import written

KINDS = ("email", "ip", "card", "phone")
TREES, RATE, PRECISION = 40, 0.3, 0.95
SPAN = "array<struct<start:int,kind:int,end:int>>"
MARK = "\x01"

# The contract's formats, with marks for inner separators.
EMAIL = r"(?:(?<![A-Za-z0-9._%+\x01-])|\G)[A-Za-z0-9._%+\x01-]++@[A-Za-z0-9-]++\x01[A-Za-z0-9\x01-]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9][0-9\x01]+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
# Generators.
LOOSE_MAIL = r"[^\s@<>\"']+@[^\s@<>\"']+"
NUMBERS = r"[0-9][\x20().0-9/-]{5,}[0-9]"
CONTEXT = 24
CONTEXTS = {"mail": r"(?i)(mail|contact|write|@)", "phone": r"(?i)(tel|phone|call|fax|mobile|\+)", "card": r"(?i)(card|visa|pay|account)", "ip": r"(?i)(ip|host|server|address)"}


def matches(text: Column, pattern: str) -> Column:
    """array of (start, end, m): leftmost non-overlapping matches, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<struct<start:int,end:int,m:string>>")
    zipped = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.greatest(F.size(found), F.lit(1))).alias("p"), found.alias("m"))
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["p"])
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.array_append(acc["out"], F.struct(s.alias("start"), e.alias("end"), x["m"].alias("m"))).alias("out"))

    return F.when(F.size(found) > 0, F.aggregate(zipped, start, step, lambda acc: acc["out"])).otherwise(none)


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when((n - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _kept(found: Column, kind: int, ok) -> Column:
    return F.transform(F.filter(found, lambda x: ok(x["m"])), lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def base_spans(docs: DataFrame) -> DataFrame:
    """docs with `text__pii` (never null) and `base__pii`: spans in order of start, then kind."""
    none = F.array().cast(SPAN)
    d = docs.withColumn("text__pii", F.coalesce(F.col("text").cast("string"), F.lit("")))
    text = F.col("text__pii")
    digits = F.rlike(text, F.lit("[0-9][^0-9]?[0-9]"))
    mail = F.regexp_replace(F.translate(text, MARK, "\x02"), r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", MARK)
    card = F.regexp_replace(F.translate(text, MARK, "\x02"), r"(?<=[0-9])[ -](?=[0-9])", MARK)
    d = d.withColumn("mail__pii", F.when(F.contains(text, F.lit("@")), matches(mail, EMAIL)))
    d = d.withColumn("ip__pii", F.when(digits, matches(text, IP)))
    d = d.withColumn("card__pii", F.when(digits, matches(card, CARD)))
    d = d.withColumn("phone__pii", F.when(F.rlike(text, F.lit(r"\+[0-9]")), matches(text, PHONE)))
    ip_ok = lambda m: F.forall(F.split(m, r"\."), lambda p: F.rlike(p, F.lit(OCTET)))
    card_ok = lambda m: F.length(_digits(m)).between(14, 19) & luhn(_digits(m))
    phone_ok = lambda m: F.length(_digits(m)).between(10, 15)
    parts = [
        F.coalesce(_kept(F.col("mail__pii"), 0, lambda m: F.lit(True)), none),
        F.coalesce(_kept(F.col("ip__pii"), 1, ip_ok), none),
        F.coalesce(_kept(F.col("card__pii"), 2, card_ok), none),
        F.coalesce(_kept(F.col("phone__pii"), 3, phone_ok), none),
    ]
    return d.withColumn("base__pii", F.array_sort(F.concat(*parts).cast(SPAN))).drop("mail__pii", "ip__pii", "card__pii", "phone__pii")


FEATURES = ("type", "size", "groups", "separator", "luhn", "quad", "dotted", "c_mail", "c_phone", "c_card", "c_ip", "glued")


def _described(x: Column, text: Column, kind: int) -> Column:
    """(start, kind, end, f: description) of a proposed span."""
    m, digits = x["m"], _digits(x["m"])
    n = F.length(digits) if kind else F.length(m)
    size = sum((n >= b).cast("int") for b in (7, 9, 10, 12, 14, 16, 20))
    groups = F.least(F.size(F.split(m, "[^0-9]+" if kind else r"\.")), F.lit(6))
    separator = F.when(F.contains(m, F.lit("/")), 5).when(F.contains(m, F.lit("(")), 4).when(F.contains(m, F.lit(".")), 3).when(F.contains(m, F.lit("-")), 2).when(F.contains(m, F.lit(" ")), 1).otherwise(0)
    before = F.substring(text, F.greatest(x["start"] - (CONTEXT - 1), F.lit(1)), F.least(x["start"], F.lit(CONTEXT)))
    near = [F.rlike(before, F.lit(CONTEXTS[c])).cast("int") for c in ("mail", "phone", "card", "ip")]
    # the sign that a phone format asks for is context here, so numbers without it can still be found
    glued = F.rlike(before, F.lit(r"[A-Za-z0-9_.-]$")).cast("int")
    is_luhn = F.when(F.length(digits).between(14, 19), luhn(digits).cast("int")).otherwise(0) if kind else F.lit(0)
    quad = F.rlike(m, F.lit(r"^(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.(?!$)|$)){4}$")).cast("int") if kind else F.lit(0)
    dotted = F.rlike(m, F.lit(r"@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+")).cast("int") if not kind else F.lit(0)
    f = [F.lit(kind), size, groups, separator, is_luhn, quad, dotted, *near, glued]
    out = F.when(F.length(digits).between(14, 19), 2).otherwise(3) if kind else F.lit(0)
    return F.struct(x["start"].alias("start"), out.alias("kind"), x["end"].alias("end"), F.struct(*[v.cast("int").alias(k) for k, v in zip(FEATURES, f)]).alias("f"))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, base, proposed (start, kind, end, f, confirmed), half: no texts."""
    d = base_spans(docs.select("doc_id", "text"))
    text = F.col("text__pii")
    d = d.withColumn("loose__pii", F.when(F.contains(text, F.lit("@")), matches(text, LOOSE_MAIL)))
    d = d.withColumn("numbers__pii", F.when(F.rlike(text, F.lit("[0-9][^a-zA-Z]{4,}[0-9]")), matches(text, NUMBERS)))
    none = F.array().cast(f"array<struct<start:int,kind:int,end:int,f:struct<{','.join(f'{k}:int' for k in FEATURES)}>>>")
    loose = F.coalesce(F.transform("loose__pii", lambda x: _described(x, text, 0)), none)
    numbers = F.coalesce(F.transform("numbers__pii", lambda x: _described(x, text, 1)), none)
    d = d.withColumn("proposed__pii", F.concat(loose, numbers))
    confirmed = lambda p: F.exists("base__pii", lambda b: (b["start"] < p["end"]) & (p["start"] < b["end"]))
    rows = F.transform("proposed__pii", lambda p: F.struct(p["start"].alias("start"), p["kind"].alias("kind"), p["end"].alias("end"), p["f"].alias("f"), confirmed(p).alias("confirmed")))
    half = F.pmod(F.xxhash64(F.lit(5), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(2))
    return d.select("doc_id", F.col("base__pii").alias("base"), rows.alias("proposed"), half.alias("half"))


def boost(x: np.ndarray, y: np.ndarray, w: np.ndarray, trees: int = TREES, rate: float = RATE) -> tuple[float, list]:
    """Newton-boosted trees of depth two on integer features: (prior, [(feature, cut, (left tree), (right tree))])."""
    prior = float(np.log((w @ y + 0.5) / (w @ (1 - y) + 0.5)))
    score, out = np.full(len(y), prior), []

    def leaf(at):
        p = 1 / (1 + np.exp(-score[at]))
        return float(np.clip(rate * (w[at] @ (y[at] - p)) / (w[at] @ (p * (1 - p)) + 1.0), -2, 2))

    def split(at):
        p = 1 / (1 + np.exp(-score[at]))
        g, h = w[at] * (y[at] - p), w[at] * p * (1 - p)
        best = (1e-9, None)
        for f in range(x.shape[1]):
            for c in np.unique(x[at, f])[1:]:
                r = x[at, f] >= c
                gain = g[r].sum() ** 2 / (h[r].sum() + 1) + g[~r].sum() ** 2 / (h[~r].sum() + 1) - g.sum() ** 2 / (h.sum() + 1)
                best = max(best, (gain, (f, int(c))), key=lambda b: b[0])
        return best[1]

    for _ in range(trees):
        everything = np.arange(len(y))
        top = split(everything)
        if top is None:
            break
        tree, add = [], np.zeros(len(y))
        for side in (False, True):
            at = everything[(x[:, top[0]] >= top[1]) == side]
            low = split(at) if len(at) > 1 else None
            if low is None:
                v = leaf(at)
                tree.append((0, -1, v, v))
                add[at] = v
            else:
                r = x[at, low[0]] >= low[1]
                a, b = leaf(at[~r]), leaf(at[r])
                tree.append((*low, a, b))
                add[at] = np.where(r, b, a)
        score = score + add
        out.append((*top, *tree))
    return prior, out


def predict(model: tuple[float, list], x: np.ndarray) -> np.ndarray:
    s = np.full(len(x), model[0])
    for f, c, low, high in model[1]:
        side = x[:, f] >= c
        for is_high, (g, d, a, b) in ((False, low), (True, high)):
            at = side == is_high
            s[at] += np.where(x[at, g] >= d, b, a)
    return s


def expression(model: tuple[float, list], f: Column) -> Column:
    total = F.lit(model[0])
    for i, c, low, high in model[1]:
        side = [F.when(f[FEATURES[g]] >= d, b).otherwise(a) for g, d, a, b in (low, high)]
        total = total + F.when(f[FEATURES[i]] >= c, side[1]).otherwise(side[0])
    return total


def calibrated(model, x: np.ndarray, y: np.ndarray, w: np.ndarray, precision: float = PRECISION) -> float | None:
    """The lowest score from which on the confirmed share stays at the precision."""
    s = predict(model, x)
    order = np.argsort(-s, kind="stable")
    hit, all_ = np.cumsum((w * y)[order]), np.cumsum(w[order])
    last = np.append(s[order][1:] != s[order][:-1], True)
    ok = np.flatnonzero(last & (hit >= precision * all_) & (hit > 0))
    return float(s[order][ok[-1]]) if len(ok) else None


def find(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, base, spans."""
    rows = written(spark, candidates(docs), "pii")
    each = rows.select("half", F.explode("proposed").alias("p")).groupBy("half", "p.f", "p.confirmed").agg(F.count("*").alias("n"))
    counted = each.select("half", *[F.col("f")[k].alias(k) for k in FEATURES], "confirmed", "n").collect()  # bounded by the descriptions
    kept = F.filter("proposed", lambda p: F.lit(False))
    if any(r["confirmed"] for r in counted):
        x = np.array([[r[k] for k in FEATURES] for r in counted])
        y, w, half = (np.array([float(r[k]) for r in counted]) for k in ("confirmed", "n", "half"))
        fit = half == 0 if len({*half}) > 1 and y[half == 0].any() else np.ones(len(y), bool)
        test = ~fit if not fit.all() and y[~fit].any() else fit
        model = boost(x[fit], y[fit], w[fit])
        limit = calibrated(model, x[test], y[test], w[test])
        if limit is not None:
            # confirmed candidates lie in base spans, which stay as they are
            kept = F.filter("proposed", lambda p: ~p["confirmed"] & (expression(model, p["f"]) >= F.lit(limit - 1e-9)))
    added = F.transform(kept, lambda p: F.struct(p["start"].alias("start"), p["kind"].alias("kind"), p["end"].alias("end")))
    return rows.select("doc_id", "base", F.array_sort(F.array_distinct(F.concat("base", added.cast(SPAN)))).alias("spans"))


def joined(spans: Column) -> Column:
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", n(0), n(1), n(2), n(3), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))

"""Mixing sources to target weights, in DataFrame operations only.

Temperature mixing: a source with share p of all tokens gets the weight p**a / sum(p**a).
The exponent a in [0, 1] is bisected (several points a pass, each pass one aggregate over
the table of sources): the smallest a whose entropy does not pass the target and whose most
repeated source stays within the repetition limit.

Weights times the token budget give each source whole epochs (every row) and a last, cut
epoch. That one is a budgeted block permutation: rows fall into ``BLOCKS`` blocks by hash,
blocks are permuted by a hash of (seed, epoch, block), rows in a block by a hash of
(seed, epoch, row), and rows are taken in that order while the budget lasts. The cut is one
key a source, found from sums of blocks and then inside the cut block alone, so no task
gathers a source, and rows are chosen in place without a join on documents.

Budget None is the smallest budget that shows every row of every source at least once.

Edge cases: a null source is the empty source; null or empty texts have no tokens and go
with every whole epoch; a source without tokens is kept once; a null doc_id hashes as the
empty text; repeated rows are taken or left together in the cut epoch; an empty table gives
an empty mixture; extra columns pass through inside ``row``, so no name can clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codestrata.llm.shared import written

BLOCKS = 4096
POINTS, PASSES = 15, 7
REPETITION_LIMIT = 2.0


def tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_of(docs: DataFrame) -> Column:
    return F.coalesce(docs["source"].cast("string"), F.lit(""))


def exponent(sources: DataFrame, entropy: float | None = None, repetition: float | None = REPETITION_LIMIT, budget_share: float | None = None) -> float:
    """The smallest exponent in [0, 1] within both limits (1 if none is). ``sources``: tokens__mix > 0.

    ``entropy``: an upper limit as a share of ln(number of sources). ``repetition``: the most
    epochs of any source, for a budget of ``budget_share`` of all tokens (None: lossless).
    """
    total = sources.agg(F.sum("tokens__mix"), F.count("*")).first()
    if not total[0]:
        return 1.0
    lo, hi = 0.0, 1.0
    share = F.col("tokens__mix") / F.lit(float(total[0]))
    for _ in range(PASSES):
        grid = [lo + (hi - lo) * k / (POINTS + 1) for k in range(POINTS + 2)]
        at = sources.select(share.alias("p"), F.explode(F.array(*[F.lit(a) for a in grid])).alias("a")).withColumn("w", F.pow("p", "a"))
        rows = at.groupBy("a").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.log("w")).alias("s"), F.max(F.col("w") / F.col("p")).alias("most"), F.min(F.col("w") / F.col("p")).alias("least")).orderBy("a").collect()
        ok = []
        for r in rows:
            h = (math.log(r["z"]) - r["s"] / r["z"]) / max(math.log(total[1]), 1e-12)
            epochs = r["most"] / r["least"] if budget_share is None else r["most"] / r["z"] * budget_share
            ok.append((entropy is None or h <= entropy + 1e-12) and (repetition is None or epochs <= repetition + 1e-12))
        if not any(ok):
            return 1.0
        k = ok.index(True)
        if k == 0:
            return rows[0]["a"]
        lo, hi = rows[k - 1]["a"], rows[k]["a"]
    return hi


def _block(key: Column) -> Column:
    return F.pmod(key, F.lit(BLOCKS)).cast("int")


def plan(spark: SparkSession, docs: DataFrame, seed: int = 0, entropy: float | None = None, repetition: float | None = REPETITION_LIMIT, budget: int | None = None) -> DataFrame:
    """A row for each source: source__mix, weight__mix, epochs__mix (whole), cut_order__mix, cut_within__mix (null: no cut epoch)."""
    rows = written(spark, docs.select(source_of(docs).alias("source__mix"), F.xxhash64(F.lit(seed), F.coalesce(docs["doc_id"].cast("string"), F.lit(""))).alias("key"), tokens(docs["text"]).alias("n")), "mix-rows")
    sources = written(spark, rows.groupBy("source__mix").agg(F.sum("n").alias("tokens__mix")), "mix-sources")
    some = sources.filter("tokens__mix > 0")
    total = some.agg(F.sum("tokens__mix")).first()[0] or 0
    a = exponent(some, entropy, repetition, None if budget is None else budget / max(1, total))
    power = F.pow(F.col("tokens__mix") / F.lit(float(max(1, total))), F.lit(a))
    z = some.agg(F.sum(power), F.min(power / F.col("tokens__mix"))).first()
    weight = power / F.lit(z[0] or 1.0)
    # epochs of a source: its weight times the budget over its tokens; lossless: the least is 1
    epochs = F.round(power / F.col("tokens__mix") / F.lit(z[1] or 1.0), 9) if budget is None else F.round(weight * F.lit(float(budget)) / F.col("tokens__mix"), 9)
    epochs = F.when(F.col("tokens__mix") > 0, epochs).otherwise(F.lit(1.0))
    s = sources.withColumn("weight__mix", F.when(F.col("tokens__mix") > 0, weight).otherwise(F.lit(0.0))).withColumn("all", epochs)
    s = s.withColumn("epochs__mix", F.floor("all").cast("int")).withColumn("left", F.floor((F.col("all") - F.floor("all")) * F.col("tokens__mix")).cast("long"))
    s = written(spark, s.drop("all"), "mix-weights")

    blocks = rows.groupBy("source__mix", _block(F.col("key")).alias("block")).agg(F.sum("n").alias("n")).join(s.select("source__mix", "epochs__mix", "left"), "source__mix")
    blocks = blocks.withColumn("order", F.xxhash64(F.lit(seed), "epochs__mix", "block"))
    w = Window.partitionBy("source__mix").orderBy("order", "block")
    blocks = blocks.withColumn("upto", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    cut = blocks.filter(F.col("upto") > F.col("left")).groupBy("source__mix").agg(F.min_by(F.struct("block", "order", (F.col("left") - F.col("upto") + F.col("n")).alias("rest"), "epochs__mix"), "upto").alias("c"))
    cut = written(spark, cut.select("source__mix", "c.*"), "mix-cuts")
    inside = rows.withColumn("block", _block(F.col("key"))).join(cut, ["source__mix", "block"])
    inside = inside.groupBy("source__mix", "rest", F.xxhash64(F.lit(seed), "epochs__mix", "key").alias("within")).agg(F.sum("n").alias("n"))
    inside = inside.withColumn("upto", F.sum("n").over(Window.partitionBy("source__mix").orderBy("within")))
    last = inside.filter("upto <= rest").groupBy("source__mix").agg(F.max("within").alias("cut_within__mix"))
    out = s.join(cut.select("source__mix", F.col("order").alias("cut_order__mix")), "source__mix", "left").join(last, "source__mix", "left")
    return written(spark, out.drop("left", "tokens__mix"), "mix-plan")


def mixed(spark: SparkSession, docs: DataFrame, seed: int = 0, entropy: float | None = None, repetition: float | None = REPETITION_LIMIT, budget: int | None = None) -> DataFrame:
    """row (a struct of docs' columns) as often as its source's epochs show it, with epoch, order, within and weight."""
    p = plan(spark, docs, seed, entropy, repetition, budget)
    key = F.xxhash64(F.lit(seed), F.coalesce(docs["doc_id"].cast("string"), F.lit("")))
    d = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), source_of(docs).alias("source__mix"), key.alias("key")).join(p, "source__mix")
    d = d.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs__mix"))))
    d = d.withColumn("order", F.xxhash64(F.lit(seed), "epoch", _block(F.col("key")))).withColumn("within", F.xxhash64(F.lit(seed), "epoch", "key"))
    before = (F.col("order") < F.col("cut_order__mix")) | ((F.col("order") == F.col("cut_order__mix")) & (F.col("within") <= F.col("cut_within__mix")))
    shown = d.filter((F.col("epoch") < F.col("epochs__mix")) | F.coalesce(before, F.lit(False)))
    return shown.select("row", "epoch", "order", "within", F.col("weight__mix").alias("weight"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture that shows each row at least once and none more than twice, most even among those."""
    m = mixed(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    return m.select("row.doc_id", "row.source", "epoch", F.col("order").alias("block_order"), F.col("within").alias("row_order"), tokens(F.col("row.text")).alias("n_tokens"), F.round("weight", 9).alias("weight"))

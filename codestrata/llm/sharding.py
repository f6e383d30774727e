"""Sharding by extendible hashing, in DataFrame operations only.

A directory is indexed by prefix bits of a 60-bit hash of the row's key. All rows start in
the bucket of the empty prefix; a bucket over the byte limit splits on the next bit, and
only such buckets do, until each fits. Byte sums are aggregated per cell (``step`` bits
deeper than the pass before), so no task gathers the rows of a bucket; the levels between
are sums over cells, and only buckets that the cells cannot resolve go on to a next pass.

A bucket whose rows agree in all bits (one row over the limit, or repeated rows of one key)
cannot be parted by further bits and is not split: it overflows into pages. Its rows are
dealt to blocks of about ``BLOCK_ROWS`` by the ordinal they got when they were written, so a
task that runs again deals them alike; a block is cut into pages by running sums of half
the limit, so pages fit as well; a row of more than half the limit has a page of its own
(and only a single row over the limit makes a page that is).

Edge cases: a null key hashes as the empty text; null and empty texts count ``ROW_BYTES``;
repeated rows are kept and counted each; an empty table gives no shards; extra columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codestrata.llm.shared import written

#: Bytes counted for a row beside its text.
ROW_BYTES = 64
SHARD_BYTES = 64 << 20
#: The limit of the registered query: small, so that tables of any size split over several levels and overflow.
QUERY_SHARD_BYTES = 32 << 10
HASH_BITS = 60
#: Rows of an unsplittable bucket that one task cuts into pages.
BLOCK_ROWS = 50_000


def sized(docs: DataFrame, ordinal: Column | None = None) -> DataFrame:
    """doc_id, hash (60 bits, not negative), n_bytes, ordinal (of its place, fixed once written, unless one is given)."""
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES
    return docs.select("doc_id", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("hash"), size.alias("n_bytes"), (F.monotonically_increasing_id() if ordinal is None else ordinal).alias("ordinal"))


def prefix(hash_: Column, bits: int, of: int = HASH_BITS) -> Column:
    """The first bits of a number of `of` bits."""
    return F.shiftright(hash_, of - bits)


def directory(spark: SparkSession, rows: DataFrame, limit: int = SHARD_BYTES, step: int = 12) -> DataFrame:
    """Leaf buckets: depth, prefix (of depth bits), n_bytes, n_rows, fits. ``rows``: hash, n_bytes."""
    leaves, first = [], 0
    sums = [F.sum("n_bytes").alias("n_bytes"), F.sum("n_rows").alias("n_rows"), F.min("low").alias("low"), F.max("high").alias("high")]
    # over the limit, and a further bit can part it
    splits = (F.col("n_bytes") > limit) & (F.col("low") < F.col("high"))
    while True:
        to = min(first + step, HASH_BITS)
        each = rows.select("n_bytes", F.expr("1L").alias("n_rows"), F.col("hash").alias("low"), F.col("hash").alias("high"), prefix(F.col("hash"), to).alias("cell"))
        cells = each.groupBy("cell").agg(*sums)
        levels = F.array(*[F.struct(F.lit(d).alias("depth"), prefix(F.col("cell"), d, to).alias("prefix")) for d in range(first, to + 1)])
        tree = cells.select(F.explode(levels).alias("at"), "n_bytes", "n_rows", "low", "high").groupBy("at.depth", "at.prefix").agg(*sums)
        tree = written(spark, tree, "levels")
        over = tree.filter(splits).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        done = tree.filter(~splits).withColumn("parent", F.shiftright("prefix", 1))
        leaves.append(done.filter(F.col("depth") > first).join(over, ["depth", "parent"], "left_semi").unionByName(done.filter(F.col("depth") == first)))
        deep = tree.filter((F.col("depth") == to) & splits).select(F.col("prefix").alias("cell"))
        if to == HASH_BITS or deep.isEmpty():
            break
        # buckets of the next pass begin one bit deeper: their parents are over
        rows = rows.join(deep, prefix(F.col("hash"), to) == F.col("cell"), "left_semi")
        first = to + 1
    out = leaves[0]
    for x in leaves[1:]:
        out = out.unionByName(x)
    return written(spark, out.select("depth", "prefix", "n_bytes", "n_rows", (F.col("n_bytes") <= limit).alias("fits")), "directory")


def assign(spark: SparkSession, docs: DataFrame, limit: int = SHARD_BYTES, step: int = 12) -> DataFrame:
    """doc_id, shard, depth, prefix, page, n_bytes: a row for each document."""
    return _placed(spark, written(spark, sized(docs), "sized"), limit, step).drop("ordinal")


def _placed(spark: SparkSession, rows: DataFrame, limit: int, step: int) -> DataFrame:
    leaves = directory(spark, rows.select("hash", "n_bytes"), limit, step)
    depths = sorted(r["depth"] for r in leaves.select("depth").distinct().collect())  # at most 61 numbers
    # a row carries its prefix at every depth in use; exactly one of them is a leaf
    each = F.array(*[F.struct(F.lit(d).alias("depth"), prefix(F.col("hash"), d).alias("prefix")) for d in depths or [0]])
    wide = rows.select("doc_id", "ordinal", F.col("n_bytes").alias("own"), F.explode(each).alias("at")).select("doc_id", "ordinal", "own", "at.depth", "at.prefix")
    placed = wide.join(leaves.select("depth", "prefix", "fits", "n_rows"), ["depth", "prefix"])
    whole = placed.filter("fits").withColumn("page", F.lit(0).cast("long"))
    parts = whole.unionByName(_pages(placed.filter("NOT fits"), limit))
    page = F.when(F.col("page") > 0, F.concat(F.lit("-"), F.col("page").cast("string"))).otherwise("")
    shard = F.concat(F.lpad(F.col("depth").cast("string"), 2, "0"), F.lit("-"), F.col("prefix").cast("string"), page)
    return parts.select("doc_id", shard.alias("shard"), "depth", "prefix", "page", F.col("own").alias("n_bytes"), "ordinal")


def _pages(rows: DataFrame, limit: int) -> DataFrame:
    """Overflow pages of buckets that no further bit can split: even numbers hold rows up to half the limit, an odd one a single larger row."""
    half = max(1, limit // 2)
    blocks = F.ceil(F.col("n_rows") / BLOCK_ROWS)
    w = Window.partitionBy("depth", "prefix", "block").orderBy("own", "ordinal")
    run = rows.withColumn("block", F.pmod("ordinal", blocks)).withColumn("before", F.coalesce(F.sum("own").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    number = F.when(F.col("own") > half, F.row_number().over(w).cast("long") * 2 + 1).otherwise(F.floor(F.col("before") / F.lit(half)).cast("long") * 2)
    return run.withColumn("page", number * blocks + F.col("block") + 1).drop("block", "before")


def write_shards(spark: SparkSession, docs: DataFrame, path: str, limit: int = SHARD_BYTES, step: int = 12) -> None:
    """The rows of docs in folders of parquet files, shard=<depth>-<prefix>[-<page>]. Rows are told apart by the place they were written at, so repeated keys are written as often as they come."""
    at = "ordinal__"
    while at in docs.columns:
        at += "_"
    whole = written(spark, docs.withColumn(at, F.monotonically_increasing_id()), "numbered")
    placed = _placed(spark, written(spark, sized(whole, F.col(at)), "sized"), limit, step).select(F.col("ordinal").alias(at), F.col("shard").alias("shard__"))
    out = whole.join(placed, at).drop(at)
    name = "shard" if "shard" not in docs.columns else "shard__"
    out.withColumnRenamed("shard__", name).repartition(name).write.partitionBy(name).parquet(path)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), QUERY_SHARD_BYTES)


def sql(documents: str = "documents", limit: int = QUERY_SHARD_BYTES) -> str:
    """The same leaves by testing every depth of every row, and their pages (buckets of up to BLOCK_ROWS rows; rows of one key and size may change places)."""
    half = max(1, limit // 2)
    return f"""
    WITH d AS (
      SELECT row_number() OVER () AS rid, doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h,
             coalesce(strlen(text), 0) + {ROW_BYTES} AS n_bytes
      FROM {documents}),
    s AS (SELECT rid, doc_id, h, n_bytes, t.depth, d.h >> ({HASH_BITS} - t.depth) AS prefix FROM d, (SELECT unnest(range(0, {HASH_BITS + 1})) AS depth) t),
    b AS (SELECT *, sum(n_bytes) OVER p AS total, min(h) OVER p AS low, max(h) OVER p AS high FROM s WINDOW p AS (PARTITION BY depth, prefix)),
    l AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY depth) AS rn FROM b WHERE total <= {limit} OR low = high),
    o AS (SELECT *, row_number() OVER (PARTITION BY depth, prefix ORDER BY n_bytes, rid) AS place,
                 coalesce(sum(n_bytes) OVER (PARTITION BY depth, prefix ORDER BY n_bytes, rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
          FROM l WHERE rn = 1),
    g AS (SELECT *, CASE WHEN total <= {limit} THEN 0 WHEN n_bytes > {half} THEN place * 2 + 2 ELSE before // {half} * 2 + 1 END AS page FROM o)
    SELECT doc_id, lpad(CAST(depth AS VARCHAR), 2, '0') || '-' || CAST(prefix AS VARCHAR) || CASE WHEN page > 0 THEN '-' || CAST(page AS VARCHAR) ELSE '' END AS shard,
           CAST(depth AS INTEGER) AS depth, CAST(prefix AS BIGINT) AS prefix, CAST(page AS BIGINT) AS page, CAST(n_bytes AS BIGINT) AS n_bytes
    FROM g
    """


SQL = sql()

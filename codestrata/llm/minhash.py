"""Near-duplicate detection by bottom-k sketches of one hash function.

1. Each text becomes its set of distinct word shingles (64-bit hashes) in one Arrow pass; a
   128-bit digest of the set and its ``k`` smallest hashes (the sketch) leave that pass,
   the set itself does not.
2. Documents of equal sets form a class; its smallest doc_id stands for it from here on, so
   copies are never paired.
3. Inverted lists of retained values. Two sets with Jaccard 0.8 share at least ``SHARED`` of
   48 retained values (but for a chance under 1e-6; 0.8 of them, surely, where the sketches of
   the set and of any set that near are whole sets: 38 shingles at most), so each document is listed only under its rarest ``k - SHARED + 1``
   values: passages that many documents hold rarely bring two of them together.
4. A list's pivot is its member with the longest lists (of a text and its edited copies, the
   text). Members meet the pivot first: the union sketch estimates Jaccard and filters,
   exact Jaccard on full sets confirms. Lists of one pivot are united into a group, and
   members that are still in different components are compared exactly in blocks of
   about ``BLOCK`` members, dealt by hash; blocks of one component meet only others. A block pair gives back its
   links, not its pairs.
5. Components: smallest label reachable, by rounds over written tables.

Edge cases: null or empty texts and texts of separators have no set: they link with
nothing. Fewer words than a shingle: the whole sequence is one. A null doc_id is linked
with nothing, gets a null component and is kept. Rows that repeat a doc_id are one document:
their links count together and they share the result (keep_one keeps one of them). An empty table gives no rows. Extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codestrata.llm import textkit as tk
from codestrata.llm.shared import written

SKETCH = 48
#: Of SKETCH values, so many are shared at least at Jaccard 0.8: mean 38, over five standard deviations away.
SHARED = 24
FILTER_BITS = 1 << 23
#: Members of a block when a group is compared across its components.
BLOCK = 256
#: The estimate must come within this of the threshold: at k = 48 no tighter than SHARED.
SLACK = 0.3


def _sketches(width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, rows, offsets, data in tk.chunks(batch.column("text")):
                w = tk.words(offsets, data, tk.NOT_SPACE)
                owner, value = tk.shingles(w, width)
                count = np.bincount(owner, minlength=rows)
                first = np.concatenate([[0], np.cumsum(count)])[:-1]
                with np.errstate(over="ignore"):
                    prefix = np.concatenate([[np.uint64(0)], np.cumsum(tk.mix(value), dtype=np.uint64)])
                    prefix2 = np.concatenate([[np.uint64(0)], np.cumsum(tk.mix(value ^ np.uint64(0xA5A5A5A5DEADBEEF)), dtype=np.uint64)])
                    a, b = prefix[first + count] - prefix[first], prefix2[first + count] - prefix2[first]
                rank = np.arange(len(value)) - first[owner]
                kept = value[rank < k]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, rows), pa.array(count.astype(np.int64)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), tk.list_array(np.minimum(count, k), pa.array(kept.view(np.int64)))],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "sketch"],
                )

    return run


def sketches(docs: DataFrame, width: int, k: int = SKETCH) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b, sketch (the k smallest hashes, ascending as unsigned)."""
    ids = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return ids.mapInArrow(_sketches(width, k), "doc_id long, n_shingles long, set_a long, set_b long, sketch array<long>")


def _sets(width: int, wanted: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column("slot").fill_null(0).to_numpy()
            batch = batch.filter(pa.array(wanted[slot]))
            for row, rows, offsets, data in tk.chunks(batch.column("text")):
                owner, value = tk.shingles(tk.words(offsets, data, tk.NOT_SPACE), width)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, rows), tk.list_array(np.bincount(owner, minlength=rows), pa.array(value.view(np.int64)))], names=["rep", "values"])

    return run


def _slots(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(17), doc_id), F.lit(FILTER_BITS)).cast("int")


def _filter_of(ids: DataFrame) -> np.ndarray:
    """A bit for the slot of each doc_id: FILTER_BITS bits at the driver, however many ids there are."""
    slot = _slots(F.col("doc_id"))
    words = ids.select((F.shiftright(slot, 6)).alias("w"), F.expr("1L").alias("one"), (slot % 64).alias("b")).select("w", F.call_function("shiftleft", "one", "b").alias("v"))
    out = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    for r in words.groupBy("w").agg(F.bit_or("v").alias("v")).toLocalIterator():
        out[r["w"]] = r["v"]
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def near_links(spark: SparkSession, docs: DataFrame, width: int, threshold: float = 0.8, k: int = SKETCH) -> tuple[DataFrame, DataFrame | None]:
    """(members: doc_id, n_shingles, rep; labels: rep, label for every class that links with another)."""
    sk = written(spark, sketches(docs, width, k), "sketches")
    real = sk.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    set_key = ["set_a", "set_b", "n_shingles"]
    classes = written(spark, real.groupBy(*set_key).agg(F.min("doc_id").alias("rep")), "classes")
    same = real.select("doc_id", *set_key).join(classes, set_key).select("doc_id", "rep").distinct()
    same = written(spark, same, "members")
    # a doc_id of several rows may be in several classes: those are one document
    joined = same.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a <> b").select("doc_id", "a")
    multi = same.join(joined, "doc_id").filter("rep <> a").select("a", F.col("rep").alias("b"))
    own = classes.withColumnRenamed("rep", "doc_id")
    reps = real.join(own, ["doc_id", *set_key], "left_semi").dropDuplicates(["doc_id", *set_key])
    reps = written(spark, reps.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "sketch"), "reps")

    entries = reps.select("rep", "n", F.explode("sketch").alias("key"))
    many = entries.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    shared = entries.join(many, "key")
    # values of its own come first in a document's order of rarity
    kept_size = F.least(F.col("n"), F.lit(k))
    # a set that fits the sketch can still be near one that does not, of up to n / threshold
    need = F.when(F.col("n") <= int(k * threshold + 1e-9), F.ceil(kept_size * threshold - 1e-9)).otherwise(F.lit(SHARED * k // SKETCH))
    of_rep = Window.partitionBy("rep", "n")
    shared = shared.withColumn("alone", kept_size - F.count("*").over(of_rep)).withColumn("place", F.row_number().over(of_rep.orderBy("size", "key")))
    shared = shared.withColumn("degree", F.sum("size").over(of_rep)).filter(F.col("place") + F.col("alone") <= kept_size - need + 1)
    kept = written(spark, shared.select("key", "rep", "n", "degree"), "lists")
    # the first by degree, as an aggregate: a value's list never meets in one task
    first = F.min(F.struct((-F.col("degree")).alias("d"), F.col("rep").alias("pivot"), F.col("n").alias("pivot_n"))).alias("first")
    pivots = kept.groupBy("key").agg(first, F.count("*").alias("size")).filter("size > 1").select("key", "first.pivot", "first.pivot_n")
    groups = kept.join(pivots, "key").groupBy("pivot", "rep").agg(F.max("n").alias("n"), F.max("pivot_n").alias("pn"))
    groups = written(spark, groups, "groups")
    sets = _full_sets(spark, docs, groups.select(F.col("rep").alias("doc_id")).distinct(), width)

    near = F.least("n", "pn") >= F.lit(threshold) * F.greatest("n", "pn")
    pairs = groups.filter(near & (F.col("rep") != F.col("pivot"))).select(F.col("pivot").alias("a"), F.col("rep").alias("b"))
    likely = written(spark, _likely(reps, pairs, threshold, k), "likely")
    labels = merged(spark, None, multi.unionByName(_exact(sets, likely, threshold)))
    labels = merged(spark, labels, _across(groups, labels, sets, threshold, k))
    return sk.select("doc_id", "n_shingles").join(same.groupBy("doc_id").agg(F.min("rep").alias("rep")), "doc_id", "left"), labels


def _full_sets(spark: SparkSession, docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """rep, values (the full set, ascending as unsigned) of the documents named. Most texts leave in place; the join drops the few that only share a slot."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("slot", _slots(F.col("doc_id")))
    sets = texts.mapInArrow(_sets(width, _filter_of(ids)), "rep long, values array<long>")
    return written(spark, sets.join(ids, F.col("rep") == F.col("doc_id"), "left_semi"), "sets")


def _across(groups: DataFrame, labels: DataFrame | None, sets: DataFrame, threshold: float, k: int) -> DataFrame:
    """Links (a, b) between components inside groups."""
    if labels is None:
        g = groups.withColumn("label", F.col("rep")).withColumn("core", F.col("pivot"))
    else:
        of = lambda c, name: labels.select(F.col("rep").alias(c), F.col("label").alias(name))
        g = groups.join(of("rep", "label"), "rep", "left").join(of("pivot", "core"), "pivot", "left")
        g = g.withColumn("label", F.coalesce("label", "rep")).withColumn("core", F.coalesce("core", "pivot"))
    inside = F.col("label") == F.col("core")
    sizes = g.groupBy("pivot").agg(F.count("*").alias("size"), F.sum(inside.cast("int")).alias("cores"))
    # the pivot has met all members; two that are left make no pair
    sizes = sizes.filter((F.col("size") > 2) & (F.col("cores") < F.col("size")))
    # members are dealt to blocks by hash, those of the pivot's component apart: a block of one component meets only others
    pure, rest = F.ceil(F.col("cores") / BLOCK).cast("int"), F.greatest(F.lit(1), F.ceil((F.col("size") - F.col("cores")) / BLOCK)).cast("int")
    g = g.join(sizes.select("pivot", pure.alias("pure"), rest.alias("rest")), "pivot")
    dealt = F.xxhash64(F.lit(23), "rep")
    blk = F.when(inside, F.pmod(dealt, F.greatest(F.lit(1), F.col("pure")))).otherwise(F.col("pure") + F.pmod(dealt, F.col("rest"))).cast("int")
    g = g.withColumn("blk", blk)
    partners = F.filter(F.sequence(F.lit(0), F.col("pure") + F.col("rest") - 1), lambda j: ~((F.col("blk") < F.col("pure")) & (j < F.col("pure"))))
    each = g.withColumn("j", F.explode(partners)).select("pivot", F.least("blk", "j").alias("lo"), F.greatest("blk", "j").alias("hi"), "blk", "label", "rep")
    rows = each.join(sets, "rep").select("pivot", "lo", "hi", "blk", "label", "rep", "values")
    return rows.groupBy("pivot", "lo", "hi").applyInArrow(_block_pair(threshold, k), "a long, b long")


def _overlaps(value: np.ndarray, row: np.ndarray, other: np.ndarray, n: int) -> np.ndarray:
    """Matrix of shared values between rows of one side (other False) and of the other (other True); rows are numbered within n."""
    _, number = np.unique(value, return_inverse=True)
    left, right = np.flatnonzero(~other), np.flatnonzero(other)
    left, right = left[np.argsort(number[left], kind="stable")], right[np.argsort(number[right], kind="stable")]
    start = np.searchsorted(number[right], number[left], side="left")
    size = np.searchsorted(number[right], number[left], side="right") - start
    out = np.zeros(n * n, dtype=np.int64)
    step = 4_000_000  # increments at a time
    total = np.cumsum(size)
    at = 0
    while at < len(left):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + step)))
        s = size[at:end]
        pick = np.repeat(start[at:end], s) + np.arange(int(s.sum())) - np.repeat(np.cumsum(s) - s, s)
        out += np.bincount(np.repeat(row[left[at:end]], s) * n + row[right[pick]], minlength=n * n)
        at = end
    return out.reshape(n, n)


def _block_pair(threshold: float, k: int):
    """Exact links between members of two blocks (or of one) with different labels."""

    def run(table: pa.Table) -> pa.Table:
        blk = table.column("blk").to_numpy()
        label = table.column("label").to_numpy()
        rep = table.column("rep").to_numpy()
        lists = table.column("values").combine_chunks()
        n = lists.value_lengths().to_numpy().astype(np.int64)
        value = lists.flatten().to_numpy()
        m = len(rep)
        row = np.repeat(np.arange(m), n)
        two = blk.min() != blk.max()
        side = blk == blk.max() if two else np.ones(m, bool)
        pair = label[:, None] != label[None, :]
        pair &= np.minimum(n[:, None], n[None, :]) >= threshold * np.maximum(n[:, None], n[None, :])
        pair &= (~side[:, None] & side[None, :]) if two else np.triu(np.ones((m, m), bool), 1)
        none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        if not pair.any():
            return none

        def shared(use: np.ndarray) -> np.ndarray:
            v, r = value[use], row[use]
            if two:
                return _overlaps(v, r, side[r], m)
            return _overlaps(np.concatenate([v, v]), np.concatenate([r, r]), np.repeat([False, True], len(v)), m)

        # retained values in common bound the union sketch's estimate from above
        place = np.arange(len(value)) - (np.cumsum(n) - n)[row]
        most = np.minimum(k, np.maximum(n[:, None], n[None, :]))
        pair &= shared(place < k) >= (threshold - SLACK) * most
        if not pair.any():
            return none
        asked = pair.any(axis=0) | pair.any(axis=1)
        inter = shared(asked[row])
        pair &= 100 * inter >= round(threshold * 100) * (n[:, None] + n[None, :] - inter)
        a, b = np.nonzero(pair)
        return pa.table({"a": rep[a], "b": rep[b]})

    return run


def _likely(reps: DataFrame, pairs: DataFrame, threshold: float, k: int) -> DataFrame:
    """The pairs whose union sketch estimates a similarity near or above the threshold."""
    one = reps.groupBy("rep").agg(F.first("sketch").alias("sketch"))
    s = pairs.join(one.select(F.col("rep").alias("a"), F.col("sketch").alias("sa")), "a").join(one.select(F.col("rep").alias("b"), F.col("sketch").alias("sb")), "b")
    # sketches are in unsigned order: flip the sign bit to sort the union alike
    flip = lambda v: v.bitwiseXOR(F.lit(-(2**63)))
    union = F.slice(F.array_sort(F.transform(F.array_union("sa", "sb"), flip)), 1, k)
    common = F.size(F.array_intersect(union, F.transform(F.array_intersect("sa", "sb"), flip)))
    return s.filter(common >= F.lit(threshold - SLACK) * F.size(union)).select("a", "b")


def _exact(sets: DataFrame, likely: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose full sets have the Jaccard similarity."""
    v = likely.join(sets.select(F.col("rep").alias("b"), F.col("values").alias("vb")), "b").join(sets.select(F.col("rep").alias("a"), F.col("values").alias("va")), "a")
    inter = F.size(F.array_intersect("va", "vb")).cast("long")
    total = F.size("va").cast("long") + F.size("vb").cast("long") - inter
    exact = F.lit(100).cast("long") * inter >= F.lit(round(threshold * 100)).cast("long") * total
    return v.filter((total > 0) & exact).select("a", "b")


def merged(spark: SparkSession, labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """Labels (rep, label: smallest rep reachable) with further links (a, b); None stands for no links at all."""
    pairs = links.select("a", "b").distinct()
    if labels is not None:
        side = lambda c: labels.select(F.col("rep").alias(c), F.col("label").alias(f"{c}_label"))
        pairs = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")).filter("a <> b").distinct()
    edges = written(spark, pairs.union(pairs.select("b", "a")), "edges")
    if edges.isEmpty():
        return labels
    roots = components(spark, edges)
    if labels is None:
        return roots
    named = roots.select(F.col("rep").alias("label"), F.col("label").alias("root"))
    moved = labels.join(named, "label", "left").select("rep", F.coalesce("root", "label").alias("label"))
    return written(spark, moved.unionByName(roots.join(labels, "rep", "left_anti")), "labels")


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """rep, label (smallest rep reachable) for every end of edges (a, b), given in both directions: neighbours' minimum, then label of the label, until nothing changes."""
    labels = written(spark, edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "rep"), "labels")
    while True:
        near = edges.join(labels, F.col("b") == F.col("rep")).groupBy("a").agg(F.min("label").alias("seen")).withColumnRenamed("a", "rep")
        nxt = labels.join(near, "rep").select("rep", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        up = labels.select(F.col("rep").alias("label"), F.col("label").alias("root"))
        nxt = written(spark, nxt.join(up, "label", "left").select("rep", "old", F.least("label", F.coalesce("root", "label")).alias("label")), "labels")
        labels = nxt.select("rep", "label")
        if nxt.filter("old <> label").isEmpty():
            return labels


def near_dedup(spark: SparkSession, docs: DataFrame, width: int = 5, threshold: float = 0.8, k: int = SKETCH) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of docs."""
    members, labels = near_links(spark, docs, width, threshold, k)
    out = (members.withColumn("label", F.col("rep")) if labels is None else members.join(labels, "rep", "left")).withColumn("component_id", F.coalesce("label", "rep", "doc_id"))
    # the smallest doc_id of a component is the smallest of its classes' representatives
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(spark: SparkSession, docs: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs with one document of each group, that of its smallest doc_id; of rows that repeat its doc_id the one of the smallest text stays. Rows without a doc_id all stay."""
    gone = near_dedup(spark, docs, width, threshold).filter("NOT kept").select("doc_id").distinct()
    rest = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again = written(spark, docs.select("doc_id").filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeats")
    if again.isEmpty():
        return rest
    order = F.struct(F.coalesce("text", F.lit("")), F.xxhash64(*docs.columns))
    one = rest.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), order).alias("r")).select("r.*")
    return rest.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(one)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 3], ' ') END AS g
  FROM w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
r AS (SELECT s.doc_id, s.g, row_number() OVER (PARTITION BY s.doc_id ORDER BY f.c, s.g) AS rk FROM s JOIN (SELECT g, count(*) AS c FROM s GROUP BY g) f USING (g)),
p AS (SELECT r.doc_id, r.g, n.n FROM r JOIN n USING (doc_id) WHERE r.rk <= n.n - CAST(ceil(n.n * 0.8) AS BIGINT) + 1),
c AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM p x JOIN p y ON x.g = y.g AND x.doc_id < y.doc_id AND 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n)),
i AS (SELECT c.a, c.b, count(*) AS i FROM c JOIN s x ON x.doc_id = c.a JOIN s y ON y.doc_id = c.b AND y.g = x.g GROUP BY c.a, c.b),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
t AS (SELECT a AS root, a AS node FROM e UNION SELECT t.root, e.b FROM t JOIN e ON e.a = t.node),
m AS (SELECT root AS doc_id, min(node) AS component_id FROM t GROUP BY root)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(coalesce(m.component_id, w.doc_id), w.doc_id) AS component_id,
       least(coalesce(m.component_id, w.doc_id), w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

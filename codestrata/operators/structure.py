"""Structure of repositories: tree nodes, technologies, entry points, modules, guards.

Every function takes files(repo_id, path, size?) and stays relational; rule tables are
literals of fixed size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata import rules
from codestrata.functions import paths as P


def pruned(files: DataFrame) -> DataFrame:
    return files.filter(~P.is_pruned(F.col("path")))


def typed(files: DataFrame) -> DataFrame:
    return files.withColumn("type", P.file_type(F.col("path")))


def tree_nodes(files: DataFrame) -> DataFrame:
    """repo_id, path, parent_path, name, type, depth: files and the directories above them."""
    segs = P.segments(F.col("path"))
    each = pruned(files).select("repo_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(segs)), lambda n: F.struct(F.array_join(F.slice(segs, F.lit(1), n), "/").alias("path"), n.alias("depth"), (n == F.size(segs)).alias("is_file")))).alias("n"))
    nodes = each.groupBy("repo_id", "n.path", "n.depth").agg(F.bool_and("n.is_file").alias("is_file"))
    parent = F.when(F.col("depth") == 1, F.lit("")).otherwise(P.dirname(F.col("path")))
    return nodes.select("repo_id", "path", parent.alias("parent_path"), P.basename(F.col("path")).alias("name"), F.when(F.col("is_file"), "file").otherwise("directory").alias("type"), "depth")


def tree_lines(files: DataFrame) -> DataFrame:
    """repo_id, path, ord, line: the drawn tree, in order of path segments. A node's stem is made of its ancestors' 'is last' marks."""
    nodes = tree_nodes(files)
    last = F.lead("name").over(Window.partitionBy("repo_id", "parent_path").orderBy("name")).isNull()
    nodes = nodes.withColumn("is_last", last)
    segs = P.segments(F.col("path"))
    up = F.transform(F.sequence(F.lit(1), F.size(segs)), lambda n: F.array_join(F.slice(segs, F.lit(1), n), "/"))
    above = nodes.select("repo_id", "path", "depth", "name", F.explode(up).alias("of"))
    marks = nodes.select("repo_id", F.col("path").alias("of"), F.col("depth").alias("level"), "is_last")
    stems = above.join(marks, ["repo_id", "of"]).groupBy("repo_id", "path", "depth", "name").agg(F.array_sort(F.collect_list(F.struct("level", "is_last"))).alias("m"))
    draw = F.array_join(F.transform("m", lambda x: F.when(x["level"] == F.col("depth"), F.when(x["is_last"], "└── ").otherwise("├── ")).otherwise(F.when(x["is_last"], "    ").otherwise("│   "))), "")
    order = F.row_number().over(Window.partitionBy("repo_id").orderBy(P.segments(F.col("path"))))
    return stems.select("repo_id", "path", order.alias("ord"), F.concat(draw, F.col("name")).alias("line"))


def technologies(files: DataFrame) -> DataFrame:
    """repo_id, technology, ord: distinct, in first-seen order of files, then of rules."""
    name = P.basename(F.col("path"))
    rows = [F.when(name == n, F.struct(F.lit(i).alias("rank"), F.lit(t).alias("technology"))) for i, (n, t) in enumerate(rules.TECH_NAMES.items())]
    rows += [F.when(F.endswith(name, F.lit(e)), F.struct(F.lit(len(rules.TECH_NAMES) + i).alias("rank"), F.lit(t).alias("technology"))) for i, (e, t) in enumerate(rules.TECH_EXTENSIONS.items())]
    hits = pruned(files).select("repo_id", P.segments(F.col("path")).alias("segs"), F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("r"))
    first = hits.groupBy("repo_id", F.col("r.technology").alias("technology")).agg(F.min(F.struct("segs", "r.rank")).alias("seen"))
    return first.select("repo_id", "technology", F.row_number().over(Window.partitionBy("repo_id").orderBy("seen")).alias("ord"))


def entry_points(files: DataFrame) -> DataFrame:
    """repo_id, technology, path: a technology without an entry file keeps a null path."""
    rows = F.array(*[F.struct(F.lit(t).alias("technology"), F.lit(n).alias("name")) for t, names in rules.ENTRY_FILES.items() for n in names])
    name = P.basename(F.col("path"))
    hits = pruned(files).select("repo_id", "path", F.explode(F.filter(rows, lambda r: r["name"] == name)).alias("r")).select("repo_id", F.col("r.technology").alias("technology"), "path")
    return technologies(files).select("repo_id", "technology").join(hits, ["repo_id", "technology"], "left")


def size_stats(files: DataFrame) -> DataFrame:
    """repo_id, total_size, file_count, oversized, safe, reason: the total is judged before the count."""
    big = F.when(F.col("size") > rules.MAX_FILE_BYTES, F.struct("path", "size"))
    a = pruned(files).groupBy("repo_id").agg(F.sum("size").alias("total_size"), F.count("*").alias("file_count"), F.array_sort(F.collect_list(big)).alias("oversized"))
    total = F.format_string("%.2f", F.col("total_size") / F.lit(1048576.0))
    reason = F.when(F.col("total_size") > rules.MAX_TOTAL_BYTES, F.concat(F.lit("total of "), total, F.lit(" MB is over the limit"))).when(F.col("file_count") > rules.MAX_FILES, F.concat(F.col("file_count").cast("string"), F.lit(" files are over the limit")))
    return a.withColumn("reason", reason).withColumn("safe", F.col("reason").isNull())


def modules(files: DataFrame) -> DataFrame:
    """repo_id, dir, base, module, files, types: directories but the root, a parent's name (the project's at the top) before bases that recur, a number if that recurs too."""
    t = typed(pruned(files)).withColumn("dir", P.dirname(F.col("path"))).filter("dir <> '.'")
    d = t.groupBy("repo_id", "dir").agg(F.count("*").alias("files"), F.sort_array(F.collect_set("type")).alias("types"))
    base = P.basename(F.col("dir"))
    parent = F.when(F.contains("dir", F.lit("/")), P.basename(P.dirname(F.col("dir")))).otherwise(P.project_name(F.col("repo_id")))
    d = d.withColumn("base", base).withColumn("same", F.count("*").over(Window.partitionBy("repo_id", "base")))
    d = d.withColumn("label", F.when(F.col("same") > 1, F.concat(parent, F.lit("-"), F.col("base"))).otherwise(F.col("base")))
    n = F.row_number().over(Window.partitionBy("repo_id", "label").orderBy("dir"))
    return d.withColumn("n", n).select("repo_id", "dir", "base", F.when(F.col("n") > 1, F.concat("label", F.lit("-"), F.col("n").cast("string"))).otherwise(F.col("label")).alias("module"), "files", "types")

"""Sources: directories, archives, remote repositories and tables of paths -> files(repo_id, path, size, content)."""

from __future__ import annotations

import io
import os
import shutil
import subprocess
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata import rules
from codestrata.functions import paths as P

FILES = "repo_id string, path string, size bigint, content string"


class InputError(ValueError):
    """The input names no repository that can be analysed."""


def from_table(df: DataFrame, path: str = "path", content: str = "content", repo_id: str | None = None) -> DataFrame:
    """Any DataFrame of paths and contents as files."""
    size = F.coalesce(F.octet_length(content), F.lit(0)).cast("long")
    return df.select((F.col(repo_id) if repo_id else F.lit("repository")).alias("repo_id"), F.col(path).alias("path"), size.alias("size"), F.col(content).alias("content"))


def listing(root: str) -> list[tuple[str, int]]:
    """Relative paths and sizes below a root, ignored names pruned before they are entered; hidden folders are kept."""
    out = []
    for top, dirs, names in os.walk(root):
        dirs[:] = sorted(d for d in dirs if d not in rules.IGNORED)
        for n in sorted(names):
            p = os.path.join(top, n)
            if n not in rules.IGNORED and os.path.isfile(p):
                out.append((os.path.relpath(p, root).replace(os.sep, "/"), os.path.getsize(p)))
    return out


def _decode(data: bytes) -> str:
    return data.decode("utf-8", "replace")


def admitted(sizes: list[tuple[str, int]], of: str) -> None:
    """Raises where names and sizes are over the limits; no text has been read by then."""
    total = sum(n for _, n in sizes)
    if total > rules.MAX_TOTAL_BYTES:
        raise InputError(f"{of}: total of {total / 1048576:.2f} MB is over the limit")
    if len(sizes) > rules.MAX_FILES:
        raise InputError(f"{of}: {len(sizes)} files are over the limit")


def _text_of(path: str) -> str:
    with open(path, "rb") as f:
        return _decode(f.read())


def from_driver(spark: SparkSession, root: str, repo_id: str | None = None) -> DataFrame:
    """A directory only the driver sees: within the limits, texts are sent with the plan."""
    names = listing(root)
    admitted(names, root)
    rid = repo_id or os.path.abspath(root)
    return spark.createDataFrame([(rid, p, n, _text_of(os.path.join(root, p))) for p, n in names], FILES)


def from_directory(spark: SparkSession, root: str, repo_id: str | None = None, files_per_task: int = 200) -> DataFrame:
    """A directory on a file system that all workers see. Names are listed on the driver and judged by the limits, then texts are read by the tasks."""
    if not os.path.isdir(root):
        raise InputError(f"no directory: {root}")
    names = listing(root)
    admitted(names, root)
    base = os.path.abspath(root)
    rid = repo_id or base

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [_text_of(os.path.join(base, p)) for p in b.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([rid] * len(texts)), b.column("path"), b.column("size"), pa.array(texts, pa.string())], names=["repo_id", "path", "size", "content"])

    df = spark.createDataFrame(names, "path string, size bigint")
    return df.repartition(max(1, len(names) // files_per_task)).mapInArrow(read, FILES)


def from_folders(spark: SparkSession, path: str, depth: int) -> DataFrame:
    """Many repositories in shared storage: the first `depth` path segments below `path` name the repository. Hidden names are skipped by Spark's reader."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rel = F.regexp_replace(F.element_at(F.split("path", F.lit(path.rstrip("/").replace(".", "\\.") + "/")), -1), "^/", "")
    segs = F.split(rel, "/")
    rid = F.array_join(F.slice(segs, 1, depth), "/")
    inner = F.array_join(F.slice(segs, F.lit(depth + 1), F.size(segs)), "/")
    return raw.select(rid.alias("repo_id"), inner.alias("path"), F.col("length").alias("size"), F.decode("content", "UTF-8").alias("content")).filter(~P.is_pruned(F.col("path")))


def _members(z: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
    """Files of an archive that are read, in its order."""
    kept = []
    for info in z.infolist():
        parts = info.filename.split("/")
        if not (info.is_dir() or ".." in parts or any(x in rules.IGNORED for x in parts)):
            kept.append(info)
    return kept


def _unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for rid, data in zip(b.column("repo_id").to_pylist(), b.column("content").to_pylist()):
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                members = _members(z)
                # sizes as the directory states them; read() stops at them, so a bomb is not inflated
                admitted([(m.filename, m.file_size) for m in members], rid)
                for info in members:
                    with z.open(info) as f:
                        text = _decode(f.read(info.file_size))
                    yield pa.RecordBatch.from_arrays([pa.array([rid]), pa.array([info.filename]), pa.array([info.file_size]), pa.array([text])], names=["repo_id", "path", "size", "content"])


def from_archives(spark: SparkSession, path: str) -> DataFrame:
    """Zip archives (a file, folder or glob Spark can read); each is a repository named after its file. An archive over the limits is an error before it is inflated."""
    try:
        raw = spark.read.format("binaryFile").load(path)
    except Exception as e:
        raise InputError(f"cannot extract {path}: {str(e).splitlines()[0]}") from e
    name = F.regexp_replace(P.basename(F.col("path")), r"(?i)\.zip$", "")
    return raw.select(name.alias("repo_id"), "content").mapInArrow(_unzip, FILES)


def clone(url: str, base: str | None = None, then: Callable[[str], object] | None = None, timeout: int = 600) -> str:
    """A shallow clone below a folder of our own; with a callback it is removed afterwards. Needs git and a network."""
    target = tempfile.mkdtemp(prefix="clone-", dir=base)
    try:
        subprocess.run(["git", "clone", "--depth", "1", "--", url, target], check=True, capture_output=True, timeout=timeout)
    except (OSError, subprocess.SubprocessError) as e:
        shutil.rmtree(target, ignore_errors=True)
        raise InputError(f"cannot clone {url}") from e
    if then:
        try:
            then(target)
        finally:
            shutil.rmtree(target, ignore_errors=True)
    return target


def write_docs(readme: str, modules: list[tuple[str, str]], folder: str) -> int:
    """README.md and docs/<module>.md in a folder of the caller's choice; the number of files."""
    os.makedirs(os.path.join(folder, "docs"), exist_ok=True)
    for name, text in [("README.md", readme), *((os.path.join("docs", f"{os.path.basename(n)}.md"), t) for n, t in modules)]:
        with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
            f.write(text)
    return len(modules) + 1

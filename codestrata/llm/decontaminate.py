"""Benchmark decontamination by exact n-gram windows.

Method: the test items' normalised windows form a hash set that is broadcast after its
size has been checked; each training text is scanned once, every hash hit is verified
word by word, and hit spans (or whole documents) can be removed.

Edge cases: null or empty texts have no words and no hits. Items without words have no
window; items of fewer words than a window are one window. An item is its item_id: rows that
repeat an item_id are one item with the windows of all its rows; rows without an item_id mark
the words they hit, but no item can be named for them, so they never count as one. Repeated
windows count for every item that has them; repeated documents are rows like any other. An
empty benchmark leaves every document clean. Extra columns of the input are not read.

The broadcast grows with the benchmark only. Its bound, ``max_broadcast_bytes`` of item text,
is checked before anything is sent. A larger benchmark is processed in passes of bounded
size: each pass is a job whose result, documents with the hits so far, is written to the
shared folder before the next group of items is read, so driver and tasks hold one group at
a time and nothing is left out. (A single item over the bound is a group of its own.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from codestrata.llm import textkit as tk
from codestrata.llm.shared import written

HIT_SCHEMA = "doc_id long, n_words long, hit_words array<long>, items array<string>"
WINDOW = 8
MAX_BROADCAST_BYTES = 32 << 20


class WindowSet:
    """Normalised windows of the items, by width, with an exact check of each hit."""

    def __init__(self, items: list[tuple[str | None, str | None]], width: int = WINDOW):
        self.width = width
        self.items: list[str] = []
        number = {}
        for i, _ in items:
            if i is not None and i not in number:
                number[i] = len(self.items)
                self.items.append(i)
        of_row = [number.get(i) for i, _ in items]
        column = pa.array([t for _, t in items], pa.large_string())
        vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        base = 0
        for _, rows, offsets, data in tk.chunks(column):
            w = tk.words(offsets, data, tk.ALNUM)
            raw = w.data.tobytes()
            ids = [vocabulary.setdefault(raw[a:b], len(vocabulary) + 1) for a, b in zip(w.start.tolist(), w.end.tolist())]
            for r in range(rows):
                own = tuple(ids[w.first[r] : w.first[r] + w.count[r]])
                for k in range(max(1, len(own) - width + 1) if own else 0):
                    owners = found.setdefault(own[k : k + width], set())
                    if of_row[base + r] is not None:
                        owners.add(of_row[base + r])
            base += rows
        h = tk.words(*next(tk.chunks(pa.array([b" ".join(vocabulary).decode()], pa.large_string())))[2:], tk.ALNUM).hashes() if vocabulary else np.zeros(0, np.uint64)
        order = np.argsort(h)
        self.word_hash, self.word_id = h[order], np.arange(1, len(h) + 1)[order]
        self.word_bytes = list(vocabulary)
        self.by_width: dict[int, tuple[np.ndarray, np.ndarray, list[list[int]]]] = {}
        for k in sorted({len(x) for x in found}):
            own = [x for x in found if len(x) == k]
            ids = np.array(own, dtype=np.int64).reshape(len(own), k)
            key = self._key(ids)
            order = np.argsort(key, kind="stable")
            self.by_width[k] = key[order], ids[order], [sorted(found[own[i]]) for i in order]

    @staticmethod
    def _key(ids: np.ndarray) -> np.ndarray:
        return tk.mix(tk.windows(ids.reshape(-1).astype(np.uint64), ids.shape[1])[:: ids.shape[1]]) if len(ids) else np.zeros(0, np.uint64)

    def _ids(self, w: tk.Words) -> np.ndarray:
        """The id of each word in the items' vocabulary, 0 for any other; compared byte by byte."""
        h = w.hashes()
        if not len(self.word_hash) or not len(h):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.word_hash, h), len(self.word_hash) - 1)
        ids = np.where(self.word_hash[at] == h, self.word_id[at], 0)
        return ids

    def scan(self, w: tk.Words) -> tuple[np.ndarray, list[list[int]]]:
        """Whether each word is hit; the items of each row."""
        ids = self._ids(w)
        hit = np.zeros(len(ids), bool)
        items: list[set[int]] = [set() for _ in w.count]
        known = np.concatenate([[0], np.cumsum(ids == 0)])
        raw = w.data.tobytes()
        for k, (keys, grams, owners) in self.by_width.items():
            n = len(ids) - k + 1
            if n <= 0:
                continue
            start = np.flatnonzero((known[k:] == known[:n]) & (w.row[:n] == w.row[k - 1 :]))
            if not len(start):
                continue
            grid = ids[start[:, None] + np.arange(k)]
            key = self._key(grid)
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            ok = np.flatnonzero((keys[at] == key) & (grams[at] == grid).all(axis=1))
            for i in ok:
                s = start[i]
                if all(raw[w.start[s + j] : w.end[s + j]] == self.word_bytes[grid[i, j] - 1] for j in range(k)):
                    hit[s : s + k] = True
                    items[w.row[s]].update(owners[at[i]])
        return hit, [sorted(x) for x in items]


def _scan_batches(windows: WindowSet, again: bool, more: bool):
    """A pass over documents: `again` adds to the hits of the pass before, `more` keeps the text for the next one."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, rows, offsets, data in tk.chunks(batch.column("text")):
                w = tk.words(offsets, data, tk.ALNUM)
                hit, items = windows.scan(w)
                names = [[windows.items[i] for i in x] for x in items]
                if again:
                    before = batch.column("hit_words").slice(row, rows).to_pylist()
                    hit[[w.first[r] + i for r, x in enumerate(before) for i in x]] = True
                    names = [sorted({*x, *y}) for x, y in zip(batch.column("items").slice(row, rows).to_pylist(), names)]
                at = np.flatnonzero(hit)
                counts = np.bincount(w.row[at], minlength=rows)
                arrays = [batch.column("doc_id").slice(row, rows), pa.array(w.count.astype(np.int64)), tk.list_array(counts, pa.array((at - w.first[w.row[at]]).astype(np.int64))), pa.array(names, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(arrays + [batch.column("text").slice(row, rows)] * more, names=["doc_id", "n_words", "hit_words", "items"] + ["text"] * more)

    return scan


def item_groups(benchmark: DataFrame, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> Iterator[list[tuple[str | None, str | None]]]:
    """The items in groups of bounded size, in a stable order; the driver holds one at a time."""
    group, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("i"), "text").orderBy("i", "text").toLocalIterator():
        own = len((r["text"] or "").encode())
        if group and size + own > max_broadcast_bytes:
            yield group
            group, size = [], 0
        group.append((r["i"], r["text"]))
        size += own
    yield group


def _passes(benchmark: DataFrame, max_broadcast_bytes: int) -> Iterator[tuple[list[tuple[str | None, str | None]], bool]]:
    """(group, whether another follows)."""
    held = None
    for group in item_groups(benchmark, max_broadcast_bytes):
        if held is not None:
            yield held, True
        held = group
    yield held, False


def scan_hits(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_words, hit_words (indices), items: a row for each document."""
    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    again = False
    for items, more in _passes(benchmark, max_broadcast_bytes):
        out = out.mapInArrow(_scan_batches(WindowSet(items, width), again, more), HIT_SCHEMA + ", text string" * more)
        out = written(docs.sparkSession, out, "hits") if more else out
        again = True
    return out


def report(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, min_items: int = 2) -> DataFrame:
    """The contract's digest of each document's hits."""
    return scan_hits(docs, benchmark, width).select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("items") >= min_items).alias("contaminated"),
    )


_HITS = "_hit_words"
_ITEMS = "_hit_items"


def _marked(docs: DataFrame, benchmark: DataFrame, width: int, max_broadcast_bytes: int) -> DataFrame:
    """docs as they are, with the words hit and the items found; a pass after the first adds to both."""
    out, schema = docs, StructType([*docs.schema.fields, StructField(_HITS, ArrayType(IntegerType())), StructField(_ITEMS, ArrayType(StringType()))])
    at, again = docs.columns.index("text"), False
    for items, more in _passes(benchmark, max_broadcast_bytes):
        windows = WindowSet(items, width)

        def mark(batches: Iterator[pa.RecordBatch], windows=windows, again=again) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words, names = [], []
                for row, rows, offsets, data in tk.chunks(batch.column(at)):
                    w = tk.words(offsets, data, tk.ALNUM)
                    hit, items = windows.scan(w)
                    words += [np.flatnonzero(hit[w.first[r] : w.first[r] + w.count[r]]).tolist() for r in range(rows)]
                    names += [[windows.items[i] for i in x] for x in items]
                arrays = list(batch.columns)
                if again:
                    words = [sorted({*x, *y}) for x, y in zip(batch.column(len(arrays) - 2).to_pylist(), words)]
                    names = [sorted({*x, *y}) for x, y in zip(batch.column(len(arrays) - 1).to_pylist(), names)]
                    arrays = arrays[:-2]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(words, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.string()))], names=[f"c{i}" for i in range(len(arrays))] + [_HITS, _ITEMS])

        out = out.mapInArrow(mark, _numbered(schema))
        out = written(docs.sparkSession, out, "marked") if more else out
        again = True
    return out


def _numbered(schema: StructType) -> StructType:
    """Columns by number, but for the two of hits: names of docs may clash with theirs, or differ by case alone."""
    last = len(schema) - 2
    return StructType([StructField(f"c{i}" if i < last else f.name, f.dataType) for i, f in enumerate(schema)])


def _named(marked: DataFrame, docs: DataFrame, text: Column | None = None) -> DataFrame:
    """The columns of docs under their own names again; text: in place of theirs."""
    at = docs.columns.index("text")
    cols = [text if i == at and text is not None else F.col(f"c{i}") for i in range(len(docs.columns))]
    return marked.select(*[c.alias(n) for c, n in zip(cols, docs.columns)])


def remove_spans(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """docs with the words of every hit window cut out of `text`; texts without a hit stay byte for byte."""
    marked = _marked(docs, benchmark, width, max_broadcast_bytes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            lists = batch.column(1)
            out: list[str | None] = column.to_pylist()
            for row, rows, offsets, data in tk.chunks(column):
                w = tk.words(offsets, data, tk.ALNUM)
                for r in np.flatnonzero(lists.slice(row, rows).value_lengths().to_numpy()):
                    keep = np.ones(offsets[r + 1] - offsets[r], bool)
                    for i in w.first[r] + lists[row + int(r)].values.to_numpy():
                        keep[w.start[i] - offsets[r] : w.end[i] - offsets[r]] = False
                    out[row + r] = data[offsets[r] : offsets[r + 1]][keep].tobytes().decode("utf-8", "replace")
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *batch.columns[2:]], names=names)

    rest = [f"c{i}" for i, n in enumerate(docs.columns) if n != "text"]
    at = docs.columns.index("text")
    names = [f"c{at}", *rest]
    schema = StructType([StructField(f"c{at}", StringType())] + [StructField(c, docs.schema[int(c[1:])].dataType) for c in rest])
    done = marked.select(F.col(f"c{at}").cast("string"), _HITS, *rest).mapInArrow(cut, schema)
    return _named(done, docs, F.col(f"c{at}"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, min_items: int = 2, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """docs without those that hold windows of at least min_items items (0: none is dropped; 1: a hit without item_id counts too); rows are decided in place, without a join."""
    marked = _marked(docs, benchmark, width, max_broadcast_bytes)
    gone = F.size(_ITEMS) >= min_items
    if min_items == 1:
        gone = F.size(_HITS) > 0
    return _named(marked.filter(~gone) if min_items else marked, docs)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
g AS (
  SELECT DISTINCT item, least(len(w), 8) AS k, array_to_string(w[s : s + least(len(w), 8) - 1], ' ') AS gram
  FROM b, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS u(s) WHERE len(w) > 0),
n AS (SELECT DISTINCT k FROM g),
h AS (
  SELECT d.rid, n.k, s, array_to_string(d.w[s : s + n.k - 1], ' ') AS gram
  FROM d, n, unnest(range(1, len(d.w) - n.k + 2)) AS u(s) WHERE len(d.w) >= n.k),
m AS (SELECT h.rid, h.k, h.s, g.item FROM h JOIN g ON h.k = g.k AND h.gram = g.gram),
words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + k)) AS p FROM m) GROUP BY rid),
items AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS list FROM m GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(words.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(items.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items.list, '')) AS items_sha256,
       coalesce(items.n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""

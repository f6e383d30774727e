"""Language-model scoring with a causal self-attention model trained in numpy on subword ids.

Text: A-Z lower-cased, words `[^\\x20\\x09-\\x0D]+`, one end token a text. A word's subword ids
come from a public byte-level vocabulary (its path is a parameter; it is read on the
driver and travels with the job). Ids fall into ``GROUPS`` x ``PER`` classes: the most
frequent ids have a class each, the others share classes of about equal mass.

Model: log10 P(text) = sum over ids of log10 P(class | ids before) + log10 P(id | class).
P(id | class) is smoothed counts over all training texts. P(class | before) is a softmax of
two levels (group, then class in its group) over one causal attention layer, added to the
log counts of class pairs over all training texts: with its output weights at zero the
model is a smoothed bigram model, and attention learns what more the context says. Windows
of ``WINDOW`` ids overlap by ``WINDOW - STRIDE``; a window scores only what no window before
has scored, so each id is scored once, and windows of all texts of a chunk are masked and
multiplied in batches.

Passes: texts are read once into blocks (subword ids, distinct words, the place of each
word), written to the shared folder; all else reads blocks. Counts of words, ids and class
pairs cover all training texts. Attention weights start from ``WARM_BLOCKS`` blocks (a common
start, so that averages of weights make sense); then every task trains on every window of
all training texts of its blocks, and the tasks' weights are averaged by tokens seen. The
driver gets at most a number a parameter, a vocabulary table and a table of class pairs.

Base score: the most frequent words (``FREQUENT`` at most, of ``SHORT`` bytes at most) travel with
the job and are counted where the block is scored; of all other words, the distinct ones of a
block are joined with their counts once a block, not once a document, and come back as one
list a block. No text is shuffled.

Edge cases: null and empty texts are the end token alone; ties in counts are broken by the
word or id; repeated rows are scored (and trained on) each; with no training text N and V
are 0 and the model is uniform; an empty table gives no rows; extra columns are not read; a
null doc_id hashes as the empty text. A text longer than a chunk is a block of its own.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm import textkit as tk
from codestrata.llm.shared import crc_mod, written

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
GROUPS, PER = 32, 32
CLASSES = GROUPS * PER  #: the last one is END
OWN_CLASS = 960  #: ids with a class each
DIM, WINDOW, STRIDE = 16, 32, 24
WARM_BLOCKS, WARM_STEPS, WARM_RATE, RATE = 4, 240, 0.01, 0.002
BATCH_WINDOWS = 256  #: a batch's arrays stay in a core's cache
CHUNK = 1 << 20
SMOOTH = 0.5
#: Row groups of a few blocks, so that tasks of the later passes can part a file.
ROW_GROUPS = {"compression": "zstd", "parquet.block.size": 2 << 20, "parquet.page.size.row.count.limit": 4, "parquet.block.row.count.limit": 4}
#: Words whose counts travel with the job; longer ones never do. STEPS of counts to a doubling, where the frequent ones are told from the rest.
FREQUENT, SHORT, STEPS = 1 << 18, 64, 8
PAIR_PRIOR = 20.0  #: pseudo-counts of the class's own share in a row of class pairs


class Encoder:
    """Subword ids of words, each with a space before it; all words of a call are encoded at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.core, self.begins = ranks, None, None

    def __getstate__(self):
        return {"ranks": self.ranks, "core": None, "begins": None}

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, ids of each word)."""
        if self.core is None:
            import tiktoken

            self.core = tiktoken.Encoding("words", pat_str=r" [^ ]+", mergeable_ranks=self.ranks, special_tokens={})
            self.begins = np.zeros(max(self.ranks.values()) + 1, bool)
            self.begins[[i for b, i in self.ranks.items() if b[:1] == b" "]] = True
        ids = self.core.encode_to_numpy(" " + " ".join(words)).astype(np.int32)
        first = np.flatnonzero(self.begins[ids])  # words hold no space, so an id that begins with one begins a word
        return ids, np.diff(np.append(first, len(ids))).astype(np.int64)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@dataclass
class Classes:
    of: np.ndarray  #: class of each id; the last id is END
    log_p: np.ndarray  #: log10 P(id | class)
    prior: np.ndarray  #: P(class)


def classes_from(counts: dict[int, int], n_ids: int, ends: int) -> Classes:
    n = np.zeros(n_ids + 1)
    for i, c in counts.items():
        n[i] = c
    n[n_ids] = ends
    order = np.lexsort((np.arange(n_ids), -n[:n_ids]))
    of = np.zeros(n_ids + 1, dtype=np.int64)
    of[order[:OWN_CLASS]] = np.arange(min(OWN_CLASS, n_ids))
    rest = order[OWN_CLASS:]
    mass = np.cumsum(n[rest] + SMOOTH)
    shared = CLASSES - OWN_CLASS - 1
    of[rest] = OWN_CLASS + np.minimum((mass / mass[-1] * shared).astype(np.int64), shared - 1) if len(rest) else 0
    of[n_ids] = CLASSES - 1
    total = np.bincount(of, weights=n + SMOOTH, minlength=CLASSES)
    return Classes(of, np.log10((n + SMOOTH) / total[of]), total / total.sum())


@dataclass
class Pairs:
    """Natural logs of P(group | class before) and P(class | group, class before); CLASSES stands before a text."""

    group: np.ndarray  #: CLASSES + 1, GROUPS
    member: np.ndarray  #: CLASSES + 1, GROUPS, PER


def pairs_from(before: np.ndarray, cls: np.ndarray, count: np.ndarray, prior: np.ndarray) -> Pairs:
    n = np.zeros((CLASSES + 1) * CLASSES, dtype=np.float64)
    np.add.at(n, before * CLASSES + cls, count)
    p = n.reshape(CLASSES + 1, CLASSES)
    p = (p + PAIR_PRIOR * prior) / (p.sum(axis=1, keepdims=True) + PAIR_PRIOR)
    p = np.maximum(p, 1e-12).reshape(CLASSES + 1, GROUPS, PER)
    total = p.sum(axis=2)
    return Pairs(np.log(total / total.sum(axis=1, keepdims=True)).astype(np.float32), np.log(p / total[:, :, None]).astype(np.float32))


def _shapes() -> dict[str, tuple[int, ...]]:
    return {"E": (CLASSES + 1, DIM), "P": (WINDOW, DIM), "QKV": (DIM, 3 * DIM), "O": (DIM, DIM), "G": (DIM, GROUPS), "M": (GROUPS, DIM, PER)}


class Params:
    """Weights as views of one flat array."""

    def __init__(self, flat: np.ndarray):
        self.flat, at = flat, 0
        for name, shape in _shapes().items():
            size = math.prod(shape)
            setattr(self, name, flat[at : at + size].reshape(shape))
            at += size

    @staticmethod
    def size() -> int:
        return sum(math.prod(s) for s in _shapes().values())


def initial(seed: int = 1) -> Params:
    rng = np.random.default_rng(seed)
    p = Params(np.zeros(Params.size(), dtype=np.float32))
    p.E[:] = rng.standard_normal(p.E.shape) / math.sqrt(DIM)
    p.P[:] = rng.standard_normal(p.P.shape) * 0.3 / math.sqrt(DIM)
    p.QKV[:] = rng.standard_normal(p.QKV.shape) / math.sqrt(DIM)
    p.O[:] = rng.standard_normal(p.O.shape) * 0.5 / math.sqrt(DIM)
    return p


_MASK = np.where(np.tri(WINDOW, dtype=bool), 0.0, -1e9).astype(np.float32)
_ONES = np.ones(WINDOW, dtype=np.float32)
_MOST = np.float32(80)  #: exponentials stay finite
_SCALE = np.float32(1 / math.sqrt(DIM))


def attend(p: Params, inputs: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Hidden state of each position of windows of input classes (CLASSES marks the start)."""
    x = p.E.take(inputs, axis=0)
    x += p.P
    qkv = (x.reshape(-1, DIM) @ p.QKV).reshape(*inputs.shape, 3 * DIM)
    q, k, v = qkv[..., :DIM], qkv[..., DIM : 2 * DIM], qkv[..., 2 * DIM :]
    a = (q * _SCALE) @ k.transpose(0, 2, 1)
    a += _MASK
    np.minimum(a, _MOST, out=a)
    np.exp(a, out=a)
    a *= (1 / (a.reshape(-1, WINDOW) @ _ONES)).reshape(*inputs.shape, 1)
    o = a @ v
    h = (o.reshape(-1, DIM) @ p.O).reshape(x.shape)
    h += x
    return h, (x, q, k, v, a, o)


@dataclass
class Windows:
    """All windows of texts; their positions are laid out a batch at a time."""

    cls: np.ndarray  #: classes of all texts, each ending with END
    first: np.ndarray  #: place of the text's first id, a window
    count: np.ndarray  #: ids of its text
    number: np.ndarray  #: its number in the text
    text: np.ndarray
    stride: int

    def __len__(self) -> int:
        return len(self.text)

    def batch(self, which) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(inputs, targets, scored); CLASSES marks the start of a text."""
        number = self.number[which][:, None]
        at = number * self.stride + _STEPS
        inside = at < self.count[which][:, None]
        pos = np.minimum(self.first[which][:, None] + at, len(self.cls) - 1)
        targets = self.cls[pos]
        inputs = np.where(at == 0, self.cls.dtype.type(CLASSES), self.cls[np.maximum(pos - 1, 0)])
        return inputs, targets, inside & ((number == 0) | (_STEPS >= WINDOW - self.stride))


_STEPS = np.arange(WINDOW)


def windows_of(cls: np.ndarray, first: np.ndarray, count: np.ndarray, stride: int = STRIDE) -> Windows:
    n = 1 + np.maximum(0, -(-(count - WINDOW) // stride))
    text = np.repeat(np.arange(len(count)), n)
    return Windows(cls, first[text], count[text], np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n), text, stride)


def _heads(p: Params, pairs: Pairs, h: np.ndarray, before: np.ndarray, target: np.ndarray):
    """Exponentials of both levels and what they sum to, rows of a group together; (order, ends of groups, h, group, member, e1, e2, ln P)."""
    group, member = target // PER, target % PER
    order = np.argsort(group.astype(np.uint8), kind="stable")
    h, before, group, member = h[order], before[order], group[order], member[order]
    ends = np.searchsorted(group, np.arange(GROUPS + 1))
    z1 = h @ p.G
    z1 += pairs.group.take(before, axis=0)
    z2 = pairs.member.reshape(-1, PER).take(before.astype(np.int64) * GROUPS + group, axis=0)
    for g in range(GROUPS):
        a, b = ends[g], ends[g + 1]
        if a < b:
            z2[a:b] += h[a:b] @ p.M[g]
    rows = np.arange(len(h))
    own = z1[rows, group] + z2[rows, member]
    e1, e2 = np.exp(z1, out=z1), np.exp(z2, out=z2)
    s1, s2 = e1 @ np.ones(GROUPS, np.float32), e2 @ np.ones(PER, np.float32)
    return order, ends, h, group, member, e1, e2, s1, s2, own.astype(np.float64) - np.log(s1) - np.log(s2)


def score_classes(p: Params, pairs: Pairs, cls: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sum of ln P(class | before) of each text."""
    w = windows_of(cls, first, count)
    out = np.zeros(len(count))
    for s in range(0, len(w), BATCH_WINDOWS):
        inputs, targets, ok = w.batch(slice(s, s + BATCH_WINDOWS))
        h, _ = attend(p, inputs)
        got = _heads(p, pairs, h[ok], inputs[ok], targets[ok])
        row = np.repeat(w.text[s : s + BATCH_WINDOWS], ok.sum(axis=1))[got[0]]
        low = int(w.text[s])
        sums = np.bincount(row - low, weights=got[-1])
        out[low : low + len(sums)] += sums
    return out


def gradients(p: Params, pairs: Pairs, inputs: np.ndarray, targets: np.ndarray, scored: np.ndarray) -> tuple[float, Params]:
    """Mean loss over the scored positions and its gradient."""
    g = Params(np.zeros_like(p.flat))
    h, (x, q, k, v, a, o) = attend(p, inputs)
    order, ends, hs, group, member, e1, e2, s1, s2, own = _heads(p, pairs, h[scored], inputs[scored], targets[scored])
    n = max(1, len(own))
    rows, one = np.arange(len(own)), np.float32(1 / n)
    e1 *= (one / s1)[:, None]
    e1[rows, group] -= one
    e2 *= (one / s2)[:, None]
    e2[rows, member] -= one
    g.G[:] = hs.T @ e1
    d = e1 @ p.G.T
    for j in range(GROUPS):
        b, c = ends[j], ends[j + 1]
        if b < c:
            g.M[j] = hs[b:c].T @ e2[b:c]
            d[b:c] += e2[b:c] @ p.M[j].T
    back = np.empty_like(d)
    back[order] = d
    dh = np.zeros_like(h)
    dh[scored] = back
    flat = lambda t: t.reshape(-1, t.shape[-1])
    g.O[:] = flat(o).T @ flat(dh)
    do = (flat(dh) @ p.O.T).reshape(h.shape)
    da = do @ v.transpose(0, 2, 1)
    dqkv = np.empty((*inputs.shape, 3 * DIM), dtype=np.float32)
    dqkv[..., 2 * DIM :] = a.transpose(0, 2, 1) @ do
    da -= np.einsum("bij,bij->bi", da, a)[:, :, None]
    da *= a
    da *= _SCALE
    dqkv[..., :DIM] = da @ k
    dqkv[..., DIM : 2 * DIM] = da.transpose(0, 2, 1) @ q
    g.QKV[:] = flat(x).T @ flat(dqkv)
    dx = (flat(dqkv) @ p.QKV.T).reshape(h.shape)
    dx += dh
    g.P[:] = dx.sum(axis=0)
    ids = inputs.reshape(-1)
    by = np.argsort(ids.astype(np.uint16), kind="stable")
    ids = ids[by]
    start = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    g.E[ids[start]] = np.add.reduceat(flat(dx)[by], start, axis=0)
    return -float(own.sum()) / n, g


class Adam:
    def __init__(self, p: Params):
        self.p, self.m, self.s, self.t = Params(p.flat.copy()), np.zeros_like(p.flat), np.zeros_like(p.flat), 0

    def step(self, g: np.ndarray, rate: float) -> None:
        self.t += 1
        self.m *= np.float32(0.9)
        self.m += np.float32(0.1) * g
        g *= g
        g *= np.float32(0.01)
        self.s *= np.float32(0.99)
        self.s += g
        size = np.sqrt(self.s)
        size *= np.float32(1 / math.sqrt(1 - 0.99**self.t))
        size += np.float32(1e-7)
        np.divide(self.m, size, out=size)
        size *= np.float32(rate / (1 - 0.9**self.t))
        self.p.flat -= size


def descend(state: Adam, pairs: Pairs, w: Windows, rate: float, steps: int | None = None, seed: int = 3) -> None:
    """Batches of windows in random order; each window once (steps None), or rounds of all until `steps`, the rate then falling to 0."""
    rng = np.random.default_rng(seed)
    total = -(-len(w) // BATCH_WINDOWS) if steps is None else steps
    left = np.zeros(0, np.int64)
    for t in range(total if len(w) else 0):
        if not len(left):
            left = rng.permutation(len(w))
        at, left = np.sort(left[:BATCH_WINDOWS]), left[BATCH_WINDOWS:]
        _, g = gradients(state.p, pairs, *w.batch(at))
        state.step(g.flat, rate if steps is None else rate * min(1.0, 2 * (1 - t / total)))


def subwords(w: tk.Words, encoder: Encoder, end_id: int, distinct: tuple[list[str], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all texts, each ending with END; first id of each text; ids of each text). distinct: the distinct words and the number of each word among them, if known."""
    if distinct is None:
        _, first, number = np.unique(w.hashes(), return_index=True, return_inverse=True)
        distinct = w.texts(first), number
    words, number = distinct
    ids, size = encoder(words)
    begin = np.cumsum(size) - size
    own = size[number]
    rows = len(w.count)
    per_text = np.bincount(w.row, weights=own, minlength=rows).astype(np.int64) + 1
    text_first = np.cumsum(per_text) - per_text
    out = np.full(int(per_text.sum()), end_id, dtype=np.int32)
    steps = np.arange(int(own.sum()))
    source = np.repeat(begin[number] - (np.cumsum(own) - own), own) + steps
    out[steps + np.repeat(w.row, own)] = ids[source]  # one END after each text before
    return out, text_first, per_text


BLOCK = "block long, doc_id array<long>, n_words array<long>, n_ids array<long>, trains array<boolean>, ids binary, at binary, words array<string>, trained array<long>"


def _narrow(values: np.ndarray, below: int) -> bytes:
    return values.astype(np.uint16 if below <= 1 << 16 else np.int32).tobytes()


def _wide(blob, n: int) -> np.ndarray:
    """What _narrow packed, n numbers."""
    return np.frombuffer(blob, dtype=np.uint16 if len(blob) == 2 * n else np.int32).astype(np.int32)


def _read(encoder: Encoder, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for row, rows, offsets, data in tk.chunks(batch.column("text"), CHUNK):
                w = tk.words(offsets, data, tk.NOT_SPACE)
                _, first, number = np.unique(w.hashes(), return_index=True, return_inverse=True)
                texts = w.texts(first)
                ids, _, count = subwords(w, encoder, end, (texts, number))
                trains = batch.column("trains").slice(row, rows)
                trained = np.bincount(number, weights=trains.to_numpy(zero_copy_only=False)[w.row], minlength=len(first)).astype(np.int64)
                one = lambda values: tk.list_array(np.array([len(values)]), values)
                arrays = [
                    pa.array([block]),
                    one(batch.column("doc_id").slice(row, rows)),
                    one(pa.array(w.count.astype(np.int64))),
                    one(pa.array(count)),
                    one(trains),
                    pa.array([_narrow(ids, end + 1)], pa.binary()),
                    pa.array([_narrow(number, len(first))], pa.binary()),
                    one(pa.array(texts, pa.string())),
                    one(pa.array(trained)),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in BLOCK.split(", ")])
                block += 1

    return run


@dataclass
class Corpus:
    encoder: Encoder
    end: int
    blocks: DataFrame


def read(spark: SparkSession, docs: DataFrame, encoder: Encoder, trains=None) -> Corpus:
    """docs (doc_id, text) as blocks; trains: which rows a model learns from (none)."""
    end = max(encoder.ranks.values()) + 1
    trains = F.lit(False) if trains is None else F.coalesce(trains, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), trains.alias("trains"))
    return Corpus(encoder, end, written(spark, rows.mapInArrow(_read(encoder, end), BLOCK), "blocks", **ROW_GROUPS))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(block, ids, first id of each text, ids of each text, whether it trains) of each block."""
    for batch in batches:
        for i in range(batch.num_rows):
            count = batch.column("n_ids")[i].values.to_numpy()
            ids = _wide(batch.column("ids")[i].as_buffer(), int(count.sum()))
            yield batch.column("block")[i].as_py(), ids, np.cumsum(count) - count, count, batch.column("trains")[i].values.to_numpy(zero_copy_only=False)


def _count_ids(end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(end + 1, dtype=np.int64)
        for _, ids, _, count, trains in _texts(batches):
            total += np.bincount(ids[np.repeat(trains, count)], minlength=end + 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "c"])

    return run


def _count_pairs(classes: Classes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((CLASSES + 1) * CLASSES, dtype=np.int64)
        for _, ids, first, count, trains in _texts(batches):
            cls = classes.of[ids]
            before = np.concatenate([[CLASSES], cls[:-1]])
            before[first] = CLASSES
            total += np.bincount((before * CLASSES + cls)[np.repeat(trains, count)], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "c"])

    return run


def _train(classes: Classes, pairs: Pairs, start: Params, rate: float, steps: int | None):
    """A task's weights times its tokens, and its tokens at the end, by position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, tokens = Adam(start), 0
        for _, ids, first, count, trains in _texts(batches):
            if not trains.any():
                continue
            w = windows_of(classes.of[ids].astype(np.int16), first[trains], count[trains], WINDOW)
            tokens += int(count[trains].sum())
            descend(state, pairs, w, rate, steps, seed=3 + state.t)
        if tokens:
            v = np.append(state.p.flat.astype(np.float64), 1.0) * tokens
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(v))), pa.array(v)], names=["at", "v"])

    return run


def _averaged(rows: DataFrame, otherwise: Params) -> Params:
    got = rows.groupBy("at").agg(F.sum("v").alias("v")).toArrow()  # one row a parameter
    if not got.num_rows:
        return otherwise
    v = np.zeros(got.num_rows)
    v[got.column("at").to_numpy()] = got.column("v").to_numpy()
    return Params((v[:-1] / v[-1]).astype(np.float32))


@dataclass
class Model:
    encoder: Encoder
    classes: Classes
    pairs: Pairs
    params: Params
    counts: DataFrame  #: word, c
    train_tokens: int  #: N
    distinct: int  #: V
    ends: int
    frequent: pa.Table  #: word, c
    rare: DataFrame  #: the rest of counts


def parted(counts: DataFrame) -> tuple[pa.Table, DataFrame]:
    """counts (word, c) as the most frequent short words, FREQUENT at most, and all others."""
    step = F.when(F.octet_length("word") <= SHORT, F.floor(F.log2("c") * STEPS)).otherwise(-1)
    sizes = counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()  # STEPS rows a doubling of the largest count
    least, taken = math.inf, 0
    for r in sizes:
        taken += r["count"]
        if r["step"] < 0 or taken > FREQUENT:
            break
        least = r["step"]
    if least == math.inf:
        return pa.table({"word": pa.array([], pa.string()), "c": pa.array([], pa.int64())}), counts
    return counts.filter(step >= least).select("word", "c").toArrow(), counts.filter(step < least)


def train_blocks(spark: SparkSession, corpus: Corpus) -> Model:
    """A model of the corpus's training texts."""
    end, blocks = corpus.end, corpus.blocks
    each = blocks.select(F.explode(F.arrays_zip("words", "trained")).alias("w")).filter("w.trained > 0")
    counts = written(spark, each.groupBy(F.col("w.words").alias("word")).agg(F.sum("w.trained").alias("c")), "word-counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    coded = blocks.select("block", "n_ids", "ids", "trains")
    ids = coded.mapInArrow(_count_ids(end), "id long, c long").groupBy("id").agg(F.sum("c").alias("c")).toArrow()  # at most the vocabulary
    seen = dict(zip(ids.column("id").to_pylist(), ids.column("c").to_pylist()))
    ends = seen.pop(end, 0)
    classes = classes_from(seen, end, ends)
    got = coded.mapInArrow(_count_pairs(classes), "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c")).toArrow()  # at most CLASSES squared
    pair = got.column("pair").to_numpy()
    pairs = pairs_from(pair // CLASSES, pair % CLASSES, got.column("c").to_numpy(), classes.prior)
    p = initial()
    warm = coded.orderBy(F.xxhash64(F.lit(11), "block"), "block").limit(WARM_BLOCKS).coalesce(1)
    p = _averaged(warm.mapInArrow(_train(classes, pairs, p, WARM_RATE, WARM_STEPS // WARM_BLOCKS), "at long, v double"), p)
    p = _averaged(coded.mapInArrow(_train(classes, pairs, p, RATE, None), "at long, v double"), p)
    return Model(corpus.encoder, classes, pairs, p, counts, total[0] + ends, total[1] + (1 if ends else 0), ends, *parted(counts))


def train(spark: SparkSession, texts: DataFrame, vocabulary: str = VOCABULARY) -> Model:
    """A model of the texts (doc_id, text)."""
    return train_blocks(spark, read(spark, texts, Encoder(read_ranks(vocabulary)), F.lit(True)))


SCORED = "block long, doc_id array<long>, n_words array<long>, score array<double>, base array<double>, known array<long>, rare array<long>, at binary, words array<string>"


def _below(model: Model) -> float:
    return float(model.train_tokens + model.distinct + 1)


def _base(c: np.ndarray, n: np.ndarray, below: float) -> tuple[np.ndarray, np.ndarray]:
    """(log10 probability, known words) of texts of n words each, by their counts one after another."""
    row = np.repeat(np.arange(len(n)), n)
    base, known = (np.bincount(row, weights=x, minlength=len(n)) for x in (np.log10((c + 1) / below), c > 0))
    return base.astype(np.float64), known.astype(np.int64)  # of no words at all, bincount's are whole numbers


def _score(classes: Classes, pairs: Pairs, params: Params, frequent: pa.Table, below: float):
    """Blocks with the model's score and the base of their frequent words; the other words, distinct, and their places (rare: how many a text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = frequent.column("word").combine_chunks(), np.append(frequent.column("c").to_numpy(), 0)
        for batch in batches:
            words = batch.column("words")
            found = pc.index_in(words.flatten(), known).fill_null(len(known)).to_numpy()
            ends = np.cumsum(words.value_lengths().to_numpy())
            for i, (block, ids, first, count, _) in enumerate(_texts([batch])):
                out = score_classes(params, pairs, classes.of[ids].astype(np.int16), first, count) / math.log(10)
                out += np.add.reduceat(classes.log_p[ids], first)
                n, own = batch.column("n_words")[i].values.to_numpy(), words[i].values
                c = counts[found[ends[i] - len(own) : ends[i]]]
                rare = np.flatnonzero(c == 0)
                at = _wide(batch.column("at")[i].as_buffer(), int(n.sum()))
                is_rare, row = c[at] == 0, np.repeat(np.arange(len(n)), n)
                often = np.bincount(row[~is_rare], minlength=len(n))
                base, seen = _base(c[at[~is_rare]], often, below)
                one = lambda values: tk.list_array(np.array([len(values)]), pa.array(values))
                arrays = [
                    pa.array([block]),
                    one(batch.column("doc_id")[i].values),
                    one(n),
                    one(out),
                    one(base),
                    one(seen),
                    one(n - often),
                    pa.array([_narrow(np.searchsorted(rare, at[is_rare]), len(rare))], pa.binary()),
                    one(own.take(pa.array(rare))),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in SCORED.split(", ")])

    return run


def _finish(below: float, ends: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                values = lambda name: batch.column(name)[i].values
                rare = values("rare").to_numpy()
                counts = np.zeros(max(1, batch.column("distinct")[i].as_py()))
                if batch.column("found")[i].is_valid:
                    found = values("found")
                    counts[found.field("pos").to_numpy()] = found.field("c").to_numpy()
                base, known = _base(counts[_wide(batch.column("at")[i].as_buffer(), int(rare.sum()))], rare, below)
                base += values("base").to_numpy() + math.log10((ends + 1) / below)
                known += values("known").to_numpy() + (ends > 0)
                yield pa.RecordBatch.from_arrays([values("doc_id"), pa.array(values("n_words").to_numpy() + 1), pa.array(known), pa.array(base), values("score")], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return run


def score_blocks(corpus: Corpus, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score: a row for each row of the corpus."""
    spark, below = corpus.blocks.sparkSession, _below(model)
    coded = corpus.blocks.select("block", "doc_id", "n_words", "n_ids", "ids", "trains", "at", "words")
    scored = written(spark, coded.mapInArrow(_score(model.classes, model.pairs, model.params, model.frequent, below), SCORED), "scored", **ROW_GROUPS)
    asked = scored.select("block", F.posexplode("words").alias("pos", "word"))
    hit = asked.join(model.rare, "word").groupBy("block").agg(F.collect_list(F.struct("pos", "c")).alias("found"))  # at most the words of a chunk
    whole = scored.withColumn("distinct", F.size("words")).drop("words").join(hit, "block", "left")
    return whole.mapInArrow(_finish(below, model.ends), "doc_id long, n_tokens long, n_known long, base_score double, score double")


def score(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """score_blocks of docs (doc_id, text)."""
    return score_blocks(read(spark, docs, model.encoder), model)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = crc_mod("doc_id", 7) == 2
    corpus = read(spark, docs, Encoder(read_ranks(VOCABULARY)), ~held)
    model = train_blocks(spark, corpus)
    return score_blocks(corpus, model).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")

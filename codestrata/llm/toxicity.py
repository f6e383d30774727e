"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

Kernel: words (lower-cased, marks of their ends added, inserted punctuation taken out, runs
of single letters joined, common digit-for-letter swaps undone) are compared by the gapped
subsequences of three letters they share. A subsequence spanning d letters weighs
DECAY**d, so `idiot`, `id.iot` and `idxiot` stay close. The feature map is scaled by a
function of word length alone, which keeps the kernel positive semi-definite.

Model: landmarks are drawn from the training words; Nyström features z(x) = K(x, L) W^-1/2
feed a linear SVM. Because the kernel is an inner product, the machine's value is
z(x)·v = <phi(x), sum_l alpha_l phi(l)>: the landmarks fold into one table of weights per
subsequence, and a text is scored by table look-ups over its distinct words, in numpy.

Training: only whole documents are labelled, so words are labelled by multiple-instance
rounds: a rejected document's most suspicious words stand for it, a clean document's
words are all clean. The document score is a logistic curve of its highest word values.

Sampling: labelled rows are taken in order of a hash of doc_id, at most ``MAX_TOXIC`` and
``MAX_CLEAN`` of each class: the bound on what reaches the driver. Labels, lang, source
and doc_id are never inputs of a score; rows with crc32(doc_id) % 5 == 0 never train.

Edge cases: null and empty texts get the score of a text without suspicious words; null
labels are skipped; several labels of a document: the largest counts; repeated rows are scored
each; without a labelled row of both classes every score is the base rate (0 without any);
an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm import textkit as tk
from codestrata.llm.shared import crc_mod

MAX_TOXIC, MAX_CLEAN = 1200, 2000
LANDMARKS = 192
DECAY = 0.7
SPAN = 5
LONGEST = 24  #: letters of a piece; longer words are scored in overlapping pieces
ROUNDS = 3
SEED_GAIN = 9.0  #: a word in three rejected documents of a few dozen and in no clean one has about 10
SYMBOLS = 64
#: (d1, d2): distances between the three letters
GAPS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN) if a + b < SPAN]

# Letters are classes 1-..., 0 is a break. Punctuation inside a word is left out (255).
_CODE = np.full(0x250, 255, dtype=np.uint8)
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyz"):
    _CODE[ord(_c)] = _i + 2
for _i, _c in enumerate("áàâäãåçéèêëíìîïñóòôöõúùûüßæœøýž"):
    if ord(_c) < 0x250:
        _CODE[ord(_c)] = 28 + _i
for _a, _b in zip("0134578@$", "oieastbas"):
    _CODE[ord(_a)] = _CODE[ord(_b)]
for _c in range(0xC0, 0xDF):
    if _CODE[_c] == 255 and _c != 0xD7:
        _CODE[_c] = _CODE[_c + 32]
for _c in range(65, 91):
    _CODE[_c] = _CODE[_c + 32]
OTHER, EDGE = 60, 1


@dataclass
class Model:
    weights: np.ndarray  #: SYMBOLS**3, folded landmarks
    bias: float
    curve: tuple[float, float, float]  #: logistic on (highest, second highest) word value


def pieces(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, grid): letter classes of each word between edge marks, padded with breaks; a word longer than LONGEST in overlapping pieces."""
    points = np.frombuffer(("\n".join(words) + "\n").encode("utf-32-le", "replace"), dtype=np.uint32)
    code = np.where(points < 0x250, _CODE[np.minimum(points, 0x24F)], OTHER).astype(np.int64)
    code[points == 10] = 0
    code = code[code != 255]
    end = np.flatnonzero(code == 0)
    start = np.concatenate([[0], end[:-1] + 1])
    size = end - start
    owner = np.arange(len(words))
    grid = np.zeros((len(words), LONGEST), dtype=np.int64)
    grid[:, 0] = EDGE
    fits = size + 2 <= LONGEST
    row = np.repeat(owner, size)
    col = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + 1
    ok = fits[row]
    grid[row[ok], col[ok]] = code[code != 0][ok]
    grid[owner[fits], size[fits] + 1] = EDGE
    more_owner, more = [], []
    for i in np.flatnonzero(~fits):
        c = np.concatenate([[EDGE], code[start[i] : end[i]], [EDGE]])
        grid[i] = c[:LONGEST]
        for s in range(LONGEST - SPAN, len(c) - SPAN, LONGEST - SPAN):
            r = np.zeros(LONGEST, dtype=np.int64)
            r[: len(c[s : s + LONGEST])] = c[s : s + LONGEST]
            more.append(r)
            more_owner.append(i)
    if more:
        return np.concatenate([owner, more_owner]), np.concatenate([grid, more])
    return owner, grid


_SCALE = np.array([1.0 / max(1e-9, sum(max(0, n - a - b) * DECAY ** (2 * (a + b)) for a, b in GAPS)) ** 0.5 if n > 2 else 0.0 for n in range(LONGEST + 1)], dtype=np.float32)


def values(grid: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """<phi(piece), weights> of each piece."""
    total = np.zeros(len(grid), dtype=np.float32)
    for a, b in GAPS:
        n = LONGEST - a - b
        x, y, z = grid[:, :n], grid[:, a : a + n], grid[:, a + b :]
        total += np.float32(DECAY ** (a + b)) * (weights[(x * SYMBOLS + y) * SYMBOLS + z] * (z > 0)).sum(axis=1)
    return total * _SCALE[(grid > 0).sum(axis=1)]


def features(grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """phi of each piece: subsequence numbers (-1: none) and weights, a row for each piece."""
    idx, wt = [], []
    for a, b in GAPS:
        n = LONGEST - a - b
        x, y, z = grid[:, :n], grid[:, a : a + n], grid[:, a + b :]
        idx.append(np.where(z > 0, (x * SYMBOLS + y) * SYMBOLS + z, -1))
        wt.append(np.full((len(grid), n), DECAY ** (a + b), dtype=np.float32))
    return np.concatenate(idx, axis=1), np.concatenate(wt, axis=1) * _SCALE[(grid > 0).sum(axis=1)][:, None]


def _dense(grid: np.ndarray, where: np.ndarray, width: int) -> np.ndarray:
    """phi over the columns that `where` numbers."""
    idx, wt = features(grid)
    at = np.where(idx >= 0, where[idx], -1)
    ok = at >= 0
    flat = (np.arange(len(grid))[:, None] * width + at)[ok]
    return np.bincount(flat, weights=wt[ok], minlength=len(grid) * width).reshape(len(grid), width).astype(np.float32)


def join_spaced(words: list[str]) -> list[str]:
    """Words, plus each run of three or more single letters as one word."""
    out, run = [], []
    for w in words + [""]:
        core = w.strip(".,;:!?*-_\"'()")
        if len(core) == 1 and core.isalpha():
            run.append(core)
        else:
            if len(run) >= 3:
                out.append("".join(run))
            run = []
    return out


def _distinct(batch: pa.RecordBatch, column: str):
    """For each piece of a batch: first row, rows, distinct word texts, (row, word number) pairs."""
    for row, rows, offsets, data in tk.chunks(batch.column(column)):
        w = tk.words(offsets, data, tk.NOT_SPACE)
        h = w.hashes()
        _, first, number = np.unique(h, return_index=True, return_inverse=True)
        texts = w.texts(first)
        size = w.end - w.start
        # spaced-out letters: single-letter words (with a mark or an accent: up to 3 bytes)
        extra_row: list[int] = []
        single = size <= 2
        run = single[:-2] & single[1:-1] & single[2:] & (w.row[:-2] == w.row[2:]) if len(single) > 2 else np.zeros(0, bool)
        for r in np.unique(w.row[:-2][run]) if len(run) else ():
            own = w.texts(np.arange(w.first[r], w.first[r] + w.count[r]))
            for joined in join_spaced(own):
                texts.append(joined)
                extra_row.append(int(r))
        pair_row = np.concatenate([w.row, np.array(extra_row, dtype=np.int64)])
        pair_word = np.concatenate([number, np.arange(len(first), len(texts))])
        yield row, rows, texts, pair_row, pair_word


def word_values(texts: list[str], model: Model) -> np.ndarray:
    out = np.full(len(texts), -np.inf, dtype=np.float32)
    for s in range(0, len(texts), 20000):
        owner, grid = pieces(texts[s : s + 20000])
        np.maximum.at(out, owner + s, values(grid, model.weights))
    return out + np.float32(model.bias)


def top_two(rows: int, row: np.ndarray, word: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The highest values of two different words of each row (none: -2)."""
    out = np.full((rows, 2), -2.0, dtype=np.float32)
    if not len(row):
        return out
    v = np.maximum(value[word], -2.0)
    top = np.full(rows, -2.0, dtype=np.float32)
    np.maximum.at(top, row, v)
    out[:, 0] = top
    best = np.full(rows, -1, dtype=np.int64)
    at = v >= top[row]
    np.maximum.at(best, row[at], word[at])
    rest = word != best[row]
    np.maximum.at(out[:, 1], row[rest], v[rest])
    return out


def scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for batch in batches:
            for row, rows, texts, pair_row, pair_word in _distinct(batch, "text"):
                value = np.array([cache.get(t, np.nan) for t in texts], dtype=np.float32)
                new = np.flatnonzero(np.isnan(value))
                if len(new):
                    value[new] = word_values([texts[i] for i in new], model)
                    if len(cache) > 200_000:
                        cache.clear()
                    cache.update(zip((texts[i] for i in new), value[new].tolist()))
                top = top_two(rows, pair_row, pair_word, value)
                a, b, c = model.curve
                score = 1 / (1 + np.exp(-np.clip(a + b * top[:, 0] + c * top[:, 1], -30, 30).astype(np.float64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, rows), pa.array(score), pa.array(top[:, 0].astype(np.float64))], names=["doc_id", "score", "highest"])

    return run


def training_rows(docs: DataFrame, labels: DataFrame, max_toxic: int, max_clean: int) -> DataFrame:
    """doc_id, toxic, text of a bounded sample of labelled training documents, in hash order."""
    lab = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", 5) != 0)).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    h = F.xxhash64("doc_id")
    pick = lab.filter("toxic = 1").orderBy(h).limit(max_toxic).unionByName(lab.filter("toxic = 0").orderBy(h).limit(max_clean))
    # at most max_toxic + max_clean pairs of numbers: a bounded broadcast
    return docs.select("doc_id", "text").join(F.broadcast(pick), "doc_id")


def _word_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, rows, texts, pair_row, pair_word in _distinct(batch, "text"):
            lists: list[list[str]] = [[] for _ in range(rows)]
            key = np.unique(pair_row * len(texts) + pair_word) if len(texts) else np.zeros(0, np.int64)
            for r, i in zip((key // max(1, len(texts))).tolist(), (key % max(1, len(texts))).tolist()):
                lists[r].append(texts[i])
            yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(row, rows), pa.array(lists, pa.list_(pa.string()))], names=["toxic", "words"])


def _svm(k: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 300, reg: float = 1e-4) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM on Nyström features, by accelerated gradient steps."""
    n, m = k.shape
    weight = weight / weight.sum()
    lipschitz = 2 * float(np.linalg.norm(k * np.sqrt(weight)[:, None], 2) ** 2 + 1.0) + reg
    v, u, b, c, t = np.zeros(m), np.zeros(m), 0.0, 0.0, 1.0
    for _ in range(steps):
        margin = np.maximum(0, 1 - y * (k @ u + c))
        g = -2 * (weight * y * margin)
        nv, nb = u - (k.T @ g + reg * u) / lipschitz, c - g.sum() / lipschitz
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        u, c = nv + (t - 1) / nt * (nv - v), nb + (t - 1) / nt * (nb - b)
        v, b, t = nv, nb, nt
    return v, b


def train(documents: list[tuple[int, list[str]]], landmarks: int = LANDMARKS, rounds: int = ROUNDS, max_words: int = 8000) -> Model:
    """A model from (label, distinct words) of documents."""
    toxic = [w for y, w in documents if y == 1]
    clean = [w for y, w in documents if y == 0]
    base = len(toxic) / max(1, len(documents))
    if not toxic or not clean:
        return Model(np.zeros(SYMBOLS**3, np.float32), 0.0, (30.0 if toxic else -30.0, 0.0, 0.0))
    in_toxic, in_clean = defaultdict(int), defaultdict(int)
    for docs, count in ((toxic, in_toxic), (clean, in_clean)):
        for w in docs:
            for x in w:
                count[x] += 1
    rng = np.random.default_rng(7)
    # how much more often rejected documents hold a word than clean ones do
    lift = {x: (c / len(toxic)) / ((in_clean[x] + 0.5) / len(clean)) for x, c in in_toxic.items()}
    # evidence that a word marks rejection: log-likelihood of its rejected documents over what clean ones suggest
    gain = {x: in_toxic[x] * np.log(lift[x]) for x in lift if lift[x] > 3}
    by_lift = sorted((x for x in gain if in_toxic[x] >= 2 and gain[x] > SEED_GAIN), key=lambda x: (-gain[x], x))[:600]
    clean_words = sorted(in_clean)
    order = rng.permutation(len(clean_words))
    clean_words = [clean_words[i] for i in order]
    common = sorted(in_clean, key=lambda x: (-in_clean[x], x))[:500]
    positives = by_lift or sorted(lift, key=lambda x: (-lift[x], x))[:50]
    weight_of = {x: float(in_toxic[x]) for x in positives}
    negatives = list(dict.fromkeys(common + clean_words[: max_words - len(common)]))
    model, hard = None, []
    for r in range(rounds):
        pos, neg = list(weight_of), list(dict.fromkeys(hard[: max_words // 2] + negatives))[:max_words]
        # a suspicious word stands as the piece that the rounds before find most suspicious (at first all of them), a clean word as all its pieces
        owner, grid = pieces(pos)
        share = np.array([weight_of[x] for x in pos])
        if model is None:
            share = (share / np.bincount(owner, minlength=len(pos)))[owner]
        else:
            value = values(grid, model.weights)
            grid = grid[[max(of, key=value.__getitem__) for of in _by_owner(owner, len(pos))]]
        clean_grid = pieces(neg)[1]
        pos_rows, neg_rows = len(grid), len(clean_grid)
        grid = np.concatenate([grid, clean_grid])
        y = np.concatenate([np.ones(pos_rows), -np.ones(neg_rows)])
        w = np.concatenate([share / share.sum(), np.full(neg_rows, 1.0 / neg_rows)])
        heavy = np.argsort(-w[:pos_rows], kind="stable")[: landmarks // 2]
        some = pos_rows + np.concatenate([np.arange(min(neg_rows, landmarks // 4)), rng.integers(0, neg_rows, landmarks // 4)])
        marks = np.unique(np.concatenate([heavy, some]))
        model = _fit(grid, y, w, marks)
        # the next round's examples: each rejected document's most suspicious words, and clean words beyond the margin
        words_all = list({x for d in toxic for x in d} | {x for d in clean for x in d}) if r == 0 else words_all
        value = dict(zip(words_all, word_values(words_all, model).tolist()))
        hard = sorted((x for x in in_clean if value[x] > -0.8), key=lambda x: (-value[x], x))
        weight_of = defaultdict(float)
        for d in toxic:
            best = sorted(((value[x], x) for x in d if lift[x] > 3), reverse=True)[:2]
            for v, x in best:
                if v > -0.5:
                    weight_of[x] += 1.0
        weight_of = dict(weight_of) or {x: float(in_toxic[x]) for x in positives}
    curve = _curve(model, [(y, w) for y, w in documents], base)
    return Model(model.weights, model.bias, curve)


def _by_owner(owner: np.ndarray, n: int) -> list[list[int]]:
    """The places of each owner's pieces."""
    out: list[list[int]] = [[] for _ in range(n)]
    for i, o in enumerate(owner.tolist()):
        out[o].append(i)
    return out


def _fit(grid: np.ndarray, y: np.ndarray, w: np.ndarray, marks: np.ndarray) -> Model:
    used = np.unique(features(grid[marks])[0])
    used = used[used >= 0]
    where = np.full(SYMBOLS**3, -1, dtype=np.int64)
    where[used] = np.arange(len(used))
    dense = _dense(grid[marks], where, len(used))
    gram = dense @ dense.T
    vals, vecs = np.linalg.eigh(gram + 1e-6 * np.eye(len(marks)))
    ok = vals > 1e-4
    root = (vecs[:, ok] / np.sqrt(vals[ok])) @ vecs[:, ok].T
    k = np.zeros((len(grid), len(marks)), dtype=np.float32)
    for s in range(0, len(grid), 1000):
        k[s : s + 1000] = _dense(grid[s : s + 1000], where, len(used)) @ dense.T
    z = (k @ root).astype(np.float64)
    v, b = _svm(z, y, w)
    alpha = root @ v
    weights = np.zeros(SYMBOLS**3, dtype=np.float32)
    weights[used] = alpha @ dense
    return Model(weights, b, (0.0, 1.0, 0.0))


def _curve(model: Model, documents: list[tuple[int, list[str]]], base: float) -> tuple[float, float, float]:
    """Logistic regression of the label on a document's two highest word values."""
    value: dict[str, float] = {}
    words = list({x for _, d in documents for x in d})
    value = dict(zip(words, word_values(words, model).tolist()))
    x = np.array([(sorted((max(-2.0, value[t]) for t in d), reverse=True) + [-2.0, -2.0])[:2] for _, d in documents])
    y = np.array([l for l, _ in documents], dtype=float)
    a = np.column_stack([np.ones(len(x)), x])
    theta = np.array([np.log(max(base, 1e-6) / max(1 - base, 1e-6)), 0.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ theta, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(3)
        theta = theta - np.clip(np.linalg.solve(h, a.T @ (p - y) + 1e-2 * theta * [0, 1, 1]), -4, 4)
    return tuple(float(t) for t in theta)


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model:
    rows = training_rows(docs, labels, max_toxic, max_clean).mapInArrow(_word_lists, "toxic int, words array<string>")
    return train([(r["toxic"], r["words"]) for r in rows.collect()])  # at most max_toxic + max_clean documents


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, highest: a row for each row of docs."""
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(scorer(model), "doc_id long, score double, highest double")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows whose score is 0.5 or more, decided in place."""
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = scorer(model)
        for batch in batches:
            slim = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(at)], names=["doc_id", "text"])
            score = np.concatenate([b.column("score").to_numpy() for b in run(iter([slim]))] or [np.zeros(0)])
            yield batch.filter(pa.array(score < 0.5))

    return docs.mapInArrow(keep, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scores(docs, model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "highest")

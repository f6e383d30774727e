"""Scoring, toxicity, mixing, search, sharding, near-duplicates and the pipeline on small corpora."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codestrata.llm import bm25, lm_scoring, minhash, mixing, sharding, toxicity
from tests.llm.test_text_operators import ODD, docs

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture
def small(monkeypatch):
    for name, value in {"WARM_STEPS": 20}.items():
        monkeypatch.setattr(lm_scoring, name, value)


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    words = [a + b for a in ("the", "re", "ing", "É") for b in ("", "al", "on", "er", "st")]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 80)))) for i in range(n)]


def test_lm_base_scores(spark, small):
    rows = corpus() + ODD
    train = [t for i, t in rows if i is not None and i % 3]
    model = lm_scoring.train(spark, docs(spark, [r for r in rows if r[0] is not None and r[0] % 3]))
    c = Counter(w for t in train for w in SPACE.findall("".join(x.lower() if x < "\x7f" else x for x in t or "")))
    c[0] = len(train)
    n, v = sum(c.values()), len(c)
    assert (model.train_tokens, model.distinct) == (n, v)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in lm_scoring.score(spark, docs(spark, rows), model).collect())
    want = []
    for i, t in rows:
        w = SPACE.findall("".join(x.lower() if x < "\x7f" else x for x in t or "")) + [0]
        want.append((i is not None, i or 0, len(w), sum(c[x] > 0 for x in w), round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)))
    assert got == sorted(want)


def test_lm_joins_rare_words_only(spark, small, monkeypatch):
    """The frequent words of a corpus never enter the join by word, and wherever they are parted the base scores are the same."""
    rows, written, joined, got = corpus(90, 4) + [(100, "rare " + "long" * 40 + " \u00e9"), (101, "rare unknown")] + ODD, lm_scoring.written, [], []

    def spy(spark, df, name, **options):
        out = written(spark, df, name, **options)
        if name == "scored":
            joined.append({w for r in out.collect() for w in r.words})
        return out

    monkeypatch.setattr(lm_scoring, "written", spy)
    for most in (0, 10, 1 << 18):
        monkeypatch.setattr(lm_scoring, "FREQUENT", most)
        model = lm_scoring.train(spark, docs(spark, [r for r in rows if r[0] != 101]))
        counts = {r.word: r.c for r in model.counts.collect()}
        often = dict(zip(model.frequent.column("word").to_pylist(), model.frequent.column("c").to_pylist()))
        rest = {r.word: r.c for r in model.rare.collect()}
        assert counts == often | rest and not often.keys() & rest.keys() and len(often) <= most
        assert min(often.values(), default=9e9) >= max((c for w, c in rest.items() if len(w) < 64), default=0)
        out = lm_scoring.score(spark, docs(spark, rows), model).collect()
        got.append(sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in out))
        assert not joined[-1] & often.keys()
    assert got[0] == got[1] == got[2] and joined[0] >= counts.keys() and joined[2] == {"long" * 40, "unknown"}


def test_lm_words_are_encoded_at_once():
    """One call of the tokenizer for all words gives the ids of each word alone."""
    import tiktoken

    ranks = lm_scoring.read_ranks(lm_scoring.VOCABULARY)
    alone = tiktoken.Encoding("alone", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    words = ["the", "a\u00a0b", "\u3000", "\x00", "\x85x", "\ufffd", "Ünïcode", "日本語のテキスト", "x" * 5000, "'s", "123456", "\u2028", "the", "🙂🙂", "<|endoftext|>"]
    calls, encoder = [], lm_scoring.Encoder(ranks)
    encoder(["warm"])
    core = encoder.core

    class Spy:
        def __getattr__(self, name):
            return lambda *a: calls.append(name) or getattr(core, name)(*a)

    encoder.core = Spy()
    ids, size = encoder(words)
    want = [alone.encode_ordinary(" " + w) for w in words]
    assert size.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x] and len(calls) == 1
    assert [len(x) for x in encoder([])] == [0, 0]


def test_lm_is_a_distribution_and_windows_score_once(small):
    counts = np.array([1, 31, 32, 33, 57, 100])
    first = np.cumsum(counts) - counts
    cls = np.arange(counts.sum()) % lm_scoring.CLASSES
    for stride in (lm_scoring.STRIDE, lm_scoring.WINDOW):
        _, targets, scored = lm_scoring.windows_of(cls, first, counts, stride).batch(slice(None))
        assert sorted(targets[scored]) == sorted(cls) and scored.sum() == counts.sum()
    classes = lm_scoring.classes_from({i: 5 for i in range(300)}, 300, 3)
    assert abs(classes.prior.sum() - 1) < 1e-9
    for k in range(lm_scoring.CLASSES):
        p = 10 ** classes.log_p[classes.of == k]
        assert not len(p) or abs(p.sum() - 1) < 1e-9


def some_pairs(seed=4):
    rng = np.random.default_rng(seed)
    prior = rng.random(lm_scoring.CLASSES)
    return lm_scoring.pairs_from(*rng.integers(0, lm_scoring.CLASSES, (2, 5000)), np.ones(5000), prior / prior.sum())


def some_params(seed=5):
    p = lm_scoring.initial()
    p.flat[:] += np.random.default_rng(seed).standard_normal(len(p.flat)) * 0.1
    return p


def naive_score(p, pairs, cls):
    """ln P of one text, window by window, row by row, from the definition alone."""
    total, w, d = 0.0, lm_scoring.WINDOW, lm_scoring.DIM
    for start in range(0, max(1, len(cls) - w + lm_scoring.STRIDE), lm_scoring.STRIDE):
        before = [cls[i - 1] if i else lm_scoring.CLASSES for i in range(start, min(start + w, len(cls)))]
        x = [p.E[c].astype(float) + p.P[j] for j, c in enumerate(before)]
        qkv = [r @ p.QKV.astype(float) for r in x]
        for j in range(len(before)):
            if start and j < w - lm_scoring.STRIDE:
                continue
            weight = [math.exp(qkv[j][:d] @ qkv[i][d : 2 * d] / math.sqrt(d)) for i in range(j + 1)]
            h = x[j] + sum(a * qkv[i][2 * d :] for i, a in enumerate(weight)) / sum(weight) @ p.O.astype(float)
            z = h @ p.G + pairs.group[before[j]]
            m = np.array([h @ p.M[g] + pairs.member[before[j], g] for g in range(lm_scoring.GROUPS)])
            joint = np.log(np.exp(z) / np.exp(z).sum())[:, None] + m - np.log(np.exp(m).sum(axis=1, keepdims=True))
            assert abs(np.exp(joint).sum() - 1) < 1e-6
            total += joint.reshape(-1)[cls[start + j]]
    return total


def test_lm_scores_against_a_naive_forward_pass():
    counts = np.array([1, 20, 32, 33, 75, 200])
    first = np.cumsum(counts) - counts
    cls = np.random.default_rng(2).integers(0, lm_scoring.CLASSES, counts.sum()).astype(np.int16)
    p, pairs = some_params(), some_pairs()
    got = lm_scoring.score_classes(p, pairs, cls, first, counts)
    want = [naive_score(p, pairs, cls[a : a + n].tolist()) for a, n in zip(first, counts)]
    assert np.allclose(got, want, rtol=1e-4)


def test_lm_trains_on_every_text(spark, small, monkeypatch):
    tokens, averaged = [], lm_scoring._averaged

    def spy(rows, otherwise):
        tokens.append(rows.groupBy("at").agg(F.sum("v").alias("v")).orderBy(F.desc("at")).first()["v"])
        return averaged(rows, otherwise)

    monkeypatch.setattr(lm_scoring, "_averaged", spy)
    rows = corpus(90)
    encoder = lm_scoring.train(spark, docs(spark, rows)).encoder
    want = sum(len(encoder(["".join(x.lower() if x < "\x7f" else x for x in w) for w in t.split()])[0]) + 1 for _, t in rows)
    assert tokens[-1] == want


def test_lm_descends_over_every_window_once(monkeypatch):
    seen, gradients = [], lm_scoring.gradients

    def spy(p, pairs, inputs, targets, scored):
        seen.extend(targets[:, 0].tolist())
        return gradients(p, pairs, inputs, targets, scored)

    monkeypatch.setattr(lm_scoring, "gradients", spy)
    monkeypatch.setattr(lm_scoring, "BATCH_WINDOWS", 64)
    n = lm_scoring.WINDOW
    cls = np.repeat(np.arange(150), n).astype(np.int16)
    w = lm_scoring.windows_of(cls, np.arange(150) * n, np.full(150, n), n)
    lm_scoring.descend(lm_scoring.Adam(lm_scoring.initial()), some_pairs(), w, 0.003)
    assert sorted(seen) == list(range(150))


def test_lm_gradients():
    rng = np.random.default_rng(0)
    p = lm_scoring.Params(some_params().flat.astype(np.float64))
    x, t = rng.integers(0, lm_scoring.CLASSES, (2, 3, lm_scoring.WINDOW))
    scored = rng.random(t.shape) < 0.8
    pairs = some_pairs()
    _, g = lm_scoring.gradients(p, pairs, x, t, scored)
    at = 0
    for name, shape in lm_scoring._shapes().items():
        size = math.prod(shape)
        k = at + int(np.abs(g.flat[at : at + size]).argmax())
        at += size
        loss = []
        for step in (1e-4, -1e-4):
            q = lm_scoring.Params(p.flat.copy())
            q.flat[k] += step
            loss.append(lm_scoring.gradients(q, pairs, x, t, scored)[0])
        assert abs((loss[0] - loss[1]) / 2e-4 - g.flat[k]) < 1e-4 + 0.02 * abs(g.flat[k]), name


def test_lm_long_text_and_learning(spark, small, monkeypatch):
    """A text longer than a chunk is scored whole; a text like the training texts scores above the same words in random order."""
    monkeypatch.setattr(lm_scoring, "CHUNK", 1 << 12)
    monkeypatch.setattr(lm_scoring, "WARM_STEPS", 200)
    line = "one two three four five six seven eight "
    mixed = line.split() * 200
    random.Random(3).shuffle(mixed)
    model = lm_scoring.train(spark, docs(spark, [(i, line * 20) for i in range(20)]))
    got = {r.doc_id: r for r in lm_scoring.score(spark, docs(spark, [(1, line * 200), (2, " ".join(mixed)), (3, "one")]), model).collect()}
    assert got[1].n_tokens == 1601 and got[1].base_score == pytest.approx(got[2].base_score) and got[1].score > got[2].score


def test_lm_empty(spark, small):
    model = lm_scoring.train(spark, docs(spark, ODD).limit(0))
    assert model.train_tokens == 0 and lm_scoring.score(spark, docs(spark, ODD), model).count() == len(ODD)
    assert lm_scoring.score(spark, docs(spark, ODD).limit(0), model).count() == 0


def test_toxicity_learns_gapped_words(spark):
    rng = random.Random(2)
    plain = [f"{a}{b}" for a in "bcdfgh" for b in ("ane", "olt", "uri", "emp", "ast")]
    rows, labels = [], []
    for i in range(300):
        words = [rng.choice(plain) for _ in range(30)]
        bad = i % 4 == 0
        if bad:
            words[rng.randrange(30)] = rng.choice(["idiot", "moron"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    lab = spark.createDataFrame(labels + [(None, 1, 1), (5000, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs(spark, rows), lab)
    probe = [(9000, "bane id.iot colt"), (9001, "bane idxiot colt"), (9002, "bane colt"), (9003, None), (9004, ""), (9005, "i d i o t"), (9006, "x" * 100_000)]
    got = {r.doc_id: r.score for r in toxicity.scores(docs(spark, probe), model).collect()}
    assert min(got[9000], got[9001], got[9005]) >= 0.5 and max(got[9002], got[9003], got[9004], got[9006]) < 0.5
    assert {r.doc_id for r in toxicity.drop_toxic(docs(spark, probe), model).collect()} == {9002, 9003, 9004, 9006}
    scored = {r.doc_id: r.score >= 0.5 for r in toxicity.scores(docs(spark, rows), model).collect()}
    assert sum(scored[i] == bool(t) for i, _, t in labels) >= 295


def naive_subsequences(word):
    """Gapped three-letter subsequences of a word between its edge marks: (letters) -> summed weight, letters as the operator's classes."""
    codes = [toxicity.EDGE] + [c for c in (int(toxicity._CODE[ord(x)]) if ord(x) < 0x250 else toxicity.OTHER for x in word) if c != 255] + [toxicity.EDGE]
    out = defaultdict(float)
    for i in range(len(codes)):
        for j in range(i + 1, len(codes)):
            for k in range(j + 1, len(codes)):
                if k - i < toxicity.SPAN:
                    out[codes[i], codes[j], codes[k]] += toxicity.DECAY ** (k - i)
    norm = sum(toxicity.DECAY ** (2 * (k - i)) for i in range(len(codes)) for j in range(i + 1, len(codes)) for k in range(j + 1, len(codes)) if k - i < toxicity.SPAN)
    return {x: v / max(norm, 1e-9) ** 0.5 for x, v in out.items()} if len(codes) > 2 else {}


def test_toxicity_kernel_against_a_naive_one():
    """The folded landmarks give every word the value that naive kernels with the landmarks give."""
    words = ["idiot", "id.iot", "idxiot", "ID1OT", "a", "", "...", "été", "\u4e2d\u6587\u5b57", "clean", "abcdefghijklmnopqrst"]
    owner, grid = toxicity.pieces(words)
    assert owner.tolist() == list(range(len(words)))
    phi = [naive_subsequences(w) for w in words]
    kernel = lambda a, b: sum(v * b.get(k, 0.0) for k, v in a.items())
    assert kernel(phi[0], phi[1]) == pytest.approx(kernel(phi[0], phi[0])) and kernel(phi[0], phi[2]) > 2 * kernel(phi[0], phi[9])
    rng = np.random.default_rng(3)
    y, w = rng.choice([-1.0, 1.0], len(words)), np.full(len(words), 1 / len(words))
    marks = np.array([0, 2, 9, 10])
    model = toxicity._fit(grid, y, w, marks)
    gram = np.array([[kernel(phi[a], phi[b]) for b in marks] for a in marks])
    k = np.array([[kernel(x, phi[b]) for b in marks] for x in phi])
    vals, vecs = np.linalg.eigh(gram + 1e-6 * np.eye(len(marks)))
    root = (vecs[:, vals > 1e-4] / np.sqrt(vals[vals > 1e-4])) @ vecs[:, vals > 1e-4].T
    v, b = toxicity._svm(k @ root, y, w)
    assert np.allclose(toxicity.values(grid, model.weights) + model.bias, k @ root @ v + b, atol=2e-3)


def test_toxicity_trains_on_whole_words(spark):
    """What tells two words apart behind 80 common letters is learned and found."""
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("bcdfghklmnprstv") for _ in range(n))
    head = letters(80)
    rows = [(i, " ".join(letters(6) for _ in range(20)) + " " + head + ("zaqwuxoj" if i % 3 == 0 else "bcdfghkl")) for i in range(1, 240)]
    labels = spark.createDataFrame([(i, 1 if i % 3 == 0 else 0) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs(spark, rows), labels)
    got = {r.doc_id: r.score for r in toxicity.scores(docs(spark, rows), model).collect()}
    right = sum((got[i] >= 0.5) == (i % 3 == 0) for i, _ in rows)
    assert right > 0.95 * len(rows)


def test_toxicity_without_labels(spark):
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs(spark, ODD), lab)
    assert toxicity.scores(docs(spark, ODD), model).filter("score >= 0.5").count() == 0


def test_mixing(spark):
    rows = [(i, "w " * (1 + i % 5), "big" if i % 3 else ("mid" if i % 2 else None)) for i in range(600)] + [(700, None, "empty"), (701, "w w", "tiny")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("source__mix", F.lit(0)).withColumn("epoch", F.lit(0))
    out = mixing.mixed(spark, d, repetition=2.0).select("row.*").collect()
    times = Counter(r.doc_id for r in out)
    assert set(times) == {r[0] for r in rows} and max(times.values()) <= 2
    share = defaultdict(int)
    for r in rows:
        share[r[2] or ""] += len((r[1] or "").split())
    seen = Counter()
    for r in out:
        seen[r.source or ""] += len((r.text or "").split())
    assert seen["big"] == share["big"] and share["tiny"] <= seen["tiny"] <= 2 * share["tiny"]
    budget = 400
    capped = mixing.mixed(spark, d, budget=budget, repetition=None, entropy=0.5).select("row.*").collect()
    assert sum(len((r.text or "").split()) for r in capped) <= budget
    assert mixing.mixed(spark, d.limit(0)).count() == 0


@pytest.mark.parametrize("entropy,repetition,budget", [(None, 2.0, None), (0.7, None, 900), (None, 1.5, 2500), (0.4, 3.0, None)])
def test_mixing_against_brute_force(spark, entropy, repetition, budget):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(0, 9), rng.choice(["a"] * 12 + ["b"] * 3 + ["c", None])) for i in range(400)] + [(7, "w w", "b"), (None, "w", "c"), (900, None, "void")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter((r.row.doc_id, r.row.text, r.row.source) for r in mixing.mixed(spark, d, 5, entropy, repetition, budget).select("row").collect())
    count = lambda t: len((t or "").split())
    tokens = Counter()
    for _, t, s in rows:
        tokens[s or ""] += count(t)
    total = sum(tokens.values())
    p = {s: n / total for s, n in tokens.items() if n}

    def fits(a):
        w = {s: x**a for s, x in p.items()}
        z = sum(w.values())
        h = -sum(x / z * math.log(x / z) for x in w.values()) / math.log(len(p))
        each = [w[s] / z / p[s] for s in p]
        most = max(each) / min(each) if budget is None else max(each) * budget / total
        return (entropy is None or h <= entropy + 1e-12) and (repetition is None or most <= repetition + 1e-12)

    lo, hi = 0.0, 1.0
    for _ in range(60):
        lo, hi = ((lo + hi) / 2, hi) if not fits((lo + hi) / 2) else (lo, (lo + hi) / 2)
    a = (0.0 if fits(0.0) else hi) if fits(1.0) else 1.0
    w = {s: x**a for s, x in p.items()}
    least = min(w[s] / p[s] for s in p)
    want = Counter()
    for s in {r[2] or "" for r in rows}:
        mine = [r for r in rows if (r[2] or "") == s]
        all_ = 1.0 if s not in p else w[s] / p[s] / least if budget is None else w[s] / sum(w.values()) * budget / tokens[s]
        whole = int(all_ + 1e-6)
        left = (all_ - whole) * tokens[s]
        keys = spark.createDataFrame(mine, "doc_id long, text string, source string").select("*", F.xxhash64(F.lit(5), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("key"))
        order = keys.select("doc_id", "text", "source", F.xxhash64(F.lit(5), F.lit(whole), F.pmod("key", F.lit(mixing.BLOCKS)).cast("int")).alias("o"), F.xxhash64(F.lit(5), F.lit(whole), "key").alias("w")).collect()
        for r in order:
            want[r.doc_id, r.text, r.source] += whole
        taken, so_far = 0, defaultdict(list)
        for r in order:
            so_far[r.o, r.w].append(r)
        for at in sorted(so_far):
            taken += sum(count(r.text) for r in so_far[at])
            if taken > left + 1e-3:
                break
            for r in so_far[at]:
                want[r.doc_id, r.text, r.source] += 1
    want = Counter({k: n for k, n in want.items() if n})
    # the bisection stops within 1e-8 of the exponent: of each source the row at its cut may differ, or change places with the next
    off = Counter()
    for (_, _, s), n in ((got - want) + (want - got)).items():
        off[s] += n
    assert max(off.values(), default=0) <= 2
    assert budget is None or sum(count(t) * n for (_, t, _), n in got.items()) <= budget


def test_mixing_exponent_meets_entropy(spark):
    s = spark.createDataFrame([("a", 900), ("b", 90), ("c", 10)], "source__mix string, tokens__mix long")
    a = mixing.exponent(s, entropy=0.6, repetition=None)
    w = np.array([900, 90, 10]) ** a
    w = w / w.sum()
    assert abs(-(w * np.log(w)).sum() / np.log(3) - 0.6) < 1e-4


def test_search_is_exact(spark, monkeypatch):
    for name, value in {"SHARD_BYTES": 9000, "SHARD_DOCS": 50, "BLOCK": 2, "DENSE": 6, "BATCH": 3, "QUERY_BYTES": 300}.items():
        monkeypatch.setattr(bm25, name, value)
    opened, evaluate = [], bm25.Shard._evaluate
    monkeypatch.setattr(bm25.Shard, "_evaluate", lambda self, mask, *rest: opened.append(mask.mean()) or evaluate(self, mask, *rest))
    rows = corpus(120) + [(200, corpus(120)[3][1]), (201, None), (202, "")]
    texts = {i: SPACE.findall("".join(x.lower() if x < "\x7f" else x for x in t or "")) for i, t in rows}
    real = [w for w in texts.values() if w]
    n, mean = len(real), sum(map(len, real)) / len(real)
    df = Counter(x for w in real for x in set(w))
    got = defaultdict(list)
    queries = docs(spark, rows).filter("doc_id % 20 = 0 OR doc_id = 3")
    for r in bm25.search(spark, docs(spark, rows), queries, 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.doc_id, r.score))
    for q in [i for i, _ in rows if i % 20 == 0 or i == 3]:
        scores = []
        for i, w in texts.items():
            tf = Counter(w)
            s = sum(math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * tf[x] * (bm25.K1 + 1) / (tf[x] + bm25.K1 * (1 - bm25.B + bm25.B * len(w) / mean)) for x in set(texts[q]) if tf[x])
            if s > 0:
                scores.append((-round(s, 9), i))
        assert got[q] == [(i, -s) for s, i in sorted(scores)[:5]]
    assert bm25.search(spark, docs(spark, rows).limit(0), queries.limit(0)).count() == 0


def test_search_of_repeated_ids_nulls_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(bm25, "SHARD_BYTES", 2000)
    rows = [(1, "a b"), (1, "b c"), (2, "a b c " * 2000), (None, "c"), (None, "c"), (3, "b c"), (3, "b c"), (4, None), (5, " ")]
    got = bm25.search(spark, docs(spark, rows), docs(spark, [(1, "a b"), (1, "b c"), (None, "a"), (4, None)])).orderBy("query_id", "rank").collect()
    assert {r.query_id for r in got} == {1} and len(got) == 7  # one query of the words of both rows
    assert [r["rank"] for r in got] == list(range(1, 8)) and sorted(r.doc_id or 0 for r in got) == [0, 0, 1, 1, 2, 3, 3]
    same = [r for r in got if r.doc_id is None]
    assert same[0].score == same[1].score


def test_search_skips_blocks(monkeypatch):
    """Blocks that cannot reach the threshold are not opened, and the result is that of scoring everything."""
    import pyarrow as pa

    monkeypatch.setattr(bm25, "BLOCK", 4)
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(80)]
    texts = [" ".join(rng.choice(words[20 * (i % 4) : 20 * (i % 4) + 20], 12)) for i in range(400)]
    dense = np.sort(np.unique(bm25._term_rows(bm25.tk.words(*next(bm25.tk.chunks(pa.array([" ".join(words[:6])])))[2:], bm25.tk.NOT_SPACE))[1]))
    row = bm25._posting_lists(pa.array(range(400)), pa.array(texts, pa.large_string()))
    blob = lambda k, kind: np.frombuffer(row.column(k)[0].as_buffer(), dtype=kind)
    shard = bm25.Shard(row.column(0)[0].values.to_numpy(), blob(1, np.int64), blob(2, np.int64), blob(3, np.int32), blob(4, np.int32), blob(5, np.int32), dense, 12.0)
    term = lambda t: np.unique(bm25._term_rows(bm25.tk.words(*next(bm25.tk.chunks(pa.array([t])))[2:], bm25.tk.NOT_SPACE))[1])
    table = pa.table({"query_id": pa.array([0, 1, 2]), "terms": pa.array([[{"term": int(x), "idf": 1.0 + int(x) % 3} for x in term(texts[i])] for i in (0, 1, 2)])})
    queries, masks, evaluate = bm25.Queries(table, dense, np.arange(len(dense))), [], bm25.Shard._evaluate
    monkeypatch.setattr(bm25.Shard, "_evaluate", lambda self, mask, *rest: masks.append(mask.sum()) or evaluate(self, mask, *rest))
    pruned, whole = bm25.Best(3, 3), bm25.Best(3, 400)
    queries.search(shard, pruned)
    assert sum(masks) < 3 * shard.blocks * 0.6
    queries.search(shard, whole)
    assert (pruned.score == whole.score[:, :3]).all() and (pruned.doc == whole.doc[:, :3]).all()


def test_rows_of_the_index_are_narrow():
    """A row passes through the JVM whole: 4 bytes a posting and 10 a term at most here (it was 8 and 12), and counts of any size come back."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, 200) % 5000) for _ in range(500)] + ["b " * 300, "", None, "c " * 70000]
    ids = pa.array([*range(503), None])
    plain = bm25._posting_lists(ids, pa.array(texts, pa.large_string()))
    (narrow,) = bm25._index(1000, 1 << 30)(iter([pa.RecordBatch.from_arrays([ids, pa.array(texts)], names=["doc_id", "text"])]))
    numbers = lambda k, kind: np.frombuffer(plain.column(k)[0].as_buffer(), dtype=kind)
    length, row, tf = (numbers(k, np.int32) for k in (3, 4, 5))
    most = int(tf.max())
    assert most == 70000
    got = [bm25._unpacked(narrow.column(k)[0].as_buffer(), n) for k, n in ((3, len(length)), (4, len(row)), (5, len(tf)))]
    assert all((a == b).all() for a, b in zip(got, (length, row, tf)))
    (narrow,) = bm25._index(1000, 1 << 30)(iter([pa.RecordBatch.from_arrays([ids[:500], pa.array(texts[:500])], names=["doc_id", "text"])]))
    terms = len(narrow.column(2)[0].as_buffer()) // 8
    postings = int(bm25._unpacked(narrow.column(3)[0].as_buffer(), terms).sum())
    assert sum(len(narrow.column(k)[0].as_buffer()) for k in (2, 3, 4, 5)) <= 10 * terms + 4 * postings


def test_search_lays_out_few_postings_at_once(spark, monkeypatch):
    """Postings of a few queries are laid out at a time, and the best are those of scoring by single queries."""
    rows = corpus(90)
    found = lambda: [tuple(r) for r in bm25.search(spark, docs(spark, rows), docs(spark, rows[:40]), 5).orderBy("query_id", "rank").collect()]
    for name, value in {"SHARD_DOCS": 30, "BLOCK": 4, "DENSE": 6, "PIVOTS": 1}.items():
        monkeypatch.setattr(bm25, name, value)
    want = []
    for few in (1, 7, 64):
        monkeypatch.setattr(bm25, "FEW", few)
        got = found()
        want = want or got
        assert got == want and len(got) == 200


def test_sharding(spark):
    rows = [(i, "x" * (i % 300)) for i in range(500)] + [(7, "dup" * 50)] * 40 + [(None, None), (900, "y" * 5000)]
    placed = sharding.assign(spark, docs(spark, rows), 2000, 3).collect()
    assert len(placed) == len(rows)
    by = defaultdict(list)
    for r in placed:
        by[r.shard].append(r)
    assert all(sum(r.n_bytes for r in x) <= 2000 or len(x) == 1 for x in by.values())
    depth = {(r.depth, r.prefix) for r in placed}
    assert not any((d - k, p >> k) in depth for d, p in depth for k in range(1, d + 1))  # leaves only
    assert max(r.depth for r in placed) < 20  # a row over the limit, or rows of one key, do not split on
    assert sum(r.page > 0 for r in placed) == 42  # 41 rows of the repeated key, one large row
    one = sharding.assign(spark, docs(spark, rows), 1 << 30).select("shard").distinct().collect()
    assert [r.shard for r in one] == ["00-0"] and sharding.assign(spark, docs(spark, rows).limit(0)).count() == 0


def test_sharding_against_brute_force(spark, monkeypatch):
    """The registered SQL at a small limit, and pages of a key of many rows dealt to several blocks."""
    import duckdb

    rows = [(i, "x" * (i % 300)) for i in range(300)] + [(7, "dup" * 50)] * 40 + [(None, None), (900, "y" * 5000), (901, "")]
    data = docs(spark, rows)
    got = sorted(tuple(r) for r in sharding.assign(spark, data.filter("doc_id IS NOT NULL"), 2000, 4).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r for r in rows if r[0] is not None])
    assert got == sorted(con.execute("SELECT doc_id, shard, depth, prefix, page, n_bytes FROM (" + sharding.sql("documents", 2000) + ")").fetchall())
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 10)
    by = defaultdict(list)
    for r in sharding.assign(spark, data, 2000, 4).collect():
        by[r.shard].append(r)
    assert sum(map(len, by.values())) == len(rows) and all(sum(r.n_bytes for r in x) <= 2000 or len(x) == 1 for x in by.values())


def test_shards_are_written_whole(spark, tmp_path):
    rows = [(i, "x" * (i % 200)) for i in range(200)] + [(7, "dup" * 50)] * 30 + [(None, None), (900, "y" * 5000)]
    sharding.write_shards(spark, docs(spark, rows), str(tmp_path / "out"), 2000, 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter(rows)
    size = back.groupBy("shard").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + sharding.ROW_BYTES).alias("n"), F.count("*").alias("c"))
    assert all(r.n <= 2000 or r.c == 1 for r in size.collect())


def groups_of(rows, width, threshold=80):
    sets = {}
    for i, t in rows:
        w = SPACE.findall("".join(x.lower() if x < "\x7f" else x for x in t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    label = {i: i for i in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = label[a], label[b]
                label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
    return {i: (len(sets[i]), label[i]) for i in ids}


def test_near_dedup_against_brute_force(spark):
    rng = random.Random(4)
    fresh = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    passage = fresh(60)
    rows, i = [], 0
    for _ in range(12):
        base = fresh(rng.choice([3, 5, 8, 40, 150]))
        for _ in range(rng.choice([1, 3, 8])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                w[rng.randrange(len(w))] = f"e{rng.randrange(9999)}"
            rows.append((i, " ".join(w)))
            i += 1
    rows += [(i + k, " ".join(fresh(50) + passage + fresh(30))) for k in range(25)]
    chain = fresh(80)
    for k in range(12):  # neighbours are near, ends are not
        chain = chain[3:] + fresh(3)
        rows.append((i + 30 + k, " ".join(chain)))
    rows += [(900, None), (901, ""), (902, "one"), (903, "One"), (904, "a b c d"), (905, "a b c d")]
    rng.shuffle(rows)
    want = groups_of(rows, 4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_dedup(spark, docs(spark, rows), 4).collect()}
    assert got == want
    kept = {r.doc_id for r in minhash.keep_one(spark, docs(spark, rows + [(None, "free"), (None, "free")])).collect()}
    assert kept == {i for i, (_, c) in groups_of(rows, 5).items() if i == c} | {None}


def test_near_dedup_where_one_set_fits_the_sketch(spark):
    rng = random.Random(9)
    rows = []
    for n, more in [(48, 12), (48, 11), (48, 10), (47, 11), (46, 11), (45, 11)] * 4:
        w = [f"w{rng.randrange(10**9)}" for _ in range(n + 3 + more)]
        rows += [(len(rows), " ".join(w[: n + 3])), (len(rows) + 1, " ".join(w))]
    want = groups_of(rows, 4)
    assert {n for n, _ in want.values()} == {45, 46, 47, 48, 56, 57, 58, 59, 60} and len({c for _, c in want.values()}) == 24
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_dedup(spark, docs(spark, rows), 4).collect()} == want


def test_near_dedup_filter_is_no_tighter_than_the_lists(spark):
    k = minhash.SKETCH
    common, own = list(range(minhash.SHARED)), k - minhash.SHARED
    a, b = [common + list(range(at, at + 2 * own, 2)) for at in (100, 101)]
    reps = spark.createDataFrame([(1, a), (2, b)], "rep long, sketch array<long>")
    assert minhash._likely(reps, spark.createDataFrame([(1, 2)], "a long, b long"), 0.8, k).count() == 1


def test_near_dedup_odd(spark):
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_shingles, r.kept) for r in minhash.near_dedup(spark, docs(spark, ODD), 4).collect())
    assert len(got) == len(ODD) and all(x[3] for x in got)
    assert minhash.near_dedup(spark, docs(spark, ODD).limit(0)).count() == 0


def test_pipeline_stages(spark, tmp_path, sf):
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    df = frame
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, sf)
        assert out.columns == frame.columns, name
        out.write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
    last = corpus_pipeline.STAGES[-1][1](spark, df, sf)
    assert last.count() == df.count() > 100 and {"doc_id", "shard"} <= set(last.columns)


def test_pipeline_stages_at_the_edges(spark, tmp_path):
    """Null columns, empty and long texts, ties, repeated rows, an empty table, clashing names: each stage keeps what it should, with its columns."""
    long = " ".join(f"v{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "one two three four five six seven"), (3, "one two three four five six seven"), (4, "one two three four five six seven"), (None, "a null id"), (None, "a null id"), (5, long), (6, " \t"), (7, "\u00c9t\u00e9 2024")]
    frame = docs(spark, rows).withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.when(F.col("doc_id") % 2 == 0, "s")).withColumn("n_chars", F.length("text"))
    spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None), (None, "x"), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for df, names in ((frame, list(frame.columns)), (frame.limit(0), list(frame.columns))):
        n = df.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, str(tmp_path))
            got = Counter((r.doc_id, getattr(r, "text", None)) for r in out.collect())
            if name == "near_dedup":
                # rows of one doc_id are one document; without an id nothing is a copy
                want = Counter(rows if n else [])
                want = Counter({k: 1 if k[0] == 3 else c for k, c in want.items() if k[0] != 4})
            elif name == "sharding":
                assert sum(got.values()) == n and {"doc_id", "shard"} <= set(out.columns)
                continue
            elif name == "mixing":
                assert set(got) == set(rows if n else []) and all(got[k] <= 2 * c for k, c in Counter(rows).items())
                continue
            else:
                want = Counter(rows if n else [])
            assert got == want and out.columns == names, name


def test_pipeline_decontamination_against_brute_force(spark, tmp_path):
    alnum = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    rng = random.Random(6)
    fresh = lambda n: " ".join(f"w{rng.randrange(2000)}" for _ in range(n))
    items = [(i, fresh(rng.randint(14, 40))) for i in range(6)] + [(6, None), (7, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    word = lambda i, a, b: " ".join(items[i][1].split()[a:b])
    rows = [(i, fresh(rng.randint(0, 60))) for i in range(40)] + [(40, None), (41, ""), (42, items[0][1])]
    rows += [(43, f"{fresh(20)} {items[1][1].upper()}, {fresh(20)}"), (44, f"{fresh(5)} {items[2][1]} {items[3][1]}")]
    rows += [(45, f"{fresh(9)} {word(4, 3, 11)}"), (46, f"{fresh(9)} {word(4, 3, 10)}"), (47, f"{word(5, 0, 4)} and {word(5, 4, 14)}")]

    def grams(t):
        w = alnum.findall((t or "").lower())
        return {tuple(w[k : k + 8]) for k in range(len(w) - 7)}

    planted = set().union(*(grams(t) for _, t in items))
    want = [i for i, t in rows if not grams(t) & planted]
    assert {46} <= set(want) and not {42, 43, 44, 45, 47} & set(want)
    kept = corpus_pipeline.decontaminate_stage(spark, docs(spark, rows), str(tmp_path)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted(r for r in rows if r[0] in want)

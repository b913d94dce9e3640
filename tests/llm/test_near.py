import random
import re

import numpy as np

from boxloom.llm import near


def shingle_set(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus():
    rng = random.Random(11)
    vocab = ["Ab", "cd", "é", "x", "the", "of"] + [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(30):
        base = [rng.choice(vocab) for _ in range(rng.choice([2, 3, 7, 12, 40, 200]))]
        texts.append(" ".join(base))
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4, 9])):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts.append(rng.choice([" ", "\n", "  "]).join(copy))
    texts += ["", None, " \n", "one", "ONE", "one two", "a b c", "A B C", "a b c d"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_against_brute_force(spark, monkeypatch):
    rows = corpus()
    want = brute(rows)
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, key string").repartition(3)
    monkeypatch.setattr(near, "BLOCK", 2)
    monkeypatch.setattr(near, "ROUNDS", 1)
    monkeypatch.setattr(near, "BROADCAST_IDS", 0)
    got = {r.id: (r.n_shingles, r.component_id) for r in near.near_duplicates(docs).collect()}
    assert got == want
    assert near.near_duplicates(docs).columns[:4] == ["id", "n_shingles", "component_id", "kept"]


def test_dense_group_near_the_threshold(spark, monkeypatch):
    """Many members that link with a few others each: every round of the block comparison has work."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(70):
        copy = list(base)
        for i in rng.sample(range(120), rng.choice([1, 2, 3, 4])):
            copy[i] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    monkeypatch.setattr(near, "ROUNDS", 0)
    monkeypatch.setattr(near, "BLOCK", 20)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.id: (r.n_shingles, r.component_id) for r in near.near_duplicates(docs).collect()} == brute(rows)


def test_forest_first():
    a, b = np.array([1, 1, 2, 3]), np.array([2, 3, 3, 4])
    score = np.array([0.9, 0.95, 0.99, 0.8])
    assert near.passed_on(a, b, a, b, score, 0) == [2, 1, 3]
    assert near.passed_on(a, b, np.array([1, 1, 1, 1]), np.array([2, 2, 2, 4]), score, 2) == [2, 1, 3]
    assert near.passed_on(a, b, a, b, score, None) == [0, 1, 2, 3]


def test_collisions():
    """The chance that minima of independent sets share a register, against counting."""
    rng = np.random.default_rng(1)
    for n, m in ((2000, 2000), (5000, 1000)):
        hits = []
        for _ in range(300):
            x, y = (near.fine_registers(np.unique(rng.integers(0, 2**64, k * 4, dtype=np.uint64))) for k in (n, m))
            hits.append((x == y)[(x != near.EMPTY) & (y != near.EMPTY)].mean())
        want = near.collision(np.array(n * 4 / near.FINE), np.array(m * 4 / near.FINE))
        assert abs(np.mean(hits) - want) < 0.3 * want, (np.mean(hits), want)


def test_repeated_ids_and_long_texts(spark):
    long = " ".join(f"w{i % 7001}" for i in range(300_000))
    rows = [(3, "a b c d e"), (3, "p q r s t"), (5, "A b c d e"), (7, "p q r s t"), (7, "a b c d e"), (8, long), (9, long + " end")]
    got = sorted((r.id, r.component_id, r.kept) for r in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(3, 3, True), (3, 3, True), (5, 3, False), (7, 3, False), (7, 3, False), (8, 8, True), (9, 8, False)]


def test_empty_and_null_ids(spark):
    assert near.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (2, "A b c d")], "doc_id long, text string")
    got = sorted((r.id or -1, r.component_id, r.kept) for r in near.near_duplicates(docs).collect())
    assert got == [(-1, None, True), (2, 2, True), (4, 2, False), (4, 2, False)]


def test_estimate_is_close():
    rng = np.random.default_rng(4)
    for size in (7, 60, 400, 5000):
        pool = rng.integers(0, 2**63, 2 * size, dtype=np.uint64) * np.uint64(2)
        both = int(size * 0.9)
        a, b = np.unique(pool[:size]), np.unique(np.r_[pool[:both], pool[size : 2 * size - both]])
        true = both / (2 * size - both)
        got = near.estimate((near.registers(a) == near.registers(b)).mean(), np.array(float(size)), np.array(float(size)), near.REGISTERS)
        assert abs(got - true) < 0.15, (size, got, true)

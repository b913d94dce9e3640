import random

import numpy as np

from boxloom.llm import repeats


def brute(rows):
    seen, out = {}, {}
    for i, t in rows:
        if i is not None:
            data = (t or "").encode()
            for p in range(len(data) - 49):
                s = data[p : p + 50]
                seen[s] = min(seen.get(s, i), i)
    for i, t in rows:
        data = (t or "").encode()
        cut = np.zeros(len(data), bool)
        for p in range(len(data) - 49) if i is not None else ():
            if seen[data[p : p + 50]] < i:
                cut[p : p + 50] = True
        kept = bytes(b for b, c in zip(data, cut) if not c)
        edge = np.diff(np.r_[0, cut.astype(int), 0])
        out.setdefault(i, []).append((list(zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))), kept))
    return out


def corpus():
    rng = random.Random(8)
    prose = lambda n: "".join(rng.choices("abcdé \n\x00", k=n))
    shared = [prose(n) for n in (49, 50, 51, 80, 400, 1500)]
    texts = ["", None, "x" * 49, "x" * 50, "x" * 200, "ab" * 90, "ab" * 25, "q" * 120]
    for _ in range(60):
        parts = [prose(rng.choice([0, 3, 60, 300])) for _ in range(4)]
        for s in rng.choices(shared, k=2):
            lo = rng.choice([0, 0, rng.randrange(len(s))])
            parts.insert(rng.randrange(5), s[lo:])
        texts.append("".join(parts))
    texts += [texts[12]] * 4 + [texts[20]] * 2 + [texts[30][:-1]]
    rng.shuffle(texts)
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


def check(spark, rows, **sizes):
    """Against the strings of all rows, a text at a time; rows of one id and text can't be told apart."""
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, places string").repartition(5)
    got = {}
    for r in repeats.remove_repeats(docs, **sizes).collect():
        got.setdefault(r._row.doc_id, []).append(([(s.start, s.end) for s in r.spans], bytes(r.kept)))
        assert r._row.places == "z"
    want = brute(rows)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_against_brute_force(spark, monkeypatch):
    rows = corpus()
    check(spark, rows)
    monkeypatch.setattr(repeats, "BROADCAST_IDS", 0)
    check(spark, rows, unit_bytes=300, part_bytes=200, suffix_bytes=60)


def test_equal_hashes_are_compared():
    raw = np.frombuffer(("ab" * 60 + "cd" * 60).encode(), np.uint8)
    assert repeats._same_bytes(raw, np.array([0, 0]), np.array([60, 120]), np.array([60, 60])).tolist() == [True, False]


def test_edges(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rng = random.Random(1)
    long, other = ("".join(rng.choices("abcdefgh", k=200)) for _ in range(2))
    check(spark, [(None, long), (None, long), (5, long), (5, long), (9, "k" + long), (2, "short")])
    # one id with several texts: each row is judged by its own bytes
    check(spark, [(1, long), (5, long), (5, other), (5, other), (7, other + "k"), (5, "x" + long + other)])


def test_very_long_text(spark):
    rng = random.Random(3)
    head = "".join(rng.choices("abcdefgh", k=300))
    body = "".join(rng.choices("abcdefgh ", k=3 << 20))
    docs = spark.createDataFrame([(1, head), (2, body[: 2 << 20] + head + body[2 << 20 :])], "doc_id long, text string")
    found = {r._row.doc_id: [(s.start, s.end) for s in r.spans] for r in repeats.remove_repeats(docs).collect()}
    assert found == {1: [], 2: [(2 << 20, (2 << 20) + 300)]}

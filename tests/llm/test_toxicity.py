import random

import numpy as np

from boxloom.llm import toxicity


def test_held_out_accuracy(spark):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(400)]
    bad = ["idiot", "moron", "scum", "worthless"]
    rows = []
    for i in range(900):
        words = rng.choices(vocab, k=rng.randint(20, 120))
        toxic = rng.random() < 0.15
        for _ in range(rng.randint(2, 5) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), int(toxic), "p"))
    rows += [(1000, None, 0, "p"), (1001, "", 0, "p"), (None, "idiot scum moron", 1, "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, t int, p_toxic string")
    # every toxic document is hostile, a few others are too
    marks = [(r[0], max(r[2], int(r[0] is not None and r[0] % 11 == 0)), r[2]) for r in rows if r[0] is None or r[0] < 600]
    labels = spark.createDataFrame(marks + [(5, None, None), (4444, 1, 1)], "doc_id long, hostile int, toxic int")
    chain = ("hostile", "toxic")
    got = {r.id: r for r in toxicity.classify(docs, labels, categories=chain).collect()}
    assert len(got) == len(rows)
    wrong = sum(got[i].toxic != bool(t) for i, _, t, _ in rows[600:900])
    assert wrong <= 6, wrong
    assert not got[1000].toxic and got[1000][1:] == got[1001][1:]
    assert all(0 <= got[5][f"p_{c}"] <= 1 for c in chain)
    none = toxicity.classify(docs, labels.limit(0), categories=chain).collect()
    assert not any(r.toxic for r in none) and toxicity.classify(docs.limit(0), labels, categories=chain).count() == 0
    report = toxicity.learn(docs, labels, categories=chain)["report"]["toxic"]
    assert report["rows"] == 600 and report["right"] >= 0.9 * report["positive"] and report["flagged"] <= report["right"] + 6


def test_folds_do_not_leak():
    """Words that name single rows would be learned by heart; out of fold they say nothing."""
    rng = np.random.default_rng(2)
    label = (rng.random(400) < 0.3).astype(int)
    cells = [np.unique(np.r_[rng.integers(0, 40, 5), 1000 + 3 * i]).astype(np.int64) for i in range(400)]
    report = toxicity.train(cells, label[:, None], ("toxic",), sure=0.0)["report"]["toxic"]
    assert report["right"] <= 0.5 * report["flagged"] + 5


def test_missing_labels_and_repeated_ids(spark):
    rows = [(i, "good words here" if i % 2 else "bad vile words") for i in range(80)] + [(3, "another text"), (7, "x " * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, None if i < 60 else 1, int(i % 2 == 0)) for i in range(80)] + [(2, None, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(r.toxic == (r.id % 2 == 0) for r in got if r.id > 7)

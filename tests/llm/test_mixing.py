import itertools
import random

from boxloom.llm import mixing


def brute_targets(sizes, share=1.5, weights=(5, 2, 1), most=2):
    """Budgets of sources in order, dealt again until none is above its limit."""
    total, out, open_ = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        left = total - sum(out[i] for i in range(len(sizes)) if i not in open_)
        unit = left / sum(weights[i % 3] for i in open_)
        over = {i for i in open_ if unit * weights[i % 3] > most * sizes[i]}
        out = [most * sizes[i] if i in over else unit * weights[i % 3] if i in open_ and not over else out[i] for i in range(len(sizes))]
        open_ = open_ - over if over else set()
    return out


def test_targets_reshare(spark):
    rng = random.Random(3)
    for sizes in ([10, 100, 1000, 50, 0], [0, 0], [7], [rng.choice([0, 3, 900, 40]) for _ in range(60)]):
        rows = mixing.targets(spark.createDataFrame([(f"s{i:03}", s) for i, s in enumerate(sizes)], "_src string, s long")).cache()
        unit = mixing.unit_of(rows)
        got = [min(r.weight * unit if r.weight * unit == r.weight * unit else 0.0, float(r.limit)) for r in rows.orderBy("sid").collect()]
        want = brute_targets(sizes)
        assert all(abs(a - b) < 1e-6 for a, b in zip(got, want)) and abs(sum(got) - 1.5 * sum(sizes)) < 1e-6


def test_fit_is_the_best_subset():
    rng = random.Random(1)
    for _ in range(200):
        counts = {s: rng.randint(1, 3) for s in rng.sample(range(1, 30), rng.randint(1, 4))}
        total = sum(s * n for s, n in counts.items())
        budget = rng.randint(0, total)
        got = mixing.fit(counts, budget)
        assert all(0 <= got[s] <= counts[s] for s in got)
        share = {s: n * budget // total for s, n in counts.items()} if budget < total else counts
        best = max(
            v
            for c in itertools.product(*(range(share[s], counts[s] + 1) for s in counts))
            if (v := sum(a * b for a, b in zip(c, counts))) <= budget
        )
        assert sum(s * n for s, n in got.items()) == best
    small = mixing.fit({1000: 50, 7: 400, 3: 90}, 30_011, limit=100)
    assert sum(s * n for s, n in small.items()) == 30_011


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" * rng.choice([1, 2, 5, 9, 40])), rng.choice(["b", "a", "a", "é", None]), "x") for i in range(400)]
    rows += [(1000 + i, "same size text here", "a", "x") for i in range(300)] + [(5000, None, "b", "x"), (5001, "", None, "x"), (None, "u v", "b", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    sizes = {}
    for i, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, brute_targets([sizes[s] for s in order])))
    taken = {}
    for r in out:
        assert r.source_size == sizes[r._row.source] and abs(r.target - want[r._row.source]) < 1e-9
        assert r.size == len((r._row.text or "").split()) and 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r._row.source] = taken.get(r._row.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 3 for s in order), (taken, want)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((r._row.doc_id or -1, r.taken) for r in out) == sorted((r._row.doc_id or -1, r.taken) for r in again)
    assert mixing.mix(docs.limit(0)).count() == 0

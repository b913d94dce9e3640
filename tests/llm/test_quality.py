import math
import re

import xxhash
from pyspark.sql import functions as F

from boxloom.llm import quality

ROWS = [
    (1, "the cat sat on the mat and the dog ran far away\nthe cat sat on the mat and", "en"),
    (2, None, None),
    (3, "", "en"),
    (4, " \t\n ", "en"),
    (5, "a b", "en"),
    (6, "a b c d e a b c d e a b c d e", "en"),
    (7, "x# y* z$ %& |<>\nline one\nline one\n\nline one  　wide", None),
    (8, "café \U0001f600 naïve\x0bnext\x0cpage\rline one two three four five six", "fr"),
    (9, "good words here " * 300, "en"),
    (9, "good words here " * 300, "en"),
    (None, "one two three four five six seven eight nine ten eleven", "en"),
]


def h(values, buckets=None):
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else (v & (2**64 - 1)).to_bytes(8, "little")
        seed = xxhash.xxh64(data, seed=seed & (2**64 - 1)).intdigest()
    x = seed - 2**64 if seed >= 2**63 else seed
    return x if buckets is None else x & (buckets - 1)


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = {}
    for i in range(len(w) - 4):
        grams.setdefault(tuple(w[i : i + 5]), []).append(i)
    rep = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 10 or 100 * len(rep) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(rep), failed


def grams(text, buckets):
    w = [h([x]) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return [x & (buckets - 1) for x in w] + [h([a, b], buckets) for a, b in zip(w, w[1:])]


def test_against_brute_force(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, n_words string")
    good = spark.createDataFrame([(1,), (1,), (9,), (None,), (77,)], "doc_id long")
    got = quality.quality_rules(docs, good, buckets=256, threshold=-100_000).collect()
    raw, trusted = [0] * 256, [0] * 256
    for i, t, _ in ROWS:
        for b in grams(t, 256):
            raw[b] += 1
            trusted[b] += i in (1, 9)
    share = sum(trusted) / sum(raw)
    prior = quality.PRIOR
    ratio = [round(1e6 * math.log((g + prior * share) / (r + prior) / share)) for g, r in zip(trusted, raw)]
    want = []
    for i, t, lang in ROWS:
        total, n = sum(ratio[b] for b in grams(t, 256)), len(grams(t, 256))
        base = brute(t)
        want.append((i, lang, *base, not base[-1] and total >= -100_000 * n, round(total / n / 1e6, 9) if n else 0.0))
    have = [(r._row.doc_id, r._row.n_words, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, round(r.score, 9)) for r in got]
    assert sorted(have, key=str) == sorted(want, key=str)


def test_empty_and_untrusted(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long")
    assert quality.quality_rules(empty, none).count() == 0
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "doc_id long, text string")
    assert [r.kept for r in quality.quality_rules(docs, none).collect()] == [True]


def test_no_python_on_executors(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    plan = quality.quality_rules(docs, docs.select("doc_id"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([r[:2] for r in ROWS], "doc_id long, text string")
    good = docs.where(F.col("doc_id") < 5).select("doc_id")
    first = quality.quality_rules(docs, good).select("_row.doc_id", "score").collect()
    monkeypatch.setattr(quality, "BROADCAST_IDS", 0)
    second = quality.quality_rules(docs, good).select("_row.doc_id", "score").collect()
    assert sorted(first, key=str) == sorted(second, key=str)

import random

import corpus_pipeline
from .test_mixing import brute_targets
from .test_near import shingle_set
from .test_quality import brute as base_rules
from .test_repeats import brute as cuts


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(300)] + ["é", "the", "of"]
    prose = lambda n: " ".join(rng.choices(vocab, k=n))
    passage = prose(40)
    texts = [prose(rng.randint(12, 90)) for _ in range(40)]
    texts += [texts[3], texts[5] + " tail", texts[7][:-3], None, "", "too short", "a a a a a a a a a a a a a"]
    texts += [f"{prose(20)} {passage} {prose(15)}" for _ in range(4)]
    texts += [passage]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 40, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    good = stages["quality_rules"](spark, docs, str(tmp_path))
    assert good.columns == docs.columns
    kept = {r.doc_id: r.text for r in good.collect()}
    failed = {i for i, t in enumerate(texts) if base_rules(t)[-1]}
    assert not failed & set(kept) and len(kept) > 40

    near = stages["near_dedup"](spark, good, str(tmp_path))
    sets = {i: shingle_set(t, 5) for i, t in kept.items()}
    gone = set()
    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                gone.add(b)
    left = {r.doc_id: r.text for r in near.collect()}
    assert set(left) == set(kept) - gone and gone >= {40, 41, 42} & set(kept)

    cut = stages["repeat_removal"](spark, near, str(tmp_path))
    want = {}
    for i, found in cuts(sorted(left.items())).items():
        text = found[0][1].decode(errors="ignore")
        if text.split():
            want[i] = text
    got = {r.doc_id: r for r in cut.collect()}
    assert {i: r.text for i, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values())

    mixed = stages["source_mix"](spark, cut, str(tmp_path))
    assert mixed.columns == docs.columns
    taken, sizes = {}, {}
    for r in mixed.collect():
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
    for r in got.values():
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    order = sorted(sizes)
    for s, t in zip(order, brute_targets([sizes[s] for s in order])):
        assert abs(taken.get(s, 0) - t) <= 60

    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert packed.select("doc_id").distinct().count() == mixed.select("doc_id").distinct().count()


def test_edges(spark, tmp_path):
    """No rows, null ids and clashing columns; a genuine replacement character outlives a cut."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, id long, kept boolean, size int, spans string"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/a/documents.parquet")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/a/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/a").count() == 0
    rng = random.Random(2)
    prose = lambda n: " ".join(f"w{rng.getrandbits(30)}" for _ in range(n))
    passage = prose(12) + "é"
    texts = [f"{prose(20)} {passage} a", f"\ufffd {prose(20)} {passage[:-1]}è {prose(9)}", None, prose(30)]
    rows = [(i if i < 3 else None, t, "en", None, 1, 7, True, 3, "z") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/b/documents.parquet")
    labels.write.parquet(f"{tmp_path}/b/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/b/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, f"{tmp_path}/b")
        assert out.columns == docs.columns
        docs = out
    cut = {r.doc_id: r.text for r in corpus_pipeline.repeat_removal(spark, spark.read.parquet(f"{tmp_path}/b/documents.parquet"), "").collect()}
    assert cut[1].startswith("\ufffd ") and cut[1].count("\ufffd") == 1 and passage[:-1] not in cut[1] and cut[2] is None
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").where("doc_id is null").count() >= 1

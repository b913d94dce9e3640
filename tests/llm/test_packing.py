import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

from boxloom.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def model():
    return Tokenizer.from_file(PATH)


def test_encoder_equals_the_library():
    rng = random.Random(3)
    bits = ["a", "the", "don't", "é", "ß\U0001f600", " ", "  ", "\n", "\n\n", "\t", " ", " ", "\r\n", "\x1c", "\x85", "12", "...", "<|endoftext|>", "<|endoftext|> ", " <|endoftext|>", "\u00a0", "\u2003", "\u3000", "\u2028", "“q”", "«", "漢字", "'s", "-", "_x"]
    texts = ["", " ", "\n", " a", "a ", "a b", "it's  we'll \n x"] + ["".join(rng.choices(bits, k=rng.randint(1, 40))) for _ in range(800)]
    got = list(packing.Encoder(PATH).encode(pa.array([*texts, None])))
    assert not len(got.pop())
    want = [x.ids for x in model().encode_batch(texts, add_special_tokens=False)]
    assert [g.tolist() for g in got] == want


def test_pieces_cover_every_id_once(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "né"]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 1, 5, 90, 400, 900, 2500]))) for _ in range(120)] + [None, "", " "]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string").repartition(3, "doc_id")
    out = packing.pack(docs, PATH, unit_tokens=5000).toPandas()
    ids = {i: [*e.ids, 0] for i, e in enumerate(model().encode_batch([t or "" for t in texts], add_special_tokens=False))}
    for i, own in out.groupby("doc_id"):
        at = 0
        for r in own.sort_values("start").itertuples():
            assert r.start == at and r.doc_tokens == len(ids[i])
            piece = np.array(ids[i][at : at + r.length], "<u4")
            assert zlib.crc32(piece.tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids[i])
    assert set(out.doc_id) == set(ids)
    for _, seq in out.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert (seq.offset == seq.length.cumsum() - seq.length).all()
        total = seq.length.sum()
        assert total == seq.sequence_tokens.iloc[0] <= 1024 and total & (total - 1) == 0
    for _, group in out.groupby("step_group"):
        assert group.sequence_tokens.nunique() == 1
        assert group.length.sum() <= packing.STEP * packing.WINDOW


def test_special_tokens_are_the_library_s(spark):
    rows = [(1, "a <|endoftext|> b"), (2, "see <|endoftext|> here")]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    want = {i: len(model().encode(t, add_special_tokens=False).ids) + 1 for i, t in rows}
    assert {r.doc_id: r.doc_tokens for r in out} == want


def test_tiers():
    rng = random.Random(2)
    for lengths in ([600] * 9, [rng.randrange(1, 3000) for _ in range(400)], [1, 2, 3], [1024, 2048, 1], [700, 300, 24, 500, 12]):
        tiers = packing.Tiers()
        out = packing.pack_unit(lengths, tiers, 0)
        assert tiers.total < 1024
        out += packing.pack_rest(tiers)
        cover = {}
        for seq in out:
            size = sum(p[2] for p in seq)
            assert size <= 1024 and size & (size - 1) == 0
            for doc, start, n in seq:
                cover.setdefault(doc, []).append((start, n))
        for doc, n in enumerate(lengths):
            at = 0
            for start, part in sorted(cover[doc]):
                assert start == at and part > 0
                at += part
            assert at == n
    tiers = packing.Tiers()
    # a long piece's gap is filled from shorter tiers, each tier has sequences of its own length
    assert packing.pack_unit([700, 324, 400, 112], tiers, 0) == [[(0, 0, 700), (1, 0, 324)], [(2, 0, 400), (3, 0, 112)]]


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "word " * 400_000 + "x" * 100_000)], "doc_id long, text string")
    out = packing.pack(docs, PATH).toPandas()
    assert out.length.sum() == out.doc_tokens.iloc[0] > 400_000


def test_empty_and_null_ids(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    out = packing.pack(spark.createDataFrame([(None, None), (7, "a"), (7, "a")], "doc_id long, text string"), PATH).collect()
    assert sorted((r.doc_id is None, r.length) for r in out if r.doc_tokens == 1) == [(True, 1)]
    assert sum(r.length for r in out) == 5


def test_few_chunks_are_encoded_at_once(monkeypatch):
    """The tokenizer's results are held for CALL chunks at most, and the ids are those of the whole texts."""
    enc = packing.Encoder(PATH)
    model, sizes = enc.model, []

    class Counting:
        def encode_batch_fast(self, texts, **more):
            sizes.append(len(texts))
            return model.encode_batch_fast(texts, **more)

    enc.model = Counting()
    texts = [" ".join(f"w{i}x{j}" for j in range(3000)) for i in range(4)]
    got = [ids.tolist() for ids in enc.encode(pa.array(texts))]
    assert got == [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)]
    assert sum(sizes) == 12_000 and max(sizes) <= 4096

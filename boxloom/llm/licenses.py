"""License scans by diagonal voting.

All rolling word 3-grams of a text that occur in any template are joined with their
template positions. A hit votes for its diagonal (place in the text minus place in the
template). From the diagonal with most votes on, its neighbours, as insertions and omissions
make them, are merged with it. A merged span is verified by alignment: the longest run of its
hits that ascends in text and template must confirm a share of the words of both, and, where
another license has nearly the same notice, most of the words that tell the two apart. Of
spans that overlap the one that confirms most words stays.

Words are runs of digits, letters a to z and non-ASCII characters, after lower-casing A-Z.
The template table is a parameter; it is read on the driver and its grams are broadcast, so
it should be a table of notices, not of documents. Texts are hashed whole, grams that no
template holds are dropped at once, and the rest meet the templates in a join.

Null and empty texts have no words and no labels (first_word, last_word null, score 0).
Very long texts are hashed in blocks of their own. Rows that repeat an id are scanned each.
Equal votes go to the smaller diagonal, equal spans to the smaller label. Empty tables give
no rows. Other columns aren't read, so their names can't clash.
"""

from __future__ import annotations

from bisect import bisect_left
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.llm.common import ALNUM_WORD, Scratch, blocks, shingles, sliced, words_of
from boxloom.llm.license_texts import TEMPLATES

GRAM = 3
#: Diagonals this far from the one with most votes belong to its span, at most a quarter of the template's words.
DRIFT = 3
#: Share of its own and of the template's words that a span must confirm.
LEAST = 0.75
#: Notices of different licenses are nearly the same from this similarity on.
CLOSE = 0.6

#: Phrases that are always labelled where their words stand consecutively.
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}


def _hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return words_of(raw, np.array([0, len(raw)]), ALNUM_WORD)[0]


def template_grams(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """(gram, template, at): every 3-gram of every template."""
    rows = [(g, t, at) for t, (_, text) in enumerate(templates) for at, g in enumerate(shingles(_hashes(text), GRAM).view(np.int64).tolist())]
    return spark.createDataFrame(rows, "gram long, template int, at int")


def telling(templates) -> list[tuple[str, int, list[set[int]]]]:
    """(label, words, places) of each template; places: for each close template of another label, the words it lacks."""
    words = [_hashes(text).tolist() for _, text in templates]
    out = []
    for (label, _), own in zip(templates, words):
        apart = []
        for (other, _), theirs in zip(templates, words):
            if other != label:
                same = SequenceMatcher(None, own, theirs, autojunk=False)
                if same.ratio() >= CLOSE:
                    lacks = set(range(len(own))) - {i for m in same.get_matching_blocks() for i in range(m.a, m.a + m.size)}
                    apart += [lacks] if lacks else []
        out.append((label, len(own), apart))
    return out


_SCHEMA = (
    "id long, n_words long, n_base long, first_word long, last_word long, base array<string>, "
    "hits array<struct<pos: bigint, gram: bigint>>"
)


def _scan(templates):
    def run(batches):
        known = np.unique(np.concatenate([shingles(_hashes(t), GRAM) for _, t in templates]))
        phrases = [(label, _hashes(p)) for label, p in sorted(PHRASES.items())]
        for batch in batches:
            rows = []
            for row, raw, offsets in blocks(batch.column(1)):
                words, first = words_of(raw, offsets, ALNUM_WORD)
                owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
                found = [[] for _ in range(len(first) - 1)]
                for label, p in phrases:
                    n = len(words) - len(p) + 1
                    if n > 0:
                        at = np.logical_and.reduce([words[i : i + n] == h for i, h in enumerate(p)])
                        at = np.flatnonzero(at & (owner[:n] == owner[len(p) - 1 :]))
                        for d, x in zip(owner[at].tolist(), (at - first[owner[at]]).tolist()):
                            found[d].append((x, label))
                grams = shingles(words, GRAM)
                at = np.flatnonzero(np.isin(grams, known))
                at = at[owner[at] == owner[at + GRAM - 1]]
                hits = [[] for _ in found]
                for d, x, g in zip(owner[at].tolist(), (at - first[owner[at]]).tolist(), grams[at].view(np.int64).tolist()):
                    hits[d].append({"pos": x, "gram": g})
                for d, (base, n) in enumerate(zip(found, np.diff(first).tolist())):
                    places = [x for x, _ in base]
                    rows.append((n, len(base), min(places, default=None), max(places, default=None), sorted({y for _, y in base}), hits[d]))
            cols = list(zip(*rows)) if rows else [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.list_(pa.string()), pa.list_(pa.struct([("pos", pa.int64()), ("gram", pa.int64())]))]
            arrays = [batch.column(0)] + [pa.array(c, k) for c, k in zip(cols, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n_words", "n_base", "first_word", "last_word", "base", "hits"])

    return run


def ascending(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of (place in the text, place in the template) that ascends in both."""
    tails, ends, back = [], [], {}
    for pos, at in sorted(hits, key=lambda h: (h[0], -h[1])):
        i = bisect_left(tails, at)
        back[pos, at] = ends[i - 1] if i else None
        tails[i:], ends[i:] = ([at], [(pos, at)]) if i == len(tails) else ([at, *tails[i + 1 :]], [(pos, at), *ends[i + 1 :]])
    out, step = [], ends[-1] if ends else None
    while step:
        out.append(step)
        step = back[step]
    return out[::-1]


def verified(lines: list[tuple[int, int, list[int]]], known: list[tuple[str, int, list[set[int]]]], least: float) -> list[dict]:
    """Spans of one text from (template, diagonal, places of its hits)."""
    found = []
    by: dict[int, dict[int, list[int]]] = {}
    for template, diagonal, places in lines:
        by.setdefault(template, {})[diagonal] = places
    for template, own in by.items():
        label, words, apart = known[template]
        drift = min(DRIFT, words // 4)
        for peak in sorted(own, key=lambda d: (-len(own[d]), d)):
            near = [d for d in range(peak - drift, peak + drift + 1) if d in own]
            if peak not in own or GRAM * sum(len(own[d]) for d in near) < least * words:
                continue
            run = ascending([(p, p - d) for d in near for p in own[d]])
            sure = {at + k for _, at in run for k in range(GRAM)}
            start, end = run[0][0], run[-1][0] + GRAM
            share = len(sure) / max(words, end - start)
            if share >= least and all(2 * len(lacks & sure) >= len(lacks) for lacks in apart):
                found.append({"start": start, "end": end, "label": label, "share": share, "words": len(sure)})
                for d in near:
                    del own[d]
    kept: list[dict] = []
    for s in sorted(found, key=lambda s: (-s["words"], -s["share"], s["label"], s["start"])):
        if all(2 * (min(s["end"], k["end"]) - max(s["start"], k["start"])) <= s["end"] - s["start"] for k in kept):
            kept.append(s)
    return sorted(kept, key=lambda s: (s["start"], s["end"], s["label"]))


_SPAN = "start long, end long, label string, share double, words long"


def _verify(known, least: float):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("share", pa.float64()), ("words", pa.int64())]))

    def run(batches):
        for batch in batches:
            spans = [verified([(x["template"], x["diagonal"], sorted(x["places"])) for x in lines], known, least) for lines in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["key", "spans"])

    return run


def spans(hits: DataFrame, templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """(key, spans): verified spans of hits (key, pos, gram), for keys that have any."""
    grams = template_grams(hits.sparkSession, templates)
    votes = hits.join(F.broadcast(grams), "gram").withColumn("diagonal", F.col("pos") - F.col("at"))
    lines = votes.groupBy("key", "template", "diagonal").agg(F.collect_set("pos").alias("places"))
    texts = lines.groupBy("key").agg(F.collect_list(F.struct("template", "diagonal", "places")).alias("lines"))
    return texts.mapInArrow(sliced(_verify(telling(templates), least)), f"key long, spans array<struct<{_SPAN.replace(' ', ':').replace(',:', ', ')}>>").where(F.size("spans") > 0)


def license_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """One row per input row: id, n_words, base places and labels, all labels, score and spans."""
    spark = docs.sparkSession
    pairs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = pairs.mapInArrow(sliced(_scan(templates)), _SCHEMA).withColumn("key", F.monotonically_increasing_id())
    found = Scratch(spark, "licenses").keep(found, "scanned")
    hits = found.select("key", F.explode("hits").alias("hit")).select("key", "hit.pos", "hit.gram")
    out = found.drop("hits").join(spans(hits, templates, least), "key", "left")
    own = F.coalesce(F.transform("spans", lambda s: s["label"]), F.array().cast("array<string>"))
    both = F.array_sort(F.array_distinct(F.concat("base", own)))
    share = F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0))
    return out.select(
        "id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"), F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(share).alias("score"), "spans",
    )

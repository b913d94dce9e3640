import random
import re

from boxloom.llm import licenses

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ROWS = [
    (1, "Intro. CC BY text, cc-by; all RIGHTS reserved.\nGNU General Public License"),
    (2, None),
    (3, ""),
    (4, "ccé by cc  by all rights, not reserved"),
    (5, "x " * 50 + "Released under the MIT License. " + "y " * 50 + "released under an MIT license"),
    (6, "Permission is hereby granted, free of charge, to any happy person obtaining a copy of this software and associated documentation files"),
    (7, "general public"),
    (8, "license all rights reserved all rights reserved"),
    (8, "license all rights reserved all rights reserved"),
    (None, "this work is licensed under the apache license, version 2.0."),
]


def test_scan(spark):
    docs = spark.createDataFrame([(i, t, 0) for i, t in ROWS], "doc_id long, text string, key int")
    got = licenses.license_scan(docs).collect()
    assert len(got) == len(ROWS)
    by = {r.id: r for r in got}
    for i, t in ROWS:
        words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(p, label) for label, phrase in licenses.PHRASES.items() for p in range(len(words)) if words[p : p + len(phrase.split())] == phrase.split()]
        r = by[i]
        assert (r.n_words, r.n_base) == (len(words), len(at))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in at}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert by[5].labels == "mit" and by[6].labels == "mit" and by[None].labels == "apache" and by[2].labels == ""
    assert [(s.start, s.end) for s in by[5].spans] == [(50, 55)]
    assert by[6].spans[0].start == 0 and by[6].spans[0].end == len(re.findall(WORD, ROWS[5][1].lower()))
    assert licenses.license_scan(docs.limit(0)).count() == 0


GPL = (
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
    "Foundation; either version 2 of the License, or (at your option) any later version."
)


def labels_of(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.labels for r in sorted(licenses.license_scan(docs).collect(), key=lambda r: r.id)]


def test_verified_labels(spark):
    lgpl = GPL.replace("This program", "This library").replace("GNU General", "GNU Lesser General").replace("version 2 ", "version 2.1 ")
    agpl = GPL.replace("GNU General", "GNU Affero General").replace("version 2 ", "version 3 ")
    words = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files".split()
    turned = " ".join(words[10:] + words[:10])
    texts = {
        GPL: "gpl", lgpl: "gpl,lgpl", agpl: "agpl,gpl",  # the base phrase labels both
        "released under the big, under the MIT roof, the mit license": "",
        turned: "", "pre " * 9 + " ".join(words) + " post" * 9: "mit", " ".join(words[:5] + ["quite", "really"] + words[5:]): "mit",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.": "cc-by",
        "all rights reserved " * 50: "reserved", "x " * 200_000 + "Released under the MIT License": "mit",
    }
    assert labels_of(spark, *texts) == list(texts.values())


def test_labels_against_brute_force(spark):
    """Every window of every text, aligned with every template word by word."""
    rng = random.Random(4)
    filler = [f"w{i}" for i in range(50)]
    texts = []
    for _ in range(40):
        label, notice = rng.choice(licenses.TEMPLATES)
        words = re.findall(WORD, notice.lower())
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            words.insert(rng.randrange(len(words) + 1), rng.choice(filler)) if rng.random() < 0.5 else words.pop(rng.randrange(len(words)))
        texts.append(" ".join(rng.choices(filler, k=rng.randrange(30)) + words + rng.choices(filler, k=rng.randrange(30))))
    known = licenses.telling(licenses.TEMPLATES)
    want = []
    for text in texts:
        words, found = text.split(), []
        for t, (_, notice) in enumerate(licenses.TEMPLATES):
            own = re.findall(WORD, notice.lower())
            grams = {}
            for at in range(len(own) - 2):
                grams.setdefault(tuple(own[at : at + 3]), []).append(at)
            lines = {}
            for pos in range(len(words) - 2):
                for at in grams.get(tuple(words[pos : pos + 3]), []):
                    lines.setdefault(pos - at, []).append(pos)
            found += [(t, d, p) for d, p in lines.items()]
        base = {label for label, phrase in licenses.PHRASES.items() if f" {phrase} " in f" {text} "}
        want.append(",".join(sorted({s["label"] for s in licenses.verified(found, known, licenses.LEAST)} | base)))
    assert labels_of(spark, *texts) == want
    assert sum(bool(w) for w in want) >= 25

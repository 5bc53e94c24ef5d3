import math
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import public_tokenizers
import pytest

from cloaklake.llm import language_id, licence_scan, lm_score

from ..conftest import DATA

PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1, 9.0) for i, t, lang in rows], SCHEMA)


def documents(spark, sf="sf0.001"):
    return spark.read.parquet(f"{DATA}/{sf}/documents.parquet")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def base_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    hits = [(i, label) for p, label in licence_scan.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    places = [i for i, _ in hits]
    return len(words), len(hits), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in hits}))


def test_licence_base_on_all_documents(spark):
    df = documents(spark, "sf0.01")
    texts = {r.doc_id: r.text for r in df.collect()}
    rows = licence_scan.scan_licences(df).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_scan(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1
        if "CC BY-NC 4.0" in (texts[r.doc_id] or ""):
            assert "cc-by-nc-4.0" in r.labels


LICENCES = [
    ("x " * 50 + "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", {"mit"}),
    ("Licensed under the Apache License, Version 2.0 (the \"License\")", {"apache", "apache-2.0"}),
    ("the apache license of version unknown", {"apache"}),
    ("MIT license, MIT LICENSE", {"mit"}),
    ("This is licensed under CC BY 4.0.", {"cc-by-4.0"}),
    ("licensed under by the way 4 0 cc", set()),
    ("Mozilla Public License Version 2.0", {"mpl", "mpl-2.0"}),
    ("Licensed under the GNU Lesser General Public License v2.1", {"gpl", "lgpl", "lgpl-2.1"}),
    ("# SPDX-License-Identifier: Apache-2.0", {"apache-2.0"}),
    ("// SPDX-License-Identifier: MIT\nint x;", {"mit"}),
    ("This work is licensed under the GNU General Public License, version 3.", {"gpl", "gpl-3.0"}),
    ("CC BY-NC-SA 4.0 and, " + "more words " * 500 + " distributed under the Mozilla Public License, v. 2.0", {"cc-by-nc-sa-4.0", "mpl", "mpl-2.0"}),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: neither the name nor x may be used to endorse or promote products derived from this software without specific prior written permission", {"bsd", "bsd-3-clause"}),
    ("the terms of the license of the public of mozilla", set()),
    ("", set()), (None, set()), ("license " * 20000, set()), ("İ MIT license", {"mit"}),
]


def standing(words, template, slack, anchored):
    """Whether all key phrases stand within slack words of where they should: of the place of one of them, or of any place."""
    where = [(p, {i for i, x in enumerate(words) if x == w[0] and words[i : i + len(w)] == w}) for p, w in template]
    if not all(at for _, at in where):
        return False
    free = 0 if anchored else slack
    places = {i - p + d for p, at in where for i in at for d in range(-free, free + 1)}
    return any(all(any(o + p + d in at for d in range(-slack, slack + 1)) for p, at in where) for o in places)


def test_licence_labels_against_brute_force(spark):
    rnd = random.Random(6)
    made = licence_scan.licence_texts.templates()
    phrases = [(x[0], [(p, [w.decode() for w in words]) for p, _, words in licence_scan.Template(*x).phrases]) for x in made]
    rows = [(i, r.text) for i, r in enumerate(documents(spark).collect())]
    for n in range(300):
        words = licence_scan.plain_words(rnd.choice(made)[1])
        for _ in range(rnd.randrange(3)):
            at = rnd.randrange(len(words) + 1)
            words[at : at + rnd.randrange(2)] = [rnd.choice(["the", "license", "xyz", "public"])] * rnd.randrange(3)
        rows.append((1000 + n, " ".join(["so"] * rnd.randrange(5) + words + ["software", "sublicense"])))
    got = {r.doc_id: set(filter(None, r.labels.split(","))) for r in licence_scan.scan_licences(frame(spark, [(i, t, None) for i, t in rows])).collect()}
    found = 0
    for i, t in rows:
        words = licence_scan.plain_words(t or "")
        base = set(filter(None, base_scan(t)[4].split(",")))
        most = base | {x for x, own in phrases if standing(words, own, 2, False)}
        # a key phrase that is the template's only one is its own place
        least = base | {x for x, own in phrases if len(own) == 1 and standing(words, own, 2, True)}
        assert least <= got[i] <= most, (t, got[i], least, most)
        found += len(got[i])
    assert found > 250


def counted(sample, longest=5):
    """Counts of words (0) and of framed n-grams, by language."""
    tables = {}
    for text, lang in sample:
        for w in re.findall(r"[0-9a-z\x80-\U0010ffff]+", lower(text)):
            if not re.search(r"[a-z\x80-\U0010ffff]", w):
                continue
            framed = f"^{w}$"
            for n, keys in [(0, [w]), *((n, [framed[i : i + n] for i in range(len(framed) - n + 1)]) for n in range(1, longest + 1))]:
                for k in keys:
                    tables.setdefault(n, Counter())[k, lang] += 1
    return tables


def test_language_scores_against_brute_force(spark):
    rows = documents(spark).collect()
    train = [(r.text, r.lang) for r in rows if r.lang and zlib.crc32(str(r.doc_id).encode()) % 5]
    sizes = Counter(lang for _, lang in train)
    langs = sorted(sizes, key=lambda x: (-sizes[x], x))
    tables = counted(train)
    keys = {n: {k for k, _ in t} for n, t in tables.items()}
    total = {n: {x: sum(c for (_, lang), c in t.items() if lang == x) for x in langs} for n, t in tables.items()}
    score = lambda n, k, x: math.log((tables[n][k, x] + 0.5) / (total[n][x] + 0.5 * (len(keys[n]) + 1)))

    def predicted(text):
        if not any(c.isalpha() for c in text or ""):
            return "und", 0.0
        sums = {x: math.log(sizes[x] / sum(sizes.values())) for x in langs}
        for w in re.findall(r"[0-9a-z\x80-\U0010ffff]+", lower(text)):
            if not re.search(r"[a-z\x80-\U0010ffff]", w):
                continue
            framed = f"^{w}$"
            for n in (0, 5, 4, 3, 2, 1):
                known = [k for k in ([w] if n == 0 else [framed[i : i + n] for i in range(len(framed) - n + 1)]) if k in keys[n]]
                if known:
                    for x in langs:
                        sums[x] += sum(score(n, k, x) for k in known)
                    break
        top = max(sums.values())
        best = next(x for x in langs if sums[x] == top)
        return best, 1 / sum(math.exp(v - top) for v in sums.values())

    extra = [(9001, "Zwölfkämpfer xqzv über", None), (9002, "12 34", None), (9003, None, "en"), (9004, "a", None)]
    df = documents(spark).select("doc_id", "text", "lang").unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string"))
    model = language_id.learn(documents(spark), sample_docs=10**6)  # all rows that aren't held out
    got = {r.doc_id: r for r in language_id.identify(df, model).collect()}
    for i, t, _ in [(r.doc_id, r.text, r.lang) for r in rows] + extra:
        want, share = predicted(t)
        assert got[i].lang_pred == want and got[i].score == pytest.approx(share, abs=1e-6), (i, t)


def test_licence_labels(spark):
    df = frame(spark, [(i, t, None) for i, (t, _) in enumerate(LICENCES)])
    for r in licence_scan.scan_licences(df).collect():
        text, want = LICENCES[r.doc_id]
        assert set(filter(None, r.labels.split(","))) == want, text
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_scan(text)
    assert licence_scan.scan_licences(df.limit(0)).count() == 0


def test_licence_names_as_they_are_usually_written(spark):
    cases = [
        ("Licensed under the BSD 3-Clause License", {"bsd-3-clause"}), ("GPLv3", {"gpl-3.0"}), ("GNU GPL v3 or later", {"gpl-3.0"}), ("Creative Commons Attribution 4.0 International License", {"cc-by-4.0"}), ("license: MIT", {"mit"}),
        ("ISC License", {"isc"}), ("The Unlicense", {"unlicense"}), ("SPDX-License-Identifier: (MIT OR Apache-2.0)", {"mit", "apache-2.0"}), ("Creative Commons Attribution-ShareAlike 3.0", {"cc-by-sa-3.0"}), ("Apache-2.0 OR MIT", {"apache-2.0", "mit"}),
        ("wir gehen mit dem Hund", set()), ("attribution of 4 authors", set()), ("the 3 clauses of the treaty", set()),
    ]
    got = {r.doc_id: set(filter(None, r.labels.split(","))) for r in licence_scan.scan_licences(frame(spark, [(i, t, None) for i, (t, _) in enumerate(cases)])).collect()}
    for i, (text, want) in enumerate(cases):
        assert want <= got[i] and (want or not got[i]), (text, got[i])


def test_language_held_out_accuracy(spark):
    df = documents(spark, "sf0.01")
    rows = language_id.language_id(df).join(df.select("doc_id", "lang"), "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97


def test_language_sample_is_bounded_and_never_empty(spark):
    """Whatever doc_ids repeat: at most so many rows of each language, some wherever there are any, long texts in pieces."""
    rows = [(7, "the same row again", "en")] * 3000 + [(8, f"zeile nummer {i} mit worten", "de") for i in range(2000)] + [(9, "une seule ligne", "fr"), (11, "lang " * 100_000, "de")]
    df = frame(spark, rows)
    taken = language_id.sampled(df.select("lang", "doc_id", "text"), 500, 1000).collect()
    count = {k: sum(r.lang == k for r in taken) for k in ("en", "de", "fr")}
    assert count == {"en": 500, "de": 500, "fr": 1} and max(len(r.text) for r in taken) <= 1000
    model = language_id.learn(df, sample_docs=20, sample_bytes=5000)
    assert sorted(model.languages) == ["de", "en", "fr"] and all(len(t[0]) for t in model.tables.values())
    assert language_id.learn(df, max_languages=2).languages == ["en", "de"]


def test_language_edges(spark):
    rows = [(i, "the cat and the dog are here", "en") for i in range(20)] + [(i, "der hund und die katze sind hier", "de") for i in range(20, 40)]
    rows += [(100, None, "en"), (101, "", "de"), (102, "1234 %%% 5", "en"), (103, "THE CAT", None), (104, "Katzen Hundes", None), (105, "中文", None), (106, "— …", None), (None, "und die", "de"), (103, "THE CAT", None)]
    got = {r.doc_id: r for r in language_id.language_id(frame(spark, rows)).collect()}
    assert [got[i].lang_pred for i in (100, 101, 102, 103, 104, 106, None)] == ["und", "und", "und", "en", "de", "und", "de"]
    assert got[105].lang_pred in ("en", "de") and got[None].held_out is False and got[100].score == 0
    assert language_id.language_id(frame(spark, rows)).count() == len(rows)
    assert {r.lang_pred for r in language_id.language_id(frame(spark, [(1, "no label", None)])).collect()} == {"und"}
    assert language_id.language_id(frame(spark, [])).count() == 0


def test_marginal_sums_over_all_segmentations():
    import numpy as np

    p = lm_score.Pieces(PIECES)
    p.weigh(np.arange(p.size + 1) % 97)

    def brute(s):
        @lru_cache(None)
        def rest(i):
            if i == len(s):
                return 1.0
            ways = [math.exp(p.weight[s[i:j]]) * rest(j) for j in range(i + 1, len(s) + 1) if s[i:j] in p.weight]
            return sum(ways) + (0 if s[i] in p.weight else math.exp(sum(p.byte[b] for b in s[i].encode())) * rest(i + 1))

        return math.log(rest(0))

    for w in ["thlyouble", "a", "é", "𝒳y", "zzzzzz", "naïve"]:
        assert brute(p.MARK + w) == pytest.approx(p.marginal(w), abs=1e-9)
    assert math.isfinite(p.marginal("x" * 50_000))


@pytest.mark.parametrize("broadcast_words", [0, 50, 1 << 19])
def test_lm_base_and_marginal(spark, broadcast_words):
    import numpy as np

    df = documents(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()] + [(10_000, None), (10_001, ""), (10_002, "tie tie"), (10_002, "tie tie"), (None, "no id ﻿")]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, score string")
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    words = [re.findall(r"[^\x20\x09-\x0D]+", lower(t)) for _, t in rows]
    count = Counter(w for ws, h in zip(words, held, strict=True) if not h for w in [*ws, None])
    n, v = sum(count.values()), len(count)
    got = sorted(map(tuple, lm_score.score_documents(df, PIECES, broadcast_words=broadcast_words).collect()), key=str)
    want, p = [], lm_score.Pieces(PIECES)
    pieces = np.zeros(p.size + 1)
    for w, c in count.items():
        pieces[p.end if w is None else p.model.encode(w)] += 0
        for k in [p.end] if w is None else p.model.encode(w):
            pieces[k] += c
    p.weigh(pieces)
    for (i, _), ws, h in zip(rows, words, held, strict=True):
        tokens = [*ws, None]
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens)
        model = (sum(map(p.marginal, ws)) + p.end_weight) / math.log(10)
        want.append((i, h, len(tokens), sum(count[w] > 0 for w in tokens), n, base, model))
    for a, b in zip(got, sorted(want, key=str), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_lm_empty(spark):
    assert lm_score.score_documents(frame(spark, []), PIECES).count() == 0

"""Collocations against a count of every phrase, and their defined cases."""

import re
from collections import Counter

import numpy as np

from helixlake.llm import collocations as col
from helixlake.llm.shingles import U

DOCS = "lang string, text string, doc_id long, n long, score string, phrase int"


def frame(spark, rows):
    return spark.createDataFrame([(lang, t, 1, 2, "x", 3) for lang, t in rows], DOCS)


def brute(rows, least, top):
    f, total = Counter(), Counter()
    for lang, t in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(rb"[.,;:!?\x0a-\x0d]", (t or "").encode().lower()):
            w = [x for x in re.split(rb"[\x20\x09]", piece) if x]
            total[lang] += len(w)
            f.update((lang, tuple(w[k : k + n])) for n in range(1, 6) for k in range(len(w) - n + 1))
    out = []
    for lang in total:
        found = {p: n for (own, p), n in f.items() if own == lang and n >= least}
        inside = Counter()
        for p, n in found.items():
            for m in range(2, len(p)):
                for k in range(len(p) - m + 1):
                    inside[p[k : k + m]] = max(inside[p[k : k + m]], n)
        rows = []
        for p, a in found.items():
            if len(p) > 1 and not 100 * inside[p] >= 100 * a:
                score, k = min((1000 * a * total[lang] // (found[p[:k]] * found[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, b" ".join(p), found[p[:k]], found[p[k:]]))
        out += [(lang, k, p.decode(), -a, left, right, total[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def test_collocations_of_the_whole_table_at_a_lower_count(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("lang", "text").collect()]
    got = sorted(tuple(r) for r in col.collocations(docs, least=12, top=300).collect())
    assert got == brute(rows, 12, 300) and len({r[0] for r in got}) == 4


def test_defined_cases(spark):
    rows = [(None, "New York is new york. NEW\tYORK, new\nyork"), ("und", "new york"), ("en", None), ("en", ""), ("fr", "a b a b a b a b"), ("fr", "a b a b a b a b"), ("", "é\x00 ß é\x00 ß"), ("de", " \x1c x\x1c \x85 ,,")]
    rows += [("en", "one two three four five six. " * 9), ("en", "one two three four. " * 2), ("es", "x y, x y, y x, y x, x z, z y")]
    for least, top in ((2, 2000), (1, 3), (9, 5)):
        assert sorted(tuple(r) for r in col.collocations(frame(spark, rows), least, top).collect()) == brute(rows, least, top)
    assert col.collocations(frame(spark, [])).count() == 0
    want = brute(rows, 2, 2000)  # below, nearly everything passes the filter: slower, and the same
    with_full_filter = col.frequent_phrases(frame(spark, rows), 2, bits=64)
    assert sorted(tuple(r) for r in col._ranked(with_full_filter, 2000).collect()) == want


def test_one_very_long_text(spark):
    rows = [("en", " ".join(f"w{k % 97} v{k % 13}" for k in range(200_000))), ("en", "w1 v1")]
    assert sorted(tuple(r) for r in col.collocations(frame(spark, rows), 100, 50).collect()) == brute(rows, 100, 50)


def test_colliding_fingerprints_fall_apart(spark):
    hashes = col.Hashes()
    hashes.clear()
    w = col.Words([("en", "a b a b c a b c c")], hashes, keep=True)
    places = list(col._verified(w, np.arange(8), np.zeros(8, U), 2))
    assert sorted(tuple(w.words[p : p + 2]) for p in places) == sorted({(x, y) for x, y in zip(w.words, w.words[1:])})
    # A fingerprint whose sum isn't that of its one phrase, as if another phrase shared it, is counted by words.
    docs = frame(spark, [("en", "x y z. " * 7), ("fr", "x y. " * 3)])
    made = col.frequent_phrases(docs, 2)
    want = sorted(map(tuple, made.where("words > 0").collect()))
    w = col.Words([("en", "x y")], hashes, keep=True)
    at, prints = w.runs(2)
    odd = spark.createDataFrame([(int(prints.view(np.int64)[0]), 1, 99, 5, 4, "en", 2, "x y")], "print long, place long, n long, check long, own long, lang string, words int, phrase string")
    assert [tuple(r) for r in col._settled(docs, odd, 2, 5, col.FILTER_BITS).collect()] == [("en", 2, "x y", 7)] and ("en", 2, "x y", 7) in want

"""The n-gram join against brute force: whole table, groups, thresholds, scarce ranges, long texts."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixlake.llm import ngram_join as join
from helixlake.llm import queries
from helixlake.llm.shingles import U, mixed, words
from tests.llm.test_pairs import brute_components, frame


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_join_of_the_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert found(queries.op11_ngram_join(spark, sf_dir)) == brute_components(rows, 80)


def texts(seed, groups, size):
    """Groups around one text each, with edits that leave pairs on both sides of the threshold, and passages of others."""
    draw = random.Random(seed)
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for g in range(groups):
        n = draw.choice([6, 12, 30, 60, 66, 100, 130, 260, 300])
        base = [f"g{g}_{k}" for k in range(n)]
        for _ in range(size):
            own = list(base)
            for _ in range(draw.choice([0, 1, 1, 2, 3, max(1, n // 40), max(1, n // 25)])):
                own[draw.randrange(len(own))] = f"e{draw.random()}"
            if draw.random() < 0.2:
                own = own[: -draw.randrange(1, max(2, n // 6))]
            if draw.random() < 0.3:
                own += passage[: draw.choice([20, 60])]
            rows.append((len(rows), " ".join(own)))
    return rows


def test_groups_with_passages(spark):
    rows = texts(1, 40, 25)
    assert found(join.similar_documents(frame(spark, rows))) == brute_components(rows, 80)


def test_small_blocks_and_scarce_ranges_give_the_same(spark, monkeypatch):
    rows = texts(2, 12, 20)
    want = brute_components(rows, 80)
    monkeypatch.setattr(join, "BLOCK", 3)
    monkeypatch.setattr(join, "SET_BLOCK", 2)
    assert found(join.similar_documents(frame(spark, rows))) == want
    docs = frame(spark, rows)
    classes = join.sketches(docs, 80).select(F.col("doc_id").alias("rep"), "n_shingles")
    scarce = classes.where("rep % 3 = 0").select("rep")
    tiles = [tuple(r) for r in join.tiles(docs, classes, scarce, 80).collect()]
    by = {}
    for t, rep in tiles:
        by.setdefault(rep, set()).add(t)
    sets = {i: set(join.shingle_set(join.word_hashes(t.encode()), 5).tolist()) for i, t in rows}
    for i in sets:
        for j in sets:
            if i % 3 == 0 and sets[i] & sets[j]:
                assert len(by[i] & by[j]) >= len(sets[i] & sets[j])


def test_chain_and_defined_cases(spark):
    base = [f"w{k}" for k in range(200)]
    rows = [(10 + k, " ".join(f"x_{j}" if j < 4 * k else w for j, w in enumerate(base))) for k in range(12)]
    rows += [(1, None), (2, ""), (3, "one two"), (4, "ONE\ttwo"), (5, "one two three"), (6, " \n "), (30, "a b c d e f g h i"), (31, "a b c d e f g h"), (32, "a b c d e f g"), (33, "é ß 日本 x y z"), (34, "É ß 日本 x y z")]
    got = found(join.similar_documents(frame(spark, rows)))
    assert got == brute_components(rows, 80)
    assert got[21][1] == 10 and got[31][1] == 30 and got[32][1] == 32 and got[4] == (1, 3)  # 4 of 5 is linked, 3 of 4 isn't
    odd = join.similar_documents(frame(spark, [(None, "one two three"), (7, "one two three"), (7, "one two three"), (8, "one two three")]))
    assert sorted(map(tuple, odd.collect()), key=str) == [(7, 1, 7), (7, 1, 7), (8, 1, 7), (None, 1, None)]
    assert join.similar_documents(frame(spark, [])).count() == 0


def test_very_long_texts(spark):
    long = " ".join(f"word{k}" for k in range(300_000))
    rows = [(1, long), (2, long + " end"), (3, long[: len(long) * 85 // 100]), (4, long[: len(long) * 60 // 100]), (5, "x" * 3_000_000)]
    got = found(join.similar_documents(frame(spark, rows)))
    assert got == brute_components(rows, 80) and {i: c for i, (_, c) in got.items()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 10**6))
def test_similar_sets_share_a_tile(n, seed):
    draw = np.random.default_rng(seed)
    pool = mixed(draw.integers(0, 1 << 62, 2 * n + 8).astype(U))
    differ = (100 - join.PERCENT) * n // join.PERCENT  # as many as a similar pair can differ in
    gone = int(draw.integers(0, differ // 2 + 1)) if n > 8 else 0
    a = np.unique(pool[:n])
    both = n - gone
    most = (100 * both - join.PERCENT * n) // join.PERCENT
    b = np.unique(np.concatenate([a[draw.permutation(len(a))[:both]], pool[n : n + int(draw.integers(0, max(0, most) + 1))]]))
    common = len(np.intersect1d(a, b))
    if 100 * common >= join.PERCENT * (len(a) + len(b) - common):
        (x, enough_a), (y, enough_b) = join.tile_keys(a), join.tile_keys(b)
        assert not enough_a or not enough_b or len(np.intersect1d(x, y))
        apart = int(np.bitwise_count(join._folded(join.bitmap(a), 2) ^ join._folded(join.bitmap(b), 2)).sum())
        assert apart <= len(a) + len(b) - 2 * common


def test_written_ranges_never_fall_with_the_set():
    for band in range(6, 16):
        sizes = range((80 << band) // 100, 2 << band)
        upto = [join.written(n, band) for n in sizes]
        assert upto == sorted(upto) and all(u <= join.ranges(band, 80) for u in upto)
        assert all(u > 20 * n / 80 for n, u in zip(sizes, upto))


@given(st.text(st.characters(codec="utf-8", exclude_characters="\0"), max_size=80))
def test_word_hashes_follow_words(text):
    raw = text.encode()
    own = words(raw)
    hashes = join.word_hashes(raw)
    assert len(hashes) == len(own) and len(set(hashes.tolist())) == len(set(own))
    assert all((hashes == h).sum() == own.count(w) for h, w in zip(hashes, own))

"""GC by each base's own window against loops over bases, and what a job takes from it."""

import random

import pytest
from pyspark.sql import functions as F

from helixlake.operators.composition import base_gc, expected_depth, gc_profile, rate_at

LENGTHS = {"a": 1_733, "b": 400, "c": 57}


def loop_gc(text, at):
    window = text[at : at + 100]
    return int(100 * sum(x in "GC" for x in window) / len(window) + 0.5)


@pytest.fixture(scope="module")
def world():
    draw = random.Random(11)
    weights = lambda k: [1 + k // 300, 1, 2, 1, 0.05]
    reference = {c: "".join(draw.choices("ACGTN", weights(k))[0] for k in range(n)) for c, n in LENGTHS.items()}
    reference["b"] = "A" * 150 + reference["b"][150:]  # windows without G and C
    depth = [(s, c, p, draw.randint(1, 4)) for s in "xy" for c, n in LENGTHS.items() for p in sorted(draw.sample(range(n + 20), n // 3)) if (s, c) != ("y", "b")]
    return reference, depth


@pytest.mark.parametrize("width", [32, 64, 100, 1000])
def test_equals_a_loop_over_bases(spark, world, width):
    reference, depth = world
    pages = spark.createDataFrame([(c, k, t[k : k + width]) for c, t in reference.items() for k in range(0, len(t), width)], "chrom string, start_pos int, seq string").repartition(3)
    track = base_gc(pages, width).cache()
    gc = {c: [loop_gc(t, k) for k in range(len(t))] for c, t in reference.items()}
    got = {(r.chrom, r.page * width + k): v for r in track.collect() for k, v in enumerate(r.gc)}
    assert got == {(c, k): v for c, values in gc.items() for k, v in enumerate(values)}

    frame = spark.createDataFrame(depth, "sample string, chrom string, pos int, n long")
    profile = gc_profile(frame, track, width).cache()
    want = {}
    for s, c in {(d[0], d[1]) for d in depth}:
        for v in set(gc[c]):
            total = sum(n for s2, c2, p, n in depth if (s2, c2) == (s, c) and p < len(gc[c]) and gc[c][p] == v)
            want[s, c, v] = 0.0 if v == 0 else total / gc[c].count(v)
    rates = {(r.sample, r.chrom, r.gc): r.mean_rd for r in profile.collect()}
    assert rates == pytest.approx(want)

    draw = random.Random(width)
    spans = [(k, c, *sorted(draw.sample(range(LENGTHS[c] + 90), 2))) for k, c in enumerate(draw.choices("abc", k=60))]
    spans += [(60, "a", 0, 1_733), (61, "a", 64, 128), (62, "a", 100, 100), (63, "b", 0, 5_000), (64, "nowhere", 0, 10)]
    made = expected_depth(spark.createDataFrame(spans, "span_id long, chrom string, start_pos int, end_pos int"), profile, track, width)
    found = {(r.span_id, r.sample): r.expected_rd for r in made.collect()}
    for k, c, start, end in spans:
        for s in "xy":
            loop = sum(rates.get((s, c, v), 0.0) for v in gc.get(c, [])[start:end])
            assert found.get((k, s), 0.0) == pytest.approx(loop, abs=2e-6), (k, c, start, end, s)

    places = spark.createDataFrame([(c, c, k) for c in "abc" for k in (0, 31, 56, 399, 1_732, 9_999)], "cluster_id string, chrom string, breakpoint int")
    at = {(r.chrom, r.breakpoint, r.sample): r.mean_rd for r in rate_at(places, profile, track, width).collect()}
    assert at == {(c, k, s): rates[s, c, gc[c][k]] for c in "abc" for k in (0, 31, 56, 399, 1_732) if k < len(gc[c]) for s in "xy" if (s, c) != ("y", "b")}


def test_empty_reference_and_spans(spark):
    pages = spark.createDataFrame([], "chrom string, start_pos int, seq string")
    track = base_gc(pages)
    assert track.count() == 0
    depth = spark.createDataFrame([("x", "a", 5, 1)], "sample string, chrom string, pos int, n long")
    profile = gc_profile(depth, track)
    assert profile.count() == 0
    spans = spark.createDataFrame([(1, "a", 0, 10)], "span_id long, chrom string, start_pos int, end_pos int")
    assert expected_depth(spans, profile, track).agg(F.sum("expected_rd")).first()[0] is None

"""Every variant query against its SQL on the smallest tables, and kernels against brute force."""

import itertools
import math
import os
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helixlake.jobs import ORACLE_SQL, QUERIES
from helixlake.operators.clusters import sweep
from helixlake.operators.ranges import islands, overlap_filter, overlap_join
from helixlake.constants import INFINITE_SCORE
from helixlake.operators.scoring import Candidate, clash, greedy_cover, pair_score
from tests.conftest import TINY


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(TINY):
        con.sql(f"create view {f.split('.')[0]} as select * from '{TINY}/{f}'")
    return con


def plain(value):
    return round(value, 5) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, str(TINY))
    want = duck.sql(ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in got.collect())
    assert rows == Counter(tuple(plain(r[k]) for k in at) for r in want.fetchall())
    assert rows


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, str(TINY)).count() > 0


def brute_sets(rows, both):
    """All sets active and overlapping at some arrival, from every right breakpoint that is an end of an interval."""
    found = set()
    for b in {r[1] for r in rows}:
        spans = {r[0]: tuple(min(max(v + r[5] * b, r[6]), r[7]) for v in r[3:5]) for r in rows if r[1] <= b < r[2]}
        for at in {x for s in spans.values() for x in s}:
            found.add(frozenset(k for k, (lo, hi) in spans.items() if lo <= at <= hi))
    side = {r[0]: r[8] for r in rows}
    found = {s for s in found if s and (not both or len({side[x] for x in s}) > 1)}
    return {s for s in found if not any(s < t for t in found)}


shape = st.tuples(st.integers(0, 30), st.integers(1, 20), st.integers(0, 60), st.integers(0, 15), st.sampled_from([-1, 0, 1]), st.sampled_from("FR"))


@settings(max_examples=150, deadline=None)
@given(st.lists(shape, max_size=9), st.booleans())
def test_sweep_finds_the_maximal_sets(shapes, both):
    rows = [(k, a, a + n, lo, lo + w, slope, 0, 200, side) for k, (a, n, lo, w, slope, side) in enumerate(shapes)]
    got = [frozenset(s) for _, s in sweep(rows, both)]
    assert len(got) == len(set(got))
    assert set(got) == brute_sets(rows, both)


def brute_sets_anywhere(rows, both):
    """All sets active and overlapping at some left breakpoint from start to stop."""
    found = set()
    for b in range(min((r[1] for r in rows), default=0), max((r[2] for r in rows), default=0)):
        spans = {r[0]: tuple(min(max(v + r[5] * b, r[6]), r[7]) for v in r[3:5]) for r in rows if r[1] <= b < r[2]}
        for at in {x for s in spans.values() for x in s}:
            found.add(frozenset(k for k, (lo, hi) in spans.items() if lo <= at <= hi))
    side = {r[0]: r[8] for r in rows}
    found = {s for s in found if s and (not both or len({side[x] for x in s}) > 1)}
    return {s for s in found if not any(s < t for t in found)}


clipped = st.tuples(st.integers(0, 30), st.integers(1, 20), st.integers(0, 60), st.integers(0, 15), st.sampled_from([-1, 0, 1]), st.integers(0, 40), st.integers(0, 40), st.sampled_from("FR"))


@settings(max_examples=300, deadline=None)
@given(st.lists(clipped, max_size=9), st.booleans())
def test_sweep_between_arrivals_finds_the_maximal_sets(shapes, both):
    rows = [(k, a, a + n, lo, lo + w, slope, least, least + room, side) for k, (a, n, lo, w, slope, least, room, side) in enumerate(shapes)]
    got = [frozenset(s) for _, s in sweep(rows, both, between=True)]
    assert len(got) == len(set(got))
    assert set(got) == brute_sets_anywhere(rows, both)


def brute_pairs_anywhere(rows):
    """Unions of a set of either side that are active at some left breakpoint, each overlapping at a place of its own."""
    found = set()
    for b in range(min((r[1] for r in rows), default=0), max((r[2] for r in rows), default=0)):
        sets = {"F": set(), "R": set()}
        for side, own in sets.items():
            spans = {r[0]: tuple(min(max(v + r[5] * b, r[6]), r[7]) for v in r[3:5]) for r in rows if r[8] == side and r[1] <= b < r[2]}
            own |= {frozenset(k for k, (lo, hi) in spans.items() if lo <= at <= hi) for s in spans.values() for at in s}
        found |= {x | y for x in sets["F"] for y in sets["R"] if x and y}
    return {s for s in found if not any(s < t for t in found)}


@settings(max_examples=200, deadline=None)
@given(st.lists(clipped, max_size=8))
def test_paired_sweep_finds_the_maximal_pairs(shapes):
    rows = [(k, a, a + n, lo, lo + w, slope, least, least + room, side) for k, (a, n, lo, w, slope, least, room, side) in enumerate(shapes)]
    got = [frozenset(s) for _, s in sweep(rows, False, between=True, paired=True)]
    assert len(got) == len(set(got))
    assert set(got) == brute_pairs_anywhere(rows)


def duplication_spans(row, to):
    """For each left breakpoint that a row of evidence allows, the right breakpoints that it allows there, position by
    position: (side, {b: (low, high)}). A copy to the right is one to the left after mirroring about 0."""
    _, _, kind, ls, le, lo, rs, re, ro, least, most = row
    start, end = le if lo == "F" else ls, re if ro == "F" else rs
    floor = 0
    if to == "RIGHT":
        start, end, lo, floor = -end, -start, "R" if lo == "F" else "F", -(1 << 40)
    back = kind == "INVDUP" and lo == "R"
    out = {}
    for b in range(start - most, start + 1) if back else range(start + 1, start + most + 1):
        far = abs(b - start)
        ends = (max(least - far, 0), most - far)
        if to == "RIGHT" or b >= 1:
            ahead = kind == "INVDUP" and not back
            out[b] = (end + ends[0], end + ends[1]) if ahead else (max(floor, end - ends[1]), max(floor, end - ends[0]))
    return lo, out


def test_duplication_shapes_allow_what_their_rows_do(spark):
    from helixlake.operators import clusters

    ends = [(3, 12, 40, 49), (50, 59, 90, 99), (20, 29, 22, 31)]
    rows = [(k, "c", kind, ls, le, o[0], rs, re, o[1], 4, 11) for k, ((ls, le, rs, re), (kind, o)) in enumerate((x, y) for x in ends for y in (("INTERDUP", "FR"), ("INTERDUP", "RF"), ("INVDUP", "FF"), ("INVDUP", "RR")))]
    df = spark.createDataFrame(rows, "ev_id long, chrom string, sv_type string, l_start int, l_end int, l_or string, r_start int, r_end int, r_or string, min_delta int, max_delta int")
    got = clusters.duplication_shapes(df).collect()
    assert len(got) == 2 * len(rows)
    for r in got:
        side, spans = duplication_spans(rows[r.ev_id], r.sv_type.split("_")[1])
        clip = lambda v, b, r=r: min(max(v + r.slope * b, r.least), r.most)
        assert (r.side, {b: (clip(r.low, b), clip(r.high, b)) for b in range(r.start, r.stop)}) == (side, spans)


def test_duplication_needs_both_strands(spark):
    from helixlake.operators import clusters

    # Two FR and two RF pairs around one place; a third FR pair whose mate lies elsewhere; FF and RR pairs alone.
    rows = [
        (1, "c", "INTERDUP", 901, 1000, "F", 5000, 5099, "R", 119, 327), (2, "c", "INTERDUP", 911, 1010, "F", 5015, 5114, "R", 119, 327),
        (3, "c", "INTERDUP", 1020, 1119, "R", 7001, 7100, "F", 119, 327), (4, "c", "INTERDUP", 1040, 1139, "R", 7021, 7120, "F", 119, 327),
        (5, "c", "INTERDUP", 921, 1020, "F", 9000, 9099, "R", 119, 327), (6, "d", "INVDUP", 901, 1000, "F", 5000, 5099, "F", 119, 327),
    ]
    df = spark.createDataFrame(rows, "ev_id long, chrom string, sv_type string, l_start int, l_end int, l_or string, r_start int, r_end int, r_or string, min_delta int, max_delta int")
    found = clusters.duplications(df).where("sv_type = 'INTERDUP_LEFT'").groupBy("cluster_id").agg({"ev_id": "collect_set"}).collect()
    assert sorted(sorted(r[1]) for r in found) == [[1, 2, 3, 4], [3, 4, 5]]


def test_inversion_that_begins_between_arrivals(spark):
    from helixlake.operators import clusters

    rows = [(1, "c", "INV", 901, 1000, "F", 4901, 5000, "F", 119, 327), (2, "c", "INV", 1200, 1299, "R", 5050, 5149, "R", 119, 327)]
    df = spark.createDataFrame(rows, "ev_id long, chrom string, sv_type string, l_start int, l_end int, l_or string, r_start int, r_end int, r_or string, min_delta int, max_delta int")
    got = clusters.cluster(clusters.shapes(df), both_sides=True, between=True).collect()
    # F reaches down to 5000 + 119 - (b - 1000), R up to 5050 at most until b = 1081: they meet at 1069.
    assert {(r["ev_id"], r["left_brk"]) for r in got} == {(1, 1069), (2, 1069)}


def test_micro_fixture_of_deletions():
    row = lambda k, le, rs: (k, le, le + 200, rs - le - 200, rs - le, 1, le, rs, "A")
    near = [row(0, 100, 600), row(1, 110, 590), row(2, 120, 610)]
    assert [s for _, s in sweep([*near, row(3, 900, 1500)], False) if len(s) > 1] == [[0, 1, 2]]


def brute_cover(calls, least):
    """Every weight anew in every round."""
    covered, barred, picked = set(), set(), []
    while True:
        best = None
        for c, call in sorted(calls.items()):
            left = {s: own - covered for s, own in call.reads.items()}
            enough = {s: own for s, own in left.items() if (c, s) not in barred and len(own) >= least}
            w = call.score(sum(map(len, left.values()))) if enough else INFINITE_SCORE
            if c not in {p[0] for p in picked} and w < INFINITE_SCORE and (best is None or w < best[0]):
                best = w, c, enough
        if best is None:
            return picked
        w, c, enough = best
        picked.append((c, w, {s: len(own) for s, own in enough.items()}))
        covered |= set().union(*enough.values())
        span = lambda x: (calls[x].kind, calls[x].start, calls[x].end)
        for a, b in itertools.combinations([p for p in picked if clash(span(p[0]), span(c)) or p[0] == c], 2):
            if clash(span(a[0]), span(b[0])):
                barred |= {(k, s) for k in calls for s in a[2].keys() & b[2].keys() if k not in (a[0], b[0]) and clash(span(k), span(a[0])) and clash(span(k), span(b[0]))}


candidate = st.tuples(st.sampled_from(["DEL", "INV", "TDUP", "MEI_F"]), st.integers(0, 40), st.integers(0, 30), st.lists(st.integers(0, 25), max_size=12), st.integers(1, 50))


@settings(max_examples=300, deadline=None)
@given(st.lists(candidate, max_size=7), st.integers(1, 3))
def test_cover_equals_brute_force(rows, least):
    calls = {}
    for k, (kind, start, width, own, cost) in enumerate(rows):
        reads = {s: {f"{x}" for x in own if x % 2 == j} for j, s in enumerate("ab")}
        calls[f"c{k}"] = Candidate(kind, start, start + width, reads, lambda n, cost=cost: cost / n if n else INFINITE_SCORE)
    assert greedy_cover(calls, least) == brute_cover(calls, least)


def test_cover_bars_a_third_clash_and_stops_below_the_least_support():
    made = lambda start, names, cost: Candidate("DEL", start, start + 100, {"s": set(names)}, lambda n: cost)
    calls = {"a": made(0, "12345", 1.0), "b": made(50, "67890", 2.0), "c": made(60, "vwxyz", 3.0), "d": made(500, "vwx", 0.5)}
    assert [p[0] for p in greedy_cover(calls, 5)] == ["a", "b"]


def test_pair_score_equals_the_column(spark):
    from helixlake.operators.scoring import genotype_likelihood

    rows = [(f"k{k}", "s", kind, op, ep, od, ed) for k, (kind, op, ep, od, ed) in enumerate(itertools.product(["DEL", "INV", "TDUP", "INVDUP_LEFT"], [0, 7], [0.0, 9.5], [0, 12], [0.0, 30.25]))]
    df = spark.createDataFrame(rows, "cluster_id string, sample string, sv_type string, op long, ep double, od long, ed double")
    got = {r.cluster_id: r.score for r in genotype_likelihood(df).collect()}
    assert got == {c: pytest.approx(pair_score(kind, False, op, ep, od, ed), rel=1e-9) for c, _, kind, op, ep, od, ed in rows}


def test_binned_joins_equal_nested_loops(spark):
    left = [("c", k, k * 37 % 900, k * 37 % 900 + k % 120) for k in range(120)]
    right = [("c", k, k * 53 % 900, k * 53 % 900 + k % 50) for k in range(60)] + [("d", 1, 0, 999)]
    a = spark.createDataFrame(left, "chrom string, id int, s int, e int")
    b = spark.createDataFrame(right, "chrom string, k int, s int, e int")
    want = {(x[1], y[1]) for x, y in itertools.product(left, right) if x[0] == y[0] and x[2] <= y[3] and y[2] <= x[3]}
    got = [(r["id"], r["r_k"]) for r in overlap_join(a, b, ("s", "e"), ("s", "e"), width=64).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    hit = {x for x, _ in want}
    assert {r["id"] for r in overlap_filter(a, b, ("s", "e"), ("s", "e"), anti=False, width=128).collect()} == hit
    assert {r["id"] for r in overlap_filter(a, b, ("s", "e"), ("s", "e"), anti=True, width=128).collect()} == {x[1] for x in left} - hit


def test_filters_see_spans_between_the_ends(spark):
    """Rows over many bins: also those whose ends lie in bins that right leaves empty."""
    left = [("c", k, k * 7919 % 60_000, k * 7919 % 60_000 + (k * k * 37) % (40 << (k % 11))) for k in range(300)] + [("c", 900, 1000, 50_000), ("d", 901, 0, 5_000_000), ("e", 902, 10, 900_000)]
    right = [("c", 20_000, 20_200), ("c", 40_000, 40_003), ("c", 70_000, 71_000), ("d", 2_500_000, 2_500_001)]
    a = spark.createDataFrame(left, "chrom string, id int, s int, e int")
    b = spark.createDataFrame(right, "chrom string, s int, e int")
    hit = {x[1] for x in left if any(x[0] == c and x[2] <= e and s <= x[3] for c, s, e in right)}
    assert {900, 901} < hit and 902 not in hit
    for width in (64, 5_000):
        kept = [r["id"] for r in overlap_filter(a, b, ("s", "e"), ("s", "e"), anti=False, width=width).collect()]
        assert len(kept) == len(set(kept)) and set(kept) == hit
        assert {r["id"] for r in overlap_filter(a, b, ("s", "e"), ("s", "e"), anti=True, width=width).collect()} == {x[1] for x in left} - hit


def test_islands_across_tiles(spark):
    rows = [("c", 0, 5), ("c", 4, 30), ("c", 29, 31), ("c", 31, 33), ("c", 50, 51), ("c", 7, 8), ("d", 2, 90), ("d", 89, 95), ("d", 95, 96)]
    df = spark.createDataFrame(rows, "chrom string, s int, e int")
    got = {(r["chrom"], r["s"]): r["island"] for r in islands(df, ["chrom"], "s", "e", tile=10).collect()}
    assert got == {("c", 0): 0, ("c", 4): 0, ("c", 7): 0, ("c", 29): 0, ("c", 31): 31, ("c", 50): 50, ("d", 2): 2, ("d", 89): 2, ("d", 95): 95}


def test_special_functions(spark):
    from pyspark.sql import functions as F

    from helixlake.functions.likelihood import erf, lgamma, log_factorial

    df = spark.createDataFrame([(float(k), k) for k in (0, 1, 2, 3, 100, 256, 257, 5000)], "x double, n int")
    for r in df.select("x", erf(F.col("x")).alias("e"), lgamma(F.col("x") + 1).alias("g"), log_factorial(F.col("n")).alias("f")).collect():
        assert r.e == math.erf(r.x) and r.g == math.lgamma(r.x + 1)
        assert r.f == pytest.approx(r.g, rel=1e-11, abs=1e-11)


def test_variant_files(spark, tmp_path):
    from helixlake.operators import vcf

    own = "array(named_struct('sample', 's2', 'gt', '1/1', 'score', 0.5D, 'rp', 7L, 'sr', 1L), named_struct('sample', 's1', 'gt', '0/0', 'score', 0.25D, 'rp', 0L, 'sr', 0L)) as samples"
    rows = [("k1", "chr2", "DEL", 109, 99, 400, 420, 7, False), ("k2", "chr1", "INV", 9, 5, 40, 44, 0, True)]
    calls = spark.createDataFrame(rows, "cluster_id string, chrom string, sv_type string, inner_start int, outer_start int, inner_end int, outer_end int, rp int, precise boolean")
    calls = calls.selectExpr("*", "0 as sr", "cast(null as string) as element", "cast(null as int) as element_length", "false as filtered", "'A' as ref", own)
    vcf.write(vcf.records(calls), {"chr1": 1000, "chr2": 1000}, ["s1", "s2"], str(tmp_path / "calls"))
    lines = [line for f in sorted((tmp_path / "calls").glob("part-*")) for line in f.read_text().splitlines()]
    assert lines[0] == "##fileformat=VCFv4.3" and [x for x in lines if x.startswith("#CHROM")] == [lines[-3]] and lines[-3].endswith("FORMAT\ts1\ts2")
    samples = "GT:CNVL:RP:SR\t0/0:0.250000:0:0\t1/1:0.500000:7:1"
    assert lines[-2:] == [
        f"chr1\t6\tsv_inv_k2\tA\t<INV>\t255\tLowQual\tEND=45;SVLEN=32;RPSUP=0;SRSUP=0;CIEND=0,0;CIPOS=0,0;PRECISE;SVTYPE=INV\t{samples}",
        f"chr2\t110\tsv_del_k1\tA\t<DEL>\t255\tPASS\tEND=401;SVLEN=-292;RPSUP=7;SRSUP=0;CIEND=0,20;CIPOS=-10,0;IMPRECISE;SVTYPE=DEL\t{samples}",
    ]


def test_text_readers_over_many_splits(spark, tmp_path):
    """Splits of some hundred bytes: sequences and records go over them."""
    from helixlake.sources import files

    seqs = {"one": "ACGTN" * 301, "two": "ggca" * 5, "three": "T" * 777}
    (tmp_path / "a.fa").write_text("".join(f">{n} text\n" + "".join(s[k : k + 60] + "\n" for k in range(0, len(s), 60)) for n, s in seqs.items()))
    (tmp_path / "b.fa").write_text(">four\nAC\nGT\n\n")
    (tmp_path / "r.fq").write_text("".join(f"@r{k}\nACGT{k % 10}\n+\nIIII{k % 7}\n" for k in range(200)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        pages = files.fasta(spark, str(tmp_path / "a.fa"), str(tmp_path / "b.fa"), width=100)
        got = {}
        for r in sorted(pages.collect(), key=lambda r: (r.chrom, r.start_pos)):
            assert r.start_pos == len(got.get(r.chrom, ""))
            got[r.chrom] = got.get(r.chrom, "") + r.seq
        assert got == {**{n: s.upper() for n, s in seqs.items()}, "four": "ACGT"}
        assert files._split_order(spark.read.text(str(tmp_path / "a.fa"))).select("block").distinct().count() > 3
        reads = {(r.qname, r.seq, r.qual) for r in files.fastq_files(spark, str(tmp_path / "r.fq")).collect()}
        assert reads == {(f"r{k}", f"ACGT{k % 10}", f"IIII{k % 7}") for k in range(200)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spans = spark.createDataFrame([(1, "one", 95, 310), (2, "two", 0, 3)], "span_id int, chrom string, start_pos int, end_pos int")
    assert dict(files.subsequences(spans, pages, 100).collect()) == {1: seqs["one"][95:310], 2: "GGC"}


def test_split_reads_on_both_strands_and_sides(spark):
    from helixlake.operators import evidence

    rows = [(k, side, strand, 1000, hit) for k, (side, strand, hit) in enumerate(itertools.product(["HEAD", "TAIL"], "FR", [500, 2000, 1000]))]
    df = spark.createDataFrame(rows, "clip_id int, clip_side string, hit_or string, pos int, hit_pos int")
    got = {(r.clip_side, r.hit_or, r.hit_pos): r.split_class for r in evidence.split_orientation(df).collect()}
    assert got == {
        ("HEAD", "F", 500): "FFAB", ("HEAD", "F", 2000): "FFBA", ("TAIL", "F", 500): "FFBA", ("TAIL", "F", 2000): "FFAB",
        ("HEAD", "R", 500): "RFAB", ("HEAD", "R", 2000): "FRBA", ("TAIL", "R", 500): "RFBA", ("TAIL", "R", 2000): "FRAB",
    }


def test_calls_of_planted_variants(spark):
    """Two samples with evenly spread pairs: a deletion in both, and an inversion and a tandem duplication in one each."""
    from helixlake.operators.calling import call_variants

    rows, n = [], 0

    def pair(sample, a, b, or1, or2):
        nonlocal n
        n += 1
        for first, (p, q, x, y) in enumerate([(a, b, or1, or2), (b, a, or2, or1)]):
            flag = 1 + (64 if not first else 128) + (16 if x == "R" else 0) + (32 if y == "R" else 0)
            rows.append((f"r{n}", n, "c", sample, f"lib-{sample}", p, q, flag, (b + 100 - a) * (1 if not first else -1), 40, 0))

    for sample in "xy":
        for p in range(0, 90_000, 10):
            if not (20_000 - 500 < p < 22_000):
                pair(sample, p, p + 300 + p // 10 % 30, "F", "R")
        for k in range(12):  # a deletion of 20,000 to 22,000
            pair(sample, 19_700 + 15 * k + (sample == "y"), 22_000 + 10 * k, "F", "R")  # equal places would count as copies
    for k in range(9):  # an inversion of 50,000 to 53,000 in x, a duplication of 70,000 to 71,500 in y
        d = 20 + 20 * k  # the two gaps to the breakpoints add up to the library's usual one
        pair("x", 50_000 - d - 99, 53_000 - (214 - d) - 99, "F", "F")
        pair("x", 50_000 + d, 53_000 + 214 - d, "R", "R")
        pair("y", 70_010 + 11 * k, 71_250 + 11 * k, "R", "F")
    schema = "read_name string, rid long, chrom string, sample string, library string, pos int, mate_pos int, flag int, isize int, mapq int, nm int"
    alignments = spark.createDataFrame(rows, schema).repartition(4)
    none = spark.createDataFrame([], "chrom string, start_pos int, end_pos int, strand string, repeat_class string, mei_code int")
    windows = spark.range(900).selectExpr("'c' as chrom", "id * 100 as start_pos", "50 as gc")
    calls = {r.sv_type: r for r in call_variants(alignments, none, none, none, windows).collect()}
    assert set(calls) == {"DEL", "INV", "TDUP"}
    d, i, t = calls["DEL"], calls["INV"], calls["TDUP"]
    assert 19_900 <= d.inner_start <= 20_100 and 21_950 <= d.inner_end <= 22_100 and {x["sample"]: x["rp"] for x in d.samples} == {"x": 12, "y": 12}
    assert 49_700 <= i.outer_start <= 50_300 and 52_700 <= i.outer_end <= 53_300 and {x["sample"]: x["rp"] for x in i.samples} == {"x": 18, "y": 0}
    assert 69_900 <= t.outer_start <= 70_300 and 71_100 <= t.outer_end <= 71_600 and {x["sample"]: x["rp"] for x in t.samples} == {"x": 0, "y": 9}
    assert {x["gt"] for x in d.samples} <= {"0/1", "1/1"} and d.rp == 24


def test_columns_of_filters_may_clash(spark):
    a = spark.createDataFrame([("c", 5, 9, 1, 2), ("c", 50, 60, 3, 4)], "chrom string, s int, e int, _bin int, _s1 int")
    b = spark.createDataFrame([("c", 7, 8, 1)], "chrom string, s int, e int, _b1 int")
    assert [tuple(r) for r in overlap_filter(a, b, ("s", "e"), ("s", "e"), anti=False).collect()] == [("c", 5, 9, 1, 2)]
    with pytest.raises(ValueError, match="r_s"):
        overlap_join(a.withColumnRenamed("_bin", "r_s"), b, ("s", "e"), ("s", "e"))


def test_malformed_rows_of_evidence_are_errors(spark):
    from helixlake.sources import text

    with pytest.raises(Exception, match="thirteen"):
        text.divet(spark.createDataFrame([("a b c",)], "line string")).collect()

"""Jobs whose work must not meet in one task, one broadcast or one plan."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from helixlake.jobs import QUERIES
from helixlake.operators import clusters, depth, evidence, reads, resolve
from tests.conftest import TINY

EVIDENCE = "ev_id long, chrom string, sv_type string, l_start int, l_end int, l_or string, r_start int, r_end int, r_or string, min_delta int, max_delta int"


def test_duplications_hold_each_row_once(spark):
    # Each row has a shape for the copy to the left and one for the copy to the right, under one id.
    rows = [(k, "c", "INTERDUP", 901 + k, 1000 + k, "F", 5000 + k, 5099 + k, "R", 119, 327) for k in range(3)] + [(3, "c", "INTERDUP", 1020, 1119, "R", 7001, 7100, "F", 119, 327)]
    found = clusters.duplications(spark.createDataFrame(rows, EVIDENCE)).collect()
    assert found and len(found) == len({(r.cluster_id, r.ev_id) for r in found})
    assert {r.ev_id for r in found if r.sv_type == "INTERDUP_LEFT"} == {0, 1, 2, 3}


@pytest.mark.parametrize("options", [{}, {"both_sides": True, "between": True}, {"between": True, "paired": True}])
def test_an_island_over_many_tiles_gives_the_sets_of_one_sweep(spark, monkeypatch, options):
    monkeypatch.setattr(clusters, "TILE_REACHES", 1)
    draw, rows = random.Random(5), []
    for k in range(150):
        start, low, least = draw.randint(-200, 300), draw.randint(0, 60), draw.randint(0, 40)
        rows.append((k, start, start + draw.randint(1, 25), low, low + draw.randint(0, 30), -1, least, least + 60, draw.choice("FR")))
    frame = spark.createDataFrame([(r[0], "c", "X", *r[1:]) for r in rows], "ev_id long, chrom string, sv_type string, start long, stop long, low long, high long, slope long, least long, most long, side string")
    found = clusters.cluster(frame, **options).groupBy("cluster_id", "left_brk", "size").agg(F.sort_array(F.collect_list("ev_id")).alias("own")).collect()
    want = clusters.sweep(rows, options.get("both_sides", False), options.get("between", False), options.get("paired", False))
    assert sorted((r.left_brk, r.own) for r in found) == sorted((b, own) for b, own in want if len(own) > 1)
    assert all(r.size == len(r.own) for r in found)


def test_kmers_are_never_broadcast(spark):
    clips = spark.createDataFrame([(1, "c", 4, "ACGTACGTACGT")], "clip_id long, chrom string, pos long, seq string")
    reference = spark.createDataFrame([("c", "ACGTACGTAC", 4)], "chrom string, kmer string, at long")
    found = evidence.seed_join(clips, reference)
    assert [(r.hit_or, r.at) for r in found.collect()] == [("F", 4), ("R", 4)]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [chrom" in plan and "_bin" in plan.split("SortMergeJoin [chrom")[1].split("]")[0]


def test_split_evidence_is_planned_in_steps(spark):
    plan = QUERIES["split_evidence"](spark, str(TINY))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Relation") == 1


def test_kmers_are_made_in_many_tasks(spark):
    from helixlake.jobs.tables import Tables

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert Tables(spark, str(TINY)).reference_kmers.rdd.getNumPartitions() == parts > 1


def test_reference_has_no_holes_where_keys_are_missing_or_repeated(spark, tmp_path):
    from helixlake.jobs.tables import Tables

    keys = [0, 1, 2, 7, 7, 12, 40, 45]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    text = {k: hashlib.md5(str(k).encode()).hexdigest() + hashlib.md5(str(k + 1).encode()).hexdigest() for k in keys}
    text = {k: s.translate(str.maketrans("0123456789abcdef", "ACGTACGTACGTACGT")) for k, s in text.items()}
    got = Tables(spark, str(tmp_path)).reference.collect()
    for c in range(1, 5):
        want = [text[k] for k in sorted(keys, key=lambda k: ((k + c * 7) % len(keys), k))]
        assert [(r.start_pos, r.seq) for r in sorted((r for r in got if r.chrom == f"chr{c}"), key=lambda r: r.start_pos)] == [(64 * k, s) for k, s in enumerate(want)]


def test_deletion_with_crossed_ends_spells_what_lies_between(spark):
    text = "".join(random.Random(3).choices("ACGT", k=200))
    pages = spark.createDataFrame([("c", k, text[k : k + 50]) for k in range(0, 200, 50)], "chrom string, start_pos long, seq string")
    rows = [("a", "c", "DEL", 120, 10, 60, 190, True), ("b", "c", "DEL", 61, 10, 60, 190, True), ("d", "c", "DEL", 60, 10, 61, 190, True)]
    calls = spark.createDataFrame(rows, "cluster_id string, chrom string, sv_type string, inner_start int, outer_start int, inner_end int, outer_end int, precise boolean")
    got = {r.cluster_id: (r.ref, r.alt) for r in resolve.with_sequences(calls, pages, width=50).collect()}
    assert got == {"a": (text[61:120], text[61]), "b": (".", None), "d": (text[60:62], text[60])}


def test_windows_are_never_broadcast(spark):
    windows = spark.createDataFrame([("c", 0, 40), ("c", 100, 50)], "chrom string, start_pos bigint, gc int")
    counted = spark.createDataFrame([("s", "c", 5, 10), ("s", "c", 120, 30)], "sample string, chrom string, pos long, n long")
    spans = spark.createDataFrame([(1, "c", 50, 150)], "span_id long, chrom string, start_pos long, end_pos long")
    profile = depth.gc_depth(counted, windows)
    found = depth.expected_depth(spans, profile, windows)
    assert [tuple(r) for r in found.collect()] == [(1, "s", 20.0)]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    joins = r"SortMergeJoin \[chrom[^]]*start_pos"
    assert re.search(joins, plan)
    assert re.search(joins, profile._jdf.queryExecution().sparkPlan().toString())


def test_a_place_of_a_mate_is_looked_up_once(spark, monkeypatch):
    asked, join = [], reads.overlap_join
    monkeypatch.setattr(reads, "overlap_join", lambda left, *a, **k: asked.append(left.count()) or join(left, *a, **k))
    reads_at = spark.range(200).selectExpr("id as rid", "'c' as chrom", "id as pos", "1010L as mate_pos", "0 as flag")
    elements = spark.createDataFrame([("c", 1000 - k, 1200, "+", "SINE/Alu", 0) for k in range(50)], "chrom string, start_pos int, end_pos int, strand string, repeat_class string, mei_code int")
    got = reads.mei(reads_at, elements).collect()
    assert len(got) == 200 and {r.element_start for r in got} == {951} and asked == [1]

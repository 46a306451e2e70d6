"""Annotation from files, and the calling job from files alone."""

import random

from helixlake.jobs.call import main
from helixlake.operators import resolve
from helixlake.sources import annotation
from tests.test_calling import LENGTHS, Reads


def stored(tmp_path, reference):
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "ref.fa").write_text("".join(f">{c} of the test\n" + "".join(t[k : k + 60].lower() + "\n" for k in range(0, len(t), 60)) for c, t in reference.items()))
    (folder / "gaps.bed").write_text("# gaps\nc\t80000\t80100\nc\t80000\t80100\nd\t29900\t40000\nelsewhere\t1\t9\nc\t90000\t90010\nc\t7\t7\n")
    row = "  463   1.3  0.6  1.7  {0}  {1} {2} (1) {3} {4} {5} 1 300 (0) 1\n"
    masker = [("c", 85_001, 85_300, "+", "ALR/Alpha", "Satellite/centr"), ("d", 5_001, 5_400, "+", "AluY", "SINE/Alu"), ("d", 15_001, 15_400, "C", "L1HS", "LINE/L1"), ("none", 1, 9, "+", "AluY", "SINE/Alu")]
    (folder / "reps.out").write_text("   SW  perc\nscore  div.\n\n" + "".join(row.format(*m) for m in masker))
    return folder


def test_build_and_load(spark, tmp_path):
    reference = Reads().reference
    folder = stored(tmp_path, reference)
    main(["build", "--ref", str(folder / "ref.fa"), "--gaps", str(folder / "gaps.bed"), "--reps", str(folder / "reps.out"), "--out", str(tmp_path / "a")])
    known = annotation.load(spark, str(tmp_path / "a"))
    assert {r.chrom: r.length for r in known.lengths.collect()} == LENGTHS
    for r in known.lengths.collect():
        assert abs(r.gc - 100 * sum(x in "GC" for x in reference[r.chrom]) / LENGTHS[r.chrom]) < 1e-5
    text = {c: "" for c in LENGTHS}
    for r in known.pages.orderBy("chrom", "start_pos").collect():
        assert r.start_pos == len(text[r.chrom])
        text[r.chrom] += r.seq
    assert text == reference
    assert sorted(tuple(r) for r in known.gaps.collect()) == [("c", 80_000, 80_100), ("d", 29_900, 30_000)]
    assert known.duplications.count() == 0 and known.satellites.count() == 1
    assert sorted((r.chrom, r.start_pos, r.end_pos, r.strand, r.repeat_type, r.repeat_class) for r in known.elements.collect()) == [
        ("d", 5_000, 5_400, "+", "AluY", "SINE/Alu"), ("d", 15_000, 15_400, "-", "L1HS", "LINE/L1")]
    assert known.track.count() == known.pages.count()
    part = annotation.load(spark, str(tmp_path / "a"), ["d"])
    assert [r.chrom for r in part.lengths.collect()] == ["d"] and part.gaps.count() == 1 and part.width == 1000


def test_calls_from_files(spark, tmp_path):
    """A deletion of [20,013, 22,007) with split reads, in files alone."""
    reads = Reads()
    ref = reads.reference["c"]
    reads.even("x", without=[(20_013, 22_007)])
    for k in range(12):
        reads.pair("x", 19_700 + 15 * k, 22_010 + 10 * k, "F", "R")
    for clip in range(24, 44, 3):
        reads.clipped("x", 20_013 - 100 + clip, f"{100 - clip}M{clip}S", ref[20_013 - 100 + clip : 20_013] + ref[22_007 : 22_007 + clip])
        reads.clipped("x", 22_007, f"{clip}S{100 - clip}M", ref[20_013 - clip : 20_013] + ref[22_007 : 22_007 + 100 - clip])
    folder = stored(tmp_path, reads.reference)
    lines = [f"@SQ\tSN:{c}\tLN:{n}" for c, n in LENGTHS.items()] + ["@RG\tID:lib-x\tSM:x"]
    for name, _, chrom, mate_chrom, _, library, pos, mate_pos, flag, isize, mapq, nm, cigar, seq, quals in reads.rows:
        text = "".join(chr(q + 33) for q in quals) if quals else "*"
        lines.append("\t".join(map(str, [name, flag, chrom, pos + 1, mapq, cigar, "=" if mate_chrom == chrom else mate_chrom, mate_pos + 1, isize, seq or "*", text, f"RG:Z:{library}", f"NM:i:{nm}"])))
    (folder / "x.sam").write_text("\n".join(lines) + "\n")
    main(["build", "--ref", str(folder / "ref.fa"), "--gaps", str(folder / "gaps.bed"), "--reps", str(folder / "reps.out"), "--out", str(tmp_path / "a")])
    main(["call", "--input", str(folder / "x.sam"), "--annotation", str(tmp_path / "a"), "--out", str(tmp_path / "out")])
    made = "".join(f.read_text() for f in sorted((tmp_path / "out" / "calls").glob("part-*"))).splitlines()
    assert made[0].startswith("##fileformat") and "##contig=<ID=d,length=30000>" in made
    (record,) = [line.split("\t") for line in made if not line.startswith("#")]
    assert record[0] == "c" and record[3:5] == [ref[20_013:22_008], ref[20_013]] and record[6] == "PASS"
    assert record[1] == "20014" and "END=22008;SVLEN=-1995" in record[7] and "PRECISE" in record[7].split(";")
    assert record[9].split(":")[0] in ("0/1", "1/1")
    assert "DEL,1,1995" in "".join(f.read_text() for f in (tmp_path / "out" / "totals").glob("part-*"))
    assert len("".join(f.read_text() for f in (tmp_path / "out" / "histogram").glob("part-*")).splitlines()) > 20


def test_sequences_of_every_kind(spark):
    draw = random.Random(3)
    text = "".join(draw.choice("ACGT") for _ in range(1_234))
    pages = spark.createDataFrame([("c", k, text[k : k + 100]) for k in range(0, 1_234, 100)], "chrom string, start_pos int, seq string")
    turned = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    calls = [  # name, type, inner start, outer start, inner end, outer end, precise, resolved, element, reference, alternative
        ("a", "DEL", 95, 90, 310, 320, True, False, None, text[95:311], text[95]),
        ("b", "DEL", 95, 90, 310, 320, False, False, None, text[95], None),
        ("c", "INV", 95, 90, 310, 320, False, True, None, text[90:321], turned(text[90:321])),
        ("d", "TDUP", 95, 90, 310, 320, True, False, None, text[90], text[90:321]),
        ("e", "INS", 95, 90, 310, 320, False, True, None, text[95], "."),
        ("f", "INS", 95, 90, 310, 320, True, False, None, text[95], None),
        ("g", "MEI_F", 95, 90, 310, 320, False, True, ("c", 700, 820), text[90], text[700:820]),
        ("h", "MEI_R", 95, 90, 310, 320, False, True, ("c", 700, 820), text[90], turned(text[700:820])),
        ("i", "MEI_R", 95, 90, 310, 320, False, True, None, text[90], "."),
        ("j", "NUMT_F", 95, 90, 310, 320, False, True, None, text[90], "."),
        ("k", "INTERDUP_RIGHT", 195, 90, 310, 320, False, True, None, text[90], text[90:196]),
        ("l", "INVDUP_LEFT", 95, 90, 310, 420, False, True, None, text[310], text[310:421]),
        ("m", "INVDUP_LEFT", 95, 90, 420, 310, False, True, None, text[420], text[310:421]),
        ("n", "DEL", 1_200, 1_190, 1_300, 1_310, True, False, None, text[1_200:], text[1_200]),
        ("o", "DEL", 5_000, 4_990, 5_300, 5_310, True, False, None, ".", None),
        ("p", "INV", None, 90, 310, 320, None, None, None, text[90], None),
    ]
    rows = [(n, "c", kind, *ends, precise, asked, *(element or (None, None, None))) for n, kind, *ends, precise, asked, element, _, _ in calls]
    frame = spark.createDataFrame(rows, "cluster_id string, chrom string, sv_type string, inner_start int, outer_start int, inner_end int, outer_end int, precise boolean, asked boolean, element_chrom string, element_start int, element_end int")
    from pyspark.sql import functions as F

    got = {r.cluster_id: (r.ref, r.alt) for r in resolve.with_sequences(frame, pages, F.col("asked"), 100).collect()}
    assert got == {c[0]: (c[-2], c[-1]) for c in calls}
    empty = resolve.with_sequences(frame.where("false"), pages, True, 100)
    assert empty.count() == 0

"""The whole run on planted reads: what must be called, at which base, and what must not."""

import random

import pytest

from helixlake.operators import vcf
from helixlake.operators.calling import call_variants

SCHEMA = "read_name string, rid long, chrom string, mate_chrom string, sample string, library string, pos int, mate_pos int, flag int, isize int, mapq int, nm int, cigar string, seq string, base_quals array<int>"
ELEMENTS = "chrom string, start_pos int, end_pos int, strand string, repeat_type string, repeat_class string, mei_code int"
LENGTHS = {"c": 90_000, "d": 30_000, "chrM": 16_000}


class Reads:
    def __init__(self, seed: int = 5):
        draw = random.Random(seed)
        self.rows, self.n = [], 0
        self.reference = {c: "".join(draw.choice("ACGT") for _ in range(n)) for c, n in LENGTHS.items()}

    def pair(self, sample, a, b, or1, or2, chrom="c", mate_chrom=None, mapq=40, extra=0, times=1):
        for _ in range(times):
            self.n += 1
            mate = mate_chrom or chrom
            size = b + 100 - a if mate == chrom else 0
            for first, (p, q, x, y, own, other) in enumerate([(a, b, or1, or2, chrom, mate), (b, a, or2, or1, mate, chrom)]):
                flag = 1 + (64 if not first else 128) + (16 if x == "R" else 0) + (32 if y == "R" else 0) + extra
                self.rows.append((f"r{self.n}", self.n, own, other, sample, f"lib-{sample}", p, q, flag, size if not first else -size, mapq, 0, "100M", None, None))

    def even(self, sample, chrom="c", without=()):
        for p in range(0, LENGTHS[chrom] - 500, 10):
            if not any(a - 430 < p < b for a, b in without):
                self.pair(sample, p, p + 300 + p // 10 % 30, "F", "R", chrom)

    def clipped(self, sample, pos, cigar, seq, chrom="c"):
        """A mapped read with a clip, its mate three hundred bases away."""
        self.n += 1
        self.rows.append((f"r{self.n}", self.n, chrom, chrom, sample, f"lib-{sample}", pos, pos + 310, 1 + 64 + 32, 410, 40, 0, cigar, seq, [35] * 100))

    def frame(self, spark):
        return spark.createDataFrame(self.rows, SCHEMA).repartition(4)


def run(spark, reads, elements=(), satellites=(), pages=False):
    regions = lambda rows: spark.createDataFrame(list(rows), ELEMENTS)
    lengths = spark.createDataFrame(list(LENGTHS.items()), "chrom string, length int")
    windows = spark.createDataFrame([(c, k, 50) for c, n in LENGTHS.items() for k in range(0, n, 100)], "chrom string, start_pos int, gc int")
    sequence = None
    if pages:
        sequence = spark.createDataFrame([(c, k, s[k : k + 1000]) for c, s in reads.reference.items() for k in range(0, len(s), 1000)], "chrom string, start_pos int, seq string")
    calls = call_variants(reads.frame(spark), regions(satellites), regions([]), regions(elements), windows, lengths=lengths, pages=sequence)
    return calls.collect(), {r.id: r for r in vcf.records(calls).collect()}


def test_only_accepted_pairs_of_one_chromosome_are_called(spark):
    reads = Reads()
    for sample in "xyz":
        reads.even(sample, without=[(20_000, 22_000)] if sample == "x" else [])
    reads.even("x", "d")
    for k in range(12):  # a deletion in x alone
        reads.pair("x", 19_700 + 15 * k, 22_000 + 10 * k, "F", "R")
    for k in range(12):  # pairs that must not be called: copies, secondary, failed and supplementary records, and bad mappings
        for place, extra in enumerate([0x400, 0x100, 0x200, 0x800]):
            reads.pair("y", 30_000 + 5000 * place + 13 * k, 33_000 + 5000 * place + 11 * k, "F", "R", extra=extra)
        reads.pair("y", 60_000 + 13 * k, 63_000 + 11 * k, "F", "R", mapq=5)
        reads.pair("y", 70_000 + 13 * k, 12_000 + 11 * k, "F", "R", mate_chrom="d")  # on two chromosomes
        reads.pair("y", 2_000 + 13 * k, 29_950 + k, "F", "R", chrom="d")  # up to the end of a short chromosome
    calls, records = run(spark, reads)
    assert [c.sv_type for c in calls] == ["DEL"]
    own = {s["sample"]: (s["rp"], s["gt"]) for s in calls[0].samples}
    assert own["x"][0] == 12 and own["x"][1] in ("0/1", "1/1") and own["y"] == own["z"] == (0, "0/0")
    (record,) = records.values()
    assert [s.split(":")[0] for s in record.samples.split("\t")][1:] == ["0/0", "0/0"]


def test_insertions_of_elements_and_of_mitochondrial_sequence(spark):
    """Reads of either side whose mates lie in an element far away, or on the mitochondrion."""
    reads = Reads()
    reads.even("x")
    elements = [("d", 5_000, 5_400, "+", "AluY", "SINE/Alu", 0), ("d", 15_000, 15_400, "-", "L1HS", "LINE/L1", 1), ("c", 60_100, 60_500, "+", "L1HS", "LINE/L1", 1), ("c", 60_100, 60_500, "-", "L1HS", "LINE/L1", 1)]
    for k in range(6):
        reads.pair("x", 40_000 - 110 - 9 * k, 5_050 + 20 * k, "F", "F", mate_chrom="d")  # an element at 40,000
        reads.pair("x", 40_000 + 5 + 9 * k, 5_250 - 20 * k, "R", "R", mate_chrom="d")
        reads.pair("x", 60_300 - 110 - 9 * k, 15_050 + 20 * k, "F", "F", mate_chrom="d")  # one on an element of its own kind
        reads.pair("x", 60_300 + 5 + 9 * k, 15_250 - 20 * k, "R", "R", mate_chrom="d")
        reads.pair("x", 75_000 - 110 - 9 * k, 8_000 + 20 * k, "F", "F", mate_chrom="chrM")
        reads.pair("x", 75_000 + 5 + 9 * k, 8_200 - 20 * k, "R", "R", mate_chrom="chrM")
        reads.pair("x", 20_000 - 110 - 9 * k, 9_000 + 200 * k, "F", "F", mate_chrom="d")  # mates outside elements
        reads.pair("x", 20_000 + 5 + 9 * k, 9_250 - 20 * k, "R", "R", mate_chrom="d")
        reads.pair("x", 50_000 + 9 * k, 50_300 + 9 * k, "F", "R")  # concordant, the mate near an element
    calls, records = run(spark, reads, elements)
    found = sorted((c.sv_type[:4], round(c.outer_start, -3), c.element_name, bool(c.filtered)) for c in calls)
    assert found == [("MEI_", 40_000, "AluY", False), ("MEI_", 60_000, "L1HS", True), ("NUMT", 75_000, None, False)]
    mobile = next(c for c in calls if c.element_name == "AluY")
    assert mobile.inner_start <= 40_000 <= mobile.inner_end and mobile.rp == 12 and mobile.element_length == 400
    kinds = sorted((r.alt, r.filter) for r in records.values())
    assert kinds == [("<INS:ME:LINE/L1>", "mfilt"), ("<INS:ME:SINE/Alu>", "PASS"), ("<INS:MT>", "PASS")]


@pytest.mark.parametrize("side", ["TAIL", "HEAD"])
def test_split_reads_give_the_base(spark, side):
    """Clipped reads over a deletion of [20,013, 22,007), an inversion of [50,021, 53,002) and a duplication of [70,005, 71,503)."""
    reads = Reads()
    ref = reads.reference["c"]
    reads.even("x", without=[(20_013, 22_007)])
    for k in range(12):
        reads.pair("x", 19_700 + 15 * k, 22_010 + 10 * k, "F", "R")
        d = 20 + 20 * k if k < 9 else 30
        reads.pair("x", 50_021 - d - 99, 53_002 - (214 - d) - 99, "F", "F")
        reads.pair("x", 50_021 + d, 53_002 + 214 - d, "R", "R")
        reads.pair("x", 70_015 + 11 * k, 71_250 + 11 * k, "R", "F")
    turned = ref[50_021:53_002][::-1].translate(str.maketrans("ACGT", "TGCA"))
    joined = {"DEL": (ref[:20_013], ref[22_007:]), "INV": (ref[:50_021], turned + ref[53_002:]), "TDUP": (ref[:71_503], ref[70_005:])}
    for kind, (before, after) in joined.items():
        for clip in range(24, 44, 3):
            if side == "TAIL":
                reads.clipped("x", len(before) - 100 + clip, f"{100 - clip}M{clip}S", before[clip - 100 :] + after[:clip])
            elif kind != "INV":
                reads.clipped("x", 22_007 if kind == "DEL" else 70_005, f"{clip}S{100 - clip}M", before[-clip:] + after[: 100 - clip])
            else:  # over the right breakpoint: the clip lies in the inverted part
                reads.clipped("x", 53_002, f"{clip}S{100 - clip}M", (turned + ref[53_002:])[len(turned) - clip :][:100])
    calls, records = run(spark, reads, pages=True)
    got = {c.sv_type: (c.outer_start, c.outer_end) for c in calls if c.precise}
    assert got == {"DEL": (20_013, 22_007), "INV": (50_021, 53_002), "TDUP": (70_005, 71_503)}
    assert all(c.sr == 7 for c in calls if c.precise) and [c.sv_type for c in calls if not c.precise] in ([], ["TDUP"])
    spelt = {c.sv_type: (c.ref, c.alt) for c in calls if c.precise}
    whole = ref[50_021:53_003]
    assert spelt == {"DEL": (ref[20_013:22_008], ref[20_013]), "INV": (whole, whole[::-1].translate(str.maketrans("ACGT", "TGCA"))), "TDUP": (ref[70_005], ref[70_005:71_504])}
    assert all(c.alt is None and c.ref == ref[c.outer_start] for c in calls if not c.precise and c.sv_type == "TDUP")
    assert sum("PRECISE" in r.info.split(";") for r in records.values()) >= 3

"""Fixed values that give results their meaning, and the parameters of a run."""

from __future__ import annotations

from dataclasses import dataclass

#: Flag bits of an alignment record.
PAIRED, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE = 0x1, 0x4, 0x8, 0x10, 0x20
#: Paired, and none of secondary, QC-failed, duplicate and supplementary.
PROPER_MASK = 0xF01

FRAGMENT_SAMPLE = 100_000
BAND_SIGMAS = 4
MIN_INSERT, MAX_INVERSION, MIN_SOFT_CLIP, MAX_CIGAR_OPS, CLIP_WINDOW, MEI_DISTANCE = 100, 100_000_000, 10, 3, 20, 1_000_000
KMER, KMER_CAP, SEED_BAND, MISMATCH_SHARE, MAX_HITS = 10, 50_000, 100_000, 0.05, 11
GC_WINDOW = 100
SPAN_CAPS = {"DEL": 1_000_000, "INV": 5_000_000, "INVDUP": 100_000, "INTERDUP": 100_000}
CLUSTER_SPAN_CAPS = {"DEL": 500_000, "INV": 20_000_000, "TDUP": 500_000}
INFINITE_SCORE = 10_000_000.0
MAX_CALLS, READ_CLUSTERS = 100_000, 20
ZERO_RATE_PAIRS, ZERO_RATE_DEPTH = 0.001, 0.01
SPLIT_MAX_DELTA = 100


@dataclass(frozen=True)
class Params:
    mapq: int = 5
    support: int = 5
    read_length: int = 100
    chrom_length: int = 1_010_000
    mobile_elements: tuple[str, ...] = ("SINE/Alu", "LINE/L1", "Other/SVA")

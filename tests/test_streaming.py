"""Streamed counts equal those of one batch, however the files arrive."""

from helixlake.operators.reads import concordance_band, fragment_sample
from helixlake.sources import fixtures
from helixlake.streaming import arrivals
from tests.conftest import TINY


def test_counts_follow_arrivals(spark, tmp_path):
    records = fixtures.alignments(fixtures.read_pairs(spark, str(TINY)))
    feed, band = str(tmp_path / "feed"), concordance_band(fragment_sample(records))
    halves = [records.where("rid % 2 = 0"), records.where("rid % 2 = 1")]
    for name, make, keys in (
        ("depth", arrivals.depth_by_bin, ["sample", "chrom", "start_pos"]),
        ("classes", lambda r: arrivals.class_counts(r, band), ["library", "class"]),
    ):
        for part in halves:
            part.write.mode("append").parquet(f"{feed}/{name}")
            counts = make(arrivals.alignment_stream(spark, f"{feed}/{name}", records.schema))
            arrivals.keep_current(counts, f"{tmp_path}/{name}", f"{tmp_path}/{name}-state", keys).awaitTermination()
        got = {tuple(r[k] for k in keys): r["n"] for r in arrivals.current(spark, f"{tmp_path}/{name}", keys).collect()}
        assert got == {tuple(r[k] for k in keys): r["n"] for r in make(records).collect()}

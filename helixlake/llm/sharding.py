"""Balanced label propagation: linked documents move towards their neighbours' shards under quotas.

Documents with equal texts are linked. Groups above an eighth of a shard, of which there are at most eight a shard, are
placed first, the largest first, each in the fullest shard that holds it whole; only a group that no shard has room for is
cut, into as few pieces as fit. The others are units. Labels start at random; in each round every unit's members vote, a
join brings the votes' result to them, and they move to that shard as far as its free quota allows: where more would come
than fit, a share of the units, drawn by hash, moves and the others try one of the emptier shards; rounds go on until no
unit moves. Units above a shard's quota leave whole and go with the unlinked documents, unit by unit, which fill every shard up to its exact
count; there only units at the end of a shard's free part are cut.

The law is `rows`: shards' counts differ by one at most. Ranks and slots are numbered in two steps, by counts of hash
buckets and within each bucket, so that no task takes a whole shard.

Defined cases: null texts have no bytes and no links; an empty text is a text; repeated rows are documents like others;
a null doc_id is allowed; a text of any length counts in full; groups of equal size go by their hash; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixlake.llm.common import scratch, store
from helixlake.stored import discard

BUCKET_ROWS = 20_000
#: At most so many rounds; labels usually come to rest after two or three.
ROUNDS = 12


def _ranked(df: DataFrame, within: list[str], order: list[str], rows: int, name: str, together: list[str] | None = None) -> DataFrame:
    """Adds `name`: gapless from 0 within each combination of `within` columns. Rows that agree on `together`, the first of
    `order`, follow each other."""
    buckets = max(1, -(-rows // BUCKET_ROWS))
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*(together or order), F.lit(9)), F.lit(buckets)))
    counts = df.groupBy(*within, "_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*within).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    # One row for each bucket and group: shards times buckets, some ten thousandth of the rows.
    starts = counts.select(*within, "_bucket", F.coalesce(before, F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*within, "_bucket").orderBy(*order)) - 1
    return df.withColumn("_inside", inside).join(starts, [*within, "_bucket"]).withColumn(name, (F.col("_start") + F.col("_inside")).cast("long")).drop("_bucket", "_inside", "_start")


def _share(unit: Column, salt: int) -> Column:
    return F.pmod(F.xxhash64(unit, F.lit(salt)), F.lit(1 << 20)) / F.lit(float(1 << 20))


def assign_shards(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and cut_links (how many documents with the same text lie in
    other shards) for every row of docs."""
    with scratch(docs.sparkSession) as kept:
        found = store(_assigned(docs, shards), "shards")
        kept.append(found.stored_at)
    return found


def _assigned(docs: DataFrame, shards: int) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.when(F.col("text").isNotNull(), F.unhex(F.md5(text.cast("binary")))).alias("group"),
    )
    rows = store(rows, "sizes")
    total = rows.count()
    quota = total / shards
    groups = rows.where("`group` is not null").groupBy("group").agg(F.count("*").alias("members")).where("members > 1")
    groups = store(groups, "groups")
    free = {s: total // shards + (s < total % shards) for s in range(shards)}
    large = F.col("members") > quota / 8
    pieces = _placed([(bytes(r["group"]), r["members"]) for r in groups.where(large).collect()], free)  # at most eight groups a shard
    big = _big(rows, pieces, docs)
    linked = rows.join(groups.where(~large), "group")
    linked = store(linked.select("doc_id", "size", "text_crc32", F.xxhash64("group").alias("unit"), F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(shards)).cast("int").alias("shard")), "labels")
    for k in range(ROUNDS):
        moved = _moved(linked, free, k)
        if moved is None:
            break
        before, linked = linked, store(moved, "labels")
        discard(docs.sparkSession, before.stored_at)

    # What is above a quota is as free as unlinked documents; a unit that a quota would cut leaves whole.
    limit = F.create_map(*[F.lit(x) for kv in free.items() for x in kv])
    held = store(_ranked(linked, ["shard"], ["unit", "doc_id", "text_crc32"], max(1, total // shards), "place", ["unit"]), "held")
    border = [r["unit"] for r in held.where(F.col("place") == limit[F.col("shard")]).select("unit").collect()]  # one a shard at most
    held = store(held.withColumn("stays", (F.col("place") < limit[F.col("shard")]) & ~F.col("unit").isin(border)), "stays")
    full = {r["shard"]: r["n"] for r in held.where("stays").groupBy("shard").agg(F.count("*").alias("n")).collect()}
    loose = rows.join(groups, "group", "left_anti").select("doc_id", "size", "text_crc32", F.xxhash64("doc_id", "text_crc32").alias("unit"))
    loose = loose.unionByName(held.where("not stays").select("doc_id", "size", "text_crc32", "unit"))
    ends, at = [], 0
    for s in range(shards):
        at += free[s] - full.get(s, 0)
        ends.append(at)
    filled = _ranked(loose.withColumn("_all", F.lit(0)), ["_all"], ["unit", "doc_id", "text_crc32"], total, "rank", ["unit"])
    shard = F.size(F.filter(F.array(*[F.lit(x) for x in ends]), lambda e: e <= F.col("rank"))).cast("int")
    placed = held.where("stays").select("doc_id", "size", "text_crc32", "unit", "shard").unionByName(filled.select("doc_id", "size", "text_crc32", "unit", shard.alias("shard"))).unionByName(big)
    placed = store(placed, "placed")
    slotted = _ranked(placed, ["shard"], ["doc_id", "text_crc32"], max(1, total // shards), "slot")
    # Units are cut at the ends of shards, and groups above a shard into pieces: a few rows for each shard.
    counts = placed.groupBy("unit", "shard").agg(F.count("*").alias("_n"))
    cut = counts.groupBy("unit").agg(F.sum("_n").alias("_all"), F.count("*").alias("_places")).where("_places > 1")
    cut = store(counts.join(cut, "unit").select("unit", "shard", (F.col("_all") - F.col("_n")).alias("cut_links")), "cut")
    found = slotted.join(F.broadcast(cut), ["unit", "shard"], "left")
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.coalesce("cut_links", F.lit(0)).cast("long").alias("cut_links"))


def _placed(groups: list[tuple[bytes, int]], free: dict[int, int]) -> list[tuple[bytes, int, int, int]]:
    """Pieces (group, from, to, shard) of large groups; takes their rows off `free`."""
    pieces = []
    for group, members in sorted(groups, key=lambda g: (-g[1], g[0])):
        at = 0
        while at < members:
            fits = [s for s in free if free[s] >= members - at]
            shard = min(fits, key=lambda s: (free[s], s)) if fits else max(free, key=lambda s: (free[s], -s))
            taken = min(free[shard], members - at)
            pieces.append((group, at, at + taken, shard))
            free[shard] -= taken
            at += taken
    return pieces


def _big(rows: DataFrame, pieces: list[tuple[bytes, int, int, int]], docs: DataFrame) -> DataFrame:
    """Documents of the large groups, with their piece's shard. Only groups that are cut are numbered."""
    spark, columns = docs.sparkSession, ["doc_id", "size", "text_crc32", "unit", "shard"]
    cut = {g for g, at, _, _ in pieces if at}
    schema = "`group` binary, _from long, _to long, shard int"
    whole = F.broadcast(spark.createDataFrame([p for p in pieces if p[0] not in cut], schema))
    names = F.broadcast(spark.createDataFrame([(g,) for g in sorted(cut)], "`group` binary"))
    parts = F.broadcast(spark.createDataFrame([p for p in pieces if p[0] in cut], schema))
    most = max((p[2] for p in pieces if p[0] in cut), default=1)
    cut_rows = store(rows.join(names, "group"), "cut")
    numbered = _ranked(cut_rows, ["group"], ["doc_id", "text_crc32"], most, "at")
    inside = numbered.join(parts, "group").where("at >= _from and at < _to")
    both = rows.join(whole, "group").unionByName(inside.drop("at"))
    return both.withColumn("unit", F.xxhash64("group")).select(*columns)


def _moved(linked: DataFrame, free: dict[int, int], k: int) -> DataFrame | None:
    """One round: votes by unit and shard, the winner of each unit, and moves as far as quotas allow. None if all is at
    rest: every unit lies in one shard, and no shard holds more than its quota."""
    votes = linked.groupBy("unit", "shard").agg(F.count("*").alias("n"))
    best = votes.groupBy("unit").agg(F.max_by("shard", F.struct("n", F.xxhash64("unit", "shard", F.lit(k)))).alias("goal"), F.sum("n").alias("members"), F.count("*").alias("places"))
    best = store(best, "votes")
    # Forty rows or so: the load that each shard would have.
    loads = best.groupBy("goal").agg(F.sum("members").alias("n"), F.max("places").alias("places")).collect()
    load = {r["goal"]: r["n"] for r in loads}
    if all(r["places"] == 1 and r["n"] <= free[r["goal"]] for r in loads):
        return None
    share = F.create_map(*[F.lit(x) for s in free for x in (s, min(1.0, 0.9 * free[s] / load[s]) if s in load else 1.0)])
    light = sorted(free, key=lambda s: load.get(s, 0) - free[s])[: max(1, len(free) // 2)]
    elsewhere = F.element_at(F.array(*[F.lit(s) for s in light]), (F.pmod(F.xxhash64("unit", F.lit(k)), F.lit(len(light))) + 1).cast("int"))
    goal = F.when(_share(F.col("unit"), k) < share[F.col("goal")], F.col("goal")).otherwise(elsewhere)
    return linked.join(best.select("unit", goal.alias("goal")), "unit").select("doc_id", "size", "text_crc32", "unit", F.col("goal").cast("int").alias("shard"))

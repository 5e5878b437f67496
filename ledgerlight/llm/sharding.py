"""Balanced shards by label propagation under capacity quotas.

Documents with equal texts are linked through their group; a link between two
shards is a cut edge. Every document starts in a shard drawn from its doc_id,
and a table says how many members of each group lie in each shard. In every
round that table is joined with the room the shards have left. Each group that
is not yet settled asks, as a whole, for the shard in which most of its
members are among those with room for it (its neighbours' shards); if none of
them has room, for a shard drawn by the room that is left. Of the requests to a
shard only as many are granted as its quota has room for, the larger groups
first; a granted group settles there and has no cut edge left. The rounds go on
until every group is settled or none fits anywhere, whatever the number of
groups. What the driver sees of a round are sums by shard, size class and hash
part (finer parts where whole parts no longer fit), never groups. A group larger
than a shard takes whole shards and one remainder. Rows without copies have no
edges: they move to where room is left, so counts differ by one at most.

The law of the result is ``rows``: shard s has the rows whose place p (from 0)
has floor(p * shards / rows) = s, slot is the place within the shard.

Defined cases. Null text has size 16 and the CRC-32 of no bytes; null and
empty texts are one group. Rows that repeat a doc_id are separate rows. Fewer
rows than shards leave shards empty. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm.common import stored, text_or_empty

SHARDS = 40
# hash parts of a size class in a round, and how fine they may become
PARTS, MOST_PARTS = 64, 1024


def quotas(sizes: dict[int, int], requests: dict[tuple[int, int], int], capacity: float,
           passes: int = 50) -> dict[tuple[int, int], float]:
    """Share of the requests from one shard to another that is granted: a
    shard takes in what its capacity and its own departures allow, departures
    being cut back until both agree."""
    granted = {target: 1.0 for _, target in requests}
    asked: dict[int, int] = {}
    for (_, target), n in requests.items():
        asked[target] = asked.get(target, 0) + n
    for _ in range(passes):
        leaving: dict[int, float] = {}
        for (a, b), n in requests.items():
            leaving[a] = leaving.get(a, 0.0) + n * granted[b]
        granted = {b: min(granted[b], max(0.0, capacity - sizes.get(b, 0) + leaving.get(b, 0.0)) / n)
                   for b, n in asked.items()}
    return {(a, b): granted[b] for a, b in requests}


def whole_shards(large: list[tuple[str, int]], room: list[int], capacity: int) -> list[tuple[int, int, int]]:
    """(rows, shard, slot) for runs of the rows of groups larger than a shard,
    in order: full shards, then a remainder where it fits best, cut if it must
    be. Takes the rows from ``room``."""
    runs = []
    for _, n in large:
        while n:
            full = [s for s, r in enumerate(room) if r == capacity]
            fits = [s for s, r in enumerate(room) if r >= n]
            if n >= capacity and full:
                s = full[0]
            else:
                s = min(fits, key=lambda s: room[s]) if fits else max(range(len(room)), key=lambda s: room[s])
            take = min(n, room[s])
            runs.append((take, s, capacity - room[s]))
            room[s] -= take
            n -= take
    return runs


def grants(asked: dict[tuple[int, int, int], int], room: list[int], capacity: int) -> list[tuple[int, int, int]]:
    """The keys (wish, size class, part) of the requests that are granted,
    larger classes first; no shard takes in more than its room, which is
    lowered."""
    wishes: dict[tuple[int, int], int] = {}
    for (wish, _, _), n in asked.items():
        wishes[-1, wish] = wishes.get((-1, wish), 0) + n
    share = quotas({s: capacity - r for s, r in enumerate(room)}, wishes, capacity)
    out = []
    for key in sorted(asked, key=lambda k: (k[0], -k[1], k[2])):
        if share[-1, key[0]] > 0 and asked[key] <= room[key[0]]:
            room[key[0]] -= asked[key]
            out.append(key)
    return out


def wishes(members: DataFrame, room: list[int], salt: int) -> DataFrame:
    """(grp, members, wish) of groups that lie where ``members`` (grp, members,
    shard, n) says. Only shards with room for the whole group count."""
    spark = members.sparkSession
    free = spark.createDataFrame(list(enumerate(room)), "shard int, free long")       # one row per shard
    tie = F.pmod(F.xxhash64(F.lit(salt), "grp", "shard"), F.lit(1 << 20))
    near = members.join(F.broadcast(free), "shard").withColumn("fits", F.col("free") >= F.col("members")) \
        .groupBy("grp", "members").agg(F.max(F.when(F.col("fits"), F.struct("n", tie.alias("tie"), "shard")))["shard"].alias("near"))
    # the others draw: shard s with the probability its room has of all room that fits
    draw = F.pmod(F.xxhash64(F.lit(-1 - salt), "grp"), F.lit(max(sum(room), 1)))
    far, upto = F.lit(None).cast("int"), 0
    for s, r in enumerate(room):
        far = F.when((draw >= upto) & (F.col("members") <= r), F.lit(s)).otherwise(far)
        upto += r
    largest = max(range(len(room)), key=lambda s: room[s])
    last = F.when(F.col("members") <= room[largest], F.lit(largest))
    return near.select("grp", "members", F.coalesce("near", far, last).alias("wish"))


def propagate(members: DataFrame, room: list[int], capacity: int) -> tuple[DataFrame, list[dict]]:
    """(grp, shard) of the groups of ``members`` (grp, members, shard, n) that
    settle, and what each round did; ``room`` is lowered by what they take."""
    spark = members.sparkSession
    placed, rounds, parts = spark.createDataFrame([], "grp string, shard int"), [], PARTS
    while True:
        kind = F.floor(F.log2("members")).cast("int")
        part = F.pmod(F.xxhash64(F.lit(len(rounds)), "grp"), F.lit(parts)).cast("int")
        asked = stored(wishes(members, room, len(rounds)).where("wish is not null")
                       .select("*", kind.alias("kind"), part.alias("part")), "asked")
        sums = asked.groupBy("wish", "kind", "part").agg(F.sum("members").alias("n"), F.count(F.lit(1)).alias("groups")).collect()
        if not sums:
            return placed, rounds       # all settled, or no shard has room for any
        granted = grants({(r["wish"], r["kind"], r["part"]): r["n"] for r in sums}, room, capacity)
        took = set(granted)
        rounds.append({"asked": sum(r["groups"] for r in sums), "parts": parts, "settled": sum(
            r["groups"] for r in sums if (r["wish"], r["kind"], r["part"]) in took)})
        if not granted:
            if parts >= MOST_PARTS:
                return placed, rounds
            parts *= 4
            continue
        keys = F.broadcast(spark.createDataFrame(granted, "wish int, kind int, part int"))
        moved = stored(asked.join(keys, ["wish", "kind", "part"], "left_semi").select("grp", F.col("wish").alias("shard")), "moved")
        placed = placed.unionByName(moved)
        members = stored(members.join(moved.select("grp"), "grp", "left_anti"), "members")


def shard(docs: DataFrame, shards: int = SHARDS, report: list[dict] | None = None) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot,
    grown_shard (null under this law). ``report`` receives what each round did."""
    text = text_or_empty()
    base = stored(docs.select(
        F.col("doc_id").cast("long"), (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text, 256).alias("grp"),
        F.monotonically_increasing_id().alias("row")), "sharding")
    total = base.count()
    capacity = total // shards
    start = F.pmod(F.xxhash64("doc_id", "row"), F.lit(shards)).cast("int")
    counts = base.groupBy("grp", start.alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    groups = counts.groupBy("grp").agg(F.sum("n").alias("members")).where("members > 1")
    members = stored(counts.join(groups, "grp"), "members")
    groups = members.groupBy("grp", "members").agg(F.count(F.lit(1)).alias("in_shards"))
    room = [capacity] * shards
    # fewer than ``shards`` of these, and none to place if a shard holds no row
    large = [(r["grp"], r["members"]) for r in groups.where(F.col("members") > capacity).orderBy("grp").collect()] \
        if capacity else []
    runs = whole_shards(large, room, capacity)
    before = [capacity - r for r in room]
    placed, rounds = propagate(members.where(F.col("members") <= capacity), room, capacity)
    if report is not None:
        report += rounds
    if large:
        placed = placed.unionByName(groups.where(F.col("members") > capacity).select("grp", F.lit(-1).alias("shard")))
    # a table of its own: the join below is then free to split a hot group
    placed = stored(placed, "placed")
    labels = stored(base.select("row", "grp").join(placed, "grp", "left").select(
        "row", "grp", F.coalesce("shard", F.lit(shards)).alias("shard")), "labels")
    # rows in order: the large groups, the other groups by shard, the rest
    runs += [(capacity - r - b, s, b) for s, (r, b) in enumerate(zip(room, before))]
    first = [-(-s * total // shards) for s in range(shards + 1)]
    runs += [(first[s + 1] - first[s] - capacity + r, s, capacity - r) for s, r in enumerate(room)]
    return exact_cut(base, labels, runs)


def exact_cut(base: DataFrame, labels: DataFrame, runs: list[tuple[int, int, int]]) -> DataFrame:
    """Rows in order of (shard, grp, row), numbered without a global window and
    dealt to ``runs`` (rows, shard, first slot): a range-partitioned sort numbers
    rows within each partition, and the partitions' counts (one number each, all
    the driver sees) shift them."""
    spark = base.sparkSession
    ordered = labels.repartitionByRange("shard", "grp", "row").sortWithinPartitions("shard", "grp", "row") \
        .select("row", F.monotonically_increasing_id().alias("place"))
    ordered = stored(ordered, "ordered")
    counts = ordered.groupBy(F.expr("shiftright(place, 33)").alias("part")).agg(F.count(F.lit(1)).alias("n")) \
        .orderBy("part").collect()
    total, starts = 0, []
    for r in counts:
        starts.append((r["part"], total))
        total += r["n"]
    offsets = spark.createDataFrame(starts, "part long, first long")
    place = F.col("first") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = ordered.withColumn("part", F.expr("shiftright(place, 33)")).join(F.broadcast(offsets), "part") \
        .select("row", place.alias("place"))
    at, spans = 0, []
    for n, s, slot in runs:
        if n:
            spans.append((at, at + n, s, slot - at))
        at += n
    spans = spark.createDataFrame(spans, "lo long, hi long, shard int, shift long")
    dealt = numbered.join(F.broadcast(spans), F.expr("place >= lo and place < hi")) \
        .select("row", "shard", (F.col("place") + F.col("shift")).alias("slot"))
    return base.join(dealt, "row").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), F.col("grp").alias("text_group"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: all ``documents`` in shards 0 to 39."""
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))

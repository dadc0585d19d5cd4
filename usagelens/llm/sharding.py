"""Sharding by balanced label propagation.

Documents start on shards by hash. In each round a document looks where most documents of its
group are and asks to move there; requests between two shards are granted up to quotas, so
that sizes stay within a tolerance: an exchange in both directions is free, the room that is
left in a shard is shared out among those who ask. Rounds are joins and grouped counts on narrow
rows, the texts are read once. At last the documents, in the order of their shard and group,
are dealt out by rank, which makes the numbers of rows exact.

The law is ``rows``: the numbers of documents of any two shards differ by one at most.

Defined cases: a null text has no bytes (size 1, checksum 0) and is in one group with no other
but null texts; a null ``doc_id`` is a document like any other; repeated rows count each; an
empty table gives no rows; other columns are not read; of a text only its length and checksums
are kept, whatever its length. A group larger than a shard fills several shards: its rows ask
for one of them each, other documents make room; they are counted before any shuffle and
ranked in salted parts, also where all have one ``doc_id``. Ties between shards go by the
group's hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from usagelens.llm.common import discard, written

SHARDS = 16
ROUNDS = 5
TOLERANCE = 0.05
# Parts of the final order: groups by hash, and the parts that one group's rows are dealt to.
_GROUP_PARTS = 512
_SALTS = 64
_SALT_ROWS = 256


def _unit(*columns: object) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / float(1 << 30)


def documents(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, grp) of every row; ``grp`` names the text."""
    text = F.col("text")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.md5(text.cast("binary")), F.lit("")).alias("grp"),
    )


def _granted(asked: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """(shard, wanted, share): the share of the requests of each pair of shards that is granted.

    ``asked`` and ``sizes`` have at most shards x shards and shards rows; they become one row
    of arrays. An exchange between two shards is granted as a whole. For what goes beyond it, a
    shard takes in as much as it has room for plus what leaves it at the shares found so far;
    shares only grow from step to step, so no step exceeds the room.
    """
    flows = asked.select((F.col("shard") * shards + F.col("wanted")).alias("k"), F.col("x").alias("v"))
    stocks = sizes.select((-1 - F.col("shard")).alias("k"), F.col("n").alias("v"))
    one = flows.union(stocks).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    pairs, each = f"sequence(0, {shards * shards - 1})", f"sequence(0, {shards - 1})"
    turned = f"x[(i % {shards}) * {shards} + i div {shards}]"

    def total(of: str) -> str:
        return f"aggregate(transform({each}, k -> {of}), 0D, (a, v) -> a + v)"

    taken = f"least(1D, (room[j] + {total(f'more[j * {shards} + k] * s[k]')}) / greatest(1D, asks[j]))"
    steps = f"aggregate(sequence(1, 8), transform({each}, j -> 0D), (s, t) -> transform({each}, j -> {taken}))"
    return (
        one.selectExpr(
            f"transform({pairs}, i -> double(coalesce(try_element_at(m, i), 0))) AS x",
            f"transform({each}, j -> double(coalesce(try_element_at(m, -1 - j), 0))) AS n",
        )
        .selectExpr("x", "n", f"transform({pairs}, i -> least(x[i], {turned})) AS free")
        .selectExpr("x", "n", "free", "zip_with(x, free, (a, b) -> a - b) AS more")
        .selectExpr(
            "*",
            f"transform(n, v -> greatest(0D, {1 + TOLERANCE}D / {shards} * {total('n[k]')} - v)) AS room",
            f"transform({each}, j -> {total(f'more[k * {shards} + j]')}) AS asks",
        )
        .selectExpr("*", f"{steps} AS s")
        .selectExpr(
            f"posexplode(transform({pairs}, i -> (free[i] + more[i] * s[i % {shards}]) / greatest(1D, x[i])))"
            " AS (k, share)"
        )
        .selectExpr(f"int(k div {shards}) AS shard", f"int(k % {shards}) AS wanted", "share")
    )


def _large(now: DataFrame, room: float) -> tuple[DataFrame, int]:
    """Groups that no shard can hold, the room before each, and how many shards they fill.

    They share out the first shards one after the other. Each has more rows than a shard has
    room for, so there are fewer of them than shards.
    """
    sizes = now.groupBy("grp").agg(F.count("*").alias("members")).where(F.col("members") > room)
    found = sorted(((r["members"], r["grp"]) for r in sizes.collect()), reverse=True)
    rows, before = [], 0
    for members, grp in found:
        rows.append((grp, float(members), float(before)))
        before += members
    return now.sparkSession.createDataFrame(rows, "grp string, members double, before double"), int(before / room)


def propagate(rows: DataFrame, key: list[str], shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """The rows (with ``grp``), a ``mark`` of each, and the ``shard`` it belongs to after the rounds.

    ``key`` names the columns of the first placing. The marks tell equal rows apart for the draw
    among those that ask to move.
    """
    spark = rows.sparkSession
    started, started_path = written(
        rows.withColumn("mark", F.monotonically_increasing_id()).withColumn(
            "shard", F.pmod(F.xxhash64("grp", *key), F.lit(shards)).cast("int")
        ),
        "shards-start",
    )
    room = max(started.count() / shards, 1.0)
    large, full = _large(started, room)
    # Rows of a large group ask for one of its shards each, in even parts; the shards that such
    # groups fill are left by all others.
    drawn = F.floor((F.col("before") + _unit(F.lit(-1), "grp", "mark") * F.col("members")) / room)
    target = F.when(drawn < shards, drawn).when(drawn.isNotNull(), shards - 1).cast("int")
    now, path = written(
        started.join(F.broadcast(large), "grp", "left").withColumn("target", target).drop("members", "before"),
        "shards-targets",
    )
    discard(spark, started_path)
    full = full if full < shards else 0
    elsewhere = (full + F.pmod(F.xxhash64(F.lit(-2), "grp"), F.lit(shards - full))).cast("int")
    for k in range(rounds):
        small = now.where("target IS NULL")
        counts = small.groupBy("grp", "shard").agg(F.count("*").alias("n"))
        # most documents, then a shard by the group's hash, so that ties spread evenly
        draw = F.struct(F.col("shard") >= full, "n", F.xxhash64("grp", "shard").alias("h"), "shard")
        best, best_path = written(
            counts.groupBy("grp")
            .agg(F.max(draw)["shard"].alias("wanted"), F.sum("n").alias("members"))
            .where("members > 1")
            .drop("members"),
            "shards-best",
        )
        # a document without neighbours only leaves a shard that is to be full
        wanted = F.when(F.coalesce("wanted", "shard") < full, elsewhere).otherwise(F.col("wanted"))
        tied, tied_path = written(
            small.join(best, "grp", "left")
            .withColumn("wanted", wanted)
            .unionByName(now.where("target IS NOT NULL").withColumn("wanted", F.col("target"))),
            "shards-asked",
        )
        asked = tied.where("wanted <> shard").groupBy("shard", "wanted").agg(F.count("*").alias("x"))
        sizes = tied.groupBy("shard").agg(F.count("*").alias("n"))
        # at most shards x shards rows
        share = F.broadcast(_granted(asked, sizes, shards))
        moves = _unit(F.lit(k), "grp", "mark") < F.coalesce("share", F.lit(0.0))
        after, after_path = written(
            tied.join(share, ["shard", "wanted"], "left")
            .withColumn("shard", F.when(moves, F.col("wanted")).otherwise(F.col("shard")))
            .select(now.columns),
            "shards-round",
        )
        for old in (path, best_path, tied_path):
            discard(spark, old)
        now, path = after, after_path
    return now.drop("target")


def deal(placed: DataFrame, key: list[str], shards: int = SHARDS) -> DataFrame:
    """The placed rows with their final ``shard`` and ``slot``: equal runs of the order of
    (shard, group), so at most ``shards`` - 1 cuts go through it. ``mark`` tells equal rows apart.

    Ranks come in two steps: counts of the parts of the order (their number is bounded) and the
    rank in each part. Groups of over a few hundred rows are salted over several parts.
    """
    sizes = placed.groupBy("grp", "shard").agg(F.count("*").alias("members")).where(F.col("members") > _SALT_ROWS)
    large, _ = written(sizes, "shards-large")
    salt = F.pmod(F.xxhash64(F.lit(7), "mark"), F.lit(_SALTS))
    marked, _ = written(
        placed.join(large, ["grp", "shard"], "left")
        .withColumn("g", F.pmod(F.xxhash64("grp"), F.lit(_GROUP_PARTS)))
        .withColumn("s", F.when(F.col("members").isNull(), F.lit(-1)).otherwise(salt))
        .drop("members"),
        "shards-marked",
    )
    part = ["shard", "g", "s"]
    counts = marked.groupBy(*part).agg(F.count("*").alias("n"))
    # small groups first, then the large ones; a running sum over at most
    # shards x group parts x (salts + 1) counts
    running = Window.orderBy(*part).rowsBetween(Window.unboundedPreceding, -1)
    begins, _ = written(
        counts.withColumn("begin", F.coalesce(F.sum("n").over(running), F.lit(0))).drop("n"), "shards-parts"
    )
    total = placed.count()
    rank = F.col("begin") + F.row_number().over(Window.partitionBy(*part).orderBy("grp", *key, "mark")) - 1
    shard = F.floor(F.col("r") * shards / F.lit(max(total, 1)).cast("decimal(20,0)")).cast("int")
    first = F.ceil(F.col("to").cast("decimal(20,0)") * F.lit(total) / shards).cast("long")
    return (
        marked.join(begins, part)
        .withColumn("r", rank.cast("decimal(20,0)"))
        .withColumn("to", shard)
        .withColumn("slot", F.col("r").cast("long") - first)
        .drop("g", "s", "begin", "r", "shard", "mark")
        .withColumnRenamed("to", "shard")
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per document."""
    key = ["doc_id", "size", "text_crc32"]
    dealt = deal(propagate(documents(docs), key, shards, rounds), key, shards)
    return dealt.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def cut_edges(placed: DataFrame, group: str = "text_crc32") -> DataFrame:
    """One row: pairs of documents of one group, and how many of them lie on two shards."""
    counts = placed.groupBy(group, "shard").agg(F.count("*").alias("n"))
    whole = counts.groupBy(group).agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("kept"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return whole.agg(F.sum(pairs).alias("pairs"), F.sum(pairs - F.col("kept")).alias("cut"))

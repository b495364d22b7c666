"""Sharding by balanced label propagation, in Spark joins.

Documents are linked through hubs, never pair by pair: one hub for each text
and one for each line, of any length but not blank, that several documents
share.  A document's leading hub is its largest one that fits a shard.
Documents start in the shard that their text hashes to.  In each round the members
of every hub are counted by shard, a hub gives each shard the share of the other
members there, each document sums the shares over all its hubs and asks to
move to the shard with the largest sum, if that is larger than its own shard's.
Even rounds move documents to higher shards, odd ones to lower, so linked documents do
not swap places.  The requests between shards are reduced on the driver (a table
of shards x shards) until no shard exceeds its quota, and that share of
each request moves, documents of one leading hub together.  Rounds end when two in
a row leave no more links uncut, or after ``rounds``; the best placement counts.
A last pass makes the row counts exact: shards with too many rows hand over
unlinked documents first, then those whose hubs are all too large for one shard,
then others, to the shards that lack rows.

Law: ``rows`` - counts differ by one at most.

Cases: a null text has no bytes, size 8, CRC 0, and counts as an empty text, as
do all others without a line that is not blank; these are linked as equal texts.
Ties between shards go by a hash that a leading hub's rows share.  Repeated rows
and null ids are rows like others; other columns are ignored.  A very long text
is split into lines in its own row.  With fewer rows than shards some shards stay
empty; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from countloom.llm._spark import cut, forget, table

SHARDS = 24
ROUNDS = 8
#: Share by which a shard may exceed the mean between rounds.
SLACK = 0.05
#: Places that a shard's rows are ranked in side by side; with the shards they bound the table of counts.
BUCKETS = 128
#: Rows of a large hub are ranked in so many places.
SALTS = 32
_ONE = float(1 << 40)  #: shares are added up as whole numbers, so that sums do not depend on their order


def _uniform(*columns: Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _quota(requests: np.ndarray, load: np.ndarray, most: float) -> np.ndarray:
    """The largest shares of the requests, scaled target by target, that keep every shard within ``most``."""
    moved = requests.astype(float)
    for _ in range(100):
        incoming = moved.sum(axis=0)
        room = np.maximum(0, most - load + moved.sum(axis=1))
        over = incoming > room + 1e-9
        if not over.any():
            break
        moved[:, over] *= (room[over] / incoming[over])[None, :]
    return moved / np.maximum(requests, 1)


def _links(base: DataFrame) -> DataFrame:
    """(rid, hub, members) for every text and line that two rows or more hold."""
    held = base.select("rid", F.explode("hubs").alias("hub"))
    return cut(held.join(held.groupBy("hub").agg(F.count("*").alias("members")).where("members > 1"), "hub").select("rid", "hub", "members"))


def _with_lead(base: DataFrame, links: DataFrame, large: float) -> DataFrame:
    """``base`` with (lead, members, linked): the largest hub of a row that fits a shard, by which rows move and rank together."""
    lead = F.max(F.when(F.col("members") <= large, F.struct("members", "hub")))
    led = links.groupBy("rid").agg(lead.alias("l"), F.lit(True).alias("linked")).select("rid", F.col("l.hub").alias("lead"), "l.members", "linked")
    return base.drop("hubs").join(led, "rid", "left")


def _votes(state: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the links with their rows' shards, for each hub the members by shard)."""
    placed = cut(links.join(state.select("rid", "lead", "shard"), "rid"))
    votes = placed.groupBy("hub", "members", "shard").agg(F.count("*").alias("n"))
    return placed, cut(votes.groupBy("hub", "members").agg(F.collect_list(F.struct(F.col("shard").alias("to"), "n")).alias("votes")))


def _uncut(votes: DataFrame) -> int:
    """The links within shards, those of a hub weighed by 1 / (members - 1)."""
    here = votes.select("members", F.explode("votes").alias("v")).select("members", "v.n")
    return here.agg(F.sum((F.col("n") * (F.col("n") - 1) / (F.col("members") - 1) * 1024).cast("long"))).first()[0] or 0


def _wanted(placed: DataFrame, votes: DataFrame) -> DataFrame:
    """(rid, to): the shard with the largest sum of the other members' shares over all hubs of a row, the own one if none has more."""
    cast = placed.join(votes.select("hub", "votes"), "hub").select("rid", F.xxhash64("lead").alias("lead"), "shard", "members", F.explode("votes").alias("v"))
    others = F.col("v.n") - (F.col("v.to") == F.col("shard")).cast("long")
    share = F.floor(others / (F.col("members") - 1) * F.lit(_ONE))
    summed = cast.groupBy("rid", "lead", "shard", "v.to").agg(F.sum(share).alias("sum"))
    return summed.groupBy("rid").agg(F.max(F.struct("sum", (F.col("to") == F.col("shard")).alias("own"), F.xxhash64("lead", "to").alias("tie"), "to")).getField("to").alias("to"))


def propagate(state: DataFrame, placed: DataFrame, votes: DataFrame, shards: int, slack: float, number: int) -> DataFrame:
    """One round: ``state`` with linked rows moved towards the shards that their hubs favour."""
    spark = state.sparkSession
    onward = F.col("to") > F.col("shard") if number % 2 == 0 else F.col("to") < F.col("shard")
    asked = state.join(_wanted(placed, votes), "rid", "left")
    asked = cut(asked.select(*state.columns, F.when(onward, F.col("to")).otherwise(F.col("shard")).alias("to"), _uniform(F.coalesce("lead", F.col("rid")), F.lit(number)).alias("u")))
    flows = asked.groupBy("shard", "to").agg(F.count("*").alias("n")).collect()
    requests, load = np.zeros((shards, shards)), np.zeros(shards)
    for r in flows:
        load[r.shard] += r.n
        if r.to != r.shard:
            requests[r.shard, r.to] = r.n
    share = _quota(requests, load, load.sum() / shards * (1 + slack) + 1)
    allowed = spark.createDataFrame([(i, j, float(share[i, j])) for i in range(shards) for j in range(shards) if share[i, j] > 0], "shard int, to int, share double")
    moved = asked.join(F.broadcast(allowed), ["shard", "to"], "left")
    new = cut(moved.withColumn("shard", F.when(F.col("u") < F.coalesce("share", F.lit(0.0)), F.col("to")).otherwise(F.col("shard"))).select(*state.columns))
    forget(asked)
    return new


def assign(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, slack: float = SLACK, text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, n_links, n_cut) of every row of ``docs``; the last two count the other members of its hubs."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda s: F.trim(s) != "")
    base = cut(docs.select(
        F.monotonically_increasing_id().alias("rid"),
        "doc_id",
        (F.octet_length(t) + 8).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        F.xxhash64(t).alias("same"),
        F.array_distinct(F.concat(F.array(F.xxhash64(t)), F.transform(lines, lambda s: F.xxhash64(s, F.lit("line"))))).alias("hubs"),
    ))
    links = _links(base)
    state = _with_lead(base, links, base.count() / shards / 2)
    state = cut(state.withColumn("shard", F.pmod(F.xxhash64("same", F.lit(-1)), F.lit(shards)).cast("int")))
    forget(base)
    best, most, idle, number = state, -1, 0, 0
    while True:
        placed, votes = _votes(state, links)
        uncut = _uncut(votes)
        idle = 0 if uncut > most else idle + 1
        if uncut > most:
            best, most = state, uncut
        if idle == 2 or number == rounds:
            break
        state = propagate(state, placed, votes, shards, slack, number)
        forget(placed)
        forget(votes)
        number += 1
    out = cut(_balance(best, shards))
    placed, votes = _votes(out.withColumn("lead", F.lit(None)), links)
    here = F.aggregate(F.filter("votes", lambda v: v["to"] == F.col("shard")), F.lit(0).cast("long"), lambda n, v: n + v["n"])
    linked = placed.join(votes.select("hub", "votes"), "hub").groupBy("rid").agg(F.sum(F.col("members") - 1).alias("n_links"), F.sum(F.col("members") - here).alias("n_cut"))
    none = F.lit(0).cast("long")
    return out.join(linked, "rid", "left").withColumns({"n_links": F.coalesce("n_links", none), "n_cut": F.coalesce("n_cut", none)}).drop("rid")


def _balance(state: DataFrame, shards: int) -> DataFrame:
    spark = state.sparkSession
    hub = F.col("lead")
    load = {r.shard: r.n for r in state.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    rows = sum(load.values())
    kind = F.when(F.col("linked").isNull(), 0).when(hub.isNull(), 1).otherwise(2)
    # A hub of more rows than a place holds on average is dealt over places of its own bucket.
    large = F.coalesce(F.col("members") > rows / shards / BUCKETS, F.lit(False))
    salt = F.when((kind == 1) | large, F.pmod(F.xxhash64("rid", F.lit(1)), F.lit(SALTS))).otherwise(0)
    place = F.when(kind == 1, 0).otherwise(F.pmod(F.xxhash64(F.coalesce(hub, F.col("rid"))), F.lit(BUCKETS))) * SALTS + salt
    ranked = cut(state.select("rid", "doc_id", "size", "text_crc32", "shard", (kind * BUCKETS * SALTS + place).cast("int").alias("place"), F.xxhash64(F.coalesce(hub, F.col("rid"))).alias("near")))
    # Counts by shard and place: at most shards x 3 x BUCKETS x SALTS rows, most of them absent, whatever the input.
    counts = sorted((r.shard, r.place, r.n) for r in ranked.groupBy("shard", "place").agg(F.count("*").alias("n")).collect())
    first, before = [], {}
    for shard, at, n in counts:
        first.append((shard, at, before.get(shard, 0)))
        before[shard] = before.get(shard, 0) + n
    order = sorted(range(shards), key=lambda s: (-load.get(s, 0), s))
    target = {s: rows // shards + (k < rows % shards) for k, s in enumerate(order)}
    given, taken, pool, spots = {}, [], 0, 0
    for s in range(shards):
        extra = load.get(s, 0) - target[s]
        given[s] = (max(0, extra), pool)
        pool += max(0, extra)
        if extra < 0:
            taken.append((spots, spots - extra, s, load.get(s, 0)))
            spots -= extra
    starts = spark.createDataFrame([(s, at, n, *given[s]) for s, at, n in first], "shard int, place int, first long, gives long, pool long")
    rank = F.row_number().over(Window.partitionBy("shard", "place").orderBy("near", "rid")) - 1
    ranked = ranked.withColumn("rank", rank).join(F.broadcast(starts), ["shard", "place"])
    at = F.col("first") + F.col("rank")
    goes, spot = at < F.col("gives"), F.col("pool") + at
    to, slot = F.col("shard"), at - F.col("gives")
    for low, high, s, held in taken:
        here = goes & (spot >= low) & (spot < high)
        to, slot = F.when(here, F.lit(s)).otherwise(to), F.when(here, spot - low + held).otherwise(slot)
    return ranked.select("rid", "doc_id", "size", "text_crc32", to.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    placed = assign(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "n_links", "n_cut")


QUERIES = {"op4_sharding": op4_sharding}
ORACLE_SQL: dict[str, str] = {}

"""Exact components of a similarity graph from candidate buckets; DataFrame functions only.

Two ids are candidates if they share a bucket.  All pairs of a bucket are never
emitted.  Instead each round takes a few hubs of every bucket and tests every
other member of another component against them on full sets; then a hub has
met all of its bucket and leaves it.  Buckets whose members have all come
together leave too.  Where what is left are small buckets, or few pairs within
the bounds below, a last round takes every member as a hub.  Hubs are the members that stand in the largest buckets,
i.e. the centres of groups of copies, so that a group of thousands is mostly
joined after one round; the hubs per bucket grow eightfold each round, so that a
bucket that never joins is still tested completely.  No link between candidates
is lost and nothing is capped.

What is left after a round is thinned by an exact bound, as in prefix-filtered
set joins: elements of a set that no other remaining set holds cannot be in any
intersection, so a set whose shared elements are too few for the similarity
cannot have a partner any more, and a pair is tested only if the smaller shared
mass allows the link.

Members may bring a ``sketch``, the parities of how many elements fall on each
of some bits.  Every bit in which two sketches differ needs an element that one
of the sets lacks, so a pair with too many such bits cannot link and is not made:
members of a bucket that only resemble each other do not meet pair by pair.  The
bound by shared elements is not taken then.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.components import connected_components
from ..plans.lineage import Scratch

#: Buckets of so many members, weighted by members, are tested in one round.
FEW = 64
#: The same where sketches decide: they cost no join and no set.
SKETCHED = 1024
#: Pairs of members, before any bound, that may be made only to count those within the bounds.
COUNTED = 1 << 25
#: Tables of a round are broadcast if they are counted and have so many rows at most.
BROADCAST_ROWS = 50_000


def small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def linked_components(members: DataFrame, sets: DataFrame | Callable, percent: int, max_rounds: int = 60, check: Callable | None = None) -> DataFrame:
    """``(id, component)`` for the ids of ``members`` that share a bucket with another.

    members: ``(bucket, id, n)`` with n the set's size, and perhaps ``sketch``, a
    struct of longs (n and sketch may be null there, which bounds nothing), and ``crowd``, the bucket's members, where that is known.  sets: ``(id, items)``, or
    a function from a table of ids to it.  Two ids are linked if ``100 *
    intersection >= percent * union``; ``check`` may replace the test of pairs
    ``(a, b, ca, cb)`` where sets are larger than what they are made from.
    """
    scratch = Scratch(members.sparkSession)
    cut = scratch.cut
    sketch = ["sketch"] if "sketch" in members.columns else []
    if "crowd" in members.columns:
        held = members
    else:
        crowd = members.groupBy("bucket").agg(F.count("*").alias("crowd")).where("crowd > 1")
        held = cut(members.join(crowd, "bucket"), "members")
    weight = cut(held.groupBy("id").agg(F.sum("crowd").alias("weight"), F.collect_set("bucket").alias("keys")), "weight")
    labels = cut(weight.select("id", F.col("id").alias("comp")), "labels")
    live = held.join(small(weight), "id").select("bucket", "id", "n", F.col("n").alias("mass"), "weight", "keys", F.col("id").alias("comp"), *sketch)
    live = cut(live, "live")
    of = sets if callable(sets) else lambda ids: sets.join(ids, "id", "left_semi")
    check = check or (lambda pairs: verify(pairs, sets, percent))
    tested: list[DataFrame] = []
    slots = 1
    for _ in range(max_rounds):
        scratch.release(but=(live, labels, *tested))
        if live.isEmpty():
            break
        hubs = live.groupBy("bucket", F.pmod(F.xxhash64("id"), F.lit(slots)).alias("slot")).agg(
            F.max(F.struct("weight", F.xxhash64("id").alias("h"), "id", "n", "mass", "comp", *sketch)).alias("m")
        ).select("bucket", F.col("m.id").alias("hub"), F.col("m.n").alias("hn"), F.col("m.mass").alias("hm"), F.col("m.comp").alias("hc"), *(F.col("m.sketch").alias("hsketch") for _ in sketch))
        hubs = cut(hubs, "hubs")
        # a pair meets in every bucket that both are in; it is made in the first one that has the hub
        own = hubs.groupBy("hub").agg(F.collect_set("bucket").alias("hkeys"))
        near = hubs.count() <= BROADCAST_ROWS
        if near:
            own = F.broadcast(own)
        hubs_own = hubs.join(own, "hub")
        bounds = within(percent)
        if sketch:
            near_enough = unlike(members.schema["sketch"].dataType.names) * (100 + percent) <= (F.col("n") + F.col("hn")) * (100 - percent)
            bounds &= F.coalesce(near_enough, F.lit(True))
        met = live.join(F.broadcast(hubs_own) if near else hubs_own, "bucket").where(bounds & (F.array_min(F.array_intersect("keys", "hkeys")) == F.col("bucket")))
        first = F.col("id") < F.col("hub")
        pairs = met.select(
            F.least("id", "hub").alias("a"),
            F.greatest("id", "hub").alias("b"),
            F.when(first, F.col("comp")).otherwise(F.col("hc")).alias("ca"),
            F.when(first, F.col("hc")).otherwise(F.col("comp")).alias("cb"),
        ).distinct()
        if tested:
            known = reduce(DataFrame.unionByName, tested).select("a", "b")
            pairs = pairs.join(small(known), ["a", "b"], "left_anti")
        pairs = cut(pairs, "pairs")
        linked = cut(check(pairs), "links")
        tested.append(pairs)
        done = hubs.select("bucket", F.col("hub").alias("id"))
        left = live.join(F.broadcast(done) if near else done, ["bucket", "id"], "left_anti")
        if not linked.isEmpty():
            moved = cut(connected_components(linked, "ca", "cb").withColumnRenamed("id", "comp").withColumnRenamed("component", "to"), "moved")
            to = small(moved)
            renew = lambda df: df.join(to, "comp", "left").withColumn("comp", F.coalesce("to", "comp")).drop("to")
            labels = cut(renew(labels).select("id", "comp"), "labels")
            left = renew(left)
        left = cut(left.select("bucket", "id", "n", "mass", "weight", "keys", "comp", *sketch), "left")
        scratch.release(but=(left, labels, *tested))
        live, open_ = unsettled(left, cut)
        size = open_.agg(F.sum(F.col("c") * F.col("c")).alias("all"), F.sum("c").alias("rows")).first()
        if size["rows"] is None:
            break
        # as many hubs as members where that is work in proportion to the members; else the bound first
        if size["all"] <= (SKETCHED if sketch else FEW) * size["rows"]:
            slots = 1 << 30
        elif sketch:
            slots *= 8
        else:
            live, open_ = feasible(live, open_, of, percent, cut)
            slots = 1 << 30 if few_pairs(live, open_, percent) else slots * 8
    else:
        raise RuntimeError(f"buckets did not settle in {max_rounds} rounds")
    scratch.release(but=(labels,))
    return labels.withColumnRenamed("comp", "component")


def unsettled(left: DataFrame, cut) -> tuple[DataFrame, DataFrame]:
    """Members of buckets that hold two components or more, and ``(bucket, c, low)`` of these buckets."""
    per = left.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c"), F.min("n").alias("low"))
    open_ = cut(per.where("lo < hi").select("bucket", "c", "low"), "open")
    return cut(left.join(small(open_.select("bucket")), "bucket", "left_semi"), "live"), open_


def feasible(live: DataFrame, open_: DataFrame, of: Callable, percent: int, cut) -> tuple[DataFrame, DataFrame]:
    """Members that can still have a partner in another component of their bucket, and these buckets."""
    ids = cut(live.select("id").distinct(), "ids")
    items = cut(of(small(ids)).select("id", F.explode("items").alias("item")), "items")
    shared = items.groupBy("item").agg(F.count("*").alias("c")).where("c > 1").select("item")
    mass = cut(items.join(shared, "item", "left_semi").groupBy("id").agg(F.count("*").alias("m")), "mass")
    held = live.drop("mass").join(small(mass), "id").join(small(open_.select("bucket", "low")), "bucket")
    least = F.greatest("low", F.ceil(F.col("n") * percent / 100))
    held = held.where((F.col("m") * (100 + percent)) >= (F.col("n") + least) * percent)
    held = cut(held.select("bucket", "id", "n", F.col("m").alias("mass"), "weight", "keys", "comp"), "held")
    return unsettled(held, cut)


def few_pairs(live: DataFrame, open_: DataFrame, percent: int) -> bool:
    """Whether the pairs within the bounds are in proportion to the members; counted only where that is little work."""
    size = open_.agg(F.sum(F.col("c") * F.col("c")).alias("all"), F.sum("c").alias("rows")).first()
    if size["rows"] is None or size["all"] <= FEW * size["rows"]:
        return True
    if size["all"] > COUNTED or size["rows"] > BROADCAST_ROWS:
        return False
    hubs = live.select("bucket", F.col("n").alias("hn"), F.col("mass").alias("hm"), F.col("comp").alias("hc"))
    met = live.join(F.broadcast(hubs), "bucket").where(within(percent))
    return met.count() <= FEW * size["rows"]


def within(percent: int):
    """The bounds on a member and a hub: other components, sizes and shared masses that allow a link."""
    sized = (F.least("n", "hn") * 100 >= F.greatest("n", "hn") * percent) & (
        F.least("mass", "hm") * (100 + percent) >= (F.col("n") + F.col("hn")) * percent
    )
    return (F.col("comp") != F.col("hc")) & (F.col("n").isNull() | F.col("hn").isNull() | sized)


def unlike(words: list[str]):
    """Bits in which the sketches of a member and of a hub differ; null where one has no sketch."""
    return reduce(lambda a, b: a + b, (F.bit_count(F.col(f"sketch.{w}").bitwiseXOR(F.col(f"hsketch.{w}"))) for w in words))


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs whose full sets reach the similarity."""
    left = sets.select(F.col("id").alias("a"), F.col("items").alias("xa"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("xb"))
    both = small(pairs).join(left, "a").join(right, "b")
    inter = F.size(F.array_intersect("xa", "xb"))
    sized = both.select("a", "b", "ca", "cb", inter.alias("i"), (F.size("xa") + F.size("xb")).alias("n"))
    return sized.where(f"100 * i >= {percent} * (n - i)").select("a", "b", "ca", "cb")

"""Components of alike sets: candidates that share a band, confirmed on their whole sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import BROADCAST_IDS, bounded, slices
from .components import connected_components

# Two sets are alike if they share at least ALIKE[0] of ALIKE[1] parts of their union.
ALIKE = (4, 5)
# Members of sets that one side of a comparison may hold, those that one task compares with a
# hub, and bytes of text whose sets are held at once.
GROUP, HUB_SHARE, SLICE_BYTES = 1 << 17, 1 << 21, 4 << 20
# Members of sets, and sets, that one task compares with each other as a family.
FAMILY, FAMILY_SETS = 1 << 20, 8192
# How often labels follow each other before companies are judged; each turn doubles the reach.
JUMPS = 2


def overlap_enough(shared, size, other):
    """Whether shared / (size + other - shared) is at least ALIKE, in whole numbers."""
    a, b = ALIKE
    return (a + b) * shared >= a * (size + other)


def set_digest(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def group_links(sets: list[np.ndarray], names: list[int], labels: list | None = None) -> list[tuple[int, int]]:
    """Links that join exactly what the pairs of alike sets join: a name and the least
    name of its group. Sets of one label are known to be joined; they are not compared."""
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    firsts: dict = {}
    groups = len(sets)
    for i, label in enumerate(labels or []):
        parent[i] = firsts.setdefault(label, i)
        groups -= parent[i] != i
    sizes = np.array([len(s) for s in sets])
    terms, place = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sets)), sizes)[np.argsort(place, kind="stable")]
    counts = np.bincount(place, minlength=len(terms))
    starts = np.cumsum(counts) - counts
    seen = {root(0)}
    for i in range(1, len(sets)):
        if groups == 1:
            break
        mine = root(i)
        if seen == {mine}:
            continue
        if len(seen) == 1 and overlap_enough(len(np.intersect1d(sets[0], sets[i], assume_unique=True)), sizes[0], sizes[i]):
            # All before are one group: a member that is like the first needs no other link.
            parent[mine] = root(0)
            groups -= 1
            seen = {root(0)}
            continue
        terms_of = place[ends[i] - sizes[i] : ends[i]]
        many = counts[terms_of]
        at = np.arange(many.sum()) + np.repeat(starts[terms_of] - (np.cumsum(many) - many), many)
        shared = np.bincount(owner[at], minlength=len(sets))[:i]
        seen.add(mine)
        for j in np.flatnonzero(overlap_enough(shared, sizes[i], sizes[:i])).tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[a] = b
                groups -= 1
        seen = {root(r) for r in seen}
    least: dict[int, int] = {}
    for i, name in enumerate(names):
        least[root(i)] = min(name, least.get(root(i), name))
    return [(name, least[root(i)]) for i, name in enumerate(names) if name != least[root(i)]]


def _near_hub(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (hub, share, role, node, name, hub_name, hashes), each hub's own (role 0)
    before the others of its share, that are like their hub."""
    hub, own = None, np.zeros(0, np.uint64)
    for batch in batches:
        keep = []
        for key, share, role, hashes in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(6)):
            found = np.frombuffer(hashes.as_py(), np.uint64)
            if role == 0:
                hub, own = (key, share), found
            fine = role == 1 and hub == (key, share)
            keep.append(fine and overlap_enough(len(np.intersect1d(own, found, assume_unique=True)), len(own), len(found)))
        yield batch.filter(pa.array(keep, pa.bool_())).select(["node", "name", "hub", "hub_name"])


def _near_each_other(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the groups that come one after the other: (key, low, high, name, label, hashes)."""
    group, names, labels, sets = None, [], [], []

    def done() -> Iterator[pa.RecordBatch]:
        if len(sets) > 1:
            columns = list(zip(*group_links(sets, names, labels))) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])

    for batch in batches:
        for key, low, high, name, label, hashes in zip(*(c.to_pylist() for c in batch.columns[:5]), batch.column(5)):
            if (key, low, high) != group:
                yield from done()
                group, names, labels, sets = (key, low, high), [], [], []
            names.append(name)
            labels.append(label)
            sets.append(np.frombuffer(hashes.as_py(), np.uint64))
    yield from done()


def linked_sets(own: DataFrame, saved: DataFrame, sets_of: Callable[[pa.Array], list[np.ndarray]], group: int = GROUP, hub_share: int = HUB_SHARE, family: int = FAMILY) -> DataFrame:
    """(digest, component) of every distinct set of ``saved`` (doc_id, digest, size, keys):
    sets link that share one of their keys and are alike; a set is named by its smallest
    doc_id, and component is the smallest name reachable. ``own`` (doc_id, text) gives the
    texts again and ``sets_of`` their sets, as ascending 64-bit hashes.

    Equal sets are one node, so copies cost nothing. Only texts that share a key with another
    set are read a second time, and only sets are sent, each of them about twice:

    - each goes to its hub, the first of all nodes it shares a key with, and is compared with
      it; a hub with many followers is sent to several tasks. A company (the nodes of one
      key) whose members all follow one hub is settled;
    - companies that are not settled and share a node are a family. A family of up to
      ``family`` members of sets is compared by one task;
    - in a larger one every two sets of a company that do not follow the same hub are compared,
      once for each different company; a company of more than ``group`` members is dealt into
      parts and each pair of parts is compared by a task.

    So every pair that shares a key is either compared or already joined, and nothing is
    capped. Null ids name nothing.
    """
    distinct = saved.where(F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("name"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    reps = materialise(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct")
    met = reps.select(F.explode(F.array_distinct("keys")).alias("key"), "node")
    least = met.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last")
    shared = materialise(met.join(least.drop("last"), "key"), "shared")
    involved = materialise(shared.select("node").distinct().join(reps.drop("keys"), "node"), "involved")
    sets = materialise(_sets_again(own, involved, sets_of), "sets")

    size, name = involved.select("node", "size", "name"), involved.select(F.col("node").alias("hub"), F.col("name").alias("hub_name"))
    pairs = materialise(shared.where("hub < node").groupBy("node").agg(F.min("hub").alias("hub")).join(size, "node").join(name, "hub"), "pairs")
    shares = pairs.groupBy("hub").agg(F.ceil(F.sum("size") / hub_share).cast("long").alias("shares"))
    place = F.pmod(F.xxhash64("node"), F.col("shares"))
    followers = pairs.join(shares, "hub").select("hub", place.alias("share"), F.lit(1).alias("role"), "node", "name", "hub_name")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))
    hubs = shares.select("hub", copies.alias("share"), F.lit(0).alias("role"), F.col("hub").alias("node"), F.lit(None).cast("long").alias("name"), F.lit(None).cast("long").alias("hub_name"))
    sent = followers.union(hubs).join(sets, "node").select("hub", "share", "role", "node", "name", "hub_name", "hashes")
    compared = sent.repartition("hub", "share").sortWithinPartitions("hub", "share", "role").mapInArrow(_near_hub, "node long, name long, hub long, hub_name long")
    near = materialise(compared, "near")

    labels = near.select("node", F.col("hub").alias("label"))
    for _ in range(JUMPS):
        further = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = materialise(labels.join(further, "label", "left").select("node", F.coalesce("next", "label").alias("label")), "labels")
    labelled = shared.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    unsettled = labelled.groupBy("key").agg(F.min("label").alias("first"), F.max("label").alias("last"), F.min("node").alias("a")).where(F.col("first") != F.col("last"))
    open_ones = materialise(labelled.join(unsettled.select("key", "a"), "key").join(size, "node"), "unsettled")
    families = connected_components(open_ones.select("a", F.col("node").alias("b")).distinct())
    member = open_ones.select("node", "name", "size", "label").distinct().join(families, "node")
    totals = member.groupBy("component").agg((F.sum("size") <= family).alias("small_sum"), (F.count("*") <= FAMILY_SETS).alias("small_count"))
    judged = materialise(member.join(totals.select("component", F.expr("small_sum AND small_count").alias("small")), "component"), "families")
    whole = judged.where("small").select(F.col("component").alias("key"), F.lit(-1).cast("long").alias("low"), F.lit(-1).cast("long").alias("high"), "node", "name", "label")

    large = open_ones.join(judged.where("NOT small").select("node"), "node", "left_semi")
    company = [F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")]
    companies = large.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("total"), *company)
    once = companies.groupBy("n", "total", "x", "y").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("total") / group).cast("long").alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    dealt = large.join(once, "key").select("*", part.alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    members = dealt.select("key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "node", "name", "label")

    others = whole.union(members).join(sets, "node").select("key", "low", "high", "name", "label", "hashes")
    grouped = others.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "name")
    links = near.select(F.col("hub_name").alias("a"), F.col("name").alias("b")).union(grouped.mapInArrow(_near_each_other, "a long, b long"))
    linked = connected_components(links)
    return reps.join(linked, reps["name"] == linked["node"], "left").select("digest", F.coalesce("component", "name").alias("component"))


def _sets_again(own: DataFrame, involved: DataFrame, sets_of: Callable[[pa.Array], list[np.ndarray]]) -> DataFrame:
    """(node, hashes): the sets of the nodes, made again from their texts. Where the ids may
    be broadcast, no other texts are sent."""

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch, "text", SLICE_BYTES)):
            sets = sets_of(part.column(1))
            columns = [pa.array([set_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["digest", "hashes"])

    wanted = materialise(involved.select(F.col("name").alias("doc_id")).distinct(), "wanted")
    read = own.join(bounded(wanted, BROADCAST_IDS), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(again, "digest binary, hashes binary")
    return read.dropDuplicates(["digest"]).join(involved.select("digest", "node"), "digest").select("node", "hashes")

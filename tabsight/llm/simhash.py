"""SimHash near-duplicates: fingerprints of word shingles, linked through BK-trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import texts
from .components import connected_components

BITS = 64
# Words whose shingles are hashed at once, and fingerprints that one tree may hold.
CHUNK_WORDS, TREE_SIZE = 65_536, 2048
SEED = 42


def fingerprint(text: str, shingle: int = 3) -> int:
    """Bit i is 1 if it is in over half of the shingles' XXH64; 0 without words.

    Words are what ASCII white space parts, A-Z lower-cased; a text of fewer words than a
    shingle is one shingle.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = max(1, len(words) - shingle + 1) if words else 0
    counts = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK_WORDS):
        part = words[at : min(n, at + CHUNK_WORDS) + shingle - 1]
        runs = zip(*(part[i:] for i in range(shingle))) if len(part) >= shingle else [part]
        hashes = np.array([digest(b" ".join(run), seed=SEED) for run in runs], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little") if n else 0


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every whole text; fp is the fingerprint as a signed long."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return texts(docs).mapInArrow(take, "doc_id long, fp long")


class Tree:
    """A BK-tree of fingerprints: children are keyed by their Hamming distance to the parent."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int, radius: int) -> list[int]:
        """Puts a value in; returns the places of those within the radius before it.

        For the search only the edges from distance - radius to distance + radius are
        followed, as the triangle inequality allows.
        """
        values, children = self.values, self.children
        near = []
        if values:
            todo = [0]
            while todo:
                at = todo.pop()
                d = (values[at] ^ value).bit_count()
                if d <= radius:
                    near.append(at)
                for edge, child in children[at].items():
                    if d - radius <= edge <= d + radius:
                        todo.append(child)
            at = 0
            while True:
                d = (values[at] ^ value).bit_count()
                if d not in children[at]:
                    children[at][d] = len(values)
                    break
                at = children[at][d]
        values.append(value)
        children.append({})
        return near


def shard_links(values: list[int], names: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that join exactly what the shard's links within the radius join: a name
    and the least name of its group."""
    tree, parent = Tree(), list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, value in enumerate(values):
        for j in tree.add(value, radius):
            a, b = root(i), root(j)
            if a != b:
                low, high = (a, b) if names[a] < names[b] else (b, a)
                parent[high] = low
    return [(names[i], names[root(i)]) for i in range(len(values)) if root(i) != i]


def quarters(mask: int, parts: int) -> list[int]:
    """The mask with one of so many equal parts of its missing bits added, for each part."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    cuts = [len(free) * k // parts for k in range(parts + 1)]
    return [mask | sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:])]


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def fingerprint_links(reps: DataFrame, radius: int, tree_size: int = TREE_SIZE) -> DataFrame:
    """Links (a, b) of distinct fingerprints (fp, name) that join what differs in at most
    ``radius`` bits, directly or by steps.

    Two such fingerprints agree on one of radius + 1 parts of their bits, so a shard holds
    those that agree on a part. Shards of more than ``tree_size`` fingerprints are divided
    in the same way by their other bits, again and again; at last so many bits are fixed
    that no shard can be larger. So any hot part is split, and nothing is left out. Each
    shard's tree is built, and asked, where an exchange has brought its rows together.
    """
    masks = quarters(0, radius + 1)
    level = F.array(*[F.lit(signed(m)) for m in masks])
    active = reps.select("fp", "name", F.explode(level).alias("mask")).withColumn("part", F.col("fp").bitwiseAND(F.col("mask")))
    shards = []
    while True:
        if 2 ** (BITS - min(m.bit_count() for m in masks)) <= tree_size:
            shards.append(active)
            break
        hot = materialise(active.groupBy("mask", "part").count().where(F.col("count") > tree_size).select("mask", "part"), "hot")
        # The masks of a level are few; only those with a hot shard go on.
        masks = [r["mask"] % (1 << BITS) for r in hot.select("mask").distinct().collect()]
        if not masks:
            shards.append(active)
            break
        shards.append(active.join(hot, ["mask", "part"], "left_anti"))
        finer = [(signed(m), signed(k)) for m in masks for k in quarters(m, radius + 1)]
        steps = F.broadcast(reps.sparkSession.createDataFrame(finer, "mask long, finer long"))
        divided = active.join(hot, ["mask", "part"], "left_semi").join(steps, "mask").select("fp", "name", F.col("finer").alias("mask"))
        active = materialise(divided.distinct().withColumn("part", F.col("fp").bitwiseAND(F.col("mask"))), "finer")
        masks = sorted({k % (1 << BITS) for _, k in finer})
    rows = shards[0]
    for s in shards[1:]:
        rows = rows.unionByName(s)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] | None = None

        def done(mask, part, fp, name) -> list[tuple[int, int]]:
            edges = np.flatnonzero((mask[1:] != mask[:-1]) | (part[1:] != part[:-1])) + 1
            bounds = np.concatenate([[0], edges, [len(mask)]])
            out = []
            for k in np.flatnonzero(np.diff(bounds) > 1):
                a, b = bounds[k], bounds[k + 1]
                out += shard_links(fp[a:b].view(np.uint64).tolist(), name[a:b].tolist(), radius)
            return out

        def batch_of(found):
            columns = list(zip(*found)) or [[], []]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])

        for batch in batches:
            now = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            if held is not None:
                now = tuple(np.concatenate(x) for x in zip(held, now))
            if not len(now[0]):
                continue
            # The last shard may go on in the next batch.
            last = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
            keep = last[-1] + 1 if len(last) else 0
            if keep:
                yield batch_of(done(*(x[:keep] for x in now)))
            held = tuple(x[keep:] for x in now)
        if held is not None:
            yield batch_of(done(*held))

    dealt = rows.select("mask", "part", "fp", "name").repartition("mask", "part").sortWithinPartitions("mask", "part", "fp")
    return dealt.mapInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, tree_size: int = TREE_SIZE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every whole text: fingerprints of at most
    ``radius`` differing bits link, and component_id is the smallest doc_id reachable.

    Only distinct fingerprints, each named by its smallest doc_id, go into trees and
    components, so copies cost nothing there. Null and empty texts have fingerprint zero
    and link like any other; repeated rows are repeated. A null id names nothing: its row
    belongs to the component of its fingerprint if other documents have that, else to none
    (null). An empty table gives no rows.
    """
    saved = materialise(fingerprints(docs, shingle), "fingerprints")
    reps = materialise(saved.where(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("name")), "distinct")
    linked = connected_components(fingerprint_links(reps, radius, tree_size))
    named = reps.join(linked, reps["name"] == linked["node"], "left").select("fp", F.coalesce("component", "name").alias("component_id"))
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return saved.join(named, "fp", "left").select("doc_id", shown.alias("fingerprint"), "component_id")

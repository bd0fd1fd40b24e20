"""MinHash near-duplicates by fast similarity sketching."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import slices, texts
from .linking import GROUP, SLICE_BYTES, linked_sets, set_digest

SHINGLE, SEED = 2, 42
# A sketch has BANDS x ROWS coordinates. Candidates agree on all rows of a band: at a
# similarity of 0.8 no band agrees for (1 - 0.8 ** 4) ** 24 = 0.000003 of the pairs.
BANDS, ROWS = 24, 4
# Members of sets that are placed into bins at once.
CHUNK = 1 << 20
_VALUE_BITS = 44


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: every input bit changes every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Of each text, the different 64-bit hashes of its shingles, ascending. Words are what
    ASCII white space parts, A-Z lower-cased; fewer words than a shingle are one."""
    out = []
    for text in texts:
        words = text.as_py().encode("utf-8", "surrogatepass").lower().split()
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        size = min(shingle, len(words))
        runs = np.full(max(0, len(words) - size + 1) if size else 0, size, np.uint64)
        for i in range(size):
            runs = _mixed(runs + hashes[i : i + len(runs)])
        out.append(np.unique(runs))
    return out


def sketch(sets: list[np.ndarray], size: int = BANDS * ROWS, seed: int = SEED) -> np.ndarray:
    """Fast similarity sketches (a row a set): coordinates of two sets agree with the
    probability of their Jaccard similarity, all of them concentrated.

    In each of the first ``size`` rounds every member falls into a bin by hash and the least
    value of the round stays there; in round ``size`` + i all fall into bin i. Values of a
    later round are larger, so only bins that are still empty take them, and a set is done
    after the round in which its last bin fills: large sets after one or two, any set with
    members after at most twice ``size``.
    """
    empty = np.uint64((1 << 64) - 1)
    out = np.full((len(sets), size), empty, np.uint64)
    flat_out = out.reshape(-1)
    seeds = np.random.default_rng(seed).integers(0, 1 << 63, 2 * size, dtype=np.uint64)
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).astype(np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for turn in range(2 * size):
        if not len(flat):
            break
        for at in range(0, len(flat), CHUNK):
            drawn = _mixed(flat[at : at + CHUNK] ^ seeds[turn])
            if turn < size:
                bins = ((drawn >> np.uint64(_VALUE_BITS)) * np.uint64(size) >> np.uint64(64 - _VALUE_BITS)).astype(np.int64)
            else:
                bins = turn - size
            values = (drawn & np.uint64((1 << _VALUE_BITS) - 1)) | np.uint64(turn << _VALUE_BITS)
            np.minimum.at(flat_out, owner[at : at + CHUNK] * size + bins, values)
        going = (out == empty).any(axis=1)[owner]
        flat, owner = flat[going], owner[going]
    return out


def band_keys(sketches: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A digest for each band of each sketch, as signed longs; equal bands at different
    places have different digests."""
    parts = sketches.reshape(len(sketches), bands, -1)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2])
    for i in range(parts.shape[2]):
        keys = _mixed(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return keys.view(np.int64)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, group: int = GROUP) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every whole text: texts link whose sets of
    word shingles have a Jaccard similarity of 0.8 or more, component_id is the smallest
    doc_id reachable, and kept tells whether it is the text's own.

    Bands of fast similarity sketches give the candidates, whole sets confirm them (see
    ``linking.linked_sets``: no caps, no pairs of a group emitted). Null, empty and blank
    texts have an empty set, which links with nothing. Rows that repeat a doc_id are one
    node; a null id names nothing, so such a row has no component and stays. No documents
    give no rows.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch, "text", SLICE_BYTES)):
            sets = shingle_sets(part.column(1), shingle)
            keys = band_keys(sketch(sets)).tolist()
            columns = [
                part.column(0),
                pa.array([set_digest(s) for s in sets], pa.binary()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([k if len(s) else [] for k, s in zip(keys, sets)], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "size", "keys"])

    own = texts(docs)
    saved = materialise(own.mapInArrow(keyed, "doc_id long, digest binary, size long, keys array<long>"), "shingles")
    named = linked_sets(own, saved.where("size > 0"), lambda column: shingle_sets(column, shingle), group)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")
    out = saved.join(named, "digest", "left").select("doc_id", F.col("size").alias("n_shingles"), component)
    return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))

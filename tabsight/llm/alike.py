"""Texts whose word shingles are alike: exact Jaccard similarity of MinHash candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import slices, texts
from .linking import GROUP, SLICE_BYTES, group_links, linked_sets, set_digest  # noqa: F401

SHINGLE, SEED = 5, 42
# Candidates agree on all ROWS least hashes of one of BANDS: at a similarity of 0.8 all
# bands miss (1 - 0.8 ** 4) ** 20 = 0.00003 of the pairs.
BANDS, ROWS = 20, 4
# Shingles hashed at once for the bands.
CHUNK = 1024


def shingles(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """The different XXH64 of the shingles, ascending; words are cut as for a fingerprint,
    and a text of fewer words than a shingle is one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    runs = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else [words]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(run), seed=SEED) for run in runs), np.uint64))


def band_keys(hashes: np.ndarray) -> list[int]:
    """A key for each band: a digest of its ROWS least hashes."""
    turns = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) * 2 + 1
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), CHUNK):
        np.minimum(least, (hashes[at : at + CHUNK, None] * turns[0] + turns[1]).min(axis=0), out=least)
    digest = xxhash.xxh64_intdigest
    keys = [digest(band.tobytes(), seed=k) for k, band in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def alike_groups(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """(doc_id, component_id) of every whole text: texts link whose sets of five-word
    shingles have a Jaccard similarity of 0.8 or more, and component_id is the smallest
    doc_id reachable.

    Bands of MinHash give the candidates, whole sets confirm them (see
    ``linking.linked_sets``). Texts without words are alike. A null id names nothing, as in
    ``simhash.near_duplicates``.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch, "text", SLICE_BYTES)):
            sets = [shingles(t.as_py()) for t in part.column(1)]
            columns = [
                part.column(0),
                pa.array([set_digest(s) for s in sets], pa.binary()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([band_keys(s) if len(s) else [] for s in sets], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "size", "keys"])

    own = texts(docs)
    saved = materialise(own.mapInArrow(keys, "doc_id long, digest binary, size long, keys array<long>"), "shingles")
    named = linked_sets(own, saved, lambda column: [shingles(t.as_py()) for t in column], group)
    return saved.join(named, "digest", "left").select("doc_id", F.col("component").alias("component_id"))

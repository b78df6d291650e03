"""SimHash near duplicates, linked through BK-trees over shards of the fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwise.llm.common import cut
from bandwise.llm.components import connected_components

RADIUS = 2
SEED = 42
#: Shingles hashed at a time, so that one very long text needs no more memory than a short one.
SLICE = 1 << 16
#: Fingerprints in one shard, about: a tree of so many nodes takes a few milliseconds and under 100 KB.
SHARD = 4096


def fingerprint(text: bytes | None, words: int = 3) -> bytes:
    """8 bytes: a bit is set if it is set in over half the hashes of the shingles, repeats counted."""
    tokens = (text or b"").lower().split()  # of bytes: A-Z, and ASCII white space
    if not tokens:
        return bytes(8)
    words = min(words, len(tokens))
    count = len(tokens) - words + 1
    set_in = np.zeros(64, dtype=np.int64)
    for first in range(0, count, SLICE):
        part = tokens[first : first + SLICE + words - 1]
        joined = b" ".join(part)
        ends = np.cumsum([len(w) + 1 for w in part]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(part) - words + 1].tolist()
        ends = ends[words - 1 :].tolist()
        digest = xxhash.xxh64_digest
        hashes = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts, ends)])
        bits = np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8), axis=1)
        set_in += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(set_in * 2 > count).tobytes()


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """`_id`, `_fp` (the 64 bits as a long) of every row; null and empty texts have fingerprint zero."""
    slim = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text")
            found = b"".join([fingerprint(t.as_py(), words) for t in texts])
            longs = np.frombuffer(found, dtype=">u8").astype(np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(longs)], names=["_id", "_fp"])

    return slim.mapInArrow(run, f"_id {slim.schema['_id'].dataType.simpleString()}, _fp long")


class BKTree:
    """Distinct 64-bit values; each hangs below its parent on the edge numbered by their Hamming distance.

    Nodes are numbered level by level. A node's place is `parent * 65 + distance`; these places rise with the number,
    so the children of a node on a range of edges are one slice, found by binary search.
    """

    def __init__(self, values: np.ndarray):
        self.values = values
        items, places = [], []
        rest, group, base = np.arange(len(values)), np.zeros(len(values), dtype=np.int64), 0
        while len(rest):
            own, first, inverse = np.unique(group, return_index=True, return_inverse=True)
            items.append(rest[first])
            places.append(own)
            distance = np.bitwise_count(values[rest] ^ values[rest[first]][inverse]).astype(np.int64)
            stays = np.ones(len(rest), dtype=bool)
            stays[first] = False
            group = ((base + inverse) * 65 + distance)[stays]
            rest, base = rest[stays], base + len(own)
        self.items = np.concatenate(items) if items else np.empty(0, dtype=np.int64)
        self.places = np.concatenate(places) if places else np.empty(0, dtype=np.int64)
        self.places[:1] = -1  # the root hangs nowhere

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the query and of the value for every pair at most `radius` apart."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        query = np.arange(len(queries)) if len(self.items) else np.empty(0, dtype=np.int64)
        node = np.zeros(len(query), dtype=np.int64)
        while len(query):
            item = self.items[node]
            distance = np.bitwise_count(queries[query] ^ self.values[item]).astype(np.int64)
            hit = distance <= radius
            found.append((query[hit], item[hit]))
            low = np.searchsorted(self.places, node * 65 + np.maximum(distance - radius, 0), "left")
            high = np.searchsorted(self.places, node * 65 + np.minimum(distance + radius, 64), "right")
            count = high - low
            start = np.cumsum(count) - count
            node = np.arange(count.sum()) - np.repeat(start - low, count)
            query = np.repeat(query, count)
        if not found:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def forest(size: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of `size` nodes the smallest node it reaches over the links."""
    root = np.arange(size)
    while len(left):
        a, b = root[left], root[right]
        if (a == b).all():
            break
        low = np.minimum(a, b)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while (root[root] != root).any():
            root = root[root]
    return root


def _links(radius: int):
    """Links of one shard, as a forest: the smallest value each value reaches within the shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column("_fp").to_numpy(zero_copy_only=False) for b in batches]
        if not parts:
            return
        values = np.unique(np.concatenate(parts))
        bits = values.view(np.uint64)
        tree = BKTree(bits)
        left, right = [], []
        for first in range(0, len(bits), 1024):
            query, item = tree.within(bits[first : first + 1024], radius)
            query = query + first
            left.append(query[query < item])
            right.append(item[query < item])
        root = forest(len(values), np.concatenate(left or [[]]).astype(np.int64), np.concatenate(right or [[]]).astype(np.int64))
        own = np.flatnonzero(root != np.arange(len(values)))
        yield pa.RecordBatch.from_arrays([pa.array(values[own]), pa.array(values[root[own]])], names=["_a", "_b"])

    return run


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Links `_a`, `_b` that connect all distinct fingerprints `_fp` within `radius` of each other (a spanning forest a shard).

    The 64 bits are cut into `radius + 1` blocks. Two values at most `radius` apart agree in one block at least, so
    fingerprints are dealt to shards by the value of each block, and every shard's tree answers just the fingerprints
    dealt to it: the work grows with their number, not with its square. A block value held by more than `shard`
    fingerprints is split into pieces, and each pair of pieces is a shard of its own.
    """
    blocks = radius + 1
    edges = [64 * i // blocks for i in range(blocks + 1)]
    values = [F.shiftrightunsigned("_fp", low).bitwiseAND(F.lit((1 << (high - low)) - 1)) for low, high in zip(edges, edges[1:])]
    dealt = distinct.select("_fp", F.posexplode(F.array(*values)).alias("_block", "_value"))
    heavy = cut(dealt.groupBy("_block", "_value").agg(F.count("*").alias("_n")).filter(F.col("_n") > shard))
    joined = dealt.join(heavy, ["_block", "_value"], "left")
    pieces = F.ceil(F.coalesce("_n", F.lit(1)) / shard).cast("int")
    own = F.pmod(F.xxhash64("_fp"), pieces).cast("int")
    other = F.explode(F.sequence(F.lit(0), pieces - 1))
    cells = joined.select("_fp", "_block", "_value", own.alias("_own"), other.alias("_other")).select(
        "_fp", "_block", "_value", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j")
    )
    shards = max(1, -(-distinct.count() * blocks // shard))
    return cells.repartition(shards, "_block", "_value", "_i", "_j").mapInArrow(_links(radius), "_a long, _b long")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, radius: int = RADIUS, shard: int = SHARD
) -> DataFrame:
    """Every row's id with `fingerprint` (16 hex digits) and `component_id`, the smallest id reachable over links.

    Fingerprints at most `radius` bits apart are linked. Copies share one fingerprint and are linked through it, so the
    trees hold distinct fingerprints only. Null and empty texts share fingerprint zero and link like any other. A null
    id never is the smallest one; a group of null ids only has a null component. Repeated rows come back as often as
    they came; an empty table gives no rows. Other columns are not looked at.
    """
    rows = cut(fingerprints(docs, doc_id, text, words))
    firsts = cut(rows.groupBy("_fp").agg(F.min("_id").alias("_first")))
    groups = cut(connected_components(fingerprint_links(firsts.select("_fp"), radius, shard), "_a", "_b"))
    rooted = firsts.join(groups, firsts["_fp"] == groups["node"], "left")
    rooted = cut(rooted.select("_fp", F.coalesce("component", "_fp").alias("_root"), "_first"))
    least = cut(rooted.groupBy("_root").agg(F.min("_first").alias("component_id")))
    by_fingerprint = cut(rooted.join(least, "_root").select("_fp", "component_id"))
    return rows.join(by_fingerprint, "_fp").select(
        F.col("_id").alias(doc_id), F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id"
    )

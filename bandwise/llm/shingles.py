"""Near duplicates of word shingles: MinHash bands and SimHash BK-trees give candidates, exact Jaccard decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwise.llm.common import cut, stored
from bandwise.llm.components import connected_components
from bandwise.llm.simhash import BKTree

WORDS = 5
SIMILARITY = 0.8
#: Pairs at Jaccard 0.8 differ in 9.7 of 64 bits on average with a deviation of 2.9, so 22 is more than four deviations.
RADIUS = 22
#: A pair at Jaccard 0.8 shares one of 40 bands of 8 minima with probability 0.9994, one at 0.9 misses all with 1e-10.
BANDS, ROWS = 40, 8
#: Texts of a candidate group in one piece; each pair of pieces is a cell of its own.
PIECE = 512
SEED = 42
#: Shingles hashed, and shingles whose minima are taken, at a time.
SLICE, CHUNK = 1 << 16, 2048
#: Bits of the filter on texts whose sets are compared.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 26

_rng = np.random.default_rng(9)
FACTORS = _rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
SHIFTS = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
MIX = _rng.integers(0, 1 << 62, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct shingles; a shorter text is one shingle, a text without words has none."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return np.empty(0, dtype=np.uint64)
    words = min(words, len(tokens))
    count = len(tokens) - words + 1
    found = []
    for first in range(0, count, SLICE):
        part = tokens[first : first + SLICE + words - 1]
        joined = b" ".join(part)
        ends = np.cumsum([len(w) + 1 for w in part]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(part) - words + 1].tolist()
        digest = xxhash.xxh64_digest
        hashes = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts, ends[words - 1 :].tolist())])
        found.append(np.unique(np.frombuffer(hashes, dtype=">u8").astype(np.uint64)))
    return np.unique(np.concatenate(found)) if len(found) > 1 else found[0]


def set_fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half of the hashes."""
    set_in = np.zeros(64, dtype=np.int64)
    for first in range(0, len(hashes), SLICE):
        part = hashes[first : first + SLICE].astype(">u8").view(np.uint8).reshape(-1, 8)
        set_in += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_in * 2 > len(hashes)).view(">i8")[0])


def bands(hashes: np.ndarray) -> np.ndarray:
    """A number for each band of minima, that also depends on which band it is."""
    low = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    for first in range(0, len(low), CHUNK):
        part = (low[None, first : first + CHUNK] ^ SHIFTS[:, None]) * FACTORS[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    mixed = (least.reshape(BANDS, ROWS).astype(np.uint64) + np.uint64(1)) * MIX
    total = (mixed ^ (mixed >> np.uint64(29))).sum(axis=1, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * MIX[0]
    return (total * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _node_of(hashes: np.ndarray) -> int:
    """A number for a set of shingles."""
    return xxhash.xxh64_intdigest(hashes.tobytes(), 3) - (1 << 63)


def _sketch(words: int):
    """Map function: a number for the set of shingles, its fingerprint and its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                piece = batch.slice(first, 256)
                found = []
                for text in piece.column("_text"):
                    s = shingles(text.as_py(), words)
                    found.append((_node_of(s), set_fingerprint(s) if len(s) else 0, bands(s).tolist() if len(s) else []))
                made = [pa.array(x, kind) for x, kind in zip(zip(*found), (pa.int64(), pa.int64(), pa.list_(pa.int64())))]
                yield pa.RecordBatch.from_arrays([piece.column("_row"), piece.column("_body"), *made], names=["_row", "_body", "_node", "_fp", "_bands"])

    return run


def _sets(words: int, filter_bits):
    """Map function: the sets of texts whose hash passes a filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(filter_bits.value, dtype=np.uint8)
        mask = np.uint64(len(bits) * 8 - 1)
        for batch in batches:
            at = batch.column("_body").to_numpy(zero_copy_only=False).view(np.uint64) & mask
            good = np.flatnonzero(bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1))
            # Small pieces, as sets take as much room as their texts.
            for first in range(0, len(good), 256):
                sets = [shingles(batch.column("_text")[i].as_py(), words) for i in good[first : first + 256].tolist()]
                columns = [pa.array([_node_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["_node", "_set"])

    return run


def _filter_of(hashes: DataFrame, column: str) -> bytes:
    """A bit for each hash, gathered as words of 64 bits: 16 bits a hash, 8 MB at most. A full one only saves less work."""
    bits, wanted = LEAST_BITS, 16 * hashes.count()
    while bits < min(wanted, MOST_BITS):
        bits *= 2
    at = F.col(column).bitwiseAND(F.lit(bits - 1))
    set_bits = hashes.select(F.shiftright(at, 6).cast("int").alias("_word"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("_bit"))
    words = np.zeros(bits // 64, dtype=np.int64)
    # One job for all partitions; an iterator over rows would start one for each.
    found = set_bits.groupBy("_word").agg(F.bit_or("_bit").alias("_bits")).toArrow()
    words[found["_word"].to_numpy()] = found["_bits"].to_numpy()
    return words.tobytes()


def _alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if len(small) < similarity * len(large) - 1e-9:
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def _links(radius: int, similarity: float):
    """Group function over one cell: links that connect all its pairs of at least `similarity`."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("_node").sort_values("_node")
        nodes = frame["_node"].to_numpy()
        sets = [np.frombuffer(s, dtype=np.uint64) for s in frame["_set"]]
        values, at = np.unique(frame["_fp"].to_numpy().view(np.uint64), return_inverse=True)
        holders = np.split(np.argsort(at, kind="stable"), np.cumsum(np.bincount(at, minlength=len(values)))[:-1])
        tree = BKTree(values)
        label = np.arange(len(nodes))
        out = []
        for i, own in enumerate(sets):
            # Larger nodes that nothing ties to this one yet; a tie makes the others of its group superfluous.
            _, item = tree.within(values[at[i] : at[i] + 1], radius)
            others = np.concatenate([holders[v] for v in item]) if len(item) else np.empty(0, dtype=np.int64)
            for j in others[others > i].tolist():
                if label[i] != label[j] and _alike(own, sets[j], similarity):
                    label[label == label[j]] = label[i]
                    out.append((nodes[i], nodes[j]))
        return pd.DataFrame(out, columns=["_a", "_b"]).astype("int64")

    return run


def near_copies(
    rows: DataFrame, row: str = "_row", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY, radius: int = RADIUS, piece: int = PIECE
) -> DataFrame:
    """`_row`, `_group` of every row: groups are connected by pairs of texts whose shingles have Jaccard `similarity` or more.

    Texts of equal shingles are one node. Nodes that share a band of MinHash values are candidates; each connected
    group of candidates is a shard, whose BK-tree of fingerprints finds the pairs within `radius`, and what it finds is
    compared exactly. A shard of more than `piece` nodes is dealt to cells, one for each pair of its pieces. A cell
    returns a spanning forest, and compares no two nodes it has tied already. Texts without words are one group.
    """
    slim = rows.select(F.col(row).alias("_row"), F.xxhash64(text).alias("_body"), F.col(text).cast("binary").alias("_text"))
    kind = slim.schema["_row"].dataType.simpleString()
    sketched = stored(slim.mapInArrow(_sketch(words), f"_row {kind}, _body long, _node long, _fp long, _bands array<long>"), "sketches")
    # One row a distinct set from here on; copies collapse in their tasks.
    nodes = stored(sketched.groupBy("_node").agg(F.min("_body").alias("_body"), F.min("_fp").alias("_fp"), F.first("_bands").alias("_bands")), "nodes")
    keys = nodes.select("_node", F.explode("_bands").alias("_key"))
    least = cut(keys.groupBy("_key").agg(F.min("_node").alias("_least"), F.count("*").alias("_n")).filter("_n > 1").drop("_n"))
    edges = keys.join(least, "_key").filter("_node <> _least").select("_node", "_least").distinct()
    shards = cut(connected_components(edges, "_node", "_least"))
    sizes = shards.groupBy("component").agg(F.ceil(F.count("*") / piece).cast("int").alias("_pieces"))
    placed = shards.join(cut(sizes), "component").select(F.col("node").alias("_node"), "component", "_pieces")
    placed = cut(placed.join(nodes.select("_node", "_body", "_fp"), "_node"))
    bits = slim.sparkSession.sparkContext.broadcast(_filter_of(placed, "_body"))
    # Only sets that are compared leave their tasks, one a node and task.
    sets = slim.select("_body", "_text").mapInArrow(_sets(words, bits), "_node long, _set binary").groupBy("_node").agg(F.min("_set").alias("_set"))
    held = placed.join(sets, "_node")
    own = F.pmod(F.xxhash64("_node"), F.col("_pieces")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1))
    cells = held.select("_node", "_fp", "_set", "component", own.alias("_own"), other.alias("_other"))
    cells = cells.select("_node", "_fp", "_set", "component", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"))
    links = cells.groupBy("component", "_i", "_j").applyInPandas(_links(radius, similarity), "_a long, _b long")
    groups = cut(connected_components(links, "_a", "_b"))
    return sketched.select("_row", "_node").join(groups, F.col("_node") == F.col("node"), "left").select("_row", F.coalesce("component", "_node").alias("_group"))

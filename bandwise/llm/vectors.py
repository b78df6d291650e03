"""Near-duplicate vectors by inverted lists with product-quantised residuals and an exact rerank."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwise.llm.common import cut, text_key
from bandwise.llm.components import connected_components
from bandwise.llm.simhash import forest

COSINE = 0.9
#: Vectors the index is fitted on, at most about.
SAMPLE = 20_000
#: Distinct vectors a list holds on average, as long as the sample gives each centroid 16 vectors.
LIST_ROWS = 128
#: Lists a vector is compared with.
PROBES = 12
SUBSPACES, CODES = 16, 32
#: Members and queries of one cell; longer lists are split into cells.
MEMBERS, QUERIES = 2048, 16_384


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        nearest = _squares(x, centres).argmin(axis=1)
        count = np.bincount(nearest, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, nearest, x)
        full = count > 0
        centres[full] = total[full] / count[full, None]
        # A centre nobody is nearest to starts anew at a random vector.
        centres[~full] = x[rng.integers(0, len(x), (~full).sum())]
    return centres


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1)[None, :]


@dataclass
class Index:
    """Centres of the coarse lists and, for each subspace of the residuals, a codebook."""

    width: int
    centres: np.ndarray
    books: np.ndarray  # subspace, code, dimension

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int, seed: int = 7) -> Index:
        centres = _kmeans(sample, lists, 8, seed)
        residual = sample - centres[_squares(sample, centres).argmin(axis=1)]
        parts = cls.parts(residual)
        books = np.stack([_kmeans(p, min(CODES, len(p)), 6, seed + i) for i, p in enumerate(parts)])
        return cls(sample.shape[1], centres, books)

    @staticmethod
    def parts(x: np.ndarray) -> np.ndarray:
        """Subspace, row, dimension; zeros fill up the last dimensions."""
        size = -(-x.shape[1] // SUBSPACES)
        padded = np.zeros((len(x), size * SUBSPACES), dtype=x.dtype)
        padded[:, : x.shape[1]] = x
        return padded.reshape(len(x), SUBSPACES, size).transpose(1, 0, 2)

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (row, subspace) and the distance between each residual and what its codes stand for."""
        codes, error = [], np.zeros(len(residual))
        for part, book in zip(self.parts(residual), self.books):
            squares = _squares(part, book)
            code = squares.argmin(axis=1)
            codes.append(code)
            error += np.maximum(squares[np.arange(len(part)), code], 0)
        return np.stack(codes, axis=1), np.sqrt(error)

    def table(self, residual: np.ndarray) -> np.ndarray:
        """Squared distances of each residual's parts to all codes: row, subspace, code."""
        return np.stack([_squares(p, b) for p, b in zip(self.parts(residual), self.books)], axis=1)


def _padded(values: list, width: int) -> np.ndarray:
    out = np.zeros((len(values), width))
    for i, v in enumerate(values):
        out[i, : min(len(v), width)] = v[:width]
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def _probe(index, probes: int):
    """Map function: the list of every vector and the lists it is compared with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _padded(batch.column("_v").to_pylist(), own.width)
            squares = _squares(x, own.centres)
            count = min(probes, squares.shape[1])
            near = np.argpartition(squares, count - 1, axis=1)[:, :count]
            order = np.take_along_axis(squares, near, axis=1).argsort(axis=1, kind="stable")
            near = np.take_along_axis(near, order, axis=1)
            lists = pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "_lists"])

    return run


def _compare(index, cosine: float):
    """Group function over one cell: members of a list against queries that probe it.

    Counts are symmetric: a member gets what a query finds, too, unless the member itself looks into the query's list,
    where it finds the same pair. A pair meets in one cell of a list, so each end counts it once.

    Asymmetric distances (query exact, member coded) come from lookup tables. The true distance differs from them by no
    more than the member's own coding error, so the bound loses no link; what passes is compared exactly.
    """
    reach = np.sqrt(max(0.0, 2 - 2 * cosine))

    def run(key: tuple[np.int32, ...], frame: pd.DataFrame) -> pd.DataFrame:
        own = index.value
        member, query = frame[frame["_member"]], frame[~frame["_member"]]
        empty = pd.DataFrame({"_a": [], "_b": [], "_n": []}).astype("int64")
        if not len(member) or not len(query):
            return empty
        centre = own.centres[int(key[0])]
        x = _padded(list(member["_v"]), own.width)
        codes, error = own.encode(x - centre)
        ids, copies = member["_g"].to_numpy(), member["_copies"].to_numpy()
        dims = np.array([len(v) for v in member["_v"]])
        looks = np.array(list(member["_lists"]))
        gained = np.zeros(len(member), dtype=np.int64)
        counts, left, right = [], [], []
        for first in range(0, len(query), 512):
            part = query.iloc[first : first + 512]
            q = _padded(list(part["_v"]), own.width)
            table = own.table(q - centre)
            squares = np.zeros((len(part), len(member)))
            for s in range(codes.shape[1]):
                squares += table[:, s, :][:, codes[:, s]]
            near = np.sqrt(np.maximum(squares, 0)) <= reach + error[None, :] + 1e-6
            a, b = np.nonzero(near)
            # Exact rerank in double precision, in pieces of bounded size.
            keep = np.zeros(len(a), dtype=bool)
            for i in range(0, len(a), 1 << 16):
                keep[i : i + (1 << 16)] = np.einsum("ij,ij->i", q[a[i : i + (1 << 16)]], x[b[i : i + (1 << 16)]]) >= cosine
            own_ids = part["_g"].to_numpy()
            own_dims = np.array([len(v) for v in part["_v"]])
            keep &= (own_ids[a] != ids[b]) & (own_dims[a] == dims[b])
            a, b = a[keep], b[keep]
            home = np.array([v[0] for v in part["_lists"]])
            other_copies = part["_copies"].to_numpy()
            for i in range(0, len(a), 1 << 16):
                of, by = b[i : i + (1 << 16)], a[i : i + (1 << 16)]
                unseen = (looks[of] != home[by, None]).all(axis=1)
                np.add.at(gained, of[unseen], other_copies[by[unseen]])
            number = np.bincount(a, weights=copies[b], minlength=len(part)).astype(np.int64)
            hit = number > 0
            counts.append(np.stack([own_ids[hit], own_ids[hit], number[hit]], axis=1))
            left.append(own_ids[a])
            right.append(ids[b])
        counts.append(np.stack([ids, ids, gained], axis=1)[gained > 0])
        left, right = np.concatenate(left), np.concatenate(right)
        nodes, at = np.unique(np.concatenate([left, right]), return_inverse=True)
        root = forest(len(nodes), at[: len(left)], at[len(left) :])
        tied = np.flatnonzero(root != np.arange(len(nodes)))
        links = np.stack([nodes[tied], nodes[root[tied]], np.zeros(len(tied), dtype=np.int64)], axis=1)
        return pd.DataFrame(np.concatenate([*counts, links]).astype("int64"), columns=["_a", "_b", "_n"])

    return run


def near_vectors(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    cosine: float = COSINE,
    sample: int = SAMPLE,
    list_rows: int = LIST_ROWS,
    probes: int = PROBES,
    members: int = MEMBERS,
    queries: int = QUERIES,
) -> DataFrame:
    """One row a vector: `n_links` (other vectors at `cosine` or more), `component_id` (smallest id reachable), `kept`.

    Null and zero vectors and those with null or non-finite components link with nothing; vectors of different lengths
    do not link. Equal vectors link with each other and are compared with the rest as one. Repeated rows are vectors of
    their own. A null id never is the smallest one. No vectors give no rows. Other columns are not looked at.

    The index (coarse centres, residual codebooks) is fitted on about `sample` vectors, all are in it. Every vector is
    stored in its nearest list and looked for in its `probes` nearest ones. Lists longer than `members` and their
    queries are dealt to cells, so a crowded list is split. A cell returns counts and a spanning forest, never all
    pairs of a group. Links found are exact; some may be missed where equal neighbours fall into distant lists.
    """
    spark = vectors.sparkSession
    finite = F.forall(F.col(embedding), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    nonzero = F.exists(F.col(embedding), lambda x: x != 0)
    good = F.coalesce(finite & nonzero, F.lit(False))
    h1, h2 = text_key(F.col(embedding))
    rows = vectors.select(F.col(vec_id).alias("_id"), F.col(embedding).cast("array<double>").alias("_v"), good.alias("_good"), h1.alias("_h1"), h2.alias("_h2"))
    valid = rows.filter("_good")
    groups = valid.groupBy("_h1", "_h2").agg(F.min("_id").alias("_first"), F.count("*").alias("_copies"), F.first("_v").alias("_v"))
    # The first hash stands for a group: equal first hashes are told apart by the second.
    groups = cut(groups.withColumn("_g", F.xxhash64("_h1", "_h2")))
    count = groups.count()
    if not count:
        return vectors.select(F.col(vec_id), F.lit(0).cast("long").alias("n_links"), F.col(vec_id).alias("component_id"), F.lit(True).alias("kept"))

    share = min(1.0, sample / count)
    drawn = groups.filter(F.pmod(F.col("_h1"), F.lit(1_000_003)) < int(share * 1_000_003) + 1).select("_h1", "_h2", "_v").toPandas()
    if not len(drawn):
        drawn = groups.select("_h1", "_h2", "_v").limit(1).toPandas()
    drawn = drawn.sort_values(["_h1", "_h2"])
    width = max(len(v) for v in drawn["_v"])
    lists = max(1, min(count // list_rows, len(drawn) // 16))
    index = spark.sparkContext.broadcast(Index.fit(_padded(list(drawn["_v"]), width), lists))

    slim = groups.select("_g", "_copies", "_v")
    placed = cut(slim.mapInArrow(_probe(index, probes), "_g long, _copies long, _v array<double>, _lists array<int>"))
    # As many rows as there are lists, and those are bounded by the sample.
    size = placed.groupBy(F.col("_lists")[0].alias("_list")).agg(F.count("*").alias("_m"))
    asked = placed.select(F.explode("_lists").alias("_list")).groupBy("_list").agg(F.count("*").alias("_q"))
    cells = {r["_list"]: (r["_m"], r["_q"]) for r in size.join(asked, "_list").collect()}
    split = spark.createDataFrame(
        [(n, -(-m // members), -(-q // queries)) for n, (m, q) in cells.items()], "_list int, _mp int, _qp int"
    )
    # Queries need their own list only.
    asks = placed.select("_g", "_copies", "_v", F.col("_lists").alias("_looks"), F.posexplode("_lists").alias("_no", "_list")).join(F.broadcast(split), "_list")
    spot = F.xxhash64("_g", F.lit("cell"))
    stored = asks.filter("_no = 0").select(
        "_list", F.pmod(spot, "_mp").cast("int").alias("_m"), F.explode(F.sequence(F.lit(0), F.col("_qp") - 1)).alias("_q"), F.lit(True).alias("_member"), "_g", "_copies", "_v", F.col("_looks").alias("_lists")
    )
    asking = asks.select(
        "_list", F.explode(F.sequence(F.lit(0), F.col("_mp") - 1)).alias("_m"), F.pmod(spot, "_qp").cast("int").alias("_q"), F.lit(False).alias("_member"), "_g", "_copies", "_v", F.slice("_looks", 1, 1).alias("_lists")
    )
    found = stored.unionByName(asking).groupBy("_list", "_m", "_q").applyInPandas(_compare(index, cosine), "_a long, _b long, _n long")
    found = cut(found)

    links = found.filter("_n > 0").groupBy("_a").agg(F.sum("_n").alias("_others"))
    parts = connected_components(found.filter("_n = 0"), "_a", "_b")
    by_group = groups.select("_h1", "_h2", "_g", "_first", "_copies").join(links, F.col("_g") == F.col("_a"), "left")
    by_group = by_group.join(parts, F.col("_g") == F.col("node"), "left")
    by_group = cut(by_group.select("_h1", "_h2", "_first", F.coalesce("component", "_g").alias("_root"), (F.coalesce("_others", F.lit(0)) + F.col("_copies") - 1).alias("_links")))
    least = cut(by_group.groupBy("_root").agg(F.min("_first").alias("_least")))
    known = cut(by_group.join(least, "_root").select(F.col("_h1").alias("_k1"), F.col("_h2").alias("_k2"), "_links", "_least"))
    slim = rows.select("_id", "_good", F.when(F.col("_good"), F.col("_h1")).alias("_h1"), F.when(F.col("_good"), F.col("_h2")).alias("_h2"))
    out = slim.join(known, (slim["_h1"] == known["_k1"]) & (slim["_h2"] == known["_k2"]), "left")
    component = F.when(F.col("_good"), F.col("_least")).otherwise(F.col("_id"))
    return out.select(
        F.col("_id").alias(vec_id),
        F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("_id").eqNullSafe(component).alias("kept"),
    )

"""Merkle manifest of a dataset: leaves, subroots of groups, a root, and a proof for each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bandwise.llm.common import cut, placed, stored

ARITY = 8
#: Levels that one shuffle covers: a block of ARITY ** LEVELS nodes is sorted together, and no run leaves it.
LEVELS = 4
BLOCK = ARITY**LEVELS
#: Groups whose subroots and paths are broadcast (about a kilobyte each); more are joined by a shuffle.
BROADCAST_GROUPS = 10_000


def digest_of(text: Column) -> Column:
    """SHA-256 of text, as binary."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def as_hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def encoded(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return digest_of(F.concat(*[encoded(v) for v in values]))


def _level(nodes: DataFrame, level: int) -> DataFrame:
    """One level within blocks: `_sides<level>` at each of its nodes, and `_node` becomes the parent at first children.

    A node of this level is held by its first leaf. Its siblings are the fixed offsets to both sides, masked by its slot
    in the run; a run that ends early has nothing at the later offsets.
    """
    step = ARITY**level
    here = F.col("_at") % step == 0
    slot = (F.col("_at") / step).cast("long") % ARITY
    w = Window.partitionBy("_group", "_block", "_here").orderBy("_at")
    none = F.lit(b"")

    def beside(k: int) -> Column:
        node = F.lag("_node", -k).over(w) if k < 0 else F.lead("_node", k).over(w)
        inside = (slot + k).between(0, ARITY - 1)
        return F.when(inside, F.coalesce(node, none)).otherwise(none)

    before = F.concat(*[beside(-k) for k in range(ARITY - 1, 0, -1)])
    after = F.concat(*[beside(k) for k in range(1, ARITY)])
    # A level is there as long as the group has several nodes on it.
    active = F.col("_here") & (F.col("_n") > step)
    sides = F.when(active, F.struct(before.alias("before"), after.alias("after")))
    seen = nodes.withColumn("_here", here).withColumn(f"_sides{level}", sides)
    parent = digest_of(as_hex(F.concat("_node", F.col(f"_sides{level}.after"))))
    return seen.withColumn("_node", F.when(active & (slot == 0), parent).otherwise(F.col("_node")))


def _climb(nodes: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """`_path` for each row of (`_group`, `_at`, `_n`, `_node`, ...), and the top node of each group.

    The path lists the siblings before and after the row's ancestor on each level. All levels within a block take one
    shuffle; the blocks' tops are the nodes of the next round, so n rows take about log4096(n) rounds. A block holds at
    most 4,096 rows, whatever share of the table its group has.
    """
    rows = nodes.withColumn("_leaf", F.col("_node")).withColumn("_block", F.floor(F.col("_at") / BLOCK))
    for level in range(LEVELS):
        rows = _level(rows, level)
    # Down to the leaves: each takes what the last first leaf before it holds.
    down = Window.partitionBy("_group", "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    held = [F.col("_sides0")] + [F.last(f"_sides{level}", ignorenulls=True).over(down) for level in range(1, LEVELS)]
    # Levels beyond the top of the group have no sides at all.
    rows = rows.withColumn("_path", F.array_compact(F.array(*held)))
    own = [c for c in nodes.columns if c != "_node"]
    rows = stored(rows.select(*own, "_leaf", "_block", "_path", "_node"), "levels")
    tops = rows.filter(F.col("_at") % BLOCK == 0).select("_group", F.col("_block").alias("_at"), F.ceil(F.col("_n") / BLOCK).alias("_n"), "_node")
    rows = rows.drop("_node").withColumnRenamed("_leaf", "_node")
    if most <= BLOCK:
        return rows.drop("_block"), tops.select("_group", "_node")
    above, top = _climb(tops, -(-most // BLOCK))
    above = above.select("_group", F.col("_at").alias("_block"), F.col("_path").alias("_above"))
    joined = rows.join(above, ["_group", "_block"])
    return joined.withColumn("_path", F.concat("_path", "_above")).drop("_block", "_above"), top


def _most(nodes: DataFrame) -> int:
    return nodes.agg(F.max("_n")).first()[0] or 0


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path lead to."""
    return F.aggregate(path, leaf, lambda node, sides: digest_of(as_hex(F.concat(sides["before"], node, sides["after"]))))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings on a path, level by level, from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: as_hex(F.concat(s["before"], s["after"]))), "").cast("binary"), 256)


def manifest(
    docs: DataFrame,
    columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    doc_id: str = "doc_id",
    group: str = "lang",
    changed: dict[str, Column] | None = None,
) -> DataFrame:
    """`_id`, `_group` (a key of the group), `_node` (the leaf), `_changed`, `_path`, `_subroot`, `_root` of every row.

    A leaf is the digest of the `columns` of a row. Leaves of a group ascend by id, a null id first, rows of one id by
    their leaves; each run of eight nodes has one parent, also a run of one, until one node remains. The subroots of the
    groups, a null group first, then by UTF-8 bytes, lead to the root in the same way. `_changed` is the leaf of the
    row with the expressions of `changed` in place of its columns, null without any. Digests are binary.

    Nulls in any column and empty texts have their own encoding. Rows that are equal in all columns are leaves of their own.
    An empty table has no rows, and no root. Long texts are only ever hashed; nothing wider than a digest is shuffled.
    Other columns are not looked at, whatever their names.

    Places come from a range sort, so a group that holds most of the rows is spread like the others. What the driver
    holds is the size of the largest group and the number of groups.
    """
    changed = changed or {}
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaf = leaf_digest(*[F.col(c) for c in columns])
    other = leaf_digest(*[changed.get(c, F.col(c)) for c in columns]) if changed else F.lit(None).cast("binary")
    # The place in the input only tells equal rows apart.
    slim = docs.select(F.col(doc_id).alias("_id"), key.alias("_group"), leaf.alias("_node"), other.alias("_changed"), F.monotonically_increasing_id().alias("_tie"))
    rows = stored(placed(stored(slim, "leaves"), "_group", ["_id", "_node", "_tie"]).drop("_tie"), "placed")
    rows, tops = _climb(rows, _most(rows))
    subroots = cut(tops.select(F.lit("").alias("_group"), F.col("_group").alias("_name"), "_node"))
    groups = cut(placed(subroots, "_group", ["_name"]))
    number = _most(groups)
    groups, root = _climb(groups, number)
    root = root.select("_group", F.col("_node").alias("_root"))  # one row
    groups = groups.join(F.broadcast(root), "_group").select(F.col("_name").alias("_group"), F.col("_node").alias("_subroot"), F.col("_path").alias("_above"), "_root")
    small = F.broadcast(groups) if number <= BROADCAST_GROUPS else groups
    joined = rows.join(small, "_group").withColumn("_path", F.concat("_path", "_above"))
    return joined.select("_id", "_group", "_node", "_changed", "_path", "_subroot", "_root")


def proofs(found: DataFrame) -> DataFrame:
    """A manifest with `_proof` (digest of the siblings), `_folded` (root from the changed leaf, if any) and `_verified`."""
    start = F.coalesce("_changed", "_node")
    rows = found.withColumns({"_proof": proof_digest(F.col("_path")), "_folded": folded(start, F.col("_path"))})
    return rows.withColumn("_verified", F.col("_folded") == F.col("_root"))

"""Line dedup against levelled sorted runs of line hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from os.path import commonprefix

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampType

from bandwise.llm.common import ascii_lower, cut, new_folder, stored, strip, text_key

MIN_CHARS = 10
#: Hashes of a bucket (24 bytes each) that a task should sort at a time, and the most buckets a table may have.
BUCKET_ROWS, MAX_BUCKETS = 1 << 22, 100_000
HASHES = ["_h1", "_h2"]
_SORTED_SCANS = "spark.sql.legacy.bucketedTableScan.outputOrdering"


@contextmanager
def sorted_scans(spark: SparkSession) -> Iterator[None]:
    """Plans made inside know that a bucket of one sorted file is sorted."""
    before = spark.conf.get(_SORTED_SCANS)
    spark.conf.set(_SORTED_SCANS, "true")
    try:
        yield
    finally:
        spark.conf.set(_SORTED_SCANS, before)


@dataclass
class LineRuns:
    """An index of line hashes: runs of (`_h1`, `_h2`, `_owner`), each on a level.

    A new batch adds a run on level 0. `fanout` runs on a level are merged into one on the next, so n batches leave
    about log n runs and each hash is rewritten as often. No hash is in two runs.

    Runs and batches are tables with the same `buckets` by hash, a bucket being one sorted file, so that a batch and
    the runs are merge joined bucket by bucket: neither side is shuffled or sorted again. The runs in use are listed in
    `folder`, a version for each change, written after the files it names: `open` finds the last whole one.
    """

    spark: SparkSession
    fanout: int = 4
    buckets: int | None = None
    folder: str | None = None
    runs: list[tuple[int, str]] = field(default_factory=list)
    version: int = 0
    _names: dict[str, str] = field(default_factory=dict, repr=False)

    def __post_init__(self):
        self.buckets = self.buckets or self.spark.sparkContext.defaultParallelism
        self.folder = (self.folder or new_folder(self.spark, "runs")).rstrip("/")

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> LineRuns:
        """The index that another session left in `folder`."""
        listed = spark.read.parquet(f"{folder.rstrip('/')}/versions")
        last = listed.agg(F.max("version")).first()[0]
        # A row a run: about `fanout` times the number of levels.
        rows = listed.filter(F.col("version") == last).orderBy("place").collect()
        index = cls(spark, rows[0]["fanout"], rows[0]["buckets"], folder, [(r["level"], r["path"]) for r in rows], last)
        for r in rows:
            name, columns = f"bandwise_run_{uuid.uuid4().hex}", f"_h1 BIGINT, _h2 BIGINT, _owner {r['owner']}, _many BOOLEAN"
            buckets = f"CLUSTERED BY (_h1, _h2) SORTED BY (_h1, _h2) INTO {index.buckets} BUCKETS"
            spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet {buckets} LOCATION '{r['path']}'")
            index._names[r["path"]] = name
        return index

    def batch(self, keys: DataFrame) -> str:
        """Writes the distinct keys of a batch (`_h1`, `_h2`, `_owner`, `_many`) in the buckets of the runs; its path."""
        return self._write(keys.repartition(self.buckets, *HASHES), "batch")

    def read(self, path: str) -> DataFrame:
        return self.spark.table(self._names[path])

    def lookup(self, path: str) -> DataFrame:
        """The keys of a batch that some run holds, with `_owner` from there."""
        keys = self.read(path).select(*HASHES)
        found = [keys.join(self.read(run).hint("merge"), HASHES) for _, run in self.runs]
        return _union(found) if found else self.read(path).limit(0)

    def unseen(self, path: str) -> DataFrame:
        """The keys of a batch that no run holds: one merge anti join a run, all in the same buckets."""
        keys = self.read(path)
        for _, run in self.runs:
            keys = keys.join(self.read(run).hint("merge"), HASHES, "left_anti")
        return keys

    def add(self, path: str) -> DataFrame:
        """Adds what no run holds of a batch as a run, compacts the levels that are full, and returns what it added."""
        # The first batch is a run as it is.
        mine = self._write(self.unseen(path), "run-0") if self.runs else path
        added = self.read(mine)
        self.runs.append((0, mine))
        level = 0
        while len(full := [run for at, run in self.runs if at == level]) >= self.fanout:
            merged = _union([self.read(run) for run in full]).repartition(self.buckets, *HASHES)
            level += 1
            self.runs = [r for r in self.runs if r[0] != level - 1] + [(level, self._write(merged, f"run-{level}"))]
        self._list(added.schema["_owner"].dataType.simpleString())
        return added

    def _write(self, keys: DataFrame, kind: str) -> str:
        path, name = f"{self.folder}/{kind}-{uuid.uuid4().hex}", f"bandwise_run_{uuid.uuid4().hex}"
        rows = keys.select(*HASHES, "_owner", "_many").write.bucketBy(self.buckets, *HASHES).sortBy(*HASHES)
        rows.option("path", path).saveAsTable(name, format="parquet")
        self._names[path] = name
        return path

    def _list(self, owner: str) -> None:
        self.version += 1
        rows = [(self.version, i, level, path, self.fanout, self.buckets, owner) for i, (level, path) in enumerate(self.runs)]
        listed = self.spark.createDataFrame(rows, "version int, place int, level int, path string, fanout int, buckets int, owner string")
        # One file, so that a version is listed whole or not at all.
        listed.coalesce(1).write.mode("append").parquet(f"{self.folder}/versions")

    def close(self) -> None:
        """Takes the tables out of the session's catalog; their files and the list of runs stay."""
        for name in self._names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._names.clear()


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _order_of(ids: DataFrame) -> Column | None:
    """Numbers (or times) that never fall as `_id` rises, to cut batches by; None where there are no such numbers.

    Texts count by the six bytes behind what all ids begin with; ids that agree in those share a batch.
    """
    kind = ids.schema["_id"].dataType
    if isinstance(kind, (NumericType, DateType, TimestampType)):
        return F.col("_id")
    if kind.simpleString() not in ("string", "binary"):
        return None
    least, most = ids.agg(F.hex(F.min("_id").cast("binary")), F.hex(F.max("_id").cast("binary"))).first()
    shared = len(commonprefix([least or "", most or ""])) // 2 * 2
    digits = F.substring(F.hex(F.col("_id").cast("binary")), shared + 1, 12)
    return F.conv(F.rpad(digits, 12, "0"), 16, 10).cast("long")


def line_key(line: Column) -> Column:
    return ascii_lower(strip(line))


def _lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def dedup_lines(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_chars: int = MIN_CHARS,
    batches: int = 4,
    index: LineRuns | None = None,
) -> DataFrame:
    """`docs` with `_kept` (text without repeated lines), `_n_lines` (before) and `_n_dropped`.

    A line's key is the line stripped of ASCII white space, A-Z in lower case. Keys of at least `min_chars` code points
    that several documents hold lose all their lines except in the smallest id holding them. Documents come in
    `batches` ranges of rising ids; with an `index` of earlier calls, what it holds belongs to those documents.

    Null and empty texts are one empty line; a document that loses every line becomes an empty text. Rows of one id
    count as one document, and each keeps its own lines. Null ids count as one document larger than any other.
    An empty table gives no rows. Ids of any type that has an order. Column names of `docs` do not matter, except those beginning with an underscore.

    Only hashes are shuffled to find repeats, pre-aggregated to one row a key, so a line that stands in a third of all
    documents costs one row a task. Those hashes are then joined with the lines' hashes, which adaptive execution
    splits where a key is hot. Texts are shuffled once, by id and content. What a text gathers are the places of its own
    lost lines, and dropping them takes time linear in its lines.
    """
    spark = docs.sparkSession
    body = F.xxhash64(F.col(text))  # tells rows of one id apart
    # Hashed ahead of the explode, once a text rather than once a line.
    texts = docs.select(F.col(doc_id).alias("_id"), body.alias("_body"), _lines_of(F.col(text)).alias("_lines"))
    lines = texts.select("_id", "_body", F.posexplode("_lines").alias("_no", "_line"))
    lines = lines.withColumn("_key", line_key(F.col("_line"))).filter(F.char_length("_key") >= min_chars)
    h1, h2 = text_key(F.col("_key"))
    lines = stored(lines.select("_id", "_body", "_no", h1.alias("_h1"), h2.alias("_h2")), "lines")

    wanted = -(-lines.count() // BUCKET_ROWS)
    own = index is None
    if own:
        index = LineRuns(spark, buckets=min(MAX_BUCKETS, max(wanted, spark.sparkContext.defaultParallelism)))

    bounds = []
    order = _order_of(lines) if batches > 1 else None
    if order is not None:
        shares = [i / batches for i in range(1, batches)]
        bounds = sorted(set(lines.agg(F.percentile_approx(order, shares, 1000)).first()[0] or []))
    batch = F.lit(len(bounds))
    for i in reversed(range(len(bounds))):
        batch = F.when(order <= F.lit(bounds[i]), i).otherwise(batch)
    lines = lines.withColumn("_batch", batch)

    repeats = []
    with sorted_scans(spark):
        for number in range(len(bounds) + 1):
            keys = lines.filter(F.col("_batch") == number).groupBy(*HASHES)
            # A null id is larger than any other: the first holder is null only if all are.
            many = F.coalesce(F.min("_id") < F.max("_id"), F.lit(False)) | (F.count("_id").between(1, F.count("*") - 1))
            written = index.batch(keys.agg(F.min("_id").alias("_owner"), many.alias("_many")))
            old = index.lookup(written).select(*HASHES, "_owner")
            new = index.add(written).filter("_many").select(*HASHES, "_owner")
            repeats.append(cut(old.unionByName(new).withColumn("_batch", F.lit(number))))
    repeats = _union(repeats)
    if own:
        index.close()

    lost = lines.join(repeats, ["_batch", "_h1", "_h2"]).filter(~F.col("_id").eqNullSafe(F.col("_owner")))
    lost = lost.groupBy(F.col("_id").alias("_lost_id"), F.col("_body").alias("_lost_body")).agg(F.collect_set("_no").alias("_lost"))
    same = F.col(doc_id).eqNullSafe(F.col("_lost_id")) & (body == F.col("_lost_body"))
    joined = docs.join(lost, same, "left").withColumn("_split", _lines_of(F.col(text)))
    # The difference of two sets of places takes linear time, whatever share of a long text is lost.
    places = F.array_except(F.sequence(F.lit(0), F.size("_split") - 1), F.col("_lost"))
    stay = F.when(F.col("_lost").isNull(), F.col("_split")).otherwise(F.transform(places, lambda i: F.get("_split", i)))
    joined = joined.withColumns({"_n_lines": F.size("_split").cast("long"), "_stay": stay})
    return joined.withColumns(
        {
            "_kept": F.array_join("_stay", "\n"),
            "_n_dropped": F.col("_n_lines") - F.size("_stay"),
        }
    ).drop("_lost", "_lost_id", "_lost_body", "_split", "_stay")

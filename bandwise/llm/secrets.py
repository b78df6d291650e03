"""Secret scans with an incremental ledger of blobs."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bandwise.llm.common import cut, new_folder

# Marks put around matches; no rule may match them.
OPEN, INNER, CLOSE = "\x01", "\x02", "\x03"
SPARE = "�"


@dataclass(frozen=True)
class SecretRule:
    """`pattern` with two groups: what comes before the secret, and the secret, of `least` code points at least."""

    kind: str
    version: int
    pattern: str
    least: int

    @property
    def stamp(self) -> str:
        """Version and digest of what the rule says, so that a rule changed under its old version is another one."""
        said = hashlib.sha256(f"{self.least}:{self.pattern}".encode()).hexdigest()
        return f"{self.version}-{said[:16]}"


# The patterns that the contract names, in its order, and one more kind.
BASE = ("assign", "access", "hex")
RULES = (
    SecretRule("assign", 1, r"((?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?)([A-Za-z0-9+/_.=-]+)", 6),
    # A run too short holds no longer match, so these lengths can stand in the pattern: a mark at every run costs a lot.
    SecretRule("access", 1, r"()(AKIA[A-Z0-9]{16,})", 20),
    SecretRule("hex", 1, r"()([0-9a-f]{24,})", 24),
    SecretRule("pem", 1, r"()(-----BEGIN [A-Z ]*PRIVATE KEY-----)", 1),
)


def blob_of(text: Column) -> Column:
    """Address of a content; null is the empty content."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _matches(text: Column, rule: SecretRule) -> Column:
    """One struct a part of the text: what it adds to positions, and the match at its start (code points)."""
    marked = F.regexp_replace(text, rule.pattern, f"{OPEN}$1{INNER}$2{CLOSE}")
    parts = F.split(marked, OPEN)

    def part(p: Column, i: Column) -> Column:
        before = F.instr(p, INNER) - 1
        whole = F.instr(p, CLOSE) - 2
        return F.struct(
            F.lit(rule.kind).alias("kind"),
            F.lit(rule.stamp).alias("version"),
            i.alias("no"),
            F.when(i == 0, F.char_length(p)).otherwise(F.char_length(p) - 2).alias("step"),
            F.when((i > 0) & (whole - before >= rule.least), whole).alias("length"),
        )

    found = F.transform(parts, part)
    return F.when(F.size(parts) > 1, found)


def scan(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[SecretRule, ...] = RULES, ledger: str | None = None
) -> tuple[DataFrame, DataFrame, str]:
    """Finds secrets in every content once, and appends what was done to the ledger.

    Returns the rows' ids and addresses (`_id`, `_blob`), the findings of all rules given in all contents of the ledger
    (`_blob`, `kind`, `start`, `end`, in code points, the end exclusive), and the ledger's folder to pass to the next
    call. The ledger is one table: a row says that a content was scanned by a kind's rule of one version, and holds what
    was found. So whatever part of a lost write is there is whole, and the rest is scanned by the next call. One call may
    write at a time. Only pairs of content and rule version that the ledger lacks are scanned; a rule whose pattern
    changed under its old version counts as a new one. Matches are leftmost and do not overlap within a kind; those too
    short are dropped after matching.

    Null texts are the empty content. Repeated rows and copies are one content, scanned once, and every row gets its
    findings. Null ids are ids like others; an empty table adds nothing. Other columns are not looked at.

    Texts of contents not yet seen are shuffled once, by id. Positions are running sums over the matches of one
    content; of texts only lengths get there.
    """
    spark = docs.sparkSession
    fresh = ledger is None
    ledger = ledger or new_folder(spark, "ledger")
    ids = cut(docs.select(F.col(doc_id).alias("_id"), blob_of(F.col(text)).alias("_blob")))
    contents = ids.groupBy("_blob").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"))).alias("_first"))
    wanted = F.explode(F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.stamp).alias("version")) for r in rules]))
    pairs = contents.select("_blob", F.col("_first.id").alias("_first"), wanted.alias("_rule")).select("_blob", "_first", "_rule.kind", "_rule.version")
    if not fresh:
        pairs = pairs.join(spark.read.parquet(f"{ledger}/scanned"), ["_blob", "kind", "version"], "left_anti")
    pairs = pairs.groupBy("_blob").agg(F.min("_first").alias("_first"), F.collect_set("kind").alias("_kinds"))
    pairs = cut(pairs)

    body = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    todo = body.join(pairs, F.col("_id").eqNullSafe(F.col("_first"))).filter(blob_of(F.col("_text")) == F.col("_blob"))
    plain = F.translate(F.col("_text"), OPEN + INNER + CLOSE, SPARE * 3)
    found = [F.when(F.array_contains("_kinds", r.kind), _matches(plain, r)) for r in rules]
    parts = todo.select("_blob", F.explode(F.flatten(F.array_compact(F.array(*found)))).alias("_part")).select("_blob", "_part.*")
    parts = parts.dropDuplicates(["_blob", "kind", "version", "no"])  # rows of one id and one content
    order = Window.partitionBy("_blob", "kind", "version").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("step").over(order), F.lit(0)).cast("long")
    findings = parts.withColumn("start", start).filter("length is not null")
    span = F.struct("start", (F.col("start") + F.col("length")).alias("end"))
    # Grouped as the window was: nothing is shuffled again.
    findings = findings.groupBy("_blob", "kind", "version").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    by_kind = {r.kind: r.stamp for r in rules}
    versions = F.create_map(*[x for k, v in by_kind.items() for x in (F.lit(k), F.lit(v))])
    scanned = pairs.select("_blob", F.explode("_kinds").alias("kind")).withColumn("version", versions[F.col("kind")])
    done = scanned.join(findings, ["_blob", "kind", "version"], "left")
    done.write.mode("append").parquet(f"{ledger}/scanned")

    current = spark.read.parquet(f"{ledger}/scanned").filter(versions[F.col("kind")] == F.col("version"))
    return ids, current.select("_blob", "kind", F.inline("spans")), ledger


def secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """Every row's id with the number of base findings a kind, the digest of the base spans, and all spans as text.

    Texts without findings have zeros, an empty string and its digest; see `scan` for other cases.
    """
    ids, findings, _ = scan(docs, doc_id, text, rules)
    kinds = [r.kind for r in rules]
    rank = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind"))
    span = F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string"))
    listed = F.sort_array(F.collect_list(F.struct("start", rank.alias("rank"), span.alias("span"), "kind")))
    by_blob = findings.groupBy("_blob").agg(listed.alias("_all"))
    base = F.filter("_all", lambda s: s["kind"].isin(*BASE))

    def join(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: s["span"]), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("_all", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    by_blob = cut(by_blob.select("_blob", *[number(k) for k in BASE], join(base).alias("_base"), join(F.col("_all")).alias("spans")))
    out = ids.join(by_blob, "_blob", "left")
    return out.select(
        F.col("_id").alias(doc_id),
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(F.coalesce("_base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )

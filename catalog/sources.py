"""Reading, stacking, isolating and writing tables."""

from pyspark.sql import functions as F

from bandwise.operators.bands import quantile_bands
from bandwise.plans.chain import Step, score
from bandwise.sources.reader import WHITESPACE, read_csv
from bandwise.sources.union import (
    SOURCE,
    common_columns,
    only_sources,
    preview,
    supertype_schema,
    union_sources,
)
from bandwise.sources.writer import write_scored
from catalog.data import CUTOFF, LOANS, loans, portfolio, rounded, shared_folder, table
from catalog.registry import query


def _two_layouts(spark, sf_dir):
    """Dev and test items whose columns differ in presence and type."""
    items = table(spark, sf_dir, "lineitem")
    cutoff = F.lit(CUTOFF).cast("timestamp")
    dev = items.filter(F.col("l_shipdate") < cutoff).select(
        "l_orderkey", "l_linenumber", "l_quantity", F.col("l_suppkey").alias("code"), "l_tax"
    )
    test = items.filter(F.col("l_shipdate") >= cutoff).select(
        "l_orderkey",
        F.col("l_linenumber").cast("double").alias("l_linenumber"),
        F.col("l_returnflag").alias("code"),
        "l_discount",
    )
    return {"dev": dev, "test": test}


@query(
    """
    SELECT source, count(*) AS n, sum(line) AS line_sum, max(code) AS max_code,
      count(q) AS n_quantity, count(t) AS n_tax, count(d) AS n_discount
    FROM (
      SELECT 'dev' AS source, CAST(l_linenumber AS DOUBLE) AS line, CAST(l_suppkey AS VARCHAR) AS code,
        l_quantity AS q, l_tax AS t, NULL AS d
      FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01'
      UNION ALL
      SELECT 'test', CAST(l_linenumber AS DOUBLE), l_returnflag, NULL, NULL, l_discount
      FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-01-01')
    GROUP BY source
    """
)
def union_of_sources(spark, sf_dir):
    stacked = union_sources(_two_layouts(spark, sf_dir))
    return stacked.groupBy(F.col(SOURCE).alias("source")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("l_linenumber").alias("line_sum"),
        F.max("code").alias("max_code"),
        F.count("l_quantity").alias("n_quantity"),
        F.count("l_tax").alias("n_tax"),
        F.count("l_discount").alias("n_discount"),
    )


@query(
    """
    SELECT source, least(count(*), 100) AS n
    FROM (SELECT CASE WHEN l_shipdate < TIMESTAMP '1999-01-01' THEN 'dev' ELSE 'test' END AS source
          FROM lineitem)
    GROUP BY source
    """
)
def union_with_limit_per_source(spark, sf_dir):
    stacked = union_sources(_two_layouts(spark, sf_dir), limit_per_source=100)
    return stacked.groupBy(F.col(SOURCE).alias("source")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """
    SELECT 'code' AS name, 'string' AS type, count(code) AS n FROM (
      SELECT CAST(l_suppkey AS VARCHAR) AS code FROM lineitem)
    UNION ALL SELECT 'l_discount', 'double', count(*) FROM lineitem
      WHERE l_shipdate >= TIMESTAMP '1999-01-01'
    UNION ALL SELECT 'l_linenumber', 'double', count(*) FROM lineitem
    UNION ALL SELECT 'l_orderkey', 'bigint', count(*) FROM lineitem
    UNION ALL SELECT 'l_quantity', 'double', count(*) FROM lineitem
      WHERE l_shipdate < TIMESTAMP '1999-01-01'
    UNION ALL SELECT 'l_tax', 'double', count(*) FROM lineitem
      WHERE l_shipdate < TIMESTAMP '1999-01-01'
    """
)
def supertype_of_sources(spark, sf_dir):
    """The merged type of every column and how many rows have a value."""
    sources = _two_layouts(spark, sf_dir)
    merged = supertype_schema(df.schema for df in sources.values())
    counted = union_sources(sources).agg(
        *(F.count(F.col(f.name)).alias(f.name) for f in merged.fields)
    )
    entries = [
        F.struct(
            F.lit(f.name).alias("name"),
            F.lit(f.dataType.simpleString()).alias("type"),
            F.col(f.name).alias("n"),
        )
        for f in merged.fields
    ]
    return counted.select(F.inline(F.array(*entries)))


@query(
    """
    SELECT 'code' AS name, 'Categorical' AS kind,
      count(DISTINCT CASE WHEN l_shipdate < TIMESTAMP '1999-01-01'
        THEN CAST(l_suppkey AS VARCHAR) ELSE l_returnflag END) AS values_seen
    FROM lineitem
    UNION ALL SELECT 'l_linenumber', 'Numerical', count(DISTINCT l_linenumber) FROM lineitem
    UNION ALL SELECT 'l_orderkey', 'Numerical', count(DISTINCT l_orderkey) FROM lineitem
    """
)
def columns_common_to_sources(spark, sf_dir):
    sources = _two_layouts(spark, sf_dir)
    shared = common_columns(sources)
    counted = union_sources(sources).agg(
        *(F.count_distinct(F.col(name)).alias(name) for name, _ in shared)
    )
    entries = [
        F.struct(
            F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.col(name).alias("values_seen")
        )
        for name, kind in shared
    ]
    return counted.select(F.inline(F.array(*entries)))


@query(
    f"""
    WITH {LOANS}
    SELECT l_returnflag, count(*) AS n, round(sum(balance), 2) AS balance
    FROM loans WHERE source = 'test' GROUP BY l_returnflag
    """
)
def rows_of_test_source(spark, sf_dir):
    rows = only_sources(portfolio(spark, sf_dir), ["test"])
    return rows.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.sum("balance"), 2).alias("balance")
    )


@query("SELECT least(count(*), 5) AS shown, least(count(*), 5) AS known FROM orders")
def preview_of_a_source(spark, sf_dir):
    """How many rows are shown, and how many of them the table holds."""
    orders = table(spark, sf_dir, "orders")
    there = orders.distinct().withColumn("there", F.lit(True))
    shown = preview(orders, 5).join(there, orders.columns, "left")
    return shown.agg(F.count(F.lit(1)).alias("shown"), F.count("there").alias("known"))


@query(
    """
    SELECT o_orderstatus, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS keys,
      round(sum(o_totalprice), 2) AS price, count(DISTINCT o_orderpriority) AS priorities,
      CAST(sum(CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END) AS BIGINT) AS big
    FROM orders GROUP BY o_orderstatus
    """
)
def csv_round_trip(spark, sf_dir):
    """Orders written as delimited text and read back with inferred types."""
    path = shared_folder(spark)
    orders = table(spark, sf_dir, "orders").withColumn("big", F.col("o_totalprice") > 250000)
    write_scored(orders.drop("o_orderdate"), path, format="csv")
    read = read_csv(spark, path)
    return read.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("o_custkey").alias("keys"),
        rounded(F.sum("o_totalprice"), 2).alias("price"),
        F.count_distinct("o_orderpriority").alias("priorities"),
        F.count_if("big").alias("big"),
    )


@query(
    """
    SELECT doc_id, lang, n_chars, length(body) AS length, sha256(body) AS digest
    FROM (SELECT *, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS body FROM documents)
    WHERE body <> ''
    """
)
def csv_quoted_text(spark, sf_dir):
    """Whole texts with line breaks, quotes and delimiters in quoted cells, written and read back in splits."""
    path = shared_folder(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", "text").filter("text <> ''")
    options = {"quoteAll": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    docs.write.options(header=True, **options).csv(path)
    read = read_csv(spark, path)
    return read.select(
        "doc_id", "lang", "n_chars", F.char_length("text").alias("length"), F.sha2("text", 256).alias("digest")
    )


@query(
    """
    SELECT o_orderstatus, count(*) AS n, CAST(sum(CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END) AS BIGINT) AS keys,
      count(CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 1 END) AS known, 'bigint' AS key_type, 'string' AS empty_type
    FROM orders GROUP BY o_orderstatus
    """
)
def csv_with_missing_integers(spark, sf_dir):
    """Integers of which some are missing stay integers; a column without any value is text."""
    path = shared_folder(spark)
    key = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey"))
    orders = table(spark, sf_dir, "orders").select("o_orderstatus", key.alias("key"), F.lit(None).cast("string").alias("empty"))
    write_scored(orders, path, format="csv")
    read = read_csv(spark, path)
    kinds = [F.lit(read.schema[c].dataType.simpleString()).alias(f"{c}_type") for c in ("key", "empty")]
    return read.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum("key").alias("keys"), F.count("key").alias("known"), *kinds
    )


@query(
    """
    SELECT l_linenumber, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys, round(sum(l_quantity), 2) AS quantity
    FROM lineitem GROUP BY l_linenumber
    """
)
def csv_whitespace(spark, sf_dir):
    """Several files of cells apart by runs of blanks and tabs, each with its header."""
    path = shared_folder(spark)
    head = "l_orderkey l_linenumber\tl_quantity"
    items = table(spark, sf_dir, "lineitem").select(
        F.pmod("l_orderkey", F.lit(3)).cast("int").alias("part"),
        F.concat(F.lit(" "), "l_orderkey", F.lit(" \t "), "l_linenumber", F.lit("   "), "l_quantity", F.lit("\t")).alias(head),
    )
    # Every task writes files of its own, and the writer puts the header on each: nothing is gathered or sorted by file.
    bare = {"header": True, "quote": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    for i in range(3):
        items.filter(F.col("part") == i).select(head).write.options(**bare).csv(f"{path}/part={i}")
    read = read_csv(spark, path, delimiter=WHITESPACE)
    return read.groupBy(F.col("l_linenumber").cast("int").alias("l_linenumber")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys"), rounded(F.sum("l_quantity"), 2).alias("quantity")
    )


@query(
    """
    SELECT n_regionkey, count(*) AS n, CAST(sum(n_nationkey) AS BIGINT) AS keys,
      min(n_name) AS first_name
    FROM nation GROUP BY n_regionkey
    """
)
def csv_with_lines_before_header(spark, sf_dir):
    """A semicolon-separated text whose header is on the third line."""
    path = shared_folder(spark)
    rows = table(spark, sf_dir, "nation").select(
        F.concat_ws(";", "n_nationkey", "n_name", "n_regionkey").alias("value"),
        F.col("n_nationkey").alias("k"),
    )
    head = spark.createDataFrame(
        [("nations", -3), ("exported", -2), ("n_nationkey;n_name;n_regionkey", -1)],
        "value string, k int",
    )
    rows.unionByName(head).coalesce(1).sortWithinPartitions("k").select("value").write.text(path)
    read = read_csv(spark, path, delimiter=";", header_row=2)
    return read.groupBy("n_regionkey").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("n_nationkey").alias("keys"),
        F.min("n_name").alias("first_name"),
    ).withColumn("n_regionkey", F.col("n_regionkey").cast("int"))


@query(
    """
    WITH e AS (SELECT quantile_cont(l_quantity, [0.25, 0.5, 0.75]) AS q FROM lineitem)
    SELECT CASE WHEN l_quantity <= q[1] THEN 0 WHEN l_quantity <= q[2] THEN 1
                WHEN l_quantity <= q[3] THEN 2 ELSE 3 END AS segment,
      count(*) AS n, round(sum(l_extendedprice), 2) AS balance
    FROM lineitem, e GROUP BY 1
    """
)
def scored_table_written(spark, sf_dir):
    """A scored table written as parquet laid out by segment, then summed up."""
    path = shared_folder(spark)
    rows = loans(spark, sf_dir)
    chain = [Step("l_quantity", tuple(quantile_bands(rows, "l_quantity", 4)))]
    write_scored(score(rows, chain), path, partition_by=["segment"])
    return spark.read.parquet(path).groupBy("segment").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.sum("balance"), 2).alias("balance")
    )


@query(
    """
    SELECT l_linenumber AS segment, count(*) AS n,
      round(sum(CASE WHEN l_linenumber IN (2, 5) THEN 2 * l_extendedprice ELSE l_extendedprice END), 2) AS balance
    FROM lineitem GROUP BY 1
    """
)
def segments_rewritten(spark, sf_dir):
    """Two segments of a written table made anew; the others are left as they were."""
    path = shared_folder(spark)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("segment"), "l_extendedprice")
    write_scored(rows, path, partition_by=["segment"])
    doubled = rows.filter("segment IN (2, 5)").withColumn("l_extendedprice", 2 * F.col("l_extendedprice"))
    write_scored(doubled, path, partition_by=["segment"], replace_partitions=True)
    found = spark.read.parquet(path).groupBy("segment")
    return found.agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("l_extendedprice"), 2).alias("balance"))

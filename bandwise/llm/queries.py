"""The operators applied to the supplied tables, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bandwise.llm import chat, collocations, decontamination, langid, lines, merkle, mixing, secrets, simhash, toxicity, urls, vectors, warc
from bandwise.llm.common import ascii_lower, remainder_of_id, stored, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


@_query("""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    length(text) - length(regexp_replace(text, '[#$%&*!@^~|<>{}\\[\\]\\\\]', '', 'g')) AS symbols, length(text) AS chars
  FROM documents),
keyed AS (
  SELECT doc_id, source, size,
    -ln((('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || size::VARCHAR), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0)
      / coalesce(1.0::DOUBLE / (1.0::DOUBLE + 100.0::DOUBLE * nullif(symbols::DOUBLE / nullif(chars, 0)::DOUBLE, 0.0::DOUBLE)), 1.0::DOUBLE) AS k
  FROM sized),
sources AS (
  SELECT source, sum(size)::BIGINT AS words,
    CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY 2.0 * words / weight, source) AS r,
    coalesce(sum(2 * words) OVER (ORDER BY 2.0 * words / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS full_before,
    sum(weight) OVER (ORDER BY 2.0 * words / weight DESC, source DESC)::DOUBLE AS weighing,
    1.5 * sum(words) OVER () AS total
  FROM sources),
levels AS (
  SELECT arg_min((total - full_before) / weighing, r) FILTER (2.0 * words / weight > (total - full_before) / weighing) AS level FROM ranked),
goals AS (
  SELECT source, words, round(least(2.0 * words, coalesce(level * weight, 2.0 * words))::DOUBLE, 6) AS target
  FROM sources, levels),
plan AS (
  SELECT *, CASE WHEN words > 0 THEN floor(target / words)::BIGINT ELSE 0 END AS epochs FROM goals),
placed AS (
  SELECT k.doc_id, k.source, size, k, words, target, epochs, floor(target)::BIGINT - epochs * words AS rest,
    sum(size) OVER (PARTITION BY k.source ORDER BY k RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS until,
    sum(size) OVER (PARTITION BY k.source, k) AS tied
  FROM keyed k JOIN plan p ON k.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, words AS source_size, target,
  (size * epochs + CASE WHEN rest = 0 OR until - tied >= rest THEN 0 WHEN until <= rest THEN size
    ELSE floor((rest - until + tied) * size / tied) END)::BIGINT AS taken
FROM placed""")
def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the words of each that the mix takes."""
    return mixing.mix(table(spark, sf_dir, "documents"))


_TALK = chat.HEAD + "Assistant: </turn> ok"


@_query("""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
esc AS (
  SELECT *, replace(replace(replace(text, '\\', '\\\\'), '</turn>', '<\\/turn>'), '### ', '#\\## ') AS etext,
    replace(replace(replace(replace(role, '\\', '\\\\'), '</turn>', '<\\/turn>'), '### ', '#\\## '), ':', '\\:') AS erole
  FROM said)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(4 + length(erole) + 2 + length(etext) + 8)::BIGINT AS formatted_chars
FROM esc GROUP BY conv_id""")
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as event logs of one message a row, folded, rendered, and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "\\" + _TALK
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], rows.schema)
    rows = rows.unionByName(extra).withColumns({c: F.coalesce(c, F.lit("")) for c in ("role", "text")})
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    events = rows.select("conv_id", place.alias("seq"), place.alias("turn"), F.lit("message").alias("op"), "role", "text")
    return chat.digests(chat.render(chat.fold(events)))


RULES = [
    urls.Rule("allow", "com"),
    urls.Rule("block", "example.com", "/en/"),
    urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"),
    urls.Rule("block", "net", "/fr/"),
]


@_query(r"""
WITH nodes AS (
  SELECT url FROM pages UNION
  SELECT regexp_replace(url, '(\?utm_source=[^&#]*)?(#(.|\n)*)?$', '') FROM pages WHERE url IS NOT NULL),
parts AS (
  SELECT url, regexp_replace(url, '(\?utm_source=[^&#]*)?(#(.|\n)*)?$', '') AS base,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM nodes),
ruled AS (
  SELECT *,
    CASE
      WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
      WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
      WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/'
    END AS rule
  FROM parts),
classes AS (
  SELECT base, bool_or(rule IN ('com/', 'www.example.com/en/')) AS allowed, bool_or(rule IS NOT NULL) AS blocked
  FROM ruled GROUP BY base)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN coalesce(allowed, false) THEN 'allow' WHEN coalesce(blocked, false) THEN 'block' ELSE 'allow' END AS verdict
FROM pages JOIN ruled ON pages.url IS NOT DISTINCT FROM ruled.url LEFT JOIN classes USING (base)""")
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages judged by rules, and by those of their aliases."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    judged = urls.judge_urls(pages.select("page_id", "url"), RULES, urls.alias_edges(pages))
    return judged.select("page_id", *[F.col(f"_{c}").alias(c) for c in ("host", "path", "rule", "verdict")])


@_query()
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items it contains."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.contaminated_documents(docs, table(spark, sf_dir, "benchmark"))
    own = docs.select("doc_id", F.xxhash64("text").alias("_own"))
    joined = own.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_body")), "left")
    return joined.select(
        "doc_id",
        F.col("_body").isNotNull().alias("contaminated"),
        F.coalesce("_n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("_items", F.lit("")).alias("item_ids"),
        F.coalesce("_max_share", F.lit(0.0)).alias("max_share"),
    )


_KEY = r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"


def _spans_sql(kind: str, rank: int, pattern: str, good: str) -> str:
    """Matches in order; a place is found behind the one before, which leftmost matching makes the right one."""
    return f"""
  SELECT id, '{kind}' AS kind, {rank} AS rank, start, start + length(found) AS stop FROM (
    SELECT id, unnest(found) AS found,
      unnest(list_transform(list_zip(range(len(found)), found), lambda x: (
        coalesce(list_sum(list_transform(gaps[1:x[1] + 1], lambda g: length(g))), 0)
        + coalesce(list_sum(list_transform(found[1:x[1]], lambda f: length(f))), 0))::BIGINT)) AS start
    FROM (SELECT id, regexp_extract_all(text, '{pattern}') AS found, regexp_split_to_array(text, '{pattern}') AS gaps
      FROM texts WHERE regexp_matches(text, '{pattern}')))
  WHERE {good}"""


_ASSIGN = _KEY + r"""["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+"""
_ASSIGN_VALUE = "length(regexp_extract(found, '^" + _KEY + r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 6"""


@_query(f"""
WITH texts AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({_spans_sql("assign", 1, _ASSIGN, _ASSIGN_VALUE)}
  UNION ALL {_spans_sql("access", 2, "AKIA[A-Z0-9]+", "length(found) >= 20")}
  UNION ALL {_spans_sql("hex", 3, "[0-9a-f]+", "length(found) >= 24")}
  UNION ALL {_spans_sql("pem", 4, "-----BEGIN [A-Z ]*PRIVATE KEY-----", "true")}),
by_text AS (
  SELECT id, count(*) FILTER (rank = 1) AS n_assign, count(*) FILTER (rank = 2) AS n_access, count(*) FILTER (rank = 3) AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank <= 3) AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
  FROM spans GROUP BY id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN by_text USING (id)""")
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the spans of secrets in them."""
    return secrets.secrets(table(spark, sf_dir, "documents"))


@_query("""
WITH RECURSIVE good AS (
  SELECT vec_id, embedding::DOUBLE[64] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a, good b
  WHERE a.vec_id <> b.vec_id AND array_cosine_similarity(a.v, b.v) >= 0.9),
reach(node, root) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node WHERE r.root <= l.b),
component AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN component ON node = vec_id""")
def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with their links and components."""
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


@_query()
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their language, learned from three quarters of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    remainder = remainder_of_id(F.col("doc_id"), 4)
    model = langid.train(docs, remainder != 2, F.col("doc_id"))
    held_out = F.coalesce(remainder == 2, F.lit(False)).alias("held_out")
    return langid.identify(docs.select("doc_id", held_out, "text"), model).select(
        "doc_id", "held_out", F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score")
    )


@_query()
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their toxicity, learned from the labels of four fifths."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    remainder = remainder_of_id(F.col("doc_id"), 5)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), remainder != 0)
    return toxicity.score_toxicity(docs, model).select(
        F.col("_id").alias("doc_id"),
        F.coalesce(remainder_of_id(F.col("_id"), 5) == 0, F.lit(False)).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"),
    )


@_query()
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their fingerprints and components."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@_query("""
WITH texts AS (SELECT row_number() OVER () AS id, doc_id, string_split(coalesce(text, ''), chr(10)) AS split FROM documents),
lines AS (SELECT id, doc_id, unnest(split) AS line, unnest(range(len(split))) AS no FROM texts),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
owners AS (SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT keyed.*, owner IS NOT NULL AND owner <> doc_id AS lost FROM keyed LEFT JOIN owners USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY id""")
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that earlier documents have."""
    docs = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").cast("long").alias("n_dropped"), F.sha2("_kept", 256).alias("kept_sha256")
    )


def _crc32_sql(text: str) -> str:
    """CRC-32 of ASCII text, bit by bit."""
    step = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    byte = f"list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: {step})"
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda d: ascii(d)::BIGINT)), lambda c, b: {byte}), 4294967295)"


def _merkle_sql(levels: int = 6, upper: int = 2) -> str:
    """Levels written out: enough for 8 ** levels rows a language and 8 ** upper languages."""

    def encoded(column: str) -> str:
        return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}::VARCHAR, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join([*map(encoded, ("doc_id", "source", "lang", "n_chars")), encoded(text)]) + ")"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"""leaves AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce('=' || lang, '') AS grp, {leaf("text")} AS leaf,
    CASE WHEN {_crc32_sql("doc_id::VARCHAR")} % 3 = 0 THEN {leaf(lower)} ELSE {leaf("text")} END AS changed
  FROM documents)""",
        "n0 AS (SELECT grp, id, leaf AS node, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf, id) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM leaves)",
    ]

    def tree(name: str, levels: int) -> None:
        for k in range(levels):
            parts.append(
                f"{name}{k + 1} AS (SELECT grp, pos // 8 AS pos, max(n) AS n, CASE WHEN max(n) > {8**k} THEN sha256(string_agg(node, '' ORDER BY pos)) ELSE max(node) END AS node "
                f"FROM {name}{k} GROUP BY grp, pos // 8)"
            )

    def fold(name: str, nodes: str, levels: int) -> None:
        for k in range(levels):
            parts.append(
                f"{name}{k + 1} AS (SELECT f.id, f.grp, f.pos // 8 AS pos, "
                f"CASE WHEN max(t.n) > {8**k} THEN sha256(string_agg(CASE WHEN t.pos = f.pos THEN f.node ELSE t.node END, '' ORDER BY t.pos)) ELSE max(f.node) END AS node, "
                f"max(f.proof) || coalesce(string_agg(t.node, '' ORDER BY t.pos) FILTER (t.pos <> f.pos), '') AS proof "
                f"FROM {name}{k} f JOIN {nodes}{k} t ON t.grp = f.grp AND t.pos // 8 = f.pos // 8 GROUP BY f.id, f.grp, f.pos)"
            )

    tree("n", levels)
    parts.append(f"m0 AS (SELECT '' AS grp, grp AS name, node, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM n{levels})")
    tree("m", upper)
    parts.append("f0 AS (SELECT l.id, l.grp, n0.pos, changed AS node, '' AS proof FROM leaves l JOIN n0 USING (id))")
    fold("f", "n", levels)
    parts.append(f"g0 AS (SELECT f.id, m0.grp, m0.pos, f.node, f.proof FROM f{levels} f JOIN m0 ON m0.name = f.grp)")
    fold("g", "m", upper)
    return (
        "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, m0.node AS subroot, m{upper}.node AS root, sha256(g.proof) AS proof_sha256, g.node AS folded_root, g.node = m{upper}.node AS verified
FROM leaves l JOIN m0 ON m0.name = l.grp JOIN g{upper} g ON g.id = l.id CROSS JOIN m{upper}"""
    )


@_query(_merkle_sql())
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as leaves, with their proofs; in a third of them the text is tampered with."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(remainder_of_id(F.col("doc_id"), 3) == 0, ascii_lower(F.col("text"))).otherwise(F.col("text"))
    rows = merkle.proofs(merkle.manifest(docs, changed={"text": tampered}))
    return rows.select(
        F.col("_id").alias("doc_id"),
        merkle.as_hex(F.col("_node")).alias("leaf"),
        merkle.as_hex(F.col("_subroot")).alias("subroot"),
        merkle.as_hex(F.col("_root")).alias("root"),
        F.col("_proof").alias("proof_sha256"),
        merkle.as_hex(F.col("_folded")).alias("folded_root"),
        F.col("_verified").alias("verified"),
    )


@_query("""
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, coalesce(html, '') AS payload, unhex(sha1(coalesce(html, '')))::BIT::VARCHAR AS bits FROM pages),
firsts AS (SELECT payload, min(page_id) AS first_id FROM hashed GROUP BY payload)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda j: substr(bits, 5 * i + j + 1, 1)::INT * (16 >> j)))::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM hashed JOIN firsts USING (payload)""")
def op11_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as WARC records in ZIP packages, read back by ranges."""
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    packages = warc.write_packages(pages)
    found = warc.resolve_revisits(stored(warc.read_records(stored(warc.locate_records(packages), "ranges")), "records"))
    return found.select(
        F.col("_id").cast(kind).alias("page_id"),
        F.col("_bytes").alias("payload_bytes"),
        F.col("_digest").alias("payload_digest"),
        F.col("_type").alias("record_type"),
        F.col("_refers_id").cast(kind).alias("refers_to"),
    )


@_query(r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
    string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS split
  FROM documents),
listed AS (
  SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM (SELECT lang, unnest(split) AS piece FROM pieces)),
tokens AS (SELECT lang, id, unnest(words) AS w1, generate_subscripts(words, 1) AS pos FROM listed),
chains AS (
  SELECT lang, w1, lead(w1, 1) OVER w AS w2, lead(w1, 2) OVER w AS w3, lead(w1, 3) OVER w AS w4, lead(w1, 4) OVER w AS w5
  FROM tokens WINDOW w AS (PARTITION BY id ORDER BY pos)),
totals AS (SELECT lang, count(*) AS n FROM chains GROUP BY lang),
counts AS (
  SELECT lang, [w1] AS ids, count(*) AS f FROM chains GROUP BY ALL HAVING count(*) >= 100
  UNION ALL SELECT lang, [w1, w2], count(*) FROM chains WHERE w2 IS NOT NULL GROUP BY lang, w1, w2 HAVING count(*) >= 100
  UNION ALL SELECT lang, [w1, w2, w3], count(*) FROM chains WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3 HAVING count(*) >= 100
  UNION ALL SELECT lang, [w1, w2, w3, w4], count(*) FROM chains WHERE w4 IS NOT NULL GROUP BY lang, w1, w2, w3, w4 HAVING count(*) >= 100
  UNION ALL SELECT lang, [w1, w2, w3, w4, w5], count(*) FROM chains WHERE w5 IS NOT NULL GROUP BY lang, w1, w2, w3, w4, w5 HAVING count(*) >= 100),
whole AS (SELECT * FROM counts WHERE len(ids) >= 2),
cuts AS (SELECT *, unnest(range(1, len(ids))) AS k FROM whole),
scored AS (
  SELECT c.lang, c.ids, c.f AS a, c.k, x.f AS l, y.f AS r, n, ((1000::HUGEINT * c.f * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.ids = c.ids[1:c.k] JOIN counts y ON y.lang = c.lang AND y.ids = c.ids[c.k + 1:] JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, ids ORDER BY score, k) = 1),
inner_parts AS (
  SELECT lang, ids[i:i + m - 1] AS ids, max(f) AS longer
  FROM (SELECT *, unnest(range(1, len(ids) - m + 2)) AS i FROM (SELECT *, unnest(range(2, len(ids))) AS m FROM whole)) GROUP BY ALL),
kept AS (
  SELECT b.*, array_to_string(b.ids, ' ') AS phrase FROM best b LEFT JOIN inner_parts p ON p.lang = b.lang AND p.ids = b.ids
  WHERE longer IS NULL OR 100 * longer < 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score
FROM kept QUALIFY rank <= 2000""")
def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first phrases of each language by how much more often they occur than chance."""
    rows = collocations.collocations(table(spark, sf_dir, "documents"))
    return rows.select(*[F.col(f"_{c}").alias(c) for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")])

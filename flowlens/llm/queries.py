"""The registered queries of the operators, and the SQL that checks them where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import decontaminate, html_text, manifest, nearest, pieces, secrets, shingle_join, suffixes, token_counts, toxicity, urls, vectors, whitening
from flowlens.llm.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


URL_RULES = [
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
]

URL_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(rule, verdict) AS (VALUES %s),
fits AS (
  SELECT page_id, host, path, rule, r.verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) AS rn
  FROM parts LEFT JOIN rules r ON ('.' || host) LIKE ('%%.' || split_part(rule, '/', 1))
    AND starts_with(path, substr(rule, strpos(rule, '/'))))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE rn = 1
""" % ", ".join(f"('{rule}', '{verdict}')" for verdict, rule in URL_RULES)


@register("op1_url_filter", URL_SQL)
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


@register("op2_shingle_join")
def similar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.join_similar(table(spark, sf_dir, "documents")).drop("key", "root")


@register("op3_repeated_strings")
def repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


@register("op4_toxicity")
def toxic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_documents(docs, toxicity.fit_on(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending",
    )


@register("op5_secret_scan")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(F.encode(secrets.joined(base), "UTF-8"), 256).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"),
    )


@register("op6_sentencepiece")
def sentencepiece_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(pieces.encode_pieces(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model")))


def piece_digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


@register("op7_html_text")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract_text(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


@register("op8_vector_duplicates")
def vector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


@register("op9_decontamination")
def benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op10_token_counts")
def token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


MANIFEST_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def field_sql(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE octet_length(encode(CAST({value} AS VARCHAR))) || ':' || {value} END"


def tree_sql(name: str, leaves: str, levels: int) -> str:
    """CTEs of all levels of the trees over ``leaves`` (grp, ord, d); enough for 16^levels leaves in a tree."""
    sized = "count(*) OVER (PARTITION BY grp) AS size"
    parts = [f"{name}0 AS (SELECT 0 AS level, grp, ord, d, {sized} FROM ({leaves}))"]
    for k in range(levels):
        parts.append(
            f"{name}{k + 1} AS (SELECT *, {sized} FROM (SELECT {k + 1} AS level, grp, ord // 16 AS ord, sha256(string_agg(d, '' ORDER BY ord)) AS d "
            f"FROM {name}{k} WHERE size > 1 GROUP BY grp, ord // 16))"
        )
    parts.append(f"{name} AS ({' UNION ALL '.join(f'SELECT * FROM {name}{k}' for k in range(levels + 1))})")
    parts.append(f"""{name}_steps AS (
  SELECT grp, leaf, list(before || '|' || after ORDER BY level) AS steps FROM (
    SELECT l.grp, l.ord AS leaf, x.level, coalesce(string_agg(x.d, '' ORDER BY x.ord) FILTER (x.ord < l.ord >> (4 * x.level)), '') AS before,
      coalesce(string_agg(x.d, '' ORDER BY x.ord) FILTER (x.ord > l.ord >> (4 * x.level)), '') AS after
    FROM {name}0 l JOIN {name} x ON x.grp = l.grp AND x.size > 1 AND x.ord // 16 = l.ord >> (4 * x.level + 4) GROUP BY ALL)
  GROUP BY grp, leaf)""")
    return ",\n".join(parts)


CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
  lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))))"""

MANIFEST_SQL = f"""
WITH named AS (
  SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, CASE WHEN source IS NULL THEN '' ELSE '+' || source END AS grp
  FROM documents),
hashed AS (
  SELECT doc_id, grp, sha256(concat({", ".join(field_sql(c) for c in MANIFEST_COLUMNS)})) AS d,
    CASE WHEN {CRC} % 5 = 0 THEN sha256(concat({", ".join(field_sql("low" if c == "text" else c) for c in MANIFEST_COLUMNS)})) END AS changed
  FROM named),
leaves AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, d) - 1 AS ord FROM hashed),
{tree_sql("s", "SELECT grp, ord, d FROM leaves", 5)},
tops AS (SELECT grp AS source, row_number() OVER (ORDER BY encode(grp)) - 1 AS ord, d FROM s WHERE size = 1),
{tree_sql("t", "SELECT 'all' AS grp, ord, d FROM tops", 3)},
paths AS (
  SELECT l.doc_id, l.d AS leaf, l.changed, p.d AS subroot, (SELECT d FROM t WHERE size = 1) AS root,
    list_concat(coalesce(a.steps, []), coalesce(b.steps, [])) AS steps
  FROM leaves l JOIN tops p ON p.source = l.grp LEFT JOIN s_steps a ON a.grp = l.grp AND a.leaf = l.ord LEFT JOIN t_steps b ON b.leaf = p.ord)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(steps, ''), '|', '')) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM (SELECT *, list_reduce(list_concat([coalesce(changed, leaf)], steps), lambda h, x: sha256(split_part(x, '|', 1) || h || split_part(x, '|', 2))) AS folded FROM paths)
"""


@register("op11_merkle_manifest", MANIFEST_SQL)
def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lower = F.translate("text", manifest.UPPER, manifest.UPPER.lower())
    found = manifest.manifest(
        docs, MANIFEST_COLUMNS, altered=[lower if c == "text" else F.col(c) for c in MANIFEST_COLUMNS],
        is_altered=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0,
    )
    return found.select(
        "doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("path")).alias("proof_sha256"),
        manifest.folded(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))



TOP_SQL = """
WITH x AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: floor(1024 * CAST(c AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, q.r, x.vec_id, CAST(list_inner_product(q.v, x.v) AS BIGINT) AS score FROM x q JOIN x ON q.r <> x.r WHERE q.vec_id % 100 = 0),
best AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM best WHERE rank <= 10
"""


@register("op12_top_products", TOP_SQL)
def top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@register("op13_whitening")
def whitened_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))

"""The queries of the text operators: thin contracts over the operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprint, jaccard, langid, linededup, mixing, packing, quality, sharding, tokenbin, urltrie
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    clean = linededup.drop_boilerplate(docs.withColumn("n_lines", F.size(F.split("text", "\n")).cast("long")), dropped="n_dropped")
    return clean.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "epochs")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urltrie.judge(table(spark, sf_dir, "pages"), urltrie.PRODUCTION_RULES)


def tokenizer(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public tokenizer's file, which every executor has installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer())


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.round_trip(table(spark, sf_dir, "documents"), tokenizer())


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.cluster(table(spark, sf_dir, "documents"))


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


OP4_SQL = """
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
t AS (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS tl FROM l),
f AS (SELECT source, tl, count(DISTINCT doc_id) AS n FROM t WHERE tl <> '' GROUP BY source, tl),
p AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
bad AS (SELECT f.source, f.tl FROM f JOIN p ON f.source IS NOT DISTINCT FROM p.source WHERE n >= 5 AND n > CAST(0.02 AS DOUBLE) * pages),
m AS (SELECT t.*, bad.tl IS NOT NULL AS is_bad FROM t LEFT JOIN bad ON t.source IS NOT DISTINCT FROM bad.source AND t.tl = bad.tl),
g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE is_bad) AS nb, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT is_bad) AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(g.n_lines AS BIGINT) AS n_lines, CAST(g.nb AS BIGINT) AS n_dropped, sha256(CASE WHEN g.nb > 0 THEN coalesce(g.kept, '') ELSE d.text END) AS text_sha256
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
"""

OP6_SQL = r"""
WITH r(rh, rp, rv) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
c AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM c),
m AS (SELECT u.*, rh || rp AS rule, rv, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rh) - length(replace(rh, '.', '')) DESC NULLS LAST, length(rp) DESC) AS k
      FROM u LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM m WHERE k = 1
"""

OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
k AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM k),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * common >= 80 * (nx.n + ny.n - common)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.root) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id, n.n
"""

QUERIES: dict[str, Query] = {
    "op1_fingerprint": op1_fingerprint,
    "op2_quality": op2_quality,
    "op3_language": op3_language,
    "op4_line_dedup": op4_line_dedup,
    "op5_mix": op5_mix,
    "op6_url_filter": op6_url_filter,
    "op7_pack": op7_pack,
    "op8_jaccard": op8_jaccard,
    "op9_shard": op9_shard,
    "op10_tokens": op10_tokens,
}

SQL: dict[str, str] = {"op4_line_dedup": OP4_SQL, "op6_url_filter": OP6_SQL, "op8_jaccard": OP8_SQL}

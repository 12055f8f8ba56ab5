"""The registered queries of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statera.llm.best_position import search
from statera.llm.block_neighbours import nearest
from statera.llm.common import fresh_path, table
from statera.llm.compaction import compacted_documents
from statera.llm.license_align import license_scan
from statera.llm.mixture import mix_report
from statera.llm.order_minhash import edit_report
from statera.llm.packing import packed_documents
from statera.llm.simhash_trie import near_duplicates
from statera.llm.token_cache import TokenCache, token_counts
from statera.llm.token_store import read_store, write_store
from statera.llm.topk_threshold import top_k
from statera.llm.toxicity import toxicity_scores
from statera.llm.variant_trie import spelling_variants


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-store")
    write_store(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_store(spark, path)


def op2_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compacted_documents(table(spark, sf_dir, "documents"))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_report(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, cache = table(spark, sf_dir, "documents"), TokenCache(spark, fresh_path(spark, "token-cache"), public_tokenizers.path("piece_bpe_32k.model"))
    token_counts(docs, cache)
    return token_counts(docs, cache)  # the second round finds every digest


def op4_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_store": op1_token_store,
        "op2_compaction": op2_compaction,
        "op3_top_k": op3_top_k,
        "op4_mixture": op4_mixture,
        "op5_licenses": op5_licenses,
        "op6_order_minhash": op6_order_minhash,
        "op7_token_counts": op7_token_counts,
        "op8_simhash": op8_simhash,
        "op9_packing": op9_packing,
        "op10_toxicity": op10_toxicity,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_nearest": op12_nearest,
        "op13_lexical_search": op13_lexical_search,
    }


#: Each document's place in the mix: sources share all words by weight, full ones (3 times their size) first, then ranks by size class, salt and id.
MIX_SQL = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
k AS (SELECT *, length(bin(size)) AS bits, CAST(concat('0x', md5(coalesce(CAST(doc_id AS VARCHAR), ''))[1:4]) AS BIGINT) % 16 AS salt FROM d),
c AS (SELECT *, greatest(bits - 5, 0) * 16 + (size >> greatest(bits - 5, 0)) AS class FROM k),
s AS (SELECT source, sum(size) AS source_size, (ARRAY[5, 2, 1])[(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / weight, source) AS n FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(weight) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level FROM o),
t AS (SELECT source, source_size, least(3.0 * source_size, weight * (SELECT arg_min(level, n) FROM l WHERE level * weight <= 3 * source_size)) AS target FROM l),
r AS (SELECT c.*, CAST(t.source_size AS BIGINT) AS source_size, CAST(t.target AS DOUBLE) AS target, CASE WHEN t.source_size > 0 THEN CAST(t.target AS DOUBLE) / t.source_size ELSE 0 END AS rate,
  row_number() OVER (PARTITION BY c.source ORDER BY class, salt, doc_id NULLS FIRST, size) AS rank, CAST(CAST(concat('0x', md5(concat('mix', coalesce(concat('=', c.source), '')))[1:8]) AS BIGINT) AS DOUBLE) / 4294967296.0 AS shift FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, round(target, 6) AS target, CAST((floor(rate * rank + shift) - floor(rate * (rank - 1) + shift)) * size AS BIGINT) AS taken, source, CAST(floor(rate * rank + shift) - floor(rate * (rank - 1) + shift) AS BIGINT) AS copies FROM r
"""

TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""


def _crc32_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, half a byte at a time, lower halves first."""

    def entry(c: int) -> int:
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        return c

    steps = "[" + ", ".join(f"{entry(i)}::BIGINT" for i in range(16)) + "]"
    halves = f"list_transform(range(length(hex(encode({text})))), lambda i: CAST(instr('0123456789ABCDEF', substr(hex(encode({text})), xor(i, 1) + 1, 1)) - 1 AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {halves}), lambda c, x: xor(c >> 4, {steps}[(xor(c, x) & 15) + 1])), 4294967295)"


VARIANTS_SQL = f"""
WITH RECURSIVE r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{7,}}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
o AS (SELECT run, count(*) AS n, concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', run) AS named FROM r GROUP BY doc_id, run),
h AS (SELECT run, n, {_crc32_sql("named")} AS h FROM o),
v AS (SELECT CASE WHEN h % 31 = 0 THEN concat(left(run, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word, n FROM h),
w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM v WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
x AS MATERIALIZED (SELECT word, left(word, i) AS p, substr(word, i + 2) AS s FROM (SELECT word, unnest(range(length(word))) AS i FROM w)),
l AS (SELECT DISTINCT x.word AS longer, w.word AS shorter FROM x JOIN w ON w.word = x.p || x.s),
e AS (SELECT a.word, b.word AS near FROM x a JOIN x b ON a.p = b.p AND a.s = b.s AND a.word <> b.word UNION SELECT longer, shorter FROM l UNION SELECT shorter, longer FROM l),
b AS (SELECT e.word, count(*) AS n_near, arg_min(e.near, (-w.n, e.near)) AS form, max(w.n) AS form_n FROM e JOIN w ON w.word = e.near GROUP BY e.word),
f AS MATERIALIZED (SELECT w.word, w.n, CAST(coalesce(b.n_near, 0) AS BIGINT) AS n_near, CASE WHEN form_n >= 10 * w.n THEN form END AS form, CASE WHEN form_n >= 10 * w.n THEN form_n END AS form_n FROM w LEFT JOIN b ON b.word = w.word),
c AS (SELECT word, word AS root FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM f JOIN c ON c.word = f.word JOIN f AS t ON t.word = c.root WHERE t.form IS NULL
"""

NEAREST_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, sqrt(list_reduce(list_transform(list_zip(a.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda total, square: total + square)) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM s) WHERE rank <= 10
"""

#: Terms of both tables, then each document's score for each item by plain sums.
SEARCH_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms, row_number() OVER () AS r FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM benchmark),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(terms) AS term FROM i) GROUP BY ALL),
g AS (SELECT CAST(count(*) FILTER (WHERE len(terms) > 0) AS BIGINT) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS words FROM d),
t AS (SELECT r, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, doc_id, CAST(len(terms) AS BIGINT) AS n, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight FROM t, g GROUP BY term, n_docs),
p AS (SELECT r, doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // words))) AS impact FROM t JOIN w USING (term), g),
s AS (SELECT item_id, r, doc_id, CAST(sum(times * impact) AS BIGINT) AS score FROM q JOIN p USING (term) GROUP BY ALL HAVING sum(times * impact) > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s) WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_compaction": "SELECT doc_id, length(text) AS n_chars, md5(text) AS text_md5, lang, source FROM documents",
        "op3_top_k": TOP_K_SQL,
        "op4_mixture": MIX_SQL,
        "op11_spelling_variants": VARIANTS_SQL,
        "op12_nearest": NEAREST_SQL,
        "op13_lexical_search": SEARCH_SQL,
    }

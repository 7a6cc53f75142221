"""The registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cap_filters, hard_negatives, language_id, license_scan, ngram_join, packing, piece_codec, piecewise, pivot_index, prefix_trie, pseudonyms, site_templates, toxicity
from .common import table

#: Key of the registered pseudonym query; a deployment passes its own secret.
PSEUDONYM_KEY = "synthetic-test-data"

def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), digests_only=True)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all pages, by text models fitted on labelled documents."""
    models = language_id.fit(table(spark, sf_dir, "documents"), "text", "lang", "doc_id")
    found = language_id.identify(table(spark, sf_dir, "pages"), models, text_col="html", url_col="url", markup=True, keep=("page_id", "url"))
    return found.select("page_id", "url", "language", "confidence", "text_language", "accepted")


def op3_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return pivot_index.search(vectors, vectors.filter("vec_id % 100 = 0"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonyms.pseudonymise(table(spark, sf_dir, "documents"), key=PSEUDONYM_KEY)
    return found.select("doc_id", "text", "n_found")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_templates.main_text(table(spark, sf_dir, "pages"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each rebuilt on the beginning of the first of its hundred."""
    return prefix_trie.prefix_trie(prefix_trie.with_shared_starts(prefix_trie.sequences(table(spark, sf_dir, "conversations"))))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; every seventh has its label moved on by one."""
    label = F.col("label").cast("bigint")
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives.mine(vectors, vectors.filter("vec_id % 100 = 0"))


def op13_piecewise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecewise.compare_edited(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_language_id": op2_language_id,
    "op3_cap_filters": op3_cap_filters,
    "op4_pivot_index": op4_pivot_index,
    "op5_packing": op5_packing,
    "op6_pseudonyms": op6_pseudonyms,
    "op7_license_scan": op7_license_scan,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_toxicity": op9_toxicity,
    "op10_site_templates": op10_site_templates,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_piecewise": op13_piecewise,
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: DuckDB SQL where it can say the same rows; the other operators' models, tokenizers and trees are tested by brute force.
ORACLE_SQL: dict[str, str] = {
    "op3_cap_filters": """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT l.b, r.seen FROM r JOIN l ON l.a = r.node),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT c.node AS vec_id, coalesce(n.n, 0) AS n_links, component_id, c.node = component_id AS kept FROM c LEFT JOIN n ON n.a = c.node""",
    "op8_ngram_jaccard": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END)) AS sh FROM w),
k AS (SELECT doc_id, len(sh) AS n, CASE WHEN len(sh) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY md5(array_to_string(sh, '|'))) END AS class_id FROM s),
x AS (SELECT k.doc_id, n, unnest(sh) AS g FROM s JOIN k USING (doc_id) WHERE k.doc_id = class_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS node, doc_id AS seen FROM k WHERE doc_id = class_id UNION SELECT p.b, r.seen FROM r JOIN p ON p.a = r.node),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT doc_id, n AS n_shingles, component_id, class_id FROM k JOIN c ON c.node = k.class_id""",
    "op11_prefix_trie": """WITH o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) ELSE xor(s >> 1, 3988292384 * (s & 1)) END), 4294967295::BIGINT) % 6 AS h FROM (SELECT DISTINCT conv_id FROM o)),
r AS (SELECT c.conv_id, o.pos, role, text FROM c JOIN o ON o.conv_id = c.base AND o.pos <= h UNION ALL SELECT c.conv_id, o.pos, role, text FROM c JOIN o ON o.conv_id = c.conv_id AND o.pos > h),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth, md5(length(role)::VARCHAR || ':' || role || text) AS key, length(text) AS size FROM r),
p AS (SELECT conv_id, depth, size, md5(string_agg(key, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM t UNION ALL SELECT conv_id, 0, 0, '' FROM c),
m AS (SELECT conv_id, depth, size, node, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM p),
n AS (SELECT node, any_value(parent) AS parent, depth, min(conv_id) AS first, count(*) AS members, any_value(size) AS size, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last) AS ends FROM m GROUP BY node, depth),
k AS (SELECT parent, count(*) AS children FROM n WHERE depth > 0 GROUP BY parent),
s AS (SELECT DISTINCT a.node AS top, b.node FROM m a JOIN m b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
z AS (SELECT top, sum((members - 1) * size) AS saved, count(*) FILTER (k.parent IS NULL) AS leaves FROM s JOIN n USING (node) LEFT JOIN k ON k.parent = n.node GROUP BY top)
SELECT n.first AS conv_id, n.depth, u.first AS parent_conv_id, n.members AS n_convs, coalesce(children, 0) AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM n LEFT JOIN n u ON u.node = n.parent LEFT JOIN k ON k.parent = n.node JOIN z ON z.top = n.node""",
    "op12_hard_negatives": """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10""",
}

"""Queries of the operators in this package, with equivalent SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.functions.labels import normal_form_sql
from loomgraph.llm import cross_split, keyword_pages, packing, similar, term_counts, tokenizer
from loomgraph.session import table


#: where the vocabulary file lies for these queries
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return similar.similar_pairs(table(spark, d, "node_embeddings")).select("node_id_a", "node_id_b")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return cross_split.overlaps(table(spark, d, "edge_list")).select("edge_id_a", "edge_id_b")


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    return cross_split.overlap_counts(cross_split.overlaps(table(spark, d, "edge_list")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "edge_list")
    marks = term_counts.marked(term_counts.term_counts(edges), edges.count())
    return marks.filter("mark IS NOT NULL").select("field", "term", "mark")


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    return term_counts.term_counts(table(spark, d, "edge_list"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode(table(spark, d, "documents"), VOCABULARY)


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"), VOCABULARY)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return keyword_pages.keyword_pages(keyword_pages.page_scores(table(spark, d, "documents"))).select("doc_id")


QUERIES = {f.__name__: f for f in (p2_found, p4_found, p4_counts, p5_found, p5_counts, p7_ids, p8_containers, p9_found)}

_S, _T, _D = (normal_form_sql(c) for c in ("src_column", "edge_type_column", "dst_column"))

_TERMS = f"""
WITH n AS (SELECT edge_id, {_S} AS s, {_T} AS t, {_D} AS d FROM edge_list),
u AS (
  SELECT edge_id, 'node' AS field, s AS term FROM n UNION ALL SELECT edge_id, 'node', d FROM n UNION ALL SELECT edge_id, 'edge_type', t FROM n
), counts AS (
  SELECT field, term, count(*) AS occurrences, count(DISTINCT edge_id) AS records FROM u WHERE term IS NOT NULL GROUP BY field, term
)"""

_OVERLAPS = f"""
WITH n AS (
  SELECT edge_id, split, source, {_S} AS s, {_T} AS t, {_D} AS d FROM edge_list
), e AS (SELECT * FROM n WHERE s IS NOT NULL AND t IS NOT NULL AND d IS NOT NULL),
tr AS (SELECT * FROM e WHERE split = 'train'), ev AS (SELECT * FROM e WHERE split IN ('valid', 'test')),
pairs AS (
  SELECT tr.edge_id AS a, ev.edge_id AS b, ev.split, ev.source, (tr.s = ev.s AND tr.d = ev.d) OR (tr.s = ev.d AND tr.d = ev.s) AS exact
    FROM tr JOIN ev ON tr.t = ev.t AND tr.s = ev.s WHERE levenshtein(tr.d, ev.d) <= 1
  UNION SELECT tr.edge_id, ev.edge_id, ev.split, ev.source, (tr.s = ev.s AND tr.d = ev.d) OR (tr.s = ev.d AND tr.d = ev.s)
    FROM tr JOIN ev ON tr.t = ev.t AND tr.d = ev.d WHERE levenshtein(tr.s, ev.s) <= 1
  UNION SELECT tr.edge_id, ev.edge_id, ev.split, ev.source, (tr.s = ev.s AND tr.d = ev.d) OR (tr.s = ev.d AND tr.d = ev.s)
    FROM tr JOIN ev ON tr.t = ev.t AND tr.s = ev.d WHERE levenshtein(tr.d, ev.s) <= 1
  UNION SELECT tr.edge_id, ev.edge_id, ev.split, ev.source, (tr.s = ev.s AND tr.d = ev.d) OR (tr.s = ev.d AND tr.d = ev.s)
    FROM tr JOIN ev ON tr.t = ev.t AND tr.d = ev.s WHERE levenshtein(tr.s, ev.d) <= 1
)"""

SQL = {
    "p2_found": """
WITH e AS (SELECT node_id AS id, embedding::DOUBLE[] AS v FROM node_embeddings WHERE len(embedding) = 64),
u AS (SELECT id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM e WHERE NOT list_bool_or(list_transform(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) AND list_bool_or(list_transform(v, lambda x: x <> 0))),
s AS (SELECT a.id AS x, b.id AS y, round(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) / (a.n * b.n), 6) AS c FROM u a JOIN u b ON a.id <> b.id),
r AS (SELECT x, y, row_number() OVER (PARTITION BY x ORDER BY c DESC, y) AS k FROM s WHERE c >= 0.85)
SELECT DISTINCT least(x, y) AS node_id_a, greatest(x, y) AS node_id_b FROM r WHERE k <= 5""",
    "p4_found": f"{_OVERLAPS} SELECT least(a, b) AS edge_id_a, greatest(a, b) AS edge_id_b FROM pairs",
    "p4_counts": f"{_OVERLAPS}, g AS (SELECT split, source, b, max(exact::INT) AS x, count(*) AS n FROM pairs GROUP BY 1, 2, 3)"
    " SELECT split, source, count(*) AS n_edges, sum(x)::BIGINT AS n_exact, sum(n)::BIGINT AS n_pairs FROM g GROUP BY split, source",
    "p5_found": f"{_TERMS}, m AS (SELECT field, term, CASE WHEN records < 3 THEN 'rare' WHEN records > 0.05 * (SELECT count(*) FROM edge_list) THEN 'common' END AS mark FROM counts)"
    " SELECT field, term, mark FROM m WHERE mark IS NOT NULL",
    "p5_counts": f"{_TERMS} SELECT field, term, occurrences, records FROM counts",
}

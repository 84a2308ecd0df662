"""Queries over the edge list and the raw edge lines: failing rows, orphan references and skewed labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.labels import normal_form_sql
from loomgraph.operators import orphans, skew
from loomgraph.session import table
from loomgraph.sources import rejects


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return rejects.rejected(rejects.read_lines(table(spark, d, "edge_raw"), table(spark, d, "edge_files"))).select("line_id")


def p1_edges(spark: SparkSession, d: str) -> DataFrame:
    return rejects.valid_edges(rejects.read_lines(table(spark, d, "edge_raw"), table(spark, d, "edge_files")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = orphans.edge_list_orphans(table(spark, d, "edge_list"), table(spark, d, "node_mapping"), table(spark, d, "relation_mapping"))
    return found.select(F.col("ref_id").alias("edge_id"), "field")


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    found = orphans.edge_list_orphans(table(spark, d, "edge_list"), table(spark, d, "node_mapping"), table(spark, d, "relation_mapping"))
    return found.groupBy("parent", F.date_format("at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n_orphans"))


def p3_pending(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "edge_list")
    events = orphans.all_parent_events(table(spark, d, "node_mapping"), table(spark, d, "relation_mapping"))
    return orphans.pending_snapshots(orphans.references(edges), events, orphans.periods(edges, "loaded_at"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "edge_list")
    return skew.dominant_labels(skew.label_stats(edges), edges.count())


def p6_labels(spark: SparkSession, d: str) -> DataFrame:
    return skew.label_stats(table(spark, d, "edge_list"))


QUERIES = {f.__name__: f for f in (p1_found, p1_edges, p3_found, p3_counts, p3_pending, p6_found, p6_labels)}

_S, _T, _D = (normal_form_sql(c) for c in ("src_column", "edge_type_column", "dst_column"))

_LINES = f"""
WITH l AS (
  SELECT r.line_id, r.file_id, r.line_no, f.delim, f.n_columns, f.src_column AS ps, f.edge_type_column AS pt, f.dst_column AS pd, f.edge_weight_column AS pw,
    CASE WHEN right(raw_line, 1) = chr(13) THEN left(raw_line, length(raw_line) - 1) ELSE raw_line END AS x
  FROM edge_raw r JOIN edge_files f ON r.file_id = f.file_id WHERE r.line_no >= f.header_length
), p AS (
  SELECT *, regexp_full_match(x, '(?s)(?:"(?:[^"]|"")*"|[^"' || delim || ']*)(?:[' || delim || '](?:"(?:[^"]|"")*"|[^"' || delim || ']*))*') AS quotes_hold,
    regexp_extract_all(x || delim, '(?s)("(?:[^"]|"")*"|[^"' || delim || ']*)[' || delim || ']', 1) AS raw FROM l
), v AS (
  SELECT *, list_transform(raw, lambda y: CASE WHEN y[1] = '"' THEN replace(substr(y, 2, length(y) - 2), '""', '"') ELSE y END) AS val FROM p
), n AS (
  SELECT *, {normal_form_sql("val[ps + 1]")} AS src, {normal_form_sql("val[pt + 1]")} AS edge_type, {normal_form_sql("val[pd + 1]")} AS dst, trim(val[pw + 1], ' ' || chr(9)) AS w FROM v
), c AS (
  SELECT *, x IS NOT NULL AND quotes_hold AND len(raw) = n_columns
    AND coalesce(regexp_full_match(src, '[a-z]+_[a-z]+_[0-9a-z]+'), false) AND coalesce(regexp_full_match(dst, '[a-z]+_[a-z]+_[0-9a-z]+'), false)
    AND (pt IS NULL OR coalesce(regexp_full_match(edge_type, '[a-z]+(_[a-z]+)*'), false))
    AND (pw IS NULL OR w = '' OR (regexp_full_match(w, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') AND NOT isinf(coalesce(try_cast(w AS DOUBLE), 'inf'::DOUBLE)))) AS ok
  FROM n
)"""

_EVENTS = f"""
WITH refs AS (
  SELECT 'node_mapping' AS parent, 'src_column' AS field, {_S} AS label, edge_id, loaded_at FROM edge_list
  UNION ALL SELECT 'relation_mapping', 'edge_type_column', {_T}, edge_id, loaded_at FROM edge_list
  UNION ALL SELECT 'node_mapping', 'dst_column', {_D}, edge_id, loaded_at FROM edge_list
), held AS (
  SELECT DISTINCT 'node_mapping' AS parent, {normal_form_sql("node_label")} AS label, mapped_at, removed_at FROM node_mapping
  UNION SELECT DISTINCT 'relation_mapping', {normal_form_sql("relation_label")}, mapped_at, removed_at FROM relation_mapping
), orphan AS (
  SELECT * FROM refs r WHERE label IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM held h WHERE h.parent = r.parent AND h.label = r.label AND h.mapped_at <= r.loaded_at AND (h.removed_at IS NULL OR h.removed_at > r.loaded_at))
)"""

_LABELS = f"""
WITH n AS (SELECT {_S} AS s, {_D} AS d, edge_weight_column AS w FROM edge_list),
ends AS (SELECT 'src_column' AS field, s AS term, d AS nbr, w FROM n UNION ALL SELECT 'dst_column', d, s, w FROM n),
stats AS (
  SELECT field, term, count(*) AS n_edges, count(DISTINCT nbr) AS n_neighbours, round(sum(w), 4) AS sum_weight FROM ends WHERE term IS NOT NULL GROUP BY field, term
)"""

SQL = {
    "p1_found": f"{_LINES} SELECT line_id FROM c WHERE NOT ok OR ok IS NULL",
    "p1_edges": f"{_LINES} SELECT line_id, file_id, line_no, src, edge_type, dst, CASE WHEN w <> '' THEN w::DOUBLE END AS weight FROM c WHERE ok",
    "p3_found": f"{_EVENTS} SELECT edge_id, field FROM orphan",
    "p3_counts": f"{_EVENTS} SELECT parent, strftime(loaded_at, '%Y-%m') AS month, count(*) AS n_orphans FROM orphan GROUP BY 1, 2",
    "p3_pending": f"{_EVENTS}, valid AS (SELECT * FROM held WHERE label IS NOT NULL AND mapped_at IS NOT NULL AND (removed_at IS NULL OR removed_at > mapped_at)), known AS (SELECT * FROM refs WHERE label IS NOT NULL AND loaded_at IS NOT NULL),"
    " steps AS (SELECT parent, mapped_at AS moment FROM valid UNION SELECT parent, removed_at FROM valid WHERE removed_at IS NOT NULL UNION SELECT parent, loaded_at FROM known),"
    " months AS (SELECT DISTINCT parent, date_trunc('month', moment) + INTERVAL 1 MONTH AS ends FROM steps), counted AS (SELECT parent, label, date_trunc('month', loaded_at) + INTERVAL 1 MONTH AS ends, count(*) AS n FROM known GROUP BY 1, 2, 3),"
    " seen AS (SELECT m.parent, m.ends, c.label, sum(c.n) AS n FROM months m JOIN counted c ON c.parent = m.parent AND c.ends <= m.ends GROUP BY 1, 2, 3),"
    " open_ AS (SELECT * FROM seen s WHERE NOT EXISTS (SELECT 1 FROM valid v WHERE v.parent = s.parent AND v.label = s.label AND v.mapped_at < s.ends AND (v.removed_at IS NULL OR v.removed_at >= s.ends)))"
    " SELECT m.parent, strftime(m.ends - INTERVAL 1 MONTH, '%Y-%m') AS month, coalesce(sum(o.n), 0)::BIGINT AS n_pending FROM months m LEFT JOIN open_ o ON o.parent = m.parent AND o.ends = m.ends GROUP BY 1, 2",
    "p6_found": f"{_LABELS} SELECT field, term FROM stats WHERE n_edges >= 0.02 * (SELECT count(*) FROM edge_list)",
    "p6_labels": f"{_LABELS} SELECT * FROM stats",
}

"""Tables of thermal events derived from the star-schema tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")

DERIVED: dict[str, str] = {
    "detections": """
SELECT event_id,
  CASE WHEN event_id % 401 = 0 THEN CAST(-999 AS DOUBLE)
       ELSE CAST(8.1 AS DOUBLE) + CAST((user_id * 37) % 540 AS DOUBLE) / CAST(100 AS DOUBLE) + CAST(event_id % 3 AS DOUBLE) / CAST(250 AS DOUBLE) END AS latitude,
  CAST(76.25 AS DOUBLE) + CAST((user_id * 53) % 410 AS DOUBLE) / CAST(100 AS DOUBLE) + CAST(event_id % 5 AS DOUBLE) / CAST(500 AS DOUBLE) AS longitude,
  CASE WHEN event_id % 211 = 0 THEN NULL ELSE CAST(295 AS DOUBLE) + CAST((event_id * 31) % 7200 AS DOUBLE) / CAST(100 AS DOUBLE) END AS brightness,
  CAST(266 AS DOUBLE) + CAST((event_id * 17) % 4100 AS DOUBLE) / CAST(100 AS DOUBLE) AS bright_t31,
  value / CAST(10 AS DOUBLE) AS frp,
  CAST(32 + event_id % 48 AS DOUBLE) / CAST(100 AS DOUBLE) AS scan,
  CAST(36 + event_id % 43 AS DOUBLE) / CAST(100 AS DOUBLE) AS track,
  CASE event_type WHEN 'purchase' THEN 'h' WHEN 'click' THEN 'n' WHEN 'view' THEN 'n' WHEN 'error' THEN 'l' ELSE CAST(event_id % 101 AS VARCHAR(8)) END AS confidence,
  CASE CAST(event_id % 3 AS INTEGER) WHEN 0 THEN 'VIIRS_N20' WHEN 1 THEN 'VIIRS_SUOMI_NPP' ELSE 'VIIRS_NOAA21' END AS satellite_source,
  CAST(ts AS DATE) AS acq_date,
  CAST(EXTRACT(HOUR FROM ts) * 100 + EXTRACT(MINUTE FROM ts) AS INTEGER) AS acq_time,
  CASE WHEN EXTRACT(HOUR FROM ts) BETWEEN 6 AND 18 THEN 'D' ELSE 'N' END AS daynight
FROM events""",
    "season_dates": """
SELECT event_id, CAST(ts AS DATE) + CAST((event_id % 12) * 61 AS INTEGER) AS acq_date FROM events""",
    "boundary_edges": """
WITH p(i, x, y) AS (VALUES (0, 76.30, 10.60), (1, 77.30, 8.10), (2, 78.20, 8.60), (3, 79.90, 10.30), (4, 80.30, 13.30), (5, 78.60, 12.60), (6, 76.90, 11.70))
SELECT a.i AS edge_id, CAST(a.x AS DOUBLE) AS x1, CAST(a.y AS DOUBLE) AS y1, CAST(b.x AS DOUBLE) AS x2, CAST(b.y AS DOUBLE) AS y2
FROM p a JOIN p b ON b.i = (a.i + 1) % 7""",
    "facilities": """
SELECT s_suppkey AS osm_id, CASE CAST(s_suppkey % 3 AS INTEGER) WHEN 0 THEN 'node' WHEN 1 THEN 'way' ELSE 'relation' END AS osm_type,
  CAST(8.1 AS DOUBLE) + CAST((s_suppkey * 97) % 540 AS DOUBLE) / CAST(100 AS DOUBLE) AS latitude,
  CAST(76.25 AS DOUBLE) + CAST((s_suppkey * 61) % 410 AS DOUBLE) / CAST(100 AS DOUBLE) AS longitude,
  s_name AS name,
  CASE CAST(s_suppkey % 4 AS INTEGER) WHEN 0 THEN 'HIGHER_RELEVANCE' WHEN 1 THEN 'HIGHER_RELEVANCE' WHEN 2 THEN 'GENERAL_CONTEXT' ELSE 'CAUTION_LOWER_RELEVANCE' END AS relevance_tier
FROM supplier""",
    "facility_tags": """
SELECT p_partkey AS osm_id, 'way' AS osm_type,
  CASE CAST(p_partkey % 5 AS INTEGER) WHEN 0 THEN 'plant' WHEN 1 THEN 'substation' WHEN 2 THEN 'generator' ELSE '' END AS power,
  CASE CAST(p_partkey % 17 AS INTEGER) WHEN 0 THEN 'refinery' WHEN 1 THEN 'steel' WHEN 2 THEN 'cement' WHEN 3 THEN 'mine' WHEN 4 THEN 'chemical' WHEN 5 THEN 'factory' WHEN 6 THEN 'warehouse' WHEN 7 THEN 'area' ELSE '' END AS industrial,
  CASE CAST(p_partkey % 11 AS INTEGER) WHEN 0 THEN 'works' WHEN 1 THEN 'petroleum_refinery' ELSE '' END AS man_made,
  CASE CAST(p_partkey % 7 AS INTEGER) WHEN 0 THEN 'industrial' WHEN 1 THEN 'quarry' ELSE '' END AS landuse,
  CASE CAST(p_partkey % 13 AS INTEGER) WHEN 0 THEN 'industrial' ELSE '' END AS building,
  p_name AS name
FROM part""",
    "tiles": """
SELECT n_nationkey AS tile_no,
  CAST(8.1 AS DOUBLE) + CAST(1.09 AS DOUBLE) * CAST(FLOOR(CAST(n_nationkey AS DOUBLE) / CAST(5 AS DOUBLE)) AS DOUBLE) AS south,
  CAST(8.1 AS DOUBLE) + CAST(1.09 AS DOUBLE) * (CAST(FLOOR(CAST(n_nationkey AS DOUBLE) / CAST(5 AS DOUBLE)) AS DOUBLE) + CAST(1 AS DOUBLE)) AS north,
  CAST(76.25 AS DOUBLE) + CAST(0.825 AS DOUBLE) * CAST(n_nationkey % 5 AS DOUBLE) AS west,
  CAST(76.25 AS DOUBLE) + CAST(0.825 AS DOUBLE) * (CAST(n_nationkey % 5 AS DOUBLE) + CAST(1 AS DOUBLE)) AS east,
  n_nationkey % 7 <> 3 AS success
FROM nation""",
    "landcover_cells": """
SELECT CAST(32 + FLOOR(CAST(p_partkey % 374 AS DOUBLE) / CAST(17 AS DOUBLE)) AS BIGINT) AS cell_y,
  CAST(305 + (p_partkey % 374) % 17 AS BIGINT) AS cell_x,
  MIN(CASE CAST((p_partkey % 374) % 6 AS INTEGER) WHEN 0 THEN 10 WHEN 1 THEN 20 WHEN 2 THEN 30 WHEN 3 THEN 40 WHEN 4 THEN 50 ELSE 60 END) AS landcover_code
FROM part GROUP BY 1, 2""",
    "catalogue": """
SELECT o_orderkey AS product_id, CAST(o_orderkey % 25 AS INTEGER) AS tile_no,
  DATE '2023-12-15' + CAST((o_orderkey * 11) % 61 AS INTEGER) AS image_date,
  CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE CAST((o_orderkey * 7) % 1000 AS DOUBLE) / CAST(10 AS DOUBLE) END AS cloud_cover
FROM orders""",
    "pixels": """
SELECT l_orderkey % 200 AS event_id, CASE WHEN l_linenumber % 2 = 0 THEN 'pre' ELSE 'post' END AS timing,
  l_orderkey AS px_a, l_linenumber AS px_b,
  CAST(CASE WHEN l_orderkey % 10 = 0 AND l_partkey % 10 < 6 THEN 9 WHEN l_orderkey % 10 = 1 AND l_partkey % 10 < 6 THEN 3 WHEN l_orderkey % 10 = 2 AND l_partkey % 10 < 6 THEN 0
    WHEN l_partkey % 10 < 8 THEN 4 + l_partkey % 3 ELSE l_suppkey % 12 END AS INTEGER) AS scl,
  CAST(400 + (l_partkey * 13) % 1200 AS DOUBLE) AS b04,
  CAST(900 + (l_suppkey * 29 + l_partkey) % 2800 AS DOUBLE) AS b08,
  CASE WHEN l_orderkey % 331 = 0 THEN NULL ELSE CAST(700 + (l_partkey * 7 + l_suppkey) % 1500 AS DOUBLE) END AS b11,
  CAST((l_partkey * 3 + l_suppkey * 5) % 1700 AS DOUBLE) AS b12
FROM lineitem""",
    "reviewer_labels": """
SELECT c_custkey AS event_id,
  CASE CAST(c_custkey % 12 AS INTEGER) WHEN 0 THEN 'Industrial / Facility Fire' WHEN 1 THEN 'Presistent Industrial Themal Souce' WHEN 2 THEN ' Agricultural Burning' WHEN 3 THEN 'argricultural burning'
    WHEN 4 THEN 'NAtural/Forest Fire' WHEN 5 THEN 'Other/Unclassified' WHEN 6 THEN 'possible argricultural buring' WHEN 7 THEN 'possible forest fire' WHEN 8 THEN 'Industrial / Facility Thermal Anomaly'
    WHEN 9 THEN 'Industrial Facility' WHEN 10 THEN 'Biomass / Scrub Burning' ELSE 'unknown text' END AS raw_label
FROM customer""",
    "footprint_edges": """
WITH k(ring, i, dx, dy) AS (VALUES (0, 0, -0.913, -0.217), (0, 1, 0.317, -0.811), (0, 2, 0.877, 0.233), (0, 3, -0.291, 0.787), (1, 0, -0.213, -0.197), (1, 1, 0.223, -0.181), (1, 2, 0.011, 0.203)),
e AS (SELECT a.ring, a.dx AS dx1, a.dy AS dy1, b.dx AS dx2, b.dy AS dy2 FROM k a JOIN k b ON a.ring = b.ring AND b.i = (a.i + 1) % CASE a.ring WHEN 0 THEN 4 ELSE 3 END),
c AS (SELECT n_nationkey AS product_id, CAST(8.31 AS DOUBLE) + CAST((n_nationkey * 7) % 25 AS DOUBLE) * CAST(0.2137 AS DOUBLE) AS y, CAST(76.41 AS DOUBLE) + CAST((n_nationkey * 11) % 25 AS DOUBLE) * CAST(0.1611 AS DOUBLE) AS x,
  CAST(1 + n_nationkey % 3 AS DOUBLE) * CAST(0.61 AS DOUBLE) AS s FROM nation)
SELECT product_id, ring, x + s * CAST(dx1 AS DOUBLE) AS x1, y + s * CAST(dy1 AS DOUBLE) AS y1, x + s * CAST(dx2 AS DOUBLE) AS x2, y + s * CAST(dy2 AS DOUBLE) AS y2 FROM c CROSS JOIN e WHERE ring = 0 OR product_id % 2 = 0""",
    "predictions": """
WITH w AS (SELECT event_id, CAST(1 + (event_id * 7) % 50 AS DOUBLE) AS a, CAST(1 + (event_id * 11) % 60 AS DOUBLE) AS b, CAST(1 + (event_id * 13) % 40 AS DOUBLE) AS c FROM events)
SELECT event_id, a / (a + b + c) AS p_agricultural, b / (a + b + c) AS p_industrial, c / (a + b + c) AS p_natural,
  CASE WHEN a >= b AND a >= c THEN 'Agricultural Burning' WHEN b >= c THEN 'Industrial Thermal Activity' ELSE 'Natural / Wildfire / Other' END AS predicted_class
FROM w""",
}



def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by name: derived, or as it is in the folder."""
    if name not in DERIVED:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    used = [b for b in BASE if re.search(rf"\b(FROM|JOIN) {b}\b", DERIVED[name])]
    text = DERIVED[name]
    for b in used:
        text = re.sub(rf"\b(FROM|JOIN) {b}\b", rf"\1 {{{b}}}", text)
    return spark.sql(text, **{b: spark.read.parquet(f"{sf_dir}/{b}.parquet") for b in used})


def with_tables(names: str, body: str) -> str:
    """``body`` with the named derived tables before it."""
    return "WITH " + ",\n".join(f"{n} AS ({DERIVED[n]})" for n in names.split()) + "\n" + body

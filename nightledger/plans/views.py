"""The driver's tables seen as observing-session tables.

Every view is a table with expressions that Spark SQL and DuckDB read alike, so that a query and its oracle start
from the same rows. Times keep no zone.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, tuple[str, dict[str, str], str]] = {
    "exposures": ("events", {
        "event_id": "event_id", "timestamp": "ts", "session_date": "CAST(ts - INTERVAL 12 HOUR AS DATE)", "target_name": "'NGC ' || CAST(user_id AS STRING)", "filter_name": "event_type",
        "exposure_seconds": "CAST(30 * (event_id % 10 + 1) AS DOUBLE)", "hfr": "1 + value / 100", "fwhm": "CASE WHEN event_id % 11 = 0 THEN NULL ELSE 2 + value / 80 END",
        "telescope": "'T' || CAST(user_id % 5 AS STRING)", "camera": "'C' || CAST(user_id % 3 AS STRING)", "detected_stars": "CAST(floor(value * 3) AS INT)", "file_path": "CASE WHEN event_id % 17 = 0 THEN NULL ELSE 'f' || CAST(event_id AS STRING) END",
    }, ""),
    "weather": ("events", {
        "weather_id": "event_id", "timestamp": "ts + INTERVAL 7 SECOND", "telescope": "'T' || CAST(user_id % 5 AS STRING)", "temperature": "CASE WHEN event_id % 13 = 0 THEN NULL ELSE value / 4 - 5 END", "humidity": "value",
        "cloud_cover": "CAST(event_id % 101 AS INT)", "precipitation": "CASE WHEN event_id % 7 = 0 THEN value / 50 ELSE 0.0 END", "wind_speed": "CAST(event_id % 37 AS DOUBLE)", "dewpoint": "value / 6 - 8",
    }, "event_id % 3 = 0"),
    "mount_samples": ("events", {
        "session_id": "user_id", "sample_id": "event_id", "timestamp": "ts", "ra_hours": "(user_id % 23) + 0.3 * floor(extract(day FROM ts) / 5) + value / 100000", "dec_degrees": "-30 + (user_id % 60) + value / 10000",
        "ra_stdev": "value / 50", "dec_stdev": "CASE WHEN event_id % 9 = 0 THEN NULL ELSE value / 70 END", "status": "CASE event_type WHEN 'error' THEN 'SLEWING' ELSE 'TRACKING' END", "axis": "event_type",
    }, ""),
    "targets": ("part", {
        "id": "p_partkey", "name": "p_name || ' ' || CAST(p_partkey AS STRING)", "canonical_name": "p_name", "ra_deg": "(p_partkey * 137.508) % 360", "dec_deg": "((p_partkey * 61.8) % 180) - 90",
        "object_type": "CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE p_type END", "priority": "p_size",
    }, ""),
    "observations": ("lineitem", {
        "target_id": "l_partkey", "observation_date": "CAST(l_shipdate AS DATE)", "filter": "CASE WHEN l_orderkey % 23 = 0 THEN NULL ELSE l_returnflag || l_linestatus END", "exposure_time": "60 * l_quantity", "frame_count": "CAST(l_quantity AS INT)",
        "telescope": "CASE WHEN l_orderkey % 29 = 0 THEN '' ELSE 'T' || CAST(l_suppkey % 7 AS STRING) END", "camera": "'C' || CAST(l_linenumber % 3 AS STRING)", "hfr": "40 * l_discount", "fwhm": "50 * l_tax", "seq": "l_orderkey * 10 + l_linenumber",
    }, ""),
    "frames": ("orders", {
        "path": "o_orderkey", "image_type": "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'LIGHT' WHEN '2' THEN 'DARK' WHEN '3' THEN 'FLAT' WHEN '4' THEN 'BIAS' ELSE 'DARKFLAT' END", "exposure": "CAST(30 * (o_custkey % 10 + 1) AS DOUBLE)",
        "temperature": "CAST(-20 + (o_orderkey % 21) AS DOUBLE)", "camera": "'C' || CAST(o_custkey % 3 AS STRING)", "telescope": "'T' || CAST(o_custkey % 4 AS STRING)", "gain": "CAST(100 * (o_custkey % 2) AS INT)", "filter": "o_orderstatus", "date_obs": "o_orderdate", "target": "'M ' || CAST(o_custkey % 40 AS STRING)",
        "binning": "CAST(1 + o_custkey % 2 AS INT)", "bias_offset": "CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE CAST(10 * (o_custkey % 3) AS INT) END", "focal_length": "CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE CAST(400 + 100 * (o_custkey % 4) AS INT) END", "rotation": "CAST(90 * (o_custkey % 2) AS INT)",
    }, ""),
    "stars": ("lineitem", {
        "frame": "l_orderkey", "star": "l_linenumber", "x": "CAST((l_partkey * 37) % 3000 AS DOUBLE)", "y": "CAST((l_suppkey * 53) % 2000 AS DOUBLE)", "flux": "l_extendedprice", "fwhm": "1 + 40 * l_discount", "eccentricity": "10 * l_tax", "theta": "CAST(25 * l_linenumber AS DOUBLE)", "snr": "l_quantity", "hfr": "1 + 20 * l_discount",
    }, ""),
    "files": ("documents", {"path": "source || '/LIGHT/' || lang || '/' || CAST(doc_id AS STRING) || CASE doc_id % 4 WHEN 0 THEN '.fits' WHEN 1 THEN '.xisf' WHEN 2 THEN '.fits.fz' ELSE '.txt' END", "file_id": "doc_id", "length": "n_chars", "content": "text", "source": "source"}, ""),
    "tags": ("nation", {"tag_id": "n_nationkey", "tag": "n_name", "color": "n_regionkey"}, ""),
    "target_tags": ("part", {"target_id": "p_partkey", "tag_id": "CAST(p_size % 25 AS INT)"}, ""),
    "pixels": ("(SELECT vec_id, unnest(range(0, 64)) AS pos, unnest(embedding) AS value FROM embeddings)", {"image_id": "vec_id", "x": "CAST(pos % 8 AS INT)", "y": "CAST(floor(pos / 8) AS INT)", "value": "CAST(value AS DOUBLE)"}, ""),
    "subframes": ("lineitem", {
        "session_id": "l_suppkey", "file": "'/out/L_' || CAST(l_orderkey AS STRING) || '_' || CAST(l_linenumber AS STRING) || '.xisf'", "filter_name": "CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_returnflag END", "target": "'M ' || CAST(l_partkey % 30 AS STRING)", "camera": "'C' || CAST(l_linenumber % 3 AS STRING)",
        "fwhm": "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE 1 + 40 * l_discount END", "eccentricity": "10 * l_tax", "snr": "l_quantity", "num_stars": "CAST(l_quantity * 3 AS INT)", "median_adu": "l_extendedprice / 10",
    }, ""),
    "weights": ("lineitem", {"integration_id": "l_orderkey", "session_id": "l_suppkey", "filename": "CASE WHEN l_linenumber % 2 = 0 THEN '/in/' ELSE '' END || 'L_' || CAST(l_orderkey AS STRING) || '_' || CAST(l_linenumber AS STRING) || '.xisf'", "normalized_weight": "CASE WHEN l_linenumber = 5 THEN NULL ELSE l_discount * 10 END", "accepted": "l_tax < 0.06"}, ""),
    "integrations": ("orders", {"integration_id": "o_orderkey", "session_id": "o_custkey % 100", "filter_name": "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderstatus END", "frames_total": "CAST(10 + o_orderkey % 40 AS INT)", "frames_integrated": "CAST(10 + o_orderkey % 40 - o_orderkey % 5 AS INT)", "total_rejection_pct": "o_totalprice / 100000"}, ""),
    "log_sessions": ("supplier", {"session_id": "s_suppkey % 60", "row_id": "s_suppkey", "log_date": "DATE '2024-01-01' + CAST(s_suppkey % 300 AS INT)", "tool_version": "s_name", "subframes_ok": "CAST(s_suppkey % 90 AS INT)"}, ""),
    "equipment": ("supplier", {"telescope": "'T' || CAST(s_suppkey AS STRING)", "focal_length": "200 + 10 * s_nationkey", "pixel_size": "3.76 + s_nationkey / 10", "brand": "s_nationkey"}, ""),
}


class Views:
    """``Views(spark, sf_dir).exposures`` and so on; ``sql`` puts the same views into a DuckDB query."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name == "spark":
            return self._spark
        if name not in VIEWS:  # one of the driver's tables as it is
            return self._spark.read.parquet(f"{self._dir}/{name}.parquet")
        table, columns, where = VIEWS[name]
        if name == "pixels":  # DuckDB and Spark unnest arrays in different words
            rows = self._spark.read.parquet(f"{self._dir}/embeddings.parquet").selectExpr("vec_id", "posexplode(embedding) AS (pos, value)")
        else:
            rows = self._spark.read.parquet(f"{self._dir}/{table}.parquet")
        rows = rows.where(where) if where else rows
        return rows.selectExpr(*(f"{e} AS `{c}`" for c, e in columns.items()))


def sql(query: str) -> str:
    """``query`` after the definitions of the views that it names as ``{view}``."""
    names = sorted(set(re.findall(r"\{(\w+)\}", query)))
    parts = []
    for name in names:
        table, columns, where = VIEWS[name]
        select = ", ".join(f'{e} AS "{c}"' for c, e in columns.items())
        parts.append(f"{name} AS (SELECT {select} FROM {table}{f' WHERE {where}' if where else ''})")
    body = re.sub(r"\{(\w+)\}", r"\1", query).strip()
    if not names:
        return body
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(head):
            return f"{head}{', '.join(parts)}, {body[len(head) :]}"
    return f"WITH {', '.join(parts)} {body}"

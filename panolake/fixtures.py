"""Deterministic scenes derived from the driver tables, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Each view's columns and source; ``//`` is integer division, spelled ``div`` in Spark SQL.
VIEWS = {
    "fx_labels": "SELECT p_partkey AS label_id, p_partkey // 20 AS image_id, 1 + p_partkey % 2 AS label_class, (p_partkey * 7919) % 7400 AS x, 736 + (p_partkey * 104729) % 2400 AS y, 40 + p_partkey % 60 AS w, 30 + p_partkey % 50 AS h, CASE (p_partkey // 20) % 3 WHEN 0 THEN 'trn' WHEN 1 THEN 'val' ELSE 'tst' END AS dataset FROM part",
    "fx_dets": "SELECT det_id, image_id, CASE WHEN b % 11 = 3 THEN 1 - b % 2 ELSE b % 2 END AS det_class, (b * 7919) % 7400 + 3 * j AS x, 736 + (b * 104729) % 2400 + 2 * j AS y, 40 + b % 60 AS w, 30 + b % 50 AS h, CAST(5 + (det_id * 37) % 95 AS DOUBLE) / 100 AS score, CASE image_id % 3 WHEN 0 THEN 'trn' WHEN 1 THEN 'val' ELSE 'tst' END AS dataset FROM (SELECT event_id AS det_id, event_id // 4 AS b, event_id % 4 AS j, (event_id // 4) // 20 AS image_id FROM events) e WHERE b % 10 <> 7",
    "fx_images": "SELECT o_orderkey AS image_id, concat('pano_', o_orderkey, '.jpg') AS file_name, CASE o_orderkey % 2 WHEN 0 THEN 'NE' ELSE 'SZH' END AS aoi, 8000 AS width, 4000 AS height FROM orders",
    "fx_frames": "SELECT c_custkey AS frame_id, CAST(5 * c_custkey AS DOUBLE) AS x, CAST(0 AS DOUBLE) AS y, CAST(3 AS DOUBLE) AS z, c_custkey AS t FROM customer",
    "fx_objects": "SELECT c_custkey // 5 AS k, CAST(25 * (c_custkey // 5) + 12 AS DOUBLE) AS x, CAST(4 AS DOUBLE) AS y, CAST(0 AS DOUBLE) AS z FROM customer WHERE c_custkey % 5 = 0",
    "fx_rays": "SELECT f.frame_id, o.k AS object_id, f.frame_id AS ray_id, f.x AS ox, f.y AS oy, f.z AS oz, (o.x - f.x) / sqrt((o.x - f.x) * (o.x - f.x) + (o.y - f.y) * (o.y - f.y) + (o.z - f.z) * (o.z - f.z)) AS dx, (o.y - f.y) / sqrt((o.x - f.x) * (o.x - f.x) + (o.y - f.y) * (o.y - f.y) + (o.z - f.z) * (o.z - f.z)) AS dy, (o.z - f.z) / sqrt((o.x - f.x) * (o.x - f.x) + (o.y - f.y) * (o.y - f.y) + (o.z - f.z) * (o.z - f.z)) AS dz FROM fx_frames f JOIN fx_objects o ON f.frame_id // 5 = o.k",
    "fx_drive_frames": "SELECT c_custkey // 250 AS drive, c_custkey % 250 AS frame, c_custkey AS frame_id, CAST(CASE WHEN c_custkey % 250 < 125 THEN 5 * (c_custkey % 250) ELSE 5 * (249 - c_custkey % 250) END AS DOUBLE) AS x, CAST(1000 * (c_custkey // 250) + CASE WHEN c_custkey % 250 < 125 THEN 0 ELSE 6 END AS DOUBLE) AS y, CAST(3 AS DOUBLE) AS z, CASE c_custkey % 2 WHEN 0 THEN 'trn' ELSE 'val' END AS dataset FROM customer",
    "fx_drive_objects": "SELECT c_custkey // 250 AS drive, 2 * c_custkey AS object_id, CAST(5 * (c_custkey % 250) + c_custkey % 3 AS DOUBLE) AS x, CAST(1000 * (c_custkey // 250) + 1 + (c_custkey * 7) % 5 AS DOUBLE) AS y, CAST(0 AS DOUBLE) AS z FROM customer WHERE c_custkey % 250 < 125 AND c_custkey % 4 = 0 UNION ALL SELECT c_custkey // 250 AS drive, 2 * c_custkey + 1 AS object_id, 5 * (c_custkey % 250) + c_custkey % 3 + CAST(0.7 + 0.3 * (c_custkey % 3) AS DOUBLE) AS x, CAST(1000 * (c_custkey // 250) + 1 + (c_custkey * 7) % 5 AS DOUBLE) AS y, CAST(0.1 AS DOUBLE) AS z FROM customer WHERE c_custkey % 250 < 125 AND c_custkey % 8 = 0",
    "fx_drive_rays": "SELECT drive, frame AS frame_id, frame_id * 100000 + object_id % 100000 AS ray_id, dataset, x AS ox, y AS oy, z AS oz, vx / sqrt(vx * vx + vy * vy + vz * vz) AS dx, vy / sqrt(vx * vx + vy * vy + vz * vz) AS dy, vz / sqrt(vx * vx + vy * vy + vz * vz) AS dz FROM (SELECT f.drive, f.frame, f.frame_id, f.dataset, f.x, f.y, f.z, o.object_id, o.x - f.x + CAST(0.012 AS DOUBLE) * ((f.frame_id * 7919 + o.object_id * 31) % 21 - 10) AS vx, o.y - f.y + CAST(0.01 AS DOUBLE) * ((f.frame_id * 104729 + o.object_id * 17) % 23 - 11) AS vy, o.z - f.z AS vz FROM fx_drive_frames f JOIN fx_drive_objects o ON f.drive = o.drive AND sqrt((o.x - f.x) * (o.x - f.x) + (o.y - f.y) * (o.y - f.y)) < 14) n",
    "fx_points": "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings",
    "fx_status": "SELECT user_id AS ann_id, event_id, ts, event_type AS action FROM events",
}
_NEEDS = {"fx_rays": ("fx_frames", "fx_objects"), "fx_drive_rays": ("fx_drive_frames", "fx_drive_objects")}
TABLES = ("part", "events", "orders", "customer", "embeddings")


def _spark_sql(sql: str) -> str:
    return sql.replace("//", "div").replace("embedding[1]", "embedding[0]").replace("embedding[2]", "embedding[1]")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; its plan reaches the Parquet scans."""
    sql = _spark_sql(VIEWS[name])
    parts = {n: view(spark, sf_dir, n) for n in _NEEDS.get(name, ())}
    for table in TABLES:
        if f"FROM {table}" in sql:
            parts[table] = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    for n in parts:
        sql = sql.replace(f"FROM {n}", "FROM {" + n + "}").replace(f"JOIN {n}", "JOIN {" + n + "}")
    return spark.sql(sql, **parts)


def with_views(sql: str) -> str:
    """``sql`` for DuckDB, with the views it names before it."""
    names = [n for n in VIEWS if n in sql]
    names = [*dict.fromkeys([*(d for n in names for d in _NEEDS.get(n, ())), *names])]
    views = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    if not names:
        return sql
    for head in ("WITH RECURSIVE ", "WITH "):
        if sql.startswith(head):
            return f"{head}{views}, {sql[len(head):]}"
    return f"WITH {views} {sql}"

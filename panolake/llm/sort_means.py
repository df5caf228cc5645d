"""Centroid clustering by sort-means: exact Lloyd rounds over integer vectors that skip centroids too far to win.

A vector keeps the centroid of the round before. Each round orders the other centroids by their distance from
each centroid; a vector scans them in the order of its own and stops at the first that lies strictly beyond
twice its current distance, as no later one can be nearer or tie. A round is one pass that writes each
vector's assignment to the shared folder, together with one row of componentwise sums per cluster and task,
so only sums are gathered.

Defined results: vectors that are null, of another length, or hold a null or non-finite component (or one of
2^52 and more, whose integer a long may not hold) take no part; repeated rows all take part; rows with a null
vec_id are clustered and are never a first centroid; of rows with equal vec_id the one with smaller
components comes first; fewer kept vectors than ``k`` give as many centroids; an empty table gives no rows;
distances and inertias beyond a long are null; extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panolake.llm.common import Scratch, scratch, table

#: Components up to this size have squared distances that 64 bits hold; others are worked out with whole numbers of any size.
PLAIN = 1 << 27
_ROWS = "vec_id long, q array<long>, cluster int, distance long, n long, sums array<decimal(38,0)>"
_SCHEMA = pa.schema(
    [("vec_id", pa.int64()), ("q", pa.list_(pa.int64())), ("cluster", pa.int32()), ("distance", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0)))]
)


def whole_vectors(vectors: DataFrame, size: int = 64, scale: int = 1024) -> DataFrame:
    """vec_id, q: floor(scale * component) of the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    sound = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < 2.0**52), F.lit(False)))
    kept = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") == size) & sound)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("q"))


def _squares(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    apart = q - c
    return (apart * apart).sum(axis=-1)


def nearest(q: np.ndarray, before: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (ties: the smaller number) and squared distance of each row of ``q``, whose centroids were ``before``."""
    if max(abs(int(x)) for a in (q, centroids) for x in ((a.min(), a.max()) if a.size else (0,))) > PLAIN:
        q, centroids = q.astype(object), centroids.astype(object)
    between = _squares(centroids[:, None, :], centroids[None, :, :])
    best, least = before.copy(), _squares(q, centroids[before])
    for own in np.unique(before).tolist():
        rows = np.flatnonzero(before == own)
        reach = 4 * least[rows]
        for other in sorted((c for c in range(len(centroids)) if c != own), key=lambda c: between[own, c]):
            within = between[own, other] <= reach
            rows, reach = rows[within], reach[within]
            if not len(rows):
                break
            d = _squares(q[rows], centroids[other])
            wins = (d < least[rows]) | ((d == least[rows]) & (other < best[rows]))
            best[rows[wins]], least[rows[wins]] = other, d[wins]
    return best, least


def _assigned(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Each vector with its nearest centroid, and a row of sums for each cluster of a task."""
    k, size = len(centroids), len(centroids[0])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, sums, n = np.array(centroids, np.int64), np.zeros((k, size), object), np.zeros(k, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            q = batch.column("q").flatten().to_numpy().reshape(-1, size)
            best, least = nearest(q, batch.column("cluster").to_numpy().astype(np.int64), points)
            exact = q if max(abs(int(q.min())), abs(int(q.max()))) <= PLAIN else q.astype(object)
            for c in np.unique(best).tolist():
                sums[c] += exact[best == c].sum(axis=0)
                n[c] += int((best == c).sum())
            far = [int(d) if d < 1 << 63 else None for d in least] if least.dtype == object else least
            columns = [batch.column("vec_id"), batch.column("q"), pa.array(best.astype(np.int32)), pa.array(far, pa.int64()), pa.nulls(len(best), pa.int64()), pa.nulls(len(best), _SCHEMA.field("sums").type)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)
        used = np.flatnonzero(n)
        columns = [None, None, used.astype(np.int32), None, n[used], [[int(x) for x in sums[c]] for c in used]]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(used), f.type) if c is None else pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)

    return rows.mapInArrow(assign, _ROWS)


def _moved(found: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Each centroid as the floor of its vectors' mean; at most ``k`` times the number of components rows are collected."""
    parts = found.where("n is not null").select("cluster", F.col("n").cast("decimal(38,0)").alias("n"), F.posexplode("sums").alias("at", "s"))
    sums = parts.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    out = [row[:] for row in centroids]
    for r in sums:
        out[r["cluster"]][r["at"]] = int(r["s"]) // int(r["n"])
    return out


def first_centroids(whole: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The ``k`` vectors with the smallest SHA-256 of ``salt`` and vec_id."""
    hashed = whole.where("vec_id is not null").select("q", F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256).alias("hash"))
    return [r["q"] for r in hashed.orderBy("hash", "q").limit(k).collect()]


def cluster(whole: DataFrame, k: int = 8, rounds: int = 10, salt: str = "3:") -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of every row of ``whole`` (vec_id, q) and the last centroids."""
    with scratch(whole.sparkSession) as keep:
        rows = keep(whole.withColumn("cluster", F.lit(0)), "means-vectors")
        centroids = first_centroids(rows, k, salt)
        if not centroids:
            return rows.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), []
        for _ in range(rounds):
            found = keep(_assigned(rows, centroids), "means-round")
            centroids = _moved(found, centroids)
            _forget(keep)
            rows = found.where("n is null").select("vec_id", "q", "cluster")
        last = keep.result(_assigned(rows, centroids).where("n is null").select("vec_id", "cluster", "distance"), "means-clusters")
    return last, centroids


def _forget(keep: Scratch) -> None:
    """Drops the tables of earlier rounds, all but the newest."""
    newest = keep.paths.pop()
    keep.drop()
    keep.paths.append(newest)


def inertias(clustered: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Adds cluster_inertia, inertia and centroid_sha256; one row per cluster is sent to all tasks."""
    spark = clustered.sparkSession
    whole = F.col("distance").cast("decimal(38,0)")
    total = F.when(F.count("distance") == F.count(F.lit(1)), F.sum(whole))
    per = [(r["cluster"], r["total"]) for r in clustered.groupBy("cluster").agg(total.alias("total")).collect()]
    every = None if any(t is None for _, t in per) else sum(int(t) for _, t in per)
    held = lambda t: None if t is None or int(t) >= 1 << 63 else int(t)
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
    facts = spark.createDataFrame([(c, held(t), held(every), digest(c)) for c, t in per], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return clustered.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, distance and inertias of every kept vector of ``embeddings``: 8 centroids, 10 rounds."""
    return inertias(*cluster(whole_vectors(table(spark, sf_dir, "embeddings"))))


def _sql(k: int = 8, rounds: int = 10) -> str:
    apart = "list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    steps = [
        "v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings"
        " WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR)) - 1)::INTEGER AS cluster, q FROM v ORDER BY 1 LIMIT {k})",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"a{r} AS MATERIALIZED (SELECT vec_id, q, cluster, distance FROM (SELECT v.vec_id, v.q, c.cluster, {apart} AS distance FROM v CROSS JOIN c{r} c)"
            " QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1)"
        )
        if r < rounds:
            steps.append(
                f"m{r} AS (SELECT cluster, pos, sum(q[pos])::BIGINT AS s, count(*) AS n FROM a{r} CROSS JOIN range(1, 65) t(pos) GROUP BY ALL),"
                f" c{r + 1} AS MATERIALIZED (SELECT o.cluster, coalesce(m.q, o.q) AS q FROM c{r} o LEFT JOIN (SELECT cluster,"
                f" list((s - ((s % n) + n) % n) // n ORDER BY pos) AS q FROM m{r} GROUP BY cluster) m USING (cluster))"
            )
    steps.append(
        f"f AS (SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia FROM a{rounds})"
    )
    return f"WITH {', '.join(steps)} SELECT f.*, sha256(array_to_string(c.q, ',')) AS centroid_sha256 FROM f JOIN c{rounds} c USING (cluster)"


OP13_SQL = _sql()

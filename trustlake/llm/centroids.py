"""Plain Lloyd clustering in exact integers.

Vectors of whole numbers are assigned to the nearest of K centroids, which are broadcast (K x dimensions numbers, whatever the
table's size). A task takes the squared differences to one centroid after another in NumPy, and keeps the lowest number where
distances are equal. Each task adds up the vectors of a cluster; these sums, a row a cluster and task, meet in a groupBy, and a
centroid becomes the exact floor of sum / count. All numbers are integers, so results do not depend on the partitioning.

Defined results: vectors that are null, of another length or hold a null, NaN or infinite component are left out; a component beyond
LIMIT after scaling raises an error, as squared distances would not fit 64 bits; repeated rows are vectors of their own; a null id is hashed as an
empty text; first centroids of equal hash go by their components; with fewer vectors than K there are as many clusters as
vectors; empty clusters keep their centroid; an empty table gives no rows; other columns, whatever their names, take no part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlake.llm.shared import table, written

CLUSTERS = 16
ROUNDS = 3
DIMENSIONS = 64
SCALE = 64
SEED = 1
LIMIT = 1 << 27


def whole(vector: Column, dimensions: int = DIMENSIONS, scale: int = SCALE) -> Column:
    """floor(scale * component) of each component as an array of longs; null for vectors that are left out."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    kept = (F.size(vector) == dimensions) & F.forall(vector, finite)
    return F.when(kept, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors of the smallest hashes of `seed:id`, in the order of the hashes."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = vectors.select("v", key.alias("key")).orderBy("key", "v").limit(clusters).collect()  # K rows
    return np.array([r.v for r in rows], np.int64)


def _nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of each point."""
    distances = np.empty((len(centroids), len(points)), np.int64)
    for k, centroid in enumerate(centroids):
        apart = points - centroid
        distances[k] = np.einsum("ij,ij->i", apart, apart)
    best = distances.argmin(axis=0)  # the lowest number of equal ones
    return best, distances[best, np.arange(len(points))]


def _points(pdf: pd.DataFrame) -> np.ndarray:
    points = np.stack(pdf["v"].to_list()).astype(np.int64)
    if np.abs(points).max() > LIMIT:
        raise ValueError(f"a scaled component is beyond {LIMIT}")
    return points


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)
    clusters, dimensions = centroids.shape

    def partial(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, counts = np.zeros((clusters, dimensions), np.int64), np.zeros(clusters, np.int64)
        for pdf in batches:
            if len(pdf):
                points = _points(pdf)
                best, _ = _nearest(points, shared.value)
                np.add.at(sums, best, points)
                counts += np.bincount(best, minlength=clusters)
        some = np.flatnonzero(counts)
        if len(some):
            yield pd.DataFrame({"cluster": some.astype(np.int32), "n": counts[some], "sums": list(sums[some])})

    parts = vectors.select("v").mapInPandas(partial, "cluster int, n long, sums array<long>")
    # exact beyond 64 bits: a component of all vectors together
    total = [F.sum(F.get("sums", i).cast("decimal(38,0)")).alias(f"s{i}") for i in range(dimensions)]
    out = centroids.copy()
    for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *total).collect():  # at most K rows
        out[row.cluster] = [int(row[f"s{i}"]) // row.n for i in range(dimensions)]
    shared.destroy()
    return out


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of each vector."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def nearest(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                best, distance = _nearest(_points(pdf), shared.value)
                yield pd.DataFrame({"id": pdf["id"], "cluster": best.astype(np.int32), "distance": distance})

    return vectors.select("id", "v").mapInPandas(nearest, "id long, cluster int, distance long")


def lloyd(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, distance), final centroids) of vectors (id, v: array of longs), which are read once for each round."""
    centroids = first_centroids(vectors, clusters, seed)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], "id long, cluster int, distance long"), centroids
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    return assigned(vectors, centroids), centroids


def quantized(rows: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(id, v) of the rows whose vectors are kept, written."""
    return written(rows.select(F.col(id_col).cast("long").alias("id"), whole(F.col(vector_col), dimensions, scale).alias("v")).where("v is not null"), "lloyd-vectors")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = lloyd(quantized(table(spark, sf_dir, "embeddings")))
    found = written(found, "lloyd-assigned")
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # at most K rows
    inertia = sum(r.cluster_inertia for r in sums)
    named = [(r.cluster, r.cluster_inertia, inertia, sha256(",".join(map(str, centroids[r.cluster].tolist())).encode()).hexdigest()) for r in sums]
    clusters = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(clusters), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    ctes = [f"""k AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS}),
r AS (SELECT *, row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS n FROM k),
e AS (SELECT n, unnest(range(0, {DIMENSIONS})) AS i, unnest(v) AS x FROM r),
c0 AS (SELECT n AS c, i, x AS y FROM e WHERE n < {CLUSTERS})"""]
    for t in range(ROUNDS + 1):
        ctes.append(f"""d{t} AS (SELECT n, c, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM e JOIN c{t} USING (i) GROUP BY n, c),
a{t} AS (SELECT n, c, d FROM d{t} QUALIFY row_number() OVER (PARTITION BY n ORDER BY d, c) = 1)""")
        if t < ROUNDS:
            ctes.append(f"""m{t} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS k FROM e JOIN a{t} USING (n) GROUP BY c, i),
c{t + 1} AS (SELECT o.c, o.i, CASE WHEN m.k IS NULL THEN o.y ELSE (s - ((s % k) + k) % k) // k END AS y FROM c{t} o LEFT JOIN m{t} m ON m.c = o.c AND m.i = o.i)""")
    return f"""WITH {",\n".join(ctes)},
h AS (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY i)) AS h FROM c{ROUNDS} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a{ROUNDS} JOIN r USING (n) JOIN h USING (c)"""


ORACLE = _oracle()

"""Centroid clustering with Hamerly's bounds, exact over integers.

A vector keeps an upper bound of its distance to its own centroid and a lower bound of its distance to the second-nearest
one. When centroids move, the upper bound grows by the drift of its own centroid and the lower one shrinks by the
greatest drift of the others. Where the upper bound stays under the lower one, or under half the way from its centroid to
the next, nothing nearer can exist and the vector keeps its cluster unread; every other vector is compared with all
centroids in integers, and both bounds are set anew. Bounds are square roots in doubles and decide only with a margin, so
that rounding and ties never do.

Scale: each round maps over the staged vectors without a shuffle and writes them with their bounds to the shared folder (the
round before is then deleted). Only vectors that changed cluster are read back: their components, summed per cluster
in 64-bit integers of two halves, correct the cluster sums that the driver keeps (``k`` times ``size`` numbers).

Edge cases: vectors that are null, of another length, or with a null or non-finite component are left out; with fewer
vectors than ``k`` there are as many clusters; equal vectors may start as two centroids, of which the smaller number takes
all; an empty cluster keeps its centroid; null ids never start a centroid while others can, but are clustered; repeated
rows count each; components are held to +-CLAMP after scaling, since beyond it a squared distance leaves 64 bits;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, fresh_path, removed, staged_at, table

K, ROUNDS, SIZE, SCALE, SALT = 8, 10, 64, 1024, 3
#: Largest magnitude of an integer component.
CLAMP = 1 << 27
STATE = "vec_id long, v binary, cluster int, was int, upper double, lower double, distance long"
#: Vectors compared with all centroids at a time.
BLOCK = 4096


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the kept vectors as little-endian 32-bit integers floor(scale * x)."""
    x = F.col(vector_col).cast("array<double>")
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).filter(F.size("x") == size)
    kept = kept.filter(~F.exists("x", lambda e: F.coalesce(F.isnan(e) | (F.abs(e) == float("inf")), F.lit(True))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.asarray(batch.column(1).flatten()).reshape(-1, size)
            whole = np.clip(np.floor(rows * scale), -CLAMP, CLAMP).astype("<i4")
            yield pa.record_batch([batch.column(0), _packed(whole)], names=["vec_id", "v"])

    return kept.mapInArrow(run, "vec_id long, v binary")


def _packed(whole: np.ndarray) -> pa.Array:
    n, width = len(whole), whole.shape[1] * 4
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(whole))])


def _unpacked(column: pa.Array, size: int) -> np.ndarray:
    flat = np.frombuffer(b"".join(column.to_pylist()), "<i4")
    return flat.reshape(-1, size).astype(np.int64)


def distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of each vector to each centroid."""
    out = np.empty((len(v), len(centroids)), np.int64)
    for at in range(0, len(v), BLOCK):
        for c, centroid in enumerate(centroids):
            gap = v[at : at + BLOCK] - centroid
            out[at : at + BLOCK, c] = np.einsum("ij,ij->i", gap, gap)
    return out


def settle(v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, upper, lower, scanned) after the centroids moved by drift; scanned tells which vectors were read in full."""
    k = len(centroids)
    known = cluster >= 0
    own = np.where(known, cluster, 0)
    far = np.array([np.delete(drift, c).max() if k > 1 else 0.0 for c in range(k)])
    upper, lower = np.where(known, upper + drift[own], np.inf), np.where(known, lower - far[own], -np.inf)
    apart = np.sqrt(distances(centroids, centroids).astype(float))
    half = np.array([np.delete(apart[c], c).min() / 2 if k > 1 else np.inf for c in range(k)])
    scanned = ~(upper * (1 + 1e-9) + 1e-6 < np.maximum(lower, half[own]))
    if scanned.any():
        # The upper bound is made exact first; where that settles it, the other centroids stay unread.
        at = np.flatnonzero(scanned & known)
        gap = v[at] - centroids[own[at]]
        upper[at] = np.sqrt(np.einsum("ij,ij->i", gap, gap).astype(float))
        scanned[at] = ~(upper[at] * (1 + 1e-9) + 1e-6 < np.maximum(lower[at], half[own[at]]))
        at = np.flatnonzero(scanned)
        d = distances(v[at], centroids)
        best = d.argmin(axis=1)  # of equal ones the first
        cluster = cluster.copy()
        cluster[at] = best
        upper[at] = np.sqrt(d[np.arange(len(at)), best].astype(float))
        d[np.arange(len(at)), best] = np.iinfo(np.int64).max
        lower[at] = np.sqrt(d.min(axis=1).astype(float)) if k > 1 else np.inf
    return cluster, upper, lower, scanned


def _step(centroids: list[list[int]], drift: list[float], last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, moved = np.array(centroids, np.int64), np.array(drift)
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _unpacked(batch.column("v"), at.shape[1])
            before = np.asarray(batch.column("cluster"))
            cluster, upper, lower, _ = settle(v, before, np.asarray(batch.column("upper")), np.asarray(batch.column("lower")), at, moved)
            gap = v - at[cluster]
            distance = np.einsum("ij,ij->i", gap, gap) if last else np.zeros(len(v), np.int64)
            yield pa.record_batch([batch.column("vec_id"), batch.column("v"), pa.array(cluster.astype(np.int32)), pa.array(before.astype(np.int32)), pa.array(upper), pa.array(lower), pa.array(distance)], names=[x.split()[0] for x in STATE.split(", ")])

    return run


def _partial_sums(size: int):
    """Of vectors that changed cluster: what each cluster gains, as (cluster, n, sums), a row for each cluster and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains: dict[int, list] = {}
        for batch in batches:
            v = _unpacked(batch.column("v"), size)
            for name, sign in (("cluster", 1), ("was", -1)):
                of = np.asarray(batch.column(name))
                for c in np.unique(of[of >= 0]).tolist():
                    rows = v[of == c]
                    n, sums = gains.get(c, (0, np.zeros(size, np.int64)))
                    gains[c] = (n + sign * len(rows), sums + sign * rows.sum(axis=0))
        if gains:
            yield pa.record_batch([pa.array(list(gains), pa.int32()), pa.array([n for n, _ in gains.values()], pa.int64()), pa.array([s.tolist() for _, s in gains.values()], pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    return run


def first_centroids(vectors: DataFrame, k: int, salt: int) -> list[list[int]]:
    """The k vectors of the smallest hashes; equal hashes (repeated or null ids) follow by their bytes."""
    hashed = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select("v", hashed.alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return [np.frombuffer(r["v"], "<i4").tolist() for r in rows]


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, salt: int = SALT, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """((vec_id, v, cluster, was, upper, lower, distance), final centroids): state after the last assignment, staged."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    path = fresh_path(spark, "clusters")
    start = whole_vectors(vectors, id_col, vector_col, size, scale)
    start = start.withColumns({"cluster": F.lit(-1), "was": F.lit(-1), "upper": F.lit(0.0), "lower": F.lit(0.0), "distance": F.lit(0).cast("long")})
    state = staged_at(start, f"{path}-start")
    before, centroids = f"{path}-start", first_centroids(state, k, salt)
    if not centroids:
        return state, []
    counts, sums, drift = [0] * len(centroids), [[0] * size for _ in centroids], [0.0] * len(centroids)
    for turn in range(rounds + 1):
        state = staged_at(state.mapInArrow(_step(centroids, drift, turn == rounds), STATE), f"{path}-{turn}")
        removed(spark, before)
        before = f"{path}-{turn}"
        if turn == rounds:
            break
        changed = state.filter("cluster <> was").select("v", "cluster", "was").mapInArrow(_partial_sums(size), "cluster int, n long, sums array<long>")
        totals = changed.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(size)))
        for r in totals.collect():  # a row for each cluster
            counts[r["cluster"]] += r["n"]
            sums[r["cluster"]] = [x + int(r[f"s{i}"]) for i, x in enumerate(sums[r["cluster"]])]
        moved = [[s // n for s in sums[c]] if (n := counts[c]) else old for c, old in enumerate(centroids)]
        drift = [float(np.sqrt(sum((a - b) ** 2 for a, b in zip(*pair)))) * (1 + 1e-12) for pair in zip(moved, centroids)]
        centroids = moved
    return state, centroids


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, centroids = cluster(table(spark, sf_dir, "embeddings"))
    per = state.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # a row for each cluster
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    rows = [(r["cluster"], r["cluster_inertia"], sum(x["cluster_inertia"] for x in per), hashes[r["cluster"]]) for r in per]
    told = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

"""Approximate nearest neighbours: inverted lists with adaptive dimension scans.

Vectors are assigned to the nearest of ``lists`` centroids, fitted on a bounded sample
(``sample_rows``); every vector is indexed. A query reads the nearest lists until they hold
``share`` of all vectors and more than k of them. Within a list, vectors are rotated by a
random orthogonal matrix and scanned in blocks of columns: after d of D dimensions a candidate
is given up if its partial squared distance exceeds (d / D) * (1 + slack / sqrt(d)) ** 2 times
the k-th best one so far: the test of the hypothesis that its full distance is no larger.
Survivors' distances are computed in double precision on the original vectors.

A list is dealt to chunks of about ``chunk_rows`` vectors and queries to blocks of about
``block_rows``, so one list or one vector that a third of the rows have makes no large task;
what a task gives back is k rows a query.

Vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part, nor do rows without an identifier. Rows that share a query's
identifier are its own and are no candidates. Fewer than k candidates are all returned.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlog.llm.common import binary
from matchlog.session import materialize

SHARE = 0.7
SLACK = 2.1


def valid_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, vector array<double>) of the rows that take part."""
    rows = df.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
    most = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return rows.filter(F.size("vector") == (most["size"] if most else 0))


def kmeans(sample: np.ndarray, lists: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Centroids by Lloyd's rounds; an empty list keeps its centre."""
    centers = sample[np.random.default_rng(seed).choice(len(sample), lists, replace=False)].copy()
    for _ in range(rounds):
        own = nearest(sample, centers)[:, 0]
        sums = np.zeros_like(centers)
        np.add.at(sums, own, sample)
        counts = np.bincount(own, minlength=lists)
        centers[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centers


def nearest(vectors: np.ndarray, centers: np.ndarray, all_lists: bool = False) -> np.ndarray:
    """The nearest centre of each vector, or all centres by distance."""
    squared = (centers**2).sum(axis=1) - 2 * vectors @ centers.T
    return np.argsort(squared, axis=1, kind="stable") if all_lists else squared.argmin(axis=1)[:, None]


def rotation(size: int, seed: int = 9) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, summed dimension by dimension."""
    total = np.zeros(np.broadcast_shapes(a.shape, b.shape)[:-1])
    for k in range(a.shape[-1]):
        step = a[..., k] - b[..., k]
        total += step * step
    return np.sqrt(total)


def scan(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, slack: float = SLACK, step: int = 16, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) index pairs that hold each query's k nearest, ties included."""
    size = vectors.shape[1]
    depths = [*range(step, size, step), size]
    best = np.full(len(queries), np.inf)
    pool_q, pool_v, pool_d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for start in range(0, len(vectors), block):
        part = vectors[start : start + block]
        first = depths[0]
        squared = (queries[:, None, :first] ** 2).sum(2) + (part[None, :, :first] ** 2).sum(2) - 2 * queries[:, :first] @ part[:, :first].T

        def limit(depth: int) -> np.ndarray:
            factor = min(1.0, depth / size * (1 + slack / math.sqrt(depth)) ** 2) if depth < size else 1.0
            return best * factor * (1 + 1e-9) + 1e-12

        alive = (squared <= limit(first)[:, None]) & (query_ids[:, None] != ids[None, start : start + block])
        q, v = np.nonzero(alive)
        sums = squared[q, v]
        for a, b in zip(depths[:-1], depths[1:], strict=True):
            sums = sums + ((queries[q, a:b] - part[v, a:b]) ** 2).sum(axis=1)
            keep = sums <= limit(b)[q]
            q, v, sums = q[keep], v[keep], sums[keep]
        if not len(q):
            continue
        pool_q, pool_v, pool_d = np.concatenate([pool_q, q]), np.concatenate([pool_v, v + start]), np.concatenate([pool_d, sums])
        order = np.lexsort((pool_d, pool_q))
        pool_q, pool_v, pool_d = pool_q[order], pool_v[order], pool_d[order]
        begin = np.searchsorted(pool_q, np.arange(len(queries)))
        last = begin + k - 1
        full = (last < np.searchsorted(pool_q, np.arange(len(queries)), "right"))
        best[full] = np.minimum(best[full], pool_d[last[full]])
        keep = pool_d <= (best * (1 + 1e-9) + 1e-12)[pool_q]
        pool_q, pool_v, pool_d = pool_q[keep], pool_v[keep], pool_d[keep]
    return pool_q, pool_v


def _matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, size)


def search(df: DataFrame, is_query, k: int = 10, share: float = SHARE, key: str = "vec_id", vector: str = "embedding", sample_rows: int = 20_000, most_lists: int = 1024, chunk_rows: int = 4096, block_rows: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found, nearest first.

    ``is_query`` is a condition on ``vec_id``.
    """
    spark = df.sparkSession
    rows = materialize(valid_vectors(df, key, vector))
    total = rows.count()
    sample = np.array([r.vector for r in rows.sample(min(1.0, sample_rows / max(total, 1)), seed=3).limit(2 * sample_rows).collect()] or [r.vector for r in rows.limit(1).collect()])
    lists = max(1, min(most_lists, math.isqrt(total), len(sample) // 8))
    size = sample.shape[1] if len(sample) else 1
    centers = kmeans(sample, lists) if len(sample) else np.zeros((1, 1))
    shared = spark.sparkContext.broadcast((centers, rotation(size)))

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                flat = np.ascontiguousarray(batch.column(1).flatten().to_numpy(zero_copy_only=False)).reshape(-1, size)
                own = nearest(flat, shared.value[0])[:, 0]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.int32()), binary([x.tobytes() for x in flat])], ["vec_id", "list", "vector"])

    index = materialize(rows.mapInArrow(assign, "vec_id long, list int, vector binary"))
    counts = np.zeros(lists, np.int64)
    for r in index.groupBy("list").count().collect():  # one row a list
        counts[r["list"]] = r["count"]
    queries = index.filter(is_query).select(F.col("vec_id").alias("query_id"), "vector")
    blocks = max(1, -(-queries.count() // block_rows))
    deals = np.maximum(1, -(-counts // chunk_rows))
    probes = spark.sparkContext.broadcast((counts, deals, max(share * total, k + 1)))

    def probe(batches):
        have, chunks, need = probes.value
        for batch in batches:
            if not batch.num_rows:
                continue
            order = nearest(_matrix(batch.column(1), size), shared.value[0], True)
            # lists until they hold enough, the query's own rows not counted on
            enough = (np.cumsum(have[order], axis=1) < need).sum(axis=1) + 1
            row, column = np.nonzero((np.arange(lists) < enough[:, None]) & (have[order] > 0))
            read = order[row, column]
            times = chunks[read]
            chunk = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            row, read = np.repeat(row, times), np.repeat(read, times)
            for at in range(0, len(row), 4096):
                cut = slice(at, at + 4096)
                taken = batch.take(pa.array(row[cut]))
                yield pa.RecordBatch.from_arrays([taken.column(0), pa.array(read[cut], pa.int32()), pa.array(chunk[cut], pa.int32()), taken.column(1)], ["query_id", "list", "chunk", "vector"])

    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")
    asked = queries.mapInArrow(probe, "query_id long, list int, chunk int, vector binary").select("*", block)
    deal = F.element_at(F.lit([int(x) for x in deals]), F.col("list") + 1)
    stored = index.select("*", F.pmod(F.xxhash64("vec_id", "vector"), deal).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        names, types = ["query_id", "vec_id", "score"], [pa.int64(), pa.int64(), pa.float64()]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in types], names)
        turn = shared.value[1]
        asked_ids, ids = left.column("query_id").to_numpy(), right.column("vec_id").to_numpy()
        vectors, wanted = _matrix(right.column("vector"), size), _matrix(left.column("vector"), size)
        turned, out = vectors @ turn, []
        for at in range(0, len(wanted), 64):
            own, own_ids = wanted[at : at + 64], asked_ids[at : at + 64]
            q, v = scan(own @ turn, own_ids, turned, ids, k)
            score = distances(own[q], vectors[v])
            order = np.lexsort((ids[v], score, q))
            q, v, score = q[order], v[order], score[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            keep = place < k
            out.append((own_ids[q[keep]], ids[v[keep]], score[keep]))
        return pa.table([pa.array(np.concatenate(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    unit = ["list", "chunk", "block"]
    found = asked.groupBy(*unit).cogroup(stored.groupBy(*unit)).applyInArrow(solve, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).alias("rank")
    return found.select("query_id", rank, "vec_id", "score").filter(F.col("rank") <= k)

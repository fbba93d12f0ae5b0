"""Exact top-k inner-product search by columnar branch and bound.

Vectors, scaled to integers, are packed into blocks in vertical layout (one array
per dimension). For a query a block adds up partial scores one group of dimensions
at a time; the mass that is left, the product of the norms over the remaining
dimensions, bounds what a candidate can still gain, and candidates whose bound is
under the k-th best score so far leave the block. Survivors are compacted into a
smaller array before the next group. Scores are exact integers.

The k-th best score starts from a bounded number of the longest vectors, which every query
meets first, and rises from block to block as a task goes on. A pair of a candidate block and a
query block is shuffled only if the longest candidate could reach some query's k-th best.
Blocks meet blocks: the candidate blocks are joined with the query blocks on the
query block's number, so no side has to fit a broadcast. Each cell returns k rows
a query at most and a window keeps the best k over all cells.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Vectors a candidate block and a query block hold, and dimensions in a group.
BLOCK, QUERY_BLOCK, GROUP = 4096, 4096, 8
#: Candidates of a block that are scored in full first, to set the bound; longest vectors of all blocks that every query meets first, and of one block.
SEED, LONGEST, LONG_OF_BLOCK = 256, 1000, 64
#: Shares of a dimension whose longest vectors are found first.
LONG_SHARES = 64
#: Shares into which the candidate blocks are dealt for each query block.
SALTS = 32
EXACT = 2.0**53


def _pack(ids: list, rows: list[np.ndarray]) -> tuple[bytes, bytes, int, int]:
    m = np.ascontiguousarray(np.array(rows, np.int32).T)
    return np.array(ids, np.int64).tobytes(), m.tobytes(), len(ids), m.shape[0]


def blocks(df: DataFrame, scale: int, wanted: Column, size: int, id_col: str, vector_col: str) -> DataFrame:
    """Blocks of equal dimension: block (task and number), dim, n, norm of the longest, ids and the integers dimension by dimension.

    Rows with a null id, a null vector, or a null or non-finite component take no part.
    """
    ok = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    own = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & ok & wanted)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        waiting: dict[int, tuple[list, list]] = {}

        def out(d):
            nonlocal number
            ids, rows = waiting.pop(d)
            a, b, n, dim = _pack(ids, rows)
            longest = max(float(np.sqrt((x * x).sum())) for x in rows) * (1 + 1e-9)
            number += 1
            return pa.RecordBatch.from_pydict({"block": [(task << 24) + number], "dim": [dim], "n": [n], "norm": [longest], "ids": [a], "data": [b]})

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.floor(scale * np.array(v, float))
                if np.abs(x).max() >= 2.0**31:
                    raise ValueError(f"vector {i} has a component beyond the integers this search supports")
                ids, rows = waiting.setdefault(len(v), ([], []))
                ids.append(i)
                rows.append(x)
                if len(ids) >= size:
                    yield out(len(v))
        for d in list(waiting):
            yield out(d)

    return own.mapInArrow(run, "block long, dim long, n long, norm double, ids binary, data binary")


def search_cell(qids: np.ndarray, q: np.ndarray, qat: np.ndarray, ids: np.ndarray, x: np.ndarray, at: np.ndarray, k: int, floor: np.ndarray | None = None) -> list[tuple[int, int, int, int]]:
    """(query's position, candidate id, candidate's position, score) of the k best in this block, ties to the smaller id.

    ``q`` and ``x`` are dims x vectors; ``qat`` and ``at`` tell rows apart, so that a query skips only itself.
    ``floor``: a score that each query's k best are known to reach; candidates under it are left out.
    """
    dims, n = x.shape
    q, x = q.astype(np.int64), x.astype(np.int64)
    kind = np.float64 if np.abs(q).max(initial=0).astype(float) * np.abs(x).max(initial=0) * dims < EXACT else object
    xs, qs = x.astype(kind), q.astype(kind)
    starts = list(range(0, dims, GROUP))
    rest = lambda m: [np.sqrt((m[s:].astype(float) ** 2).sum(axis=0)) * (1 + 1e-9) for s in [*starts[1:], dims]]
    xrest, qrest = rest(x), rest(q)
    # Long candidates first: they set a good bound early.
    order = np.argsort(-np.sqrt((x.astype(float) ** 2).sum(axis=0)), kind="stable")
    xs, ids, at, xrest = xs[:, order], ids[order], at[order], [r[order] for r in xrest]
    out = []
    for j in range(q.shape[1]):
        own = qs[:, j]
        other = at != qat[j]
        seed = np.flatnonzero(other[: SEED + k])
        best = -np.inf if floor is None else floor[j]
        if len(seed) >= k:
            best = max(best, float(np.sort(own @ xs[:, seed])[-k]))
        alive = np.flatnonzero(other)
        partial = np.zeros(len(alive), kind)
        for g, s in enumerate(starts):
            e = min(s + GROUP, dims)
            partial = partial + own[s:e] @ (xs[s:e] if len(alive) == n else xs[s:e, alive])
            bound = partial.astype(float) + qrest[g][j] * xrest[g][alive]
            keep = bound >= best - 1e-6 * (1 + abs(best))
            if not keep.all():
                alive, partial = alive[keep], partial[keep]
        if not len(alive):
            continue
        if len(alive) > k:
            cut = np.sort(partial)[-k]
            top = partial >= cut
            alive, partial = alive[top], partial[top]
        ranked = sorted(zip((-int(v) for v in partial), ids[alive].tolist(), at[alive].tolist(), strict=True))[:k]
        out.extend((j, i, p, -s) for s, i, p in ranked)
    return out


def _places(block: int, own: np.ndarray) -> np.ndarray:
    """Numbers that tell all rows apart: the block's number and the place in it."""
    return (np.int64(block) << 13) + own


def _norms(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m.astype(float) ** 2).sum(axis=0))


def top_k(df: DataFrame, k: int = 5, scale: int = 256, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best inner products of floor(scale * x) for every query row.

    Queries are the rows whose id is divisible by ``every``; a query's candidates are all
    rows but itself, of its own dimension. Ties go to the smaller id. Null ids, null or empty
    vectors and those with null or non-finite components take no part; a component beyond
    31 bits after scaling raises an error. Repeated rows are separate queries and candidates.
    Fewer than k candidates: all. An empty table gives no rows. Other columns are not read.
    """
    everything = materialize(blocks(df, scale, F.lit(True), BLOCK, id_col, vector_col))

    def longest(batches):
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                m = np.frombuffer(r["data"], np.int32).reshape(r["dim"], -1)
                norms = _norms(m)
                top = np.argsort(-norms, kind="stable")[:LONG_OF_BLOCK]
                yield pa.RecordBatch.from_pydict({"dim": [r["dim"]] * len(top), "at": _places(r["block"], top), "norm": norms[top], "data": [np.ascontiguousarray(m[:, i]).tobytes() for i in top]})

    # Within shares first, so no task orders the vectors of all blocks; with LONGEST in Spark's limit of 1,000, tasks also cut before the shuffle.
    share = F.pmod(F.xxhash64("at"), F.lit(LONG_SHARES))
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("norm"), "at"))
    long = everything.select("block", "dim", "data").mapInArrow(longest, "dim long, at long, norm double, data binary")
    for by in (["dim", share], ["dim"]):
        long = long.withColumn("r", first(*by)).where(F.col("r") <= LONGEST)
    long = long.groupBy("dim").agg(F.collect_list("at").alias("_at"), F.collect_list("data").alias("_data")).withColumnRenamed("dim", "_dim")  # LONGEST vectors a dimension

    def chosen(batches):
        """The query vectors of each block with their place, the k-th best score among the longest vectors, and the norm a candidate needs to matter."""
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                ids, m = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["data"], np.int32).reshape(r["dim"], -1)
                own = np.flatnonzero(ids % every == 0)
                if len(own):
                    q, at = np.ascontiguousarray(m[:, own]), np.array(r["_at"], np.int64)
                    x = np.frombuffer(b"".join(r["_data"]), np.int32).reshape(len(at), -1).astype(float)
                    scores = x @ q.astype(float)
                    scores[at[:, None] == _places(r["block"], own)[None, :]] = -np.inf
                    floor = np.sort(scores, axis=0)[-k] if len(at) >= k else np.full(len(own), -np.inf)
                    floor = floor - 1e-6 * (1 + np.abs(floor))
                    norms = _norms(q)
                    need = np.where(floor <= 0, -1.0, floor / np.maximum(norms, 1e-300))
                    yield pa.RecordBatch.from_pydict({"block": [r["block"]], "dim": [r["dim"]], "n": [len(own)], "ids": [ids[own].tobytes()], "at": [own.tobytes()], "floor": [floor.tobytes()], "need": [float(need.min())], "data": [q.tobytes()]})

    met = everything.join(F.broadcast(long), F.col("dim") == F.col("_dim")).drop("_dim")
    queries = materialize(met.mapInArrow(chosen, "block long, dim long, n long, ids binary, at binary, floor binary, need double, data binary"))
    # Query parts are dealt by hash over as many query blocks as their number asks for.
    sizes = queries.groupBy(F.col("dim").alias("_d")).agg(F.ceil(F.sum("n") / QUERY_BLOCK).cast("int").alias("_blocks"))  # one row a dimension
    queries = queries.join(F.broadcast(sizes), F.col("dim") == F.col("_d")).withColumn("number", F.pmod(F.xxhash64("block"), F.col("_blocks")).cast("int"))
    left = queries.groupBy("dim", "number").agg(F.collect_list(F.struct("block", "n", "ids", "at", "floor", "data")).alias("parts"))
    # What a candidate block must reach for each query block; one number a query block.
    needs = queries.groupBy(F.col("dim").alias("_d"), "number").agg(F.min("need").alias("need")).groupBy("_d").agg(F.collect_list(F.struct("number", "need")).alias("needs"))
    right = everything.join(needs, F.col("dim") == F.col("_d"))
    right = right.withColumn("met", F.explode(F.filter("needs", lambda x: x["need"] <= F.col("norm")))).withColumn("number", F.col("met.number"))
    right = right.select("dim", "number", F.col("block").alias("cblock"), F.col("ids").alias("cids"), F.col("data").alias("cdata"))
    # A query block goes to SALTS tasks, each with its share of the candidate blocks; the number of
    # partitions is stated, as cells are small in bytes and costly in time.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["dim", "number", "salt"]
    right = right.withColumn("salt", F.pmod(F.xxhash64("cblock"), F.lit(SALTS)).cast("int")).repartition(parts, *keys)
    left = left.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).repartition(parts, *keys)
    cells = right.join(left, keys)

    def run(batches):
        import pyarrow as pa

        known: dict[tuple, np.ndarray] = {}  # of the query block at hand: the k best scores of each query so far
        for batch in batches:
            for r in batch.to_pylist():
                d = r["dim"]
                ids, x = np.frombuffer(r["cids"], np.int64), np.frombuffer(r["cdata"], np.int32).reshape(d, -1)
                at = _places(r["cblock"], np.arange(len(ids)))
                rows = []
                for p in r["parts"]:
                    qids, q = np.frombuffer(p["ids"], np.int64), np.frombuffer(p["data"], np.int32).reshape(d, -1)
                    qat = _places(p["block"], np.frombuffer(p["at"], np.int64))
                    key = (d, r["number"], p["block"])
                    if key not in known:
                        known = {x: v for x, v in known.items() if x[:2] == key[:2]}
                        known[key] = np.full((len(qids), k), -np.inf)
                    best = known[key]
                    floor = np.maximum(np.frombuffer(p["floor"], np.float64), best[:, 0])
                    for j, i, a, s in search_cell(qids, q, qat, ids, x, at, k, floor):
                        rows.append((int(qids[j]), int(qat[j]), i, a, s))
                        if s > best[j, 0]:
                            best[j, 0] = s
                            best[j].sort()
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "query_at", "vec_id", "at", "score"])

    found = cells.mapInArrow(run, "query_id long, query_at long, vec_id long, at long, score long")
    rank = F.row_number().over(Window.partitionBy("query_at").orderBy(F.desc("score"), "vec_id", "at"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

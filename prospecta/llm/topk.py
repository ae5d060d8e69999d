"""Exact top-k inner products, pruned by norms and by SVD-rotated partial sums.

Vectors are whole numbers, floor(SCALE * x). They are dealt by descending length into blocks. A query first
meets the block of the longest vectors, which gives it a lower bound of its k-th score; it then goes only to the
blocks whose longest vector could still reach that bound (Cauchy-Schwarz). Inside a block vectors go
by descending length in slices: an inner product over the leading rotated components plus the
product of the lengths of the rest bounds the score from above, and only pairs that can enter the result
are scored in full, in whole numbers. The rotation comes from the SVD of a bounded sample; it steers pruning, not results.

Defined results: null vectors and those with a null, NaN or infinite component take no part, nor do null
ids. A shorter vector counts as ending in zeros. Rows with equal id and equal vector count once; other rows with
the query's id are not its candidates. Ties go to the smaller id. No queries or one row give no rows.
Scores beyond a long are cut to its range.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prospecta.llm.cluster import cut

SCALE, QUERY_STEP, TOP = 256, 50, 5
BLOCK_ROWS, QUERY_ROWS, SLICE, MAX_BINS, SAMPLE_ROWS, LEADING = 8192, 4096, 1024, 512, 10_000, 16
_OUT = "q long, query_id long, vec_id long, score long"
_ARROW = pa.schema([("q", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def whole_vectors(rows: DataFrame, id_col="vec_id", vector_col="embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v, norm, q): valid vectors as doubles that hold whole numbers; q identifies the row."""
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("e"))
    fine = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & fine)
    rows = rows.select("vec_id", F.transform("e", lambda x: _floor(x.cast("double") * scale)).alias("v")).distinct()
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).withColumn("q", F.xxhash64("vec_id", "v"))


def _floor(x):
    """floor as a double, for values of any size."""
    return F.when(F.abs(x) < 2.0**62, F.floor(F.when(F.abs(x) < 2.0**62, x)).cast("double")).otherwise(x)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    size = np.asarray(lists.value_lengths(), np.int64)
    out = np.zeros((len(lists), width))
    at = np.arange(width)[None, :] < size[:, None]
    out[at] = np.asarray(lists.flatten())
    return out


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products as int64."""
    if len(a) and np.abs(a).max() * np.abs(b).max() * a.shape[1] >= 2.0**53:
        full = [sum(int(x) * int(y) for x, y in zip(p, r, strict=True)) for p, r in zip(a, b, strict=True)]
        return np.array([max(-(2**63), min(2**63 - 1, x)) for x in full], np.int64)
    return np.einsum("ij,ij->i", a, b).astype(np.int64)


def search_block(q_id, queries, floor, ids, vectors, norms, turn, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of each query's k best of a block that can enter its result; ``floor`` bounds from below."""
    order = np.lexsort((ids, -norms))
    ids, vectors, norms = ids[order], vectors[order], norms[order]
    lead = min(LEADING, turn.shape[1])
    q_turned, v_turned = queries @ turn, vectors @ turn
    q_norm = np.sqrt((queries * queries).sum(axis=1))
    rest = lambda x: np.sqrt(np.maximum((x[:, lead:] ** 2).sum(axis=1), 0))
    q_rest, v_rest = rest(q_turned), rest(v_turned)
    # Whole numbers whose products stay below 2^53 are exact in doubles.
    small = not len(ids) or not len(queries) or np.abs(queries).max() * np.abs(vectors).max() * queries.shape[1] < 2.0**53
    low, low_id = floor.astype(np.float64).copy(), np.full(len(queries), np.iinfo(np.int64).max)
    best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
    for at in range(0, len(ids), SLICE):
        part = slice(at, at + SLICE)
        alive = np.flatnonzero(q_norm * norms[at] * (1 + 1e-9) + 1 >= low)
        if not len(alive):
            break
        bound = q_turned[alive, :lead] @ v_turned[part, :lead].T + q_rest[alive, None] * v_rest[None, part]
        slack = 1 + 1e-9 * q_norm[alive, None] * norms[None, part]
        i, j = np.nonzero(bound + slack >= low[alive, None])
        if small and len(i) > bound.size // 32:
            # Many pairs are left: one product of the two blocks costs less than gathering their rows.
            score = (queries[alive] @ vectors[part].T)[i, j].astype(np.int64)
        else:
            pairs = [(alive[i[s : s + 65536]], j[s : s + 65536] + at) for s in range(0, len(i), 65536)]
            score = np.concatenate([_exact(queries[a], vectors[b]) for a, b in pairs] or [np.empty(0, np.int64)])
        i, j = alive[i], j + at
        other = ids[j] != q_id[i]
        i, j, score = i[other], j[other], score[other]
        keep = (score > low[i]) | ((score == low[i]) & (ids[j] < low_id[i]))
        i = np.concatenate([best[0], i[keep]])
        found, score = np.concatenate([best[1], ids[j[keep]]]), np.concatenate([best[2], score[keep]])
        order = np.lexsort((found, -score, i))
        i, found, score = i[order], found[order], score[order]
        starts = np.searchsorted(i, i)
        top = np.arange(len(i)) - starts < k
        best = (i[top], found[top], score[top])
        last = np.flatnonzero((np.arange(len(i)) - starts == k - 1)[top])
        low[best[0][last]], low_id[best[0][last]] = best[2][last], best[1][last]
    return best


def _search(blocks: DataFrame, queries: DataFrame, turn: np.ndarray, k: int) -> DataFrame:
    """Search (block, part) groups: vectors of the block, queries dealt to it."""
    shared = blocks.sparkSession.sparkContext.broadcast(turn)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        turn = shared.value
        if not left.num_rows or not right.num_rows:
            return _ARROW.empty_table()
        q_id, q = np.asarray(right.column("query_id")), np.asarray(right.column("qq"))
        i, ids, score = search_block(
            q_id, _matrix(right.column("qv"), len(turn)), np.asarray(right.column("floor")), np.asarray(left.column("vec_id")),
            _matrix(left.column("v"), len(turn)), np.asarray(left.column("norm")), turn, k,
        )
        return pa.Table.from_arrays([pa.array(x) for x in (q[i], q_id[i], ids, score)], schema=_ARROW)

    return blocks.groupBy("block", "part").cogroup(queries.groupBy("block", "part")).applyInArrow(run, _OUT)


def top_products(rows: DataFrame, id_col="vec_id", vector_col="embedding", step: int = QUERY_STEP, k: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows whose id is divisible by ``step``, the k best of all other rows.

    The driver gets a sample of SAMPLE_ROWS vectors and one row for each of at most MAX_BINS ranges of length.
    """
    spark = rows.sparkSession
    held = cut(whole_vectors(rows, id_col, vector_col))
    is_query = F.col("vec_id") % step == 0
    n, n_queries, width = held.agg(F.count("*"), F.count(F.when(is_query, 1)), F.max(F.size("v"))).first()
    if n < 2 or not n_queries or not width:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    share = min(1.0, SAMPLE_ROWS / n)
    sample = held.where(F.pmod(F.xxhash64(F.lit("svd"), "q"), F.lit(1 << 32)) < int(share * (1 << 32))).select("v").toArrow()
    rows_of = _matrix(sample.column("v"), width) if sample.num_rows else np.eye(width)
    # The right singular vectors of the sample are those of its Gram matrix, which is only width x width.
    turn = np.linalg.svd(rows_of.T @ rows_of)[0]
    bins = min(MAX_BINS, math.ceil(n / BLOCK_ROWS))
    bounds = held.approxQuantile("norm", [1 - (b + 1) / bins for b in range(bins - 1)], 1e-3) if bins > 1 else []
    longer = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b > F.col("norm"))) if bounds else F.lit(0)
    binned = held.withColumn("bin", longer)
    sizes = binned.groupBy("bin").agg(F.count("*").alias("n"), F.max("norm").alias("longest")).orderBy("bin").collect()
    first, table = 0, []
    for r in sizes:
        pieces = math.ceil(r["n"] / BLOCK_ROWS)
        table.append((r["bin"], first, pieces, r["longest"]))
        first += pieces
    places = F.broadcast(spark.createDataFrame(table, "bin int, first long, pieces long, longest double"))
    parts = math.ceil(n_queries / QUERY_ROWS)
    blocks = binned.join(places, "bin").select("vec_id", "v", "norm", (F.col("first") + F.pmod("q", "pieces")).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    asked = held.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"), F.col("norm").alias("q_norm"), F.col("q").alias("qq"))
    asked = asked.withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "qq"), F.lit(parts)).cast("int"))
    start = asked.withColumn("block", F.lit(0).cast("long")).withColumn("floor", F.lit(float("-inf")))
    opening = cut(_search(blocks.where("block = 0"), start, turn, k))
    floors = opening.groupBy(F.col("q").alias("qq")).agg(F.count("*").alias("n"), F.min("score").cast("double").alias("low")).where(F.col("n") >= k).select("qq", "low")
    later = asked.join(floors, "qq", "left").withColumn("floor", F.coalesce("low", F.lit(float("-inf"))))
    reach = places.select(F.explode(F.sequence("first", F.col("first") + F.col("pieces") - 1)).alias("block"), "longest").where("block > 0")
    dealt = later.join(F.broadcast(reach), F.col("longest") * F.col("q_norm") * (1 + 1e-9) + 1 >= F.col("floor"))
    rest = _search(blocks.where("block > 0"), dealt.select("block", "part", "query_id", "qv", "qq", "floor"), turn, k)
    best = Window.partitionBy("q", "query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = opening.unionByName(rest).withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

"""Exact top-k search by inner product (operator 4): norm-sorted vectors, rotated partial sums, residual bounds.

Components become floor(scale * x).  Vectors are dealt by descending length into blocks, written once.  A rotation from
the singular vectors of all vectors puts most of a product into its first places.  Queries first meet the longest
vectors (a head of fixed size), which gives each a threshold that its k-th best score reaches at least.  Then each
query goes to the blocks whose longest vector times its own length reaches that threshold.  There, partial products over
the first rotated places plus the product of the residual lengths (Cauchy-Schwarz) leave few candidates; their integer
products are exact.  A task holds one block, queries stream by, and each block returns at most k rows a query.

Vectors that are null or hold null or non-finite components take no part.  Shorter vectors count as filled up with
zeros.  Rows that repeat both id and vector are one row; of other rows that share an id the best score counts, once a
query; a query never meets rows with its own id.  Ties go to the
smaller id.  Scores beyond 64 bits saturate.  Null ids take no part.  An empty table gives an empty result.  Extra columns
are ignored, whatever their names.

Cost: a block of fixed size is shuffled once, and a copy of each query to every block that its threshold reaches: with
lengths that differ few, with vectors of one length all of them, as in any exact search; larger blocks make fewer copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

SCALE, K, EVERY = 1024, 10, 100
#: Bytes of a block (its vectors and their rotated ones), however large the table; rows that a block has at least, if the
#: bytes allow, so that small tables still make a block for each core; rows of the head; rows that are compared at once.
BLOCK_BYTES, BLOCK_ROWS, HEAD_ROWS, CHUNK = 32 << 20, 4096, 4096, 2048
#: Queries that meet a block at once.
QUERIES = 256
#: Rotated places after which candidates are pruned, as shares of all places.
STOPS = (1 / 8, 1 / 4, 1 / 2)


def pack(v: np.ndarray) -> bytes:
    """Whole numbers as 32-bit integers, or as doubles where they are larger."""
    return b"i" + v.astype("<i4").tobytes() if np.abs(v).max(initial=0) < 2**31 else b"d" + v.astype("<f8").tobytes()


def unpack(rows: list[bytes], dims: int) -> np.ndarray:
    out = np.zeros((len(rows), dims))
    for i, r in enumerate(rows):
        x = np.frombuffer(r, "<i4" if r[:1] == b"i" else "<f8", offset=1)
        out[i, : len(x)] = x
    return out


def integers(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v, norm, dims) of the vectors that take part."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    rows = rows.where("vec_id is not null and x is not null").where(~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))

    def run(batches):
        for b in batches:
            vec = C.column(b, "x").to_pylist()
            with np.errstate(over="ignore"):
                whole = [np.clip(np.floor(scale * np.array(v, "float64")), -1e300, 1e300) for v in vec]
                norm = [float(np.sqrt(w @ w)) for w in whole]
            yield pa.RecordBatch.from_arrays([C.column(b, "vec_id"), pa.array([pack(w) for w in whole], pa.binary()), pa.array(norm, pa.float64()), pa.array([len(w) for w in whole], pa.int32())], names=["vec_id", "v", "norm", "dims"])

    return rows.mapInArrow(run, "vec_id long, v binary, norm double, dims int")


def rotation(vectors: DataFrame, dims: int, longest: float) -> np.ndarray:
    """Right singular vectors of all vectors, the largest first; from sums of products, one row for each place."""

    def part(batches):
        total = np.zeros((dims, dims))
        for b in batches:
            x = unpack(C.column(b, "v").to_pylist(), dims) / longest
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], names=["i", "row"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                total[i] = total.get(i, 0) + np.frombuffer(r)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([r.tobytes() for r in total.values()], pa.binary())], names=["i", "row"])

    schema = "i int, row binary"
    got = {r.i: np.frombuffer(r.row) for r in vectors.select("v").mapInArrow(part, schema).repartition("i").mapInArrow(add, schema).collect()}  # dims rows
    _, vec = np.linalg.eigh(np.stack([got[i] for i in range(dims)]))
    return np.ascontiguousarray(vec[:, ::-1])


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact products of rows, pair by pair, as 64-bit integers."""
    if q.shape[1] * np.abs(q).max(initial=0) * np.abs(x).max(initial=0) < 2.0**53:
        return np.einsum("nd,nd->n", q, x).astype("int64")
    exact = [sum(int(a) * int(b) for a, b in zip(r, s, strict=True)) for r, s in zip(q, x, strict=True)]
    return np.array([min(max(e, -(2**63)), 2**63 - 1) for e in exact], "int64")


class Block:
    """Vectors by descending length, rotated, with the residual lengths after each stop."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, norms: np.ndarray, turn: np.ndarray):
        order = np.lexsort((ids, -norms))
        self.ids, self.x, self.norms = ids[order], x[order], norms[order]
        self.turned = self.x @ turn
        d = x.shape[1]
        self.stops = sorted({max(1, round(d * s)) for s in STOPS} | {d})
        self.rest = [np.sqrt((self.turned[:, s:] ** 2).sum(1)) for s in self.stops]

    def best(self, ids: np.ndarray, q: np.ndarray, norms: np.ndarray, least: np.ndarray, turn: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each query the up to k best (vec_id, score) that reach ``least``; a vec_id once, with its best score."""
        least = least.astype("float64").copy()
        turned = q @ turn
        rest = [np.sqrt((turned[:, s:] ** 2).sum(1)) for s in self.stops]
        found = [(np.zeros(0, "int64"), np.zeros(0, "int64")) for _ in ids]
        for at in range(0, len(self.ids), CHUNK):
            part = slice(at, at + CHUNK)
            # rounding of the rotated products stays far below this share of the lengths
            slack = 1e-9 * norms * max(self.norms[at], 1) + 1e-6
            live = np.flatnonzero(norms * self.norms[at] + slack >= least)
            if not len(live):
                continue
            i, j = None, None
            partial, before = None, 0
            for stop, mine, theirs in zip(self.stops, rest, self.rest, strict=True):
                if i is None:
                    new = turned[live, before:stop] @ self.turned[part, before:stop].T
                    partial = new if partial is None else partial + new
                    keep = partial + mine[live, None] * theirs[None, part] + slack[live, None] >= least[live, None]
                    if keep.mean() < 0.1 or stop == self.stops[-1]:  # few are left: from here on pair by pair
                        i, j = np.nonzero(keep)
                        partial = partial[i, j]
                else:
                    partial = partial + np.einsum("nd,nd->n", turned[live[i], before:stop], self.turned[at + j, before:stop])
                    keep = partial + mine[live[i]] * theirs[at + j] + slack[live[i]] >= least[live[i]]
                    i, j, partial = i[keep], j[keep], partial[keep]
                before = stop
            who = live[i]
            score = products(q[who], self.x[at + j])
            ok = (score >= least[who]) & (self.ids[at + j] != ids[who])
            who, cand, score = who[ok], self.ids[at + j][ok], score[ok]
            for r in np.unique(who):
                mine = who == r
                c, s = np.concatenate([found[r][0], cand[mine]]), np.concatenate([found[r][1], score[mine]])
                top = np.lexsort((c, -s))
                top = top[np.sort(np.unique(c[top], return_index=True)[1])][:k]  # the best of each vec_id
                found[r] = (c[top], s[top])
                if len(top) == k:
                    least[r] = max(least[r], float(s[top[-1]]))
        return found


def _matrix(rows: list[tuple], dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, vectors and lengths of (vec_id, v, norm), without repeated rows."""
    rows = list({(r[0], r[1]): r for r in rows}.values())
    return np.array([r[0] for r in rows], "int64"), unpack([r[1] for r in rows], dims), np.array([r[2] for r in rows], "float64")


@C.shipped
def search(df: DataFrame, every: int = EVERY, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for queries whose id is divisible by ``every`` against all other rows."""
    spark = df.sparkSession
    vectors = C.materialise(integers(df, id_col, vector_col, scale), "vectors")
    n, dims, longest = vectors.agg(F.count("*"), F.max("dims"), F.max("norm")).first()
    if not n:
        return C.empty(spark, "query_id long, rank int, vec_id long, score long")
    dims, longest = max(dims, 1), max(longest, 1.0)
    turn = rotation(vectors, dims, longest)
    rows = min(max(1, BLOCK_BYTES // (16 * dims)), max(BLOCK_ROWS, n // (2 * spark.sparkContext.defaultParallelism)))
    blocks = vectors.repartitionByRange(-(-n // rows), F.desc("norm"), "vec_id").withColumn("block", F.spark_partition_id())
    blocks = C.materialise(blocks, "blocks")
    tops = sorted((r.block, r.top) for r in blocks.groupBy("block").agg(F.max("norm").alias("top")).collect())  # a row a block
    names, top = np.array([b for b, _ in tops]), np.array([t for _, t in tops])
    # the longest vectors are in the first block
    head = blocks.where(F.col("block") == tops[0][0]).orderBy(F.desc("norm"), "vec_id").limit(HEAD_ROWS).collect()  # HEAD_ROWS rows
    sent = spark.sparkContext.broadcast((turn, [(r.vec_id, r.v, r.norm) for r in head], names, top))

    def thresholds(batches):
        turn, head, names, top = sent.value
        first = Block(*_matrix(head, dims), turn)
        for b in batches:
            for at in range(0, b.num_rows, QUERIES):
                part = b.slice(at, QUERIES)
                ids, norm = C.column(part, "vec_id").to_numpy(), C.column(part, "norm").to_numpy()
                found = first.best(ids, unpack(C.column(part, "v").to_pylist(), dims), norm, np.full(len(ids), -np.inf), turn, k)
                # saturated scores tell nothing about order
                least = np.array([float(s[-1]) if len(s) == k and s[-1] < 2**62 else -np.inf for _, s in found])
                reach = [names[top * x * (1 + 1e-9) + 1e-6 >= t].tolist() for x, t in zip(norm, least, strict=True)]
                yield pa.RecordBatch.from_arrays([C.column(part, "vec_id"), C.column(part, "v"), C.column(part, "norm"), pa.array(least), pa.array(reach, pa.list_(pa.int32()))], names=["vec_id", "v", "norm", "least", "blocks"])

    queries = vectors.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "v", "norm")
    queries = queries.mapInArrow(thresholds, "vec_id long, v binary, norm double, least double, blocks array<int>")
    queries = queries.select(F.explode("blocks").alias("block"), F.lit(1).alias("side"), "vec_id", "v", "norm", "least")
    rows = blocks.select("block", F.lit(0).alias("side"), "vec_id", "v", "norm", F.lit(0.0).alias("least"))
    dealt = rows.unionByName(queries).repartition(max(1, len(tops)), "block").sortWithinPartitions("block", "side")

    def run(batches):
        turn = sent.value[0]
        held, waiting, asked, at = None, [], [], None

        def answer():
            ids, q, norm, least = [np.array([r[0] for r in asked], "int64"), unpack([r[1] for r in asked], dims), np.array([r[2] for r in asked]), np.array([r[3] for r in asked])]
            found = held.best(ids, q, norm, least, turn, k)
            asked.clear()
            who = np.repeat(ids, [len(c) for c, _ in found])
            return pa.RecordBatch.from_arrays([pa.array(who), pa.array(np.concatenate([c for c, _ in found])), pa.array(np.concatenate([s for _, s in found]))], names=["query_id", "vec_id", "score"])

        for b in batches:
            for block, side, *row in zip(*(C.column(b, c).to_pylist() for c in ("block", "side", "vec_id", "v", "norm", "least")), strict=True):
                if block != at:
                    if asked:
                        yield answer()
                    at, held, waiting = block, None, []
                if side == 0:
                    waiting.append(row)
                    continue
                if held is None:
                    held, waiting = Block(*_matrix(waiting, dims), turn), []
                asked.append(row)
                if len(asked) == QUERIES:
                    yield answer()
        if asked:
            yield answer()

    best = dealt.mapInArrow(run, "query_id long, vec_id long, score long").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank, vec_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s) WHERE rank <= 10
"""


def op4_top_inner_products(spark, sf_dir):
    return search(C.table(spark, sf_dir, "embeddings"))

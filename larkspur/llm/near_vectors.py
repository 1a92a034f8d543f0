"""Near-duplicate vectors by sorted projection passes (operator 7).

Each pass hashes every vector to the signs of its products with random directions, concatenated to one number, sorts all
vectors by it and compares each with the next ``window`` ones, across task boundaries too.  What is sorted are vectors
rounded to a byte a component, with the length of what rounding took away: most pairs it decides, and those that lie
nearer to the threshold than it may be off are verified by whole vectors in double precision.  The pairs of all passes
give components.  A task passes on a spanning forest of its sure pairs, and the others that no tree joins.

Vectors of equal direction are joined by a hash first, and only one of them (of the least id) takes part in the passes:
copies fill no windows.  Passes and window grow with the number of those that take part (``extent``), so that a pair at
the threshold is found as often in a large table as in a small one.

Windows are bounded, groups are not, so links are counted afterwards within each component, exactly: with a leader (its
smallest id) at angles a and b, two members surely link when a + b is at most the threshold's angle.  All pairs of
members within half of that angle are counted without a look.  Only the others are compared with the members, in blocks
that stream by; only counts leave a task.

Vectors that are null, zero or hold null or non-finite components link with nothing: 0 links, their own component, kept.
Shorter vectors count as filled up with zeros.  Rows that share an id are one node of the graph, but each counts as a
vector; repeated rows do too.  A null id links with nothing; its component is null and it is not kept.  An empty table
gives an empty result.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .graph import components

SIMILAR, PASSES, WINDOW, BITS = 0.9, 16, 24, 62
#: Different vectors up to which PASSES and WINDOW do: they find about 97 % of random pairs at cosine 0.9.
ENOUGH = 50_000
#: Passes that one shuffle sorts, and rows of one direction that one task joins, about.
AT_ONCE, COPIES = 16, 1 << 18
#: Rows of a block, and members that one task compares with their leader.
BLOCK_ROWS, PARTNERS = 1024, 256
SEED = 17


def extent(n: int, least: float = SIMILAR) -> tuple[int, int]:
    """Passes and window for ``n`` different vectors.

    Two vectors at angle a share a bit with probability p = 1 - a / pi, and a window reaches over about log2(n / window)
    bits, so a pass finds a pair with probability (n / window) ** log2(p): passes grow by its inverse."""
    more = max(1.0, n / ENOUGH)
    window = math.ceil(WINDOW * more**0.25)
    share = 1 - math.acos(max(-1.0, min(1.0, least))) / math.pi
    return math.ceil(PASSES * max(1.0, more * WINDOW / window) ** -math.log2(max(share, 0.5))), window


def direction(v: np.ndarray) -> bytes:
    """128-bit hash that vectors share when they are multiples of each other, but for rounding and zeros at the end."""
    x = v.astype("float64")
    x /= np.abs(x).max()
    x = np.rint(x / np.linalg.norm(x) * 2.0**30).astype("int64")
    return xxhash.xxh3_128_digest(x[: np.flatnonzero(x)[-1] + 1].tobytes())


def unpack(rows: list[bytes], dims: int) -> np.ndarray:
    """Vectors of length one."""
    out = np.zeros((len(rows), dims))
    for i, r in enumerate(rows):
        x = np.frombuffer(r, "<f4" if r[:1] == b"f" else "<f8", offset=1)
        out[i, : len(x)] = x
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v, dims, kind); v and kind are null for rows that link with nothing."""
    kind = "float" if dict(df.dtypes)[vector_col] == "array<float>" else "double"

    def run(batches):
        code, head = ("<f4", b"f") if kind == "float" else ("<f8", b"d")
        for b in batches:
            out, kinds = [], []
            ids = C.column(b, "vec_id")
            for x, i in zip(C.column(b, "x").to_pylist(), ids.to_pylist(), strict=True):
                v = None if i is None or x is None or None in x else np.array(x, code)
                usable = v is not None and v.any() and np.isfinite(v).all()
                out.append(head + v.tobytes() if usable else None)
                kinds.append(direction(v) if usable else None)
            yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.binary()), pa.array([0 if v is None else len(v) // int(code[-1]) for v in out], pa.int32()), pa.array(kinds, pa.binary())], names=["vec_id", "v", "dims", "kind"])

    return df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("x")).mapInArrow(run, "vec_id long, v binary, dims int, kind binary")


class Forest:
    """Pairs that join trees."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.setdefault(x, x)) != x:
            up[x] = up[p] if p in up else p
            x = p
        return x

    def joins(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def rough(x: np.ndarray) -> list[bytes]:
    """Vectors of length one in a byte a component, after their scale and the length of what rounding took away."""
    scale = np.abs(x).max(axis=1, keepdims=True) / 127
    whole = np.rint(x / scale).astype("int8")
    lost = np.linalg.norm(x - whole * scale.astype("<f4").astype("float64"), axis=1)
    head = np.stack([scale[:, 0].astype("<f4"), np.nextafter(lost.astype("<f4"), np.float32(np.inf))], 1)
    return [h.tobytes() + w.tobytes() for h, w in zip(head, whole, strict=True)]


def from_rough(rows: list[bytes], dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors as far as they are known, and how far off they may be."""
    raw = np.frombuffer(b"".join(rows), "uint8").reshape(len(rows), 8 + dims)
    head = raw[:, :8].copy().view("<f4").astype("float64")
    return raw[:, 8:].view("int8") * head[:, :1], head[:, 1]


def close(ids: np.ndarray, passes: np.ndarray, x: np.ndarray, off: np.ndarray, window: int, least: float, forest: Forest, new: int = 0) -> list[tuple[int, int, bool]]:
    """Pairs at most ``window`` apart, of one pass, that join trees; the later one from row ``new`` on.  Those that surely
    reach ``least`` (true) join them; those that may reach it (false) are still to be verified."""
    out = []
    for d in range(1, min(window, len(ids) - 1) + 1):
        start = max(0, new - d)
        cos = np.einsum("nd,nd->n", x[start:-d], x[start + d :])
        slack = off[start:-d] + (1 + off[start:-d]) * off[start + d :] + 1e-9
        near = (cos + slack >= least) & (passes[start:-d] == passes[start + d :]) & (ids[start:-d] != ids[start + d :])
        for i in start + np.flatnonzero(near):
            a, b = int(ids[i]), int(ids[i + d])
            sure = bool(cos[i - start] - slack[i - start] >= least)
            if forest.joins(a, b) if sure else forest.root(a) != forest.root(b):
                out.append((min(a, b), max(a, b), sure))
    return out


def without_copies(rows: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(vec_id, v) of the least id of each direction, and (a, b) that connect each row with it, by way of the least id
    of a share of the direction's rows, so that no task has all rows of a common one."""
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n // COPIES))))
    some = C.materialise(rows.groupBy("kind", "salt").agg(F.min(F.struct("vec_id", "v")).alias("first")), "directions")
    first = C.materialise(some.groupBy("kind").agg(F.min("first").alias("least")), "directions")
    near = rows.select("kind", "salt", "vec_id").join(some.select("kind", "salt", F.col("first.vec_id").alias("a")), ["kind", "salt"]).select("a", F.col("vec_id").alias("b"))
    far = some.join(first, "kind").select(F.col("least.vec_id").alias("a"), F.col("first.vec_id").alias("b"))
    return first.select("least.*"), near.unionByName(far).where("a <> b")


def linked_pairs(rows: DataFrame, dims: int, least: float, passes: int, window: int) -> DataFrame:
    """(a, b): verified pairs of all passes, enough to connect all that were found."""
    parts = [_passes(rows, dims, least, range(p, min(p + AT_ONCE, passes)), window) for p in range(0, passes, AT_ONCE)]
    found = functools.reduce(DataFrame.unionByName, parts)
    return found.where("sure").select("a", "b").unionByName(verified(found.where("not sure").select("a", "b").distinct(), rows, dims, least))


def verified(pairs: DataFrame, rows: DataFrame, dims: int, least: float) -> DataFrame:
    """Of pairs (a, b) those that reach ``least``, by their whole vectors."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                x, y = (unpack(C.column(part, c).to_pylist(), dims) for c in ("va", "vb"))
                keep = pa.array(np.einsum("nd,nd->n", x, y) >= least)
                yield pa.RecordBatch.from_arrays([C.column(part, "a").filter(keep), C.column(part, "b").filter(keep)], names=["a", "b"])

    side = lambda i, v: rows.select(F.col("vec_id").alias(i), F.col("v").alias(v))
    return pairs.join(side("a", "va"), "a").join(side("b", "vb"), "b").select("a", "b", "va", "vb").mapInArrow(run, "a long, b long")


def _passes(rows: DataFrame, dims: int, least: float, passes: range, window: int) -> DataFrame:

    def hashed(batches):
        rng = np.random.default_rng(SEED)
        directions = rng.normal(size=(passes.stop, dims, BITS))
        power = (1 << np.arange(BITS, dtype="int64"))[::-1]
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                x, ids = unpack(C.column(part, "v").to_pylist(), dims), C.column(part, "vec_id").to_numpy()
                small = pa.array(rough(x), pa.binary())
                for p in passes:
                    key = (x @ directions[p] > 0).astype("int64") @ power
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), p, "int16")), pa.array(key), C.column(part, "vec_id"), small], names=["pass", "key", "vec_id", "v"])

    order = ["pass", "key", F.xxhash64("vec_id", "pass")]  # ties in another order in each pass
    placed = rows.select("vec_id", "v").mapInArrow(hashed, "pass short, key long, vec_id long, v binary").repartitionByRange(*order).sortWithinPartitions(*order)
    schema = "a long, b long, sure boolean, edge int, side byte, at int, pass short, v binary"

    def batch(pairs, ends):
        a = [p[0] for p in pairs] + [e[0] for e in ends]
        b, sure = ([p[k] for p in pairs] + [None] * len(ends) for k in (1, 2))
        rest = [[None] * len(pairs) + [e[k] for e in ends] for k in range(1, 6)]
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int8(), pa.int32(), pa.int16(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([a, b, sure, *rest], kinds, strict=True)], names=["a", "b", "sure", "edge", "side", "at", "pass", "v"])

    def slide(batches):
        from pyspark import TaskContext

        me, forest, tail, head = TaskContext.get().partitionId(), Forest(), [], []
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                now = list(zip(*(C.column(b.slice(at, 4096), c).to_pylist() for c in ("vec_id", "pass", "v")), strict=True))
                head += now[: window - len(head)]
                some = tail + now
                pairs = close(np.array([r[0] for r in some]), np.array([r[1] for r in some]), *from_rough([r[2] for r in some], dims), window, least, forest, len(tail))
                tail = some[-window:]
                yield batch(pairs, [])
        yield batch([], [(i, me, 0, k, p, v) for k, (i, p, v) in enumerate(tail)] + [(i, me - 1, 1, k, p, v) for k, (i, p, v) in enumerate(head)])

    found = C.materialise(placed.mapInArrow(slide, schema), "passes")
    ends = found.where("edge is not null").repartition("edge").sortWithinPartitions("edge", "side", "at")

    def across(batches):
        forest, key, some = Forest(), None, []

        def pairs():
            return close(np.array([r[0] for r in some]), np.array([r[1] for r in some]), *from_rough([r[2] for r in some], dims), window, least, forest) if some else []

        for b in batches:
            out = []
            for edge, *row in zip(*(C.column(b, c).to_pylist() for c in ("edge", "a", "pass", "v")), strict=True):
                if edge != key:
                    out += pairs()
                    key, some = edge, []
                some.append(row)
            yield batch(out, [])
        yield batch(pairs(), [])

    return found.where("edge is null").unionByName(ends.mapInArrow(across, schema).where("edge is null")).select("a", "b", "sure")


def _streamed(dealt: DataFrame, dims: int, handle, schema: str) -> DataFrame:
    """Runs ``handle(held rows, iterator over lists of later rows)`` for each group of a sorted stream (group, block, side, vec_id, v, near)."""

    def run(batches):
        key, held, later = None, [], []

        def flush():
            if later:
                yield handle(held, later)

        for b in batches:
            for g, k, side, *row in zip(*(C.column(b, c).to_pylist() for c in ("group", "block", "side", "vec_id", "v", "near")), strict=True):
                if (g, k) != key:
                    yield from flush()
                    key, held, later = (g, k), [], []
                (later if side else held).append(row)
                if len(later) == BLOCK_ROWS:
                    yield handle(held, later)
                    later = []
        yield from flush()

    return dealt.sortWithinPartitions("group", "block", "side").mapInArrow(run, schema)


def count_links(rows: DataFrame, groups: DataFrame, dims: int, least: float) -> DataFrame:
    """(vec_id, n_links) of the members of components (node, component); rows that share an id add up."""
    angle = float(np.arccos(least))
    members = C.materialise(rows.join(groups, F.col("vec_id") == F.col("node")).select(F.col("component").alias("group"), "vec_id", "v"), "members")
    sizes = members.groupBy("group").agg(F.count("*").alias("n"))
    salts = sizes.select("group", F.ceil(F.col("n") / PARTNERS).cast("int").alias("blocks"))
    leader = members.where("vec_id = group").groupBy("group").agg(F.min("v").alias("v")).join(salts, "group")
    leader = leader.select("group", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("side"), F.col("group").alias("vec_id"), "v", F.lit(True).alias("near"))
    each = members.join(salts, "group").select("group", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("side"), "vec_id", "v", F.lit(True).alias("near"))

    def near(held, later):
        to = np.arccos(np.clip(unpack([r[1] for r in later], dims) @ unpack([held[0][1]], dims)[0], -1, 1))
        return pa.RecordBatch.from_arrays([pa.array([held[0][0]] * len(later), pa.int64()), pa.array([r[0] for r in later], pa.int64()), pa.array([r[1] for r in later], pa.binary()), pa.array(to <= angle / 2 - 1e-6)], names=["group", "vec_id", "v", "near"])

    known = C.materialise(_streamed(leader.unionByName(each).repartition("group", "block"), dims, near, "group long, vec_id long, v binary, near boolean"), "near")
    totals = known.groupBy("group").agg(F.count("*").alias("n"), F.sum(F.col("near").cast("long")).alias("sure"))
    sure = known.where("near").join(totals, "group").select("vec_id", (F.col("sure") - 1).alias("n_links"))
    split = totals.where("sure < n").select("group", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks"))
    inside = known.join(split, "group")
    build = inside.select("group", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("side"), "vec_id", "v", "near")
    probe = inside.where("not near").select("group", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("side"), "vec_id", "v", "near")

    def compare(held, later):
        # members count the far ones that they link with; far ones count the near ones
        if not held:
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, names=["vec_id", "n_links"])
        link = unpack([r[1] for r in later], dims) @ unpack([r[1] for r in held], dims).T >= least
        mine, theirs = np.array([r[0] for r in held]), np.array([r[0] for r in later])
        is_near = np.array([r[2] for r in held])
        same = (theirs[:, None] == mine[None]) & ~is_near[None]
        ids = np.concatenate([mine, theirs])
        n = np.concatenate([(link & ~same).sum(0), link[:, is_near].sum(1)])
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n.astype("int64"))], names=["vec_id", "n_links"])

    rest = _streamed(build.unionByName(probe).repartition("group", "block"), dims, compare, "vec_id long, n_links long")
    far = known.where("not near").select("vec_id", F.lit(0).cast("long").alias("n_links"))
    # rows that share an id have the same number here; each of them is counted once
    once = sure.unionByName(far).groupBy("vec_id").agg(F.max("n_links").alias("n_links"))
    return once.unionByName(rest).groupBy("vec_id").agg(F.sum("n_links").alias("n_links"))


@C.shipped
def near_duplicates(df: DataFrame, least: float = SIMILAR, passes: int | None = None, window: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of each row; passes and window that aren't given follow ``extent``."""
    every = C.materialise(vectors(df, id_col, vector_col), "vectors")
    rows = every.where("v is not null")
    dims, n = rows.agg(F.max("dims"), F.count("*")).first()
    if dims is None:
        plain = every.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    else:
        different, copies = without_copies(rows, n)
        grown = extent(different.count(), least)
        pairs = linked_pairs(different, dims, least, passes or grown[0], window or grown[1])
        groups = C.materialise(components(pairs.unionByName(copies)), "groups")
        links = count_links(rows, groups, dims, least)
        plain = every.join(groups.withColumnRenamed("node", "vec_id"), "vec_id", "left").join(links, "vec_id", "left")
        # a row without a usable vector has no part in what its id's other rows do
        plain = plain.select("vec_id", F.when(F.col("v").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), F.when(F.col("v").isNotNull(), F.coalesce("component", "vec_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return plain.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


#: Brute force over all pairs; equal where the passes find every link.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT a AS vec_id, b AS other FROM links UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a),
least AS (SELECT vec_id, min(other) AS m FROM reach GROUP BY 1),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(l.m, e.vec_id)) AS component_id, coalesce(l.m, e.vec_id) >= e.vec_id AS kept
FROM embeddings e LEFT JOIN n USING (vec_id) LEFT JOIN least l USING (vec_id)
"""


def op7_sorted_projections(spark, sf_dir):
    return near_duplicates(C.table(spark, sf_dir, "embeddings"))

"""Similarity join of documents on word n-grams by Jaccard (operator 6): size-aware, heavy and light.

A document's set holds its distinct n-word shingles (hashed to 64 bits).  Equal sets are one class (128-bit digest, named
by its first half while no two share that), so copies cost nothing beyond their own text.  Two classes of sizes n and m link when they share at least
``need(n, m) = ceil(t (n + m) / (1 + t))`` shingles.

* Light, sizes up to a boundary x: for each partner size m a set lists all its subsets of need(n, m) shingles.  Sets of
  sizes n and m link exactly when they meet in a list for these sizes, so a list's first set of either size joins all.
* Heavy, where one size is above x: inverted lists.  Shingles are ordered from rare to frequent (by a count sketch over
  all documents that grows with the input, up to 64 MB), and the first n - ceil(t n) + 1 of a set are posted; linked sets meet in such a list.
* x makes the sum of both costs least, over the histogram of small sizes.

In each list the entry with the fewest rarer shingles leads; every other entry is compared with the leader alone, and
verified links give components.  In a second pass entries outside a list's largest component meet the entries of other
components, if sizes and positions allow that this is their first common shingle (a pair whose first one stands at
positions p and q shares at most min(n - p, m - q)).  A list first tells, for each class of sizes about 1 % wide, the
smallest size and the largest n - p; an entry goes only to those classes in which a partner can be.  So nothing is
capped, a list of thousands of near copies makes thousands of comparisons, and of documents that share a template just
below the threshold the shared part, which stands last in the order, brings none together.  What is left grows with the
square of a list only where many sets in different components could link by their first common shingle and don't.

Comparison reads whole texts again: texts of a pair's right side go to the left side's task, dealt anew by a salt where
one side has many partners.  The set of the left side is held, the others stream by.

Null texts and texts without words have the empty set, link with nothing and are their own component.  A null doc_id
links with nothing and has a null component.  Rows that share a doc_id are one node.  Repeated rows are copies.  An
empty table gives an empty result.  Very long texts are taken whole (8 bytes a shingle, and their words).  Extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .graph import components

#: Similarity as a fraction, and words of a shingle.
SIMILAR, WORDS = (4, 5), 5
#: Buckets of the count sketch (2 to this power, 4 bytes each), and bytes of input from which it doubles with the input.
SKETCH_BITS, SKETCH_BYTES, SKETCH_MOST = 20, 8 << 30, 24
#: Sizes that are counted one by one (larger ones together), and the cost of a comparison in postings.
SIZES, COMPARISON = 4096, 3.0
#: Classes whose postings a task remembers to have made.
SEEN = 100_000
#: Partners of one set that one task compares.
PARTNERS = 256
#: A list that may hold more entries than this (by the sketch, which never counts too few) is aggregated map-side
#: instead of gathered in one task.
HOT_ROWS = 20_000
#: Ratio between the bounds of a size class of the second pass.
SIZE_STEP = 1.01
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Distinct hashed shingles, in order of the hash; words are runs without ASCII white space, A-Z lower-cased."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, "uint64")
    digest = xxhash.xxh3_64_intdigest
    if len(words) < n:
        return np.array([digest(b"\0".join(words), 1)], "uint64")
    memo = {w: digest(w) for w in set(words)}
    x = np.fromiter(map(memo.__getitem__, words), "uint64", len(words))
    with np.errstate(over="ignore"):
        out = np.zeros(len(words) - n + 1, "uint64")
        for k in range(n):
            out = (out ^ x[k : k + len(out)]) * MIX[0]
            out ^= out >> np.uint64(32)
        out = (out ^ (out >> np.uint64(30))) * MIX[1]
        out = (out ^ (out >> np.uint64(27))) * MIX[2]
    return np.unique(out ^ (out >> np.uint64(31)))


def digest(s: np.ndarray, seed: int = 0) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes(), seed)


def need(n: int, m: int, t: tuple[int, int]) -> int:
    """Shingles that linked sets of these sizes share at least."""
    return -(-t[0] * (n + m) // (t[0] + t[1]))


def partners(n: int, t: tuple[int, int]) -> range:
    """Sizes that a set of size n can link with."""
    return range(-(-t[0] * n // t[1]), t[1] * n // t[0] + 1)


def posted(n: int, t: tuple[int, int]) -> int:
    """Postings of a set: the first shingle that it has in common with a linked set is among them."""
    return min(n, n - -(-t[0] * n // t[1]) + 1)


def boundary(sizes: dict[int, int], t: tuple[int, int]) -> int:
    """The largest light size that makes listed subsets, postings and their comparisons cheapest.  Subsets only grow with
    the boundary, so the search ends where they alone cost more than the best so far, or where the largest is light."""
    def subsets(x: int):
        """Of sets of size x, for each size of partner, and of smaller ones for partners of size x; few tell when it is enough."""
        for m in partners(x, t):
            if x in sizes and m <= x:
                yield sizes[x] * math.comb(x, need(x, m, t))
            if m < x and m in sizes:
                yield sizes[m] * math.comb(m, need(m, x, t))

    best, least, light = 0, sum(c * posted(n, t) * COMPARISON for n, c in sizes.items()), 0
    for x in range(1, -(-t[1] * max(sizes, default=0) // t[0]) + 1):
        for more in subsets(x):
            light += more
            if light >= least:
                return best
        cost = light + sum(c * posted(n, t) * COMPARISON for n, c in sizes.items() if t[1] * n > t[0] * x)
        if cost < least:
            best, least = x, cost
    return best


#: Roles of a set in a light list: of the list's one size, the smaller of two, the larger.
ALIKE, SMALLER, LARGER = -1, -3, -2


def light_keys(s: np.ndarray, x: int, t: tuple[int, int], often: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Lists of a small set, its role in each, and how many sets can be in it at most (a list's sets hold all its
    shingles).  Two sets link exactly when they meet in a list, alike or in different roles."""
    often = np.zeros(len(s), int) if often is None else often
    n, out = len(s), []
    for m in partners(n, t):
        if 0 < m <= x:
            head = np.array([min(n, m), max(n, m)], "uint64").tobytes()
            role = ALIKE if n == m else SMALLER if n < m else LARGER
            out += [(xxhash.xxh3_64_intdigest(head + s[list(c)].tobytes(), 2), role, int(often[list(c)].min())) for c in combinations(range(n), need(n, m, t))]
    return out


def sketch_bits(rows: DataFrame) -> int:
    """Places of the sketch, by what the optimizer knows of the input's size (no job)."""
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= 1 << 60:  # not known
        size = 0
    return min(SKETCH_MOST, SKETCH_BITS + max(0, math.ceil(math.log2(max(size, 1) / SKETCH_BYTES))))


def sketch(rows: DataFrame, n: int) -> tuple[np.ndarray, dict[int, int]]:
    """How often shingles of each bucket occur in all texts (32 bits, saturated), and the number of texts of each size."""
    parts, bits = 64, sketch_bits(rows)

    def count(batches):
        C.begin(__name__)
        seen, sizes = np.zeros(1 << bits, "uint32"), np.zeros(SIZES, "int64")
        for b in C.slices(batches):
            sets = [shingles(t, n) for t in C.texts_of(b)]
            sizes += np.bincount([min(len(s), SIZES - 1) for s in sets], minlength=len(sizes))
            at, times = np.unique((np.concatenate(sets) >> np.uint64(64 - bits)).astype("int64"), return_counts=True)
            seen[at] += times.astype("uint32")
        if sizes.any():
            cells = np.split(seen, parts)
            width = [int(c.max(initial=0)) for c in cells]  # most counts of a task fit in one or two bytes
            kinds = ["u1" if w < 1 << 8 else "<u2" if w < 1 << 16 else "<u4" for w in width]
            yield pa.RecordBatch.from_arrays([pa.array([*range(parts), parts], pa.int32()), pa.array([*kinds, "<i8"]), pa.array([*(c.astype(k).tobytes() for c, k in zip(cells, kinds, strict=True)), sizes.tobytes()], pa.binary())], names=["part", "kind", "cells"])
        del seen
        C.trim()

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for part, kind, cells in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = np.frombuffer(cells, kind).astype("int64")
                total[part] = total[part] + x if part in total else x
        for part, x in total.items():
            if part < parts:
                x = np.minimum(x, (1 << 31) - 1).astype("<i4")
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([x.dtype.str]), pa.array([x.tobytes()], pa.binary())], names=["part", "kind", "cells"])

    schema = "part int, kind string, cells binary"
    got = {r.part: np.frombuffer(r.cells, r.kind) for r in rows.mapInArrow(count, schema).repartition("part").mapInArrow(add, schema).collect()}  # 2 ** SKETCH_MOST counts at most
    if not got:
        return np.zeros(1 << bits, "int32"), {}
    return np.concatenate([got[k] for k in range(parts)]), {n: int(c) for n, c in enumerate(got[parts]) if n and c}


def postings(rows: DataFrame, seen: np.ndarray, x: int, n: int, t: tuple[int, int], seed: int = 0) -> DataFrame:
    """One row of kind 0 for each document (key: the digest's other half; size) and its class's postings (kind 1 light,
    2 heavy, negative where the list may be hot; key: the list, position).  A task posts a class once."""
    sent = rows.sparkSession.sparkContext.broadcast(seen)  # 4 * 2 ** SKETCH_MOST bytes at most
    bits, limit = len(seen).bit_length() - 1, HOT_ROWS

    def run(batches):
        C.begin(__name__)
        often, done = sent.value, set()
        for b in C.slices(batches):
            ids = C.column(b, "doc_id").to_pylist()
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            docs = np.zeros((5, len(ids)), "int64")
            for i, text in enumerate(C.texts_of(b)):
                s = shingles(text, n)
                d = digest(s, seed)
                a, c = np.frombuffer(d, "<i8")
                docs[:, i] = 0, a, c, len(s), 0
                if not len(s) or d in done or ids[i] is None:
                    continue
                if len(done) < SEEN:
                    done.add(d)
                count = often[(s >> np.uint64(64 - bits)).astype("int64")]
                made = []  # (kind, key, at, most) of each list
                if len(s) <= x and (keys := light_keys(s, x, t, count)):
                    made.append((1, np.array([k for k, _, _ in keys], "uint64"), np.array([r for _, r, _ in keys]), np.array([m for _, _, m in keys])))
                if t[1] * len(s) > t[0] * x:
                    order = np.lexsort((s, count))[: posted(len(s), t)]
                    made.append((2, s[order], np.arange(len(order)), count[order]))
                for kind, key, at, most in made:
                    out[0].append(np.where(most > limit, -kind, kind))
                    out[1].append(np.full(len(key), a))
                    out[2].append(key.view("int64"))
                    out[3].append(np.full(len(key), len(s)))
                    out[4].append(at)
            cols = [np.concatenate([docs[k], *out[k]]) for k in range(5)]
            who = pa.array(ids + [None] * (len(cols[0]) - len(ids)), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(cols[0].astype("int8")), pa.array(cols[1]), pa.array(cols[2]), pa.array(cols[3].astype("int32")), pa.array(cols[4].astype("int32")), who], names=["kind", "class", "key", "size", "at", "doc_id"])
        del done
        C.trim()

    return rows.mapInArrow(run, "kind byte, class long, key long, size int, at int, doc_id long")


def compare(pairs: DataFrame, classes: DataFrame, rows: DataFrame, n: int, t: tuple[int, int], seed: int = 0) -> DataFrame:
    """Of pairs of classes (a, b) those that link, by whole texts of one document of each class."""
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("salts"))
    left = salts.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("side"), F.col("a").alias("class"))
    right = pairs.join(salts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("side"), F.col("b").alias("class"))
    places = left.unionByName(right).join(classes.select("class", F.col("rep").alias("doc_id")), "class")
    places = C.materialise(places.select("doc_id", "a", "salt", "side", F.col("class").alias("b")), "places")
    # texts move once to their places' rows and once to their places, at every size alike
    wanted = C.may_be_among(places.select("doc_id"))
    dealt = rows.where(wanted(F.col("doc_id"))).join(places.hint("merge"), "doc_id").select("a", "salt", "side", "b", "text")
    dealt = dealt.repartition("a", "salt").sortWithinPartitions("a", "salt", "side", "b")

    def run(batches):
        held, key = None, None
        for b in C.slices(batches):
            out = []
            for a, side, other, text in zip(*(C.column(b, c).to_pylist() for c in ("a", "side", "b", "text")), strict=True):
                s = shingles(text, n)
                if np.frombuffer(digest(s, seed), "<i8")[0] != other:
                    continue  # another text under the same id
                if side == 0:
                    held, key = s, a
                elif key == a:
                    both = len(np.intersect1d(held, s, assume_unique=True))
                    if t[1] * both >= t[0] * (len(held) + len(s) - both):
                        out.append((a, other))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], names=["a", "b"])
        C.trim()

    return dealt.mapInArrow(run, "a long, b long")


@C.shipped
def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, t: tuple[int, int] = SIMILAR) -> DataFrame:
    """doc_id, n_shingles, component_id of each row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    seen, sizes = sketch(rows, n)
    x = boundary(sizes, t)
    seed, clash = -1, True
    while clash:  # classes go by the first half of their digest; if two ever share it, all are named anew
        seed += 1
        made = C.materialise(postings(rows, seen, x, n, t, seed), "postings")  # one pass makes all kinds of rows
        table = made.where("kind = 0").select("doc_id", "class", F.col("key").alias("half"), "size")
        real = table.where("size > 0 and doc_id is not null")
        classes = real.groupBy("class").agg(F.min("doc_id").alias("rep"), (F.min("half") != F.max("half")).alias("clash"))
        classes = C.materialise(classes, "classes")
        clash = not classes.where("clash").isEmpty()
    # lists keep only keys that two classes have; the leader of a list has the fewest rarer shingles
    entry, span = F.struct("at", "class", "size"), Window.partitionBy("key")
    whole = {"lead": F.min(entry), "top": F.max(entry), "least": F.min("class"), "most": F.max("class")}
    cool = made.where("kind > 0").select("kind", "key", "class", "size", "at").repartition("key")
    for name, value in whole.items():
        cool = cool.withColumn(name, value.over(span))
    warm = made.where("kind < 0").select(F.abs("kind").cast("byte").alias("kind"), "key", "class", "size", "at").distinct()
    warm = C.materialise(warm, "warm")
    ends = warm.groupBy("key").agg(*(value.alias(name) for name, value in whole.items())).where("least != most")
    lists = cool.where("least != most").unionByName(warm.join(ends, "key"))
    lists = lists.select("kind", "key", "class", "size", "at", *(F.col(f"{who}.{what}").alias(name) for who in ("lead", "top") for what, name in (("class", who), ("size", f"{who}_size"), ("at", f"{who}_at"))))
    lists = C.materialise(lists, "lists")
    met = lists.where("class != lead").where(_fits("size", "at", "lead_size", "lead_at", t))
    # of a light list with two sizes the smaller sets meet the first of the larger ones too
    met = met.select("class", "lead").unionByName(lists.where(f"top_at = {LARGER} and at = {SMALLER}").select("class", F.col("top").alias("lead")))
    met = met.select(F.least("class", "lead").alias("a"), F.greatest("class", "lead").alias("b"), F.col("lead")).groupBy("a", "b").agg(F.min("lead").alias("lead"))
    # the leader is the side that is held
    first = C.materialise(met.select(F.col("lead").alias("a"), F.when(F.col("a") == F.col("lead"), F.col("b")).otherwise(F.col("a")).alias("b")), "pairs")
    links = C.materialise(compare(first, classes, rows, n, t, seed), "links")
    group = C.materialise(components(links), "groups")

    # second pass: what lies outside the largest component of a list
    own = lists.select("kind", "key", "class", "size", "at").join(group.withColumnRenamed("node", "class").hint("merge"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    own = own.where("kind = 2")
    counts = own.groupBy("key", "component").agg(F.count("*").alias("n"))
    main = counts.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("groups")).where("groups > 1").select("key", "main")
    open_lists = C.materialise(own.join(main.hint("merge"), "key"), "open")
    p, q = t
    step = lambda c: F.floor(F.log(c.cast("double")) / math.log(SIZE_STEP)).cast("int")
    # what a list holds, by size class: an entry only goes to the classes in which a partner can be
    cells = open_lists.groupBy("key", step(F.col("size")).alias("sizes")).agg(F.min("size").alias("m"), F.max(F.col("size") - F.col("at")).alias("rest"))
    there = cells.groupBy("key").agg(F.collect_list(F.struct("sizes", "m", "rest")).alias("there"))  # a struct a size class
    can = lambda c: (F.least(F.col("size") - F.col("at"), c["rest"]) * (p + q) >= p * (F.col("size") + c["m"])) & (c["m"] * p <= F.col("size") * q)
    probe = open_lists.where("component != main").join(there.hint("merge"), "key").withColumn("sizes", F.filter("there", can))
    probe = probe.select("key", F.explode("sizes.sizes").alias("sizes"), F.col("class").alias("a"), F.col("size").alias("n"), F.col("at").alias("i"), F.col("component").alias("ca"), "main")
    build = open_lists.select("key", step(F.col("size")).alias("sizes"), F.col("class").alias("b"), F.col("size").alias("m"), F.col("at").alias("j"), F.col("component").alias("cb"))
    # a list gives a pair once: from the side that lies outside the largest component, of two such sides from the smaller
    cross = probe.join(build.hint("merge"), ["key", "sizes"]).where("ca != cb and (cb = main or a < b)").where(_fits("n", "i", "m", "j", t))
    cross = cross.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    done = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    second = C.materialise(cross.join(done, ["a", "b"], "left_anti"), "pairs")
    more = C.materialise(compare(second, classes, rows, n, t, seed), "links")

    # rows that share an id are one node: their classes are linked
    shared = real.groupBy("doc_id").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a != b")
    shared = real.join(shared.select("doc_id", "a"), "doc_id").select("a", F.col("class").alias("b"))
    star = group.select(F.col("node").alias("a"), F.col("component").alias("b"))
    final = components(star.unionByName(more).unionByName(shared)).withColumnRenamed("node", "class")
    # the least id of each component, then of each class
    named = C.materialise(classes.join(final, "class", "left").withColumn("component", F.coalesce("component", "class")), "named")
    least = named.groupBy("component").agg(F.min("rep").alias("least"))
    named = named.join(least, "component").select("class", "least")
    mine = table.join(named, "class", "left")
    whose = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return mine.select("doc_id", F.col("size").cast("long").alias("n_shingles"), whose.alias("component_id"))


def _fits(n: str, i: str, m: str, j: str, t: tuple[int, int]):
    """Whether sizes and positions let two sets link whose first common shingle this is; in a light list roles decide."""
    p, q = t
    enough = F.least(F.col(n) - F.col(i), F.col(m) - F.col(j)) * (p + q) >= p * (F.col(n) + F.col(m))
    light = (F.col(i) < 0) & ((F.col(i) == ALIKE) | (F.col(i) != F.col(j)))
    return light | ((F.col(i) >= 0) & enough & (F.least(n, m) * q >= F.greatest(n, m) * p))


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
shared AS (SELECT g FROM s GROUP BY 1 HAVING count(*) > 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM (SELECT s.* FROM s JOIN shared USING (g)) a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, b AS other FROM edges UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON r.other = e.a),
least AS (SELECT doc_id, min(other) AS m FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(l.m, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least l USING (doc_id)
"""


def op6_ngram_jaccard(spark, sf_dir):
    return similar_groups(C.table(spark, sf_dir, "documents"))

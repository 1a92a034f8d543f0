"""Best-fit packing by a linear grouping scheme (operator 3).

Documents become ids, end with an id, and are cut only where they are longer than a sequence.  Documents of one length
are interchangeable, so the whole packing is a function of the histogram of lengths: at most ``capacity`` counts,
however many documents there are.  The driver plans on it, and executors look up their rows:

1. Large lengths are sorted and dealt into groups of equal cardinality; each is rounded up to its group's largest.
2. The few sizes that are left make a linear program over configurations (column generation: a dense simplex, priced by
   a knapsack over the capacity).  Its solution is rounded down.
3. Actual documents take the slots of their group, so sequences keep the room that rounding up had reserved.
4. What is left of the large and all small lengths go best-fit decreasing into the tightest room that holds them.

Steps 1 to 4 run for a few numbers of groups and limits of "large"; the plan with the fewest sequences stays.  A plan is
a list of runs: documents of a length from one rank to another lie ``per`` to a sequence from a sequence on.  The number
of runs depends on the capacity alone.  Ranks within a length come from buckets by hash, so a length that a third of all
rows have is numbered by many tasks.

Null text counts as empty and gives one piece, the end id.  Very long texts are encoded in overlapping chunks and cut
into as many pieces as they need.  Repeated rows are packed like any others; rows that tie in length are placed by doc_id,
piece and start.  An empty table gives an empty result.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .token_counts import encoder, tokenizer_path

CAPACITY, END_ID = 4096, 1
#: Lengths above capacity / LARGE are large; numbers of groups that are tried.
LARGE, GROUPS = (4, 8, 16), (12, 24)
#: Rows of a length that one task numbers.
BUCKET_ROWS = 200_000
#: Texts beyond this many characters are encoded in overlapping chunks.
CHUNK = 4_000_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@C.shipped
def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of each document: doc_id, piece, start, length, ids_crc32.  One pass, no shuffle."""

    def step():
        ids_of, end = encoder(path, CHUNK, owner=__name__).ids, np.uint32(end_id).tobytes()

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows: list[tuple] = []
            names = C.column(batch, "doc_id").to_pylist()
            for name, ids in zip(names, ids_of([t or "" for t in C.texts_of(batch)]), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((name, k, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

        return one

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return C.by_slice(rows, step, PIECES)


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 1000) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often each is used, by column generation; the fewest sequences when parts are allowed."""
    k = len(sizes)
    s, d = np.array(sizes), np.array(demand, float)
    basis = np.diag([float(capacity // x) for x in sizes])
    for _ in range(rounds):
        price = np.linalg.solve(basis.T, np.ones(k))
        # the knapsack's best value for each room, and the item put in last (-1: a unit of room is left empty)
        value, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for room in range(int(s.min()), capacity + 1):
            fits = s <= room
            gain = np.where(fits, value[room - np.where(fits, s, 0)] + price, -1.0)
            g = int(gain.argmax())
            if gain[g] > value[room - 1]:
                value[room], last[room] = gain[g], g
            else:
                value[room] = value[room - 1]
        if value[capacity] <= 1 + 1e-9:
            break
        new, room = np.zeros(k), capacity
        while room > 0:
            if (g := last[room]) < 0:
                room -= 1
            else:
                new[g] += 1
                room -= s[g]
        x, u = np.linalg.solve(basis, d), np.linalg.solve(basis, new)
        ratio = np.where(u > 1e-9, x / np.where(u > 1e-9, u, 1), np.inf)
        basis[:, int(ratio.argmin())] = new
    x = np.linalg.solve(basis, d)
    return [(basis[:, i].astype(int), float(x[i])) for i in range(k)]


class Plan:
    """Runs (length, first rank, number, first sequence, per sequence, offset), and how many sequences they fill."""

    def __init__(self, capacity: int):
        self.capacity, self.runs, self.sequences = capacity, [], 0
        self.room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> sequences (first, number)
        self.rooms: list[int] = []  # its keys in order

    def leave(self, room: int, first: int, number: int) -> None:
        if number and room:
            if not self.room[room]:
                bisect.insort(self.rooms, room)
            self.room[room].append((first, number))

    def best_fit(self, length: int, rank: int, number: int) -> None:
        while number:
            at = bisect.bisect_left(self.rooms, length)
            if at == len(self.rooms):
                need = -(-number // (self.capacity // length))
                self.leave(self.capacity, self.sequences, need)
                self.sequences += need
                continue
            room = self.rooms[at]
            first, there = self.room[room].pop()
            if not self.room[room]:
                del self.rooms[at]
            per = room // length
            use = min(there, number // per)
            took = use * per if use else number
            self.runs.append((length, rank, took, first, per, self.capacity - room))
            self.leave(room - (per * length if use else number * length), first, use or 1)
            self.leave(room, first + (use or 1), there - (use or 1))
            rank, number = rank + took, number - took


def plan(histogram: dict[int, int], capacity: int, large: int, groups: int) -> Plan:
    """The packing of so many documents of each length."""
    out, rank = Plan(capacity), dict.fromkeys(histogram, 0)
    if n := histogram.get(capacity, 0):
        out.runs.append((capacity, 0, n, 0, 1, 0))
        out.sequences = n
    big = [(x, histogram[x]) for x in sorted(histogram, reverse=True) if capacity / large < x < capacity]
    total = sum(n for _, n in big)
    if groups := min(groups, total):  # a group holds a document at least
        queues: list[list[list[int]]] = []
        left = 0
        for x, n in big:
            while n:
                if not left:
                    left = -(-total * (len(queues) + 1) // groups) - (-(-total * len(queues) // groups))
                    queues.append([])
                    continue
                take = min(n, left)
                queues[-1].append([x, take])
                n, left = n - take, left - take
        merged: list[list[list[int]]] = []  # neighbours of one rounded length are one size
        for q in queues:
            if merged and merged[-1][0][0] == q[0][0]:
                merged[-1] += q
            else:
                merged.append(q)
        for slots, often in configurations([q[0][0] for q in merged], [sum(n for _, n in q) for q in merged], capacity):
            number = int(often + 1e-7)
            number = min([number, *(sum(n for _, n in q) // int(c) for q, c in zip(merged, slots, strict=True) if c)])
            if not number or not slots.any():
                continue
            filled = [(0, number, 0)]  # parts of these sequences: first, number, tokens
            for q, c in zip(merged, slots, strict=True):
                for _ in range(int(c)):
                    filled = _lay(out, q, rank, filled)
            for first, n, tokens in filled:
                out.leave(capacity - tokens, out.sequences + first, n)
            out.sequences += number
    for x in sorted(histogram, reverse=True):
        if x < capacity and (n := histogram[x] - rank[x]):
            out.best_fit(x, rank[x], n)
    return out


def _lay(out: Plan, queue: list[list[int]], rank: dict[int, int], filled: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The next documents of a group into one slot of each sequence."""
    after = []
    for first, number, tokens in filled:
        while number:
            while not queue[0][1]:
                queue.pop(0)
            x, there = queue[0]
            take = min(there, number)
            out.runs.append((x, rank[x], take, out.sequences + first, 1, tokens))
            after.append((first, take, tokens + x))
            rank[x] += take
            queue[0][1] -= take
            first, number = first + take, number - take
    return after


def best_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan | None:
    """The plan with the fewest sequences; stops at the least that any packing needs."""
    best, least = None, -(-sum(x * n for x, n in histogram.items()) // capacity)
    for large in LARGE:
        for groups in GROUPS:
            found = plan(histogram, capacity, large, groups)
            if best is None or found.sequences < best.sequences:
                best = found
            if best.sequences <= least:
                return best
    return best


@C.shipped
def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows that have a length from 1 to ``capacity``; ``pieces`` is read three times."""
    spark = pieces.sparkSession
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    found = best_plan(histogram, capacity)
    runs = np.array(found.runs or [(0, 0, 0, 0, 1, 0)], "int64")
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    sent = spark.sparkContext.broadcast(runs)
    buckets = max(8, -(-max(histogram.values(), default=1) // BUCKET_ROWS))
    dealt = pieces.withColumn("_bucket", F.pmod(C.row_key("doc_id", "piece"), F.lit(buckets)))
    base = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    base = base.select("length", "_bucket", (F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")).alias("_base"))
    number = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "start")) - 1
    ranked = dealt.withColumn("_number", number).join(base, ["length", "_bucket"])
    ranked = ranked.select(*pieces.columns, (F.col("_base") + F.col("_number")).alias("_rank"))

    def place(batches):
        table = sent.value
        key = (table[:, 0] << 50) + table[:, 1]
        for b in batches:
            length, rank = (C.column(b, n).to_numpy() for n in ("length", "_rank"))
            run = table[np.searchsorted(key, (length << 50) + rank, "right") - 1]
            k = rank - run[:, 1]
            keep = [x for x in b.schema.names if x != "_rank"]
            yield pa.RecordBatch.from_arrays([*(C.column(b, x) for x in keep), pa.array(run[:, 3] + k // run[:, 4]), pa.array(run[:, 5] + length * (k % run[:, 4]))], names=[*keep, "sequence_id", "offset"])

    from pyspark.sql import types as T

    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """PIECES with sequence_id and offset.  Ids are made once; their rows (40 bytes a piece) are kept in the shared folder."""
    return pack(C.materialise(cut_pieces(docs, path, capacity, end_id, id_col, text_col), "pieces"), capacity)


def op3_best_fit_packing(spark, sf_dir):
    return pack_documents(C.table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))

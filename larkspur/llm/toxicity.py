"""Toxicity by a factorization machine over hashed terms (operator 2).

A text's features are the hashed lower-case words that it holds and the first letters of the longer ones, each once.  The score is the logistic of
``w0 + sum w_i + sum_(i<j) <v_i, v_j>``: the second sum learns what two terms mean together, as an insult beside the
mention of a group, which no sum of single weights can.  It is computed from per-text sums of factors, in time linear
in the features.

Fitting: at most ``Fit.rows`` labelled texts, the first by a hash of their ids, give their features on the executors;
the driver keeps the ``Fit.terms`` hashed terms that tell the classes apart best (half the G
statistic above ``Fit.gain``, at least ``Fit.least`` texts), and those of the ``Fit.pair_terms`` most frequent ones that
tell ``Fit.pair_gain`` more beside another than either does alone; it fits with Adagrad in numpy.  Scoring is one pass over all texts, without a shuffle.

Null and empty texts have no features and score like the intercept.  Very long texts are taken whole: each term counts
once.  Rows whose label is null are not learned from; if labels disagree or repeat, each row counts.  Ties in the order of
terms go to the lower bucket.  Without labelled rows every score is 0; an empty table gives an empty result.  Extra
columns are kept by ``score``, whose own are named by ``out``.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

WORDS = re.compile(r"[^\W\d_]+").findall
#: Letters of the stems that count as terms beside whole words, so that an inflected insult is known again.
STEMS = (4, 5)
#: Hashed terms whose buckets a worker remembers.
MEMO_WORDS = 60_000


@dataclass(frozen=True)
class Fit:
    rows: int = 12_000
    bits: int = 20
    terms: int = 2048
    least: int = 3
    gain: float = 8.0
    pair_terms: int = 512
    pair_gain: float = 20.0
    factors: int = 8
    epochs: int = 30
    batch: int = 256
    rate: float = 0.1
    decay: float = 1e-4
    decay_pairs: float = 1e-3
    seed: int = 7


@dataclass
class Hasher:
    """Buckets of words; the memo is shared by all texts of a worker."""

    bits: int
    memo: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def buckets(self, text: str | None) -> np.ndarray:
        """Distinct buckets of the words and stems of a text, in order."""
        if not text:
            return np.zeros(0, "int32")
        memo, mask, out = self.memo, (1 << self.bits) - 1, []
        for w in set(WORDS(text.lower())):
            if (b := memo.get(w)) is None:
                b = tuple(zlib.crc32(x.encode()) & mask for x in (w, *(w[:n] + "~" for n in STEMS if len(w) > n)))
                if len(memo) < MEMO_WORDS:
                    memo[w] = b
            out += b
        return np.unique(np.array(out, "int32"))


class Machine:
    """The fitted model: intercept, hashed terms in order, their weights and factors."""

    def __init__(self, w0: float, terms: np.ndarray, w: np.ndarray, v: np.ndarray, bits: int):
        self.w0, self.terms, self.w, self.v, self.bits = w0, terms, w, v, bits

    def raw(self, rows: list[np.ndarray]) -> np.ndarray:
        """Log-odds of texts given by the indices of their terms."""
        at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        flat = np.concatenate(rows).astype(int) if rows else np.zeros(0, int)
        out = self.w0 + np.bincount(at, self.w[flat], len(rows))
        for f in range(self.v.shape[1]):
            x = self.v[flat, f]
            out += 0.5 * (np.bincount(at, x, len(rows)) ** 2 - np.bincount(at, x * x, len(rows)))
        return out

    def index(self, buckets: np.ndarray) -> np.ndarray:
        """Which of the model's terms these are."""
        if not len(self.terms):
            return np.zeros(0, int)
        at = np.searchsorted(self.terms, buckets)
        at[at == len(self.terms)] = 0
        return at[self.terms[at] == buckets]

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw([self.index(r) for r in rows]), -500, 500)))


def fit(rows: list[np.ndarray], labels: np.ndarray, how: Fit = Fit()) -> Machine:
    """Fits to texts given by their buckets."""
    none = Machine(-500.0, np.zeros(0, "int32"), np.zeros(0), np.zeros((0, how.factors)), how.bits)
    labels = np.asarray(labels, float)
    if not len(labels) or not labels.any():
        return none
    if labels.all():
        return Machine(500.0, none.terms, none.w, none.v, how.bits)
    size = 1 << how.bits
    every = np.bincount(np.concatenate(rows), minlength=size)
    some = np.flatnonzero(every >= how.least)  # few of all buckets
    hits = np.bincount(np.concatenate([r for r, y in zip(rows, labels, strict=True) if y] or [np.zeros(0, int)]), minlength=size)[some].astype(float)
    every = every[some].astype(float)
    pos, n = labels.sum(), len(labels)

    def g(seen, total):  # of the 2 x 2 table of a term and the label
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(seen > 0, seen * np.log(seen / total), 0.0)

    score = g(hits, every * pos / n) + g(every - hits, every * (n - pos) / n) + g(pos - hits, (n - every) * pos / n) + g(n - pos - every + hits, (n - every) * (n - pos) / n)
    best = np.argsort(-score, kind="stable")[: how.terms]
    best = best[score[best] > how.gain]

    # frequent terms that tell nothing alone, but much beside another
    often = np.sort(np.argsort(-every, kind="stable")[: how.pair_terms])
    both, toxic = np.zeros((len(often), len(often))), np.zeros((len(often), len(often)))
    for k in range(0, len(rows), 1024):
        there = np.stack([np.isin(some[often], r, assume_unique=True) for r in rows[k : k + 1024]]).astype("float32")
        both += there.T @ there
        there = there[labels[k : k + 1024] == 1]
        toxic += there.T @ there
    pair = g(toxic, both * pos / n) + g(both - toxic, both * (n - pos) / n) + g(pos - toxic, (n - both) * pos / n) + g(n - pos - both + toxic, (n - both) * (n - pos) / n)
    alone = np.maximum(score[often][:, None], score[often][None])
    tells = (pair > alone + how.pair_gain) & (both >= how.least) & ~np.eye(len(often), dtype=bool)
    best = np.union1d(best, often[tells.any(1)]).astype(int)
    terms = some[best].astype("int32")
    rng = np.random.default_rng(how.seed)
    model = Machine(float(np.log(pos / (n - pos))), terms, np.zeros(len(terms)), rng.normal(0, 0.05, (len(terms), how.factors)), how.bits)
    x = [model.index(r) for r in rows]
    gw, gv, g0 = np.full(len(terms), 1e-6), np.full(model.v.shape, 1e-6), 1e-6
    for _ in range(how.epochs):
        order = rng.permutation(n)
        for k in range(0, n, how.batch):
            pick = order[k : k + how.batch]
            some = [x[i] for i in pick]
            at, flat = np.repeat(np.arange(len(some)), [len(r) for r in some]), np.concatenate(some)
            v = model.v[flat]
            sums = np.stack([np.bincount(at, v[:, f], len(some)) for f in range(how.factors)], 1)
            z = model.w0 + np.bincount(at, model.w[flat], len(some)) + 0.5 * (sums**2 - np.stack([np.bincount(at, v[:, f] ** 2, len(some)) for f in range(how.factors)], 1)).sum(1)
            miss = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels[pick]) / len(some)
            used, back = np.unique(flat, return_inverse=True)
            dw = np.bincount(back, miss[at], len(used)) + how.decay * model.w[used]
            each = miss[at][:, None] * (sums[at] - v)
            dv = np.stack([np.bincount(back, each[:, f], len(used)) for f in range(how.factors)], 1) + how.decay_pairs * model.v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            g0 += miss.sum() ** 2
            model.w[used] -= how.rate * dw / np.sqrt(gw[used])
            model.v[used] -= how.rate * dv / np.sqrt(gv[used])
            model.w0 -= how.rate * miss.sum() / np.sqrt(g0)
    return model


@C.shipped
def learn(docs: DataFrame, labels: DataFrame, use: Column, how: Fit = Fit(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Machine:
    """Fits to the labelled documents for which ``use`` (over the id) holds.

    At most ``how.rows`` labels, the first by hash of the id, go to the driver and from there to the executors, which
    return the buckets of those texts (4 bytes a distinct word)."""
    some = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("id").isNotNull() & F.col("label").isNotNull())
    some = some.where(use_on(use, "id"))
    # a share by hash first, so that what is sorted doesn't grow with the number of tasks
    share = 1.2 * how.rows / max(1, some.count())
    some = some.where(F.pmod(C.row_key("id"), F.lit(1 << 30)) < F.lit(min(1.0, share) * (1 << 30)))
    picked = some.orderBy(C.row_key("id"), "id", "label").limit(how.rows).collect()  # how.rows at most
    if not picked:
        return fit([], np.zeros(0), how)
    ids = docs.sparkSession.createDataFrame([(i,) for i in sorted({r.id for r in picked})], "id long")

    def step():
        hasher = Hasher(how.bits)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [hasher.buckets(t).astype("<i4").tobytes() for t in C.texts_of(batch)]
            return pa.RecordBatch.from_arrays([C.column(batch, "id"), pa.array(rows, pa.binary())], names=["id", "buckets"])

        return one

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.join(F.broadcast(ids), "id", "left_semi")  # how.rows ids at most
    found = C.by_slice(texts, step, "id long, buckets binary").collect()
    of: dict[int, list[np.ndarray]] = {}
    for r in sorted(found, key=lambda r: (r.id, bytes(r.buckets))):  # any order of rows fits the same model
        of.setdefault(r.id, []).append(np.frombuffer(r.buckets, "<i4"))
    pairs = [(row, r.label) for r in picked for row in of.get(r.id, [])]
    model = fit([p[0] for p in pairs], np.array([float(p[1] == 1) for p in pairs]), how)
    del found, of, pairs
    C.trim()  # the driver's memory too
    return model


def use_on(use, name: str) -> Column:
    """``use`` is a function from the id's column to a condition, or a condition."""
    return use(F.col(name)) if callable(use) else use


@C.shipped
def score(docs: DataFrame, model: Machine, text_col: str = "text", out: tuple[str, str] = ("_score", "_predicted")) -> DataFrame:
    """All rows of ``docs`` with a score and a prediction, named by ``out``, beside their own columns; one pass, no shuffle."""
    from pyspark.sql import types as T

    sent = docs.sparkSession.sparkContext.broadcast(model)  # how.terms rows at most
    names = docs.columns
    at = names.index(text_col)

    def step():
        m = sent.value
        hasher = Hasher(m.bits)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            s = m.scores([hasher.buckets(t) for t in batch.column(at).to_pylist()])
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= 0.5).astype("int32"))], names=[*names, *out])

        return one

    return C.by_slice(docs, step, T.StructType([*docs.schema.fields, T.StructField(out[0], T.DoubleType()), T.StructField(out[1], T.IntegerType())]), text_col)


def op2_factorization_toxicity(spark, sf_dir):
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, C.table(spark, sf_dir, "labels"), lambda i: ~C.held_out(i))
    out = score(docs, model)
    return out.select("doc_id", C.held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), F.col("_predicted").alias("predicted"))

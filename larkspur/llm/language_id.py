"""Language identification by nearest centroid (operator 8).

A text's vector holds its letter n-grams (runs of 1 to 3 bytes of lower-cased UTF-8, white space and everything that is
no letter taken as one blank), hashed to ``Fit.dims`` places, weighted by 1 + log(count) and inverse document frequency,
and scaled to length one.  Each language has up to ``Fit.clusters`` centroids from spherical k-means over its training
texts.  A text gets the language of the centroid with the highest cosine.  It is rejected when it lies too far from it:
when the cosine is below ``Fit.floor`` times the lowest of that centroid's texts of about this length.  Cosines grow with
length, so floors are kept for each centroid and doubling of the number of distinct n-grams.  They come from a quarter of
the texts, which the centroids aren't made of; a centroid, and then a language, with too few of them takes its language's
floor, or the lowest of all.

Fitting: about ``Fit.per_language`` texts a language, drawn by a hash of their ids, give their counts on the executors;
the driver fits in numpy, a language at a time.  Every language with a labelled text is learned, however rare: what is
collected is bounded by fewer texts of each (``Fit.rows`` in all, ``Fit.few`` a language at least).  Scoring is one pass
over all texts.

Null texts and texts without a letter are ``und`` with score 0 and rejected.  If nothing can be learned, every text is.
Equal cosines go to the language first in order.  Repeated rows each count in fitting and give repeated results; an empty
table gives an empty result.  Very long texts are counted whole, by steps.  Extra columns are kept by ``identify``, whose
own are named by ``out``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

UNKNOWN = "und"
HAS_LETTER = re.compile(r"[^\W\d_]").search
#: Bytes that count as parts of letters; all others are blanks.
LETTERS = np.array([i if i >= 0x80 or chr(i).isalpha() else 0x20 for i in range(256)], "uint8")
#: Bytes of text whose n-grams one numpy step counts.
STEP_BYTES = 400_000
#: Doublings of distinct n-grams that have floors of their own; texts that a floor needs, and those it is taken from.
LENGTHS, ENOUGH, ABOUT = 16, 8, 20


@dataclass(frozen=True)
class Fit:
    per_language: int = 600
    rows: int = 24_000
    few: int = 20
    dims: int = 1 << 13
    clusters: int = 4
    rounds: int = 12
    floor: float = 0.5
    lowest: float = 0.1  # the floor where no language has texts enough to tell
    seed: int = 11


def folded(text: str | None) -> np.ndarray:
    """The bytes whose n-grams count: lower-cased, runs of what is no letter as one blank, blanks at both ends."""
    x = LETTERS[np.frombuffer(b" " + (text or "").lower().encode("utf-8", "surrogatepass") + b" ", "uint8")]
    blank = x == 0x20
    return x[~(blank & np.concatenate([[False], blank[:-1]]))]


def counts(text: str | None, dims: int) -> np.ndarray:
    """Occurrences of each place; of a long text by steps, each n-gram in the step where it starts."""
    x = folded(text)
    total = np.zeros(dims, "int64")
    for k in range(0, len(x), STEP_BYTES):
        part = x[k : k + STEP_BYTES + 2].astype("uint32")
        one, two = part[:STEP_BYTES], part[: STEP_BYTES + 1]
        pairs = two[:-1] * np.uint32(257) + two[1:]
        out = [one, pairs + np.uint32(1 << 16), (part[:-2] * np.uint32(257) + part[1:-1]) * np.uint32(257) + part[2:] + np.uint32(1 << 26)]
        places = np.concatenate(out) * np.uint32(2654435761)
        total += np.bincount((places ^ (places >> np.uint32(15))) % np.uint32(dims), minlength=dims)
    return total


def vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(tf.astype("float32")) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]  # of each centroid
    floors: np.ndarray  # of each centroid and length

    def predict(self, texts: list[str | None], dims: int) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and whether it is rejected."""
        langs, score, bad = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        if not self.langs:
            return langs, score, bad
        across = np.ascontiguousarray(self.centroids.T)
        for i, t in enumerate(texts):
            if not t or not HAS_LETTER(t):
                continue
            tf = counts(t, dims)
            place = np.flatnonzero(tf)
            x = np.log1p(tf[place].astype("float32")) * self.idf[place]
            cos = x @ across[place] / max(float(np.sqrt(x @ x)), 1e-9)
            c = int(cos.argmax())
            langs[i], score[i], bad[i] = self.langs[c], min(1.0, max(0.0, float(cos[c]))), cos[c] < self.floors[c, length(len(place))]
        return langs, score, bad


def length(n: int) -> int:
    return min(max(n, 1).bit_length() - 1, LENGTHS - 1)


def least_cosines(cos: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each length the lowest cosine of texts about as long: of ABOUT at least, the nearest lengths first."""
    out = np.full(LENGTHS, np.nan)
    for b in range(LENGTHS if len(cos) >= ENOUGH else 0):
        away = np.abs(lengths - b)
        reach = np.sort(away)[min(ABOUT, len(away)) - 1]
        out[b] = cos[away <= reach].min()
    return out


def cluster(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: centroids of length one, and each row's."""
    k = min(k, len(x))
    centers = x[[0]]
    while len(centers) < k:  # the row farthest from those taken
        centers = np.vstack([centers, x[[(x @ centers.T).max(1).argmin()]]])
    for _ in range(rounds):
        own = (x @ centers.T).argmax(1)
        sums = np.stack([x[own == c].sum(0) if (own == c).any() else centers[c] for c in range(k)])
        centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return centers, (x @ centers.T).argmax(1)


def fit(tf: list[tuple[np.ndarray, np.ndarray]], langs: list[str], how: Fit = Fit()) -> Model:
    """Fits to texts given by their places and counts."""
    seen, own_rows = np.zeros(how.dims, "int64"), {}
    for i, ((place, _), lang) in enumerate(zip(tf, langs, strict=True)):
        seen[place] += 1
        own_rows.setdefault(lang, []).append(i)
    idf = (np.log((1 + len(tf)) / (1 + seen)) + 1).astype("float32")
    rng = np.random.default_rng(how.seed)
    centroids, names, floors = [], [], []
    for lang in sorted(own_rows):
        dense = np.zeros((len(own_rows[lang]), how.dims), "uint16")
        for row, i in zip(dense, own_rows[lang], strict=True):
            row[tf[i][0]] = np.minimum(tf[i][1], 65535)
        x = vectors(dense, idf)
        apart = np.arange(len(x)) % 4 == 3 if len(x) >= 4 * ENOUGH else np.zeros(len(x), bool)
        centers, _ = cluster(x[~apart], how.clusters, how.rounds, rng)
        lengths = np.array([length(int(n)) for n in (dense[apart] > 0).sum(1)], int)
        cos = x[apart] @ centers.T
        best, own = cos.max(1), cos.argmax(1)
        for c in range(len(centers)):
            centroids.append(centers[c])
            names.append(lang)
            some = own == c if (own == c).sum() >= ENOUGH else np.ones(len(own), bool)
            floors.append(how.floor * least_cosines(best[some], lengths[some]))
    floors = np.array(floors)
    known = ~np.isnan(floors)
    lowest = np.min(np.where(known, floors, np.inf), axis=0, initial=np.inf)
    lowest[~np.isfinite(lowest)] = how.lowest
    return Model(idf, np.array(centroids, "float32").reshape(len(names), how.dims), names, np.where(known, floors, lowest))


@C.shipped
def learn(docs: DataFrame, use, how: Fit = Fit(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fits to rows with a text, a language and an id for which ``use`` (a function of its column) holds."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("id").isNotNull() & (F.col("lang") != UNKNOWN)).where(use(F.col("id")))
    rows = rows.where(F.col("text").isNotNull())
    totals = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row a language
    if not totals:
        return Model(np.ones(how.dims, "float32"), np.zeros((0, how.dims), "float32"), [], np.zeros((0, LENGTHS)))
    each = max(how.few, min(how.per_language, how.rows // len(totals)))
    share = docs.sparkSession.createDataFrame([(r.lang, min(1.0, each / r.n)) for r in totals], "lang string, part double")
    chance = F.pmod(C.row_key("id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.join(F.broadcast(share), "lang").where(chance < F.col("part")).select("id", "lang", "text")

    def step():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            tf = [counts(t, how.dims) for t in C.texts_of(batch)]
            place = [np.flatnonzero(x) for x in tf]
            n = [np.minimum(x[p], 65535) for x, p in zip(tf, place, strict=True)]
            pack = lambda v: pa.array([x.astype("<u2").tobytes() for x in v], pa.binary())
            return pa.RecordBatch.from_arrays([C.column(batch, "id"), C.column(batch, "lang"), pack(place), pack(n)], names=["id", "lang", "place", "n"])

        return one

    found = C.by_slice(chosen, step, "id long, lang string, place binary, n binary").collect()  # Fit.rows, or Fit.few a language, about
    found.sort(key=lambda r: (r.lang, r.id, bytes(r.place), bytes(r.n)))
    found = [r for r in found if len(r.place)]
    if not found:
        return Model(np.ones(how.dims, "float32"), np.zeros((0, how.dims), "float32"), [], np.zeros((0, LENGTHS)))
    return fit([(np.frombuffer(r.place, "<u2"), np.frombuffer(r.n, "<u2")) for r in found], [r.lang for r in found], how)


@C.shipped
def identify(docs: DataFrame, model: Model, how: Fit = Fit(), text_col: str = "text", out: tuple[str, str, str] = ("_lang", "_score", "_rejected")) -> DataFrame:
    """All rows with language, cosine and whether it is rejected, named by ``out``, beside their own columns; one pass,
    no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # Fit.clusters centroids a language at most
    names = docs.columns
    at = names.index(text_col)

    def step():
        m = sent.value

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            lang, score, bad = m.predict(batch.column(at).to_pylist(), how.dims)
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(bad)], names=[*names, *out])

        return one

    schema = T.StructType([*docs.schema.fields, T.StructField(out[0], T.StringType()), T.StructField(out[1], T.DoubleType()), T.StructField(out[2], T.BooleanType())])
    return C.by_slice(docs, step, schema, text_col)


def not_held_out(doc_id: Column) -> Column:
    return ~C.held_out(doc_id)


def op8_language_id(spark, sf_dir):
    docs = C.table(spark, sf_dir, "documents")
    model = learn(docs, not_held_out)
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", C.held_out(F.col("doc_id")).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"), F.col("_rejected").alias("rejected"))

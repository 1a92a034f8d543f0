"""Byte-level BPE encoding and decoding (operator 5).

The tokenizers library is built from a rank file: bytes become characters by the byte table, every pair of tokens whose
join is a token is a merge with the join's rank, and a whole match that is a token needs no merging.  Matches of the
pattern are encoded separately; a bounded memo in each worker keeps the ids of the first matches that it meets, and the
library encodes the others in Arrow batches.

Decoding reverses the byte table, id by id, and joins bytes, so a character that two tokens share comes back whole.
``decode`` of ids that end within a character holds its first bytes back (``Decoder``), or replaces them at the end.

Nulls count as empty text: no ids, hashes of no bytes.  An empty table gives an empty result.  Very long texts are
encoded whole, in memory in proportion to them.  Extra columns are ignored, whatever their names; repeated rows give
repeated results.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import os

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .token_counts import byte_table

#: Matches whose ids a worker remembers, and their characters.
MEMO_WORDS, MEMO_CHARS = 250_000, 64


class Codec:
    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
        chars = byte_table()
        shown = {t: "".join(map(chars.__getitem__, t)) for t in ranks}
        merges = [(shown[t[:i]], shown[t[i:]]) for t in sorted(ranks, key=ranks.get) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        model = models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True, cache_capacity=0)
        self.tokenizer = Tokenizer(model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.whole = Tokenizer(model)
        self.whole.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "removed", invert=True), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.split = regex.compile(pattern).findall
        back = {c: b for b, c in enumerate(chars)}
        self.bytes_of = {i: bytes(back[c] for c in s) for s, i in self.tokenizer.get_vocab().items()}
        self.memo: dict[str, bytes] = {}

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        parts = [self.split(t) for t in texts]
        memo, known = self.memo, {}
        met = set().union(*parts) if parts else set()
        new = [w for w in met if w not in memo]
        for w, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            x = np.asarray(e.ids, "<u4").tobytes()
            if len(memo) < MEMO_WORDS and len(w) <= MEMO_CHARS:
                memo[w] = x
            else:
                known[w] = x
        if known:
            known |= {w: memo[w] for w in met if w in memo}
        get = (known or memo).__getitem__
        return [b"".join(map(get, p)) for p in parts]

    def encode(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids and the characters of the text that each covers; tokens that share a character cover it both."""
        e = self.whole.encode(text, add_special_tokens=False)
        return e.ids, e.offsets

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids) -> str:
        """The text; bytes that are no whole character become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


class Decoder:
    """Decodes ids as they come; holds back the bytes of a character until the last of them is there."""

    def __init__(self, codec: Codec):
        self.codec, self.rest = codec, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids, last: bool = False) -> str:
        return self.rest.decode(self.codec.decode_bytes(ids), last)


def codec(path: str, pattern: str) -> Codec:
    """One for each worker, so that its memo serves all its tasks."""
    return C.kept(__name__, (path, pattern), lambda: Codec(path, pattern))


@C.shipped
def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>; null text gives no ids."""

    def step():
        ids_of = codec(path, pattern).ids

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = ids_of([t or "" for t in C.texts_of(batch)])
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype("int32")
            flat = pa.array(np.frombuffer(b"".join(ids), "<u4").astype("int32"))
            return pa.RecordBatch.from_arrays([C.column(batch, "doc_id"), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["doc_id", "ids"])

        return one

    return C.by_slice(_rows(docs, id_col, text_col), step, "doc_id long, ids array<int>")


@C.shipped
def decode(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """``ids_col`` becomes text; null ids give null, ids that are in no rank file an error."""

    def step(batches):
        c = codec(path, pattern)
        for b in batches:
            for k in range(0, b.num_rows, C.SLICE_ROWS):
                part = b.slice(k, C.SLICE_ROWS)
                text = pa.array([None if x is None else c.decode(x) for x in C.column(part, ids_col).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([text if n == ids_col else C.column(part, n) for n in part.schema.names], names=part.schema.names)

    from pyspark.sql import types as T

    return encoded.mapInArrow(step, T.StructType([T.StructField(f.name, T.StringType()) if f.name == ids_col else f for f in encoded.schema]))


@C.shipped
def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the ids of each text and what they decode to; one pass."""

    def step():
        c = codec(path, pattern)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = c.ids([t or "" for t in C.texts_of(batch)])
            n = pa.array([len(x) // 4 for x in ids], pa.int64())
            digest = [hashlib.sha256(x).hexdigest() for x in ids]
            back = [hashlib.sha256(c.decode_bytes(np.frombuffer(x, "<u4").tolist())).hexdigest() for x in ids]
            return pa.RecordBatch.from_arrays([C.column(batch, "doc_id"), n, pa.array(digest), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return one

    return C.by_slice(_rows(docs, id_col, text_col), step, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def op5_byte_bpe(spark, sf_dir):
    import public_tokenizers

    return round_trip(C.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)

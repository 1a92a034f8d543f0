"""Token counts by overlap resynchronisation (operator 10).

A text of up to ``chunk`` characters is one chunk.  A longer one is encoded as overlapping chunks with offsets; two
neighbours are spliced at a boundary that both show and that is proven stable, so that ids are those of one encoding
of the whole.

Proof.  Pre-tokenisation scans from left to right by a pattern without look-behind and starts afresh where a match
ends, so what follows a boundary does not depend on how the scan came there.  A position p is therefore safe when
(1) both chunks have a pre-token boundary at p, (2) in the left chunk the pre-token before p ended because of a
character inside the chunk (p is left of its end by more than ``EDGE``), (3) no normalisation joins the characters at
p - 1 and p (the character at p is ASCII, or a letter, number or punctuation that never composes with what stands
before it).  Merges stay inside a pre-token, so ids left of p come from the left chunk and ids right of p from the
right one.  If an overlap has no such p, it is doubled, up to the rest of the text.

Inside a chunk without special strings, words between ASCII white space are independent, as the pre-tokenizer drops
white space; their ids are memoised in a bounded table, and the library encodes the words that it lacks.  All this holds
for the normalizer and pre-tokenizer named below, which are compared with the file's; with any others the library
encodes whole texts.

Nulls count as empty text: 0 bytes, 0 tokens, over_limit false.  An empty table gives an empty result.  Repeated rows
give repeated results.  Extra columns are ignored, whatever their names; a null id is kept.
"""

from __future__ import annotations

import gc
import json
import os
import sys
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

CHUNK, OVERLAP, EDGE = 16_384, 256, 32
#: Words whose ids a worker remembers (the first that it meets, so the frequent ones are among them), and their bytes.
MEMO_WORDS, MEMO_BYTES = 250_000, 64
#: Marks at the end of a word: the pre-tokenizer parts them from ASCII letters before them.
MARKS = b".,;:!?"
#: Words that the library encodes in one call.
CALL_WORDS = 256


def byte_table() -> list[str]:
    """The character that stands for each byte: itself where it can be printed, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


SHOWN = dict(enumerate(byte_table()))


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


# The normalizer and pre-tokenizer for which the proofs above and below hold, as the library spells them.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PRE_TOKENIZER = [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def proven(tokenizer) -> bool:
    """Whether the file names the steps that the proofs are about; with any others the library encodes whole texts."""
    parts = json.loads(tokenizer.to_str())
    steps = ((parts["normalizer"] or {}).get("normalizers"), (parts["pre_tokenizer"] or {}).get("pretokenizers"))
    return steps == (NORMALIZER, PRE_TOKENIZER) and parts["model"]["type"] == "BPE" and not parts["model"]["dropout"] and sys.byteorder == "little"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def starts_afresh(c: str) -> bool:
    """Whether normalisation can never join ``c`` to the character before it."""
    return c < "\x80" or (unicodedata.category(c)[0] in "LNPS" and not "ᄀ" <= c <= "ᇿ" and not "ힰ" <= c <= "퟿" and unicodedata.combining(c) == 0)


def boundaries(encoding, begin: int, text: str) -> dict[int, int]:
    """Position in the text -> index of the token that starts a pre-token there."""
    out: dict[int, int] = {}
    last = None
    for i, (word, (start, _)) in enumerate(zip(encoding.word_ids, encoding.offsets, strict=True)):
        if word != last or word is None:
            at = begin + start
            if starts_afresh(text[at]):
                out[at] = i
        last = word
    return out


def resynchronised(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, edge: int = EDGE) -> list[int]:
    """Ids of the whole text, from overlapping chunks."""
    ids: list[int] = []
    begin, end = 0, min(len(text), chunk)
    left = tokenizer.encode(text[:end], add_special_tokens=False)
    first = 0  # of the left chunk's tokens, the first that isn't in ids yet
    while end < len(text):
        lap, splice, known, need = overlap, None, boundaries(left, begin, text), left
        while splice is None:
            # a lap that reaches back past its chunk is taken from the chunk's own start
            start = max(begin + 1, end - lap)
            stop = min(len(text), max(end + chunk, start + chunk))
            right = tokenizer.encode(text[start:stop], add_special_tokens=False)
            marks = boundaries(right, start, text)
            at = [p for p in known if p in marks and start + edge <= p < end - edge and known[p] >= first]
            if at:
                splice = max(at)
            elif start == begin + 1:
                # no common boundary in the whole chunk: the left chunk grows by another chunk
                end = min(len(text), end + max(chunk, end - begin))
                left = need = tokenizer.encode(text[begin:end], add_special_tokens=False)
                known, lap = boundaries(left, begin, text), overlap
                if end == len(text):
                    break
            else:
                lap *= 2
        if splice is None:
            break
        ids += need.ids[first : known[splice]]
        left, begin, end, first = right, start, stop, marks[splice]
    return ids + left.ids[first:]


class Encoder:
    """Ids of texts as one encoding by the library gives them."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.tokenizer, self.chunk, self.overlap = load(path), chunk, overlap
        self.memo: dict[bytes, bytes] = {}
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = [s.encode() for s in special]
        self.proven = proven(self.tokenizer)
        self.merges = self.tokenizer.model

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text.  No cycles are made here, so the collector needn't look at the words."""
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self._ids(texts)
        finally:
            if collecting:
                gc.enable()

    def _ids(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        split: list[tuple[int, list[bytes]]] = []
        whole: list[int] = []
        met: set[bytes] = set()
        for i, t in enumerate(texts):
            if self.proven and len(t) > self.chunk:
                out[i] = np.asarray(resynchronised(self.tokenizer, t, self.chunk, self.overlap), "<u4").tobytes()
                continue
            raw = t.encode()
            if not self.proven or any(s in raw for s in self.special):
                whole.append(i)
                continue
            words = raw.lower().split()  # of bytes: A-Z alone
            split.append((i, words))
            met.update(words)
        if whole:
            for i, e in zip(whole, self.tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False), strict=True):
                out[i] = np.asarray(e.ids, "<u4").tobytes()
        memo, passing = self.memo, []
        new = [w for w in met if w not in memo]
        ends = {}  # words that end in marks are their letters and the marks
        for w in new:
            if (stem := w.rstrip(MARKS)) != w and stem.isalpha():
                ends[w] = stem, w[len(stem) :]
        new = list({p for w in new for p in ends.get(w, (w,)) if p not in memo})
        for w, x in self.encoded(new):
            if len(memo) - len(passing) >= MEMO_WORDS or len(w) > MEMO_BYTES:
                passing.append(w)  # found no place; known for these texts only
            memo[w] = x
        for w, (stem, tail) in ends.items():
            memo[w] = memo[stem] + memo[tail]
        passing += ends
        get = memo.__getitem__
        for i, words in split:
            out[i] = b"".join(map(get, words))
        for w in passing:
            del memo[w]
        return out

    def encoded(self, words: list[bytes]):
        """Words and their ids.  Words of letters that are normal already are one pre-token each and go to the library's
        merges alone; of others the library encodes many in one text, and offsets tell them apart."""
        odd = []
        for w in words:
            t = w.decode()
            if t.isalpha() and t == t.lower() and unicodedata.is_normalized("NFC", t):
                yield w, array("I", [x.id for x in self.merges.tokenize(w.decode("latin-1").translate(SHOWN))]).tobytes()
            else:
                odd.append((w, t))
        for k in range(0, len(odd), CALL_WORDS):
            some = odd[k : k + CALL_WORDS]
            e = self.tokenizer.encode(" ".join([t for _, t in some]), add_special_tokens=False)
            ids = np.asarray(e.ids, "<u4").tobytes()
            ends = np.cumsum([0] + [len(t) + 1 for _, t in some])
            cut = (4 * np.searchsorted([a for a, _ in e.offsets], ends)).tolist()
            for (w, _), a, b in zip(some, cut[:-1], cut[1:], strict=True):
                yield w, ids[a:b]


def encoder(path: str, chunk: int = CHUNK, overlap: int = OVERLAP, owner: str = __name__) -> Encoder:
    """One for each worker, so that its memo serves all its tasks of one operator."""
    return C.kept(owner, (path, chunk, overlap), lambda: Encoder(path, chunk, overlap))


@C.shipped
def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row; one pass, no shuffle."""

    def step():
        ids = encoder(path, chunk, overlap).ids

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in C.texts_of(batch, "text")]
            n = np.array([len(x) // 4 for x in ids(texts)], "int64")
            size = pa.array([len(t.encode()) for t in texts], pa.int64())
            return pa.RecordBatch.from_arrays([C.column(batch, "doc_id"), size, pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

        return one

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return C.by_slice(rows, step, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op10_token_counts(spark, sf_dir):
    return count_tokens(C.table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))

"""Quotation linking (operator 1): conversations in reply order, without the quotes.

Each message is parsed once: its lines' quote levels (``>`` marks, blanks between them allowed), passages (runs of lines
of one level, without the line that introduces them, "... wrote:"), and its own text.  Passages are normalised (lower
case, marks and white space folded, punctuation dropped) and hashed.  A message offers its own text, its paragraphs, its
lines and every run of lines under such hashes.  Of the runs only those are hashed that start with the first line of a
passage and have as many lines as it (blank ones aside), so no message makes all of its runs.  Originals are aggregated
to the earliest message of each hash, in a conversation and over all, before quotes are joined to them.  A quote is linked to the earliest message of its own conversation that offers
it, else, if it has ACROSS_WORDS words or more, to the earliest of all ("Yes." in two conversations says nothing of them),
but only to messages before its own by (conv_id, turn).  A message replies to what its outermost linked passage comes
from (first of equal level), else to the turn before it.

Conversations that quote one another become one, named by the least conv_id.  (conv_id, turn) is an order in which every
message follows what it replies to; ``position`` counts from 0 along it.  A conversation of any size, merged from however
many, is numbered by many tasks: by spans of turns, and sums over ranges of spans.  Everything up to the positions is
worked out on hashes; texts are parsed again at the end and move once.

Null text counts as empty.  Rows with a null conv_id or turn are returned without conversation, position and reply, and
are no originals.  Messages that share conv_id and turn keep an order by a hash of their text; repeated rows are numbered
one by one.  Very long texts are parsed whole.  An empty table gives an empty result.  Extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .graph import components

MARKS = re.compile(r"[ \t]*>(?:[ \t]*>)*")
#: A line that introduces a quote.
INTRODUCES = re.compile(r"^.{0,200}\b(?:wrote|writes|said|schrieb|a écrit|escribió) ?:$", re.I)
FOLD = re.compile(r"[\W_]+")
#: Turns that one task numbers.
SPAN = 4096
#: Words of a passage that may link to another conversation.
ACROSS_WORDS = 4


def normalised(text: str) -> str:
    return FOLD.sub(" ", text.lower()).strip()


def fingerprint(text: str) -> int | None:
    """Signed 64-bit hash of a normalised passage; null if nothing is left of it."""
    text = normalised(text)
    return xxhash.xxh3_64_intdigest(text) - 2**63 if text else None


def parse(text: str) -> tuple[str, list[tuple[int, str]]]:
    """The message's own text, and its quoted passages (level, text) in order."""
    own: list[str] = []
    quotes: list[tuple[int, list[str]]] = []
    inside = False
    for line in text.split("\n"):
        m = MARKS.match(line)
        level, rest = (m[0].count(">"), line[m.end() :].strip()) if m else (0, line)
        if not level:
            own.append(line)
            inside = False
            continue
        if not inside:  # the line before a quote may say whose it is
            k = len(own) - 1
            while k >= 0 and not own[k].strip():
                k -= 1
            if k >= 0 and INTRODUCES.match(own[k].strip()):
                del own[k:]
        if INTRODUCES.match(rest):
            inside = True
            quotes.append((level, []))
            continue
        if not inside or quotes[-1][0] != level or not rest:
            quotes.append((level, []))
        quotes[-1][1].append(rest)
        inside = True
    return re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip("\n"), [(n, "\n".join(filter(None, x))) for n, x in quotes if any(x)]


def offered(own: str) -> list[int]:
    """Hashes under which a message's own text can be quoted: whole, by paragraph, by line."""
    parts = [own, *re.split(r"\n\s*\n", own), *own.split("\n")]
    return sorted({f for p in parts if (f := fingerprint(p)) is not None})


def lines_of(text: str) -> list[str]:
    """Normalised lines of which anything is left."""
    return [x for line in text.split("\n") if (x := normalised(line))]


def runs(own: str, wanted: dict[int, list[int]]) -> set[int]:
    """Hashes of the runs of a message's own lines that start with a wanted line and have a number of lines wanted of it."""
    lines, out = lines_of(own), set()
    for at, line in enumerate(lines):
        lengths = {n for n in wanted.get(fingerprint(line), ()) if n <= len(lines) - at}
        if lengths:
            h = xxhash.xxh3_64(line)
            for n in range(2, max(lengths) + 1):
                h.update(" " + lines[at + n - 1])
                if n in lengths:
                    out.add(h.intdigest() - 2**63)
    return out


def mark(text: str) -> int:
    """Tells apart the texts of messages that share conv_id and turn."""
    return xxhash.xxh3_64_intdigest(text) - 2**63


def offered_runs(messages: DataFrame, offers: DataFrame, quotes: DataFrame) -> DataFrame:
    """(conv_id, turn, hash) of the runs of lines that passages of two lines and more ask for."""
    wanted = quotes.where("lines > 1").groupBy(F.col("lead").alias("hash")).agg(F.collect_set("lines").alias("lengths"))  # lengths, however many quotes
    asked = offers.join(wanted, "hash").groupBy("conv_id", "turn").agg(F.collect_set(F.struct("hash", "lengths")).alias("wanted"))
    held = messages.join(asked, ["conv_id", "turn"])

    def step():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [runs(parse(t or "")[0], {w["hash"]: w["lengths"] for w in ws}) for t, ws in zip(C.texts_of(batch), C.column(batch, "wanted").to_pylist(), strict=True)]
            return pa.RecordBatch.from_arrays([C.column(batch, "conv_id"), C.column(batch, "turn"), pa.array([sorted(f) for f in found], pa.list_(pa.int64()))], names=["conv_id", "turn", "offers"])

        return one

    return C.by_slice(held, step, "conv_id long, turn long, offers array<long>").select("conv_id", "turn", F.explode("offers").alias("hash"))


def parsed(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, mark, offers, quotes) of each message: hashes alone."""

    def step():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in C.texts_of(batch)]
            found = [parse(t) for t in texts]
            offers = pa.array([offered(o) for o, _ in found], pa.list_(pa.int64()))
            split = [[(n, fingerprint(q), lines_of(q)) for n, q in qs] for _, qs in found]
            quotes = [[{"level": n, "hash": f, "lead": fingerprint(x[0]), "lines": len(x), "words": sum(len(y.split()) for y in x)} for n, f, x in qs if f is not None] for qs in split]
            quotes = pa.array(quotes, pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.int64()), ("lead", pa.int64()), ("lines", pa.int32()), ("words", pa.int32())])))
            return pa.RecordBatch.from_arrays([C.column(batch, "conv_id"), C.column(batch, "turn"), pa.array([mark(t) for t in texts], pa.int64()), offers, quotes], names=["conv_id", "turn", "mark", "offers", "quotes"])

        return one

    return C.by_slice(messages, step, "conv_id long, turn long, mark long, offers array<long>, quotes array<struct<level:int,hash:long,lead:long,lines:int,words:int>>")


def own_texts(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, mark, own, n_quotes, max_level) of each message."""

    def step():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in C.texts_of(batch)]
            found = [(o, [n for n, q in qs if fingerprint(q) is not None]) for o, qs in map(parse, texts)]
            cols = [pa.array([mark(t) for t in texts], pa.int64()), pa.array([o for o, _ in found], pa.string()), pa.array([len(n) for _, n in found], pa.int32()), pa.array([max(n, default=0) for _, n in found], pa.int32())]
            return pa.RecordBatch.from_arrays([C.column(batch, "conv_id"), C.column(batch, "turn"), *cols], names=["conv_id", "turn", "mark", "own", "n_quotes", "max_level"])

        return one

    return C.by_slice(messages, step, "conv_id long, turn long, mark long, own string, n_quotes int, max_level int")


def rows_before(spans: DataFrame) -> DataFrame:
    """``spans`` (conversation_id, conv_id, span, n, ...) with the rows of their conversation that come before them.

    Sums run over ranges of all spans in order; what lies before a range is told by a sum a range, and what lies before
    a conversation is the least of its spans' sums.  So no task has all spans of a conversation."""
    order = ["conversation_id", "conv_id", "span"]
    dealt = C.materialise(spans.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "spans")
    sums, before = sorted((r["range"], r.n) for r in dealt.groupBy("range").agg(F.sum("n").alias("n")).collect()), 0  # a row a task
    starts = []
    for k, n in sums:
        starts.append((k, before))
        before += n
    starts = F.broadcast(dealt.sparkSession.createDataFrame(starts, "range int, start long"))  # a row a task
    inside = Window.partitionBy("range").orderBy(*order)
    whole = dealt.withColumn("upto", F.sum("n").over(inside) - F.col("n")).join(starts, "range").withColumn("upto", F.col("upto") + F.col("start")).drop("start", "range")
    first = whole.groupBy("conversation_id").agg(F.min("upto").alias("first"))
    return whole.join(first, "conversation_id").withColumn("before", F.col("upto") - F.col("first")).drop("upto", "first")


@C.shipped
def link(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """conversation_id, position, conv_id, turn, reply_conv, reply_turn, n_quotes, n_linked, max_level, text of each message."""
    messages = df.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(text_col).cast("string").alias("text"))
    whole = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    every = C.materialise(parsed(messages.where(whole)), "messages")
    offers = every.select("conv_id", "turn", F.explode("offers").alias("hash"))
    quotes = every.select("conv_id", "turn", F.posexplode("quotes").alias("at", "q")).select("conv_id", "turn", "at", "q.level", "q.hash", "q.lead", "q.lines", "q.words")
    quotes = C.materialise(quotes, "quotes")
    wanted = quotes.select("hash").distinct()  # offers that nobody quotes aren't aggregated
    offers = offers.unionByName(offered_runs(messages.where(whole), offers, quotes)).join(wanted, "hash", "left_semi")
    here = offers.groupBy("conv_id", "hash").agg(F.min("turn").alias("here"))
    first = here.groupBy("hash").agg(F.min(F.struct("conv_id", "here")).alias("first"))
    # one original a hash, so a passage that everybody quotes joins one row
    found = quotes.join(here, ["conv_id", "hash"], "left").join(first, "hash", "left")
    near = F.when(F.col("here") < F.col("turn"), F.struct("conv_id", F.col("here").alias("turn")))
    far = F.when((F.col("first.conv_id") < F.col("conv_id")) & (F.col("words") >= ACROSS_WORDS), F.struct(F.col("first.conv_id").alias("conv_id"), F.col("first.here").alias("turn")))
    found = found.withColumn("to", F.coalesce(near, far))
    replies = found.groupBy("conv_id", "turn").agg(F.count("to").alias("n_linked"), F.min(F.when(F.col("to").isNotNull(), F.struct("level", "at", "to"))).alias("best"))
    replies = C.materialise(replies.select("conv_id", "turn", "n_linked", F.col("best.to.conv_id").alias("quoted_conv"), F.col("best.to.turn").alias("quoted_turn")), "replies")
    across = replies.where("quoted_conv <> conv_id").select("conv_id", "quoted_conv")
    groups = components(across, "conv_id", "quoted_conv").select(F.col("node").alias("conv_id"), F.col("component").alias("conversation_id"))
    # positions: rows before the span in the conversation, rows before the message in the span
    nodes = every.groupBy("conv_id", "turn", "mark").agg(F.count("*").alias("n")).withColumn("span", F.floor(F.col("turn") / SPAN))
    spans = nodes.groupBy("conv_id", "span").agg(F.sum("n").alias("n"), F.max("turn").alias("last"))
    spans = spans.withColumn("last", F.lag("last").over(Window.partitionBy("conv_id").orderBy("span")))
    spans = spans.join(groups, "conv_id", "left").withColumn("conversation_id", F.coalesce("conversation_id", "conv_id"))
    inside = Window.partitionBy("conv_id", "span").orderBy("turn", "mark")
    earlier = F.max("turn").over(Window.partitionBy("conv_id", "span").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1))
    placed = nodes.withColumn("at", F.sum("n").over(inside) - F.col("n")).withColumn("earlier", earlier).join(rows_before(spans).drop("n"), ["conv_id", "span"])
    placed = placed.join(replies, ["conv_id", "turn"], "left")
    turn = F.coalesce("quoted_turn", "earlier", "last")
    placed = placed.select("conversation_id", (F.col("before") + F.col("at")).alias("position"), "conv_id", "turn", "mark", F.coalesce("quoted_conv", F.when(turn.isNotNull(), F.col("conv_id"))).alias("reply_conv"), turn.alias("reply_turn"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"))
    key = ["conv_id", "turn", "mark"]
    number = F.row_number().over(Window.partitionBy(*key).orderBy("n_quotes")) - 1  # rows of one key are equal
    texts = own_texts(messages)
    out = texts.where(whole).withColumn("number", number).join(C.materialise(placed, "placed").hint("merge"), key)
    out = out.select("conversation_id", (F.col("position") + F.col("number")).alias("position"), "conv_id", "turn", "reply_conv", "reply_turn", "n_quotes", "n_linked", "max_level", F.col("own").alias("text"))
    none = F.lit(None).cast("long")
    apart = texts.where(~whole).select(none.alias("conversation_id"), none.alias("position"), "conv_id", "turn", none.alias("reply_conv"), none.alias("reply_turn"), "n_quotes", F.lit(0).cast("long").alias("n_linked"), "max_level", F.col("own").alias("text"))
    return out.unionByName(apart)


def op1_quotation_linking(spark, sf_dir):
    return link(C.table(spark, sf_dir, "conversations"))

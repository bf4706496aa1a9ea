"""Quotation linking: conversations in reply order, without quotes.

A line's quote level is the number of ``>`` before its text.  Neighbouring lines
of one level are a passage; level 0 is the message's own text.  Passages are
normalised (lower case, single spaces) and hashed: as a whole, by paragraph and
by line.  A quoted passage is linked to the first message that has it as own
text: an earlier turn of its conversation if there is one, else the first message
of any other conversation, if the text has ``FAR_WORDS`` words (fewer stand in many
messages by chance); wholes go before paragraphs and these before lines.

Linked quotes are taken out of the text.  Lines that begin with ``>`` and are no quote
of a message (a prompt, a quote from elsewhere) stay as they are.

A message replies to the message its outermost linked passage comes from, if that
is in its conversation.  Messages of a thread share ``thread_turn``, the turn of
its first message; ordering a conversation by (thread_turn, depth, turn) puts
every message behind the one it answers: ``reply_ordered``.  A message without linked
quotes starts a thread of its own, so conversations without quotes stay in turn order.

Passages are joined by hash to one row per hash (or per conversation and hash), so
a line that stands in a third of all messages makes no pairs; ancestors are found
by pointer doubling.  Defined results: null and empty texts have no passages; a
line ``On ... wrote:`` before a quote counts as part of it; a null conversation is
one of its own; null turns are not linked; repeated rows each get their row;
passages without an original stay unlinked; extra columns pass through, those of
the added names are replaced.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, materialize, ship, unboxed

ship(__name__)

_QUOTE = re.compile(r"^((?:[ \t]{0,3}>)+)[ \t]?(.*)$")
_INTRO = re.compile(r"^\s*on\b.*\bwrote:\s*$", re.I)


#: Words of a text that is looked for in other conversations.
FAR_WORDS = 4


def parse(text: str | None) -> list[tuple[int, list[str], list[str]]]:
    """The passages of a message: quote level, lines, and the lines as they stand."""
    passages: list[tuple[int, list[str], list[str]]] = []
    lines = (text or "").split("\n")
    levels = [(m.group(1).count(">"), m.group(2)) if (m := _QUOTE.match(x)) else (0, x) for x in lines]
    intro: list[str] = []
    for i, (level, line) in enumerate(levels):
        if level == 0 and _INTRO.match(line):
            follows = next((n for n, x in levels[i + 1 :] if n or x.strip()), 0)
            if follows:
                intro.append(line)
                continue
        if intro and not (level or line.strip()):
            intro.append(line)
            continue
        if not passages or passages[-1][0] != level:
            passages.append((level, [], []))
        passages[-1][1].append(line)
        passages[-1][2].extend([*intro, lines[i]])
        intro = []
    return passages


def normalise(lines: list[str]) -> str:
    return " ".join(" ".join(lines).lower().split())


def units(lines: list[str]) -> list[tuple[int, str]]:
    """(rank, normalised text) of a passage: 0 the whole, 1 paragraphs, 2 lines."""
    paragraphs, part = [], []
    for x in [*lines, ""]:
        if x.strip():
            part.append(x)
        elif part:
            paragraphs.append(part)
            part = []
    found = [(0, normalise(lines)), *((1, normalise(p)) for p in paragraphs), *((2, normalise([x])) for x in lines)]
    return [u for u in found if u[1]]


_UNIT = pa.struct([("level", pa.int32()), ("passage", pa.int32()), ("rank", pa.int32()), ("words", pa.int32()), ("text", pa.string())])
_PASSAGE = pa.struct([("level", pa.int32()), ("passage", pa.int32()), ("raw", pa.string())])
_PARSED = ("_id binary, _passages array<struct<level int, passage int, raw string>>, "
           "_units array<struct<level int, passage int, rank int, words int, text string>>")


def _parse_batches(batches):
    for batch in batches:
        whole, found = [], []
        for x in batch.column("_text"):
            passages = parse(x.as_py())
            own = [lines for level, lines, _ in passages if level == 0]
            rows = [(0, -1, 0, normalise([y for lines in own for y in lines]))] if len(own) > 1 else []
            for k, (level, lines, _) in enumerate(passages):
                rows += [(level, k, rank, text) for rank, text in units(lines)]
            whole.append([{"level": level, "passage": k, "raw": "\n".join(raw)} for k, (level, _, raw) in enumerate(passages)] if x.is_valid else None)
            found.append([{"level": n, "passage": k, "rank": r, "words": t.count(" ") + 1, "text": t} for n, k, r, t in dict.fromkeys(rows) if t])
        yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(whole, pa.list_(_PASSAGE)), pa.array(found, pa.list_(_UNIT))],
                                         names=["_id", "_passages", "_units"])


def link_quotes(messages: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """The messages with ``text`` without quotes, and n_quotes, n_linked, links, parent_turn, thread_turn and depth.

    ``links`` lists level, conversation and turn of the originals of a message.
    """
    c, t = F.col(conversation), F.col(turn)
    identity = F.unhex(F.md5(F.to_json(F.struct(c.cast("string").alias("c"), t.cast("string").alias("t"), F.col(text).alias("x")))))
    rows = boxed(messages, _id=identity, _text=F.col(text), _c=c, _t=t.cast("long"))
    parsed = rows.select("_id", "_text").mapInArrow(_parse_batches, _PARSED)
    parsed = materialize(parsed.dropDuplicates(["_id"]), "messages")
    named = rows.select("_id", "_c", "_t").distinct()
    all_units = (parsed.select("_id", F.explode("_units").alias("u")).join(named, "_id")
                 .select("_id", "_c", "_t", "u.level", "u.passage", "u.rank", "u.words", F.unhex(F.md5("u.text")).alias("_h")))
    own = all_units.where("level = 0 AND _t IS NOT NULL")
    inside = own.groupBy("_c", "_h").agg(F.min("_t").alias("_first")).withColumnsRenamed({"_c": "_ic", "_h": "_ih"})
    # One row a hash: the least original, and the least one of all other conversations for quotes in that of the first.
    firsts = materialize(own.groupBy("_h", "_c").agg(F.min("_t").alias("_t")), "originals")
    least = firsts.groupBy("_h").agg(F.min(F.struct("_c", "_t")).alias("_any"))
    seconds = firsts.join(least, "_h").where(~F.col("_any._c").eqNullSafe(F.col("_c"))).groupBy("_h").agg(F.min(F.struct("_c", "_t")).alias("_next"))
    anywhere = least.join(seconds, "_h", "left")
    quoted = materialize(all_units.where("level > 0"), "quotes")
    looked = (quoted.join(inside, F.col("_c").eqNullSafe(F.col("_ic")) & (F.col("_h") == F.col("_ih")) & (F.col("_first") < F.col("_t")), "left")
              .join(anywhere, "_h", "left"))
    same = F.col("_first").isNotNull()
    other = F.when(~F.col("_any._c").eqNullSafe(F.col("_c")), F.col("_any")).otherwise(F.col("_next"))
    link = F.when(same, F.struct("_c", F.col("_first").alias("_t"))).when(F.col("_any").isNotNull() & (F.col("words") >= FAR_WORDS), other)
    # The best unit of a passage decides: in the conversation first, then the larger unit.
    best = (looked.withColumn("_link", link).where(F.col("_link").isNotNull())
            .groupBy("_id", "level", "passage").agg(F.min(F.struct((~same).alias("far"), "rank", "_link")).alias("b")))
    per_message = best.groupBy("_id").agg(
        F.count("*").alias("n_linked"),
        F.array_sort(F.collect_list(F.struct("level", "passage", F.col("b._link._c").alias(conversation), F.col("b._link._t").alias(turn)))).alias("links"),
        F.min(F.when(~F.col("b.far"), F.struct("level", "passage", F.col("b._link._t").alias("t")))).alias("_p"))
    linked = materialize(per_message.withColumn("parent_turn", F.col("_p.t")).drop("_p"), "links")
    quotes = F.size(F.array_distinct(F.transform(F.filter("_units", lambda u: u["level"] > 0), lambda u: u["passage"])))
    taken = F.coalesce(F.transform("links", lambda x: x["passage"]), F.array().cast("array<int>"))
    stays = F.filter("_passages", lambda p: (p["level"] == 0) | ~F.array_contains(taken, p["passage"]))
    body = F.regexp_replace(F.array_join(F.transform(stays, lambda p: p["raw"]), "\n"), r"\A\n+|\n+\z", "")
    threads = _threads(linked.join(named, "_id").where("parent_turn IS NOT NULL")
                       .groupBy("_c", "_t").agg(F.min("parent_turn").alias("_up")))
    bodies = parsed.select("_id", "_passages", quotes.cast("long").alias("n_quotes"))
    out = rows.join(bodies, "_id").join(linked, "_id", "left").join(
        threads.withColumnsRenamed({"_c": "_tc", "_t": "_tt"}), F.col("_c").eqNullSafe(F.col("_tc")) & (F.col("_t") == F.col("_tt")), "left")
    zero = lambda x: F.coalesce(F.col(x), F.lit(0)).cast("long")
    return unboxed(out, messages.columns, **{
        text: body, "n_quotes": F.col("n_quotes"), "n_linked": zero("n_linked"), "links": F.col("links"),
        "parent_turn": F.col("parent_turn"), "thread_turn": F.coalesce("_root", "_t"), "depth": zero("_depth")})


def _threads(parents: DataFrame) -> DataFrame:
    """(_c, _t, _root, _depth) of the messages with a parent, by pointer doubling."""
    now = materialize(parents.select("_c", "_t", F.col("_up").alias("_root"), F.lit(1).cast("long").alias("_depth")), "threads")
    while True:
        up = now.select(F.col("_c").alias("_uc"), F.col("_t").alias("_ut"), F.col("_root").alias("_ur"), F.col("_depth").alias("_ud"))
        step = now.join(up, F.col("_c").eqNullSafe(F.col("_uc")) & (F.col("_root") == F.col("_ut")), "left")
        moved = materialize(step.select("_c", "_t", F.coalesce("_ur", "_root").alias("_root"),
                                        (F.col("_depth") + F.coalesce("_ud", F.lit(0))).alias("_depth"), F.col("_ur").isNotNull().alias("_moved")), "threads")
        if moved.where("_moved").isEmpty():
            return moved.drop("_moved")
        now = moved.drop("_moved")


def reply_ordered(linked: DataFrame, *, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Range-partition and sort linked messages, so that files hold conversations in reply order."""
    order = (conversation, "thread_turn", "depth", turn)
    # Written, for ranges are drawn from a first look at the rows.
    linked = materialize(linked, "linked")
    return linked.repartitionByRange(*order).sortWithinPartitions(*order)

"""Quotation linking: reply-ordered conversations without quotes.

The lines of a message carry quote levels (leading ``>`` signs).  Lines of level 0, without the
line that introduces a quote, are the message's own text; runs of quoted lines of one level are
quoted passages.  Own texts and quoted passages are normalised and hashed: the whole, its
paragraphs and its lines.  A quoted passage is joined by conversation and hash to the first
message with that own text; a message replies to the message whose text its outermost quote
holds, and where nothing it quotes is found, to the message before it.

Each hash of a conversation is reduced to its first message before the join, so that a text
repeated over and over meets a quote once.  The message before and the places in a conversation
come from one range-partitioned sort by conversation and turn: a long conversation spans
partitions, and what a partition needs of those before it is one row each.

Defined cases: a null text is empty; a null conversation is a conversation of its own, a null
turn sorts first; messages that share a turn are ordered by their text; only earlier turns are
quoted from; quotes of nothing known are removed and counted, not linked; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import re

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sequence import with_sequence
from .common import map_rows, saved

LEVEL = re.compile(r"[ \t]*((?:>[ \t]?)+)")
INTRODUCTION = re.compile(r"^\s*(?:on\b.{0,300}\bwrote|am\b.{0,300}\bschrieb.{0,100}|le\b.{0,300}\ba écrit|el\b.{0,300}\bescribió"
                          r"|.{1,200}\b(?:wrote|writes|said)|-+\s*original message\s*-+)\s*:?\s*$", re.I)
LEAST_CHARS = 8          # a line of fewer normalised characters is no evidence by itself
_NOISE = re.compile(r"[\W_]+")


def levels(text: str | None) -> list[tuple[int, str]]:
    """(quote level, line without its marks) of every line."""
    out = []
    for line in (text or "").split("\n"):
        m = LEVEL.match(line)
        out.append((m[1].count(">"), line[m.end():]) if m else (0, line))
    return out


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """The message's own text, and its quoted passages with their levels in order."""
    lines = levels(text)
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    last = 0
    for k, (level, line) in enumerate(lines):
        if level == 0:
            later = next((n for n, s in lines[k + 1:k + 3] if n > 0 or s.strip()), 0)
            if not (later > 0 and INTRODUCTION.match(line)):
                own.append(line)
        elif level == last and passages:
            passages[-1][1].append(line)
        else:
            passages.append((level, [line]))
        last = level
    for level, body in passages:                # a quoted introduction belongs to the deeper quote
        while body and (not body[-1].strip() or INTRODUCTION.match(body[-1])):
            body.pop()
    return re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip(), [(n, "\n".join(b)) for n, b in passages if "\n".join(b).strip()]


def units(text: str) -> list[int]:
    """Hashes of the normalised whole, its paragraphs and its lines, the largest first."""
    parts = [text, *re.split(r"\n\s*\n", text), *text.split("\n")]
    out: dict[int, None] = {}
    for i, p in enumerate(parts):
        p = _NOISE.sub(" ", p.lower()).strip()
        if p and (i == 0 or len(p) >= LEAST_CHARS):
            out[xxhash.xxh64_intdigest(p.encode("utf-8", "surrogatepass")) - (1 << 63)] = None
    return list(out)


def conversations(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, position (from 0; a reply comes after what it
    replies to), reply_to (a turn; null at the start), by_quote, n_quotes, n_linked and text,
    the message without quotes."""
    order = ["conv_id", "turn", F.xxhash64("text", "role")]
    placed = with_sequence(messages.select("conv_id", "turn", "role", "text"), order, "seq")

    def read():
        def run(rows):
            for seq, conv, turn, role, text in rows:
                own, passages = parse(text)
                yield (seq, conv, turn, role, own, units(own), [{"level": n, "hashes": units(b)} for n, b in passages])
        return run
    parsed = saved(map_rows(placed.select("seq", "conv_id", "turn", "role", "text"),
                            "seq bigint, conv_id bigint, turn bigint, role string, text string, hashes array<bigint>, "
                            "quotes array<struct<level:int,hashes:array<bigint>>>", read), "quotes-parsed")

    sources = (parsed.select("conv_id", F.explode("hashes").alias("hash"), F.struct("seq", "turn").alias("m"))
               .groupBy("conv_id", "hash").agg(F.min("m").alias("source"))
               .select(F.col("conv_id").alias("of_conv"), "hash", "source"))
    asked = (parsed.where(F.size("quotes") > 0).select("seq", "conv_id", "turn", F.posexplode("quotes").alias("place", "quote"))
             .select("seq", "conv_id", "turn", "place", "quote.level", F.posexplode("quote.hashes").alias("rank", "hash")))
    links = (asked.join(sources, (asked["hash"] == sources["hash"]) & asked["conv_id"].eqNullSafe(sources["of_conv"]))
             .where("source.turn < turn or (source.turn is null and turn is not null)")
             .groupBy("seq").agg(F.min(F.struct("level", "rank", "place", F.col("source.turn").alias("turn"))).alias("best"),
                                 F.count_distinct("place").alias("n_linked"))
             .select("seq", F.col("best.turn").alias("quoted"), "n_linked"))
    before = parsed.select((F.col("seq") + 1).alias("seq"), F.col("conv_id").alias("before_conv"), F.col("turn").alias("before"))
    starts = parsed.groupBy("conv_id").agg(F.min("seq").alias("start")).withColumnRenamed("conv_id", "of_conv")
    joined = parsed.drop("hashes").join(links, "seq", "left").join(before, "seq", "left")
    joined = joined.join(starts, joined["conv_id"].eqNullSafe(starts["of_conv"]))
    by_quote = F.col("n_linked").isNotNull()
    return joined.select(
        "conv_id", "turn", "role", (F.col("seq") - F.col("start")).alias("position"),
        F.when(by_quote, F.col("quoted")).when(F.col("seq") > F.col("start"), F.col("before")).alias("reply_to"),
        by_quote.alias("by_quote"), F.size("quotes").cast("bigint").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"), "text")

"""Quotation linking: find the message that a quote comes from, and order conversations by reply without the quotes.

Quote levels are the ``>`` at the start of a line. Quoted lines, and everything quoted on one level as a whole (so that
re-wrapped quotes match too), are normalised and hashed; so are the lines and the whole own text of every message. A
quote comes from the first earlier message of its conversation that wrote the same words itself: originals are reduced to
one row per conversation and passage before the join, so a passage that many messages repeat multiplies nothing. A
message replies to the one that wrote most characters of its first quote level. Paths of replies are built by doubling:
each round joins a path to the path of its head.

The result has one row per message and no collected group: ``path`` holds the turns from the first message of the reply
chain to this one, and sorting by (conv_id, path) gives the reply order.

Defined results: a null text has null text and no quotes; a message without a linked quote starts at its own turn; rows
with a null conversation or turn link with nothing and have a null path; rows with one conversation and turn are one
place in the order and are all returned; lines without a letter or digit quote nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

MARKS = r"^((?:[ \t]*>)+)[ \t]?"
ATTRIBUTION = r"(?i)^.*\b(wrote|writes|said|schrieb|escribió|a écrit)\s*:\s*$"


def normal(text: Column) -> Column:
    """Letters and digits in lower case, all else as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def with_lines(messages: DataFrame, text: str) -> DataFrame:
    """Adds ``__lines`` (level and body of each line; an attribution before a quote has level -1)."""
    marks = lambda line: F.regexp_extract(line, MARKS, 1)
    split = messages.withColumn("__split", F.transform(F.split(F.col(text), "\n", -1), lambda line: F.struct(
        F.length(F.regexp_replace(marks(line), "[^>]", "")).alias("level"), F.regexp_replace(line, MARKS, "").alias("body"))))
    following = F.concat(F.slice("__split", 2, F.greatest(F.size("__split") - 1, F.lit(0))), F.array(F.struct(F.lit(0).alias("level"), F.lit("").alias("body"))))
    return split.withColumn("__lines", F.zip_with("__split", following, lambda line, after: F.struct(
        F.when((line["level"] == 0) & (after["level"] > 0) & line["body"].rlike(ATTRIBUTION), -1).otherwise(line["level"]).alias("level"),
        line["body"].alias("body")))).drop("__split")


def _body_of(level: Column | int) -> Column:
    return F.array_join(F.transform(F.filter("__lines", lambda x: x["level"] == level), lambda x: x["body"]), "\n")


def _passages(lines: DataFrame, own: bool) -> DataFrame:
    """conv_id, turn, level, words: the lines, and the whole, of own text (level 0) or of every quote level."""
    wanted = (lambda x: x["level"] == 0) if own else (lambda x: x["level"] > 0)
    single = F.transform(F.filter("__lines", wanted), lambda x: F.struct(x["level"].alias("level"), x["body"].alias("body"), F.lit(False).alias("whole")))
    levels = F.array_distinct(F.transform(F.filter("__lines", wanted), lambda x: x["level"]))
    whole = F.transform(levels, lambda level: F.struct(level.alias("level"), _body_of(level).alias("body"), F.lit(True).alias("whole")))
    rows = lines.select("conv_id", "turn", F.explode(F.concat(single, whole)).alias("p"))
    words = rows.select("conv_id", "turn", "p.level", "p.whole", normal(F.col("p.body")).alias("words")).where("words <> ''")
    return words.withColumn("hash", F.xxhash64("words", "whole"))


def link_quotes(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level, origin: the turn that wrote most of what a message quotes on a level."""
    lines = with_lines(messages, "text").where("conv_id IS NOT NULL AND turn IS NOT NULL")
    originals = _passages(lines, own=True).groupBy("conv_id", "hash", "words").agg(F.min("turn").alias("origin"))
    quotes = _passages(lines.where(F.exists("__lines", lambda x: x["level"] > 0)), own=False).distinct()
    votes = (quotes.join(originals, ["conv_id", "hash", "words"]).where("origin < turn")
             .groupBy("conv_id", "turn", "level", "origin").agg(F.sum(F.length("words")).alias("weight")))
    return votes.groupBy("conv_id", "turn", "level").agg(F.max(F.struct("weight", "origin")).alias("best")).select(
        "conv_id", "turn", "level", F.col("best.origin").alias("origin"))


def reply_paths(links: DataFrame) -> DataFrame:
    """conv_id, turn, path for every linked reply (conv_id, turn, origin); origins are earlier turns, so there is no circle."""
    paths = cut_lineage(links.select("conv_id", "turn", F.col("origin").alias("head"), F.array("origin", "turn").alias("path")))
    while True:
        heads = paths.select("conv_id", F.col("turn").alias("head"), F.col("path").alias("before"))
        longer = cut_lineage(paths.join(heads, ["conv_id", "head"], "left").select(
            "conv_id", "turn", F.coalesce(F.element_at("before", 1), "head").alias("head"),
            F.when(F.col("before").isNull(), F.col("path")).otherwise(F.concat("before", F.slice("path", 2, F.size("path") - 1))).alias("path"),
            F.col("before").isNotNull().alias("grew")))
        if longer.where("grew").isEmpty():
            return longer.select("conv_id", "turn", "path")
        paths = longer.drop("grew")


def thread_messages(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per message: conv_id, turn, role, text without quotes, n_quote_lines, n_levels, reply_to_turn, path, message (JSON of role and content)."""
    messages = conversations.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    links = cut_lineage(link_quotes(messages).where("level = 1").select("conv_id", "turn", "origin"))
    paths = reply_paths(links)
    lines = with_lines(messages, "text")
    quoted = F.size(F.filter("__lines", lambda x: x["level"] > 0))
    levels = F.coalesce(F.array_max(F.transform("__lines", lambda x: x["level"])), F.lit(0))
    clean = lines.select(
        "conv_id", "turn", "role",
        # only what surrounds a removed quote is trimmed
        F.when(F.exists("__lines", lambda x: x["level"] != 0), F.regexp_replace(F.regexp_replace(_body_of(0), r"\n{3,}", "\n\n"), r"^\s+|\s+$", ""))
        .otherwise(F.col("text")).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(quoted).cast("long").alias("n_quote_lines"),
        F.greatest(levels, F.lit(0)).cast("long").alias("n_levels"))
    alone = F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), F.array("turn"))
    return clean.join(paths, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "text", "n_quote_lines", "n_levels",
        F.when(F.size("path") > 1, F.element_at("path", F.greatest(F.size("path") - 1, F.lit(1)))).alias("reply_to_turn"),
        F.coalesce("path", alone).alias("path"), F.to_json(F.struct("role", F.col("text").alias("content"))).alias("message"))

"""Quotation linking in conversations.

Lines that start with `>` marks are quotes; the number of marks is their level. Successive lines of a
level form a passage. Passages and the unquoted lines of every message are normalised (lower case,
blanks collapsed, attribution lines and blank lines left out) and hashed line by line and as a whole;
a quoted passage links to the first earlier message of the conversation that has it as its unquoted
text, as a paragraph or as a line, the shallowest quote of a message deciding what it replies to. Where no
whole passage is found, its paragraphs and lines link it to the message that most of them belong to. Threads follow these links;
in the result a conversation is ordered by threads, each reply after what it answers, and texts are
without quotes and attributions.

Only DataFrame functions are used. Passages join originals on conversation and hash, so neither a long
conversation nor a common first turn meets in one task; of equal originals only the first is kept
before the join. Threads are found by pointer doubling over linked messages only.

Edge cases: a null text is empty and links to nothing; a null turn counts as 0, a null conv_id as a
conversation of its own; rows with equal conv_id and turn share their links; a passage without an
original stays unlinked (its message starts a thread); an empty table gives an empty result; other
columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fellwalk.operators.fixpoint import cut

MARKS = r"^[ \t]{0,3}(?:>[ \t]?)+"
ATTRIBUTION = r"(?i)^[ \t]*(?:on\b.{1,200}\bwrote:|.{1,100}\b(?:schrieb|a écrit|escribió)\b.{0,100}:|-{2,} ?original message ?-{2,})[ \t]*$"
#: Shorter passages and parts, in normalised characters, link only if one message of the conversation has them.
LEAST = 8


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def lines(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, pos, level, line) of every line; level counts the quote marks."""
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("conv_id", "turn", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "raw"))
    marks = F.regexp_extract("raw", MARKS, 0)
    return rows.select("conv_id", "turn", "pos", (F.length(marks) - F.length(F.regexp_replace(marks, ">", ""))).alias("level"), F.expr("substr(raw, length(regexp_extract(raw, r'" + MARKS + "', 0)) + 1)").alias("line"))


def passages(text: Column) -> Column:
    """Passages of a text, as array<struct<level, body, parts>>: maximal runs of lines of one level, normalised, with their paragraphs and lines.

    Lines that only introduce a quote are left out, at any level; blank lines end a paragraph, but no passage.
    """
    raw = F.filter(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: ~F.regexp_replace(x, MARKS, "").rlike(ATTRIBUTION))
    cut_line = lambda x: F.struct(
        (F.length(F.regexp_extract(x, MARKS, 0)) - F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), ">", ""))).alias("level"),
        normal(F.regexp_replace(x, MARKS, "")).alias("body"))
    kind = "array<struct<level:int,body:string>>"
    last = lambda acc: F.element_at(acc, -1)
    more = lambda acc, x: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["level"].alias("level"), F.concat(last(acc)["body"], F.lit("\n"), x["body"]).alias("body"))))
    add = lambda acc, x: (F.when((F.size(acc) > 0) & ((x["body"] == "") | (last(acc)["level"] == x["level"])), more(acc, x))
                          .when(x["body"] == "", acc).otherwise(F.concat(acc, F.array(x))))
    return F.transform(F.aggregate(F.transform(raw, cut_line), F.array().cast(kind), add), lambda p: F.struct(
        p["level"].alias("level"), normal(p["body"]).alias("body"),
        F.filter(F.array_distinct(F.transform(F.concat(F.split(p["body"], r"\n\n+"), F.split(p["body"], "\n")), normal)), lambda x: x != "").alias("parts")))


def clean(text: Column) -> Column:
    """The text without quoted lines and attributions; ends trimmed."""
    kept = F.filter(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: ~x.rlike(MARKS) & ~x.rlike(ATTRIBUTION))
    return F.trim(F.array_join(kept, "\n"))


def quoting(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike("(?m)" + MARKS)


def own_parts(text: Column) -> Column:
    """Hashes of a message's unquoted text: as a whole, by paragraph and by line, with the level-0 passages between quotes."""
    body = clean(text)
    pieces = F.concat(F.array(body), F.split(body, r"\n\s*\n"), F.split(body, "\n"), F.transform(F.filter(passages(text), lambda p: p["level"] == 0), lambda p: p["body"]))
    return F.array_distinct(F.transform(F.filter(F.transform(pieces, normal), lambda x: x != ""), lambda x: F.xxhash64(x)))


def links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, target): for each message that quotes, the original it replies to.

    Its shallowest linked level decides; there a whole passage goes before paragraphs and lines. Of whole
    passages the latest original counts; of parts the message that most parts belong to alone, then most
    parts, then the latest.
    """
    rows = messages.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(-(1 << 63))).alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), F.col("text").cast("string").alias("text"))
    piece = lambda x, part: F.struct(F.lit(part).alias("part"), (F.length(x) < LEAST).alias("short"), F.xxhash64(x).alias("h"))
    quoted = (rows.where(quoting(F.col("text"))).select("conv_id", "turn", F.explode(passages(F.col("text"))).alias("p")).where("p.level > 0")
              .select("conv_id", "turn", F.col("p.level").alias("level"), F.explode(F.concat(F.array(piece(F.col("p.body"), 0)), F.transform("p.parts", lambda x: piece(x, 1)))).alias("q"))
              .select("conv_id", "turn", "level", "q.*").distinct())
    # only conversations that quote have to be taken apart
    asking = quoted.select("conv_id").distinct()
    originals = (rows.join(asking, "conv_id", "left_semi").select("conv_id", F.col("turn").alias("target"), F.explode(own_parts(F.col("text"))).alias("h"))
                 .groupBy("conv_id", "h").agg(F.min("target").alias("target"), (F.min("target") == F.max("target")).alias("alone")))
    hits = quoted.join(originals, ["conv_id", "h"]).where("target < turn AND (alone OR NOT short)")
    votes = hits.groupBy("conv_id", "turn", "level", "part", "target").agg((-F.sum(F.col("part") * F.col("alone").cast("int"))).alias("sole"), (-F.sum("part")).alias("all"))
    best = votes.groupBy("conv_id", "turn").agg(F.min(F.struct("level", "part", "sole", "all", (-F.col("target")).alias("back"))).alias("s"))
    return best.select("conv_id", "turn", F.col("s.level").alias("level"), (-F.col("s.back")).alias("target"))


def threads(found: DataFrame) -> DataFrame:
    """(conv_id, turn, target, thread, depth): the message at the end of the chain of links, and its distance."""
    state = cut(found.select("conv_id", "turn", "target", F.col("target").alias("thread"), F.lit(1).cast("long").alias("depth")))
    while True:
        ahead = state.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("far"), F.col("depth").alias("more"))
        new = cut(state.join(ahead, ["conv_id", "thread"], "left").select(
            "conv_id", "turn", "target", F.coalesce("far", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("far").isNotNull().alias("moved")))
        state = new.drop("moved")
        if new.where("moved").isEmpty():
            return state


def linked(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, reply_to, thread, depth, n_quoted (quoted passages), text: messages without quotes.

    Within a conversation the order (thread, turn) puts each thread together, each reply after what it answers.
    """
    tree = threads(links(messages)).withColumnRenamed("turn", "_t").withColumnRenamed("conv_id", "_c")
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("_raw"))
    on = (F.coalesce("conv_id", F.lit(-(1 << 63))) == F.col("_c")) & (F.coalesce("turn", F.lit(0)) == F.col("_t"))
    text = F.col("_raw")
    return rows.join(tree, on, "left").select(
        "conv_id", "turn", "role", F.col("target").alias("reply_to"), F.coalesce("thread", "turn", F.lit(0)).alias("thread"), F.coalesce("depth", F.lit(0)).alias("depth"),
        F.when(quoting(text), F.size(F.filter(passages(text), lambda p: p["level"] > 0))).otherwise(0).cast("long").alias("n_quoted"),
        F.when(quoting(text) | F.coalesce(text, F.lit("")).rlike("(?m)" + ATTRIBUTION), clean(text)).otherwise(F.trim(F.coalesce(text, F.lit("")))).alias("text"))


def conversations(messages: DataFrame) -> DataFrame:
    """`linked` with `position`, the place in the reply order.

    Positions are counted in two steps (turns of a thread, then threads), so a long conversation is not sorted as one group of texts.
    """
    rows = linked(messages)
    keys = rows.groupBy("conv_id", "thread").agg(F.count("*").alias("n"))
    before = keys.withColumn("before", F.sum("n").over(Window.partitionBy("conv_id").orderBy("thread")) - F.col("n")).select(F.col("conv_id").alias("_c"), F.col("thread").alias("_th"), "before")
    out = rows.join(before, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("thread") == F.col("_th")))
    w = Window.partitionBy("conv_id", "thread").orderBy("turn", "role", "text")
    return out.withColumn("position", (F.col("before") + F.row_number().over(w) - 1).cast("long")).drop("_c", "_th", "before")

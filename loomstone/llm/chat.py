"""Chat formatting with budgeted windows, in DataFrame functions alone.

A turn is written as [role] text</s>. Inside roles and texts the characters \\, [, ] and < are written as \\b, \\s, \\e and \\a, so none of the
template's marks can occur there, and the text is read back exactly. A conversation becomes windows of about `budget` tokens: prefix sums of the turns'
tokens cut it into cells, each cell's turns are one window, and a turn that is longer than a cell stands alone in one.
Every window begins with the system turn, if the conversation begins with one, then repeats turns before its own, as many as
`history` tokens hold; repeats are marked <r> and never under the loss mask. The mask covers each assistant text once, in the window that has it as its own.

Tokens are counted as words and punctuation marks. Budget: system turns, history and twice the cell fit it unless one turn alone doesn't.

Defined results: null texts and roles are empty; a null turn is before all others; turns of equal number are ordered by role and text; repeated rows are repeated
turns; a null conv_id is one conversation; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters that the template uses and how they are written inside texts (fixed values of the template).
CODES = (("\\", "\\b"), ("[", "\\s"), ("]", "\\e"), ("<", "\\a"))


def escaped(text: Column) -> Column:
    for char, code in CODES:
        text = F.replace(text, F.lit(char), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for char, code in reversed(CODES):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]")).cast("long")


def format_conversations(turns: DataFrame, budget: int = 1024, history: int = 128) -> DataFrame:
    """Windows of conversations (conv_id, turn, role, text): conv_id, window (from 0), formatted, tokens, loss (spans of characters in formatted).

    A window's loss spans are half-open, in order.
    """
    rows = turns.select(
        turns["conv_id"].alias("conv_id"), turns["turn"].alias("turn"), F.coalesce(turns["role"].cast("string"), F.lit("")).alias("role"), F.coalesce(turns["text"].cast("string"), F.lit("")).alias("text")
    )
    rows = rows.withColumn("head", F.concat(F.lit("["), escaped(F.col("role")), F.lit("] "))).withColumn("body", escaped(F.col("text"))).withColumn("tokens", token_count("text") + 4)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("place", F.row_number().over(order).cast("long"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    first = F.when((F.col("place") == 1) & (F.col("role") == "system"), F.struct("head", "body", "tokens"))
    rows = rows.withColumn("system", F.first(first).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # A cell is half of what system turn and history leave; a turn that crosses the next cell's beginning still fits, or stands alone.
    cell = F.greatest(F.lit(16), F.floor((F.lit(budget - history) - F.coalesce("system.tokens", F.lit(0))) / 2))
    rows = rows.withColumn("cell", F.floor(F.col("start") / cell)).withColumn("alone", F.col("tokens") > cell)
    change = F.when((F.lag("cell").over(order) == F.col("cell")) & (F.lag("alone").over(order) == F.col("alone")) & ~F.col("alone"), 0).otherwise(1)
    rows = rows.withColumn("window", (F.sum(change).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("long"))
    # Where a window's own turns begin, in tokens; turns shortly before are its history.
    begin = F.min("start").over(Window.partitionBy("conv_id", "window"))
    rows = rows.withColumn("begin", begin)
    own = rows.select("conv_id", "window", "place", F.lit(False).alias("repeat"), "role", "head", "body", "tokens")
    marks = rows.filter(F.col("start") == F.col("begin")).groupBy("conv_id", "window").agg(F.min("begin").alias("begin"), F.min("place").alias("at"), F.first("system").alias("system"))
    # A turn is history of the windows that begin within `history` tokens after its start, so it is copied only as often as that.
    span = Window.partitionBy("conv_id").orderBy("start").rangeBetween(1, history)
    ahead = F.array_distinct(F.filter(F.collect_list(F.struct("window", "begin")).over(span), lambda w: (w["window"] > F.col("window")) & (w["begin"] - F.col("start") <= history)))
    past = rows.withColumn("ahead", F.when((F.col("tokens") <= history) & ~((F.col("place") == 1) & (F.col("role") == "system")), ahead))
    past = past.select("conv_id", F.explode("ahead").alias("in"), "place", "role", "head", "body", "tokens").select("conv_id", F.col("in.window").alias("window"), "place", F.lit(True).alias("repeat"), "role", "head", "body", "tokens")
    lead = marks.filter("system is not null and at > 1").select("conv_id", "window", F.lit(0).cast("long").alias("place"), F.lit(True).alias("repeat"), F.lit("system").alias("role"), "system.head", "system.body", "system.tokens")
    blocks = own.unionByName(past).unionByName(lead)
    blocks = blocks.withColumn("mark", F.when(F.col("repeat"), "<r>").otherwise("")).withColumn("block", F.concat("mark", "head", "body", F.lit("</s>")))
    inside = Window.partitionBy("conv_id", "window").orderBy("place", F.col("repeat").desc())
    blocks = blocks.withColumn("until", F.sum(F.length("block")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.col("until") - F.length("body") - 4
    loss = F.when(~F.col("repeat") & (F.col("role") == "assistant"), F.struct(at.alias("start"), (F.col("until") - 4).alias("end")))
    piece = F.struct("place", F.col("repeat").cast("int").alias("own"), "block", loss.alias("loss"))
    windows = blocks.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(piece)).alias("pieces"), F.sum("tokens").alias("tokens"))
    return windows.select(
        "conv_id", "window", F.array_join(F.transform("pieces", lambda p: p["block"]), "").alias("formatted"), "tokens", F.filter(F.transform("pieces", lambda p: p["loss"]), lambda x: x.isNotNull()).alias("loss")
    )


def read_back(windows: DataFrame) -> DataFrame:
    """What formatted windows say: conv_id, turns (role and text, each once, in order), masked (texts under the loss mask), characters."""
    blocks = F.filter(F.split("formatted", "</s>"), lambda b: (b != "") & ~b.startswith("<r>"))
    turn = lambda b: F.struct(unescaped(F.substring_index(F.substr(b, F.lit(2)), "] ", 1)).alias("role"), unescaped(F.substr(b, F.instr(b, F.lit("] ")) + 2)).alias("text"))
    masked = F.transform("loss", lambda s: unescaped(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    rows = windows.select("conv_id", "window", F.transform(blocks, turn).alias("turns"), masked.alias("masked"), F.length("formatted").cast("long").alias("characters"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window", "turns", "masked"))).alias("w"), F.sum("characters").alias("characters"))
    return whole.select("conv_id", F.flatten(F.transform("w", lambda x: x["turns"])).alias("turns"), F.flatten(F.transform("w", lambda x: x["masked"])).alias("masked"), "characters")

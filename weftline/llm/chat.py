"""Chat formatting of reply trees, in DataFrame functions only.

Messages form trees (id, parent). Self-joins that double their reach find every message's root, depth and the sum of
scores from the root; a leaf stands for the path that ends in it. Branches of a root are ranked by mean score, then by
length, then by leaf id; the chosen paths are expanded by the same doubled pointers and formatted, one conversation each.

The template writes a turn as ``### role: text </turn>`` and a newline. Inside roles and texts ``\\``, ``###`` and
``</turn>`` are escaped, so neither control string ever stands in a text, and ``\\x`` reads back as ``x``.

Defined results: null roles and texts count as empty, a parent that doesn't exist as none; messages on a cycle have no
root and give no conversation; rows that tie in every column of the order are interchangeable; empty tables give none. Ids are
unique: ``once`` drops repeated messages by a rule, and repeated rows of linear conversations are turns of their own. Texts of any length are formatted
whole. Columns beside those named are not read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import written

HEAD, END, BLOCK = "### ", " </turn>\n", 100
CALLED_NULL = r"^\\*null$"  # a conversation of such a name gets one more backslash in ids, so that "null" is the null one


def escape(text: Column, colon: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("###"), F.lit("#\\#\\#")), F.lit("</turn>"), F.lit("<\\/turn>"))
    return F.replace(out, F.lit(":"), F.lit("\\:")) if colon else out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def turns_as_trees(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Linear conversations as messages: id (conversation and place), parent (the turn before), score 0. A null conversation
    is one of its own, apart from one whose id is the text ``null``.

    Places are counted within blocks of ``BLOCK`` turn numbers, to which the rows of earlier blocks are added: a
    conversation with a large share of all rows is spread over many tasks.
    """
    told = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    told = told.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(2**62))))
    counts = told.groupBy("conv", "block").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("conv", "block", (F.sum("n").over(Window.partitionBy("conv").orderBy("block")) - F.col("n")).alias("before"))
    order = Window.partitionBy("conv", "block").orderBy("turn", "role", "text")
    inside = told.withColumn("inside", F.row_number().over(order)).alias("t")
    same = F.col("t.conv").eqNullSafe(F.col("b.conv")) & (F.col("t.block") == F.col("b.block"))
    placed = inside.join(before.alias("b"), same).select("t.conv", "t.role", "t.text", (F.col("inside") + F.col("before")).alias("at"))
    name = F.col("conv").cast("string")
    key = F.when(F.col("conv").isNull(), "null").when(name.rlike(CALLED_NULL), F.concat(F.lit("\\"), name)).otherwise(name)
    return placed.select(F.concat_ws("/", key, "at").alias("id"), F.when(F.col("at") > 1, F.concat_ws("/", key, F.col("at") - 1)).alias("parent"), "conv", "role", "text", F.lit(0.0).alias("score"))


def conversation(path: Column) -> Column:
    """The conversation, as text, of a path of ``turns_as_trees``; null for the null one."""
    name = F.regexp_extract(path, r"(?s)^(.*)/\d+$", 1)
    return F.when(name != "null", F.when(name.rlike(CALLED_NULL), F.substr(name, F.lit(2))).otherwise(name))


def once(messages: DataFrame) -> DataFrame:
    """One message an id: of several the one with the smallest parent, role, text and score, in this order. The other
    functions take ids to be unique."""
    rest = [c for c in ("parent", "role", "text", "score") if c in messages.columns]
    first = messages.groupBy("id").agg(F.min(F.struct(*rest)).alias("_m"))
    return first.select("id", *(F.col("_m")[c].alias(c) for c in rest))


def chosen_paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """Messages (id, parent, score) to (path, id, up): the ``top`` best root-to-leaf paths of each tree, named by their
    leaf, with each message's distance from the leaf. The joins' rounds grow with the logarithm of the depth; a message
    that has found its root takes part in no further one."""
    nodes = messages.select("id", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    parents = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("there"))
    step = written(nodes.join(parents, "parent", "left").select("id", F.when(F.col("there"), F.col("parent")).alias("to"), "score", F.lit(1).alias("n")))
    leaves = step.select("id").join(step.select(F.col("to").alias("id")).where("id is not null").distinct(), "id", "left_anti")
    done = step.where("to is null")
    levels = [step.where("to is not null")]
    while not levels[-1].isEmpty():
        now = levels[-1]
        there = now.unionByName(done).select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("score").alias("s2"), F.col("n").alias("n2"))
        # "to" is exclusive in score and n: a jump over "to" adds what stands from there on
        new = written(now.join(there, "to").select("id", F.col("to2").alias("to"), (F.col("score") + F.col("s2")).alias("score"), (F.col("n") + F.col("n2")).alias("n")))
        ended = new.where("to is null")
        if ended.isEmpty():  # depths have no gaps: what is left hangs on a cycle
            break
        done = done.unionByName(ended)
        levels.append(new.where("to is not null"))
    roots = _roots(levels, leaves)
    ranked = roots.join(done.select("id", "score", "n"), "id").withColumn("rank", F.row_number().over(Window.partitionBy("root").orderBy((F.col("score") / F.col("n")).desc(), F.col("n").desc(), "id")))
    paths = written(ranked.where(F.col("rank") <= top).select(F.col("id").alias("path"), "id", F.lit(0).alias("up")))
    for k, jump in enumerate(levels):
        # written each time: every round names the paths twice
        paths = paths.unionByName(written(paths.join(jump.select("id", "to"), "id").select("path", F.col("to").alias("id"), (F.col("up") + (1 << k)).alias("up"))))
    return paths


def _roots(levels: list[DataFrame], leaves: DataFrame) -> DataFrame:
    """(id, root) of each leaf: jump as far as there is something to jump to, largest jumps first."""
    at = leaves.select("id", F.col("id").alias("root"))
    for jump in reversed(levels):
        at = at.join(jump.select(F.col("id").alias("root"), "to"), "root", "left").select("id", F.coalesce("to", "root").alias("root"))
    return at


def format_paths(messages: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, formatted, loss): each path as one text, root first; loss: start and length of every assistant text, in code points."""
    turn = F.concat(F.lit(HEAD), escape(F.col("role"), colon=True), F.lit(": "))
    told = messages.select("id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    told = told.select("id", turn.alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == "assistant").alias("learn"))
    told = told.select("*", F.length("head").alias("head_n"), F.length("body").alias("body_n"))
    # starts are running sums over a path's turns, on the partitioning that collects them
    order = Window.partitionBy("path").orderBy(F.col("up").desc())
    placed = paths.join(told, "id").withColumn("end", F.sum(F.col("head_n") + F.col("body_n") + len(END)).over(order))
    turns = F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), "head", "body", "learn", (F.col("end") - F.col("body_n") - len(END)).cast("int").alias("start"), F.col("body_n").alias("n"))))
    whole = placed.groupBy("path").agg(turns.alias("turns"))
    loss = F.transform(F.filter("turns", lambda t: t["learn"]), lambda t: F.struct(t["start"].alias("start"), t["n"].alias("n")))
    return whole.select("path", F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"), loss.alias("loss"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text)."""
    def turn(x: Column) -> Column:
        # escaped characters are blotted out at their length: the first colon left ends the role
        bare = F.regexp_replace(x, r"(?s)\\.", "..")
        colon = F.instr(bare, ":")
        role = F.substr(x, F.lit(len(HEAD) + 1), colon - len(HEAD) - 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substr(x, colon + 2)).alias("text"))

    return F.transform(F.filter(F.split(formatted, END, -1), lambda x: x != ""), turn)


def loss_text(formatted: Column, loss: Column) -> Column:
    return unescape(F.array_join(F.transform(loss, lambda s: F.substr(formatted, s["start"] + 1, s["n"])), ""))

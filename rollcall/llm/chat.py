"""Chat formatting: reply trees into training conversations.

Messages point to the message they answer. Pointers are doubled by self-joins, so a tree
of depth d takes about log2(d) rounds: they give every message its root, its depth and the
sum of scores from its root. The best leaves of each tree are picked by the mean score of
their path, and only the picked paths are walked back and formatted.

In a formatted conversation a turn of the assistant is

    <s>[ANS] role LF text </s>        (without the spaces around LF and text)

and any other turn is

    <s>[INST] role LF text [/INST]

Control strings inside texts get a backslash after their first character, and backslashes
are doubled, so a text never holds a mark and can be read back as it was. In a role, the
characters that could start a mark or end the line are written as %XX.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rollcall.llm.scratch import written

# Fixed marks of the template.
TURN = "<s>"
END = "</s>"
ASK = "[INST]"
ASKED = "[/INST]"
ANSWER = "[ANS]"
CONTROL = (TURN, END, ASK, ASKED, ANSWER)
LOSS_ROLE = "assistant"


def escaped(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}")), CONTROL, doubled)


def unescaped(text: Column) -> Column:
    plain = reduce(lambda t, c: F.replace(t, F.lit(f"{c[0]}\\{c[1:]}"), F.lit(c)), CONTROL, text)
    return F.replace(plain, F.lit("\\\\"), F.lit("\\"))


_ROLE_MARKS = (("%", "%25"), ("\n", "%0A"), ("<", "%3C"), ("[", "%5B"))


def escaped_role(role: Column) -> Column:
    return reduce(lambda r, m: F.replace(r, F.lit(m[0]), F.lit(m[1])), _ROLE_MARKS, role)


def unescaped_role(role: Column) -> Column:
    return reduce(lambda r, m: F.replace(r, F.lit(m[1]), F.lit(m[0])), reversed(_ROLE_MARKS), role)


def paths(messages: DataFrame, *, branches: int = 1) -> DataFrame:
    """The best root-to-leaf paths of every reply tree, one row per message on a path.

    ``messages`` has ``tree``, ``node`` (not null, unique in its tree), ``parent`` and
    ``score``; other columns are left aside. A message whose parent is null or absent is a
    root; a null tree is a tree. A null score counts 0. Messages in a loop hang from no
    root and are on no path. Leaves rank by mean score of their path, highest first, ties
    by the smallest node; the first ``branches`` of a tree are kept.

    Returns ``tree, leaf, rank, depth, node``.
    """
    nodes = messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    known = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    jump = nodes.join(known, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("n")), "left").select(
        "tree", "node", F.col("n").alias("up"), F.when(F.col("n").isNull(), 0).otherwise(1).alias("depth"), F.col("score").alias("total")
    )
    jump = written(jump, "replies")
    jumps = [jump]
    longest = max(1, jump.count())
    # Every round doubles the distance that pointers reach.
    while (1 << (len(jumps) - 1)) < longest and jump.where("up is not null").limit(1).count():
        above = jump.select(
            F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("up2"),
            F.col("depth").alias("depth2"), F.col("total").alias("total2"),
        )
        # Messages that have reached their root wait; only the others are joined.
        further = (
            jump.where("up is not null")
            .join(above, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("n")))
            .select(
                "tree",
                "node",
                F.col("up2").alias("up"),
                (F.col("depth") + F.col("depth2")).alias("depth"),
                (F.col("total") + F.col("total2")).alias("total"),
            )
        )
        jump = written(jump.where("up is null").unionByName(further), "replies")
        jumps.append(jump)
    rooted = jump.where("up is null")
    parents = jumps[0].select(F.col("tree").alias("t"), F.col("up").alias("n")).where("n is not null").distinct()
    leaves = rooted.join(parents, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")), "left_anti")
    order = Window.partitionBy("tree").orderBy((F.col("total") / (F.col("depth") + 1)).desc(), "node")
    picked = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= branches)
    # From the longest jumps to the shortest: what is reached so far lies twice as far
    # apart as the jump at hand, so each message is met once.
    on_path = picked.select("tree", F.col("node").alias("leaf"), "rank", "node")
    for step in reversed(jumps[:-1] if len(jumps) > 1 else jumps):
        up = step.where("up is not null").select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        reached = on_path.join(up, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))).select(
            "tree", "leaf", "rank", F.col("up").alias("node")
        )
        # Written, as the next round reads it twice: plans would double as well.
        on_path = written(on_path.unionByName(reached), "paths")
    depths = rooted.select(F.col("tree").alias("t"), F.col("node").alias("n"), "depth")
    return on_path.join(depths, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))).select(
        "tree", "leaf", "rank", "depth", "node"
    )


def formatted(messages: DataFrame, *, branches: int = 1) -> DataFrame:
    """Each picked path of ``messages`` as one conversation.

    Besides what ``paths`` reads, ``messages`` has ``role`` and ``text``; null counts as
    empty. An empty table gives no rows.

    Returns ``tree, leaf, rank, formatted``.
    """
    said = messages.select(
        F.col("tree").alias("t"), F.col("node").alias("n"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    body = F.concat(escaped_role(F.col("role")), F.lit("\n"), escaped(F.col("text")))
    turn = F.when(F.col("role") == LOSS_ROLE, F.concat(F.lit(f"{TURN}{ANSWER} "), body, F.lit(END))).otherwise(
        F.concat(F.lit(f"{TURN}{ASK} "), body, F.lit(ASKED))
    )
    turns = paths(messages, branches=branches).join(
        said, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))
    )
    return (
        turns.groupBy("tree", "leaf", "rank")
        .agg(F.array_sort(F.collect_list(F.struct("depth", turn.alias("turn")))).alias("turns"))
        .select("tree", "leaf", "rank", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"))
    )


def read_back(conversation: Column) -> Column:
    """The turns of a formatted conversation: array of role, text and whether it has loss."""
    turns = F.filter(F.split(conversation, f"\\Q{TURN}\\E", -1), lambda t: t != "")

    def parsed(turn: Column) -> Column:
        loss = F.startswith(turn, F.lit(ANSWER))
        head = F.when(loss, len(ANSWER) + 2).otherwise(len(ASK) + 2)
        tail = F.when(loss, len(END)).otherwise(len(ASKED))
        line = F.position(F.lit("\n"), turn)
        return F.struct(
            unescaped_role(F.substring(turn, head, line - head)).alias("role"),
            unescaped(F.substring(turn, line + 1, F.length(turn) - line - tail)).alias("text"),
            loss.alias("loss"),
        )

    return F.transform(turns, parsed)


def replies_of(conversations: DataFrame) -> DataFrame:
    """Conversations stored by turn, as messages that each answer the turn before.

    Turns of a conversation go by ``turn``, null first, then by role and text; repeated
    rows are turns of their own. A conversation is one row of output in the end, so its
    turns are numbered in one window.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = conversations.select("conv_id", "role", "text", F.row_number().over(order).alias("node"))
    return numbered.select(
        F.col("conv_id").alias("tree"),
        "node",
        F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
        F.lit(0.0).alias("score"),
        "role",
        "text",
    )


def formatted_digests(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """What the formatted conversations hold, read back from them, in digests.

    ``conversations`` has ``conv_id``, ``turn``, ``role`` and ``text``; other columns are
    left aside. Conversation -1 is added: a user and an assistant both say control strings.
    """
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(LOSS_ROLE).alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(probe)
    messages = written(replies_of(rows), "messages")
    whole = formatted(messages).withColumn("turns", read_back(F.col("formatted")))
    said = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    learnt = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return whole.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )

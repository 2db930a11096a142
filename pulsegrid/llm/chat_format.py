"""Chat formatting in budgeted windows, in DataFrame functions only.

A turn is written ``<|turn|>role<|text|>text<|end|>``.  Control strings inside roles and texts are
escaped reversibly.  Prefix sums of turn tokens cut a conversation into turn-aligned windows: the turns
that begin in the same stride of the prefix sum share a window.  The last of them, which may cross into the
next stride, stays with them if budget and system turn leave room, and has a window of its own if not.
Each window starts with the system turn (the conversation's first turn if its role is ``system``), repeats
as many of the preceding turns as the history budget and the room left hold, then has its own turns.  The
loss mask covers the texts of own assistant turns; repeated turns are masked.

Prefix sums are taken inside blocks of turn numbers and the blocks' totals are summed above them, so a
very long conversation is spread over tasks.  A window holds at most ``budget`` tokens, unless one
turn alone (with the system turn) has more: turns are never cut.  The numbered turns are written to the shared
folder once, and each step reads the columns it needs of them.

Turns are ordered by turn (null first), then role, then text; repeated rows are turns of their own.
Null role or text counts as empty; rows of null conv_id form one conversation.  Ids may be of any type.  An
empty table gives no window.  Extra columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import materialise

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: What common chat templates use as control strings; an escape goes after their first character.
CONTROL = r"(<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\]))"
#: Tokens of a window, and of the history that it may repeat.
BUDGET = 1024
HISTORY = 128
#: Bytes that count as one token when no count is given.
BYTES_PER_TOKEN = 4
#: Turn numbers of one block of the prefix sums.
BLOCK_TURNS = 256


def escape(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\(\\?)", "$1")


def _numbered(conversations: DataFrame, tokens: Column | None) -> DataFrame:
    """Turns with their position in the conversation and the prefix sums of tokens before and after them."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.select(
        F.coalesce(F.concat(F.lit("s"), F.col("conv_id").cast("string")), F.lit("")).alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        text.alias("text"),
        (tokens if tokens is not None else F.lit(None)).cast("long").alias("given"),
    )
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    rows = rows.select("conv", "turn", "role", "text", "given", head.alias("head"), escape(F.col("text")).alias("body"))
    counted = F.ceil((F.octet_length("head") + F.octet_length("body") + len(END)) / F.lit(BYTES_PER_TOKEN))
    rows = rows.select(
        "conv", "turn", "role", "text", "head", "body",
        F.coalesce(F.floor(F.col("turn") / F.lit(BLOCK_TURNS)), F.lit(-(2**62))).alias("block"),
        F.greatest(F.coalesce("given", counted), F.lit(1)).cast("long").alias("tokens"),
    )
    # The first turn of all is a system turn if the least (turn, role) is one; its text only settles ties.
    system = F.when(F.col("role") == "system", F.struct("turn", "text", "tokens"))
    blocks = rows.groupBy("conv", "block").agg(
        F.sum("tokens").alias("tokens"), F.count("*").alias("n"), F.min(F.struct("turn", "role")).alias("first"), F.min(system).alias("system")
    )
    all_of = Window.partitionBy("conv").orderBy("block")
    ahead = all_of.rowsBetween(Window.unboundedPreceding, -1)
    upto = all_of.rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.select(
        "conv", "block",
        F.coalesce(F.sum("tokens").over(ahead), F.lit(0)).alias("tokens_ahead"),
        F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("n_ahead"),
        F.first("first.role").over(upto).alias("role"),
        F.first("system.tokens").over(upto).alias("system_tokens"),
    )
    blocks = blocks.select(
        "conv", "block", "tokens_ahead", "n_ahead",
        F.when(F.col("role") == "system", F.col("system_tokens")).otherwise(0).alias("system_tokens"),
    )
    order = Window.partitionBy("conv", "block").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(blocks, ["conv", "block"]).select(
        "conv", "role", "head", "body", "tokens", "system_tokens",
        (F.col("n_ahead") + F.row_number().over(order)).alias("pos"),
        (F.col("tokens_ahead") + F.sum("tokens").over(so_far)).alias("upto"),
    )
    is_system = (F.col("pos") == 1) & (F.col("system_tokens") > 0)
    upto = F.when(is_system, F.lit(0)).otherwise(F.col("upto") - F.col("system_tokens"))
    before = F.when(is_system, F.lit(0)).otherwise(upto - F.col("tokens"))
    return rows.select(
        "conv", "role", "head", "body", "tokens", "system_tokens", "pos", is_system.alias("system"), before.alias("before"), upto.alias("upto")
    )


def format_windows(
    conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens: Column | None = None
) -> DataFrame:
    """Windows of ``conversations`` (conv_id, turn, role, text; a row for each turn).

    Returns conv_id, window (its order), formatted, repeated (for each turn of ``formatted``, whether an
    earlier window has it), loss (start and end, in code points of ``formatted``, of each target) and n_tokens.
    """
    if not 0 <= history < budget:
        raise ValueError("history must be less than budget")
    rows = materialise(_numbered(conversations, tokens), "turns")
    room = F.greatest(F.lit(budget) - F.col("system_tokens"), F.lit(1))
    # A large system turn leaves less for history, which never takes more than a quarter of the room.
    stride = F.greatest(room - F.least(F.lit(history), F.floor(room / 4)), F.lit(1))
    group = F.floor(F.col("before") / stride)
    rows = rows.withColumn("group", F.when(F.col("system"), 0).otherwise(group).cast("long"))
    same = Window.partitionBy("conv", "group")  # at most a stride of tokens and one turn
    begin = F.min(F.when(~F.col("system"), F.col("before"))).over(same)
    apart = ~F.col("system") & (F.col("before") > begin) & (F.col("upto") - begin > room)
    rows = rows.withColumn("window", 2 * F.col("group") + F.when(apart, 1).otherwise(0)).withColumn("room", room)

    piece = F.struct(
        F.col("part"), F.col("pos"), F.col("repeated"), (~F.col("repeated") & (F.col("role") == "assistant")).alias("target"),
        F.concat("head", "body", F.lit(END)).alias("text"), F.length("head").alias("head"), F.length("body").alias("body"), F.col("tokens"),
    )
    own = rows.withColumn("part", F.when(F.col("system"), 0).otherwise(2)).withColumn("repeated", F.lit(False))
    named = ["conv", "window", "part", "pos", "repeated", "role", "head", "body", "tokens"]
    taken = F.sum(F.when(~F.col("system"), F.col("tokens")).otherwise(0))
    starts = rows.groupBy("conv", "window", "room").agg(F.min("before").alias("start"), taken.alias("taken"))
    starts = starts.withColumn("left", F.least(F.lit(history), F.col("room") - F.col("taken")))
    # The turns that a window repeats end in its own or the preceding stretch of ``history`` tokens.
    span = max(history, 1)
    stretch = F.floor((F.col("start") - 1) / F.lit(span))
    asked = starts.where("start > 0 AND left > 0")
    asked = asked.select("conv", F.col("window").alias("to"), "start", "left", F.explode(F.array(stretch, stretch - 1)).alias("stretch"))
    turns = rows.where(~F.col("system")).withColumn("stretch", F.floor((F.col("upto") - 1) / F.lit(span)))
    past = turns.join(asked, ["conv", "stretch"]).where(
        (F.col("upto") <= F.col("start")) & (F.col("before") >= F.col("start") - F.col("left"))
    )
    past = past.withColumn("window", F.col("to")).withColumn("part", F.lit(1)).withColumn("repeated", F.lit(True))
    system = rows.where("system").drop("window")
    retained = starts.where("window > 0").select("conv", "window").join(system, "conv")
    retained = retained.withColumn("part", F.lit(0)).withColumn("repeated", F.lit(True))
    members = own.select(named).unionByName(past.select(named)).unionByName(retained.select(named))

    pieces = F.sort_array(F.collect_list(piece)).alias("pieces")
    windows = members.groupBy("conv", "window").agg(pieces)
    # Running length before each piece, then the stretch of each target.
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    spans = F.aggregate(
        "pieces",
        zero,
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["text"])).alias("at"),
            F.when(
                p["target"],
                F.concat(
                    acc["spans"],
                    F.array(F.struct((acc["at"] + p["head"]).alias("start"), (acc["at"] + p["head"] + p["body"]).alias("end"))),
                ),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return windows.select(
        F.when(F.col("conv") != "", F.expr("substring(conv, 2)")).cast(conversations.schema["conv_id"].dataType).alias("conv_id"),
        "window",
        F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"),
        F.transform("pieces", lambda p: p["repeated"]).alias("repeated"),
        spans.alias("loss"),
        F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + p["tokens"]).alias("n_tokens"),
    )


def own_turns(windows: DataFrame) -> DataFrame:
    """``windows`` with ``turns``, an array of the role and text of each turn that is not a repetition,
    and ``targets``, the texts under the loss mask; both are read from ``formatted`` alone."""
    written = F.split("formatted", r"<\|end\|>")
    both = F.arrays_zip(F.slice(written, 1, F.size(written) - 1).alias("turn"), F.col("repeated").alias("again"))
    kept = F.filter(both, lambda x: ~x["again"])

    def read(turn: Column) -> Column:
        at = F.locate(TEXT, turn)
        role = F.substring(turn, F.lit(len(TURN) + 1), at - len(TURN) - 1)
        text = F.substring(turn, at + len(TEXT), F.length(turn))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    target = F.transform(
        "loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))
    )
    return windows.withColumn("turns", F.transform(kept, lambda x: read(x["turn"]))).withColumn("targets", target)


def digests(windows: DataFrame) -> DataFrame:
    """A row for each conversation, from what its windows say; the digests need its text as a whole."""
    read = own_turns(windows).select(
        "conv_id",
        "window",
        F.size("turns").alias("n"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("all"),
        F.array_join("targets", "").alias("loss"),
        F.length("formatted").alias("chars"),
    )
    parts = F.sort_array(F.collect_list(F.struct("window", "all", "loss")))
    whole = read.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"), parts.alias("parts"), F.sum("chars").cast("long").alias("formatted_chars")
    )
    text = F.array_join(F.transform("parts", lambda p: p["all"]), "")
    loss = F.array_join(F.transform("parts", lambda p: p["loss"]), "")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(text, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )

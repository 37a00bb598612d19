"""Chat formatting in budgeted, turn-aligned windows with a loss mask, and the reader of that format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import stored

# Fixed strings of the template. A turn is OPEN role newline text CLOSE newline.
OPEN, CLOSE, LINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
# Control strings of this and of other common templates: none may appear in an escaped text.
CONTROL = r"<\||</?s>|\[/?INST\]|<</?SYS>>"
TURN = r"(?s)<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n"
BUCKET = 4096


def escape(c: Column) -> Column:
    """Double every backslash, then put one after the first character of each control string."""
    doubled = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, f"(?=(?:{CONTROL}))(.)", "$1\\\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit(LINE))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit(LINE), F.lit("\n")))


def _running(df: DataFrame, sums: dict[str, str], order: list[str]) -> DataFrame:
    """For each value: out, its sum over the earlier rows of the conversation. Sums run inside buckets of turn numbers and
    over the buckets' totals, so a huge conversation is spread over as many tasks as it has buckets."""
    inside = W.partitionBy("conv", "bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    earlier = W.partitionBy("conv").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    own = df.select("*", *[F.coalesce(F.sum(value).over(inside), zero).alias(f"_in_{out}") for value, out in sums.items()])
    totals = df.groupBy("conv", "bucket").agg(*[F.sum(value).alias(f"_t_{out}") for value, out in sums.items()])
    totals = totals.select(
        F.col("conv").alias("_c"), F.col("bucket").alias("_b"), *[F.coalesce(F.sum(f"_t_{out}").over(earlier), zero).alias(f"_before_{out}") for out in sums.values()]
    )
    same = own["conv"].eqNullSafe(totals["_c"]) & (own["bucket"] == totals["_b"])
    return own.join(totals, same).select(*df.columns, *[(F.col(f"_in_{out}") + F.col(f"_before_{out}")).alias(out) for out in sums.values()])


def chat_windows(
    conversations: DataFrame, budget: int = 1024, history: int = 128, conv_col: str = "conv_id", turn_col: str = "turn",
    role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """One row per window: conv_id, window (0, 1, ...), formatted, fresh (offset of the first new turn) and loss
    (array of start and length, code points, of the texts that count towards the loss).

    The size of a turn is its number of words plus four. With prefix sums p of the sizes, a turn belongs to the span
    floor((p at its end - 1) / half the budget); a turn over half the budget is a span of its own. So spans
    are turn-aligned and within the budget unless one turn alone is larger. A window holds the conversation's first
    turn if that is a system turn, then the turns at the end of the span before that fit ``history``, then
    the span's own turns. Assistant texts count only in their own span: repeated targets are masked.

    Turns are ordered by number, then role, then text; null roles and texts count as empty, null turns come
    first, a null conversation id is a conversation. Repeated rows are turns of their own. An empty table gives no
    windows. No window gathers more than a budget and its history, or one larger turn.
    """
    half = max(1, budget // 2)
    turns = conversations.select(
        conversations[conv_col].alias("conv"), conversations[turn_col].cast("long").alias("turn"),
        F.coalesce(conversations[role_col].cast("string"), F.lit("")).alias("role"),
        F.coalesce(conversations[text_col].cast("string"), F.lit("")).alias("text"),
    )
    order = ["turn", "role", "text"]
    sized = turns.withColumns({
        "size": (F.regexp_count("text", F.lit(r"\S+")) + 4).cast("long"),
        "bucket": F.coalesce(F.floor(F.col("turn") / BUCKET), F.lit(-(2**62))),
        "one": F.lit(1).cast("long"),
    }).withColumn("big", (F.col("size") > half).cast("long"))
    placed = _running(stored(sized), {"size": "start", "big": "bigs", "one": "at"}, order)
    span = F.struct(
        (2 * F.col("bigs") + F.col("big")).alias("a"),
        F.when(F.col("big") == 1, 0).otherwise(F.floor((F.col("start") + F.col("size") - 1) / half)).alias("b"),
    )
    placed = stored(placed.withColumn("span", span).drop("bucket", "big", "bigs", "one"))
    by_span = W.partitionBy("conv").orderBy("span")
    spans = stored(
        placed.groupBy("conv", "span").agg(F.max(F.col("start") + F.col("size")).alias("stop"))
        .withColumn("window", F.row_number().over(by_span) - 1)
        .withColumn("last", F.lead("window").over(by_span).isNull())
        .select(F.col("conv").alias("c"), F.col("span").alias("s"), "stop", "window", "last")
    )
    located = placed.join(spans, placed["conv"].eqNullSafe(spans["c"]) & (placed["span"] == spans["s"])).drop("c", "s", "span")
    is_system = (F.col("at") == 0) & (F.col("role") == "system")
    repeated = ~is_system & ~F.col("last") & (F.col("stop") - F.col("start") <= history)
    uses = F.array_compact(F.array(
        F.struct("window", F.lit(2).alias("part")), F.when(repeated, F.struct((F.col("window") + 1).alias("window"), F.lit(1).alias("part"))),
    ))
    own = located.select("conv", "at", "role", "text", F.explode(uses).alias("u")).select("conv", "u.window", "u.part", "at", "role", "text")
    first = placed.where(is_system).select(F.col("conv").alias("c"), "role", "text")
    system = (
        spans.where("window > 0").select(F.col("c").alias("conv"), "window").join(first, F.col("conv").eqNullSafe(F.col("c")))
        .select("conv", "window", F.lit(0).alias("part"), F.lit(0).cast("long").alias("at"), "role", "text")
    )
    # A piece is cut before and after its text, so that the mask covers the escaped text alone.
    pieces = own.unionByName(system).withColumn(
        "piece", F.struct("part", "at", F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n")).alias("head"),
                          escape(F.col("text")).alias("body"), (F.col("role") == "assistant").alias("target")),
    )
    tail = f"{CLOSE}\n"
    windows = pieces.groupBy("conv", "window").agg(F.sort_array(F.collect_list("piece")).alias("p"))
    length = lambda x: F.char_length(x["head"]) + F.char_length(x["body"]) + len(tail)
    whole = lambda x: F.concat(x["head"], x["body"], F.lit(tail))
    walk = F.aggregate(
        "p", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss")),
        lambda a, x: F.struct(
            (a["at"] + length(x)).alias("at"),
            F.when(
                x["target"] & (x["part"] == 2),
                F.concat(a["loss"], F.array(F.struct((a["at"] + F.char_length(x["head"])).alias("start"), F.char_length(x["body"]).alias("length")))),
            ).otherwise(a["loss"]).alias("loss"),
        ),
    )
    return windows.select(
        F.col("conv").alias("conv_id"), "window", F.array_join(F.transform("p", whole), "").alias("formatted"),
        F.aggregate(F.filter("p", lambda x: x["part"] < 2), F.lit(0), lambda a, x: a + length(x)).alias("fresh"),
        walk["loss"].alias("loss"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """What the formatted text says: per window, the new turns (role, text) and the text under the mask."""
    new = F.substring(F.col("formatted"), F.col("fresh") + 1, F.char_length("formatted"))
    turns = F.transform(
        F.arrays_zip(F.regexp_extract_all(new, F.lit(TURN), F.lit(1)).alias("r"), F.regexp_extract_all(new, F.lit(TURN), F.lit(2)).alias("t")),
        lambda x: F.struct(unescape_role(x["r"]).alias("role"), unescape(x["t"]).alias("text")),
    )
    cut = F.transform("loss", lambda x: unescape(F.substring(F.col("formatted"), x["start"] + 1, x["length"])))
    return windows.select("conv_id", "window", turns.alias("turns"), F.array_join(cut, "").alias("target"), F.char_length("formatted").alias("chars"))


def conversation_digests(read: DataFrame) -> DataFrame:
    """Per conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. A digest of a whole
    conversation needs its text in one value, so this check (not the operator) holds one conversation at a time."""
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    rows = read.select("conv_id", "chars", F.size("turns").alias("n"), F.struct("window", said.alias("said"), "target").alias("w"))
    grouped = rows.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sort_array(F.collect_list("w")).alias("w"), F.sum("chars").alias("formatted_chars"))
    target = F.array_join(F.col("w.target"), "")
    return grouped.select(
        "conv_id", "n_turns", F.sha2(F.array_join(F.col("w.said"), ""), 256).alias("turns_sha256"),
        F.char_length(target).cast("long").alias("loss_chars"), F.sha2(target, 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )

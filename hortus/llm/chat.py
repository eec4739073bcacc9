"""Chat formatting in budgeted, turn-aligned windows with a loss mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, ROLE_END, TURN_END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"


def escape(c: Column) -> Column:
    """Afterwards no ``<|`` is left, so no text can look like a mark."""
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def format_windows(turns: DataFrame, budget: int = 512, history: int = 2) -> DataFrame:
    """conv_id, window, formatted, n_repeated, loss: the training windows.

    Turns are ordered by (turn, role, text), a null turn first; null roles and
    texts are empty.  Prefix sums of the turns' words assign each turn to a
    span of ``budget`` words (a longer turn is a span of its own start).  The
    budget is a stride: the last turn of a window may go beyond it, and the
    repeated turns are not counted.  Each
    later window repeats the system turn that opens the conversation and up to
    ``history`` turns before its span; ``n_repeated`` counts these leading
    turns.  ``loss`` lists (start, length) in code points, from 1, of the
    assistant texts of the span itself, so every target counts once.  Rows
    without conv_id form one conversation; repeated rows are turns of their
    own; an empty table gives no rows.  A conversation's windows are sorted in
    one task, as its digests need all of its text in order."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    key = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit(ROLE_END))
    rows = (turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
            .withColumn("rn", F.row_number().over(key))
            .withColumn("words", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long"))
            .withColumn("lead", F.length(head)).withColumn("body", escape(F.col("text")))
            .withColumn("piece", F.concat(head, "body", F.lit(TURN_END))))
    order = Window.partitionBy("conv_id").orderBy("rn")
    first = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = (rows.withColumn("window", F.floor((F.sum("words").over(first) - F.col("words")) / budget))
            .withColumn("system", F.first(F.when((F.col("rn") == 1) & (F.col("role") == "system"), F.col("piece"))).over(first))
            .withColumn("opens", ~F.col("window").eqNullSafe(F.lag("window").over(order))))
    # Earlier turns, oldest first; the system turn is put before them unless it is among them.
    past = F.array(*[F.lag("piece", i).over(order) for i in range(history, 0, -1)])
    system = F.when(F.col("rn") > history + 1, F.col("system"))
    rows = rows.withColumn("before", F.when(F.col("opens"), F.array_compact(F.concat(F.array(system), past))))
    span = Window.partitionBy("conv_id", "window").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("offset", F.sum(F.length("piece")).over(span) - F.length("piece"))
    grouped = (rows.groupBy("conv_id", "window")
               .agg(F.array_sort(F.collect_list(F.struct("rn", "piece", "role", F.expr("offset + lead + 1 start"), F.length("body").alias("length")))).alias("t"),
                    F.min_by("before", "rn").alias("before")))
    shift = F.length(F.array_join("before", ""))
    loss = F.transform(F.filter("t", lambda x: x["role"] == "assistant"),
                       lambda x: F.struct((x["start"] + F.col("shift")).alias("start"), x["length"].alias("length")))
    return (grouped.withColumn("shift", shift)
            .select("conv_id", "window", F.concat(F.array_join("before", ""), F.array_join("t.piece", "")).alias("formatted"),
                    F.size("before").alias("n_repeated"), loss.alias("loss")))


def read_back(windows: DataFrame) -> DataFrame:
    """n_turns, digests and lengths per conversation, from the formatted text alone."""
    parts = F.split("formatted", r"<\|im_end\|>\n", -1)
    fresh = F.slice(F.col("parts"), F.col("n_repeated") + 1, F.greatest(F.size("parts") - 1 - F.col("n_repeated"), F.lit(0)))

    def plain(p: Column) -> Column:
        cut = F.locate(ROLE_END, p)
        role = F.substr(p, F.lit(len(START) + 1), cut - len(START) - 1)
        return F.concat(unescape(role), F.lit("\n"), unescape(F.substr(p, cut + len(ROLE_END))), F.lit("\n"))

    each = (windows.withColumn("parts", parts).withColumn("fresh", fresh)
            .select("conv_id", "window", F.size("fresh").alias("n"), F.length("formatted").cast("long").alias("chars"),
                    F.array_join(F.transform("fresh", plain), "").alias("said"),
                    F.array_join(F.transform("loss", lambda s: unescape(F.substr("formatted", s["start"].cast("int"), s["length"]))), "").alias("target")))
    whole = each.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "said", "target"))).alias("w"),
                                        F.sum("n").cast("long").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    said, target = F.array_join("w.said", ""), F.array_join("w.target", "")
    return whole.select("conv_id", "n_turns", F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
                        F.length(target).cast("long").alias("loss_chars"), F.sha2(target.cast("binary"), 256).alias("loss_sha256"), "formatted_chars")

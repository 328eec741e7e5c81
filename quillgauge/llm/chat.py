"""Chat formatting by reconstruction from events.

A conversation's log is a table of events: (conv_id, seq, turn, op, role,
text) with op one of

* ``start``       a message begins at this turn, with its role;
* ``delta``       text is appended to the turn's message;
* ``edit``        the turn's message is replaced by the text;
* ``regenerate``  the turn's message and all later turns are discarded; deltas
                  that follow build the message anew.

A conversation's events are sorted by ``seq`` and folded from the last to the
first: an event counts unless a later regeneration reaches its turn, and text
counts unless a later edit of its turn does; both are running aggregates over
the sorted log, which is shuffled once, by conversation.  The messages are
rendered in a template that marks turns, with control strings inside texts
escaped reversibly, and ``read_back`` parses the rendered string again.

Edge cases: null roles and texts are empty; events of equal ``seq`` are taken
in the order of turn, op, role and text, a start before deltas; events of other
ops are ignored; repeated rows count as often as they occur, so a delta logged
twice says its text twice; the role is that of the turn's last start, and a turn
of deltas alone has an empty role; a null conversation is one like others; a
null turn comes first and no regeneration reaches it; a very long text or a
conversation of very many events becomes one string; an empty table gives no
rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Order of operations that share a sequence number.
ORDER = {"regenerate": 0, "start": 1, "edit": 2, "delta": 3}


def escape(text: Column) -> Column:
    r"""``\`` -> ``\\``, ``<|`` -> ``\<``, newline -> ``\n``: control strings cannot occur in the result."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit("<|"), F.lit("\\<")), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    """The inverse: between double backslashes, each backslash begins one of the other two codes."""
    plain = lambda p: F.replace(F.replace(p, F.lit("\\<"), F.lit("<|")), F.lit("\\n"), F.lit("\n"))
    return F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")


def rank_of(op: Column) -> Column:
    out = F.lit(9)
    for name, n in ORDER.items():
        out = F.when(op == name, F.lit(n)).otherwise(out)
    return out


def fold(events: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of every message that the log ends with."""
    e = events.select("conv_id", "seq", "turn", "op", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    e = e.where(F.col("op").isin(*ORDER)).withColumn("at", F.struct("seq", F.col("turn").alias("t"), rank_of(F.col("op")).alias("o"), F.col("role").alias("r"), F.col("text").alias("x")))
    later = Window.partitionBy("conv_id").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    reached = F.min(F.when(F.col("op") == "regenerate", F.col("turn"))).over(later)
    e = e.withColumn("alive", ~F.coalesce(F.col("turn") >= reached, F.lit(False)))
    later_in_turn = Window.partitionBy("conv_id", "turn").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("edited", F.coalesce(F.bool_or(F.col("alive") & (F.col("op") == "edit")).over(later_in_turn), F.lit(False)))
    said = F.when(F.col("alive") & ~F.col("edited") & F.col("op").isin("edit", "delta"), F.col("at"))
    started = F.when(F.col("op") == "start", F.col("at"))
    m = e.groupBy("conv_id", "turn").agg(
        F.coalesce(F.max_by("role", started), F.lit("")).alias("role"), F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda a: a.x), "").alias("text"),
        F.bool_or(F.col("alive") & (F.col("op") != "regenerate")).alias("there"),
    )
    return m.where("there").drop("there")


def render(messages: DataFrame, order: str = "turn") -> DataFrame:
    """conv_id, formatted: all messages of a conversation in one string."""
    one = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit("\n"), escape(F.col("text")), F.lit(CLOSE + "\n"))
    listed = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), one.alias("m")))).alias("all"))
    return listed.select("conv_id", F.array_join(F.transform("all", lambda x: x.m), "").alias("formatted"))


def read_back(formatted: Column) -> Column:
    """array of struct(role, text) parsed from the rendered string."""
    marks = r"<\|im_start\|>"
    parts = F.slice(F.split(formatted, marks), 2, F.lit(1 << 30))
    body = lambda p: F.substring_index(p, CLOSE, 1)
    return F.transform(parts, lambda p: F.struct(unescape(F.substring_index(body(p), "\n", 1)).alias("role"), unescape(F.substring_index(body(p), "\n", -1)).alias("text")))


def loss_text(turns: Column) -> Column:
    """All text under the loss mask: what the assistant says."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t.role == "assistant"), lambda t: t.text), "")


def as_events(conversations: DataFrame) -> DataFrame:
    """The log of a table of whole turns, as a client may have streamed them.

    A turn is started and streamed as two deltas.  Before that, assistant turns
    stream a draft that is regenerated; every second other turn streams one that
    an edit to the first half replaces.  Rows that share a turn are told apart
    by counting them.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    rows = rows.withColumn("turn", nth.cast("long")).withColumn("half", F.floor(F.length("text") / 2).cast("int"))
    event = lambda n, op, text: F.struct((F.col("turn") * 8 + n).alias("seq"), F.lit(op).alias("op"), text.alias("text"))
    first, second, draft = F.expr("substring(text, 1, half)"), F.expr("substring(text, half + 1)"), F.lit("draft <|im_end|> ")
    none = F.lit(None).cast("string")
    plain = F.array(event(4, "start", none), event(5, "delta", first), event(6, "delta", second))
    again = F.concat(F.array(event(0, "start", none), event(1, "delta", draft), event(2, "regenerate", none)), plain)
    edited = F.array(event(0, "start", none), event(1, "delta", draft), event(2, "edit", first), event(6, "delta", second))
    steps = F.when(F.col("role") == "assistant", again).when(F.col("turn") % 2 == 0, edited).otherwise(plain)
    return rows.select("conv_id", "turn", "role", F.explode(steps).alias("e")).select("conv_id", "e.seq", "turn", "e.op", "role", "e.text")


def format_conversations(events: DataFrame) -> DataFrame:
    """conv_id, formatted, turns: the rendered string and what is read back from it."""
    return render(fold(events)).withColumn("turns", read_back(F.col("formatted")))


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id and digests of what was read back."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    f = formatted.withColumn("loss", loss_text(F.col("turns")))
    return f.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )

"""Chat formatting with DataFrame functions only.

A template is data: the markers, the text around them, which roles carry loss, and the allowed
moves of a finite-state machine over roles. Texts and roles are escaped reversibly, so no text
can forge a marker: every ``&`` becomes ``&amp;`` and every ``<|`` becomes ``&lt;|`` (in a role
also a line feed becomes ``&nl;``). After that each ``&`` starts exactly one of these names, and
replacing the names in reverse order gives the text back.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """A turn is ``start role \\n text end \\n``; only the text of loss_roles carries loss."""

    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    after_role: str = "\n"
    after_turn: str = "\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state -> roles that may come next; "" is the start.
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("assistant", "tool")})
    final: tuple[str, ...] = ("assistant",)


def escape(c: Column, role: bool = False) -> Column:
    c = F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))
    return F.replace(c, F.lit("\n"), F.lit("&nl;")) if role else c


def unescape(c: Column) -> Column:
    for name, text in (("&nl;", "\n"), ("&lt;|", "<|"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(text))
    return c


def format_chats(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, segments array<struct<text, loss>>, formatted, valid, n_rejected), one row a conversation.

    turns: conv_id, turn, role, text. Rows are ordered by turn (null first), then role, then
    text, so ties and repeated rows have one result; repeated rows are repeated turns. Null text
    or role: empty. A row with a null conv_id belongs to no other: it is a conversation of its
    own, so such rows never gather in one task. Empty table: empty result. Very long texts are
    formatted whole. Other columns are left out, so names can't clash. The machine reads the roles in
    order; a role that no move allows leaves the state as it is and adds to n_rejected; valid:
    none rejected and the last state is final. Invalid conversations are formatted too, so the
    caller chooses. Concatenated segment texts equal formatted. A conversation is one row of the
    result, so its turns are gathered; nothing larger is.
    """
    t = template
    moves = F.create_map(*[F.lit(x) for state, roles in t.moves.items() for role in roles for x in (f"{state}\n{role}", True)])
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    rows = turns.select("conv_id", alone.alias("alone"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    seg = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)
    ready = rows.select(
        "conv_id", "alone", "turn", "role",
        F.concat(F.lit(t.start), escape(F.col("role"), role=True), F.lit(t.after_role)).alias("head"),
        escape(F.col("text")).alias("body"),
    )
    step = lambda a, x: F.when(
        F.coalesce(F.try_element_at(moves, F.concat(a["state"], F.lit("\n"), x["role"])), no),
        F.struct(x["role"].alias("state"), a["bad"].alias("bad")),
    ).otherwise(F.struct(a["state"].alias("state"), (a["bad"] + 1).alias("bad")))
    return (
        ready.groupBy("conv_id", "alone")
        .agg(F.array_sort(F.collect_list(F.struct("turn", "role", "body", "head"))).alias("turns"))
        .select(
            "conv_id",
            F.flatten(F.transform("turns", lambda x: F.array(seg(x["head"], no), seg(x["body"], x["role"].isin(*t.loss_roles)), seg(F.lit(t.end + t.after_turn), no)))).alias("segments"),
            F.aggregate("turns", F.struct(F.lit("").alias("state"), F.lit(0).alias("bad")), step).alias("end"),
        )
        .select("conv_id", "segments", F.array_join("segments.text", "").alias("formatted"), ((F.col("end.bad") == 0) & F.col("end.state").isin(*t.final)).alias("valid"), F.col("end.bad").alias("n_rejected"))
    )


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>, loss_text, formatted_chars, valid) from the output alone."""
    t = template
    body = F.split(F.col("formatted"), "\\Q" + t.start + "\\E", -1)
    parse = lambda p: F.struct(
        unescape(F.substring_index(p, t.after_role, 1)).alias("role"),
        unescape(_after(p, t.after_role, t.end + t.after_turn)).alias("text"),
    )
    return formatted.select(
        "conv_id", "valid",
        F.transform(F.filter(body, lambda p: p != ""), parse).alias("turns"),
        unescape(F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), "")).alias("loss_text"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _after(p: Column, sep: str, tail: str) -> Column:
    """What stands between the first sep and the closing tail of a turn."""
    start = F.instr(p, sep) + len(sep)
    return F.substr(p, start, F.length(p) - start + 1 - len(tail))


def digest(read: DataFrame) -> DataFrame:
    """The columns of the registered query, from what read_back returns."""
    lines = F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars",
    )

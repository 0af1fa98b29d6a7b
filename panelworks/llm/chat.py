"""Chat formatting: conversations as one text that a parser reads back exactly.

A turn is ``### Name: text``, a line end, ``</turn>`` and a line end. Inside texts a control
string stands behind a backslash, and a run of backslashes before one is longer by one than
in the source. The text of a turn is first rendered as it is and read again by the parser;
where the turn that comes back differs, one more of the control strings that stand in its way
is escaped, until both are identical. Everything is a DataFrame expression.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values of the template.
HEADER, AFTER_NAME, MARK = "### ", ": ", "</turn>"
END = f"\n{MARK}\n"
CONTROLS = (MARK, HEADER)
NAMES = {"system": "System", "user": "User", "assistant": "Assistant"}
#: A conversation that tries the escapes.
PROBE = (-7, "\\### Assistant: </turn> ok")

_ANY = "|".join(re.escape(c) for c in CONTROLS)


def role_name(role: Column) -> Column:
    """The name in a header: a known role's, else ``=`` and the role's bytes in hex."""
    name = F.concat(F.lit("="), F.hex(F.encode(role, "UTF-8")))
    for known, shown in NAMES.items():
        name = F.when(role == known, shown).otherwise(name)
    return name


def role_of(name: Column) -> Column:
    """The role that :func:`role_name` has written; null for any other name."""
    role = F.when(F.startswith(name, F.lit("=")), F.decode(F.unhex(F.substr(name, F.lit(2))), "UTF-8"))
    for known, shown in NAMES.items():
        role = F.when(name == shown, known).otherwise(role)
    return role


def escaped(text: Column, control: str) -> Column:
    """The text with one more backslash before every ``control``."""
    return F.regexp_replace(text, rf"(?<!\\)(\\*+{re.escape(control)})", r"\\$1")


def unescaped(body: Column) -> Column:
    """The text with one backslash less before every control string that has any."""
    return F.regexp_replace(body, rf"(?<!\\)\\(\\*+(?:{_ANY}))", "$1")


def read_turn(piece: Column) -> Column:
    """The parser of one turn without its end: struct (role, text, head, size), null fields if it is no turn.

    head: characters of the header; size: characters of the body. A header opens the turn, and
    no control string stands in its body but behind a backslash.
    """
    opened = F.substring_index(piece, AFTER_NAME, 1)
    head = F.length(opened) + len(AFTER_NAME)
    body = F.substr(piece, head + 1)
    good = F.startswith(piece, F.lit(HEADER)) & (head <= F.length(piece)) & ~F.rlike(body, F.lit(rf"(?<!\\)(?:{_ANY})"))
    role = role_of(F.substr(opened, F.lit(len(HEADER) + 1)))
    kept = lambda c: F.when(good & role.isNotNull(), c)
    return F.struct(kept(role).alias("role"), kept(unescaped(body)).alias("text"), kept(head).alias("head"), kept(F.length(body)).alias("size"))


def write_turns(turns: DataFrame) -> DataFrame:
    """``head``, ``body``: each row's (role, text) as a header and a body that the parser reads back."""
    out = turns.withColumn("head", F.concat(F.lit(HEADER), role_name(F.col("role")), F.lit(AFTER_NAME))).withColumn("body", F.col("text"))
    for control in CONTROLS:
        # A turn that comes back as it is stays; what is in its way is escaped in the others.
        back = read_turn(F.concat("head", "body"))
        same = F.coalesce((back["role"] == F.col("role")) & (back["text"] == F.col("text")), F.lit(False))
        out = out.withColumn("body", F.when(same, F.col("body")).otherwise(escaped(F.col("body"), control)))
    return out


def digest_of(turns: Column) -> Column:
    """SHA-256 of role, line end, text, line end of every turn."""
    return F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)


def format_conversations(rows: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learned: Sequence[str] = ("assistant",)) -> DataFrame:
    """(key, formatted, spans, source_sha256): a row for each conversation.

    spans: for every turn (start, size, loss): the body's place in ``formatted`` in characters,
    and whether it lies under the loss mask, which it does for the ``learned`` roles. Null roles
    and texts are empty; null keys are one conversation; turns go by turn (nulls first), ties
    by role and text, and repeated rows are turns of their own. An empty table gives an empty
    result, other columns are ignored. A conversation is one row, so it must fit in one.
    """
    turns = rows.select(F.col(key).alias("key_"), F.col(turn).alias("turn_"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    order = W.partitionBy("key_").orderBy("turn_", "role", "text")
    size = F.length("head") + F.length("body") + len(END)
    placed = write_turns(turns).withColumn("at", F.row_number().over(order)).withColumn("ends", F.sum(size).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    start = F.col("ends") - F.length("body") - len(END)
    one = placed.groupBy("key_").agg(F.array_sort(F.collect_list(F.struct("at", "role", "text", "head", "body", start.alias("start")))).alias("turns"))
    written = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    spans = F.transform("turns", lambda t: F.struct(t["start"].alias("start"), F.length(t["body"]).cast("long").alias("size"), t["role"].isin(*learned).alias("loss")))
    return one.select(F.col("key_").alias(key), written.alias("formatted"), spans.alias("spans"), digest_of(F.col("turns")).alias("source_sha256"))


def read_back(formatted: DataFrame, *, key: str = "conv_id") -> DataFrame:
    """(key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from the written texts alone.

    The parser's turns must be those of the source, and every span of the mask a body that the
    parser found in just that place; anything else raises. Loss texts are unescaped one by one.
    """
    pieces = F.split("formatted", END, -1)
    bodies = F.slice(pieces, 1, F.size(pieces) - 1)
    closed = (F.element_at(pieces, -1) == "").alias("closed")
    rows = formatted.select(F.col(key).alias("key_"), "source_sha256", closed, F.length("formatted").cast("long").alias("formatted_chars"), F.posexplode(F.arrays_zip(bodies.alias("piece"), F.col("spans").alias("span"))).alias("at", "z"))
    read = rows.select("key_", "source_sha256", "closed", "formatted_chars", "at", "z.span", F.length("z.piece").alias("chars"), read_turn(F.col("z.piece")).alias("t"))
    before = F.sum(F.col("chars") + len(END)).over(W.partitionBy("key_").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("chars") - len(END)
    placed = read.withColumn("ok", F.col("closed") & (before + F.col("t.head") == F.col("span.start")) & (F.col("t.size") == F.col("span.size")))
    one = placed.groupBy("key_").agg(F.first("source_sha256").alias("source_sha256"), F.first("formatted_chars").alias("formatted_chars"), F.bool_and(F.coalesce("ok", F.lit(False))).alias("ok"), F.array_sort(F.collect_list(F.struct("at", F.col("t.role").alias("role"), F.col("t.text").alias("text"), F.col("span.loss").alias("loss")))).alias("turns"))
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    out = one.select("key_", "source_sha256", "formatted_chars", "ok", F.size("turns").cast("long").alias("n_turns"), digest_of(F.col("turns")).alias("turns_sha256"), loss.alias("loss"))
    same = F.col("ok") & (F.col("turns_sha256") == F.col("source_sha256"))
    checked = F.when(same, F.col("turns_sha256")).otherwise(F.raise_error(F.lit("a conversation does not read back as it was")).cast("string"))
    return out.select(F.col("key_").alias(key), "n_turns", checked.alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def with_probe(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with the two turns of :data:`PROBE`."""
    conv, text = PROBE
    kinds = dict(rows.dtypes)
    probe = rows.sparkSession.range(1).select(F.explode(F.array(*[F.struct(F.lit(conv).cast(kinds["conv_id"]).alias("conv_id"), F.lit(i).cast(kinds["turn"]).alias("turn"), F.lit(r).alias("role"), F.lit(text).alias("text")) for i, r in enumerate(("user", "assistant"))])).alias("r"))
    return rows.select("conv_id", "turn", "role", "text").union(probe.select("r.*"))

"""Chat formatting with a grammar round trip, in DataFrame functions only.

A conversation is one text: for every turn ``### role: body</turn>`` and a line feed. The
parser splits at the end marks, takes the role up to the first ": " and undoes
escapes; it takes no turn whose body shows a control string. A turn is first
written as it is and parsed again alone; where that does not give role and text
back, it is written with escapes (a backslash before each backslash, #, / and, in
roles, colon and blank). Then the whole conversation is parsed and held against its source;
one that differs is written with escapes throughout, and one that would still differ
raises. Turns that need no escape stay readable.

The mask of a conversation is a list of stretches of the formatted text, in code points, with
or without loss; loss lies on the bodies of assistant turns.

Turns are ordered by (turn, role, text), nulls first; repeated rows are turns each. Null role or text is empty. Rows
without conv_id are one conversation without an id. One conversation is one row of the
result, so its turns meet in one task; conversations are independent. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, COLON = "### ", "</turn>", ": "
ASSISTANT = "assistant"


def escaped(text: Column, role: bool = False) -> Column:
    return F.regexp_replace(text, r"([\\#/: ])" if role else r"([\\#/])", r"\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def rendered_turn(role: Column, body: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit(COLON), body, F.lit(END + "\n"))


def parsed(formatted: Column) -> Column:
    """Array of (role, text, header, body) of a formatted text; a null in it is no turn of the grammar.

    ``header`` counts the characters before the body, ``body`` is as it was written.
    """
    pieces = F.split(formatted, rf"\Q{END}\E\n", -1)
    turns = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        at = F.instr(piece, COLON)
        body = F.substr(piece, at + len(COLON))
        role = F.substr(piece, F.lit(len(START) + 1), at - 1 - len(START))
        good = piece.startswith(START) & (at > len(START)) & ~F.contains(body, F.lit("###")) & ~F.contains(body, F.lit(END)) & ~F.contains(role, F.lit("###")) & ~F.contains(role, F.lit(END))
        value = F.struct(unescaped(role).alias("role"), unescaped(body).alias("text"), (at + len(COLON) - 1).alias("header"), body.alias("body"))
        return F.when(good, value)

    return F.when(F.element_at(pieces, -1) == "", F.transform(turns, turn))


def _same(turns: Column, source: Column) -> Column:
    """Whether parsed turns are the source's roles and texts."""
    plain = lambda a: F.transform(a, lambda t: F.struct(t.role.alias("role"), t.text.alias("text")))
    return plain(turns).eqNullSafe(plain(source))


def format_turns(rows: DataFrame, role: str = "role", text: str = "text") -> DataFrame:
    """``_turn`` for each row: source role and text, and the two written forms."""
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    full = rendered_turn(escaped(r, True), escaped(t))
    plain = rendered_turn(r, t)
    back = parsed(plain)
    fits = (F.size(back) == 1) & (back[0].role == r) & (back[0].text == t)
    return rows.withColumn("_turn", F.struct(r.alias("role"), t.alias("text"), F.when(F.coalesce(fits, F.lit(False)), plain).otherwise(full).alias("written"), full.alias("full")))


def format_conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, n_turns, formatted, mask (array of chars, loss) of every conversation."""
    slim = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    turns = format_turns(slim).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("_turn.role").alias("role"), F.col("_turn.text").alias("text"), F.col("_turn.written").alias("written"), F.col("_turn.full").alias("full")))).alias("t"))
    first = turns.withColumn("formatted", F.array_join(F.transform("t", lambda x: x.written), "")).withColumn("back", parsed(F.col("formatted")))
    second = first.withColumn("formatted", F.when(_same(F.col("back"), F.col("t")), F.col("formatted")).otherwise(F.array_join(F.transform("t", lambda x: x.full), "")))
    second = second.withColumn("back", parsed(F.col("formatted")))
    sure = F.when(_same(F.col("back"), F.col("t")), F.col("formatted")).otherwise(F.raise_error(F.concat(F.lit("no round trip: conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))))

    def stretches(x: Column) -> Column:
        loss = F.lower(x.role) == ASSISTANT
        part = lambda n, on: F.struct(n.cast("long").alias("chars"), on.alias("loss"))
        return F.array(part(x.header, F.lit(False)), part(F.char_length(x.body), loss), part(F.lit(len(END) + 1), F.lit(False)))

    return second.select("conv_id", F.size("t").cast("long").alias("n_turns"), sure.alias("formatted"), F.flatten(F.transform("back", stretches)).alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text) and loss_text, from the formatted text and its mask alone."""
    back = formatted.withColumn("back", parsed(F.col("formatted")))
    bodies = F.zip_with("back", F.sequence(F.lit(0), F.size("back") - 1), lambda t, i: F.when(F.col("mask")[i * 3 + 1].loss, unescaped(t.body)).otherwise(F.lit("")))
    loss = F.when(F.size("back") > 0, F.array_join(bodies, "")).otherwise(F.lit(""))
    return back.select("conv_id", F.transform("back", lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))).alias("turns"), loss.alias("loss_text"))

"""Chat formatting by a grammar round trip, with DataFrame functions alone.

Grammar of a formatted conversation::

    conversation := turn*
    turn         := "<|im_start|>" header "\\n" body "<|im_end|>\\n"
    header       := role | escaped role "<|esc|>"

The parser is deterministic: turns begin at every "<|im_start|>", a header ends at the first line end, a body at the first
"<|im_end|>", and nothing but a line end may follow it.  A conversation is rendered as it is, parsed, and compared with its
source.  Where they differ, the turns that don't survive by themselves are escaped and it is parsed again; where that isn't
enough, all turns are escaped.  Escaping is reversible: ``&`` -> ``&amp;``, ``<|`` -> ``&lt;|`` and, in headers, line ends.

Defined cases: null roles and texts are empty; rows without a conv_id are one conversation; turns are ordered by (turn, role,
text), null turns first, so ties and repeated rows have one order; an empty table gives no rows; very long texts are
rendered and parsed whole; other columns are ignored.
A conversation is one row of output, so its turns are brought together; they are rendered and counted nowhere else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, ESCAPED = "<|im_start|>", "<|im_end|>", "<|esc|>"


def _replace(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def escape(c: Column) -> Column:
    return _replace(_replace(c, "&", "&amp;"), "<|", "&lt;|")


def unescape(c: Column) -> Column:
    return _replace(_replace(c, "&lt;|", "<|"), "&amp;", "&")


def escape_header(c: Column) -> Column:
    return _replace(escape(c), "\n", "&#10;")


def unescape_header(c: Column) -> Column:
    return unescape(_replace(c, "&#10;", "\n"))


def render_turn(role: Column, text: Column, escaped: Column) -> Column:
    plain = F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))
    safe = F.concat(F.lit(START), escape_header(role), F.lit(ESCAPED + "\n"), escape(text), F.lit(END + "\n"))
    return F.when(escaped, safe).otherwise(plain)


def parse(formatted: Column) -> Column:
    """array<struct<role, text, escaped, valid, before, chars>>: the turns; ``before`` is the number of characters between the
    body and what precedes the turn, ``chars`` that of the body as it stands."""

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, "\n", 1)
        rest = F.substr(piece, F.char_length(head) + 2)
        body = F.substring_index(rest, END, 1)
        after = F.substr(rest, F.char_length(body) + 1)
        esc = head.endswith(ESCAPED)
        role = F.when(esc, unescape_header(F.substr(head, F.lit(1), F.char_length(head) - len(ESCAPED)))).otherwise(head)
        return F.struct(
            role.alias("role"), F.when(esc, unescape(body)).otherwise(body).alias("text"), esc.alias("escaped"), (after == END + "\n").alias("valid"),
            (F.char_length(head) + len(START) + 1).alias("before"), F.char_length(body).alias("chars"),
        )

    pieces = F.split(formatted, START.replace("|", r"\|"), -1)
    first = F.element_at(pieces, 1)
    return F.when(first == "", F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), turn))


def _recovers(formatted: Column, turns: Column) -> Column:
    got = parse(formatted)
    return F.coalesce(F.forall(got, lambda t: t["valid"]) & (F.transform(got, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))) == turns), F.lit(False))


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, round_trips, parsed (see parse), loss_mask.

    loss_mask is a run-length mask over ``formatted``: for each turn (skip, loss), ``skip`` characters outside the loss and
    then ``loss`` characters in it (0 unless the role is assistant; the next skip has the rest of the turn).
    """
    clean = rows.select("conv_id", F.struct("turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")).alias("t"))
    convs = clean.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    convs = convs.select("conv_id", F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))

    def rendered(escaped) -> Column:
        return F.array_join(F.transform("turns", lambda t: render_turn(t["role"], t["text"], escaped(t))), "")

    def alone(t: Column) -> Column:
        return ~_recovers(render_turn(t["role"], t["text"], F.lit(False)), F.array(t))

    step = convs.withColumn("plain", rendered(lambda t: F.lit(False))).withColumn("plain_ok", _recovers(F.col("plain"), F.col("turns")))
    step = step.withColumn("partly", F.when(~F.col("plain_ok"), rendered(alone)))
    step = step.withColumn("formatted", F.when(F.col("plain_ok"), F.col("plain")).when(_recovers(F.col("partly"), F.col("turns")), F.col("partly")).otherwise(rendered(lambda t: F.lit(True))))
    step = step.select("conv_id", "formatted", _recovers(F.col("formatted"), F.col("turns")).alias("round_trips"), parse(F.col("formatted")).alias("parsed"))
    loss = F.transform("parsed", lambda t: F.struct(t["before"].alias("skip"), F.when(t["role"] == "assistant", t["chars"]).otherwise(0).alias("loss")))
    return step.withColumn("loss_mask", loss)


def digests(formatted: DataFrame) -> DataFrame:
    """Digest columns, read back from the formatted output."""
    whole = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter(F.arrays_zip("parsed", "loss_mask"), lambda x: x["loss_mask"]["loss"] > 0), lambda x: x["parsed"]["text"]), "")
    return formatted.select(
        "conv_id", F.size("parsed").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )

"""Chat formatting of typed content parts, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>\n"
#: What may not stand in a text as it is: this template's opening, and the marks of other common templates.
CONTROL = r"([<\[])(~*)(\||/?s>|/?INST\]|<SYS>>|</SYS>>)"
ESCAPED = r"([<\[])~(~*)(\||/?s>|/?INST\]|<SYS>>|</SYS>>)"
PARTS = "array<struct<kind:string,text:string,ref:string,units:bigint>>"
#: Tokens that one unit (image tile, audio second, document page) expands to.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}


def escape(text: Column) -> Column:
    """A tilde more after the first character of each control string; see unescape."""
    return F.regexp_replace(text, CONTROL, "$1~$2$3")


def unescape(text: Column) -> Column:
    """The exact inverse of escape: a tilde less, and none ever is where escape did not add one."""
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def text_parts(text: Column) -> Column:
    """One text part; a null text is empty."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("units")))


#: While neighbouring texts are escaped as one, a placeholder is OPEN kind CLOSE, and an OPEN of the texts is followed by PLAIN.
OPEN, PLAIN, CLOSE = "\x01", "\x02", "\x03"


def _written_parts(pieces: Column) -> Column:
    """The pieces as one escaped text with its placeholders."""
    marked = F.regexp_replace(escape(F.array_join(pieces, "")), f"{OPEN}([a-z0-9_]*){CLOSE}", "<|$1|>")
    return F.regexp_replace(marked, OPEN + PLAIN, OPEN)


def format_conversations(turns: DataFrame, tokens_per_unit: Mapping[str, int] = TOKENS_PER_UNIT, trained: str = "assistant") -> DataFrame:
    """One row per conv_id from rows (conv_id, turn, role, parts).

    A visitor over each turn's parts writes text parts escaped (neighbouring ones as one text, so that no control
    string arises where they meet) and any other part as a placeholder ``<|kind|>``, and keeps the attachments in
    order: (turn, part, kind, ref, tokens). Returns conv_id, formatted, segments (array of text and loss; joined they
    are ``formatted``), attachments and expanded_tokens. Loss covers what turns of the trained role say.

    Turns are ordered by turn, role, then parts as given, nulls first; repeated rows stay. Null roles, texts and parts
    are empty; an unknown kind is a placeholder of no tokens; an empty table gives no rows; other columns are ignored.
    A conversation is one output row, so it must fit a row; rows are gathered by partial lists before the shuffle.
    """
    per_unit = F.create_map(*(F.lit(x) for kv in tokens_per_unit.items() for x in kv)) if tokens_per_unit else F.create_map().cast("map<string,int>")
    is_text = lambda p: F.coalesce(p["kind"], F.lit("text")) == "text"
    parts = F.coalesce(F.col("parts").cast(PARTS), F.array().cast(PARTS))
    one = turns.select("conv_id", F.struct(F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.transform(parts, lambda p: p.withField("text", F.when(is_text(p), F.coalesce(p["text"], F.lit(""))))).alias("parts")).alias("t"))
    ordered = one.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    body = lambda t: _written_parts(F.transform(t["parts"], lambda p: F.when(is_text(p), F.regexp_replace(p["text"], OPEN, OPEN + PLAIN)).otherwise(F.concat(F.lit(OPEN), F.regexp_replace(F.regexp_replace(p["kind"], r"[^a-z0-9_]", "_"), "^end$", "end_"), F.lit(CLOSE)))))
    attached = lambda t: F.filter(F.transform(t["parts"], lambda p, i: F.struct(t["turn"].alias("turn"), i.alias("part"), p["kind"].alias("kind"), p["ref"].alias("ref"), F.coalesce(p["units"] * F.try_element_at(per_unit, p["kind"]), F.lit(0)).cast("long").alias("tokens"))), lambda a: F.coalesce(a["kind"], F.lit("text")) != "text")
    segments = F.flatten(F.transform("t", lambda t: F.array(
        F.struct(F.concat(F.lit("<|"), escape(F.regexp_replace(t["role"], r"([|%\n]|^end\z)", "%$1")), F.lit("|>\n")).alias("text"), F.lit(False).alias("loss")),
        F.struct(body(t).alias("text"), (t["role"] == trained).alias("loss")),
        F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")),
    )))
    out = ordered.select("conv_id", segments.alias("segments"), F.flatten(F.transform("t", attached)).alias("attachments"))
    return out.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", "attachments", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"))


def read_turns(formatted: Column) -> Column:
    """The turns in a formatted conversation: an array of (role, text), unescaped; placeholders stay as they are."""
    whole = F.filter(F.split(formatted, r"<\|end\|>\n"), lambda s: s != "")
    head = r"(?s)^<\|((?:[^|%]|%.)*)\|>\n(.*)$"
    return F.transform(whole, lambda s: F.struct(F.regexp_replace(unescape(F.regexp_extract(s, head, 1)), r"(?s)%(.)", "$1").alias("role"), unescape(F.regexp_extract(s, head, 2)).alias("text")))


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Read back from format_conversations' output: counts and digests of the turns and of the text under the loss mask."""
    read = formatted.select("conv_id", read_turns(F.col("formatted")).alias("turns"), F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])).alias("said"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    spoken = F.array_join("said", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length(spoken).cast("long").alias("loss_chars"),
        F.sha2(spoken, 256).alias("loss_sha256"),
        "formatted_chars",
    )

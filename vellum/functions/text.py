"""Column functions on text that several jobs share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a trim takes off, and what a reader doesn't see.
WHITE = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WHITE_CHARACTERS = "".join(map(chr, [*range(9, 14), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
UNSEEN = WHITE + r"\x{00}-\x{1F}\x{7F}-\x{9F}\x{AD}\x{34F}\x{600}-\x{605}\x{61C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}\x{FFF0}-\x{FFFB}\x{E0000}-\x{E0FFF}"
FULL_DIGITS = "０１２３４５６７８９"


def trimmed(c: Column | str) -> Column:
    """Without Unicode white space at both ends; null becomes empty."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.coalesce(c, F.lit("")), F.lit(WHITE_CHARACTERS))


def right_trimmed(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITE_CHARACTERS))


def is_blank(c: Column | str) -> Column:
    """No character of it is rendered; null is blank."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.coalesce(c, F.lit("")), f"[{UNSEEN}]", "") == ""


def utf16_length(c: Column) -> Column:
    return F.floor(F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("long")


def utf16_slice(c: Column, start: Column, length: Column) -> Column:
    """``length`` UTF-16 units from ``start``, counted from 0."""
    return F.decode(F.substring(F.encode(c, "UTF-16BE"), (2 * start + 1).cast("int"), (2 * length).cast("int")), "UTF-16BE")


def is_calendar_date(c: Column | str) -> Column:
    """YYYY-MM-DD, and a day that exists."""
    c = F.col(c) if isinstance(c, str) else c
    c = F.coalesce(c, F.lit(""))
    return c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(c, "yyyy-MM-dd").isNotNull()


def plain_digits(c: Column) -> Column:
    return F.translate(c, FULL_DIGITS, "0123456789")

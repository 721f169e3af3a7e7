"""Documents of works as JSON, read as a closed world: unknown fields, kinds, versions and addresses are refused.

A document is flattened into its nodes (the work, its blocks, the inline nodes at each depth), each with its place in reading
order; every node tells its own faults, and the least place of a work is its first violation. One narrow pass makes the nodes,
one exchange by (work, shared name) settles what nodes must agree on, and one by work takes the minimum.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.functions.text import is_blank, is_calendar_date
from vellum.operators.images import HOST
from vellum.sources.scratch import kept

VERSION, DEPTH, SIDE, CHARS = 1, 8, 10_000, 200
# What a document may hold.
WORK_FIELDS = ("schemaVersion", "id", "title", "titleReading", "subtitle", "subtitleReading", "classification", "originalTitle", "firstPublication", "people", "orthography", "provenance", "blocks")
MAY_BE_LEFT_OUT = ("titleReading", "subtitle", "subtitleReading", "classification", "originalTitle", "firstPublication")
ROLES = ("author", "translator", "editor", "reviser", "other")
BREAK_STYLES = ("page", "leaf", "spread", "column")
LEVELS = ("large", "medium", "small")
MARKS = ("sesame", "whiteSesame", "blackCircle", "whiteCircle", "blackTriangle", "whiteTriangle", "bullseye", "fisheye", "saltire", "solid", "double", "dotted", "dashed", "wave")
PLAIN_CONTAINERS = ("strong", "frame", "warichu", "superscript", "subscript", "horizontal", "tcy")
BLOCK_FIELDS = {
    "paragraph": ("kind", "id", "layout", "inline"),
    "heading": ("kind", "id", "level", "layout", "inline"),
    "figure": ("kind", "id", "image", "alt", "size", "caption"),
    "pageCenter": ("kind",),
    "pageBreak": ("kind", "style"),
}
INLINE_FIELDS = {
    "text": ("kind", "text"),
    "note": ("kind", "text"),
    "ruby": ("kind", "base", "reading"),
    "emphasis": ("kind", "mark", "side", "children"),
    "size": ("kind", "direction", "step", "children"),
    "gaiji": ("kind", "description", "image"),
    "image": ("kind", "image", "alt", "size"),
    **{kind: ("kind", "children") for kind in PLAIN_CONTAINERS},
}
LAYOUT_FIELDS = {"none": ("kind",), "indent": ("kind", "chars"), "end": ("kind", "inset"), "hanging": ("kind", "indent", "first")}
PICTURE = r"\.(png|jpe?g|gif)\z"

FAULT = "struct<path:string,message:string>"
OBJECT = "map<string,variant>"
NODE = ("at", "path", "depth", "ruby", "v")  # ruby: the path of the ruby that a node stands under
LIST = 8  # where a node's own list stands among its rules


def _object(v: Column) -> Column:
    return F.try_variant_get(v, "$", OBJECT)


def _field(m: Column, key: str) -> Column:
    return F.try_element_at(m, F.lit(key))


def _type(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit(""))


def _string(v: Column) -> Column:
    """The text of a variant that is a string, else null."""
    return F.when(_type(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _whole(v: Column) -> Column:
    """The value of a number without a fraction (2.0 is 2), else null."""
    number = F.try_variant_get(v, "$", "double")
    return F.when(_type(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & (number == F.floor(number)), number)


def _fault(sound: Column, path: Column, message: str) -> Column:
    return F.when(~F.coalesce(sound, F.lit(False)), F.struct(path.alias("path"), F.lit(message).alias("message")))


def _under(path: Column, *keys: str) -> Column:
    return F.concat(path, F.lit("".join(f".{k}" for k in keys)))


def _only(m: Column, path: Column, allowed: Column) -> Column:
    """A fault for the first field, by name, that isn't allowed."""
    unknown = F.get(F.array_sort(F.array_except(F.map_keys(m), allowed)), F.lit(0))
    return F.when(unknown.isNotNull(), F.struct(F.concat(path, F.lit("."), unknown).alias("path"), F.lit("unknown field").alias("message")))


def _names(names) -> Column:
    return F.array(*map(F.lit, names))


def _table(fields: dict) -> Column:
    return F.create_map(*(x for kind, names in fields.items() for x in (F.lit(kind), _names(names))))


def _record(m: Column, path: Column, names) -> Column:
    return F.coalesce(_fault(m.isNotNull(), path, "not an object"), _only(m, path, _names(names)))


def _text(m: Column, path: Column, key: str, empty: bool = False) -> Column:
    s = _string(_field(m, key))
    return _fault(s.isNotNull() if empty else s != "", _under(path, key), "not a text" if empty else "not a filled text")


def _seen(m: Column, path: Column, key: str) -> Column:
    return F.coalesce(_text(m, path, key), _fault(~is_blank(_string(_field(m, key))), _under(path, key), "only white space"))


def _number(m: Column, path: Column, key: str, least: int, most: int) -> Column:
    return _fault(_whole(_field(m, key)).between(least, most), _under(path, key), f"not a whole number from {least} to {most}")


def _one_of(m: Column, path: Column, key: str, allowed) -> Column:
    return _fault(_string(_field(m, key)).isin(*allowed), _under(path, key), "not an allowed value")


def _list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _filled(m: Column, path: Column, key: str, empty: bool = False) -> Column:
    items = _list(_field(m, key))
    return _fault(items.isNotNull() if empty else F.size(items) > 0, _under(path, key), "not a list" if empty else "not a filled list")


def _address(folder: str) -> str:
    return f"^{re.escape(HOST)}{folder}"


GLYPH = _address(r"/gaiji/[A-Za-z0-9_./-]+") + PICTURE
PLATE = _address(r"/cards/([0-9]{6})/files/[A-Za-z0-9_.-]+") + PICTURE
CARD = _address(r"/cards/([0-9]{6})/card([0-9]{1,6})\.html\z")
FILE = _address(r"/cards/([0-9]{6})/files/([0-9]{1,6})(?:_[A-Za-z0-9_.-]+)?\.(?:html|txt|zip)\z")


def _url(m: Column, path: Column, key: str, pattern: str) -> Column:
    """In canonical form: no dot segment, no escape, nothing after the path."""
    s = _string(_field(m, key))
    return F.coalesce(_text(m, path, key), _fault(s.rlike(pattern) & ~s.rlike(r"/\.{1,2}(/|\z)"), _under(path, key), "not an allowed address"))


def _picture(m: Column, path: Column, pattern: str) -> Column:
    image, at = _object(_field(m, "image")), _under(path, "image")
    return F.coalesce(_record(image, at, ("url",)), _url(image, at, "url", pattern))


def _sizes(m: Column, path: Column) -> Column:
    size, at = _object(_field(m, "size")), _under(path, "size")
    return F.coalesce(_record(size, at, ("width", "height")), _number(size, at, "width", 1, SIDE), _number(size, at, "height", 1, SIDE))


def _kind_of(m: Column, path: Column, kind: Column, fields: dict) -> Column:
    return F.coalesce(_fault(m.isNotNull(), path, "not an object"), _fault(kind.isin(*fields), _under(path, "kind"), "unknown kind"), _only(m, path, F.try_element_at(_table(fields), kind)))


def _layout(path: Column) -> Column:
    own, kind, at = F.col("layout"), F.col("layout_kind"), _under(path, "layout")
    rules = (
        F.when(kind == "indent", _number(own, at, "chars", 1, CHARS)).when(kind == "end", _number(own, at, "inset", 0, CHARS))
        .when(kind == "hanging", F.coalesce(_number(own, at, "indent", 1, CHARS), _number(own, at, "first", 0, CHARS)))
    )
    return F.coalesce(_kind_of(own, at, kind, LAYOUT_FIELDS), rules)


def _owned(m: Column, path: Column, key: str, pattern: str, work: Column) -> Column:
    """An address of the work itself: numbers are compared as digits without leading zeros."""
    number = F.regexp_extract(_string(_field(m, key)), pattern, 2)
    return F.coalesce(_url(m, path, key, pattern), _fault(F.ltrim(number, F.lit("0")) == F.ltrim(work, F.lit("0")), _under(path, key), "of another work"))


def _provenance(m: Column, work: Column) -> Column:
    at = F.lit("$.provenance")
    p = _object(_field(m, "provenance"))
    rights, source, converter = (_object(_field(p, k)) for k in ("copyright", "source", "converter"))
    here = {k: _under(at, k) for k in ("copyright", "source", "converter", "bibliography")}
    card, file = (_string(_field(source, k)) for k in ("cardUrl", "fileUrl"))
    lines = _list(_field(p, "bibliography"))
    line = F.transform(lines, lambda x, i: _fault(~is_blank(_string(x)), F.concat(here["bibliography"], F.lit("["), i.cast("string"), F.lit("]")), "not a visible text"))
    return F.coalesce(
        _record(p, at, here),
        _record(rights, here["copyright"], ("work",)),
        _fault(_string(_field(rights, "work")) == "なし", _under(here["copyright"], "work"), "not free"),
        _record(source, here["source"], ("cardUrl", "fileUrl", "upstreamUpdated")),
        _text(source, here["source"], "upstreamUpdated"),
        _fault(is_calendar_date(_string(_field(source, "upstreamUpdated"))), _under(here["source"], "upstreamUpdated"), "not a date"),
        _record(converter, here["converter"], ("version", "path")),
        _text(converter, here["converter"], "version"),
        _fault(_string(_field(converter, "version")).rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\z"), _under(here["converter"], "version"), "not a version"),
        _owned(source, here["source"], "cardUrl", CARD, work),
        _owned(source, here["source"], "fileUrl", FILE, work),
        _fault(F.regexp_extract(card, CARD, 1) == F.regexp_extract(file, FILE, 1), _under(here["source"], "fileUrl"), "of another person"),
        _one_of(converter, here["converter"], "path", ("xhtml", "text")),
        _fault(F.endswith(file, F.lit(".html")) == (_string(_field(converter, "path")) == "xhtml"), _under(here["converter"], "path"), "of another file"),
        _filled(p, at, "bibliography"),
        F.get(F.array_compact(line), F.lit(0)),
    )


def _person(v: Column, i: Column) -> Column:
    m, at = _object(v), F.concat(F.lit("$.people["), i.cast("string"), F.lit("]"))
    reading = F.when(F.map_contains_key(m, "reading"), _text(m, at, "reading"))
    return F.coalesce(_record(m, at, ("role", "name", "reading")), _one_of(m, at, "role", ROLES), _text(m, at, "name"), reading)


def _header(m: Column) -> list[tuple[int, Column]]:
    """Rules of the work's own fields with their places; 3 is the list of blocks, 4 what blocks must agree on, 9 whose pictures they show."""
    root, work = F.lit("$"), _string(_field(m, "id"))
    people = F.transform(_list(_field(m, "people")), _person)
    given = [F.when(F.map_contains_key(m, k), _text(m, root, k)) for k in MAY_BE_LEFT_OUT]
    lone = F.map_contains_key(m, "subtitleReading") & ~F.map_contains_key(m, "subtitle")
    return [
        (1, _only(m, root, _names(WORK_FIELDS))),
        (2, F.coalesce(_text(m, root, "id"), _fault(work.rlike(r"^[0-9]{6}\z"), F.lit("$.id"), "not six digits"))),
        (3, _filled(m, root, "blocks")),
        (5, _text(m, root, "title")),
        (6, F.coalesce(_filled(m, root, "people"), F.get(F.array_compact(people), F.lit(0)))),
        (7, _text(m, root, "orthography")),
        (8, _provenance(m, work)),
        (10, F.coalesce(*given)),
        (11, _fault(~lone, F.lit("$.subtitleReading"), "without subtitle")),
    ]


def _block(m: Column, path: Column, kind: Column) -> list[tuple[int, Column]]:
    identified = F.when(kind.isin("paragraph", "heading", "figure"), _text(m, path, "id"))
    own = (
        F.when(kind == "heading", _one_of(m, path, "level", LEVELS))
        .when(kind == "figure", F.coalesce(_picture(m, path, PLATE), _text(m, path, "alt", empty=True), _sizes(m, path)))
        .when(kind == "pageBreak", _one_of(m, path, "style", BREAK_STYLES))
    )
    own = F.coalesce(own, F.when(kind.isin("paragraph", "heading"), _layout(path)))
    held = F.when(kind == "figure", _filled(m, path, "caption", empty=True)).when(kind.isin("paragraph", "heading"), _filled(m, path, "inline", empty=True))
    return [(0, F.coalesce(_kind_of(m, path, kind, BLOCK_FIELDS), identified, own)), (LIST, held)]


def _inline(m: Column, path: Column, kind: Column, depth: Column, ruby: Column) -> list[tuple[int, Column]]:
    placed = F.coalesce(_fault(depth <= DEPTH, path, "nested too deeply"), _fault((kind != "ruby") | kind.isNull() | ruby.isNull(), path, "ruby under a ruby"))
    own = (
        F.when(kind.isin("text", "note"), _text(m, path, "text"))
        .when(kind == "emphasis", F.coalesce(_one_of(m, path, "mark", MARKS), _one_of(m, path, "side", ("right", "left"))))
        .when(kind == "size", F.coalesce(_number(m, path, "step", 1, 5), _one_of(m, path, "direction", ("larger", "smaller"))))
        .when(kind == "gaiji", F.coalesce(_seen(m, path, "description"), _picture(m, path, GLYPH)))
        .when(kind == "image", F.coalesce(_picture(m, path, PLATE), _text(m, path, "alt", empty=True), _sizes(m, path)))
    )
    held = F.when(kind == "ruby", _filled(m, path, "base")).when(kind.isin("emphasis", "size", *PLAIN_CONTAINERS), _filled(m, path, "children"))
    return [(0, F.coalesce(placed, _kind_of(m, path, kind, INLINE_FIELDS), own)), (LIST, held), (LIST + 2, F.when(kind == "ruby", _seen(m, path, "reading")))]


def _nodes_of(items: Column, at: Column, path: Column, depth: Column, ruby: Column, place: int = LIST) -> Column:
    """Nodes made of a list's items."""
    step = lambda i: F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
    return F.transform(items, lambda v, i: F.struct(F.concat(at, F.array(F.lit(place), i)).alias("at"), step(i).alias("path"), depth.alias("depth"), ruby.alias("ruby"), v.alias("v")))


def _all_under(nodes: Column, depth: int) -> Column:
    """Nodes of a depth, and after each all that it holds, to one level more than may be."""
    if depth > DEPTH:
        return nodes

    def held(n: Column) -> Column:
        kind = F.try_variant_get(n["v"], "$.kind", "string")
        items = F.when(kind == "ruby", F.try_variant_get(n["v"], "$.base", "array<variant>")).when(kind.isin("emphasis", "size", *PLAIN_CONTAINERS), F.try_variant_get(n["v"], "$.children", "array<variant>"))
        path = F.concat(n["path"], F.when(kind == "ruby", ".base").otherwise(".children"))
        return _nodes_of(items, n["at"], path, F.lit(depth + 1), F.when(kind == "ruby", n["path"]).otherwise(n["ruby"]))

    return F.flatten(F.transform(nodes, lambda n: F.concat(F.array(n), F.coalesce(_all_under(held(n), depth + 1), _no_nodes()))))


def _no_nodes() -> Column:
    return F.array().cast("array<struct<at:array<int>,path:string,depth:int,ruby:string,v:variant>>")


def _flattened(docs: DataFrame) -> DataFrame:
    """(work_id, folder, at, path, depth, ruby, v): the work at depth -1, its blocks at 0, inline nodes from 1 on.

    One generator gives the blocks, and one a block and all its inline nodes, so that nodes are made in one pass without exchange."""
    none, no_ruby = F.array().cast("array<int>"), F.lit(None).cast("string")
    root = F.struct(none.alias("at"), F.lit("$").alias("path"), F.lit(-1).alias("depth"), no_ruby.alias("ruby"), F.col("v").alias("v"))
    blocks = _nodes_of(F.try_variant_get("v", "$.blocks", "array<variant>"), none, F.lit("$.blocks"), F.lit(0), no_ruby, 3)
    folder = F.regexp_extract(F.coalesce(F.try_variant_get("v", "$.provenance.source.fileUrl", "string"), F.lit("")), FILE, 1)
    # read before the generator: above it, the whole document would be read again for each block
    first = docs.select("work_id", folder.alias("folder"), F.concat(F.array(root), F.coalesce(blocks, _no_nodes())).alias("nodes"))
    rows = first.select("work_id", "folder", F.explode("nodes").alias("n")).select("work_id", "folder", "n.*")
    kind = F.try_variant_get("v", "$.kind", "string")
    of_block = lambda key: _nodes_of(F.try_variant_get("v", f"$.{key}", "array<variant>"), F.col("at"), _under(F.col("path"), key), F.lit(1), F.col("ruby"))
    inline = F.when(F.col("depth") == 0, F.when(kind.isin("paragraph", "heading"), of_block("inline")).when(kind == "figure", of_block("caption")))
    own = F.array(F.struct(*NODE))
    return rows.select("work_id", "folder", F.explode(F.concat(own, F.coalesce(_all_under(inline, 1), _no_nodes()))).alias("n")).select("work_id", "folder", "n.*")


def document_faults(texts: DataFrame) -> DataFrame:
    """(work_id, code, path, message): the first violation of each text that is no sound document; sound ones have no row.

    texts: (work_id, json). ``code`` is ``unreadable`` (no JSON, a null text, or one name twice in an object),
    ``unsupported-version`` or ``invalid``. Faults come in reading order: fields in the order of the format, a list's items
    before the fields after it. Of several unknown fields of an object the first by name is told. Numbers such as 2.0 are
    whole. A work_id that comes twice is one work, whose first fault of either text is told."""
    parsed = texts.select("work_id", F.try_parse_json("json").alias("v"))
    version = F.when(_object(F.col("v")).isNotNull(), _whole(F.try_variant_get("v", "$.schemaVersion", "variant")))
    code = F.when(F.col("v").isNull(), "unreadable").when(_object(F.col("v")).isNull(), "invalid").when(~F.coalesce(version == VERSION, F.lit(False)), "unsupported-version")
    nodes = _flattened(parsed.withColumn("code", code).where("code IS NULL"))
    m, path, kind, depth = (F.col(c) for c in ("m", "path", "kind", "depth"))
    by_level = {-1: _header(m), 0: _block(m, path, kind), 1: _inline(m, path, kind, depth, F.col("ruby"))}
    level = F.least(depth, F.lit(1))
    fact = lambda what, name, at, fault: F.struct(F.lit(what).alias("what"), name.alias("name"), at.alias("at"), fault.cast(FAULT).alias("fault"))
    place = lambda n: F.concat("at", F.array(F.lit(n)))
    agreed = lambda n: F.concat(F.array(F.lit(n)), F.slice("at", 2, 1 << 20))
    seen = F.when(kind == "text", ~is_blank(_string(_field(m, "text")))).otherwise(kind.isin("gaiji", "image"))
    shown = F.regexp_extract(F.coalesce(_string(_field(_object(_field(m, "image")), "url")), F.lit("")), PLATE, 1)
    told = lambda at, text: F.struct(at.alias("path"), F.lit(text).alias("message"))
    facts = [F.when((level == own) & fault.isNotNull(), fact("fault", path, place(n), fault)) for own, rules in by_level.items() for n, fault in rules]
    facts += [
        F.when((level == 0) & kind.isin("paragraph", "heading", "figure"), fact("id", F.concat(F.lit("#"), _string(_field(m, "id"))), agreed(4), told(_under(path, "id"), "repeated"))),
        F.when((level == 1) & (kind == "ruby"), fact("needs", path, place(LIST + 1), told(_under(path, "base"), "nothing visible"))),
        F.when((level == 1) & F.col("ruby").isNotNull() & seen, fact("shows", F.col("ruby"), place(0), F.lit(None))),
        F.when((level >= 0) & kind.isin("figure", "image") & (shown != F.col("folder")), fact("fault", path, agreed(9), told(_under(path, "image", "url"), "not a file of this work"))),
    ]
    # a node's object, kind and layout are read once, before the rules
    read = nodes.withColumn("m", _object(F.col("v"))).withColumn("kind", _string(_field(F.col("m"), "kind")))
    read = read.withColumn("layout", F.when((depth == 0) & kind.isin("paragraph", "heading"), _object(_field(m, "layout")))).withColumn("layout_kind", _string(_field(F.col("layout"), "kind")))
    rows = read.select("work_id", F.explode(F.array_compact(F.array(*facts))).alias("f")).select("work_id", "f.*")
    same = Window.partitionBy("work_id", "name")
    ranked = rows.withColumn("n", F.row_number().over(same.orderBy("what", "at"))).withColumn("shown", F.max(F.col("what") == "shows").over(same))
    # an ID's name holds IDs alone, so its rows are numbered by place
    broken = (F.col("what") == "fault") | ((F.col("what") == "id") & (F.col("n") > 1) & F.col("name").isNotNull()) | ((F.col("what") == "needs") & ~F.col("shown"))
    invalid = ranked.where(broken).groupBy("work_id").agg(F.min(F.struct("at", "fault")).alias("x")).select("work_id", F.lit("invalid").alias("code"), "x.fault.path", "x.fault.message")
    unread = kept(parsed.withColumn("code", code).where("code IS NOT NULL").groupBy("work_id").agg(F.min("code").alias("code")))
    whole = F.when(F.col("code") == "invalid", "not an object")
    told_whole = unread.select("work_id", "code", F.when(F.col("code") == "invalid", "$").alias("path"), whole.alias("message"))
    return reduce(DataFrame.unionByName, [told_whole, invalid.join(unread.select("work_id"), "work_id", "left_anti")])

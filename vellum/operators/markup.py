"""Pages as flat node tables, and what can be asked of them: active content, sections, lines, ruby, classes, pictures.

Pages are (page_id, html). A scanner reads tags and text in order after comments and the insides of script and style
are taken out; names, sections and classes are parameters.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.functions.text import is_blank, trimmed
from vellum.operators.images import allowed_url

#: Elements and attributes that load or run something, and the classes that carry meaning.
ACTIVE = ["script", "style", "iframe", "frame", "frameset", "object", "embed", "applet", "form", "input", "button", "select", "textarea", "link", "meta", "base", "noscript", "template", "svg", "math", "audio", "video", "canvas"]
CODE = ["script", "style"]
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "frame"]
URL_ATTRIBUTES = ["href", "src", "action", "formaction", "data", "xlink:href", "poster"]
TEXT_ATTRIBUTES = ["value", "alt", "title", "placeholder", "label", "aria-label", "srcdoc"]
EMPHASIS = {"sesame_dot": "sesame", "white_sesame_dot": "whiteSesame", "black_circle": "blackCircle", "white_circle": "whiteCircle", "black_up-pointing_triangle": "blackTriangle", "white_up-pointing_triangle": "whiteTriangle", "bullseye": "bullseye", "fisheye": "fisheye", "saltire": "saltire"}
SPANS = {"futoji": "strong", "keigakomi": "frame", "warichu": "warichu"}
HEADINGS = {"o-midashi": "large", "naka-midashi": "medium", "ko-midashi": "small"}
SECTIONS = {"article": "main", "footer": "bibliography", "nav": "ignored", "head": "ignored"}
#: Classes of div elements that are sections of their own outside of these.
SIDE = ("ad",)
BLOCK_ENDS = ["p", "div", "h1", "h2", "h3", "h4", "h5", "li", "article"]
TAG = "^</?([A-Za-z][A-Za-z0-9:-]*)"
#: Tags, in which a quoted value may hold the closing sign, and text.
TOKEN = r"""<(?:[^<>"']++|"[^"]*+"|'[^']*+')*+>|<[^>]*>|[^<]+"""
#: A name after white space or a slash, with a value in either kind of quotes, without quotes, or without a value.
ATTRIBUTE = r"""[\s/]([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?"""


def masked(html: Column) -> Column:
    """Without comments and without what script and style hold."""
    plain = F.regexp_replace(F.coalesce(html, F.lit("")), "(?s)<!--.*?-->", "")
    return F.regexp_replace(plain, r"(?is)(<(script|style)\b[^>]*>).*?</(script|style)\s*>", "$1</$2>")


def html_nodes(pages: DataFrame, deepest: int = 64) -> DataFrame:
    """(page_id, node_no, kind, tag, depth, token, code): tags and text in order; too deep a page is a fault.

    Kinds: open, void, close, text, other. Depth counts open elements before the node; void tags open nothing."""
    parts = pages.select("page_id", F.posexplode(F.regexp_extract_all(masked(F.col("html")), F.lit(TOKEN), F.lit(0))).alias("node_no", "token"))
    tag = F.lower(F.regexp_extract("token", TAG, 1))
    t = parts.withColumn("tag", tag)
    kind = F.when(~F.startswith("token", F.lit("<")), "text").when(F.col("tag") == "", "other").when(F.startswith("token", F.lit("</")), "close").when(F.col("tag").isin(VOID) | F.endswith("token", F.lit("/>")), "void").otherwise("open")
    t = t.withColumn("kind", kind)
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    depth = F.coalesce(F.sum(step).over(Window.partitionBy("page_id").orderBy("node_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return t.withColumn("depth", depth).select("page_id", "node_no", "kind", "tag", "depth", "token", F.when(F.col("depth") > deepest, "unsupported-construct").alias("code"))


def active_content(nodes: DataFrame) -> DataFrame:
    """(page_id, tag, n): active elements."""
    return nodes.where(F.col("kind").isin("open", "void") & F.col("tag").isin(ACTIVE)).groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


def attributes(nodes: DataFrame) -> DataFrame:
    """(page_id, node_no, tag, name, value): the attributes of tags, however they are quoted; without a value it is empty."""
    groups = [F.regexp_extract_all("token", F.lit(ATTRIBUTE), F.lit(g)) for g in range(1, 5)]
    each = nodes.where(F.col("kind").isin("open", "void")).select("page_id", "node_no", "tag", F.explode(F.arrays_zip(*(g.alias(f"g{i}") for i, g in enumerate(groups, 1)))).alias("a"))
    return each.select("page_id", "node_no", "tag", F.lower("a.g1").alias("name"), F.concat(*(F.coalesce(f"a.g{i}", F.lit("")) for i in (2, 3, 4))).alias("value"))


def active_attributes(nodes: DataFrame) -> DataFrame:
    """(page_id, node_no, name): handlers, and URL attributes whose scheme runs code; white space and controls inside a
    scheme count for nothing, as in browsers."""
    a = attributes(nodes)
    runs = F.col("name").isin(URL_ATTRIBUTES) & F.regexp_replace("value", "[\\x00-\\x20]", "").rlike("(?i)^(javascript|data|vbscript):")
    return a.where(F.startswith("name", F.lit("on")) | runs).select("page_id", "node_no", "name")


def active_with_text(nodes: DataFrame) -> DataFrame:
    """(page_id, code): pages where an active element holds visible text or text attributes, so it can't just be dropped."""
    opens = F.col("tag").isin([t for t in ACTIVE if t not in CODE and t not in VOID])
    inside = F.sum(F.when(opens & (F.col("kind") == "open"), 1).when(opens & (F.col("kind") == "close"), -1).otherwise(0)).over(Window.partitionBy("page_id").orderBy("node_no").rowsBetween(Window.unboundedPreceding, -1))
    text = nodes.withColumn("inside", inside).where((F.col("kind") == "text") & (F.col("inside") > 0) & ~is_blank("token")).select("page_id")
    named = attributes(nodes).where(F.col("tag").isin(ACTIVE) & F.col("name").isin(TEXT_ATTRIBUTES) & ~is_blank("value")).select("page_id")
    return text.unionByName(named).distinct().withColumn("code", F.lit("active-content"))


def _matched(nodes: DataFrame, tags: list[str]) -> DataFrame:
    """(page_id, node_no, kind, tag, token, end): the tags of ``tags`` in order; end is where what an open tag opens is closed.

    A tag closes the last one of its name that is open. Opens and closes of one name and level take turns, so the next
    of an open one is its own; a close without its open is left out."""
    some = nodes.where(F.col("tag").isin(tags) & F.col("kind").isin("open", "close")).select("page_id", "node_no", "kind", "tag", "token")
    step = F.when(F.col("kind") == "open", 1).otherwise(-1)
    order = Window.partitionBy("page_id", "tag").orderBy("node_no")
    level = F.sum(step).over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.when(F.col("kind") == "close", 1).otherwise(0)
    turn = Window.partitionBy("page_id", "tag", "level").orderBy("node_no")
    each = some.withColumn("level", level).withColumn("_kind", F.lead("kind").over(turn)).withColumn("_no", F.lead("node_no").over(turn))
    return each.withColumn("end", F.when((F.col("kind") == "open") & (F.col("_kind") == "close"), F.col("_no"))).select("page_id", "node_no", "kind", "tag", "token", "end")


def html_sections(nodes: DataFrame, sections: Mapping[str, str] = SECTIONS, side: tuple[str, ...] = SIDE) -> DataFrame:
    """nodes with their section: that of the innermost section element that is open, ``ignored`` for a div of a class of
    ``side``, else null.

    A section ends where its own element does, whatever is nested in it; after an inner one the outer goes on. An element
    that is never closed counts up to the next start or end of a section. An opening tag is in its section, a closing one outside.
    """
    name = F.coalesce(*(F.when(F.col("tag") == t, s) for t, s in sections.items()))
    aside = (F.col("tag") == "div") & F.regexp_extract("token", r"""\sclass\s*=\s*["']?([^\s"'>]*)""", 1).isin(*side)
    opens = _matched(nodes, [*sections, "div"]).where("kind = 'open'").withColumn("name", F.coalesce(name, F.when(aside, "ignored"))).where("name IS NOT NULL")
    both = F.array(F.struct(F.col("node_no").alias("at"), F.lit(1).alias("step")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("step")))
    events = opens.select("page_id", "name", "end", F.explode(both).alias("e")).select("page_id", "name", "end", "e.*").where("at IS NOT NULL")
    upto = Window.partitionBy("page_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    counted = F.when(F.col("end").isNotNull(), F.col("step")).otherwise(0)
    leveled = events.withColumn("level", F.sum(counted).over(upto) + F.when(F.col("step") == -1, 1).otherwise(0))
    # a section that ends asks for the last one opened a level above it, if that is open still
    outer = F.last(F.when((F.col("step") == 1) & F.col("end").isNotNull(), F.struct("name", "end")), ignorenulls=True).over(Window.partitionBy("page_id", "slot").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    slots = leveled.withColumn("slot", F.when(F.col("step") == 1, F.col("level")).otherwise(F.col("level") - 1)).withColumn("outer", outer)
    after = F.when(F.col("step") == 1, F.col("name")).otherwise(F.coalesce(F.when(F.col("outer.end") > F.col("at"), F.col("outer.name")), F.lit("")))
    marks = slots.select("page_id", F.col("at").alias("node_no"), after.alias("_mark"))
    order = Window.partitionBy("page_id").orderBy("node_no").rowsBetween(Window.unboundedPreceding, 0)
    return nodes.join(marks, ["page_id", "node_no"], "left").withColumn("section", F.nullif(F.last("_mark", ignorenulls=True).over(order), F.lit(""))).drop("_mark").select(*nodes.columns, "section")


def section_faults(nodes: DataFrame, sections: Mapping[str, str] = SECTIONS, side: tuple[str, ...] = SIDE) -> DataFrame:
    """(page_id, code): pages without exactly one main section and one bibliography, or with elements of no known section
    or text outside of all sections. Active elements are looked for elsewhere."""
    s = html_sections(nodes, sections, side)
    opened = lambda name: F.count_if((F.col("kind") == "open") & F.col("tag").isin([t for t, n in sections.items() if n == name]))
    outside = F.col("section").isNull()
    unknown = outside & F.col("kind").isin("open", "void") & ~F.col("tag").isin("html", "body", *ACTIVE)
    per = s.groupBy("page_id").agg(opened("main").alias("main"), opened("bibliography").alias("bib"), F.count_if(unknown).alias("unknown"), F.count_if((F.col("kind") == "text") & outside & ~is_blank("token")).alias("outside"))
    code = F.when((F.col("main") == 0) | (F.col("bib") == 0), "missing-section").when((F.col("main") > 1) | (F.col("bib") > 1), "unsupported-construct").when(F.col("unknown") > 0, "unknown-section").when(F.col("outside") > 0, "text-outside")
    return per.select("page_id", code.alias("code")).where("code IS NOT NULL")


def section_lines(nodes: DataFrame, section: str, ends: list[str]) -> DataFrame:
    """(page_id, line_no, line): the text of a section by lines, which end at br, hr and the ends of ``ends``; blank ones go."""
    inside = html_sections(nodes).where(F.col("section") == section)
    stop = F.when(F.col("tag").isin("br", "hr") | ((F.col("kind") == "close") & F.col("tag").isin(ends)), 1)
    numbered = inside.withColumn("line_no", F.count(stop).over(Window.partitionBy("page_id").orderBy("node_no").rowsBetween(Window.unboundedPreceding, -1)))
    texts = numbered.where("kind = 'text'").groupBy("page_id", "line_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_no", "token"))), lambda x: x["token"]), "").alias("line"))
    return texts.where(~is_blank("line")).select("page_id", "line_no", trimmed("line").alias("line"))


def html_lines(nodes: DataFrame) -> DataFrame:
    return section_lines(nodes, "main", BLOCK_ENDS)


def html_bibliography(nodes: DataFrame) -> DataFrame:
    return section_lines(nodes, "bibliography", [])


def html_ruby(pages: DataFrame) -> DataFrame:
    """(page_id, n, base, reading, code): ruby elements, in any case and with any attributes; each needs exactly one base
    and one reading, and neither may be blank."""
    inside = lambda t: f"(?is)<{t}(?:\\s[^>]*)?>(.*?)</{t}\\s*>"
    each = pages.select("page_id", F.posexplode(F.regexp_extract_all(masked(F.col("html")), F.lit(inside("ruby")), F.lit(1))).alias("n", "r"))
    bases, readings = (F.regexp_extract_all("r", F.lit(inside(t)), F.lit(1)) for t in ("rb", "rt"))
    strip = lambda c: F.regexp_replace(F.coalesce(F.get(c, F.lit(0)), F.lit("")), "<[^>]*>", "")
    wrong = (F.size(bases) != 1) | (F.size(readings) != 1) | is_blank(strip(bases)) | is_blank(strip(readings))
    return each.select("page_id", "n", strip(bases).alias("base"), strip(readings).alias("reading"), F.when(wrong, "ruby-base").alias("code"))


def html_class_map(nodes: DataFrame, watched: tuple[str, ...] = ("em", "span", "h3", "h4", "h5")) -> DataFrame:
    """(page_id, node_no, tag, class, family, name, code): what a class means: emphasis and side, container, size,
    heading or layout; a class of watched tags without meaning is ``unknown-class``."""
    c = attributes(nodes).where("name = 'class'").where(F.col("tag").isin(*watched, "div")).withColumnRenamed("value", "class")
    pick = lambda names, x: F.coalesce(*(F.when(x == k, v) for k, v in names.items()))
    cls = F.col("class")
    dot = pick(EMPHASIS, F.regexp_replace(cls, "_after$", ""))
    line = F.regexp_extract(cls, "^(?:underline|overline)_(solid|double|dotted|dashed|wave)$", 1)
    span, heading = pick(SPANS, cls), pick(HEADINGS, cls)
    size, layout = F.regexp_extract(cls, "^((?:dai|sho)[1-5])$", 1), F.regexp_extract(cls, "^((?:jisage|chitsuki)_[0-9]{1,3}|burasage)$", 1)
    side = F.when(F.endswith(cls, F.lit("_after")) | F.startswith(cls, F.lit("overline")), "left").otherwise("right")
    em = F.col("tag") == "em"
    family = F.when(em & (dot.isNotNull() | (line != "")), "emphasis").when((F.col("tag") == "span") & span.isNotNull(), "container").when((F.col("tag") == "span") & (size != ""), "size").when(F.col("tag").isin("h3", "h4", "h5") & heading.isNotNull(), "heading").when((F.col("tag") == "div") & (layout != ""), "layout")
    name = F.when(family == "emphasis", F.concat_ws("/", F.coalesce(dot, F.nullif(line, F.lit(""))), side)).when(family == "container", span).when(family == "size", size).when(family == "heading", heading).when(family == "layout", layout)
    return c.select("page_id", "node_no", "tag", "class", family.alias("family"), name.alias("name"), F.when(family.isNull() & F.col("tag").isin(*watched), "unknown-class").alias("code"))


def html_images(nodes: DataFrame, host: str = "https://library.example", most_side: int = 10_000) -> DataFrame:
    """(page_id, node_no, kind, src, alt, width, height, code): pictures; a glyph needs a description and its directory,
    an illustration whole sizes of at most ``most_side``; other hosts are faults."""
    img = nodes.where("tag = 'img' AND kind = 'void'")
    groups = [F.regexp_extract_all("token", F.lit(ATTRIBUTE), F.lit(g)) for g in range(1, 5)]
    img = img.withColumn("names", F.transform(groups[0], F.lower)).withColumn("values", F.zip_with(F.zip_with(groups[1], groups[2], lambda a, b: F.concat(a, b)), groups[3], lambda a, b: F.concat(a, b)))
    get = lambda a: F.coalesce(F.try_element_at("values", F.nullif(F.array_position("names", F.lit(a)), F.lit(0)).cast("int")), F.lit(""))
    kind = F.when(get("class") == "gaiji", "gaiji").otherwise("illustration")
    size = lambda a: F.when(get(a).rlike("^[1-9][0-9]{0,4}$") & (F.coalesce(get(a).try_cast("int"), F.lit(0)) <= most_side), get(a).try_cast("int"))
    code = F.when(~allowed_url(get("src"), host), "external-image").when((kind == "gaiji") & ((get("alt") == "") | ~F.startswith(get("src"), F.lit(f"{host}/gaiji/"))), "unknown-notation").when((kind == "illustration") & (size("width").isNull() | size("height").isNull()), "invalid-image")
    return img.select("page_id", "node_no", kind.alias("kind"), get("src").alias("src"), get("alt").alias("alt"), size("width").alias("width"), size("height").alias("height"), code.alias("code"))

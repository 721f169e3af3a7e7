"""Annotated lines as flat tables: tokens, ruby, glyphs, spans, headings, layouts, figures, sections, blocks and faults.

All jobs take lines (work_id, no, line). Notes stand as ［＃…］, readings as 《…》, a bar ｜ opens a ruby base, and ※
before a note makes it a glyph. Nesting deeper than open and close pairs is checked, not rebuilt.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.functions.text import WHITE as BLANK
from vellum.functions.text import is_blank, plain_digits, right_trimmed, trimmed, utf16_length
from vellum.sources.scratch import kept

#: The notation's marks and their names.
DOTS = {
    "傍点": "sesame", "白ゴマ傍点": "whiteSesame", "丸傍点": "blackCircle", "白丸傍点": "whiteCircle", "黒三角傍点": "blackTriangle", "白三角傍点": "whiteTriangle", "二重丸傍点": "bullseye",
    "蛇の目傍点": "fisheye", "ばつ傍点": "saltire", "傍線": "solid", "二重傍線": "double", "鎖線": "dotted", "破線": "dashed", "波線": "wave",
}
CONTAINERS = {"太字": "strong", "罫囲み": "frame", "割り注": "warichu", "行右小書き": "superscript", "上付き小文字": "superscript", "行左小書き": "subscript", "下付き小文字": "subscript", "縦中横": "tcy", "横組み": "horizontal"}
HEADINGS = {"大見出し": "large", "中見出し": "medium", "小見出し": "small"}
BREAKS = {"改ページ": "page", "改丁": "leaf", "改見開き": "spread", "改段": "column"}
#: Fixed values too: the characters that a reading belongs to without a bar, the marks of a text's parts, and the forms of notes below.
KANJI = "㐀-䶿一-鿿豈-﫿々〆〇ヶ\\x{20000}-\\x{3FFFF}"
ALPHA = r"\p{IsLatin}\p{IsGreek}\p{IsCyrillic}"
LEGEND, END_MARK, BASE_MARK = "【テキスト中に現れる記号について】", "［＃本文終わり］", "底本："

TOKEN = "※?［＃[^］]*］|《[^》]*》|｜|[^［《》｜※]+|[［※《》]"
_any = lambda names: "(" + "|".join(names) + ")"
#: What a note is: the first that matches. Groups are used by the jobs below.
NOTES = {
    "emphasis": f"^「(.+)」(の左)?に{_any(DOTS)}$",
    "emphasis-open": f"^(左に)?{_any(DOTS)}$",
    "emphasis-close": f"^(左に)?{_any(DOTS)}終わり$",
    "container": f"^「(.+)」(は){_any(CONTAINERS)}$",
    "container-open": f"^(){_any(CONTAINERS)}$",
    "container-close": f"^(){_any(CONTAINERS)}終わり$",
    "heading": f"^「(.+)」(は){_any(HEADINGS)}$",
    "heading-open": f"^(){_any(HEADINGS)}$",
    "heading-close": f"^(){_any(HEADINGS)}終わり$",
    "break": f"^{_any(BREAKS)}$",
    "center": "^ページの左右中央$",
    "indent": "^(天から)?([０-９0-9]+)字下げ$",
    "end": "^地(付き|から([０-９0-9]+)字上げ)$",
    "range-hanging": "^ここから([０-９0-9]+字下げ|改行天付き)、折り返して([０-９0-9]+)字下げ$",
    "range-indent": "^ここから([０-９0-9]+)字下げ$",
    "range-end": "^ここから地(付き|から([０-９0-9]+)字上げ)$",
    "close-indent": "^ここで字下げ終わり$",
    "close-end": "^ここで(地付き|字上げ|地から[０-９0-9]+字上げ)終わり$",
    "caption": "^「(.+)」はキャプション$",
    "caption-open": "^キャプション$",
    "caption-close": "^キャプション終わり$",
    "editorial": "^(「.+」は底本では「.+」|ルビの「.+」は底本では「.+」|「.+」はママ)$",
    "image": "^(.*)（([^、（）]+\\.(png|jpg|gif))(、横([0-9]+)×縦([0-9]+))?）入る$",
    "main-end": "^本文終わり$",
}


def note_kind(inner: Column) -> Column:
    # most lines are no note, and no form of a note is empty
    return F.when(inner == "", "unknown").otherwise(F.coalesce(*(F.when(inner.rlike(p), k) for k, p in NOTES.items()), F.lit("unknown")))


def named(label: Column, names: dict[str, str]) -> Column:
    return F.coalesce(*(F.when(label == k, v) for k, v in names.items()))


def visible_text(line: Column) -> Column:
    """Bases stay, readings, bars and notes go, glyphs and pictures are one object character each."""
    glyphs = F.regexp_replace(line, "※［＃[^］]*］", "￼")
    pictures = F.regexp_replace(glyphs, "［＃[^］]*入る］", "￼")
    return F.regexp_replace(pictures, "［＃[^］]*］|《[^》]*》|｜", "")


def tokenize_lines(lines: DataFrame) -> DataFrame:
    """(work_id, no, token_no, kind, text, col, at, line): tokens in order; ``unclosed`` is a sign without its other half.

    col is the token's first UTF-16 unit, at its first code point. Kinds: text, note, ruby, bar, gaiji, unclosed."""
    parts = lines.select("work_id", "no", "line", F.posexplode(F.regexp_extract_all("line", F.lit(TOKEN), F.lit(0))).alias("token_no", "tok"))
    order = Window.partitionBy("work_id", "no").orderBy("token_no")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    before, at = (F.coalesce(F.sum(n).over(upto), F.lit(0)) for n in (utf16_length(F.col("tok")), F.char_length("tok").cast("long")))
    following = F.coalesce(F.lead("tok").over(order), F.lit(""))
    tok = F.col("tok")
    kind = (
        F.when(tok.startswith("※［＃"), "gaiji").when(tok.startswith("［＃"), "note").when(tok == "｜", "bar").when(tok.isin("《", "》"), "unclosed")
        .when(tok.startswith("《"), "ruby").when((tok == "［") & following.startswith("＃"), "unclosed").otherwise("text")
    )
    inner = F.regexp_replace(tok, "^※?［＃|］$|^《|》$", "")
    return parts.select("work_id", "no", "token_no", kind.alias("kind"), F.when(kind.isin("gaiji", "note", "ruby"), inner).otherwise(tok).alias("text"), before.alias("col"), at.alias("at"), "line")


def ruby_pairs(tokens: DataFrame) -> DataFrame:
    """(work_id, no, n, col, base, reading, code): readings with their bases: after a bar, or the kanji or letters before.

    ``ruby-base`` marks one without base, or with a blank reading or one that holds marks."""
    before = F.expr("substring(line, 1, CAST(at AS INT))")
    base = F.coalesce(*(F.nullif(F.regexp_extract(before, p, 1), F.lit("")) for p in ("｜([^《｜]+)$", f"([{KANJI}]+)$", f"([{ALPHA}]+)$")), F.lit(""))
    n = F.row_number().over(Window.partitionBy("work_id", "no").orderBy("token_no")) - 1
    wrong = (F.col("base") == "") | is_blank("reading") | F.col("reading").rlike("［＃|｜|※|《")
    pairs = tokens.where("kind = 'ruby'").select("work_id", "no", n.alias("n"), "col", base.alias("base"), F.col("text").alias("reading"))
    return pairs.withColumn("code", F.when(wrong, "ruby-base"))


def gaiji_refs(tokens: DataFrame, host: str = "https://library.example") -> DataFrame:
    """(work_id, no, token_no, description, url, character, code): a picture by plane, row and cell; a character by
    code point; neither for a page and line alone; anything else is ``unknown-notation``."""
    jis = "^(?:第([34])水準)?([0-9])-([0-9]{1,2})-([0-9]{1,2})$"
    two = lambda n: F.lpad(n.cast("string"), 2, "0")

    def read(parts: Column) -> Column:
        last = F.element_at(parts, -1)
        numbers = {name: F.coalesce(F.regexp_extract(last, jis, i).try_cast("int"), F.lit(0)).alias(name) for i, name in enumerate(("level", "plane", "row", "cell"), 1)}
        codes = F.filter(parts, lambda p: p.rlike("^U\\+[0-9A-F]{4,6}$"))
        many = F.size(codes) + F.size(F.filter(parts, lambda p: p.rlike(jis))) > 1
        bare = (F.size(parts) == 2) & (F.get(parts, F.lit(0)) != "") & last.rlike("^[0-9]+-[0-9]+$")
        return F.struct(*numbers.values(), last.rlike(jis).alias("placed"), F.get(codes, F.lit(0)).alias("point"), F.size(codes).alias("points"), many.alias("many"), bare.alias("bare"))

    def told(x: Column) -> Column:
        fits = x["plane"].isin(1, 2) & ((x["level"] == 0) | (x["level"] == x["plane"] + 2)) & x["row"].between(1, 94) & x["cell"].between(1, 94)
        point = F.conv(F.substring(x["point"], 3, 6), 16, 10).cast("long")
        sound = (point <= 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
        char = F.when(sound, F.decode(F.unhex(F.lpad(F.substring(x["point"], 3, 6), 8, "0")), "UTF-32"))
        plane = x["plane"].cast("string")
        url = F.concat(F.lit(f"{host}/gaiji/"), plane, F.lit("-"), two(x["row"]), F.lit("/"), plane, F.lit("-"), two(x["row"]), F.lit("-"), two(x["cell"]), F.lit(".png"))
        picture, letter = ~x["many"] & x["placed"] & fits, ~x["many"] & ~x["placed"] & (x["points"] == 1) & F.coalesce(~is_blank(char), F.lit(False))
        return F.struct(F.when(picture, url).alias("url"), F.when(letter, char).alias("character"), F.when(~picture & ~letter & ~x["bare"], "unknown-notation").alias("code"))

    # a lambda's variable holds what is read of a glyph, as every rule asks for it again
    each = F.transform(F.transform(F.array(F.split("text", "、")), read), told)[0]
    return tokens.where("kind = 'gaiji'").select("work_id", "no", "token_no", F.col("text").alias("description"), *(each[c].alias(c) for c in ("url", "character", "code")))


def _signs(tokens: DataFrame) -> DataFrame:
    """The tokens that may be faults, without texts and bars; note and before are those of notes_of."""
    before = visible_text(F.expr("substring(line, 1, CAST(at AS INT))"))
    of_note = lambda c: F.when(F.col("kind") == "note", c)
    return tokens.where(F.col("kind").isin("note", "gaiji", "ruby", "unclosed")).withColumn("note", of_note(note_kind(F.col("text")))).withColumn("before", of_note(before))


def notes_of(tokens: DataFrame) -> DataFrame:
    """The note tokens with what they are and the visible text before them on their line."""
    if "before" in tokens.columns:  # signs, which are told already
        return tokens.where("kind = 'note'").select("work_id", "no", "token_no", "col", "at", "line", F.col("text").alias("inner"), "note", "before")
    before = visible_text(F.expr("substring(line, 1, CAST(at AS INT))"))
    return tokens.where("kind = 'note'").select("work_id", "no", "token_no", "col", "at", "line", F.col("text").alias("inner"), note_kind(F.col("text")).alias("note"), before.alias("before"))


def _between(next_at: str = "next_at") -> Column:
    """The visible text between a note and a later one on its line."""
    return visible_text(F.expr(f"substring(line, CAST(at AS INT) + length(inner) + 4, CAST({next_at} AS INT) - CAST(at AS INT) - length(inner) - 3)"))


def _after(note: str = "inner", at: str = "at") -> Column:
    """The rest of the line after a note."""
    return F.expr(f"substring(line, CAST({at} AS INT) + length({note}) + 4)")


def _spans(notes: DataFrame, kind: str, names: dict[str, str]) -> DataFrame:
    trailing = notes.where(F.col("note") == kind)
    g = lambda i: F.regexp_extract("inner", NOTES[kind], i)
    one = trailing.select("work_id", "no", "token_no", "col", F.lit("trailing").alias("form"), named(g(3), names).alias("mark"), F.when(g(2) == "の左", "left").otherwise("right").alias("side"), g(1).alias("text"), F.when(~F.endswith("before", g(1)), "unknown-notation").alias("code"))
    pairs = notes.where(F.col("note").isin(f"{kind}-open", f"{kind}-close")).withColumn("name", F.regexp_extract(F.regexp_replace("inner", "終わり$", ""), NOTES[f"{kind}-open"], 2)).withColumn("left", F.startswith("inner", F.lit("左に")))
    following = Window.partitionBy("work_id", "no", "name", "left").orderBy("token_no")
    nxt = pairs.withColumn("next_note", F.lead("note").over(following)).withColumn("next_at", F.lead("at").over(following)).where(F.col("note") == f"{kind}-open")
    closed = F.coalesce(F.col("next_note") == f"{kind}-close", F.lit(False))
    two = nxt.select("work_id", "no", "token_no", "col", F.lit("pair").alias("form"), named(F.col("name"), names).alias("mark"), F.when(F.col("left"), "left").otherwise("right").alias("side"), F.when(closed, _between()).otherwise("").alias("text"), F.when(~closed, "unclosed-notation").alias("code"))
    return one.unionByName(two)


def emphasis_spans(notes: DataFrame) -> DataFrame:
    """(work_id, no, token_no, form, mark, side, text, code): 14 marks, trailing (their text must stand before) or as pairs."""
    return _spans(notes, "emphasis", DOTS).drop("col")


def container_spans(notes: DataFrame) -> DataFrame:
    return _spans(notes, "container", CONTAINERS).drop("side", "col")


def headings(notes: DataFrame) -> DataFrame:
    """(work_id, no, form, level, text, code): see placed_headings."""
    return placed_headings(notes).drop("col")


def placed_headings(notes: DataFrame) -> DataFrame:
    """(work_id, no, col, form, level, text, code): headings, by a note after the line's whole text or between two notes.

    A heading is all of its line: text before its opening note, another text than the note says, or anything but white
    space after it is ``unsupported-construct``; an opening without its close ``unclosed-notation``."""
    g = lambda i: F.regexp_extract("inner", NOTES["heading"], i)
    wrong = lambda broken: F.when(broken, "unsupported-construct")
    one = notes.where("note = 'heading'").select("work_id", "no", "col", F.lit("trailing").alias("form"), named(g(3), HEADINGS).alias("level"), g(1).alias("text"), wrong((F.col("before") != g(1)) | ~is_blank(_after())).alias("code"))
    order = Window.partitionBy("work_id", "no").orderBy("token_no")
    some = notes.where(F.col("note").isin("heading-open", "heading-close"))
    for c in ("note", "inner", "at"):
        some = some.withColumn(f"next_{c}", F.lead(c).over(order))
    some = some.withColumn("nth", F.row_number().over(order)).where("note = 'heading-open'")
    closed = F.coalesce(F.col("next_inner") == F.concat("inner", F.lit("終わり")), F.lit(False))
    code = F.coalesce(wrong((F.col("before") != "") | (F.col("nth") > 1)), F.when(~closed, "unclosed-notation"), wrong(~is_blank(_after("next_inner", "next_at"))))
    return one.unionByName(some.select("work_id", "no", "col", F.lit("pair").alias("form"), named(F.col("inner"), HEADINGS).alias("level"), F.when(closed, _between()).otherwise("").alias("text"), code.alias("code")))


def page_breaks(lines: DataFrame) -> DataFrame:
    """(work_id, no, kind, style): lines that are a break or page-centre note and nothing else."""
    inner = F.regexp_extract("line", "^［＃([^］]*)］$", 1)
    style = named(inner, BREAKS)
    return lines.select("work_id", "no", F.when(style.isNotNull(), "pageBreak").when(inner == "ページの左右中央", "pageCenter").alias("kind"), style.alias("style")).where("kind IS NOT NULL")


def _number(c: Column) -> Column:
    return F.coalesce(F.nullif(plain_digits(c), F.lit("")).cast("int"), F.lit(0))


#: What a leading note says of its line; a second one there is a fault.
LEADING = "^［＃([^］]*)］(?:［＃([^］]*)］)?"


def _own_layout(line: Column) -> tuple[Column, Column, Column]:
    """(layout, chars, whether there are two) of a line's leading notes."""
    inner, second = F.regexp_extract(line, LEADING, 1), F.regexp_extract(line, LEADING, 2)
    indent, end = F.regexp_extract(inner, NOTES["indent"], 2), F.regexp_extract(inner, NOTES["end"], 1)
    layout = F.when(indent != "", "indent").when(end != "", "end")
    chars = F.when(indent != "", _number(indent)).when(end != "", _number(F.regexp_extract(inner, NOTES["end"], 2)))
    return layout, chars, layout.isNotNull() & (second.rlike(NOTES["indent"]) | second.rlike(NOTES["end"]))


def line_layout(lines: DataFrame) -> DataFrame:
    """(work_id, no, layout, chars, code): what a leading note says of its line; inside an open range, or twice, it is a fault."""
    return laid_out(lines).where("own_layout IS NOT NULL").select("work_id", "no", F.col("own_layout").alias("layout"), F.col("own_chars").alias("chars"), F.col("own_code").alias("code"))


def image_notes(notes: DataFrame, files: DataFrame) -> DataFrame:
    """(work_id, no, kind, alt, url, width, height): pictures; a figure stands alone on its line. files: (work_id, file_url)."""
    g = lambda i: F.regexp_extract("inner", NOTES["image"], i)
    alone = F.col("line") == F.concat(F.lit("［＃"), "inner", F.lit("］"))
    j = notes.where("note = 'image'").join(files, "work_id")
    return j.select("work_id", "no", F.when(alone, "figure").otherwise("inline").alias("kind"), g(1).alias("alt"), F.concat(F.regexp_replace("file_url", "[^/]+$", ""), g(2)).alias("url"), F.nullif(g(5), F.lit("")).cast("int").alias("width"), F.nullif(g(6), F.lit("")).cast("int").alias("height"))


def editorial_notes(notes: DataFrame) -> DataFrame:
    return notes.where("note = 'editorial'").select("work_id", "no", "token_no", "inner")


def unknown_notation(notes: DataFrame, lines: DataFrame) -> DataFrame:
    """(work_id, line, column, code): notes of no known form, and bracketed letters with accents."""
    accent = "〔[^〔〕]*[A-Za-z][^〔〕]*〕"
    place = utf16_length(F.regexp_extract("line", f"(?s)^(.*?){accent}", 1))
    one = notes.where("note = 'unknown'").select("work_id", F.col("no").alias("line"), F.col("col").alias("column"), F.lit("unknown-notation").alias("code"))
    return one.unionByName(lines.where(F.col("line").rlike(accent)).select("work_id", F.col("no").alias("l"), place.alias("column"), F.lit("unknown-notation").alias("code")).withColumnRenamed("l", "line"))


def span_pairs(notes: DataFrame) -> DataFrame:
    """(work_id, no, col, code): lines whose open and close notes don't pair up in stack order, enclose nothing, or nest
    too deep, with the place of the first such note."""
    base = F.regexp_replace("inner", "終わり$", "")
    some = notes.where(F.col("note").rlike("-(open|close)$") & ~F.col("note").isin("close-indent", "close-end")).select("work_id", "no", F.struct("token_no", "col", F.when(F.endswith("note", F.lit("-open")), F.lit(1)).otherwise(-1).alias("step"), base.alias("name")).alias("t"))
    per_line = some.groupBy("work_id", "no").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    fault = lambda code, col: F.struct(col.alias("col"), code.alias("code"))
    none = F.lit(None).cast("struct<col:bigint,code:string>")
    start = F.struct(F.array().cast("array<struct<name:string,col:bigint>>").alias("stack"), F.lit(-2).alias("last"), none.alias("fault"))

    def step(s, t):
        top = F.when(F.size(s["stack"]) > 0, F.element_at(s["stack"], -1)["name"])
        opened = F.struct(F.concat(s["stack"], F.array(F.struct(t["name"].alias("name"), t["col"].alias("col")))).alias("stack"), t["token_no"].alias("last"), F.when(F.size(s["stack"]) >= 7, fault(F.lit("unsupported-construct"), t["col"])).otherwise(none).alias("fault"))
        code = F.when(~F.coalesce(top == t["name"], F.lit(False)), F.lit("unclosed-notation")).when(s["last"] == t["token_no"] - 1, F.lit("unsupported-construct"))
        shut = F.struct(F.slice(s["stack"], 1, F.greatest(F.size(s["stack"]) - 1, F.lit(0))).alias("stack"), F.lit(-2).alias("last"), F.when(code.isNotNull(), fault(code, t["col"])).otherwise(none).alias("fault"))
        return F.when(s["fault"].isNotNull(), s).when(t["step"] == 1, opened).otherwise(shut)

    end = F.aggregate("ts", start, step)
    left = F.when(F.size(end["stack"]) > 0, fault(F.lit("unclosed-notation"), F.element_at(end["stack"], -1)["col"]))
    return per_line.select("work_id", "no", F.coalesce(end["fault"], left).alias("f")).where("f IS NOT NULL").select("work_id", "no", "f.col", "f.code")


def laid_out(lines: DataFrame) -> DataFrame:
    """lines with what ranges and leading notes say of each: inner and note (of a line that is a note alone), layout,
    chars and code (of ranges), own_layout, own_chars and own_code (of the line's leading notes).

    One window over the work serves all of it."""
    lines = lines.withColumn("inner", F.regexp_extract("line", "^［＃([^］]*)］$", 1)).withColumn("note", note_kind(F.col("inner")))
    inner, kind = F.col("inner"), F.col("note")
    mark = F.when(kind.isin("range-indent", "range-hanging", "range-end"), F.substring(kind, 7, 10)).when(kind.isin("close-indent", "close-end"), kind)
    size = F.when(kind == "range-indent", _number(F.regexp_extract(inner, NOTES["range-indent"], 1))).when(kind == "range-hanging", _number(F.regexp_extract(inner, NOTES["range-hanging"], 2))).otherwise(_number(F.regexp_extract(inner, NOTES["range-end"], 2)))
    order = Window.partitionBy("work_id").orderBy("no")
    m = lines.withColumn("mark", mark).withColumn("size", F.when(F.col("mark").isNotNull(), size))
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    before = F.last("mark", ignorenulls=True).over(upto)
    m = m.withColumn("before", before).withColumn("carried", F.last("size", ignorenulls=True).over(upto)).withColumn("last_mark", F.max(F.when(F.col("mark").isNotNull(), F.col("no"))).over(Window.partitionBy("work_id")))
    opened = F.coalesce(F.col("before").isin("indent", "hanging", "end"), F.lit(False))
    opens = F.col("mark").isin("indent", "hanging", "end")
    overlap = opens & opened & ~((F.col("mark") != "end") & F.col("before").isin("indent", "hanging"))
    unopened = (F.col("mark") == "close-indent") & ~F.coalesce(F.col("before").isin("indent", "hanging"), F.lit(False)) | (F.col("mark") == "close-end") & ~F.coalesce(F.col("before") == "end", F.lit(False))
    left = opens & (F.col("no") == F.col("last_mark"))
    code = F.when(overlap, "unsupported-construct").when(unopened | left, "unclosed-notation")
    inside = F.col("mark").isNull() & opened
    layout, chars, twice = _own_layout(F.col("line"))
    own = {"own_layout": layout, "own_chars": chars, "own_code": F.when(layout.isNotNull() & (opened | twice), "unsupported-construct")}
    return m.select("work_id", "no", "line", "inner", "note", F.when(inside, F.col("before")).alias("layout"), F.when(inside, F.col("carried")).alias("chars"), code.alias("code"), *(c.alias(n) for n, c in own.items()))


def carry_ranges(lines: DataFrame) -> DataFrame:
    """(work_id, no, layout, chars, code): the layout each line takes from a range that is open there.

    An indent replaces an open indent; other overlaps, closes without their open and ranges left open are faults,
    on the line of the note."""
    return laid_out(lines).select("work_id", "no", "layout", "chars", "code")


def split_sections(lines: DataFrame) -> DataFrame:
    """(work_id, no, section): header, body or bibliography of each line; works without them are in section_faults."""
    p = _section_places(lines)
    return lines.join(p.where("code IS NULL"), "work_id").select("work_id", "no", F.when(F.col("no") <= F.col("second"), "header").when(F.col("no") < F.col("stop"), "body").when(F.col("no") < F.col("rest"), "mark").otherwise("bibliography").alias("section"))


def section_faults(lines: DataFrame) -> DataFrame:
    return _section_places(lines).where("code IS NOT NULL").select("work_id", "code")


def _section_places(lines: DataFrame) -> DataFrame:
    dash = F.col("line").rlike("^-{20,}$")
    is_mark = lambda mark: F.contains("line", F.lit(mark)) & (trimmed("line") == mark)
    dashes = lines.groupBy("work_id").agg(F.array_sort(F.collect_list(F.when(dash, F.col("no")))).alias("d"), F.collect_list(F.when(is_mark(LEGEND), F.col("no"))).alias("legend"), F.array_sort(F.collect_list(F.when(is_mark(END_MARK), F.col("no")))).alias("ends"), F.array_sort(F.collect_list(F.when(F.startswith("line", F.lit(BASE_MARK)), F.col("no")))).alias("bases"))
    second = F.get("d", F.lit(1))
    after = lambda c: F.filter(c, lambda n: n > F.col("second"))
    p = dashes.withColumn("second", second).withColumn("legend_ok", F.array_contains("legend", F.get("d", F.lit(0)) + 1)).withColumn("ends", after("ends")).withColumn("bases", after("bases"))
    n_ends, n_bases = F.size("ends"), F.size("bases")
    code = F.when(F.col("second").isNull() | ~F.col("legend_ok"), "missing-section").when((n_ends > 1) | ((n_ends == 0) & (n_bases > 1)), "unsupported-construct").when((n_ends == 0) & (n_bases == 0), "missing-section")
    stop = F.coalesce(F.get("ends", F.lit(0)), F.get("bases", F.lit(0)))
    return p.select("work_id", "second", stop.alias("stop"), F.when(n_ends > 0, stop + 1).otherwise(stop).alias("rest"), code.alias("code"))


def bibliography(lines: DataFrame) -> DataFrame:
    """(work_id, n, line): the lines after the end of the body, right-trimmed, blank ones dropped, in order."""
    s = split_sections(lines).where("section = 'bibliography'").join(lines, ["work_id", "no"])
    some = s.select("work_id", "no", right_trimmed(F.col("line")).alias("line")).where("line <> ''")
    return some.select("work_id", F.row_number().over(Window.partitionBy("work_id").orderBy("no")).alias("n"), "line")


FIGURE = "^［＃[^］]*（[^（）]*）入る］$"


def attach_captions(lines: DataFrame) -> DataFrame:
    """(work_id, figure_no, no, caption, code): see placed_captions."""
    return placed_captions(laid_out(lines)).drop("col")


def placed_captions(rows: DataFrame) -> DataFrame:
    """(work_id, figure_no, no, col, caption, code) from laid_out's rows: captions, by a note after their text or between two notes, with the
    figure's line directly before. Captions elsewhere, in a layout, or with text around them are faults."""
    return _told_captions(_with_figures(rows).where(_captioned()))


def _captioned() -> Column:
    return F.regexp_extract("line", "［＃([^］]*)］$", 1).rlike(NOTES["caption"]) | F.contains("line", F.lit("［＃キャプション］"))


def _with_figures(rows: DataFrame) -> DataFrame:
    """laid_out's rows with the line before each: its number, and whether it is a figure's."""
    order = Window.partitionBy("work_id").orderBy("no")
    return rows.withColumn("figure", F.coalesce(F.lag(F.col("line").rlike(FIGURE)).over(order), F.lit(False))).withColumn("figure_no", F.lag("no").over(order))


def _told_captions(rows: DataFrame) -> DataFrame:
    j = rows.withColumn("last", F.regexp_extract("line", "［＃([^］]*)］$", 1))
    pair = F.contains("line", F.lit("［＃キャプション］"))
    whole = "^［＃キャプション］(.*)［＃キャプション終わり］(.*)$"
    laid = F.col("layout").isNotNull() | F.col("own_layout").isNotNull()
    code = F.when(pair & F.startswith("line", F.lit("［＃キャプション］")) & ~F.col("line").rlike(whole), "unclosed-notation").when(laid | ~F.col("figure") | (pair & (~F.col("line").rlike(whole) | ~is_blank(F.regexp_extract("line", whole, 2)))), "unsupported-construct")
    caption = F.when(pair, visible_text(F.regexp_extract("line", whole, 1))).otherwise(F.regexp_extract("last", NOTES["caption"], 1))
    place = utf16_length(F.when(pair, F.substring_index("line", "［＃キャプション］", 1)).otherwise(F.regexp_extract("line", "^(.*)［＃[^］]*］$", 1)))
    return j.select("work_id", F.when(code.isNull(), F.col("figure_no")).alias("figure_no"), "no", place.alias("col"), caption.alias("caption"), code.alias("code"))


def to_blocks(lines: DataFrame) -> DataFrame:
    """(work_id, no, kind, level, layout, chars, text): one block per line; notes that are lines of their own give breaks,
    figures or ranges; an empty line is an empty paragraph. A line is read once, in one window over its work."""
    rows = laid_out(lines)
    inner = F.col("inner")
    levels = {k: f"［＃「.+」は{k}］[{BLANK}]*$|^(?:［＃[^］]*］)?［＃{k}］.*［＃{k}終わり］[{BLANK}]*$" for k in HEADINGS}
    level = F.coalesce(*(F.when(F.col("line").rlike(levels[k]), v) for k, v in HEADINGS.items()))
    kind = F.when(inner.rlike(NOTES["break"]), "pageBreak").when(inner.rlike(NOTES["center"]), "pageCenter").when(inner.rlike(NOTES["image"]), "figure").when(level.isNotNull(), "heading").otherwise("paragraph")
    j = rows.withColumn("kind", kind).withColumn("level", level).where(~inner.rlike("|".join(p for k, p in NOTES.items() if k.startswith(("range-", "close-")))))
    text = F.when(F.col("kind").isin("pageBreak", "pageCenter"), "").otherwise(visible_text(F.col("line")))
    return j.select("work_id", "no", "kind", "level", F.coalesce("own_layout", "layout").alias("layout"), F.when(F.col("own_layout").isNotNull(), F.col("own_chars")).otherwise(F.col("chars")).alias("chars"), text.alias("text"))


def has_visible(lines: DataFrame) -> DataFrame:
    """(work_id, no, visible): whether a reader sees anything of an annotated line: glyphs and pictures count, notes and readings don't."""
    return lines.select("work_id", "no", (~is_blank(visible_text(F.col("line")))).alias("visible"))


#: What each code says of a work.
MESSAGES = {
    "unknown-notation": "a note, glyph or accent of no known form, or a note whose text isn't before it", "unclosed-notation": "a sign, pair of notes or range lacks its other half",
    "unsupported-construct": "notes overlap, nest too deep, enclose nothing or stand where they can't", "ruby-base": "a reading without a base, or a reading that can't be read", "missing-section": "the text lacks its header, end or bibliography",
}


def line_faults(lines: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """(work_id, line, column, code): all faults of notation in annotated lines, for first_failure: signs without their other
    half, glyphs, readings, pairs of notes, emphasis, containers, headings, layouts, ranges, captions, unknown notes and
    accents. tokens: the lines' tokens, if they are there already. Notes are told apart once, and these are a table.

    A fault of a note stands at the note; what a line's leading notes or a range do wrong, at the line's start."""
    signs = kept(_signs(tokenize_lines(lines) if tokens is None else tokens))
    notes = notes_of(signs)
    place = lambda df, col: df.where("code IS NOT NULL").select("work_id", F.col("no").alias("line"), col.cast("long").alias("column"), "code")
    unclosed = signs.where("kind = 'unclosed'").withColumn("code", F.lit("unclosed-notation"))
    glyphs = gaiji_refs(signs).where("code IS NOT NULL").join(signs.where("kind = 'gaiji'").select("work_id", "no", "token_no", "col"), ["work_id", "no", "token_no"])
    # one pass over the lines' layouts; only lines with a fault or a caption are kept
    rows = kept(_with_figures(laid_out(lines)).where(F.col("own_code").isNotNull() | F.col("code").isNotNull() | _captioned()))
    # a line's own layout and its part in a range are both told by one row
    ranges = rows.select("work_id", "no", F.explode(F.array("own_code", "code")).alias("code"), F.lit(0).alias("col"))
    # a pair that isn't closed is told by span_pairs, at the note that breaks the order
    mine = ~((F.col("form") == "pair") & (F.col("code") == "unclosed-notation"))
    spans = (*(df.where(mine) for df in (_spans(notes, "emphasis", DOTS), _spans(notes, "container", CONTAINERS), placed_headings(notes))), _told_captions(rows.where(_captioned())))
    faulty = (unclosed, glyphs, ruby_pairs(signs), span_pairs(notes), ranges, *spans)
    return reduce(DataFrame.unionByName, (place(df, F.col("col")) for df in faulty), unknown_notation(notes, lines))


def work_faults(lines: DataFrame) -> DataFrame:
    """The same of whole texts: a work without its sections has that fault, at line -1; of the others the body's lines count."""
    places = kept(_section_places(lines))
    body = kept(lines.join(places.where("code IS NULL").select("work_id", "second", "stop"), "work_id").where("no > second AND no < stop").select(*lines.columns))
    whole = places.where("code IS NOT NULL").select("work_id", F.lit(-1).alias("line"), F.lit(0).cast("long").alias("column"), "code")
    return line_faults(body).unionByName(whole)

"""Documents as a closed world: against a plain reading, one fault at a time and on documents broken at random."""

import copy
import json
import random
import re
from datetime import date

from vellum.functions.text import UNSEEN
from vellum.operators import documents as d

BLANK = re.compile("[" + re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: re.escape(chr(int(m[1], 16))), UNSEEN) + "]")


class Broken(Exception):
    pass


def plain(text):  # noqa: C901
    """(code, path, message) of a text's first fault, read from the top, or None."""

    def once(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError
        return dict(pairs)

    def fail(path, message):
        raise Broken(path, message)

    def record(v, path, names):
        if not isinstance(v, dict):
            fail(path, "not an object")
        for k in sorted(v):
            if k not in names:
                fail(f"{path}.{k}", "unknown field")
        return v

    def text_of(v, key, path, empty=False):
        if not isinstance(v.get(key), str) or (not empty and v[key] == ""):
            fail(f"{path}.{key}", "not a text" if empty else "not a filled text")
        return v[key]

    def seen(v, key, path):
        if not BLANK.sub("", text_of(v, key, path)):
            fail(f"{path}.{key}", "only white space")

    def number(v, key, path, least, most):
        x = v.get(key)
        if isinstance(x, bool) or not isinstance(x, (int, float)) or x != int(x) or not least <= x <= most:
            fail(f"{path}.{key}", f"not a whole number from {least} to {most}")

    def one_of(v, key, path, allowed):
        if not isinstance(v.get(key), str) or v[key] not in allowed:
            fail(f"{path}.{key}", "not an allowed value")
        return v[key]

    def items(v, key, path, each, empty=False):
        if not isinstance(v.get(key), list) or not (empty or v[key]):
            fail(f"{path}.{key}", "not a list" if empty else "not a filled list")
        for i, x in enumerate(v[key]):
            each(x, f"{path}.{key}[{i}]")

    def url(v, key, path, pattern):
        s = text_of(v, key, path)
        if not re.search(pattern.replace(r"\z", r"\Z"), s) or re.search(r"/\.{1,2}(/|\Z)", s):
            fail(f"{path}.{key}", "not an allowed address")
        return re.search(pattern.replace(r"\z", r"\Z"), s)

    def picture(v, path, pattern):
        url(record(v.get("image"), f"{path}.image", ["url"]), "url", f"{path}.image", pattern)

    def sizes(v, path):
        s = record(v.get("size"), f"{path}.size", ["width", "height"])
        number(s, "width", f"{path}.size", 1, 10_000)
        number(s, "height", f"{path}.size", 1, 10_000)

    def kind_of(v, path, fields):
        if not isinstance(v, dict):
            fail(path, "not an object")
        if not isinstance(v.get("kind"), str) or v["kind"] not in fields:
            fail(f"{path}.kind", "unknown kind")
        record(v, path, fields[v["kind"]])
        return v["kind"]

    def shows(v):
        if v["kind"] == "text":
            return BLANK.sub("", v["text"]) != ""
        return v["kind"] in ("gaiji", "image") or any(map(shows, v.get("children", [])))

    def inline(v, path, depth, ruby):
        if depth > 8:
            fail(path, "nested too deeply")
        if isinstance(v, dict) and v.get("kind") == "ruby" and ruby:
            fail(path, "ruby under a ruby")
        kind = kind_of(v, path, d.INLINE_FIELDS)
        below = lambda x, p: inline(x, p, depth + 1, ruby or kind == "ruby")
        if kind in ("text", "note"):
            text_of(v, "text", path)
        elif kind == "ruby":
            items(v, "base", path, below)
            if not any(map(shows, v["base"])):
                fail(f"{path}.base", "nothing visible")
            seen(v, "reading", path)
        elif kind in ("gaiji", "image"):
            if kind == "gaiji":
                seen(v, "description", path)
            picture(v, path, d.GLYPH if kind == "gaiji" else d.PLATE)
            if kind == "image":
                text_of(v, "alt", path, True)
                sizes(v, path)
        else:
            if kind == "emphasis":
                one_of(v, "mark", path, d.MARKS)
                one_of(v, "side", path, ("right", "left"))
            if kind == "size":
                number(v, "step", path, 1, 5)
                one_of(v, "direction", path, ("larger", "smaller"))
            items(v, "children", path, below)

    def layout(v, path):
        kind = kind_of(v, path, d.LAYOUT_FIELDS)
        for k, least in {"none": [], "indent": [("chars", 1)], "end": [("inset", 0)], "hanging": [("indent", 1), ("first", 0)]}[kind]:
            number(v, k, path, least, 200)

    def block(v, path):
        kind, top = kind_of(v, path, d.BLOCK_FIELDS), lambda x, p: inline(x, p, 1, False)
        if kind in ("paragraph", "heading", "figure"):
            text_of(v, "id", path)
        if kind == "heading":
            one_of(v, "level", path, d.LEVELS)
        if kind in ("paragraph", "heading"):
            layout(v.get("layout"), f"{path}.layout")
            items(v, "inline", path, top, True)
        if kind == "figure":
            picture(v, path, d.PLATE)
            text_of(v, "alt", path, True)
            sizes(v, path)
            items(v, "caption", path, top, True)
        if kind == "pageBreak":
            one_of(v, "style", path, d.BREAK_STYLES)

    def person(v, path):
        record(v, path, ("role", "name", "reading"))
        one_of(v, "role", path, d.ROLES)
        text_of(v, "name", path)
        if "reading" in v:
            text_of(v, "reading", path)

    def line(v, path):
        if not isinstance(v, str) or not BLANK.sub("", v):
            fail(path, "not a visible text")

    def owned(v, key, path, pattern, work):
        found = url(v, key, path, pattern)
        if found[2].lstrip("0") != work.lstrip("0"):
            fail(f"{path}.{key}", "of another work")
        return found[1]

    def provenance(v, work):
        path = "$.provenance"
        p = record(v, path, ("copyright", "source", "converter", "bibliography"))
        if record(p.get("copyright"), f"{path}.copyright", ["work"]).get("work") != "なし":
            fail(f"{path}.copyright.work", "not free")
        s = record(p.get("source"), f"{path}.source", ("cardUrl", "fileUrl", "upstreamUpdated"))
        day = text_of(s, "upstreamUpdated", f"{path}.source")
        try:
            if not re.fullmatch(r"\d{4}-\d\d-\d\d", day):
                raise ValueError
            date.fromisoformat(day)
        except ValueError:
            fail(f"{path}.source.upstreamUpdated", "not a date")
        c = record(p.get("converter"), f"{path}.converter", ("version", "path"))
        if not re.fullmatch(r"[0-9]+\.[0-9]+\.[0-9]+", text_of(c, "version", f"{path}.converter")):
            fail(f"{path}.converter.version", "not a version")
        if owned(s, "cardUrl", f"{path}.source", d.CARD, work) != owned(s, "fileUrl", f"{path}.source", d.FILE, work):
            fail(f"{path}.source.fileUrl", "of another person")
        if s["fileUrl"].endswith(".html") != (one_of(c, "path", f"{path}.converter", ("xhtml", "text")) == "xhtml"):
            fail(f"{path}.converter.path", "of another file")
        items(p, "bibliography", path, line)

    def foreign(nodes, path, folder):
        for i, v in enumerate(nodes):
            p = f"{path}[{i}]"
            if v["kind"] in ("image", "figure") and re.search(d.PLATE.replace(r"\z", r"\Z"), v["image"]["url"])[1] != folder:
                fail(f"{p}.image.url", "not a file of this work")
            for k in ("inline", "caption", "base", "children"):
                foreign(v.get(k, []), f"{p}.{k}", folder)

    try:
        v = json.loads(text, object_pairs_hook=once) if text is not None else None
    except ValueError:
        return "unreadable", None, None
    if text is None:
        return "unreadable", None, None
    if not isinstance(v, dict):
        return "invalid", "$", "not an object"
    if isinstance(v.get("schemaVersion"), bool) or v.get("schemaVersion") != 1:
        return "unsupported-version", None, None
    try:
        record(v, "$", d.WORK_FIELDS)
        if not re.fullmatch("[0-9]{6}", text_of(v, "id", "$")):
            fail("$.id", "not six digits")
        items(v, "blocks", "$", block)
        ids = [b.get("id") for b in v["blocks"]]
        for i, x in enumerate(ids):
            if x is not None and x in ids[:i]:
                fail(f"$.blocks[{i}].id", "repeated")
        text_of(v, "title", "$")
        items(v, "people", "$", person)
        text_of(v, "orthography", "$")
        provenance(v.get("provenance"), v["id"])
        foreign(v["blocks"], "$.blocks", re.search("cards/([0-9]{6})", v["provenance"]["source"]["fileUrl"])[1])
        for k in d.MAY_BE_LEFT_OUT:
            if k in v:
                text_of(v, k, "$")
        if "subtitleReading" in v and "subtitle" not in v:
            fail("$.subtitleReading", "without subtitle")
    except Broken as e:
        return "invalid", *e.args
    return None


def sound():
    text = lambda s="x": {"kind": "text", "text": s}
    glyph = {"kind": "gaiji", "description": "a sign", "image": {"url": f"{d.HOST}/gaiji/1-2/a.png"}}
    plate = {"image": {"url": f"{d.HOST}/cards/000012/files/7_b.png"}, "alt": "", "size": {"width": 3, "height": 4}}
    deep = text()
    for _ in range(7):
        deep = {"kind": "strong", "children": [deep]}
    ruby = {"kind": "ruby", "base": [{"kind": "note", "text": "n"}, {"kind": "emphasis", "mark": "wave", "side": "left", "children": [text("字")]}], "reading": "じ"}
    return {
        "schemaVersion": 1, "id": "000077", "title": "T", "subtitle": "s", "subtitleReading": "r", "orthography": "新字新仮名",
        "people": [{"role": "author", "name": "A", "reading": "a"}, {"role": "other", "name": "B"}],
        "provenance": {
            "copyright": {"work": "なし"}, "converter": {"version": "1.20.3", "path": "xhtml"}, "bibliography": ["底本", "入力"],
            "source": {"cardUrl": f"{d.HOST}/cards/000012/card77.html", "fileUrl": f"{d.HOST}/cards/000012/files/77_1.html", "upstreamUpdated": "2024-02-29"},
        },
        "blocks": [
            {"kind": "heading", "id": "h", "level": "small", "layout": {"kind": "hanging", "indent": 2, "first": 0}, "inline": [text()]},
            {"kind": "paragraph", "id": "p", "layout": {"kind": "none"}, "inline": [text(), deep, ruby, glyph, {"kind": "size", "direction": "larger", "step": 2, "children": [text("y"), {"kind": "image", **plate}]}]},
            {"kind": "figure", "id": "f", **plate, "caption": [text("c")]},
            {"kind": "paragraph", "id": "q", "layout": {"kind": "end", "inset": 1}, "inline": []},
            {"kind": "pageCenter"}, {"kind": "pageBreak", "style": "leaf"}, {"kind": "paragraph", "id": "i", "layout": {"kind": "indent", "chars": 3}, "inline": [text()]},
        ],
    }


def places(v, at=()):
    """Each value of a document with the way to it."""
    for k, x in v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ():
        yield (*at, k)
        yield from places(x, (*at, k))


def changed(doc, way, how):
    doc = copy.deepcopy(doc)
    at = doc
    for k in way[:-1]:
        at = at[k]
    if how == "gone":
        del at[way[-1]]
    elif how == "more":
        if not isinstance(at, dict):
            return None
        at["zz"], at["extra"] = 1, 2
    elif how == "twice":
        if not isinstance(at, list):
            return None
        at.append(copy.deepcopy(at[way[-1]]))
    else:
        at[way[-1]] = how
    return doc


JUNK = [f"{d.HOST}/cards/000012/files/78.html", f"{d.HOST}/cards/000013/files/77.html", f"{d.HOST}/cards/000012/files/0077.zip", "gone", "more", "twice", "", " \u3000", None, 0, 1, 2.0, 2.5, 201, 10_001, True, [], {}, "x", "ruby", "pageCenter", {"kind": "text", "text": " "}, [{"kind": "text", "text": "\u200b"}], [{"kind": "ruby", "base": [{"kind": "text", "text": "t"}], "reading": "r"}], "2023-02-29", f"{d.HOST}/cards/000013/files/77.png", f"{d.HOST}/gaiji/../a.png", f"{d.HOST}/gaiji/a.png\n"]


def faults(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "work_id bigint, json string")
    found = d.document_faults(rows).collect()
    assert len({r["work_id"] for r in found}) == len(found)
    return {r["work_id"]: (r["code"], r["path"], r["message"]) for r in found}


def test_every_single_change_is_judged_like_the_plain_reading(spark):
    doc = sound()
    assert plain(json.dumps(doc)) is None
    docs = [doc] + [c for way in places(doc) for how in JUNK if (c := changed(doc, way, how)) is not None]
    rng = random.Random(3)
    for _ in range(600):  # several faults: the first is told
        c = doc
        for _ in range(rng.randint(2, 4)):
            c = changed(c, rng.choice(list(places(c))), rng.choice(JUNK)) or c
        docs.append(c)
    texts = [json.dumps(c, ensure_ascii=False) for c in docs]
    want = {i: p for i, t in enumerate(texts) if (p := plain(t)) is not None}
    got = faults(spark, texts)
    assert [(texts[i], want.get(i), got.get(i)) for i in range(len(texts)) if want.get(i) != got.get(i)] == []
    assert len(docs) > 3000 and len({(w[1], w[2]) for w in want.values()}) > 200
    assert {w[2] for w in want.values()} >= {"nothing visible", "ruby under a ruby", "repeated", "of another work", "of another person", "not a file of this work", "without subtitle", "not a date"}


def test_what_is_no_document(spark):
    texts = [None, "", "{", "[1]", "null", "3", '{"schemaVersion":1,"schemaVersion":1}', '{"schemaVersion":2}', '{"schemaVersion":true}', '{"schemaVersion":"1"}', '{"schemaVersion":1.0}', '{"schemaVersion":1}', "{}"]
    assert faults(spark, [*texts, json.dumps(sound())]) == {i: plain(t) for i, t in enumerate(texts)}


def test_depth_ties_repeats_and_no_rows(spark):
    doc = sound()
    inner = {"kind": "text", "text": "x"}
    for _ in range(30):
        inner = {"kind": "tcy", "children": [inner]}
    doc["blocks"][0]["inline"] = [inner]
    text = json.dumps(doc)
    deep = "$.blocks[0].inline[0]" + ".children[0]" * 8
    assert faults(spark, [text]) == {0: ("invalid", deep, "nested too deeply")} == {0: plain(text)}
    twice = spark.createDataFrame([(1, text, "x"), (1, json.dumps(sound()), "y"), (1, text, "z")], "work_id bigint, json string, path string")
    assert [tuple(r) for r in d.document_faults(twice).collect()] == [(1, "invalid", deep, "nested too deeply")]
    assert faults(spark, []) == {}
    long = sound()
    long["blocks"] += [{"kind": "paragraph", "id": f"n{i}", "layout": {"kind": "none"}, "inline": [{"kind": "text", "text": "t" * 50}]} for i in range(20_000)]
    long["blocks"][15_000]["id"] = "n3"
    assert faults(spark, [json.dumps(long)]) == {0: ("invalid", "$.blocks[15000].id", "repeated")}

"""XLIFF 1.2 and 2.x: segments with their places, writing translations back, and files of segments to exchange.

A reader walks a file's events with a stack and remembers at which byte every piece of content stands. Inline elements become
codes: containers and start and end markers whose both ends are in a segment are pairs ``⟦id⟧`` and ``⟦/id⟧``, all else stands
alone as ``⟦id/⟧``. Each code keeps the markup that it stands for. Merging replaces the bytes of the targets that
change, by their translation with the codes' markup; every other byte stays, so that a merge without changes gives the file back.

One file is read in one task; files are spread by Spark and translations meet their file by its key, in one row a file. A
reader holds the events of one unit at a time and gives its segments on, so a task holds a file's bytes and not its tree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple
from xml.parsers import expat
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from weftline.functions import text as T
from weftline.functions.batches import each_row, sliced

# Element names of the two versions, by their part.
UNITS = ("trans-unit", "unit")
CONTAINERS, OPENERS, CLOSERS = ("g", "pc", "mrk"), ("bx", "bpt", "sc", "sm"), ("ex", "ept", "ec", "em")
ASIDE = ("alt-trans", "matches", "match", "note", "notes", "glossary", "originalData", "metadata")
TAG = re.compile(rb"""<(?:[^>"']|"[^"]*"|'[^']*')*>""")
SOURCE = re.compile(rb"<([^\s/>]*?)(?:seg-)?source")
CHUNK = 1 << 16


class Event(NamedTuple):
    kind: str  # start, end or text
    name: str
    attrs: dict
    at: int
    end: int
    text: str = ""


def _parsed(parser, data: bytes) -> Iterator[None]:
    """Feeds a parser in chunks; a file that is not well-formed raises ``ValueError``."""
    try:
        for at in range(0, len(data), CHUNK):
            parser.Parse(data[at : at + CHUNK], False)
            yield
        parser.Parse(b"", True)
        yield
    except expat.ExpatError as e:
        raise ValueError(f"not well-formed: {e}") from None


def events(data: bytes) -> Iterator[Event]:
    """Elements and texts in order with the bytes of their tags; a file that is not well-formed raises ``ValueError``."""
    out: list[Event] = []
    opened: list[Event] = []
    parser = expat.ParserCreate("utf-8")
    local = lambda name: name.rpartition(":")[2]

    def start(name: str, attrs: dict) -> None:
        at = parser.CurrentByteIndex
        opened.append(Event("start", local(name), attrs, at, TAG.match(data, at).end()))
        out.append(opened[-1])

    def end(name: str) -> None:
        first, at = opened.pop(), parser.CurrentByteIndex
        if data[first.at : first.end].endswith(b"/>"):  # its end is its start
            out.append(first._replace(kind="end"))
        else:
            out.append(Event("end", local(name), {}, at, TAG.match(data, at).end()))

    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = lambda text: out.append(Event("text", "", {}, parser.CurrentByteIndex, 0, text))
    for _ in _parsed(parser, data):
        yield from out
        out.clear()


def _parts(data: bytes) -> Iterator[list[Event]]:
    """The events of each outermost unit together, and all other events alone."""
    held: list[Event] = []
    depth = 0
    for e in events(data):
        if e.kind != "text" and e.name in UNITS:
            depth += 1 if e.kind == "start" else -1
        held.append(e)
        if not depth:
            yield held
            held = []


def fault(text: str | None) -> str | None:
    """What makes a file not well-formed."""
    try:
        for _ in _parsed(expat.ParserCreate("utf-8"), (text or "<none/>").encode()):
            pass
    except ValueError as e:
        return str(e)
    return None


class Content(NamedTuple):
    tagged: str
    codes: dict[str, bytes]


def _key(e: Event) -> str | None:
    a = e.attrs
    return a.get("rid") or a.get("startRef") or a.get("id") or a.get("mid")


def _closing(tag: bytes) -> bytes:
    """The end tag of a start tag."""
    return b"</" + re.match(rb"<([^\s/>]+)", tag)[1] + b">"


def content(inside: list[Event], data: bytes) -> Content:
    """The events between two tags as tagged text with its codes."""
    opened = {_key(e) for e in inside if e.kind == "start" and e.name in OPENERS}
    paired = opened & {_key(e) for e in inside if e.kind == "start" and e.name in CLOSERS}
    out: list[str] = []
    codes: dict[str, bytes] = {}
    stack: list[tuple[Event, str]] = []  # with the code of a container
    hidden = 0

    def code(name: str | None, form: str, raw: bytes) -> str:
        name = name if name and re.fullmatch(r"[A-Za-z0-9_.-]+", name) else f"c{len(codes) + 1}"
        told = form.format(name)
        while codes.get(told, raw) != raw:
            name += "."
            told = form.format(name)
        codes[told] = raw
        out.append(told)
        return name

    for e in inside:
        if e.kind == "text":
            out.append("" if hidden else e.text.replace("⟦", "⟦⟦").replace("⟧", "⟧⟧"))
        elif e.kind == "start":
            name = ""
            if not hidden and e.name in CONTAINERS:
                raw = data[e.at : e.end]
                name = code(_key(e), "⟦{}⟧", raw[:-2] + b">" if raw.endswith(b"/>") else raw)
            hidden += e.name not in CONTAINERS
            stack.append((e, name))
        else:
            first, container = stack.pop()
            hidden -= first.name not in CONTAINERS
            if container:
                raw = data[e.at : e.end]
                codes[f"⟦/{container}⟧"] = raw if raw.startswith(b"</") else _closing(raw)
                out.append(f"⟦/{container}⟧")
            elif not hidden and first.name not in CONTAINERS:
                both = _key(first) in paired
                form = "⟦{}⟧" if both and first.name in OPENERS else "⟦/{}⟧" if both and first.name in CLOSERS else "⟦{}/⟧"
                code(f"cp{first.attrs.get('hex')}" if first.name == "cp" else _key(first), form, data[first.at : e.end])
    return Content("".join(out), codes)


class Segment(NamedTuple):
    unit: str
    segment: str
    translate: bool
    source: Content
    target: Content | None
    at: int  # where the target's content stands, or where a target goes
    end: int
    before: bytes  # what a new target needs around its content
    after: bytes


def segments(text: str) -> Iterator[Segment]:
    data = text.encode()
    refused: list[bool] = []
    aside = 0
    for es in _parts(data):
        for e in es if len(es) == 1 else ():
            if e.kind == "text":
                continue
            if e.name in ASIDE:
                aside += 1 if e.kind == "start" else -1
            elif e.name in ("file", "group") and e.kind == "end" and refused:
                refused.pop()
            elif e.name in ("file", "group") and e.kind == "start" and not aside:
                refused.append(_refuses(e, refused))
        if len(es) > 1 and not aside:
            yield from _unit(es, data, refused)


def _refuses(e: Event, refused: list[bool]) -> bool:
    said = e.attrs.get("translate")
    return said == "no" if said else bool(refused) and refused[-1]


def _unit(es: list[Event], data: bytes, refused: list[bool]) -> list[Segment]:
    """The segments of a unit's events; ``refused`` says it of the elements around it, outermost first."""
    closing: dict[int, int] = {}
    stack: list[int] = []
    for i, e in enumerate(es):
        if e.kind == "start":
            stack.append(i)
        elif e.kind == "end":
            closing[stack.pop()] = i

    def children(i: int) -> list[int]:
        """The elements right inside an element."""
        found, k = [], i + 1
        while k < closing[i]:
            if es[k].kind == "start":
                found.append(k)
                k = closing[k]
            k += 1
        return found

    def within(i: int) -> Content:
        return content(es[i + 1 : closing[i]], data)

    def place(source: int, target: int | None) -> tuple[int, int, bytes, bytes]:
        """Bytes to replace, and what goes around a translation there."""
        if target is not None and es[closing[target]].at != es[target].at:
            return es[target].end, es[closing[target]].at, b"", b""
        if target is not None:  # <target/>
            tag = data[es[target].at : es[target].end]
            return es[target].at, es[target].end, tag[:-2].rstrip() + b">", _closing(tag)
        end = es[closing[source]].end
        at = blank = es[source].at
        name = SOURCE.match(data, at)[1] + b"target"
        while blank and data[blank - 1] in b" \t\r\n":
            blank -= 1
        indent = re.search(rb"(\r?\n[ \t]*)?$", data[blank:at])[1] or b""
        return end, end, indent + b"<" + name + b">", b"</" + name + b">"

    out: list[Segment] = []
    refused = list(refused)
    aside = 0
    for i, e in enumerate(es):
        if e.kind == "text":
            continue
        if e.name in ASIDE:
            aside += 1 if e.kind == "start" else -1
        if e.kind == "end" or aside:
            if e.kind == "end" and e.name in ("file", "group", *UNITS) and refused:
                refused.pop()
            continue
        if e.name in ("file", "group", *UNITS):
            refused.append(_refuses(e, refused))
        if e.name not in UNITS:
            continue
        unit, own = e.attrs.get("id", ""), children(i)
        named = lambda where, name: next((k for k in where if es[k].name == name), None)
        parts = [k for k in own if es[k].name == "segment"]
        for n, part in enumerate(parts or [None]):
            inner = children(part) if part is not None else own
            source, target, split = named(inner, "source"), named(inner, "target"), named(inner, "seg-source")
            if source is None:
                continue
            mid = (es[part].attrs.get("id") if part is not None else None) or str(n + 1)
            marks = [k for k in range(split + 1, closing[split]) if es[k].kind == "start" and es[k].attrs.get("mtype") == "seg"] if split is not None else []
            if not marks:
                old = within(target) if target is not None else None
                out.append(Segment(unit, mid, not refused[-1], within(source), old, *place(source, target)))
                continue
            have = {es[k].attrs.get("mid"): k for k in range(target + 1, closing[target]) if es[k].kind == "start" and es[k].attrs.get("mtype") == "seg"} if target is not None else {}
            for j, k in enumerate(marks):
                mine = have.get(es[k].attrs.get("mid"))
                if mine is not None:
                    at, end, before, after = place(k, mine)
                else:  # all marks of a new target stand at one place
                    at, end, before, after = place(split, target) if target is None or es[closing[target]].at == es[target].at else (es[closing[target]].at,) * 2 + (b"", b"")
                    before = (before if j == 0 else b"") + data[es[k].at : es[k].end]
                    after = data[es[closing[k]].at : es[closing[k]].end] + (after if j == len(marks) - 1 else b"")
                out.append(Segment(unit, es[k].attrs.get("mid", str(j + 1)), not refused[-1], within(k), within(mine) if mine is not None else None, at, end, before, after))
    return out


def written(tagged: str, codes: dict[str, bytes]) -> bytes | None:
    """Tagged text as markup; null if a code is none of the segment's or a bracket stands alone."""
    out = []
    for piece in re.split(rf"(⟦⟦|⟧⟧|{T.CODE}|[⟦⟧])", tagged):
        if piece in ("⟦⟦", "⟧⟧"):
            out.append(piece[0].encode())
        elif piece in codes:
            out.append(codes[piece])
        elif piece[:1] in ("⟦", "⟧"):
            return None
        else:
            out.append(escape(piece, {"\r": "&#13;"}).encode())
    return b"".join(out)


def merge_file(text: str, translations: dict[tuple[str, str], str]) -> tuple[str, int, int]:
    """The file with its new targets, how many were written, and how many refused for their codes."""
    data, out, last, n, refused = text.encode(), [], 0, 0, 0
    changed = {unit for unit, _ in translations}
    for s in segments(text):
        new = translations.get((s.unit, s.segment))
        own = s.target is None and bool(re.search(rb"<[^>]*mrk", s.before))  # a mark of a new target is written with the others
        if not s.translate or (new is None and not (own and s.unit in changed)) or s.target is not None and new == s.target.tagged:
            continue
        # codes of the source come first; what only the old target has may stay
        told = written(new or "", (s.target.codes if s.target else {}) | s.source.codes)
        if told is None:
            refused += 1
            told = b"" if own else None
        if told is None:
            continue
        out += [data[last : s.at], s.before, told, s.after]
        last = s.end
        n += new is not None
    return (b"".join([*out, data[last:]])).decode(), n, refused


SEGMENT = "n int, id string, segment string, translate boolean, source string, target string"


@sliced(t.StringType())
def _fault(texts: list) -> list:
    return [fault(x) for x in texts]


@sliced(t.StructType().add("text", "string").add("written", "long").add("refused", "long").add("error", "string"))
def _merged(texts: list, changes: list) -> list[dict]:
    def told(x: str | None, c):
        try:
            return (x, 0, 0, None) if x is None else (*merge_file(x, {(r["unit"], r["segment"]): r["target"] for r in c}), None)
        except ValueError as e:
            return x, 0, 0, str(e)

    return [dict(zip(("text", "written", "refused", "error"), told(x, c), strict=True)) for x, c in zip(texts, changes, strict=True)]


def faults(df: DataFrame, keep: Sequence[str], text: str) -> DataFrame:
    """(keep, error) of the files that are not well-formed; ``read`` gives nothing of them and ``merge`` leaves them as they are."""
    return df.select(*keep, _fault(F.col(text)).alias("error")).where("error is not null")


def read(df: DataFrame, keep: Sequence[str], text: str) -> DataFrame:
    """(keep, n, id, segment, translate, source, target) of every segment."""
    return each_row(df, keep, text, SEGMENT, _rows)


def _rows(text: str | None) -> Iterator[tuple]:
    if text and not fault(text):
        for n, s in enumerate(segments(text)):
            yield n, s.unit, s.segment, s.translate, s.source.tagged, s.target and s.target.tagged or None


def merge(df: DataFrame, keep: Sequence[str], text: str, translations: DataFrame) -> DataFrame:
    """(keep, text, written, refused, error): files with the targets of ``translations`` (keep, id, segment, target). Units that are
    not to be translated, and targets whose codes the source hasn't, stay as they are. ``keep`` names a file."""
    rows = translations.where("target is not null").select(*keep, F.struct(F.col("id").alias("unit"), "segment", "target").alias("_c"))
    changes = rows.groupBy(*keep).agg(F.collect_list("_c").alias("_c"))
    both = df.select(*keep, F.col(text).alias("_text")).join(changes, list(keep), "left")
    return both.select(*keep, _merged("_text", F.coalesce("_c", F.array().cast("array<struct<unit:string,segment:string,target:string>>"))).alias("m")).select(*keep, "m.*")


def _inline(tagged: Column) -> Column:
    """Tagged text as XLIFF 2 markup. Codes become start and end markers, which may stand in any order, and placeholders."""
    out = F.regexp_replace(tagged, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.replace(F.replace(out, F.lit("⟦⟦"), F.lit(T.OPEN)), F.lit("⟧⟧"), F.lit(T.CLOSE))
    for pattern, form in ((r"⟦/([A-Za-z0-9_.-]+)⟧", '<ec startRef="$1"/>'), (r"⟦([A-Za-z0-9_.-]+)/⟧", '<ph id="$1"/>'), (r"⟦([A-Za-z0-9_.-]+)⟧", '<sc id="$1"/>')):
        out = F.regexp_replace(out, pattern, form)
    return F.replace(F.replace(out, F.lit(T.OPEN), F.lit("⟦")), F.lit(T.CLOSE), F.lit("⟧"))


def _attribute(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def export(units: DataFrame, keep: Sequence[str], source_lang: str, target_lang: str) -> DataFrame:
    """(keep, text): XLIFF 2.1 files of ``units`` (keep, n, id, source, target or null), in the order of ``n``; ``read`` and
    ``merge`` take them back. Control characters that XML has no form for are left out."""
    target = F.when(F.col("target").isNotNull(), F.concat(F.lit("<target>"), _inline(F.col("target")), F.lit("</target>"))).otherwise("")
    unit = F.concat(F.lit('    <unit id="'), _attribute(F.col("id")), F.lit('"><segment><source>'), _inline(F.col("source")), F.lit("</source>"), target, F.lit("</segment></unit>\n"))
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<xliff xmlns="urn:oasis:names:tc:xliff:document:2.0" version="2.1" srcLang="{source_lang}" trgLang="{target_lang}">\n  <file id="f1">\n'
    body = F.array_join(F.array_sort(F.collect_list(F.struct("n", unit.alias("u"))))["u"], "")
    return units.groupBy(*keep).agg(F.concat(F.lit(head), body, F.lit("  </file>\n</xliff>\n")).alias("text"))

"""JSON and YAML catalogues: every text with its pointer and place, and writing texts back at their places.

Both readers go over a file's tokens or lines with a stack of open objects, so that any depth is read. A text's pointer is that
of RFC 6901 (keys and indexes after slashes, ``~`` and ``/`` in keys as ``~0`` and ``~1``). Writing replaces the characters of the texts that change,
in their own style where the new text can have it; every other character stays. YAML is the language of catalogues: mappings, sequences, flow
collections, plain, quoted and block scalars. Anchors, aliases, tags, complex keys and tabs as indents are refused.

One file is read in one task; files are spread by Spark, and changes meet their file by its key.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from weftline.functions.batches import sliced


class Text(NamedTuple):
    pointer: str
    value: str
    start: int
    end: int
    style: str = '"'
    indent: str = ""


def _pointer(keys) -> str:
    return "".join("/" + str(k).replace("~", "~0").replace("/", "~1") for k in keys)


JSON = re.compile(r'"(?:[^"\\\x00-\x1f]|\\.)*"|[{}\[\],:]|[^\s{}\[\],:"]+|"')
SCALAR = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null")


def json_texts(text: str, scalars: bool = False) -> list[Text]:
    """The texts of a JSON file, with ``scalars`` its numbers and truth values too; what is no JSON raises ``ValueError``."""
    out: list[Text] = []
    stack: list[list] = []  # [object or not, key or index]
    want, last = "value", 0
    bad = lambda m: ValueError(f"no JSON at {m.start() if m else len(text)}")
    start = 1 if text.startswith("\ufeff") else 0
    for m in JSON.finditer(text, start):
        token, last = m[0], m.end()
        if want == "done" or token == '"':
            raise bad(m)
        if token in "}]" and stack and stack[-1][0] == (token == "}") and want in ("first", "comma"):
            stack.pop()
            want = "comma" if stack else "done"
        elif want == "comma" and token == ",":
            if not stack[-1][0]:
                stack[-1][1] += 1
            want = "key" if stack[-1][0] else "value"
        elif want == "colon" and token == ":":
            want = "value"
        elif token[0] == '"' and (want == "key" or want == "first" and stack[-1][0]):
            stack[-1][1] = _whole(json.loads(token))
            want = "colon"
        elif want == "value" or want == "first" and not stack[-1][0]:
            if token in ("{", "["):
                stack.append([token == "{", 0])
                want = "first"
                continue
            if token[0] == '"':
                out.append(Text(_pointer(k for _, k in stack), _whole(json.loads(token)), m.start(), m.end()))
            elif not SCALAR.fullmatch(token):
                raise bad(m)
            elif scalars and token != "null":
                out.append(Text(_pointer(k for _, k in stack), token, m.start(), m.end()))
            want = "comma" if stack else "done"
        else:
            raise bad(m)
    if want != "done":
        raise bad(None)
    return out


def json_written(old: Text, new: str) -> str:
    return json.dumps(new, ensure_ascii=False)


QUOTED = re.compile(r""""(?:[^"\\]|\\[\s\S])*"|'(?:[^']|'')*'""")
KEY = re.compile(r"""("(?:[^"\\\n]|\\.)*"|'(?:[^'\n]|'')*'|(?![-?](?:[ \n]|$)|[\[\]{},#&*!|>'"%@`])(?:[^\s:#]|:(?![\s]|$)|(?<![\s])#|[ \t](?!#))+?)[ \t]*:(?=[ \t\r\n]|$)""")
BLOCK = re.compile(r"([|>])(?:([1-9])[-+]?|[-+]([1-9])?)?[ \t]*(?:#[^\n]*)?\r?(?:\n|$)")
NO_TEXT = re.compile(r"~|null|true|false|yes|no|on|off|[-+]?(?:\d[\d_]*(?:\.\d*)?|\.\d+)(?:e[-+]?\d+)?|0x[0-9a-f]+|0o[0-7]+|[-+]?\.inf|\.nan|\d{4}-\d\d-\d\d|", re.I)
ESCAPES = {"0": "\0", "a": "\a", "b": "\b", "t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r", "e": "\x1b", " ": " ", '"': '"', "/": "/", "\\": "\\", "N": "\x85", "_": "\xa0", "L": "\u2028", "P": "\u2029"}


def _whole(x: str) -> str:
    """Halves of characters that were escaped one by one, put together; a half alone is a replacement character."""
    return x.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace") if re.search("[\ud800-\udfff]", x) else x


def _fold(raw: str) -> str:
    """Line breaks of flow scalars: one is a space, more are one less."""
    return re.sub(r"[ \t]*\r?\n[ \t]*((?:\r?\n[ \t]*)*)", lambda m: "\n" * m[1].count("\n") or " ", raw)


def _unquoted(raw: str) -> str:
    if raw[0] == "'":
        return _fold(raw[1:-1]).replace("''", "'")
    inner = re.sub(r"\\\r?\n[ \t]*", "", raw[1:-1])
    code = lambda m: chr(int(m[1] or m[2] or m[3], 16)) if m[1] or m[2] or m[3] else ESCAPES.get(m[4], m[4])
    return _whole(re.sub(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|([\s\S]))", code, _fold(inner)))


class _Yaml:
    """A walk over lines. A level of the stack is [indent, keys before it, own key or index]; a dash counts half a column more
    than a key at the same place, so that a sequence may stand under its key without an indent."""

    def __init__(self, text: str):
        self.text, self.out, self.stack, self.document = text, [], [], 0

    def fail(self, at: int, why: str):
        raise ValueError(f"line {self.text.count(chr(10), 0, at) + 1}: {why}")

    def path(self) -> tuple:
        first = (f"doc{self.document + 1}",) if self.many else ()
        return first + tuple(level[1] for level in self.stack)

    def add(self, value: str, start: int, end: int, style: str, indent: str = "") -> None:
        self.out.append(Text(_pointer(self.path()).removeprefix("/") if self.many else _pointer(self.path()), value, start, end, style, indent))

    def line_end(self, at: int) -> int:
        n = self.text.find("\n", at)
        return len(self.text) if n < 0 else n

    def texts(self) -> list[Text]:
        self.many = len(re.findall(r"(?m)^---(?=\s|$)", re.sub(r"\A(?:\s*(?:#[^\n]*|%[^\n]*)?\n)*---(?=\s|$)", "", self.text))) > 0
        at, begun = 1 if self.text.startswith("\ufeff") else 0, False
        while at < len(self.text):
            end = self.line_end(at)
            line = self.text[at:end]
            if re.match(r"(?:---|\.\.\.)(?:\s|$)", line):
                self.document += begun and line.startswith("---")
                begun, self.stack = begun or line.startswith("---"), []
                at += 3
                line = self.text[at:end]
            elif line.startswith("%") and not begun:
                at = end + 1
                continue
            body = line.lstrip(" ")
            if not body.strip() or body.startswith("#") or line.strip().startswith("#"):
                at = end + 1
                continue
            if body.startswith("\t"):
                self.fail(at, "a tab as indent")
            begun = True
            at = self.entry(at + len(line) - len(body), len(line) - len(body))
        return self.out

    def entry(self, at: int, column: int) -> int:
        """One line from its first character on; gives where the next line starts."""
        text, parent = self.text, column - 1
        while re.compile(r"-(?=[ \r\n]|$)").match(text, at):
            self.level(column + 0.5, None)
            parent = column
            inside = re.compile(r"-[ ]*").match(text, at).end()
            column, at = column + inside - at, inside
        if text[at : at + 2] in ("? ", "?\n"):
            self.fail(at, "a complex key")
        m = KEY.match(text, at)
        if m:
            key = m[1]
            self.level(column, _unquoted(key) if key[0] in "\"'" else key)
            if key == "<<":
                self.fail(at, "a merge key")
            at = re.compile(r"[ \t]*").match(text, m.end()).end()
            return self.scalar(at, column)
        return self.scalar(at, parent)

    def level(self, indent: float, key) -> None:
        while self.stack and self.stack[-1][0] > indent:
            self.stack.pop()
        if self.stack and self.stack[-1][0] == indent:
            self.stack[-1][1] = key if key is not None else self.stack[-1][1] + 1
        else:
            self.stack.append([indent, key if key is not None else 0])

    def scalar(self, at: int, parent: int) -> int:
        """A value whose parent stands at a column; gives where the next line starts."""
        text = self.text
        end = self.line_end(at)
        rest = text[at:end].strip()
        if not rest or rest.startswith("#"):
            return end + 1
        if rest[0] in "&*!":
            self.fail(at, "an anchor, alias or tag")
        if rest[0] in "@`%":
            self.fail(at, "a reserved character")
        if rest[0] in "|>":
            return self.block(at, parent)
        if rest[0] in "\"'":
            m = QUOTED.match(text, at) or self.fail(at, "an open quote")
            self.add(_unquoted(m[0]), at, m.end(), rest[0])
            return self.after(m.end())
        if rest[0] in "[{":
            return self.after(self.flow(at))
        # plain: up to a comment, and over deeper lines
        stop = at + len(re.split(r"\s#", text[at:end], maxsplit=1)[0].rstrip())
        last, nxt = stop, end + 1
        while stop == at + len(text[at:end].rstrip()) or nxt > end + 1:
            more = re.compile(r"(?:[ \t]*\r?\n)*([ ]*)([^\s#][^\n]*)").match(text, nxt)
            if not more or len(more[1]) <= parent or nxt >= len(text) or re.match(r"(?:---|\.\.\.)(?:\s|$)", more[1] + more[2]):
                break
            if KEY.match(text, more.start(2)):
                self.fail(more.start(2), "a key inside a text")
            words = re.split(r"\s#", more[2], maxsplit=1)[0].rstrip()
            last, nxt = more.start(2) + len(words), self.line_end(more.start(2)) + 1
            if len(words) < len(more[2].rstrip()):
                break
        value = _fold(text[at:last])
        if not NO_TEXT.fullmatch(value):
            self.add(value, at, last, "")
        return nxt

    def after(self, at: int) -> int:
        end = self.line_end(at)
        if not re.fullmatch(r"\s*(?:\s#[^\n]*)?", self.text[at:end]):
            self.fail(at, "something after a value")
        return end + 1

    def block(self, at: int, parent: int) -> int:
        m = BLOCK.match(self.text, at) or self.fail(at, "a block's head")
        begin, lines, nxt = m.end(), [], m.end()
        digit = m[2] or m[3]
        width = max(parent, 0) + int(digit) if digit else None
        while nxt < len(self.text):
            end = self.line_end(nxt)
            line = self.text[nxt:end].rstrip("\r")
            indent = len(line) - len(line.lstrip(" "))
            if line.strip(" "):
                width = indent if width is None and indent > parent else width
                if width is None or indent < width:
                    break
            lines.append((line, nxt))
            nxt = end + 1
        while lines and not lines[-1][0].strip():
            lines.pop()
        if lines:
            body = [x[width:] for x, _ in lines]
            deeper = m[1] == ">" and any(x[:1] in (" ", "\t") for x in body)
            value = "\n".join(body) if m[1] == "|" or deeper else re.sub(r"(?<!\n)\n(?!\n)", " ", re.sub(r"\n\n", "\n\n", "\n".join(body)))
            if m[1] == ">" and not deeper:
                value = re.sub(r"\n(\n+)", r"\1", value)
            if not deeper:  # folded lines with an indent of their own keep their breaks: they are left alone
                self.add(value, begin, lines[-1][1] + len(lines[-1][0]), m[1], " " * width)
        return nxt

    def flow(self, at: int) -> int:
        """A collection in brackets; gives where it ends."""
        text, base = self.text, len(self.stack)
        token = re.compile(r"""\s+|(?<=\s)#[^\n]*|[\[\]{},]|:(?=[\s,\[\]{}]|$)|"(?:[^"\\]|\\[\s\S])*":?|'(?:[^']|'')*':?|(?:[^\s\[\]{},:"'&*!|>%@`]|:(?![\s,\[\]{}]))(?:[^\[\]{},:\n#]|:(?![\s,\[\]{}])|(?<!\s)#)*""")
        kinds: list[str] = []
        pending: tuple[str, int, int] | None = None

        def close() -> None:
            nonlocal pending
            if pending is not None:
                raw, a, b = pending
                if kinds[-1] == "[" or self.stack[-1][1] is not None:
                    if raw[0] in "\"'":
                        self.add(_unquoted(raw), a, b, raw[0])
                    elif not NO_TEXT.fullmatch(raw):
                        self.add(_fold(raw), a, b, "flow")
            pending = None

        while True:
            m = token.match(text, at) or self.fail(at, "a flow collection")
            tok, at = m[0], m.end()
            if not tok.strip() or tok[0] == "#":
                continue
            if tok in "[{":
                kinds.append(tok)
                self.stack.append([float("inf"), 0 if tok == "[" else None])
            elif tok in "]}":
                if not kinds or kinds[-1] + tok not in ("[]", "{}"):
                    self.fail(m.start(), "brackets that don't match")
                close()
                kinds.pop()
                self.stack.pop()
                if len(self.stack) == base:
                    return at
            elif tok == ",":
                close()
                self.stack[-1][1] = self.stack[-1][1] + 1 if kinds[-1] == "[" else None
            elif tok == ":" or tok[0] in "\"'" and tok[-1] == ":":
                raw = tok[:-1] if tok != ":" else pending[0] if pending else ""
                if kinds[-1] == "[":
                    self.fail(m.start(), "a pair in a sequence")
                self.stack[-1][1], pending = _unquoted(raw) if raw[:1] in ("'", '"') else raw, None
            else:
                pending = (tok.rstrip(), m.start(), m.start() + len(tok.rstrip()))


def yaml_texts(text: str) -> list[Text]:
    """The texts of a YAML file; what is refused or no YAML raises ``ValueError`` with its line."""
    return _Yaml(text).texts()


UNSAFE = re.compile(r"""^[-?:](?:\s|$)|^[,\[\]{}#&*!|>'"%@`]|^\s|\s$|:(?:\s|$)|\s#|[\x00-\x1f\x7f-\x9f]|^(?:---|\.\.\.)(?:\s|$)|^$""")


def yaml_written(old: Text, new: str) -> str:
    """A text in the old one's style, or in double quotes where that style can't hold it."""
    printable = not re.search(r"[\x00-\x08\x0b-\x1f\x7f-\x9f\ufeff]", new) and "\r" not in new
    if old.style in ("|", ">") and printable and new.strip() and not new.startswith((" ", "\n", "\t")) and not new.endswith("\n") and not (old.style == ">" and re.search(r"\n[ \t]|^[ \t]", new)):
        return ("\n\n" if old.style == ">" else "\n").join(line and old.indent + line for line in (re.sub(r"\n(\n+)", r"\n\1", new) if old.style == ">" else new).split("\n"))
    if old.style in ("|", ">"):
        raise ValueError("a block can't hold the text")
    if old.style == "'" and printable and "\n" not in new:
        return "'" + new.replace("'", "''") + "'"
    plain = old.style in ("", "flow") and not UNSAFE.search(new) and not NO_TEXT.fullmatch(new) and not (old.style == "flow" and re.search(r"[,\[\]{}:#]", new))
    return new if plain else json.dumps(new, ensure_ascii=False).replace("\x7f", "\\x7f").replace("\x85", "\\N").replace("\u2028", "\\L").replace("\u2029", "\\P").replace("\ufeff", "\\ufeff")


FORMS = {"json": (json_texts, json_written), "json values": (lambda x: json_texts(x, True), json_written), "yaml": (yaml_texts, yaml_written)}


def merge_file(text: str, changes: dict[str, str], form: str) -> tuple[str, int]:
    """The file with its new texts and how many were written; it is read again, so that what comes out is sure to hold them."""
    read, write = FORMS[form]
    out, last, n = [], 0, 0
    for x in read(text):
        new = changes.get(x.pointer)
        if new is not None and new != x.value:
            out += [text[last : x.start], write(x, new)]
            last = x.end
            n += 1
    merged = "".join([*out, text[last:]])
    if n and any(changes.get(x.pointer, x.value) != x.value for x in read(merged)):
        raise ValueError("a text doesn't come back as it was written")
    return merged, n


TEXTS = t.StructType().add("pointer", "string").add("value", "string")


def read(df: DataFrame, keep: Sequence[str], text: str, form: str) -> DataFrame:
    """(keep, n, pointer, value) of every text of JSON or YAML files; ``faults`` tells of those that can't be read."""
    each = df.select(*keep, F.posexplode(_told(form)(F.col(text))["found"]).alias("n", "_x"))
    return each.select(*keep, "n", "_x.*")


def faults(df: DataFrame, keep: Sequence[str], text: str, form: str) -> DataFrame:
    """(keep, error) of the files that can't be read."""
    return df.select(*keep, _told(form)(F.col(text))["error"].alias("error")).where("error is not null")


def _told(form: str):
    @sliced(t.StructType().add("found", t.ArrayType(TEXTS)).add("error", "string"))
    def told(texts: list) -> list[dict]:
        def one(x: str | None):
            try:
                return [{"pointer": p.pointer, "value": p.value} for p in FORMS[form][0](x)] if x is not None else [], None
            except ValueError as e:
                return [], str(e)

        return [dict(zip(("found", "error"), one(x), strict=True)) for x in texts]

    return told


def merge(df: DataFrame, keep: Sequence[str], text: str, form: str, changes: DataFrame) -> DataFrame:
    """(keep, text, written, error): files with the texts of ``changes`` (keep, pointer, value); a file with an error stays as
    it is. ``keep`` names a file."""

    @sliced(t.StructType().add("text", "string").add("written", "long").add("error", "string"))
    def merged(texts: list, rows: list) -> list[dict]:
        def one(x: str | None, c):
            try:
                return (x, 0, None) if x is None else (*merge_file(x, {r["pointer"]: r["value"] for r in c}, form), None)
            except ValueError as e:
                return x, 0, str(e)

        return [dict(zip(("text", "written", "error"), one(x, c), strict=True)) for x, c in zip(texts, rows, strict=True)]

    rows = changes.where("value is not null").groupBy(*keep).agg(F.collect_list(F.struct("pointer", "value")).alias("_c"))
    both = df.select(*keep, F.col(text).alias("_text")).join(rows, list(keep), "left")
    told = merged("_text", F.coalesce("_c", F.array().cast("array<struct<pointer:string,value:string>>")))
    return both.select(*keep, told.alias("m")).select(*keep, "m.*")

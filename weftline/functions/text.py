"""Text functions on columns: normal forms, keys, word counts, language tags, extraction."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

URL = r"https?://[^\s<>]+"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
NUMBER = r"[0-9]+(?:[.,][0-9]+)*"
# A link runs over the characters that an address may hold, and letters beyond ASCII; quotes and brackets of codes end it.
LINK = r"\b(?:https?://|www\.)[-A-Za-z0-9._~:/?#@!$&()*+,;=%\[\]\u00C0-\u1FFF]+"
# What may follow the percent sign of a conversion in C, Objective-C and Python.
FLAGS, LENGTHS, CONVERSIONS = "-+0#'", ("hh", "h", "ll", "l", "L", "q", "j", "z", "t"), "diuxXeEfFgGcs@"
PATH = r"[A-Za-z_]\w*(?:[.-]\w+)*"


def conversion() -> str:
    """The regex of a printf conversion, put together in the order of its parts: position, flags, width, precision, length, letter."""
    number = r"(?:\d+|\*)"
    optional = [r"\d+\$", f"[{FLAGS}]+", number, rf"\.{number}", "|".join(LENGTHS)]
    return "%" + "".join(f"(?:{part})?" for part in optional) + f"[{CONVERSIONS}]"


#: Placeholders by where they are at home; the first that matches at a place wins.
PLACEHOLDERS = {
    "mustache": r"\{\{\{?[#/^&>!-]?[^{}]+\}?\}\}",
    "template literal": r"\$\{[^{}]+\}",
    "ruby": rf"%(?:\{{{PATH}\}}|<{PATH}>)",
    "python": rf"%\({PATH}\)[{CONVERSIONS}]",
    "format": rf"\{{(?:\d+|{PATH})\}}",
    "printf": conversion(),
}
PLACEHOLDER = "|".join(PLACEHOLDERS.values())


def signature(secret: bytes, seconds: Column, body: Column) -> Column:
    """HMAC-SHA256 of ``seconds.body``, as hex, for a webhook's header."""
    short = hashlib.sha256(secret).digest() if len(secret) > 64 else secret  # longer keys than a block are hashed first
    key = short.ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ x for b in key)) for x in (0x36, 0x5C))
    said = F.concat(seconds.cast("string"), F.lit("."), body).cast("binary")
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, said), 256))), 256)


def squeeze(text: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def source_key(text: Column, lang: Column) -> Column:
    """SHA-256 of language and squeezed lower-cased text, separated by U+001F."""
    return F.sha2(F.concat(primary(lang), F.lit("\u001f"), F.lower(squeeze(text))).cast("binary"), 256)


def context_key(before: Column, after: Column) -> Column:
    """SHA-256 of the neighbours' squeezed texts, separated by U+001E; order matters."""
    return F.sha2(F.concat(F.coalesce(squeeze(before), F.lit("")), F.lit("\u001e"), F.coalesce(squeeze(after), F.lit(""))).cast("binary"), 256)


def primary(lang: Column) -> Column:
    """Primary subtag of a language tag."""
    return F.split(F.lower(F.replace(lang, F.lit("_"), F.lit("-"))), "-")[0]


def script(lang: Column) -> Column:
    """Four-letter script subtag, or null."""
    return F.get(F.filter(F.split(F.lower(F.replace(lang, F.lit("_"), F.lit("-"))), "-"), lambda x: x.rlike("^[a-z]{4}$")), F.lit(0))


def scripts_agree(a: Column, b: Column) -> Column:
    """False only if both name a script and the scripts differ."""
    return F.coalesce(script(a) == script(b), F.lit(True))


def space_words(text: Column) -> Column:
    return F.when(squeeze(text) == "", 0).otherwise(F.size(F.split(squeeze(text), " ")))


def found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


# Letters with their marks and digits of any script; the narrow form is the one that SQL of f13 names.
LETTERS, ASCII_LETTERS = r"[\p{L}\p{M}\p{N}]+", "[a-z0-9]+"


def trigram_sequence(text: Column, word: str = LETTERS) -> Column:
    """The trigrams of the lower-cased words, runs of ``word``, each padded by two spaces before and one after, in order."""
    words = F.regexp_extract_all(F.lower(text), F.lit(word), F.lit(0))
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3)))))


def trigrams(text: Column, word: str = LETTERS) -> Column:
    """Distinct trigrams of the words of a text."""
    return F.array_distinct(trigram_sequence(text, word))


def formula_guard(text: Column) -> Column:
    """A leading apostrophe where a spreadsheet would read a formula."""
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def literal(part: str) -> Column:
    """A search text without wildcards."""
    return F.lit(part.lower())


def picked(key: Column, rate: float, steps: int = 10_000) -> Column:
    """True for a share of all keys, by the first 32 bits of the key's SHA-256."""
    head = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return head % steps < round(rate * steps)


OPEN, CLOSE = "\u0001", "\u0002"
CODE = "⟦/?[A-Za-z0-9_.-]+/?⟧"


def escape_brackets(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("⟦"), F.lit("⟦⟦")), F.lit("⟧"), F.lit("⟧⟧"))


def _guarded(tagged: Column) -> Column:
    return F.replace(F.replace(tagged, F.lit("⟦⟦"), F.lit(OPEN)), F.lit("⟧⟧"), F.lit(CLOSE))


def plain(tagged: Column) -> Column:
    """Tagged text without its inline codes; doubled brackets become single."""
    return F.replace(F.replace(F.regexp_replace(_guarded(tagged), CODE, ""), F.lit(OPEN), F.lit("⟦")), F.lit(CLOSE), F.lit("⟧"))


def codes(tagged: Column) -> Column:
    """Inline codes in order, repeats kept."""
    return found(_guarded(tagged), CODE)


def tag_problems(source: Column, target: Column) -> Column:
    """Sorted distinct problems of the target's codes against the source's.

    Counts: a code alone that is fewer in the target is missing; so is half of a pair, which makes the pair unbalanced, or
    dropped if neither half is left; a code that is more often there is extra, or unknown if the source has none of it.
    Nesting: a fold over the target's halves of pairs that the source opens keeps the open ones; to close any but the last
    is a wrong order, to close with none open, or to leave one open, is unbalanced.
    """
    name = lambda c: F.regexp_replace(c, "[⟦⟧/]", "")
    alone = lambda c: c.endswith("/⟧")
    count = lambda codes, c: F.size(F.filter(codes, lambda x: x == c))
    stray = lambda x: F.regexp_replace(F.replace(F.replace(x, F.lit("⟦⟦"), F.lit("")), F.lit("⟧⟧"), F.lit("")), CODE, "").rlike("[⟦⟧]")
    both_ends = lambda codes: F.exists(codes, lambda c: c.startswith("⟦/") & alone(c))
    want, have = codes(source), codes(target)
    halves = F.filter(have, lambda c: ~alone(c))
    fewer = F.filter(F.array_distinct(want), lambda c: count(have, c) < count(want, c))
    more = F.filter(F.array_distinct(have), lambda c: count(have, c) > count(want, c))
    split = F.filter(fewer, lambda c: ~alone(c))
    left = lambda c: F.exists(halves, lambda h: name(h) == name(c))
    paired = F.filter(halves, lambda h: F.array_contains(want, F.concat(F.lit("⟦"), name(h), F.lit("⟧"))))
    state = lambda stack, order, loose: F.struct(stack.alias("open"), order.alias("order"), loose.alias("loose"))

    def step(at: Column, half: Column) -> Column:
        opened, n = at["open"], name(half)
        closes, top = half.startswith("⟦/"), F.try_element_at(at["open"], F.lit(-1))
        none, known = F.size(opened) == 0, F.array_contains(opened, n)
        after = F.when(~closes, F.array_append(opened, n)).when(F.coalesce(top == n, F.lit(False)), F.slice(opened, 1, F.greatest(F.size(opened) - 1, F.lit(0)))).otherwise(F.array_remove(opened, n))
        wrong = closes & ~none & (~known | (top != n))
        return state(after, at["order"] | F.coalesce(wrong, F.lit(False)), at["loose"] | (closes & none))

    nested = F.aggregate(paired, state(F.array().cast("array<string>"), F.lit(False), F.lit(False)), step)
    found = F.array(
        F.when(F.exists(fewer, alone), "tag_missing"),
        F.when(F.exists(split, left) | nested["loose"] | (F.size(nested["open"]) > 0), "tag_unbalanced"),
        F.when(F.exists(split, lambda c: ~left(c)), "tag_pair_dropped"),
        F.when(F.exists(more, lambda c: F.array_contains(want, c)), "tag_extra"),
        F.when(F.exists(more, lambda c: ~F.array_contains(want, c)), "tag_unknown"),
        F.when(nested["order"], "tag_order"),
    )
    malformed = stray(source) | stray(target) | both_ends(want) | both_ends(have)
    return F.when(malformed, F.array(F.lit("tag_malformed"))).otherwise(F.array_sort(F.array_compact(found)))


def to_markup(tagged: Column) -> Column:
    """Inline codes as elements: g around text, x alone."""
    out = F.regexp_replace(tagged, "⟦([0-9]+)⟧", '<g id="$1">')
    return F.regexp_replace(F.regexp_replace(out, "⟦/[0-9]+⟧", "</g>"), "⟦([0-9]+)/⟧", '<x id="$1"/>')


def repeated_words(text: Column) -> Column:
    """How many words of letters are followed, after white space alone, by themselves again, whatever the case."""
    parts = F.split(F.lower(text), r"\s+")
    last = lambda x: F.regexp_extract(x, r"(?:^|[^\p{L}\p{N}_])(\p{L}+)$", 1)
    first = lambda x: F.regexp_extract(x, r"^(\p{L}+)(?:[^\p{L}\p{N}_]|$)", 1)
    ends, heads = F.transform(parts, last), F.slice(F.transform(parts, first), 2, F.size(parts))
    return F.size(F.filter(F.zip_with(ends, heads, lambda a, b: (a != "") & (a == b)), lambda x: x))


WORD = r"[\p{L}\p{N}_]+"
CJK = r"[\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}]"


def words(text: Column) -> Column:
    """Runs of letters, digits and underscores."""
    return found(text, WORD)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def script_words(text: Column) -> Column:
    """Words with half a word for each CJK character, one at least."""
    cjk = F.ceil(F.regexp_count(text, F.lit(CJK)) / 2)
    return F.greatest(F.lit(1), cjk + word_count(F.regexp_replace(text, CJK, " ")))


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance by the longer length; 0 for two empty texts."""
    return F.coalesce(F.levenshtein(a, b) / F.nullif(F.greatest(F.length(a), F.length(b)), F.lit(0)), F.lit(0.0))


def end_class(text: Column) -> Column:
    """What a text ends in, closing quotes and brackets aside."""
    bare = F.regexp_replace(text, r"[\"'”»)\]\s]+$", "")
    return F.when(bare.rlike("[.。]$"), "stop").when(bare.rlike("[?？;]$"), "question").when(bare.rlike("[!！]$"), "shout").otherwise("none")


def surface_checks(source: Column, target: Column) -> dict[str, Column]:
    """Checks of a target against its source that are plain expressions."""
    lead = lambda x: F.regexp_extract(x, r"^[ \t]*", 0)
    return {
        "punctuation_end": end_class(source) != end_class(target),
        "double_space": F.contains(target, F.lit("  ")) & ~F.contains(source, F.lit("  ")),
        "whitespace": lead(source) != lead(target),
        "untranslated": source == target,
        "length": F.length(target) > 2 * F.length(source),
    }


def mod97(digits: Column) -> Column:
    """A number of any length, as text, modulo 97: seven digits at a time."""
    parts = F.regexp_extract_all(digits, F.lit("[0-9]{1,7}"), F.lit(0))
    step = lambda acc, x: (acc * F.when(F.length(x) == 7, F.lit(10_000_000)).otherwise(F.pow(F.lit(10), F.length(x)).cast("long")) + x.cast("long")) % 97
    return F.aggregate(parts, F.lit(0).cast("long"), step)


def iban_valid(iban: Column) -> Column:
    """Country and check digits go to the end, letters become numbers; the rest modulo 97 is one."""
    moved = F.concat(F.substr(iban, F.lit(5)), F.substring(iban, 1, 4))
    digits = F.array_join(F.transform(F.split(moved, ""), lambda c: F.when(c.rlike("^[A-Z]$"), (F.ascii(c) - 55).cast("string")).otherwise(c)), "")
    return mod97(digits) == 1


FOLD_FROM, FOLD_TO = "àâäçéèêëîïôöùûüß", "aaaceeeeiioouuus"


def fold(text: Column) -> Column:
    """Lower case without accents, of the same length."""
    return F.translate(F.lower(text), FOLD_FROM, FOLD_TO)


def longest_prefix(text: Column, table: dict[str, float]) -> Column:
    """The value of the longest key that the text starts with, or null."""
    out = None
    for key in sorted(table, key=len, reverse=True):
        hit = F.startswith(text, F.lit(key))
        out = F.when(hit, table[key]) if out is None else out.when(hit, table[key])
    return out


def merged(defaults: Column, overrides: Column) -> Column:
    """Two maps in one; the second wins."""
    return F.map_concat(F.map_filter(defaults, lambda k, _: ~F.map_contains_key(overrides, k)), overrides)


def loose_stem_match(a: Column, b: Column) -> Column:
    """Lower-cased words that are equal, or share all but two last letters: at least four, and all but one of the shorter."""
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    k = F.greatest(F.lit(4), short - 1, long - 2)
    return (a == b) | ((k <= short) & (F.substr(a, F.lit(1), k) == F.substr(b, F.lit(1), k)))


# Serbian Cyrillic letters and their Latin ones; three are two letters.
CYRILLIC, LATIN = "абвгдђежзијклмнопрстћуфхцчш", "abvgdđežzijklmnoprstćufhcčš"
DIGRAPHS = {"љ": "lj", "њ": "nj", "џ": "dž"}


def latin(text: Column) -> Column:
    """Lower case, with Serbian Cyrillic in Latin letters."""
    out = F.translate(F.lower(text), CYRILLIC, LATIN)
    for a, b in DIGRAPHS.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


# What the last mark of a sentence says.
END_MARKS = {"stop": ".。．…", "excl": "!！¡", "q": "?？؟;；", "colon": ":："}


def end_mark(text: Column) -> Column:
    """The class of the last mark, closing quotes and brackets aside."""
    last = F.regexp_extract(text, r"(?s)(.)[\s\"')\]}»”’›]*$", 1)
    out = F.lit("none")
    for name, marks in END_MARKS.items():
        out = F.when(last.isin(*marks), name).otherwise(out)
    return out


def rendered(template: str, values: dict[str, Column]) -> Column:
    """A template whose {names} are replaced by values; a null value is empty, names without a value stay."""
    parts = re.split(r"\{(\w+)\}", template)
    told = [F.lit(p) if i % 2 == 0 else F.coalesce(values[p].cast("string"), F.lit("")) if p in values else F.lit("{" + p + "}") for i, p in enumerate(parts)]
    return F.concat(*told)

"""Stems by suffix rules: one engine, and a table of rules for each language after its published Snowball description.

A language has vowels, regions (R1 and R2 after the first and second vowel followed by another letter, RV for Spanish), and
steps. A step takes the longest of its suffixes that the word ends in; its rule acts if the suffix lies in the rule's region and
what stands before it fits. Words of other languages are their own stems, in lower case and composed form.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as t

from weftline.functions import text as T


class Rule(NamedTuple):
    suffixes: tuple[str, ...]
    region: str  # R1, R2, RV, or W for the whole word
    put: str  # what stands instead
    before: str  # a pattern that the rest must end in
    then: tuple[tuple[str, str, str], ...]  # (region, pattern at the end, replacement): the first that fits is applied


class Step(NamedTuple):
    rules: tuple[Rule, ...]
    inside: bool = False  # only suffixes that lie in their region are looked at


def rule(suffixes: str, region: str = "R1", put: str = "", before: str = "", then: tuple = ()) -> Rule:
    return Rule(tuple(suffixes.split()), region, put, before, then)


class Regions(NamedTuple):
    R1: int
    R2: int
    RV: int
    W: int = 0


class Language(NamedTuple):
    vowels: str
    steps: tuple  # Step, or a tuple of Steps of which the first that changes the word counts
    least: int = 0  # letters before R1
    prefixes: str = ""  # R1 begins behind these
    spanish: bool = False
    before: tuple[tuple[str, str], ...] = ()  # replacements on the word first
    after: str = ""  # letters to change at the end, and into what
    into: str = ""
    words: dict[str, str] = {}
    kept: tuple[str, ...] = ()  # words that stop after the second step


def _behind(word: str, vowels: str, start: int) -> int:
    m = re.compile(f"[{vowels}][^{vowels}]").search(word, start)
    return m.end() if m else len(word)


def regions(word: str, lang: Language) -> Regions:
    m = re.match(lang.prefixes, word) if lang.prefixes else None
    r1 = m.end() if m else _behind(word, lang.vowels, 0)
    r2 = _behind(word, lang.vowels, r1)
    rv = len(word)
    if lang.spanish and len(word) > 2:
        first, second = (c in lang.vowels for c in word[:2])
        found = re.compile(f"[{lang.vowels}]").search(word, 2) if not second else re.compile(f"[^{lang.vowels}]").search(word, 2) if first else None
        rv = 3 if second and not first else found.end() if found else len(word)
    return Regions(max(r1, min(lang.least, len(word))), r2, rv)


def apply(word: str, step: Step, at: Regions) -> str:
    best: tuple[str, Rule] | None = None
    for r in step.rules:
        for s in r.suffixes:
            if word.endswith(s) and (best is None or len(s) > len(best[0])) and not (step.inside and len(word) - len(s) < getattr(at, r.region)):
                best = s, r
    if best is None:
        return word
    s, r = best
    head = word[: len(word) - len(s)]
    if len(head) < getattr(at, r.region) or r.before and not re.search(f"(?:{r.before})$", head):
        return word
    out = head + r.put
    for region, pattern, put in r.then:
        m = re.search(f"(?:{pattern})$", out)
        if m and m.start() >= getattr(at, region):
            return out[: m.start()] + m.expand(put)
    return out


# The rules of the languages, by their Snowball descriptions.
EN_V = "aeiouy"
EN_SHORT_END, EN_SHORT_WHOLE = rf"[^{EN_V}][{EN_V}][^{EN_V}wxY]", rf"^[{EN_V}][^{EN_V}]"
EN_DOUBLED = (("W", "at|bl|iz", r"\g<0>e"), ("W", r"([bdfgmnprt])\1", r"\1"), ("W", rf"^(?:[^{EN_V}]*[{EN_V}][^{EN_V}wxY]|[{EN_V}][^{EN_V}])", r"\g<0>e"))
ENGLISH = Language(
    EN_V,
    (
        Step((rule("' 's 's'", "W"),)),
        Step((rule("sses", "W", "ss"), rule("ied ies", "W", "i", then=(("W", "^(.)i", r"\1ie"),)), rule("us ss", "W", "", "(?!)"), rule("s", "W", "", rf"[{EN_V}].+"))),
        Step((rule("eed eedly", "R1", "ee"), rule("ed edly ing ingly", "W", "", f"[{EN_V}].*", EN_DOUBLED))),
        Step((rule("y Y", "W", "i", f".[^{EN_V}]"),)),
        Step((
            rule("tional", put="tion"), rule("enci", put="ence"), rule("anci", put="ance"), rule("abli", put="able"), rule("entli", put="ent"), rule("izer ization", put="ize"),
            rule("ational ation ator", put="ate"), rule("alism aliti alli", put="al"), rule("fulness", put="ful"), rule("ousli ousness", put="ous"), rule("iveness iviti", put="ive"),
            rule("biliti bli", put="ble"), rule("ogi", put="og", before="l"), rule("fulli", put="ful"), rule("lessli", put="less"), rule("li", before="[cdeghkmnrt]"),
        )),
        Step((rule("tional", put="tion"), rule("ational", put="ate"), rule("alize", put="al"), rule("icate iciti ical", put="ic"), rule("ful ness"), rule("ative", "R2"))),
        Step((rule("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize", "R2"), rule("ion", "R2", before="[st]"))),
        (Step((rule("e", "R2"), rule("l", "R2", before="l"))), Step((rule("e", "R1", before=f"(?<!{EN_SHORT_END})(?<!{EN_SHORT_WHOLE})"),))),
    ),
    prefixes="gener|commun|arsen",
    before=(("^'", ""), ("^y", "Y"), (f"(?<=[{EN_V}])y", "Y")),
    after="Y", into="y",
    words={"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", **{w: w for w in "sky news howe atlas cosmos bias andes".split()}},
    kept=("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"),
)
GERMAN = Language(
    "aeiouyäöü",
    (
        Step((rule("em ern er"), rule("e en es", then=(("W", "niss", "nis"),)), rule("s", before="[bdfghklmnrt]"))),
        Step((rule("en er est"), rule("st", before="...[bdfghklmnt]"))),
        Step((
            rule("end ung", "R2", then=(("R2", "(?<!e)ig", ""),)), rule("ig ik isch", "R2", before="[^e]"),
            rule("lich heit", "R2", then=(("R1", "er|en", ""),)), rule("keit", "R2", then=(("R2", "lich|ig", ""),)),
        )),
    ),
    least=3,
    before=(("ß", "ss"), ("(?<=[aeiouyäöü])u(?=[aeiouyäöü])", "U"), ("(?<=[aeiouyäöü])y(?=[aeiouyäöü])", "Y")),
    after="UYäöü", into="uyaou",
)
SWEDISH = Language(
    "aeiouyäåö",
    (
        Step((rule("a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas es ades andes ens arens hetens erns at andet het ast"), rule("s", before="[bcdfghjklmnoprtvy]")), True),
        Step((rule("dd", put="d"), rule("gd", put="g"), rule("nn", put="n"), rule("dt", put="d"), rule("gt", put="g"), rule("kt", put="k"), rule("tt", put="t")), True),
        Step((rule("lig ig els"), rule("löst", put="lös"), rule("fullt", put="full")), True),
    ),
    least=3,
)
NORWEGIAN = Language(
    "aeiouyæåø",
    (
        Step((rule("a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ers ets et het ast"), rule("s", before="[bcdfghjlmnoprtvyz]|[^aeiouyæåø]k"), rule("erte ert", put="er")), True),
        Step((rule("dt", put="d"), rule("vt", put="v")), True),
        Step((rule("leg eleg ig eig lig elig els lov elov slov hetslov"),), True),
    ),
    least=3,
)
DA_PAIR = Step((rule("gd", put="g"), rule("dt", put="d"), rule("gt", put="g"), rule("kt", put="k")), True)
DANISH = Language(
    "aeiouyæåø",
    (
        Step((rule("hed ethed ered e erede ende erende ene erne ere en heden eren er heder erer heds es endes erendes enes ernes eres ens hedens erens ers ets erets et eret"), rule("s", before="[abcdfghjklmnoprtvyzå]")), True),
        DA_PAIR,
        Step((rule("igst", "W", "ig"),)),
        Step((rule("ig lig elig els", then=(("R1", "([gdk])(?<=gd|dt|gt|kt)[dt]", r"\1"),)), rule("løst", put="løs")), True),
        Step(tuple(rule(c + c, put=c) for c in "bcdfghjklmnpqrstvwxz"), True),
    ),
    least=3,
)
ES_PRONOUNS = "me se sela selo selas selos la le lo las les los nos"
ES_AT = (("R2", "ic", ""),)
SPANISH = Language(
    "aeiouáéíóúü",
    (
        Step(tuple(rule(ES_PRONOUNS, "RV", "", verb, then) for verb, then in ((r"iéndo|ándo|ár|ér|ír|ando|iendo|ar|er|ir|uyendo", tuple(("RV", a, b) for a, b in (("iéndo", "iendo"), ("ándo", "ando"), ("ár", "ar"), ("ér", "er"), ("ír", "ir")))),))),
        (
            Step((
                rule("anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos", "R2"),
                rule("adora ador ación adoras adores aciones ante antes ancia ancias", "R2", then=ES_AT), rule("logía logías", "R2", "log"), rule("ución uciones", "R2", "u"), rule("encia encias", "R2", "ente"),
                rule("amente", "R1", then=(("R2", "ativ|iv|os|ic|ad", ""),)), rule("mente", "R2", then=(("R2", "ante|able|ible", ""),)), rule("idad idades", "R2", then=(("R2", "abil|ic|iv", ""),)), rule("iva ivo ivas ivos", "R2", then=(("R2", "at", ""),)),
            )),
            Step((rule("ya ye yan yen yeron yendo yo yó yas yes yais yamos", "RV", before="u"),), True),
            Step((
                rule("en es éis emos", "RV", then=(("W", "gu", "g"),)),
                rule("arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos", "RV"),
            ), True),
        ),
        Step((rule("os a o á í ó", "RV"), rule("e é", "RV", then=(("RV", "(?<=g)u", ""),)))),
    ),
    spanish=True, after="áéíóú", into="aeiou",
)
LANGUAGES = {"en": ENGLISH, "de": GERMAN, "sv": SWEDISH, "no": NORWEGIAN, "nb": NORWEGIAN, "nn": NORWEGIAN, "da": DANISH, "es": SPANISH}
# Languages that are written in both scripts.
BOTH_SCRIPTS = ("sr", "bs", "me", "cnr", "sh")
_LATIN = str.maketrans(dict(zip(T.CYRILLIC, T.LATIN, strict=True)) | T.DIGRAPHS)


@lru_cache(1 << 18)
def stem(word: str, lang: str) -> str:
    """The stem of a word, in lower case and composed form."""
    w = unicodedata.normalize("NFC", word).lower()
    code = re.split("[-_]", (lang or "").strip().lower())[0]
    if code in BOTH_SCRIPTS:
        w = w.translate(_LATIN)
    table = LANGUAGES.get(code)
    if table is None or len(w) < 3 and code == "en":
        return w
    if w in table.words:
        return table.words[w]
    for pattern, put in table.before:
        w = re.sub(pattern, put, w)
    at = regions(w, table)
    for i, step in enumerate(table.steps):
        if i == 2 and w in table.kept:
            break
        old = w
        for choice in step if isinstance(step[0], Step) else (step,):
            w = apply(w, choice, at)
            if w != old:
                break
    return w.translate(str.maketrans(table.after, table.into))


@F.pandas_udf(t.StringType())
def stemmed(word: pd.Series, lang: pd.Series) -> pd.Series:
    return pd.Series([None if w is None else stem(w, x) for w, x in zip(word, lang, strict=True)], dtype=object)

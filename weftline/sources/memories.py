"""Memory files as units: every unit with its source and its translations, or with the fault that keeps it out.

Units are cut out of whole files in the plan and parsed one by one, so the work is spread by units and a broken unit takes no
other with it. Inline elements become codes whose numbers are one count over the unit: an opening and a closing element of one
``i`` are a pair, elements that stand alone meet across languages by ``x``, or by their place among their kind where they have
none. A highlighted run is a pair of codes around its text.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.sources.xliff import events

UNIT = r"""(?s)<tu(?=[\s/>])(?:[^>"']|"[^"]*"|'[^']*')*?(?:/>|>.*?</tu\s*>)"""
FOUND = "context string, source_lang string, source string, targets array<struct<lang:string,text:string>>, variants int, fault string"
# Inline elements, by how they stand in a text. Their content is markup, but for highlights'.
FORMS = {"bpt": "⟦{}⟧", "ept": "⟦/{}⟧", "ph": "⟦{}/⟧", "ut": "⟦{}/⟧", "it": "⟦{}⟧", "hi": "⟦{}⟧"}


def same_language(a: str, b: str) -> bool:
    """One primary subtag and not two different scripts."""
    x, y = (lang.lower().replace("_", "-").split("-") for lang in (a, b))
    scripts = {p for tags in (x, y) for p in tags[1:] if len(p) == 4 and p.isalpha()}
    return x[0] == y[0] and len(scripts) < 2


class Numbers:
    """Numbers of a unit's codes, given out as identities are met first."""

    def __init__(self) -> None:
        self.known: dict[tuple, int] = {}

    def of(self, name: str, attrs: dict, seen: dict[str, int]) -> int:
        if name in ("bpt", "ept"):
            who = ("pair", attrs.get("i") or attrs.get("x"))
        else:
            name = "ph" if name == "ut" else name
            seen[name] = seen.get(name, 0) + 1
            who = (name, "x", attrs["x"]) if attrs.get("x") else (name, "place", seen[name])
        return self.known.setdefault(who, len(self.known) + 1)


def tagged(inside: list, numbers: Numbers) -> str:
    """The events of a segment as text with codes."""
    out: list[str] = []
    seen: dict[str, int] = {}
    closing: list[str] = []
    hidden = 0
    for e in inside:
        if e.kind == "text":
            out.append("" if hidden else e.text.replace("⟦", "⟦⟦").replace("⟧", "⟧⟧"))
        elif e.kind == "start":
            end, hides = "", e.name == "sub" or (e.name in FORMS and e.name != "hi")
            if not hidden and e.name in FORMS:
                n = numbers.of(e.name, e.attrs, seen)
                form = FORMS["ept"] if e.name == "it" and e.attrs.get("pos") == "end" else FORMS[e.name]
                out.append(form.format(n))
                end = f"⟦/{n}⟧" if e.name == "hi" else ""
            hidden += hides
            closing.append((end, hides))
        else:
            end, hides = closing.pop()
            hidden -= hides
            out.append(end)
    return "".join(out)


def unit(text: str, told: str | None) -> tuple:
    """A unit as a row of ``FOUND``; ``told`` is the language of the source, the first variant's if there is none."""
    try:
        all_events = list(events(text.encode()))
    except ValueError as e:
        return None, None, None, [], 0, str(e)
    depth, context, variants, start, lang = 0, None, [], None, None
    for i, e in enumerate(all_events):
        if e.kind == "start":
            depth += 1
            if depth == 2:
                lang = (e.attrs.get("xml:lang") or e.attrs.get("lang")) if e.name == "tuv" else None
                prop = e.name == "prop" and e.attrs.get("type") == "x-context"
                told_context = [] if prop else None
            elif depth == 3 and e.name == "seg" and lang and start is None:
                start = i + 1
        elif e.kind == "end":
            if depth == 3 and start is not None and e.name == "seg":
                variants.append((lang, all_events[start:i]))
                start = lang = None
            elif depth == 2 and told_context is not None:
                context, told_context = "".join(told_context).strip() or None, None
            depth -= 1
        elif depth == 2 and told_context is not None:
            told_context.append(e.text)
    at = next((i for i, (lang, _) in enumerate(variants) if not told or same_language(lang, told)), None)
    if len(variants) < 2:
        return context, None, None, [], len(variants), None
    if at is None:
        return context, None, None, [], len(variants), f"no variant in {told}"
    numbers = Numbers()
    source = tagged(variants[at][1], numbers)
    targets = [{"lang": lang, "text": tagged(inside, numbers)} for i, (lang, inside) in enumerate(variants) if i != at]
    return context, variants[at][0], source, targets, len(variants), None


def _unit(texts: pd.Series, told: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([unit(a, b) for a, b in zip(texts, told, strict=True)], columns=[c.split()[0] for c in FOUND.split(", ")])


def units(df: DataFrame, keep: Sequence[str], text: str, source_lang: str | None = None) -> DataFrame:
    """(keep, n, context, source_lang, source, targets, variants, fault) of the memories in a column, units numbered from 1.

    The source is the variant in the header's language, in ``source_lang`` where the header says ``*all*`` or nothing, and the
    first one if neither is known. A unit with fewer than two variants has no source. A null or empty file has no units.
    """
    plain = F.regexp_replace(F.col(text), r"(?s)<!--.*?-->", "")
    said = F.regexp_extract(plain, r"""(?s)<header\b[^>]*?\bsrclang\s*=\s*["']([^"']*)["']""", 1)
    told = F.when((said == "") | (F.lower(said) == "*all*"), F.lit(source_lang)).otherwise(said)
    cut = df.select(*keep, told.alias("_told"), F.posexplode(F.regexp_extract_all(plain, F.lit(UNIT), F.lit(0))).alias("n", "_unit"))
    return cut.select(*keep, (F.col("n") + 1).alias("n"), F.pandas_udf(_unit, FOUND)("_unit", "_told").alias("_u")).select(*keep, "n", "_u.*")

"""Stems on golden words, worked out from the published rules, and glossaries that use them."""

import random

import pytest

from weftline.functions import stems
from weftline.operators import glossary
from weftline.plans import registry

GOLDEN = {
    "en": """consign consign consigned consign consigning consign consignment consign consistency consist knackeries knackeri knightly knight generously generous relational relat
        conditional condit hopping hop hoping hope falling fall cries cri dies die ties tie gas gas kiwis kiwi agreed agre happy happi says say by by enjoy enjoy communism communism
        sensibility sensibl national nation rationalize ration electricity electr adjustment adjust replacement replac hopefulness hope goodness good probate probat rate rate controlling control
        luxuriated luxuri skies sky inning inning exceed exceed yes yes youth youth boyish boyish valleys valley this this possibly possibl formative format digitizer digit beds bed owed owe running run dog's dog""",
    "de": """aufeinanderfolgenden aufeinanderfolg kategorien kategori kategorischen kategor Vertrag vertrag Verträge vertrag Verträgen vertrag Häuser haus bedürfnisse bedurfnis abhängigkeit abhang
        freundlich freundlich schönheit schonheit bedeutung bedeut wissenschaftliche wissenschaft jährlicher jahrlich jugendlichen jugend großen gross straßen strass""",
    "sv": "jaktkarlarne jaktkarl klokheten klok kloster klost friheten frihet bildligt bild",
    "da": "undersøgelserne undersøg undervisning undervisning indtager indtag skriftlig skrift venlighed ven",
    "nb": "havnedistriktene havnedistrikt havneeier havneei opning opning boligene bol",
    "es": "cheques chequ chicharrones chicharron chico chic torneado torn toro tor tortillas tortill tornar torn rápidamente rapid comunidades comun habitación habit nacionales nacional contribución contribu",
    "sr-Cyrl": "Уговор ugovor Љубав ljubav",
    "xx": "Words words",
}


@pytest.mark.parametrize("lang", GOLDEN)
def test_golden_words(lang):
    words = GOLDEN[lang].split()
    assert {w: stems.stem(w, lang) for w in words[::2]} == dict(zip(words[::2], words[1::2], strict=True))


def test_any_word_has_a_stem():
    rng = random.Random(2)
    letters = "aeiouyäöüßåøæáéíóúñbcdfghklmnprstvz'"
    for lang in stems.LANGUAGES:
        for _ in range(3000):
            word = "".join(rng.choices(letters, k=rng.randint(0, 14)))
            out = stems.stem(word, lang)
            assert out == stems.stem(word.upper() if "ß" not in word else word, lang) and len(out) <= len(word) + 1 + word.count("ß")


def test_glossary_by_stems(spark):
    """Forms that differ in more than their last two letters, and words that are alike but of other stems."""
    terms = spark.createDataFrame([(1, "mandatory", "possibility", "Möglichkeit", False), (2, "mandatory", "generous gift", "Geschenk", False), (3, "forbidden", None, "Haus", False)], "term_id long, kind string, source_term string, target_term string, case_sensitive boolean")
    rows = [(1, "Possibilities of generously given generous gifts", "Möglichkeiten, Geschenke"), (2, "positions", "Häuser"), (3, "A possibility", "nichts"), (4, "", "Hausierer")]
    s = spark.createDataFrame(rows, "id long, source string, target string")
    hits = glossary.find_terms(s, terms, ["id"], "en-GB")
    assert {(r.id, tuple(h.term_id for h in r.hits)) for r in hits.collect()} == {(1, (1, 2)), (3, (1,))}
    broken = glossary.violations(hits.join(s.select("id", "target"), "id"), ["id"], "target", lang="de")
    assert [(r.id, r.term_id, r.code) for r in broken.collect()] == [(3, 1, "term_missing")]
    assert [(r.id, r.term_id) for r in glossary.forbidden(s, terms, ["id"], "target", "de").collect()] == [(2, 3)]


def test_stems_of_all_words(spark, sf_dir):
    rows = registry.QUERIES["f08_stems"](spark, sf_dir).collect()
    assert {r.lang for r in rows} == {"de", "en", "es", "fr"} and all(r.stem == stems.stem(r.word, r.lang) for r in rows)
    assert all(r.stem == r.word for r in rows if r.lang == "fr") and len({(r.lang, r.word) for r in rows}) == len(rows)

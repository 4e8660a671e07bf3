"""Tables with the cases that every operator must survive."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, c0 string, id string, h string, TEXT string, key int, label int"
EXTRA = ("x", "y", "z", "other text", 7, 9)
PROSE = {
    "en": "the river ran past the old house and the people of the town walked along it every evening",
    "de": "der fluss floss am alten haus vorbei und die leute der stadt gingen jeden abend an ihm entlang",
    "fr": "la rivière passait devant la vieille maison et les gens de la ville la longeaient chaque soir",
}


def row(doc_id, text, lang="en", source="web"):
    return (doc_id, text, lang, source, None if text is None else len(text), *EXTRA)


@pytest.fixture
def table(spark):
    return lambda rows: spark.createDataFrame([x if len(x) > 5 else row(*x) for x in rows], SCHEMA)


@pytest.fixture
def odd_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    long_ = (PROSE["en"] + "\n") * 20_000
    rows = [row(None, PROSE["en"]), row(1, None), row(2, ""), row(3, long_), row(4, PROSE["de"]), row(4, PROSE["de"]), row(5, PROSE["de"]), row(6, PROSE["fr"], None, None), row(7, "?!"), row(8, "x" * 100_000)]
    return [*rows, (9, PROSE["fr"], "fr", "web", None, *[None] * 6)]

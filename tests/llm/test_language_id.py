"""Language ID: parsing against a naive longest-match parse, and accuracy on held-out rows."""

import random

import pytest

from quarrygraph.llm import language_id as L

WORDS = {"xx": ["foo", "bar", "bazooka", "quux", "lorem"], "yy": ["ñandu", "über", "gärten", "weiß", "öl"], "zz": ["kata", "hira", "gana", "moji", "sensei"]}


def text(lang, rnd, n):
    return " ".join(rnd.choice(WORDS[lang]) for _ in range(n)).capitalize() + "."


def naive(said, sample):
    count = i = 0
    while i < len(said):
        j = i + 1
        while j <= len(said) and said[i:j] in sample:
            j += 1
        i, count = max(i + 1, j - 1), count + 1
    return count / len(said)


@pytest.mark.parametrize("cells", [L.DENSE_CELLS, 0])
def test_phrases_as_a_naive_parse_of_the_whole_text_finds_them(monkeypatch, cells):
    rnd = random.Random(1)
    samples = {lang: L.normalise(text(lang, rnd, 200)) for lang in WORDS}
    parser = L.CrossParser(samples, cells)
    tried = [text(rnd.choice("xx yy zz".split()), rnd, rnd.randint(1, 300)) for _ in range(40)] + ["东京 foo!", "x", samples["xx"] * 3, "东京" * 700]
    for window, lanes in ((512, 4096), (7, 4096), (16, 5), (1, 3)):
        monkeypatch.setattr(L, "WINDOW", window)
        monkeypatch.setattr(L, "_LANES", lanes)
        for row, said in zip(parser.rates(tried), tried):
            assert [round(x, 9) for x in row] == [round(naive(L.normalise(said), samples[lang]), 9) for lang in parser.langs]


def test_a_language_with_less_training_text_is_no_worse_off():
    rnd = random.Random(4)
    samples = {"xx": L.normalise(text("xx", rnd, 4000)), "yy": L.normalise(text("yy", rnd, 60))}
    assert L.CrossParser(samples).predict([text("yy", rnd, 30), text("xx", rnd, 30)])[0] == ["yy", "xx"]


def test_normal_form():
    assert L.normalise("  Ab,c\n12 ÉÀ—x ") == "ab c éà x"
    assert L.normalise("123 ...") == "" and L.normalise("") == ""


def test_held_out_rows(spark):
    rnd = random.Random(2)
    rows = [(i, text(lang := rnd.choice(list(WORDS)), rnd, rnd.randint(3, 40)), lang) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in L.identify(docs, L.training_samples(docs, 2000, 100)).collect()}
    held = [i for i, _, _ in rows if out[i].held_out]
    assert 60 < len(held) < 140
    assert sum(out[i].lang_pred == rows[i][2] for i in held) >= 0.99 * len(held)
    assert all(0 <= r.score <= 1 for r in out.values())


def test_awkward_rows(awkward, clashing, empty):
    samples = {"en": "the fox and the dog", "de": "der fuchs und der hund"}
    out = L.identify(awkward, samples).collect()
    assert len(out) == awkward.count()
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (3, 4, 5)) and by[1].lang_pred == "en"
    assert L.identify(clashing, samples).count() == len(out) and L.identify(empty, samples).count() == 0
    assert {r.lang_pred for r in L.identify(awkward, {}).collect()} == {"und"}
    assert L.training_samples(empty) == {}
    kept = L.accepted(clashing, samples)
    assert kept.columns == clashing.columns and kept.where("doc_id IN (3, 4, 5)").count() == 0


def test_samples_of_long_rows_and_of_many_short_rows(spark):
    ones = [(k, "the cat sat on the mat and the dog ran " * 40, "en") for k in range(30)]
    long = [(100 + k, "der hund und die katze sind im haus und garten " * 60, "de") for k in range(30)]
    short = [(1000 + k, f"le chat {chr(97 + k % 26)}", "fr") for k in range(900)]
    docs = spark.createDataFrame(ones + long + short, "doc_id long, text string, lang string")
    samples = L.training_samples(docs, sample_chars=2000, sample_rows=10)
    assert {k: len(v) for k, v in samples.items()} == {"en": 2000, "de": 2000, "fr": 2000}
    one = L.training_samples(docs.where("lang = 'de' AND doc_id < 103"), sample_chars=2000)
    assert one.keys() == {"de"} and len(one["de"]) == 2000
    got = {r.doc_id: r.lang_pred for r in L.identify(docs.where("doc_id < 1000"), samples).collect()}
    assert all(lang == ("en" if k < 100 else "de") for k, lang in got.items())

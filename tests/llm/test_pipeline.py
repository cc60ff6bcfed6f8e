"""The pipeline against its stages worked by hand."""

import random

import corpus_pipeline as P
from quarrygraph.llm import byte_bpe

from .test_near_dedup import brute

SECRET = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'


def rows():
    rnd = random.Random(5)
    words = [f"{a}{b}" for a in "ba de fi go lu ma ne po ri su".split() for b in "ka le mi no tu ra se vi".split()]
    out = []
    for i in range(60):
        text = " ".join(rnd.choice(words) for _ in range(rnd.randint(20, 60))) + "."
        out.append((i, text + (" " + SECRET if i % 10 == 0 else ""), "xx", f"s{i % 3}", len(text)))
    out += [(100 + i, out[i][1], "xx", "s1", 1) for i in range(10)] + [(200, "123 456", "xx", "s0", 7), (201, None, None, "s0", None)]
    return out


def test_awkward_rows_in_every_stage(spark, awkward, clashing, empty, tmp_path):
    clashing.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, empty, str(tmp_path)).count() == 0
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        seen = sorted(((r.doc_id, (r.text or "")[:9]) for r in out.collect()), key=str)
        if name == "near_dedup":
            assert len(seen) == 12 and len(set(seen)) == 12
        if name == "secret_scan":
            assert len(seen) == awkward.count() and all(r.h == "x" for r in out.collect())
    assert P.STAGES[-1][1](spark, docs, str(tmp_path)).count() == awkward.count()
    assert {r.doc_id for r in P.run(spark, str(tmp_path)).collect()} <= {1, 2, 6, 7, 8, 9, 10, 11, None}


def test_different_texts_under_one_id_stay(spark):
    texts = [f"{who} walks along the quiet road {where} today" for who, where in (("the old dog", "to a market"), ("one red fox", "into our wood"), ("my grey cat", "past the mill"))]
    docs = spark.createDataFrame([(1, texts[0], "en", "a", 1), (1, texts[1], "en", "a", 1), (None, texts[2], "en", "a", 1), (1, texts[0], "en", "a", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.text for r in P.remove_near_duplicates(spark, docs, "").collect()) == sorted(texts)


def test_stages(spark, tmp_path):
    table = rows()
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    kept = P.identify_language(spark, docs, str(tmp_path))
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == {r[0] for r in table} - {200, 201}
    single = P.remove_near_duplicates(spark, kept, str(tmp_path))
    left = [(r.doc_id, r.text) for r in kept.collect()]
    assert single.columns == columns and {r.doc_id for r in single.collect()} == {i for i, (_, root) in brute(left, 5, 80).items() if i == root}
    clean = P.redact_secrets(spark, single, str(tmp_path))
    found = {r.doc_id: r for r in clean.collect()}
    assert clean.columns == columns and len(found) == single.count() and not any("04db" in r.text for r in found.values())
    assert all(r.n_chars == len(r.text) for r in found.values()) and all(found[i].text == table[i][1] for i in range(60) if i % 10)
    mixed = P.mix_sources(spark, clean, str(tmp_path))
    assert mixed.columns == columns and {r.doc_id for r in mixed.collect()} <= set(found)
    out = P.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in mixed.collect())
    coder = byte_bpe._coder(byte_bpe.VOCABULARY)
    assert all(r.ids == coder.encode_ordinary(found[r.doc_id].text) and r.n_tokens == len(r.ids) for r in out)

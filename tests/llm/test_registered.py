"""The registered queries themselves, on small tables: SQL twins where there are any, the public libraries or plain computations elsewhere."""

import hashlib
import zlib

import duckdb
import public_tokenizers
import pytest

from quarrygraph.llm import byte_bpe
from quarrygraph.llm.registry import ORACLES, QUERIES

from .conftest import AWKWARD, DOCS
from .test_near_dedup import brute, texts


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    more = [(1000 + i, t + (".\nHome | News | Sport | Weather | Contact" if i % 3 else " a | b | c # $"), ["xx", "yy", None][i % 3], ["s1", "s2", None, "s3"][i % 4], len(t)) for i, t in texts(9, 90)]
    rows = [r for r in AWKWARD if r[0] is not None] + more
    spark.createDataFrame(rows, DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, f"http://h/{i}", f"<article><p>Text {i} &amp; more</p></article><nav>n</nav>") for i in range(5)] + [(9, None, None)], "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "<|im_end|>b"), (2, 0, "assistant", None)], "conv_id long, turn long, role string, text string").write.parquet(f"{at}/conversations.parquet")
    return at, rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twins(spark, folder, name):
    got = QUERIES[name](spark, folder[0])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder[0]}/documents.parquet/*.parquet'")
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r[n] for n in names)) for r in got.collect())


def test_op1(spark, folder):
    rows = [(r[0], r[1]) for r in folder[1]]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op1_near_dedup"](spark, folder[0]).collect()}
    assert got == brute(list(dict(rows).items()), 3, 85)


def test_op2_and_op3_and_op5(spark, folder):
    out = QUERIES["op2_language_id"](spark, folder[0]).collect()
    assert len(out) == len(folder[1]) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in out)
    pages = {r.page_id: (r.text, r.n_chars) for r in QUERIES["op3_html_extract"](spark, folder[0]).collect()}
    assert pages == {**{i: (f"Text {i} & more", 13) for i in range(5)}, 9: ("", 0)}
    assert {r.doc_id for r in QUERIES["op5_secret_scan"](spark, folder[0]).collect() if r.is_secret} == {10}


def test_op4(spark, folder):
    from tokenizers import Tokenizer

    coder, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    found = sorted(QUERIES["op4_token_files"](spark, folder[0]).collect(), key=lambda r: (r.doc_id, r.start))
    for r, (doc_id, text) in zip(found, sorted(((r[0], r[1] or "") for r in folder[1])), strict=True):
        ids = [*coder.encode(text, add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        start += len(ids)


def test_op7_and_op8(spark, folder):
    media = {r.doc_id: r for r in QUERIES["op7_transport_media"](spark, folder[0]).collect()}
    for doc_id, text in {r[0]: (r[1] or "").encode() for r in folder[1]}.items():
        payload = text.ljust(max(1, -(-len(text) // 192)) * 192)
        assert (media[doc_id].n_bytes, media[doc_id].payload_sha256, media[doc_id].tail_crc32) == (len(text), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    own = "</s>[INST] ok [/INST]"
    said = {1: [("user", "a"), ("assistant", "<|im_end|>b")], 2: [("assistant", "")], -1: [("user", own), ("assistant", own)]}
    got = {r.conv_id: r for r in QUERIES["op8_chat_format"](spark, folder[0]).collect()}
    for conv, turns in said.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_op10(spark, folder):
    coder = byte_bpe._coder(byte_bpe.VOCABULARY)
    want = sorted((r[0], len(ids := coder.encode_ordinary(r[1] or "")), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in folder[1])
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op10_byte_bpe"](spark, folder[0]).collect()) == want

"""Token files against the library itself."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quarrygraph.llm import token_files as T


def test_pieces_as_the_library_encodes_texts():
    coder = T.PartEncoder(public_tokenizers.path(T.VOCABULARY))
    rnd = random.Random(3)
    letters = "abcXYZ019'''sdtlmrve  \t\n\r\x0b\x0c\x00\x1c\x1f\x7fÀÉßÿ÷×éœΣσς́ \u0085#$%_-İıǅ²½"
    plain = [c for c in letters if ord(c) < 128 or c in "ÀÉßÿé"]
    for k in range(3000):
        said = "".join(rnd.choice(plain if k % 2 else letters) for _ in range(rnd.randint(0, 25))) + ("<|endoftext|>x" if k % 17 == 0 else "")
        assert np.frombuffer(coder.encode([said.encode()])[0], "<u4").tolist() == coder.tokenizer.encode(said, add_special_tokens=False).ids, said


def test_files_round_trip(spark, awkward, clashing, empty, tmp_path):
    T.write_tokens(awkward.repartition(3), str(tmp_path / "t"))
    got = T.read_tokens(spark, str(tmp_path / "t")).collect()
    own = Tokenizer.from_file(public_tokenizers.path(T.VOCABULARY))
    rows = sorted(awkward.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    start = 0
    for row, found in zip(rows, sorted(got, key=lambda r: r.start)):
        ids = [*own.encode(row.text or "", add_special_tokens=False).ids, T.END_ID]
        assert (found.doc_id, found.start, found.n_tokens, found.ids) == (row.doc_id, start, len(ids), ids)
        start += len(ids)
    some = T.read_tokens(spark, str(tmp_path / "t"), [2, 9])
    assert sorted(r.doc_id for r in some.collect()) == [2, 2, 9]
    assert "PushedFilters" in some._jdf.queryExecution().toString() and "doc_id" in some._jdf.queryExecution().toString()
    T.write_tokens(clashing, str(tmp_path / "c"))
    assert T.read_tokens(spark, str(tmp_path / "c")).count() == len(rows)
    T.write_tokens(empty, str(tmp_path / "e"))
    assert T.read_tokens(spark, str(tmp_path / "e")).count() == 0

"""Byte-level BPE against the library, over several blocks and buckets."""

import hashlib
import random

from quarrygraph.llm import byte_bpe as B


def test_as_the_library_encodes(spark, awkward):
    coder = B._coder(B.VOCABULARY)
    rnd = random.Random(4)
    letters = "abc ABC  \n\t'sre123é东\U0001f600 ́.,;\x00"
    rows = [(i, "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 80)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.ids for r in B.encode(docs, block_bytes=2000).collect()}
    assert got == {i: coder.encode_ordinary(t) for i, t in rows}
    raw = {r.doc_id: bytes(r.raw) for r in B.decode(B.encode(docs)).collect()}
    assert raw == {i: t.encode() for i, t in rows}


def test_awkward_rows(awkward, clashing, empty):
    coder = B._coder(B.VOCABULARY)
    want = sorted((str(r.doc_id), hashlib.sha256(" ".join(map(str, coder.encode_ordinary(r.text or ""))).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in awkward.collect())
    for docs in (awkward, clashing):
        assert sorted((str(r.doc_id), r.ids_sha256, r.decoded_sha256) for r in B.digests(docs, block_bytes=500).collect()) == want
    assert B.digests(empty).count() == 0 and B.encode(empty).count() == 0


def test_varints():
    import numpy as np

    values = np.array([0, 1, 127, 128, 16383, 16384, 2**21, 2**28, 2**32 - 1], np.uint32)
    assert B._unvarints(B._varints(values)).tolist() == values.tolist() and len(B._unvarints(B._varints(values[:0]))) == 0
    assert B._unpack(B._pack([b"", b"a", b"bc" * 500])) == [b"", b"a", b"bc" * 500] and B._unpack(B._pack([])) == []

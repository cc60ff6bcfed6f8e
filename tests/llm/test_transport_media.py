"""Transport streams: exact round trips and damage."""

import hashlib
import os
import zlib

import pytest

from quarrygraph.llm import transport_media as M


@pytest.mark.parametrize("n", [*range(1, 400, 7), 4095, 4096, 4097, 8192, 70000])
def test_round_trip(n):
    payload = os.urandom(n)
    stream, points = M.mux(payload)
    back, found = M.demux(stream)
    assert back == payload and [k for _, k in points] == found["points"]
    assert found["stamps"] == [M.TICKS * k for k in range(len(found["stamps"]))] and len(stream) % 188 == 0


def test_damage_is_seen():
    stream, _ = M.mux(os.urandom(5000))
    for broken in (stream[:-188], stream[: 188 * 4] + stream[188 * 5 :], b"\0" + stream[1:], stream[:20] + b"\xff" + stream[21:], stream[:-1]):
        with pytest.raises(ValueError):
            M.demux(broken)


def test_awkward_rows(awkward, clashing, empty):
    out = M.features(M.media_table(awkward)).collect()
    texts = {r.doc_id: r.text for r in awkward.collect() if r.doc_id is not None}
    assert len(out) == awkward.count()
    for r in out:
        if r.doc_id is not None:
            size = len((texts[r.doc_id] or "").encode())
            assert r.n_bytes == size and r.payload_bytes % 192 == 0 and 0 <= r.payload_bytes - size < 192 + (size == 0)
    same = {(r.media_sha256, r.feature) for r in out if r.doc_id in (1, 2)}
    assert len(same) == 1
    assert M.features(M.media_table(clashing)).count() == len(out) and M.features(M.media_table(empty)).count() == 0


def test_digests_recomputed_and_damage_in_a_row(spark, awkward):
    from pyspark.sql import functions as F

    media = M.media_table(awkward.where("doc_id IS NOT NULL"))
    stored = {r.doc_id: bytes(r.media) for r in media.collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in awkward.collect()}
    for r in M.features(media).collect():
        text = texts[r.doc_id]
        payload = text + b" " * ((-len(text)) % 192 or (0 if text else 192))
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored[r.doc_id]), hashlib.sha256(stored[r.doc_id]).hexdigest())
    broken = media.where("doc_id IN (1, 6)").withColumn("media", F.when(F.col("doc_id") == 1, F.lit(b"\0" * 188)).otherwise(F.col("media")))
    out = {r.doc_id: r for r in M.features(broken).collect()}
    assert out[1].payload_sha256 is None and out[1].feature.startswith("damaged") and out[6].payload_bytes == 192

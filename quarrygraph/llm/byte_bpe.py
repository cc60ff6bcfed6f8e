"""Byte-level BPE by a global shuffle of distinct words.

Texts are split by the vocabulary's pattern into pre-tokens. A block of texts numbers its distinct pre-tokens in the
order of their first place, so that the block's positions become a sequence of small numbers. The distinct
pre-tokens of all blocks are dealt out by hash, each bucket encodes a pre-token once, and the ids go back to
the blocks, where every text is put together by position. Rows are packed: one row holds a block's
pre-tokens of one bucket, or the position sequences of many texts, compressed. Tasks stream over sorted
rows and hold one block's distinct pre-tokens, or a bounded number of a bucket's. Decoding joins ids with the token-byte table,
which has a row for each id of the vocabulary; digests of decoded bytes look the same table up where ids are put together.

Block and bucket numbers come from one evaluation of the source, whose rows pass the first shuffle together with the
pre-tokens, so a lost executor changes nothing.

Defined cases: null text is empty and has no ids; a pre-token is never cut, however long; repeated rows give equal
results; a null doc_id is kept; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, partitions, read, tidy

VOCABULARY = "byte_bpe_50k.tiktoken"
BLOCK_BYTES = 28 << 20
_PARCEL_TOKENS = 200_000
_LEVEL = 9
#: Distinct pre-tokens of a bucket that are remembered together.
_KNOWN_WORDS = 500_000
#: Packed rows have up to some hundred kilobytes each.
_BATCH_ROWS = 64
_SPLIT = regex.compile(public_tokenizers.PATTERN)
#: Packed rows: target deals them out, kind is 0 for pre-tokens and 1 for texts, block and part name their place.
_PACKED = "target long, kind int, block long, part long, head binary, body binary"
_NAMES = [c.split()[0] for c in _PACKED.split(", ")]
_TYPES = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())


def split(text: str) -> list[str]:
    """Pre-tokens of a text, in order; joined they give the text."""
    return _SPLIT.findall(text)


@lru_cache(maxsize=2)
def ranks(vocabulary: str) -> dict[bytes, int]:
    with open(public_tokenizers.path(vocabulary), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def _coder(vocabulary: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(vocabulary), special_tokens={})


@lru_cache(maxsize=2)
def token_bytes(vocabulary: str) -> list[bytes]:
    """The token-byte table: the bytes of each id; b'' where the vocabulary has none."""
    known = ranks(vocabulary)
    table = [b""] * (max(known.values()) + 1)
    for token, k in known.items():
        table[k] = token
    return table


def _pack(parts: list[bytes]) -> bytes:
    sizes = np.array([len(p) for p in parts], "<u4").tobytes()
    return zstandard.compress(np.array([len(parts)], "<u4").tobytes() + sizes + b"".join(parts), _LEVEL)


def _unpack(data: bytes) -> list[bytes]:
    raw = zstandard.decompress(data)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = 4 + 4 * n + np.cumsum(np.frombuffer(raw, "<u4", n, 4)).astype(np.int64)
    starts = np.concatenate(([4 + 4 * n], ends[:-1])) if n else ends
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def _varints(values: np.ndarray) -> bytes:
    """Seven bits a byte, low bits first; the high bit says that more follow."""
    out, size = np.zeros((len(values), 5), np.uint8), np.ones(len(values), np.int64)
    for k in range(5):
        left = values >> np.uint32(7 * k)
        out[:, k] = left & np.uint32(0x7F)
        more = left >= 128
        out[more, k] |= 0x80
        size[more] = k + 2
    return out[np.arange(5)[None, :] < size[:, None]].tobytes()


def _unvarints(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    last = raw < 128
    owner = np.cumsum(last) - last
    start = np.concatenate(([0], np.flatnonzero(last)[:-1] + 1)) if len(raw) else np.empty(0, np.int64)
    shift = 7 * (np.arange(len(raw)) - start[owner])
    out = np.zeros(len(start), np.int64)
    np.add.at(out, owner, (raw & 0x7F).astype(np.int64) << shift)
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)


class _Numbers(dict):
    """Numbers in the order of first use."""

    def __missing__(self, word: str) -> int:
        value = self[word] = len(self)
        return value


def _splitter(buckets: int, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count, size, numbers = TaskContext.get().partitionId(), 0, 0, _Numbers()
        ids: list[int | None] = []
        seqs: list[np.ndarray] = []

        def close() -> Iterator[pa.RecordBatch]:
            """The rows of a block; its pre-tokens are numbered anew, the frequent ones first, which makes short sequences."""
            nonlocal count, size
            block, sizes = task << 32 | count, np.array([len(q) for q in seqs], np.int64)
            whole = np.concatenate(seqs) if seqs else np.empty(0, np.uint32)
            order = np.argsort(-np.bincount(whole, minlength=len(numbers)), kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            whole = rank[whole]
            ends = np.cumsum(sizes)
            cuts = np.flatnonzero(np.diff((ends + 16 * np.arange(len(ends))) // _PARCEL_TOKENS)) + 1
            for part, (i, j) in enumerate(zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)])):
                if i < j:
                    keys = np.array([0 if k is None else k for k in ids[i:j]], "<i8").tobytes()
                    head = _pack([keys, bytes(k is None for k in ids[i:j]), sizes[i:j].astype("<u4").tobytes()])
                    yield _batch([(block, 1, block, part, head, zstandard.compress(_varints(whole[ends[i] - sizes[i] : ends[j - 1]]), _LEVEL))])
            words = list(numbers)
            bucket = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) % buckets for w in words), np.int64, len(words))
            by_bucket = np.lexsort((rank, bucket))
            edges = np.flatnonzero(np.diff(bucket[by_bucket], prepend=-1, append=-1))
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
                some = by_bucket[i:j]
                steps = np.diff(rank[some], prepend=np.uint32(0)).astype(np.uint32)
                yield _batch([(int(bucket[some[0]]), 0, block, int(bucket[some[0]]), zstandard.compress(_varints(steps), _LEVEL), _pack([words[k].encode("utf-8", "surrogatepass") for k in some.tolist()]))])
            numbers.clear()
            ids.clear()
            seqs.clear()
            count, size = count + 1, 0

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                said = text.as_py() or ""
                found = split(said)
                ids.append(doc_id)
                seqs.append(np.fromiter(map(numbers.__getitem__, found), np.uint32, len(found)))
                size += len(said) + 64
                if size > block_bytes:
                    yield from close()
        if ids:
            yield from close()

    return run


def _bucket_encoder(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single = _coder(vocabulary)._core_bpe.encode_single_piece
        known: dict[bytes, bytes] = {}
        bucket = None
        for batch in batches:
            for row in range(len(batch)):
                _, kind, block, part, head, body = (c[row].as_py() for c in batch.columns)
                if kind == 0:
                    if bucket != part:
                        known, bucket = {}, part
                    found = []
                    for word in _unpack(body):
                        ids = known.get(word)
                        if ids is None:
                            if len(known) > _KNOWN_WORDS:  # those that come again are encoded again
                                known.clear()
                            ids = known[word] = np.array(single(word), "<u4").tobytes()
                        found.append(ids)
                    body = _pack(found)
                yield _batch([(block, kind, block, part, head, body)])

    return run


def _assembler(finish):
    """Puts texts together from their blocks' pre-tokens; finish makes a batch of doc_ids and their ids (little-endian unsigned 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, places, coded, words = None, [], [], None
        for batch in batches:
            for row in range(len(batch)):
                _, kind, own, _, head, body = (c[row].as_py() for c in batch.columns)
                if own != block:
                    block, places, coded, words = own, [], [], None
                if kind == 0:
                    places.append(np.cumsum(_unvarints(zstandard.decompress(head))))
                    coded += _unpack(body)
                    continue
                if words is None:  # all pre-tokens of a block come before its texts
                    words = [coded[k] for k in np.argsort(np.concatenate(places))] if places else []
                    places, coded = [], []
                keys, nulls, sizes = _unpack(head)
                seq = _unvarints(zstandard.decompress(body)).tolist()
                ends = np.cumsum(np.frombuffer(sizes, "<u4")).tolist()
                ids = [None if gone else k for k, gone in zip(np.frombuffer(keys, "<i8").tolist(), nulls)]
                for at in range(0, len(ids), 64):
                    yield finish(ids[at : at + 64], [b"".join(map(words.__getitem__, seq[a:b])) for a, b in zip([0, *ends][at : at + 64], ends[at : at + 64])])

    return run


def _id_lists(doc_ids: list[int | None], coded: list[bytes]) -> pa.RecordBatch:
    offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in coded]))).astype(np.int32)
    values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(coded), "<i4")))
    return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), values], names=["doc_id", "ids"])


def _encoded(docs: DataFrame, vocabulary: str, block_bytes: int, finish, schema: str) -> DataFrame:
    dealt = partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = rows.mapInArrow(tidy(_splitter(4 * dealt, block_bytes)), _PACKED)
    # Buckets of pre-tokens stay whole; texts go along, spread by block and part.
    by_word = packed.repartition(dealt, F.when(F.col("kind") == 0, F.col("part")).otherwise(F.xxhash64("block", "part"))).sortWithinPartitions("kind", "part", "block")
    coded = by_word.mapInArrow(tidy(_bucket_encoder(vocabulary), _BATCH_ROWS), _PACKED)
    # Blocks are dealt out by turns, not by hash, so that they come one to a task while there are tasks.
    place = F.pmod(F.shiftright("block", 32) + 31 * F.col("block").bitwiseAND((1 << 32) - 1), F.lit(dealt)).cast("int")
    by_block = coded.repartitionById(dealt, place).sortWithinPartitions("block", "kind", "part")
    return by_block.mapInArrow(tidy(_assembler(finish), _BATCH_ROWS), schema)


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, ids) of every row."""
    return _encoded(docs, vocabulary, block_bytes, _id_lists, "doc_id long, ids array<int>")


def token_table(spark: SparkSession, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, token): the token-byte table; it has a row for each id of the vocabulary, which bounds its size."""
    return spark.createDataFrame([(k, bytearray(token)) for token, k in ranks(vocabulary).items()], "id int, token binary")


def decode(coded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, raw): the bytes of every row's ids, joined from the token-byte table; null ids give null, an id that the table lacks no bytes."""
    rows = durable(coded.select(F.monotonically_increasing_id().alias("row"), "doc_id", "ids"))
    placed = rows.select("row", F.posexplode("ids").alias("place", "id"))
    named = placed.join(F.broadcast(token_table(coded.sparkSession, vocabulary)), "id").select("row", F.struct("place", F.hex("token").alias("hex")).alias("x"))
    whole = named.groupBy("row").agg(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["hex"]), "")).alias("found"))
    return rows.join(whole, "row", "left").select("doc_id", F.when(F.col("ids").isNotNull(), F.coalesce("found", F.lit(b""))).alias("raw"))


def _digester(vocabulary: str):
    """Digests of ids and of the bytes that they decode to, made where the ids are put together."""

    def finish(doc_ids: list[int | None], coded: list[bytes]) -> pa.RecordBatch:
        table, said = token_bytes(vocabulary), _decimals(vocabulary)
        counts, ids_sha, raw_sha = [], [], []
        for ids in coded:
            values = np.frombuffer(ids, "<u4").tolist()
            counts.append(len(values))
            ids_sha.append(hashlib.sha256(b" ".join(map(said.__getitem__, values))).hexdigest())
            raw_sha.append(hashlib.sha256(b"".join(map(table.__getitem__, values))).hexdigest())
        return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(raw_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return finish


@lru_cache(maxsize=2)
def _decimals(vocabulary: str) -> list[bytes]:
    return [str(k).encode() for k in range(len(token_bytes(vocabulary)))]


def digests(docs: DataFrame, vocabulary: str = VOCABULARY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of every row's ids and, decoded from them, of its bytes."""
    return _encoded(docs, vocabulary, block_bytes, _digester(vocabulary), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))

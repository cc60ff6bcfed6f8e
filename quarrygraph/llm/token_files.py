"""Token ids in ORC files: run-length encoded integers, row indexes and Bloom filters on document ids.

Texts are dealt out by ranges of doc_id, encoded by a vocabulary of the tokenizers library, and written in
ascending doc_id order, one file for each range. A row holds the ids of one document with the end id, the number
of its range and the ids before it within the range; readers take stripes in parallel, and filters on doc_id prune files,
stripes and row groups by their statistics and Bloom filters.

Equal words and equal pieces have equal ids: a word is looked up once in a group, a piece encoded once while a bounded store holds it.

Defined cases: null text is empty and has the end id alone; rows with a null doc_id come first; rows that repeat a
doc_id stand in the order of their texts; an empty table gives an empty result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, read, shared_dir, tidy

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
ROW_INDEX_STRIDE = 1000
STRIPE_BYTES = 16 << 20
_STORE = 600_000
_GROUP_BYTES = 12_000_000
_GROUP_ROWS = 4_000
#: Words of these characters need no normal form, and their lower case is one to one.
_PLAIN = re.compile("[\\x00-\\x7fÀ-ÖØ-öø-ÿ]*")
#: How the vocabulary splits such a word once it is in lower case (fixed by the file; letters stand first, as nothing else
#: begins with one), and the blank between two words.
_PIECE = re.compile("[a-zß-öø-ÿ]+| |[0-9]|'(?:s|t|re|ve|m|ll|d)|[^ \\t-\\ra-zß-öø-ÿ0-9]+")
_ENCODERS: dict[str, PartEncoder] = {}


class PartEncoder:
    """Ids of UTF-8 texts as little-endian unsigned 32-bit integers.

    The vocabulary never joins what ASCII white space parts, so each distinct word of a group of texts is encoded once, and
    Arrow puts the ids together. Plain words (ASCII and the letters of Latin-1, without a special token's mark) are split
    further here as the vocabulary's rules split them, so that a piece is known whatever its case and neighbours; each new
    piece goes to the library's model. Other words go to the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # Pieces are in normal form and apart: the model is left to do.
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.pieces: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.ends = np.zeros(self.tokenizer.get_vocab_size(True), bool)
        for token, k in self.tokenizer.get_vocab(True).items():
            self.ends[k] = token.endswith("</w>")

    def _learn_pieces(self, fresh: list[str]) -> None:
        """Every piece is one pre-token and so ends with its only word-end token: many are encoded as one text."""
        for k in range(0, len(fresh), 5_000):
            some = fresh[k : k + 5_000]
            ids = np.array(self.model.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            raw, ends = ids.tobytes(), (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(ends) != len(some):
                raise ValueError("pieces and word ends differ")
            for piece, a, b in zip(some, [0, *ends], ends):
                self.pieces[piece] = raw[4 * a : 4 * b]

    def _learn_parts(self, fresh: list[str]) -> None:
        for k in range(0, len(fresh), 20_000):
            some = fresh[k : k + 20_000]
            for part, found in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                self.parts[part] = np.array(found.ids, "<u4").tobytes()

    def _known(self, store: dict[str, bytes], wanted: set[str], learn) -> dict[str, bytes]:
        fresh = wanted.difference(store)
        if len(store) + len(fresh) > _STORE:
            store.clear()
            fresh = wanted
        learn(list(fresh))
        return store

    def _plain_words(self, words: list[str]) -> tuple[bytes, np.ndarray]:
        """The ids of plain words one after another, and how many each word has."""
        split = _PIECE.findall("".join([" ".join(words).lower(), " "])) if words else []
        known = self._known(self.pieces, set(split) - {" "}, self._learn_pieces)
        known[" "] = b""
        found = list(map(known.__getitem__, split))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        # Only the blank behind each word has no ids.
        return b"".join(found), np.diff(np.cumsum(sizes)[sizes == 0], prepend=0)

    def _other_words(self, words: list[str]) -> tuple[bytes, np.ndarray]:
        known = self._known(self.parts, set(words), self._learn_parts)
        found = [known[w] for w in words]
        return b"".join(found), np.fromiter(map(len, found), np.int64, len(found)) // 4

    def lists(self, texts: pa.Array, end: bytes = b"") -> pa.ListArray:
        """The ids of each text (null: empty), and the end ids behind them."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = split.flatten().dictionary_encode()
        held, codes = coded.dictionary, np.asarray(coded.indices)
        # No word has a blank, so one string carries all of them.
        said = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held), " ")[0].as_py()
        words, others = said.split(" ") if len(held) else [], []
        if "<|" in said or not (said.isascii() or _PLAIN.fullmatch(said)):
            plain = np.fromiter(("<|" not in w and (w.isascii() or _PLAIN.fullmatch(w) is not None) for w in words), bool, len(words))
            rank = np.empty(len(words), np.int64)
            rank[np.concatenate((np.flatnonzero(plain), np.flatnonzero(~plain)))] = np.arange(len(words))
            codes = rank[codes]
            words, others = list(compress(words, plain)), list(compress(words, ~plain))
        (first, first_sizes), (second, second_sizes) = self._plain_words(words), self._other_words(others)
        sizes = np.concatenate((first_sizes, second_sizes, [len(end) // 4]))
        ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(np.frombuffer(first + second + end, "<i4")))
        # The end stands behind each text as one more word.
        offsets = np.asarray(split.offsets)
        ends = offsets[1:] - offsets[0]
        codes = np.insert(codes, ends, len(sizes) - 1)
        upto = np.cumsum(sizes[codes])[ends + np.arange(len(ends))]
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], upto)).astype(np.int32)), ids.take(pa.array(codes)).flatten())

    def encode(self, texts: list[bytes]) -> list[bytes]:
        return [np.array(ids, "<u4").tobytes() for ids in self.lists(pa.array(texts, pa.binary()).cast(pa.string())).to_pylist()]


def _encoder(path: str) -> PartEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PartEncoder(path)
    return _ENCODERS[path]


def _writer(path: str, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before = _encoder(path), 0
        for batch in batches:
            texts = batch.column(2)
            sizes, at = pc.fill_null(pc.binary_length(texts), 0).to_pylist(), 0
            while at < len(texts):
                upto, size = at, 0
                while upto < len(texts) and (size := size + sizes[upto]) <= _GROUP_BYTES or upto == at:
                    upto += 1
                lists = encoder.lists(texts.slice(at, upto - at), end)
                offsets = np.asarray(lists.offsets).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, upto - at), batch.column(1).slice(at, upto - at), pa.array(before + offsets[:-1]), pa.array(np.diff(offsets)), lists], names=["part", "doc_id", "before", "n_tokens", "ids"])
                before += int(offsets[-1])
                at = upto

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> None:
    """Write the ids of every row as ORC, in ascending order of doc_id across and within the files."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    coded = dealt.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInArrow(tidy(_writer(public_tokenizers.path(vocabulary), end_id), _GROUP_ROWS), "part int, doc_id long, before long, n_tokens long, ids array<int>")
    writer = coded.write.option("compression", "zstd").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
    writer.option("orc.create.index", "true").option("orc.row.index.stride", str(ROW_INDEX_STRIDE)).option("orc.stripe.size", str(STRIPE_BYTES)).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files; start counts the ids of all documents before. doc_ids prunes the read."""
    rows = spark.read.schema("part int, doc_id long, before long, n_tokens long, ids array<int>").orc(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("held"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("held").over(order), F.lit(0)).alias("base"))
    wanted = rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))
    # One row for each range that write_tokens dealt out, 16 bytes each: as many as shuffle partitions.
    return wanted.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids")


def _digester(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        offsets = np.asarray(lists.offsets)
        values = memoryview(np.asarray(lists.values).astype("<i4", copy=False)).cast("B")
        sums = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(read(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path).mapInArrow(tidy(_digester), "doc_id long, start long, n_tokens long, ids_crc32 long")

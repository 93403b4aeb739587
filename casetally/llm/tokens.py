"""Operator 6: token ids in a compact binary format with a shared zstandard dictionary.

Files, under one folder and written by Spark so that lost executors and any file system are its concern:

* ``dictionary``: one row (sha256, dictionary). It is trained on the serialized ids of a bounded sample.
* ``blocks``: rows of (shard, block, dictionary hash, id width, first and last doc_id, tokens in the block,
  tokens before it in its shard, doc_ids, offsets, payload). The payload is one zstandard frame for each
  document, one after the other; frame i is payload[offsets[i]:offsets[i + 1]]. A reader that wants one
  document picks the block by its first and last doc_id and decompresses that frame alone.

Documents are in ascending order of doc_id: shards are ranges of it, blocks follow within a shard.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_path, tidy

TOKENIZER = "byte_bpe_50k.json"
END = 0
#: Bounds of the sample that the dictionary is trained on, and of the dictionary.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 1_000, 65_536, 65_536
BLOCK_DOCS, BLOCK_BYTES = 1_024, 4 << 20
#: Bytes of the texts whose words are looked up at once, and distinct words that are encoded as one text.
CHUNK_BYTES, _JOINED = 16 << 20, 512
#: How byte-level vocabularies write a space.
_SPACE = "\u0120"
_SAFE = re.compile(r"(?<=[!-~])(?= [!-~])")
BLOCKS = (
    "shard int, block int, dictionary string, width int, first_doc long, last_doc long, n_tokens long, "
    "start_in_shard long, doc_ids array<long>, offsets array<long>, payload binary"
)


def tokenizer_path(name: str) -> str:
    """A file of the public tokenizers by name, or any path."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers, with each distinct word of a call encoded once.

    A byte-level tokenizer starts a new piece at a single space between two characters that are not white
    space. So such a text is the sequence of its words, each with its space before it. Arrow splits the texts,
    finds the distinct words and puts their ids in the place of every word. A text with other white space
    around spaces is cut only where visible ASCII stands on both sides.
    """

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(name))
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for t, i in vocabulary.items() if t[0] == _SPACE]] = True
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4

    def plain(self, texts: list[str]) -> list[bytes]:
        made = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in made]

    def _spaced(self, words: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """Ids of each word with a space before it. Many are encoded as one text; a token that begins with a space starts a word."""
        data, cuts, end = [b""], [np.zeros(1, np.int64)], 0
        bounds = np.append(np.arange(0, len(words), _JOINED), len(words))
        joined = pc.binary_join(pa.ListArray.from_arrays(bounds.astype(np.int32), words), pa.scalar(" ", words.type))
        for text, size in zip(joined, np.diff(bounds).tolist(), strict=True):
            ids = self.plain([" " + text.as_py()])[0]
            starts = np.flatnonzero(self.opens[np.frombuffer(ids, "<u4")])
            if len(starts) != size:
                raise ValueError("this tokenizer does not start a piece at each space")
            data.append(ids)
            cuts.append(end + 4 * np.append(starts[1:], len(ids) // 4))
            end += len(ids)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(np.concatenate(cuts)), pa.py_buffer(b"".join(data))])

    def _irregular(self, text: str) -> bytes:
        pieces = _SAFE.split(text)
        distinct = list(dict.fromkeys(pieces))
        ids = dict(zip(distinct, self.plain(distinct), strict=True))
        return b"".join([ids[x] for x in pieces])

    def __call__(self, texts: list[str] | pa.Array) -> list[bytes]:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        if not len(texts):
            return []
        cut = pc.split_pattern(texts.cast(pa.large_string()), " ")
        ends = cut.offsets.to_numpy()
        parts, is_head = cut.values, np.zeros(len(cut.values), bool)
        is_head[ends[:-1]] = True
        heads = parts.filter(pa.array(is_head)).to_pylist()
        words = parts.filter(pa.array(~is_head)).dictionary_encode()
        ends = ends - np.arange(len(ends))
        distinct = words.dictionary
        # A word that is empty, or has white space at an end, is not sound: it has no ids, and its texts are encoded in another way.
        is_sound = pc.and_(pc.not_equal(distinct, ""), pc.equal(pc.utf8_trim_whitespace(distinct), distinct))
        sound = is_sound.to_numpy(zero_copy_only=False)
        place = np.maximum(np.cumsum(sound) - 1, 0)
        codes = words.indices.to_numpy()
        unsound = np.concatenate(([0], np.cumsum(~sound[codes])))
        unsound = unsound[ends[1:]] - unsound[ends[:-1]]
        known = self._spaced(distinct.filter(is_sound))
        ids = known.take(pa.array(place[codes], mask=~sound[codes]))
        at, data = np.frombuffer(ids.buffers()[1], np.int64)[ends], memoryview(ids.buffers()[2] or b"")
        made = []
        for i, (head, first) in enumerate(zip(heads, self.plain(heads), strict=True)):
            if unsound[i] or ends[i] < ends[i + 1] and (not head or head[-1].isspace()):
                made.append(self._irregular(texts[i].as_py()))
            else:
                made.append(first + data[at[i] : at[i + 1]])
        return made


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    return _ENCODERS[name]


def _with_end(ids: bytes, end: int = END) -> bytes:
    return ids + end.to_bytes(4, "little")


def _stored(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def _chunks(batch: pa.RecordBatch, text: int = 1) -> Iterator[pa.RecordBatch]:
    """Rows of a batch by about ``CHUNK_BYTES`` of their texts; a longer text is one by itself."""
    before = np.cumsum(pc.binary_length(batch.column(text)).to_numpy()) // CHUNK_BYTES
    starts = np.flatnonzero(np.diff(before, prepend=-1)).tolist()
    for a, b in pairwise([*starts, batch.num_rows]):
        yield batch.slice(a, b - a)


def train_dictionary(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> bytes:
    """A dictionary from a sample bounded in documents and in characters; empty if there is too little to learn."""
    keys = docs.select(F.col(key).cast("long").alias("k")).where("k is not null").distinct()
    keys = keys.withColumn("h", F.xxhash64("k")).orderBy("h", "k").limit(SAMPLE_DOCS)
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    rows = rows.join(F.broadcast(keys), "k").where(F.length("t") <= SAMPLE_CHARS).select("h", "t").orderBy("h", "t").limit(SAMPLE_DOCS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = encoder(tokenizer)
        for batch in batches:
            for part in _chunks(batch, 0):
                ids = [_stored(_with_end(x), make.width) for x in make(part.column(0))]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], names=["ids"])

    samples = [bytes(r[0]) for r in rows.select("t").mapInArrow(run, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few or too small samples
        return b""


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def write_tokens(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, key: str = "doc_id", text: str = "text") -> None:
    """Encode every text, add the end id and write the files.

    A null text counts as empty. Rows without a key come first; rows that share a key are ordered by a hash
    of their text, and each is a document of its own. No rows give files without blocks.
    """
    spark = docs.sparkSession
    data = train_dictionary(docs, tokenizer, key, text)
    name = hashlib.sha256(data).hexdigest()
    spark.createDataFrame([(name, bytearray(data))], "sha256 string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    sent = spark.sparkContext.broadcast(data)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        make = encoder(tokenizer)
        press = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(sent.value))
        keys: list[int | None] = []
        frames: list[bytes] = []
        state = {"block": 0, "start": 0, "tokens": 0, "bytes": 0}

        def flush() -> pa.RecordBatch:
            known = [k for k in keys if k is not None]
            row = (
                shard, state["block"], name, make.width, keys[0], known[-1] if known else None, state["tokens"], state["start"],
                list(keys), np.concatenate(([0], np.cumsum([len(f) for f in frames]))).tolist(), b"".join(frames),
            )
            state.update(block=state["block"] + 1, start=state["start"] + state["tokens"], tokens=0, bytes=0)
            keys.clear()
            frames.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, fields, strict=True)], schema=fields)

        for batch in batches:
            for part in _chunks(batch):
                for k, ids in zip(part.column(0).to_pylist(), make(part.column(1)), strict=True):
                    ids = _with_end(ids)
                    keys.append(k)
                    frames.append(press.compress(_stored(ids, make.width)))
                    state["tokens"] += len(ids) // 4
                    state["bytes"] += len(frames[-1])
                    if len(keys) >= BLOCK_DOCS or state["bytes"] >= BLOCK_BYTES:
                        yield flush()
        if keys:
            yield flush()

    fields = pa.schema(
        [("shard", pa.int32()), ("block", pa.int32()), ("dictionary", pa.string()), ("width", pa.int32()), ("first_doc", pa.int64()),
         ("last_doc", pa.int64()), ("n_tokens", pa.int64()), ("start_in_shard", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
         ("offsets", pa.list_(pa.int64())), ("payload", pa.binary())]
    )
    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    ordered = rows.repartitionByRange("k", F.xxhash64("t")).sortWithinPartitions("k", F.xxhash64("t"))
    ordered.mapInArrow(tidy(pack), BLOCKS).write.parquet(f"{path}/blocks")


def _load(spark: SparkSession, path: str) -> tuple[DataFrame, str, bytes]:
    """Blocks, hash and dictionary of the files; the dictionary must have the hash it is filed under."""
    name, data = spark.read.schema("sha256 string, dictionary binary").parquet(f"{path}/dictionary").first()
    if hashlib.sha256(bytes(data)).hexdigest() != name:
        raise ValueError(f"the dictionary in {path} does not have the hash {name}")
    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks"), name, bytes(data)


def _frames(name: str, data: bytes, only: int | None = None):
    """Decode blocks: one row (doc_id, start in the shard, ids) for each document, or for one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, int, np.ndarray, int]]:
        open_ = zstandard.ZstdDecompressor(dict_data=_dictionary(data))
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary"] != name:
                    raise ValueError(f"a block needs dictionary {row['dictionary']}, the files have {name}")
                payload, cut, start = memoryview(row["payload"]), row["offsets"], row["start_in_shard"]
                for i, k in enumerate(row["doc_ids"]):
                    if only is not None and k != only:
                        continue
                    ids = np.frombuffer(open_.decompress(payload[cut[i] : cut[i + 1]]), f"<u{row['width']}").astype("<u4")
                    yield k, start, ids, row["shard"]
                    start += len(ids)

    return run


def read_ids(spark: SparkSession, path: str, doc_id: int) -> DataFrame:
    """(doc_id, ids) of one document: only its block is read and only its frame decompressed."""
    blocks, name, data = _load(spark, path)
    decode = _frames(name, data, doc_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, _, ids, _ in decode(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": [k], "ids": [ids.astype(np.int64)]})

    near = blocks.where(F.col("last_doc") >= doc_id).where(F.col("first_doc").isNull() | (F.col("first_doc") <= doc_id))
    return near.mapInArrow(run, "doc_id long, ids array<long>")


def digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) for each document in the files.

    Tokens before a shard are summed over one row a shard; within a shard the blocks carry their own start.
    """
    blocks, name, data = _load(spark, path)
    decode = _frames(name, data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(k, s, len(ids), zlib.crc32(ids.tobytes()), shard) for k, s, ids, shard in decode(iter([batch]))]
            columns = list(zip(*made, strict=True)) or [[]] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "s", "n_tokens", "ids_crc32", "shard"])

    total = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = total.select("shard", (F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    rows = blocks.mapInArrow(run, "doc_id long, s long, n_tokens long, ids_crc32 long, shard int")
    # One row for each range of the shuffle that wrote the files: as many as partitions are set.
    return rows.join(F.broadcast(before), "shard").select("doc_id", (F.col("before") + F.col("s")).alias("start"), "n_tokens", "ids_crc32")


def encode_corpus(docs: DataFrame, tokenizer: str = TOKENIZER, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the files into the shared folder and return what reading them back gives."""
    path = shared_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, key, text)
    return digest(docs.sparkSession, path)

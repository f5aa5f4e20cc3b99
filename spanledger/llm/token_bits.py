"""Operator 9: token ids as fixed-width bits, in blocks that can be read at random.

Every id takes the fewest bits that hold the vocabulary. A block holds the ids of consecutive
documents: a header, the document table and the packed ids. Blocks are rows of a Parquet
table in ascending document order, so Spark commits them on any file system and a lost
executor's block is written again; `Block.tobytes` is also a complete file by itself.

Layout of a block, little-endian: b"SLTB", u16 version 1, u16 bits, u32 documents, u64 ids,
then per document i64 doc_id and u64 offset of its first id, u64 ids once more as the last
offset, then the ids, id k at bits [k * bits, (k + 1) * bits) counted from the low bit of each
byte.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh_dir, parts

MAGIC, HEAD = b"SLTB", "<4sHHIQ"
HEAD_SIZE = struct.calcsize(HEAD)
#: Ids in a block, about; a document is never split between blocks.
BLOCK_IDS = 1 << 20
END_ID = 1
#: Entries of each of the two generations of a worker's cache.
CACHE = 400_000
#: Longer chunks and words are not cached, so that a cache is bounded in bytes as well.
SHORT = 64
#: Characters from which a text is taken in parts.
LONG = 1 << 20


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids below 2**bits (bits up to 32) as a stream of bits."""
    ids = np.ascontiguousarray(ids, "<u4")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    out = []
    for at in range(0, len(ids), 1 << 17):  # a multiple of 8 ids ends on a whole byte
        rows = np.unpackbits(ids[at : at + (1 << 17)].view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
        out.append(np.packbits(rows[:, :bits].reshape(-1), bitorder="little").tobytes())
    return b"".join(out)


def unpack(data: bytes | memoryview, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids [start, stop) of a packed stream, without touching the rest."""
    if stop <= start:
        return np.zeros(0, np.uint32)
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", stop - start, start * bits // 8).astype(np.uint32)
    first = start * bits // 8
    raw = np.zeros((stop * bits + 7) // 8 - first + 8, np.uint8)
    own = np.frombuffer(data, np.uint8)[first : (stop * bits + 7) // 8]
    raw[: len(own)] = own
    at = np.arange(start, stop, dtype=np.int64) * bits - first * 8
    byte, shift = at >> 3, (at & 7).astype(np.uint64)
    value = np.zeros(stop - start, np.uint64)
    for k in range(5):
        value |= raw[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return ((value >> shift) & np.uint64((1 << bits) - 1)).astype(np.uint32)


class Block:
    """Documents' ids, written and read."""

    def __init__(self, bits: int, doc_ids: np.ndarray, offsets: np.ndarray, data: bytes | memoryview):
        self.bits, self.doc_ids, self.offsets, self.data = bits, doc_ids, offsets, data

    @classmethod
    def of(cls, bits: int, doc_ids: list[int], each: list[np.ndarray]) -> Block:
        offsets = np.cumsum([0, *map(len, each)]).astype("<u8")
        ids = np.concatenate([np.zeros(0, np.uint32), *each]) if each else np.zeros(0, np.uint32)
        return cls(bits, np.array(doc_ids, "<i8"), offsets, pack(ids, bits))

    def tobytes(self) -> bytes:
        head = struct.pack(HEAD, MAGIC, 1, self.bits, len(self.doc_ids), int(self.offsets[-1]))
        return b"".join([head, self.doc_ids.astype("<i8").tobytes(), self.offsets.astype("<u8").tobytes(), bytes(self.data)])

    @classmethod
    def read(cls, raw: bytes) -> Block:
        magic, version, bits, n, ids = struct.unpack_from(HEAD, raw)
        if magic != MAGIC or version != 1:
            raise ValueError("not a block of packed ids")
        offsets = np.frombuffer(raw, "<u8", n + 1, HEAD_SIZE + 8 * n)
        if int(offsets[-1]) != ids:
            raise ValueError("a block's offsets contradict its header")
        return cls(bits, np.frombuffer(raw, "<i8", n, HEAD_SIZE), offsets, memoryview(raw)[HEAD_SIZE + 16 * n + 8 :])

    def ids(self, k: int) -> np.ndarray:
        """The k-th document's ids."""
        return unpack(self.data, self.bits, int(self.offsets[k]), int(self.offsets[k + 1]))


# Chunks of printable ASCII and precomposed Latin letters: each normalises by itself, character by character.
PLAIN = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-įı-ž]+")
# How the vocabulary's tokenizer splits a text into words.
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\w\s]|_)+")


# How such a tokenizer file folds and splits texts.
FILE_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
FILE_SPLIT = {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}


def splits_at_white_space(spec: dict) -> bool:
    """Whether a tokenizer file folds and splits texts as ``Encoder`` does by itself: then chunks may be encoded one by one."""
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    model = spec.get("model") or {}
    return (
        spec.get("normalizer") == FILE_NORMALIZER
        and [x["type"] for x in cuts] == ["Split", "ByteLevel"]
        and (cuts[0]["pattern"], cuts[0]["behavior"], cuts[0]["invert"]) == (FILE_SPLIT, "Removed", True)
        and not (cuts[1]["add_prefix_space"] or cuts[1]["use_regex"])
        and model.get("type") == "BPE"
        and not model.get("dropout")
        and all(x["content"].startswith("<|") and not set(x["content"]) & set(" \t\n") for x in spec.get("added_tokens") or ())
        and not spec.get("truncation")
        and not spec.get("padding")
    )


class Encoder:
    """Token ids of texts, equal to the tokenizer's own, from a tokenizer file's contents.

    Where the file folds and splits texts in the way that ``splits_at_white_space`` knows, white
    space separates words and is dropped, so a text's ids are those of its chunks in a row, and
    chunks met before are looked up: a chunk of plain letters and signs is split here and its
    words go to the tokenizer's model; any other goes through the whole tokenizer. With any
    other file every text goes through the whole tokenizer.
    """

    def __init__(self, contents: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(contents)
        self.by_chunk = splits_at_white_space(json.loads(contents))
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.bits = max(1, (self.size - 1).bit_length())
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        self.letters = {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            spelt = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            found = np.array([t.id for t in self.tokenizer.model.tokenize(spelt)], "<u4").tobytes()
            if len(self.words) >= CACHE:
                self.words.clear()
            if len(word) <= SHORT:
                self.words[word] = found
        return found

    def _chunk(self, chunk: str) -> bytes:
        found = self.old.get(chunk)
        if found is None:
            if PLAIN.fullmatch(chunk) and "<|" not in chunk:
                found = b"".join([self._word(w) for w in SPLIT.findall(chunk.lower())])
            else:
                found = self._whole(chunk)
        if len(chunk) > SHORT:
            return found
        if len(self.young) >= CACHE:
            self.old, self.young = self.young, {}
        self.young[chunk] = found
        return found

    def ids(self, text: str | None) -> np.ndarray:
        """The text's ids and the end id; null has the end id only."""
        text = text or ""
        if not self.by_chunk or any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to Python only
            raw = self._whole(text)
        else:
            new = self._chunk
            raw = b"".join([self.young.get(c) or new(c) for part in parts(text, LONG) for c in part.split()])
        return np.append(np.frombuffer(raw, "<u4"), np.uint32(END_ID)).astype(np.uint32)


def _contents(path: str) -> str:
    """The tokenizer file, read by the driver."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def write(docs: DataFrame, path: str, tokenizer: str, block_ids: int = BLOCK_IDS) -> None:
    """Tokenise docs (doc_id, text) into a table of blocks at ``path``.

    Columns: part and seq (ascending in document order), n_docs, n_ids, n_null, block. A null text
    is encoded as empty; rows without an id come first, with the id 0 in the block, whose first
    n_null documents they are. Rows that
    repeat an id (or have none) stay next to each other in the order of their texts' hashes and
    then of their texts, so that only rows alike in both could change places.
    """
    text = F.coalesce("text", F.lit(""))
    # The place among the rows spreads rows that are alike in all else over the parts.
    rows = docs.select(
        F.col("doc_id").isNotNull().alias("known"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("place")
    )
    contents = docs.sparkSession.sparkContext.broadcast(_contents(tokenizer))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held: list[Encoder] = []

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        if not held:
            held.append(Encoder(contents.value))
        coder = held[0]
        doc_ids: list[int] = []
        each: list[np.ndarray] = []
        n = nulls = 0

        def block() -> pd.DataFrame:
            return pd.DataFrame(
                {"part": [part], "seq": [seq], "n_docs": [len(doc_ids)], "n_ids": [n], "n_null": [nulls], "block": [Block.of(coder.bits, doc_ids, each).tobytes()]}
            )

        for batch in batches:
            for known, doc_id, text in zip(batch["known"], batch["doc_id"], batch["text"], strict=True):
                ids = coder.ids(text)
                doc_ids.append(doc_id)
                each.append(ids)
                n += len(ids)
                nulls += not known
                if n >= block_ids:
                    yield block()
                    doc_ids, each, n, nulls, seq = [], [], 0, 0, seq + 1
        if doc_ids:
            yield block()

    ordered = rows.repartitionByRange(tasks, "known", "doc_id", "hash", "place").sortWithinPartitions("known", "doc_id", "hash", "text")
    ordered.select("known", "doc_id", "text").mapInPandas(encode, "part int, seq int, n_docs long, n_ids long, n_null long, block binary").write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """What the blocks hold by document: doc_id, start, n_tokens, ids_crc32 and the packed width."""
    blocks = spark.read.parquet(path)
    # Where each block starts: parts are few (one a writing task), blocks of a part too.
    sizes = cut(blocks.select("part", "seq", "n_ids"))
    totals = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    from pyspark.sql import Window

    first = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    starts = sizes.withColumn("within", within).join(F.broadcast(first), "part")
    starts = starts.select("part", "seq", (F.col("base") + F.col("within")).alias("start"))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, seq, nulls, raw in zip(batch["part"], batch["seq"], batch["n_null"], batch["block"], strict=True):
                block = Block.read(raw)
                ids = unpack(block.data, block.bits, 0, int(block.offsets[-1])).astype("<u4")
                at = block.offsets.astype(np.int64)
                yield pd.DataFrame(
                    {
                        "part": part,
                        "seq": seq,
                        "known": np.arange(len(block.doc_ids)) >= nulls,
                        "doc_id": block.doc_ids,
                        "within": at[:-1],
                        "n_tokens": np.diff(at),
                        "ids_crc32": [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)],
                        "bits": block.bits,
                    }
                )

    told = blocks.select("part", "seq", "n_null", "block").mapInPandas(
        decode, "part int, seq int, known boolean, doc_id long, within long, n_tokens long, ids_crc32 long, bits int"
    )
    return told.join(starts, ["part", "seq"]).select(
        F.when(F.col("known"), F.col("doc_id")).alias("doc_id"),
        (F.col("start") + F.col("within")).alias("start"),
        "n_tokens",
        "ids_crc32",
        "bits",
    )


def token_bits(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write docs' ids in ascending doc_id order and read them back: doc_id, start, n_tokens, ids_crc32, bits.

    tokenizer is the path of a tokenizer file on the driver. Null texts are empty ones, which
    hold the end id only; null ids come first; rows that repeat an id follow each other by their
    texts' hashes. Other columns are ignored; an empty table gives no rows.
    """
    path = path or fresh_dir(docs.sparkSession, "token-bits")
    write(docs, path, tokenizer)
    return read(docs.sparkSession, path)

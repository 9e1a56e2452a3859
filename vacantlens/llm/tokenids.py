"""Documents as files of token ids, and back.

Documents are dealt into shards by ranges of doc_id, tokenised there and coded in blocks
(``idcodec``). The files are a Parquet table of blocks: shard, block number, how many ids of the
shard come before, the directory of the documents in the block, and the payload. A document
goes on in the next block where one is full. Blocks are read on their own, in any order.

Defined cases: a null or empty text is only its end id; a null doc_id comes first; rows that
repeat a doc_id stand next to each other, ordered by a hash of their text, and each is a document
of its own; an empty table gives empty files and no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vacantlens.llm.idcodec import BLOCK_IDS, decode_block, encode_block
from vacantlens.llm.text import bounded_batches, utf8
from vacantlens.session import scratch_path, ship

FILES = "shard int, block int, before long, docs array<struct<doc_id:long,number:long,part:int,length:long>>, payload binary"
TOKENIZER, END_ID = "word_bpe_49k.json", 2
#: Distinct words of which a worker remembers the ids, beyond that it starts anew, and the letters
#: of the longest of them.
REMEMBERED, LONGEST = 1 << 20, 64
#: Bytes of texts taken apart at a time, more only for one text.
AT_ONCE = 1 << 21
#: The tokenizer's own split into pieces, the words for which the pattern after it does the same
#: in lower case (ASCII and the letters of Latin-1, which no normal form changes), and that pattern, with a blank
#: after each word.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LATIN = re.compile("[!-~À-ÖØ-öø-ÿ]*")
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]| |[^ a-zß-öø-ÿ0-9]+")
#: Kind of a byte of a plain word: signs, letters (both bytes of those of Latin-1), digits; what makes a word odd.
_SIGN, _LETTER, _DIGIT, _ODD = range(4)
_KIND = np.full(256, _ODD, np.uint8)
_KIND[0x21:0x7F] = _SIGN
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3, *range(0x80, 0xC0)]] = _LETTER
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x27] = _ODD
LETTERS = [chr(c) for c in (*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100))]


class PieceIds(dict):
    """The ids of pieces of Latin letters as bytes; each is given to the model when it is first asked for, the long ones
    every time."""

    def __init__(self, tokenizer, byte_level) -> None:
        self.tokenize, self[" "] = tokenizer.model.tokenize, b""
        # The signs that stand for a letter's bytes there.
        self.mapped = {ord(c): "".join(t for t, _ in byte_level.pre_tokenize_str(c)) for c in LETTERS}

    def __missing__(self, piece: str) -> bytes:
        mapped = piece if piece.isascii() else piece.translate(self.mapped)
        ids = array("I", [t.id for t in self.tokenize(mapped)]).tobytes()
        if len(piece) <= LONGEST:
            self[piece] = ids
        return ids


class WordTokenizer:
    """Ids of whole texts of a tokenizer that drops white space: words between ASCII blanks are
    independent there, so every distinct word of some texts is taken apart once. Words of Latin letters are taken
    apart here, if the tokenizer splits by ``SPLIT``, all words of some texts together, and its model sees
    every distinct piece once; other words are tokenised once and remembered, very long ones only for these texts."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        # A task has its own core; the library's thread pool only adds to its work.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.known: dict[str, bytes] = {}
        self.pieces = PieceIds(self.tokenizer, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False))
        rules = json.loads(self.tokenizer.to_str())
        self.added = [t["content"] for t in rules["added_tokens"]]
        split, normal = (rules["pre_tokenizer"] or {}).get("pretokenizers", []), (rules["normalizer"] or {}).get("normalizers", [])
        self.splits = (
            [t["type"] for t in split] == ["Split", "ByteLevel"]
            and (split[0]["pattern"], split[0]["behavior"], split[0]["invert"]) == ({"Regex": SPLIT}, "Removed", True)
            and not (split[1]["add_prefix_space"] or split[1]["use_regex"])
            and [t["type"] for t in normal] == ["NFC", "Replace", "Lowercase"]
            and normal[1]["pattern"] == {"Regex": r"\s+"}
        )

    def _found(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each word's begin there, how many it has) of distinct words."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()
            self.pieces[" "] = b""
        plain = self._plain(words) if self.splits else np.zeros(len(words), bool)
        start, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        ids, start[plain], size[plain] = self._by_pieces(words.filter(pa.array(plain)))
        rest = self._encoded(words.filter(pa.array(~plain)).to_numpy(zero_copy_only=False).tolist())
        size[~plain] = own = np.fromiter(map(len, rest), np.int64, len(rest)) // 4
        start[~plain] = len(ids) + np.cumsum(own) - own
        return (np.concatenate([ids, np.frombuffer(b"".join(rest), np.uint32)]) if rest else ids), start, size

    def _plain(self, words: pa.LargeStringArray) -> np.ndarray:
        """Whether a word has only Latin letters, digits and signs, no apostrophe and no token of its own."""
        data, offsets = utf8(words)
        low, high = int(offsets[0]), int(offsets[-1])
        odd = _KIND[data[low:high]] == _ODD
        # The second byte of a letter counts only after its first, and the two signs among them do not.
        lead = np.flatnonzero(data[low:high] == 0xC3)
        second = data[low + lead + 1]
        odd[lead] = False
        odd[lead + 1] = (second == 0x97) | (second == 0xB7)
        upto = np.concatenate([[0], np.cumsum(odd)])
        plain = upto[offsets[1:] - low] == upto[offsets[:-1] - low]
        for token in self.added:
            plain &= ~np.asarray(pc.match_substring(words, token))
        return plain

    def _by_pieces(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``_found`` of plain words, taken apart together: a piece begins with a word, a digit or where letters meet signs."""
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        data, offsets = utf8(pc.utf8_lower(words))
        low = int(offsets[0])
        data, offsets = data[low : int(offsets[-1])], offsets - low
        kind = _KIND[data]
        begins = np.ones(len(data), bool)
        np.not_equal(kind[1:], kind[:-1], out=begins[1:])
        begins |= kind == _DIGIT
        begins[offsets[offsets < len(data)]] = True  # a word may be empty
        at = np.flatnonzero(begins)
        pieces = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(data))), pa.py_buffer(np.ascontiguousarray(data)))
        coded = pieces.dictionary_encode()
        found = list(map(self.pieces.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False).tolist()))
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids, ends = _joined(np.frombuffer(b"".join(found), np.uint32), np.cumsum(size) - size, size, np.asarray(coded.indices))
        own = ends[np.searchsorted(at, offsets)]
        return ids, own[:-1], np.diff(own)

    def _encoded(self, words: list[str]) -> list[bytes]:
        """The ids of other words as bytes, those of Latin letters with an apostrophe by the pattern."""
        out = list(map(self.known.get, words))
        missing = [k for k, ids in enumerate(out) if ids is None]
        split = [k for k in missing if LATIN.fullmatch(words[k]) and not any(t in words[k] for t in self.added)] if self.splits else []
        found = {k: b"".join(map(self.pieces.__getitem__, PIECES.findall(words[k].lower()))) for k in split}
        rest = [k for k in missing if k not in found]
        if rest:
            encoded = self.tokenizer.encode_batch_fast([words[k] for k in rest], add_special_tokens=False)
            found.update((k, array("I", e.ids).tobytes()) for k, e in zip(rest, encoded))
        for k, ids in found.items():
            out[k] = ids
            if len(words[k]) <= LONGEST:
                self.known[words[k]] = ids
        return out

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin and the last's end); null is empty."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = words.flatten().dictionary_encode()
        ids, ends = _joined(*self._found(coded.dictionary.cast(pa.large_string())), np.asarray(coded.indices))
        return ids, ends[np.append(0, np.cumsum(np.asarray(pc.list_value_length(words))))]

    def __call__(self, text: str) -> np.ndarray:
        return self.batch(pa.array([text], pa.string()))[0]


def _joined(ids: np.ndarray, start: np.ndarray, size: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the ids of ``kinds`` in turn, where each one's begin and the last's end), from where a kind's ids begin and their number."""
    own = size[kinds]
    ends = np.append(0, np.cumsum(own))
    return ids[np.repeat(start[kinds] - ends[:-1], own) + np.arange(ends[-1])], ends


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(name: str = TOKENIZER) -> WordTokenizer:
    """The worker's tokenizer of that name or path; kept between tasks."""
    if name not in _tokenizers:
        path = name
        if "/" not in name:
            import public_tokenizers

            path = public_tokenizers.path(name)
        _tokenizers[name] = WordTokenizer(path)
    return _tokenizers[name]


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``AT_ONCE`` bytes of texts, the last of their columns."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        upto, low = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0)).astype(np.int64)), 0
        while low < batch.num_rows:
            done = int(upto[low - 1]) if low else 0
            high = max(low + 1, int(np.searchsorted(upto, done + AT_ONCE - size, "right")))
            held.append(batch.slice(low, high - low))
            size, low = size + int(upto[high - 1]) - done, high
            if size >= AT_ONCE or low < batch.num_rows:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _tokenised(batches: Iterator[pa.RecordBatch], tokens: WordTokenizer) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of every (doc_id, text)."""
    for batch in _together(batches):
        ids, ends = tokens.batch(batch.column(1))
        for k, doc_id in enumerate(batch.column(0).to_pylist()):
            yield doc_id, ids[ends[k] : ends[k + 1]]


def _blocks(batches: Iterator[pa.RecordBatch], shard: int, name: str, end_id: int, block_ids: int) -> Iterator[pa.RecordBatch]:
    tokens = tokenizer(name)
    held: list[np.ndarray] = []
    docs: list[tuple] = []
    count = block = before = 0

    def flush() -> pa.RecordBatch:
        nonlocal held, docs, count, block, before
        ids = np.concatenate(held)
        directory = pa.StructArray.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*docs), _DOC)], fields=list(_DOC))
        payload = encode_block(ids, max(tokens.vocabulary, end_id + 1))
        columns = [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()), pa.ListArray.from_arrays([0, len(docs)], directory), pa.array([payload], pa.binary())]
        held, docs, block, before, count = [], [], block + 1, before + len(ids), 0
        return pa.RecordBatch.from_arrays(columns, schema=_FILES)

    end = np.array([end_id], np.uint32)
    for number, (doc_id, own) in enumerate(_tokenised(batches, tokens)):
        left, part = len(own) + 1, 0
        while left:
            # The end id comes last, maybe alone in the next block.
            length = min(left, block_ids - count)
            at = len(own) + 1 - left
            held.append(own[at : at + length])
            if length == left:
                held.append(end)
            docs.append((doc_id, number, part, length))
            left, part, count = left - length, part + 1, count + length
            if count == block_ids:
                yield flush()
    if count:
        yield flush()


_DOC = pa.struct([("doc_id", pa.int64()), ("number", pa.int64()), ("part", pa.int32()), ("length", pa.int64())])
_FILES = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("docs", pa.list_(_DOC)), ("payload", pa.binary())])


def write_ids(docs: DataFrame, path: str, tokens: str = TOKENIZER, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of every document, each closed by ``end_id``, in ascending doc_id order."""
    bounded_batches(ship(docs.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        yield from _blocks(batches, shard, tokens, end_id, block_ids)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("_tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").select("doc_id", "text")
    ordered.mapInArrow(run, FILES).write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the files in order of their blocks: shard, number, part, doc_id, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, _, docs, starts, ids in _decoded(batches):
            for k, d in enumerate(docs.to_pylist()):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard], pa.int32()), pa.array([d["number"]], pa.int64()), pa.array([d["part"]], pa.int32()), pa.array([d["doc_id"]], pa.int64()), pa.array([ids[starts[k] : starts[k + 1]].astype(np.int64)], pa.list_(pa.int64()))],
                    names=["shard", "number", "part", "doc_id", "ids"],
                )

    blocks = spark.read.schema(FILES).parquet(path)
    return blocks.mapInArrow(run, "shard int, number long, part int, doc_id long, ids array<long>")


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.StructArray, np.ndarray, np.ndarray]]:
    """Per block: shard, ids of the shard before it, its directory, where its documents begin in it and the last's end, its ids."""
    for batch in batches:
        shard, before, docs, payload = (batch.column(batch.schema.get_field_index(name)) for name in ("shard", "before", "docs", "payload"))
        for k in range(batch.num_rows):
            own = docs[k].values
            ids = decode_block(payload[k].as_py())
            starts = np.append(0, np.cumsum(own.field("length").to_numpy()))
            if starts[-1] != len(ids):
                raise ValueError("a block's directory differs from its ids")
            yield shard[k].as_py(), before[k].as_py(), own, starts, ids


def _joined_crc(first: int, second: int, length: int) -> int:
    """CRC-32 of two strings joined, from their own and the second's length in bytes."""
    step = b"\0" * min(length, 1 << 20)
    moved, blank, left = first, 0, length
    while left:
        part = step if left >= len(step) else step[:left]
        moved, blank, left = zlib.crc32(part, moved), zlib.crc32(part, blank), left - len(part)
    return moved ^ blank ^ second


def id_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens and ids_crc32 (of all its ids as
    little-endian unsigned 32-bit integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, before, docs, starts, ids in _decoded(batches):
            data, at = memoryview(ids.astype("<u4", copy=False)).cast("B"), starts.tolist()
            crcs = [zlib.crc32(data[4 * low : 4 * high]) for low, high in zip(at, at[1:])]
            columns = [np.full(len(docs), shard), docs.field("number"), docs.field("part"), docs.field("doc_id"), before + starts[:-1], docs.field("length"), crcs]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c.cast(f.type) for c, f in zip(columns, _PARTS)], schema=_PARTS)

    blocks = spark.read.schema(FILES).parquet(path)
    parts = blocks.mapInArrow(run, "shard int, number long, part int, doc_id long, at long, length long, crc long")
    grouped = parts.groupBy("shard", "number", "doc_id").agg(
        F.min("at").alias("at"), F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("part", "length", "crc"))).alias("parts")
    )

    @F.pandas_udf("long")
    def joined(parts):
        out = []
        for own in parts:
            crc = own[0]["crc"]
            for part in own[1:]:
                crc = _joined_crc(crc, part["crc"], 4 * part["length"])
            out.append(crc)
        import pandas as pd

        return pd.Series(out, dtype="int64")

    # Only documents cut by a block's end need the join of checksums.
    whole = grouped.where(F.size("parts") == 1).withColumn("ids_crc32", F.col("parts")[0]["crc"])
    cut = grouped.where(F.size("parts") > 1).withColumn("ids_crc32", joined("parts"))
    # One row per shard: its ids, from the block directories alone.
    sizes = blocks.select("shard", F.aggregate("docs", F.lit(0).cast("long"), lambda s, d: s + d["length"]).alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    offsets = sizes.select(F.col("shard"), (F.sum("n").over(W.partitionBy().orderBy("shard")) - F.col("n")).alias("_base"))
    return whole.unionByName(cut).join(offsets, "shard").select("doc_id", (F.col("_base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


_PARTS = pa.schema(
    [("shard", pa.int32()), ("number", pa.int64()), ("part", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("length", pa.int64()), ("crc", pa.int64())]
)


def encoded_documents(docs: DataFrame, tokens: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Write the documents' ids to fresh files and give the digests read back from them."""
    path = scratch_path(docs.sparkSession, "ids")
    write_ids(docs, path, tokens, end_id)
    return id_digests(docs.sparkSession, path)

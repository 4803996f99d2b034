"""Token-ID output in Simple-8b files.

`write_tokens` range-partitions the documents by id, tokenizes each partition in ascending id order and writes one
file (or a few) per partition through Spark's own text sink, so that commits, retries and any file system work as
for other sinks. A file is a series of blocks, each of a few hundred documents:

    magic "S8B1", then little-endian: uint32 partition, uint32 block number, uint32 documents, uint64 ids, uint64 words,
    documents x (uint8 id known, int64 doc_id, uint32 n_tokens), words x uint64, and a line feed

The header's counts are the offsets of the next block, so a reader finds blocks without decoding. `read_tokens`
reads the files back, one row per document, with the ids of all documents before it.

Defined cases: null or empty text has the end id alone; null ids come first; an empty table writes no block; equal
ids are neighbours in an undefined order between equal texts and by text otherwise; a text of any length is one document.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import simple8b
from .common import lean, new_path, ship, stage, table

MAGIC = b"S8B1"
HEAD = struct.Struct("<4sIIIQQ")
DOC = np.dtype([("known", "u1"), ("doc_id", "<i8"), ("n", "<u4")])
#: Ids of a block, unless one document alone has more.
BLOCK_IDS = 1 << 18
#: Blocks of a file (so that a file can be read as one binary), and characters of the texts that part rows with equal ids.
FILE_BLOCKS, PARTING = 512, 32
#: Strings between white space, and parts of them, whose ids a worker remembers; a full memory is emptied.
REMEMBERED, REMEMBERED_PARTS = 120_000, 400_000
#: Bytes of text that a worker takes at once, unless one document alone has more.
SLICE_BYTES = 1 << 23
#: Marks that are parted from the letter or digit they follow. No apostrophe: the tokenizer knows contractions.
MARKS = ".,;:!?#$%&*|"
#: Longest string that is remembered.
LONGEST = 64
#: The normalizer and splitter for which the short ways are right. White space is dropped and joins nothing, letters and
#: digits are parted from marks, and every character is lower-cased by itself.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}

#: Byte-level tokenizers write a byte as a character: printable ones of Latin-1 stand for themselves, the others follow from 256 on.
_OWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: b for b in _OWN} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _OWN)}
#: Characters of the Latin blocks that NFC leaves alone and that lower-case to one character (not the dotted capital i).
LATIN = re.compile("[A-Za-z\u00aa-\u012f\u0131-\u024f]+").fullmatch

_workers: dict[str, "_Tokenizer"] = {}


class _Memory(dict):
    """Values by key, made when first asked for; emptied when full. Long keys are not kept."""

    def __init__(self, make, most: int):
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(key) > LONGEST:
            return self.make(key)
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


def parts_at_white_space(definition: dict) -> bool:
    """Are a tokenizer's ids of a text those of its strings between ASCII white space, one after another?"""
    split = definition.get("pre_tokenizer") or {}
    first = (split.get("pretokenizers") or [{}])[0] if split.get("type") == "Sequence" else split
    added = definition.get("added_tokens") or []
    plain = all(not (t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"] or re.search(r"\s", t["content"])) for t in added)
    return definition.get("normalizer") == NORMALIZER and first == SPLITTER and plain and not definition.get("truncation") and not definition.get("padding")


class _Tokenizer:
    """Ids of texts; strings between white space are tokenized once and remembered.

    The short ways (by strings, by strings and marks, letters straight to the model) are taken only for a tokenizer whose definition
    is the one they are right for; any other gets the whole texts.
    """

    def __init__(self, path: str, by_word: bool):
        import tokenizers

        self.model = tokenizers.Tokenizer.from_file(path)
        definition = json.loads(self.model.to_str())
        self.by_word = by_word and parts_at_white_space(definition)
        rest = (definition.get("pre_tokenizer") or {}).get("pretokenizers", [])[1:]
        self.direct = self.by_word and [(x["type"], x.get("add_prefix_space"), x.get("use_regex")) for x in rest] == [("ByteLevel", False, False)]
        self.parts, self.known = _Memory(self._part, REMEMBERED_PARTS), _Memory(self._string, REMEMBERED)

    def _part(self, s: str) -> bytes:
        if self.direct and s.isalpha() and (s.isascii() or LATIN(s) and unicodedata.is_normalized("NFC", s)):
            low = s.lower()
            ids = [t.id for t in self.model.model.tokenize(low if low.isascii() else low.encode().decode("latin-1").translate(BYTE_CHARS))]
        else:
            ids = self.model.encode(s, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _string(self, s: str) -> bytes:
        """A string's ids. Marks are parted only from an ASCII or Latin letter or digit: others may lower-case or decompose into
        something that ends in a combining mark, which goes with the marks."""
        if len(s) > LONGEST:
            return self._part(s)
        stem = s.rstrip(MARKS)
        if not stem or not stem[-1].isalnum() or not (stem[-1].isascii() or LATIN(stem[-1])):
            return self.parts[s]
        low = stem.lower() if self.direct and stem.isascii() and stem.isalnum() else stem
        return self.parts[low] + self.parts[s[len(stem) :]] if len(stem) < len(s) else self.parts[low]

    def __call__(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """The ids of each text: distinct strings are looked up, their ids are gathered for all texts at once."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        if not self.by_word:
            return [np.array(e.ids, dtype="<u4") for e in self.model.encode_batch(texts.to_pylist(), add_special_tokens=False)]
        strings = pc.ascii_split_whitespace(texts)
        bounds = strings.offsets.to_numpy() - strings.offsets[0].as_py()
        coded = strings.flatten().dictionary_encode()
        codes, pieces = coded.indices.to_numpy(), list(map(self.known.__getitem__, coded.dictionary.to_pylist()))
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        first, data = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(pieces), "<u4")
        lengths = sizes[codes]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        ids = data[np.repeat(first[codes] - ends[:-1], lengths) + np.arange(ends[-1])]
        at = ends[bounds].tolist()
        return [ids[a:b] for a, b in zip(at, at[1:])]


def _tokenizer(path: str, by_word: bool) -> _Tokenizer:
    key = f"{path}|{by_word}"
    if key not in _workers:
        _workers[key] = _Tokenizer(path, by_word)
    return _workers[key]


def pack_block(partition: int, number: int, doc_ids: list, ids: list[np.ndarray]) -> bytes:
    docs = np.zeros(len(ids), dtype=DOC)
    docs["known"] = [d is not None for d in doc_ids]
    docs["doc_id"] = [d or 0 for d in doc_ids]
    docs["n"] = [len(x) for x in ids]
    values = np.concatenate(ids).astype(np.uint64) if ids else np.zeros(0, np.uint64)
    words = simple8b.encode(values)
    return HEAD.pack(MAGIC, partition, number, len(ids), len(values), len(words)) + docs.tobytes() + words.astype("<u8").tobytes()


def unpack_blocks(data: bytes) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(partition, block number, documents, ids) of a file."""
    at = 0
    while at < len(data):
        magic, partition, number, n_docs, n_ids, n_words = HEAD.unpack_from(data, at)
        if magic != MAGIC:
            raise ValueError(f"no block at byte {at}")
        at += HEAD.size
        docs = np.frombuffer(data, dtype=DOC, count=n_docs, offset=at)
        at += docs.nbytes
        words = np.frombuffer(data, dtype="<u8", count=n_words, offset=at)
        at += words.nbytes + 1
        yield partition, number, docs, simple8b.decode(words, n_ids).astype("<u4")


def _tokenized(batch: pa.RecordBatch, tokenize: _Tokenizer) -> Iterator[tuple[int | None, np.ndarray]]:
    """(id, ids) of a batch's documents, tokenized in slices of bounded size."""
    texts = pc.fill_null(batch.column(1), "")
    upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        n = max(1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE_BYTES, side="right")) - at)
        yield from zip(batch.column(0).slice(at, n).to_pylist(), tokenize(texts.slice(at, n)))
        at += n


def _blocks(path: str, by_word: bool, end_id: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenize, partition = _tokenizer(path, by_word), TaskContext.get().partitionId()
        end = np.array([] if end_id is None else [end_id], dtype=np.uint32)
        doc_ids, ids, size, number = [], [], 0, 0

        def block():
            return pa.RecordBatch.from_arrays([pa.array([pack_block(partition, number, doc_ids, ids)], pa.binary())], ["block"])

        for batch in batches:
            for doc_id, mine in _tokenized(batch, tokenize):
                mine = np.concatenate((mine, end))
                if ids and size + len(mine) > BLOCK_IDS:
                    yield block()
                    doc_ids, ids, size, number = [], [], 0, number + 1
                doc_ids.append(doc_id)
                ids.append(mine)
                size += len(mine)
        if ids:
            yield block()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, end_id: int | None = 1, by_word: bool = True, id_col="doc_id", text_col="text", partitions: int | None = None) -> None:
    """Writes the texts' ids under path in ascending id order."""
    spark = ship(docs.sparkSession)
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # Rows that share an id (or have none) are parted by the texts' beginnings, which the order by id and text follows too.
    rows = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.substring("text", 1, PARTING)).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    blocks = rows.mapInArrow(lean(_blocks(tokenizer, by_word, end_id)), "block binary")
    blocks.select(F.col("block").cast("string").alias("value")).write.option("compression", "none").option("maxRecordsPerFile", FILE_BLOCKS).text(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            for partition, number, docs, ids in unpack_blocks(content.as_py()):
                ends = np.cumsum(docs["n"].astype(np.int64))
                starts = ends - docs["n"]
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(docs), partition)), pa.array(np.full(len(docs), number)), pa.array(np.arange(len(docs))), pa.array(docs["doc_id"], mask=docs["known"] == 0), pa.array(docs["n"].astype(np.int64)), pa.array(starts), pa.array(np.array(crc, dtype=np.int64))],
                    ["partition", "block", "at", "doc_id", "n_tokens", "inner", "ids_crc32"],
                )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, partition, block, at: the files' documents and where their ids begin."""
    files = ship(spark).read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    rows = files.mapInArrow(lean(_documents), "partition long, block long, at long, doc_id long, n_tokens long, inner long, ids_crc32 long")
    rows = stage(rows, "token_rows")
    per = rows.groupBy("partition", "block").agg(F.sum("n_tokens").alias("n"))
    # Two short tables: blocks of a partition, and partitions of the whole, are summed up apart.
    inside = Window.partitionBy("partition").orderBy("block")
    per = per.withColumn("before", F.sum("n").over(inside) - F.col("n"))
    shards = per.groupBy("partition").agg(F.sum("n").alias("n"))
    shards = shards.select(F.col("partition").alias("p"), (F.sum("n").over(Window.orderBy("partition")) - F.col("n")).alias("base"))
    per = per.join(shards, F.col("partition") == F.col("p")).select(F.col("partition").alias("p"), F.col("block").alias("b"), (F.col("base") + F.col("before")).alias("base"))
    rows = rows.join(per, (F.col("partition") == F.col("p")) & (F.col("block") == F.col("b")))
    return rows.select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32", "partition", "block", "at")


def token_output(docs: DataFrame, tokenizer: str | None = None, **options) -> DataFrame:
    """Writes docs' tokens to a new folder of the shared ones and returns what is read back."""
    import public_tokenizers

    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer or public_tokenizers.path("word_bpe_49k.json"), **options)
    return read_tokens(docs.sparkSession, path)


def op2_simple8b_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", "ids_crc32")

"""Token ids in wavelet matrices: one compressed file per shard that answers access, count and occurrence lookups.

Documents are range-partitioned by id and sorted; each task tokenizes what it reads and closes a shard after the document
that fills it. A shard's file holds its alphabet (most frequent id first), the documents with their lengths, and for each
bit of the alphabet codes one plane of bits with the ones counted per block; each section is compressed by itself. Token
at a position, occurrences before a position and the place of the k-th occurrence take one rank or select per plane.

The files are rows of a Parquet table in a folder that all executors share, so a lost task is written again and only
whole shards are ever seen. What a shard needs to know of others is one number per partition (the ids before it).

Defined results: a null or empty text has only the closing id; rows are ordered by id, nulls first, then by text; equal
rows are documents of their own; other columns of the input are not read; an empty table gives no shard.
"""

from __future__ import annotations

import itertools
import os
import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import slices
from tidemark.session import shared_folder

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
SHARD_TOKENS = 1 << 20
BLOCK = 512
MAGIC = b"TWM1"
KNOWN = 600_000
SLICE_BYTES = 8_000_000
#: What the last token of a word ends in (a fixed value of the tokenizer file).
WORD_END = "</w>"
#: Characters whose case, normal form and white space the standard string methods and the tokenizer file see alike.
OTHER = re.compile("[^\x00-\x1b\x20-įı-ɏ‐-‧€]")
#: How the file cuts texts of all other characters, lower-cased, into words: classes of few characters are searched faster than properties.
LOWERED = sorted({c for char in map(chr, range(0x2100)) if not OTHER.search(char) for c in char.lower()})
LETTERS, NUMBERS = ("".join(c for c in LOWERED if unicodedata.category(c)[0] == kind) for kind in "LN")
WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]++|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]++")


def spans(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``values`` of span after span, and where each span begins and the last one ends among them."""
    ends = np.append(0, np.cumsum(sizes))
    places = np.repeat((starts - ends[:-1]).astype(np.int32), sizes) + np.arange(ends[-1], dtype=np.int32)
    return values.take(places), ends


class ChunkIds:
    """Ids of texts by a tokenizer file whose words end in a token of their own kind.

    No word of the file crosses white space, so a text is its chunks between white space. Each distinct chunk of a call is
    cut into words once; a bounded number of words is remembered with their ids, in arrays rather than one object a word;
    unknown words go through the library together, each once.
    """

    def __init__(self, name: str) -> None:
        import public_tokenizers
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.special = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self._forget()

    def _forget(self) -> None:
        self.words = pa.array([], pa.large_string())
        self.ids, self.ends = np.zeros(0, "<u4"), np.zeros(1, np.int64)      # ids of word after word, and where each begins

    def _numbers(self, words: list[pa.Array]) -> np.ndarray:
        """Numbers of words among the remembered ones; unknown ones are learned."""
        if len(self.words) > KNOWN or len(self.ids) > 16 * KNOWN:       # few words can be long
            self._forget()
        known = len(self.words)
        every = pa.concat_arrays([self.words, *words]).dictionary_encode()       # keeps the numbers of those remembered
        fresh = every.dictionary[known:].to_pylist()
        if fresh:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(fresh)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(fresh):
                raise ValueError("a word of the tokenizer does not end in a closing token")
            self.words = every.dictionary
            self.ids, self.ends = np.append(self.ids, ids), np.append(self.ends, len(self.ids) + ends)
        return every.indices.to_numpy()[known:]

    def _of(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks, one after another, and where each chunk begins and the last one ends among them."""
        letters = pc.utf8_is_alpha(chunks).to_numpy(zero_copy_only=False)       # letters alone are one word
        mixed = chunks.filter(pa.array(~letters))
        found = pa.array(WORDS.findall(" ".join(mixed.to_pylist())), pa.large_string())
        # the words of a chunk cover it, so its last one ends where the chunk does; an empty chunk has none
        upto = np.searchsorted(np.cumsum(pc.binary_length(found).to_numpy()), np.cumsum(pc.binary_length(mixed).to_numpy()), "right")
        number = self._numbers([chunks.filter(pa.array(letters)), found])
        flat, ends = spans(self.ids, self.ends[number], self.ends[number + 1] - self.ends[number])
        # words of letters alone stand before the others: the first word of each chunk and the one after its last
        own = len(chunks) - len(mixed)
        first, after = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        first[letters], after[letters] = np.arange(own), np.arange(1, own + 1)
        first[~letters], after[~letters] = own + np.append(0, upto)[:-1], own + upto
        return spans(flat, ends[first], ends[after] - ends[first])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The library's ids of whole texts; texts with other characters or with a special token go through it whole."""
        plain = np.array([OTHER.search(text) is None and not any(s in text for s in self.special) for text in texts], bool)
        whole = iter(self.tokenizer.encode_batch_fast([t for t, p in zip(texts, plain) if not p], add_special_tokens=False))
        split = pc.utf8_split_whitespace(pa.array([t.lower() for t, p in zip(texts, plain) if p], pa.large_string()))
        chunks = split.flatten().dictionary_encode()
        number = chunks.indices.to_numpy()
        ids, ends = self._of(chunks.dictionary)
        # the ids of chunk after chunk, and where each text's first chunk begins among them
        flat, ends = spans(ids, ends[number], np.diff(ends)[number])
        bounds = iter(itertools.pairwise(ends[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()))
        return [flat[slice(*next(bounds))] if p else np.array(next(whole).ids, "<u4") for p in plain.tolist()]


@lru_cache(maxsize=2)
def chunk_ids(name: str) -> ChunkIds:
    return ChunkIds(name)


class WaveletMatrix:
    """Bit planes of a sequence of ids, from the highest bit of the codes down; zeros of a plane come first in the next one."""

    def __init__(self, size: int, symbols: np.ndarray, planes: list[np.ndarray], counts: list[np.ndarray]) -> None:
        self.size, self.symbols, self.planes = size, symbols, planes
        self.before = [np.concatenate([[0], np.cumsum(c, dtype=np.int64)]) for c in counts]
        self.zeros = [size - int(b[-1]) for b in self.before]
        self.code = {int(s): i for i, s in enumerate(symbols)}

    @staticmethod
    def build(ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Alphabet and bit planes of ``ids``."""
        frequency = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
        symbols = np.argsort(-frequency, kind="stable")[:np.count_nonzero(frequency)].astype("<u4")
        codes = np.zeros(len(frequency), np.uint16 if len(symbols) <= 1 << 16 else np.uint32)
        codes[symbols] = np.arange(len(symbols), dtype=codes.dtype)
        x, planes = codes[ids], []
        for level in reversed(range(max(1, (len(symbols) - 1).bit_length()) if len(symbols) else 0)):
            bit = (x & codes.dtype.type(1 << level)) != 0
            planes.append(np.packbits(bit, bitorder="little"))
            x = np.concatenate([x.take(np.flatnonzero(~bit)), x.take(np.flatnonzero(bit))])
        return symbols, planes

    @staticmethod
    def block_counts(plane: np.ndarray) -> np.ndarray:
        """Ones in each block of a plane."""
        padded = np.zeros(-(-len(plane) * 8 // BLOCK) * BLOCK // 64, np.uint64)
        padded.view(np.uint8)[:len(plane)] = plane
        return np.bitwise_count(padded).reshape(-1, BLOCK // 64).sum(axis=1).astype("<u2")

    def _rank1(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones of a plane before each position."""
        plane, block = self.planes[level], at // BLOCK
        ones = self.before[level][block]
        first = block * (BLOCK // 8)
        for byte in range(BLOCK // 8):
            here = first + byte
            left = np.clip(at - here * 8, 0, 8)
            if not left.any():
                break
            value = plane[np.minimum(here, len(plane) - 1)] & ((1 << left) - 1).astype(np.uint8)
            ones = ones + np.bitwise_count(value)
        return ones

    def access(self, positions: np.ndarray) -> np.ndarray:
        """Ids at positions."""
        at, code = np.asarray(positions, np.int64), np.zeros(len(positions), np.int64)
        for level, plane in enumerate(self.planes):
            bit = plane[at >> 3] >> (at & 7).astype(np.uint8) & 1
            ones = self._rank1(level, at)
            at = np.where(bit, self.zeros[level] + ones, at - ones)
            code = code << 1 | bit
        return self.symbols[code].astype(np.int64)

    def _range(self, symbol: int, end: int) -> tuple[int, int]:
        """Where the occurrences of ``symbol`` before ``end`` stand below the last plane."""
        code, low, high = self.code[symbol], 0, end
        for level in range(len(self.planes)):
            ones = self._rank1(level, np.array([low, high]))
            if code >> (len(self.planes) - 1 - level) & 1:
                low, high = self.zeros[level] + int(ones[0]), self.zeros[level] + int(ones[1])
            else:
                low, high = low - int(ones[0]), high - int(ones[1])
        return low, high

    def rank(self, symbol: int, end: int | None = None) -> int:
        """Occurrences of ``symbol`` before ``end`` (default: all)."""
        if symbol not in self.code:
            return 0
        low, high = self._range(symbol, self.size if end is None else end)
        return high - low

    def _select(self, level: int, bit: int, k: np.ndarray) -> np.ndarray:
        """Positions of the k-th zeros or ones (from 0) of a plane."""
        starts = np.minimum(np.arange(len(self.before[level])) * BLOCK, self.size)
        counts = self.before[level] if bit else starts - self.before[level]
        block = np.searchsorted(counts, k, "right") - 1
        out = np.zeros(len(k), np.int64)
        for b in np.unique(block):
            bits = np.unpackbits(self.planes[level][b * BLOCK // 8:(b + 1) * BLOCK // 8], bitorder="little")
            own = block == b
            out[own] = b * BLOCK + np.flatnonzero(bits == bit)[k[own] - counts[b]]
        return out

    def select(self, symbol: int, ranks: np.ndarray | None = None) -> np.ndarray:
        """Positions of the occurrences of ``symbol`` with the given ranks (default: all), climbing from the last plane."""
        if symbol not in self.code:
            return np.zeros(0, np.int64)
        low, high = self._range(symbol, self.size)
        at = low + (np.arange(high - low) if ranks is None else np.asarray(ranks, np.int64))
        for level in reversed(range(len(self.planes))):
            bit = self.code[symbol] >> (len(self.planes) - 1 - level) & 1
            at = self._select(level, bit, at - self.zeros[level] if bit else at)
        return at

    def decode(self) -> np.ndarray:
        """All ids in order: from the last plane up, each plane deals its zeros and ones back."""
        below = None
        for level in reversed(range(len(self.planes))):
            bit = np.unpackbits(self.planes[level], count=self.size, bitorder="little").view(bool)
            here = np.zeros(self.size, np.uint32)
            if below is not None:
                here[np.flatnonzero(~bit)], here[np.flatnonzero(bit)] = below[:self.zeros[level]], below[self.zeros[level]:]
            here |= bit.astype(np.uint32) << np.uint32(len(self.planes) - 1 - level)
            below = here
        return self.symbols[below] if below is not None else np.zeros(0, "<u4")


def write_file(doc_ids: list, ids: list[np.ndarray]) -> bytes:
    """One shard's file: header, lengths of the sections, sections."""
    every = np.concatenate(ids)
    symbols, planes = WaveletMatrix.build(every)
    known = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + bytes(d is None for d in doc_ids)
    sections = [symbols.tobytes(), known + np.array([len(i) for i in ids], "<i8").tobytes()]
    for plane in planes:
        sections += [plane.tobytes(), WaveletMatrix.block_counts(plane).tobytes()]
    press = zstandard.ZstdCompressor(level=1)
    packed = [press.compress(s) for s in sections]
    return MAGIC + struct.pack("<QQQ", len(every), len(ids), len(planes)) + np.array([len(p) for p in packed], "<u8").tobytes() + b"".join(packed)


def read_file(file: bytes) -> tuple[list, np.ndarray, WaveletMatrix]:
    """Document ids, their lengths and the matrix of a shard."""
    if file[:4] != MAGIC:
        raise ValueError("not a token file")
    size, docs, planes = struct.unpack_from("<QQQ", file, 4)
    lengths = np.frombuffer(file, "<u8", 2 + 2 * planes, 28)
    open_one, at, sections = zstandard.ZstdDecompressor(), 28 + lengths.nbytes, []
    for length in lengths.tolist():
        sections.append(open_one.decompress(file[at:at + length]))
        at += length
    known = np.frombuffer(sections[1], "<i8", docs).tolist()
    missing = sections[1][8 * docs:9 * docs]
    matrix = WaveletMatrix(size, np.frombuffer(sections[0], "<u4"), [np.frombuffer(s, np.uint8) for s in sections[2::2]],
                           [np.frombuffer(s, "<u2") for s in sections[3::2]])
    return [None if m else d for d, m in zip(known, missing)], np.frombuffer(sections[1], "<i8", docs, 9 * docs), matrix


def _writer(tokenizer: str, end_id: int, shard_tokens: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, before, size = TaskContext.get().partitionId(), 0, 0, 0
        docs, ids, known = [], [], chunk_ids(tokenizer)

        def shard() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in (
                (part, pa.int64()), (number, pa.int64()), (before, pa.int64()), (len(docs), pa.int64()), (size, pa.int64()), (write_file(docs, ids), pa.binary()))],
                names=["part", "number", "before", "n_docs", "n_tokens", "file"])

        for batch, texts in slices(batches, limit=SLICE_BYTES):
            for doc, found in zip(batch.column(0).to_pylist(), known.encode([t or "" for t in texts])):
                docs.append(doc)
                ids.append(np.append(found, np.uint32(end_id)))
                size += len(ids[-1])
                if size >= shard_tokens:
                    yield shard()
                    number, before, size, docs, ids = number + 1, before + size, 0, [], []
        if docs:
            yield shard()
    return write


def write_token_files(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER,
                      end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode every text, append ``end_id`` and write the shards in order of ids to the folder ``path``."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    keys = ["doc_id", "digest", "row"]    # the last two order, and spread, rows with one id
    ordered = rows.withColumns({"digest": F.xxhash64("text"), "row": F.monotonically_increasing_id()}).repartitionByRange(*keys).sortWithinPartitions(*keys)
    schema = "part long, number long, before long, n_docs long, n_tokens long, file binary"
    ordered.select("doc_id", "text").mapInArrow(_writer(tokenizer, end_id, shard_tokens), schema).write.mode("overwrite").parquet(path)


def shards(spark: SparkSession, path: str) -> DataFrame:
    """One row per shard: ``first`` (ids in all shards before it), n_docs, n_tokens and its file."""
    files = spark.read.parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("own"))
    # one row per partition of the writing job, so at most spark.sql.shuffle.partitions rows of two numbers
    offsets = parts.select("part", (F.sum("own").over(Window.orderBy("part")) - F.col("own")).alias("earlier"))
    return files.join(F.broadcast(offsets), "part").select("part", "number", (F.col("earlier") + F.col("before")).alias("first"), "n_docs", "n_tokens", "file")


def _each_shard(function, names: list[str], types: list[pa.DataType]):
    """``function(first, doc_ids, lengths, matrix)`` gives the columns that each shard adds."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                columns = function(batch.column(0)[i].as_py(), *read_file(batch.column(1)[i].as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
    return read


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 and, if wanted, its ids."""
    def rows(first: int, doc_ids: list, lengths: np.ndarray, matrix: WaveletMatrix) -> list:
        ids, ends = matrix.decode().astype("<u4"), np.cumsum(lengths)
        own = [ids[e - n:e] for e, n in zip(ends.tolist(), lengths.tolist())]
        return [doc_ids, first + ends - lengths, lengths, [zlib.crc32(o.data) for o in own], *([[o.astype(np.int64) for o in own]] if with_ids else [])]

    names, types = ["doc_id", "start", "n_tokens", "ids_crc32"], [pa.int64()] * 4
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if with_ids:
        names, types, schema = [*names, "ids"], [*types, pa.list_(pa.int64())], schema + ", ids array<long>"
    return shards(spark, path).select("first", "file").mapInArrow(_each_shard(rows, names, types), schema)


def count_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """Occurrences of an id per shard, by rank alone: first, n."""
    def rows(first: int, doc_ids: list, lengths: np.ndarray, matrix: WaveletMatrix) -> list:
        return [[first], [matrix.rank(token)]]
    return shards(spark, path).select("first", "file").mapInArrow(_each_shard(rows, ["first", "n"], [pa.int64()] * 2), "first long, n long")


def find_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """Every occurrence of an id, by select: doc_id, position in the whole sequence, offset in the document."""
    def rows(first: int, doc_ids: list, lengths: np.ndarray, matrix: WaveletMatrix) -> list:
        at, ends = matrix.select(token), np.cumsum(lengths)
        doc = np.searchsorted(ends, at, "right")
        return [[doc_ids[d] for d in doc], first + at, at - (ends - lengths)[doc]]
    return shards(spark, path).select("first", "file").mapInArrow(
        _each_shard(rows, ["doc_id", "position", "offset"], [pa.int64()] * 3), "doc_id long, position long, offset long")


def tokens_at(spark: SparkSession, path: str, start: int, length: int) -> DataFrame:
    """The ids of positions ``start`` to ``start + length - 1``, by access: position, token. Other shards are not opened."""
    def rows(first: int, doc_ids: list, lengths: np.ndarray, matrix: WaveletMatrix) -> list:
        at = np.arange(max(0, start - first), min(matrix.size, start + length - first))
        return [first + at, matrix.access(at)]
    wanted = shards(spark, path).where((F.col("first") < start + length) & (F.col("first") + F.col("n_tokens") > start))
    return wanted.select("first", "file").mapInArrow(_each_shard(rows, ["position", "token"], [pa.int64()] * 2), "position long, token long")


def encode_and_read_back(docs: DataFrame, **options) -> DataFrame:
    """Write the files to a folder of their own below the checkpoint folder and read every document back from them."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, path, **options)
    return read_documents(spark, path)

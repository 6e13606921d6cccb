"""Packing along a space-filling curve: documents near each other in a projected space share sequences.

Each document's bag of token ids is hashed to a fixed number of buckets and projected to a few dimensions by a fixed
random matrix; its place on the Hilbert curve through these dimensions is the sort key. Token ids are written once to
the checkpoint folder, range-partitioned by (key, id), sorted, and cut along the curve: every partition fills sequences
of ``length`` tokens one after the other. What remains at the end of a partition is cut into sequences whose lengths are
powers of two, which need no padding. Ties of the key are ordered by id, so a large group of copies spreads evenly.

Defined results: a null text is empty and has only the closing id; equal rows are packed each; a null id stays null and
sorts first; an empty table gives no piece.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices
from tidemark.session import cut_lineage

LENGTH = 1024
END_ID = 0
DIMENSIONS = 4
BITS = 15
BUCKETS = 512
SEED = 20_240_229
#: Beyond these characters the two libraries may class letters by different Unicode versions.
LATIN_ONLY = regex.compile(r"[\x00-ɏ‐-‧€]*+")
LONG = 2000
LONG_PIECE = regex.compile(rf"\S{{{LONG}}}|\s{{{LONG}}}")


def has_long_piece(text: str) -> bool:
    """Whether ``LONG_PIECE`` is found: such a piece covers a whole aligned half of its length, so only texts with a half that has no blank, or nothing else, are searched."""
    half = LONG // 2
    for start in range(0, len(text) - half + 1, half):
        part = text[start:start + half]
        if " " not in part or part.isspace():
            return LONG_PIECE.search(text) is not None
    return False


@lru_cache(maxsize=2)
def token_encoder(name: str) -> Callable[[list[str]], list[list[int]]]:
    """Ids of texts by the tokenizer file ``name``; where the same vocabulary is there as ranks, plain texts take the faster library."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    slow = Tokenizer.from_file(public_tokenizers.path(name))
    special = [token.content for token in slow.get_added_tokens_decoder().values()]
    ranks_file = public_tokenizers.path(name.removesuffix(".json") + ".tiktoken")
    fast = None
    if os.path.exists(ranks_file):
        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(texts: list[str]) -> list[list[int]]:
        out = []
        for text in texts:
            if fast and (text.isascii() or LATIN_ONLY.fullmatch(text)) and not has_long_piece(text) and not any(s in text for s in special):
                out.append(fast.encode_ordinary(text))
            else:
                out.append(slow.encode(text, add_special_tokens=False).ids)
        return out
    return encode


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of unsigned coordinates (Skilling's transform)."""
    x = [points[:, k].astype(np.uint64) for k in range(points.shape[1])]
    one = np.uint64(1)
    for bit in range(bits - 1, 0, -1):
        q, low = np.uint64(1 << bit), np.uint64((1 << bit) - 1)
        for k in range(len(x)):
            high = (x[k] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[k]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            if k:
                x[k] = x[k] ^ swap
    for k in range(1, len(x)):
        x[k] = x[k] ^ x[k - 1]
    turn = np.zeros(len(points), np.uint64)
    for bit in range(bits - 1, 0, -1):
        turn = np.where((x[-1] & np.uint64(1 << bit)) != 0, turn ^ np.uint64((1 << bit) - 1), turn)
    key = np.zeros(len(points), np.uint64)
    for bit in range(bits - 1, -1, -1):
        for value in x:
            key = (key << one) | (((value ^ turn) >> np.uint64(bit)) & one)
    return key.astype(np.int64)


def curve_keys(ids: list[np.ndarray]) -> np.ndarray:
    """Hilbert keys of documents from their token ids."""
    owner = np.repeat(np.arange(len(ids)), [len(i) for i in ids])
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    bucket = (flat.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKETS.bit_length() + 1)
    vectors = np.sqrt(np.bincount(owner * BUCKETS + bucket.astype(np.int64), minlength=len(ids) * BUCKETS).reshape(len(ids), BUCKETS))
    vectors /= np.maximum(1e-9, np.linalg.norm(vectors, axis=1, keepdims=True))
    matrix = np.random.default_rng(SEED).standard_normal((BUCKETS, DIMENSIONS))
    spread = 1 / (1 + np.exp(-2 * vectors @ matrix))
    return hilbert_keys(np.minimum((spread * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def tokenized(docs: DataFrame, doc_id: str, text: str, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, curve key and token ids (32-bit, or 16-bit where they fit) with the closing id."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = token_encoder(tokenizer)
        for batch, texts in slices(batches):
            ids = [np.array([*found, end_id], np.uint32) for found in encoder([t or "" for t in texts])]
            packed = [i.astype("<u2").tobytes() if i.max() < 65536 else i.astype("<u4").tobytes() for i in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(curve_keys([i[:-1] for i in ids])), pa.array([len(i) for i in ids], pa.int64()), pa.array(packed, pa.binary())],
                names=["doc_id", "key", "doc_tokens", "ids"])
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(encode, "doc_id long, key long, doc_tokens long, ids binary")


def _packer(length: int, with_ids: bool):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence, fill = TaskContext.get().partitionId() << 40, 0
        open_pieces: list[tuple] = []      # of the sequence that is being filled: at most ``length`` tokens
        done: list[tuple] = []

        def close(pieces: list[tuple]) -> None:
            nonlocal sequence
            at = 0
            for doc, start, ids, total in pieces:
                done.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, at, ids))
                at += len(ids)
            sequence += 1

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*done))
            arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
            if with_ids:
                bounds = np.zeros(len(done) + 1, np.int32)
                np.cumsum(columns[2], out=bounds[1:])
                arrays.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(columns[7]).astype(np.int32))))
            done.clear()
            return pa.RecordBatch.from_arrays(arrays, names=NAMES[:len(arrays)])

        for batch in batches:
            for doc, total, raw in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * total else "<u4").astype("<u4")
                at = 0
                while at < total:
                    take = min(length - fill, total - at)
                    open_pieces.append((doc, at, ids[at:at + take], total))
                    fill, at = fill + take, at + take
                    if fill == length:
                        close(open_pieces)
                        open_pieces, fill = [], 0
                if len(done) > 4000:
                    yield batch_of()
        # the rest, cut at powers of two from the largest to the smallest
        while fill:
            size, pieces = 1 << (fill.bit_length() - 1), []
            fill -= size
            while size:
                doc, start, ids, total = open_pieces.pop(0)
                if len(ids) > size:
                    open_pieces.insert(0, (doc, start + size, ids[size:], total))
                    ids = ids[:size]
                pieces.append((doc, start, ids, total))
                size -= len(ids)
            close(pieces)
        if done:
            yield batch_of()
    return pack


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH,
                   tokenizer: str = "byte_bpe_50k.json", end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if wanted, its ids."""
    tokens = cut_lineage(tokenized(docs, doc_id, text, tokenizer, end_id))
    ordered = tokens.repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id", "ids")
    schema = ", ".join(f"{name} long" for name in NAMES[:7]) + (", ids array<int>" if with_ids else "")
    return ordered.mapInArrow(_packer(length, with_ids), schema)

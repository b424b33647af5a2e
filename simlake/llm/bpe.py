"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Encoding.  A task splits its texts into pre-tokens and gathers them in blocks: each
block numbers its distinct pre-tokens and keeps, for each text, the numbers in order
of position.  Only a block's distinct words enter the shuffle, packed by the owner
that their hash names, so even the most frequent word enters once a block.  The task
that owns a word encodes it once.  The ids go back to the words' blocks, where each
text is reassembled by position.  Blocks are dealt to twice as many parts as the input
has and a task holds its part, packed, so that nothing is sorted.  The documents are
read twice, once for the words and once for the positions, rather than stored in
between; they must come in the same order both times, as tables do, and a mark on each
block makes the query fail if they do not.

Decoding.  The table of token bytes has one row for each rank of the vocabulary file, so
its size is bounded by that file.  It is joined as a broadcast is: every task holds it,
keyed by rank, and joins all ids of a batch to it at once, in order of position.

Defined results.  A null text counts as empty and has no ids.  Rows are independent,
so repeated rows and ids, and null ids, are harmless; extra columns are ignored; an
empty table gives an empty table.  A text longer than a block is a block of its own.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simlake.llm.common import slices, table, tidy

#: A block is closed at so many distinct words or characters of text; so many texts make one row.
BLOCK_WORDS, BLOCK_CHARS, CHUNK_TEXTS = 200_000, 4 << 20, 1024
#: Words that an owner keeps; beyond this it forgets them and may encode a word again.
OWNED_WORDS = 2_000_000


def ranks_of(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file with lines of base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks_of(path), special_tokens={})


@lru_cache(maxsize=2)
def _token_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of each rank's bytes, and all of these bytes."""
    ranks = ranks_of(path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    return np.cumsum(lengths) - lengths, lengths, np.frombuffer(b"".join(tokens), np.uint8)


def _pack(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, their bytes in planes, compressed: small numbers take little room."""
    return zstandard.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 6)


def _unpack(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(packed), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").reshape(-1)


_TEXT_SCHEMA = pa.schema([("block", pa.string()), ("mark", pa.int64()), ("doc_ids", pa.list_(pa.string())), ("sizes", pa.binary()), ("positions", pa.binary())])
_WORD_SCHEMA = pa.schema([("block", pa.string()), ("mark", pa.int64()), ("owner", pa.int32()), ("numbers", pa.binary()), ("lengths", pa.binary()), ("words", pa.binary())])
_TEXT_TYPE = "block string, mark bigint, doc_ids array<string>, sizes binary, positions binary"
_WORD_TYPE = "block string, mark bigint, owner int, numbers binary, lengths binary, words binary"


def _blocked(batches: Iterator[pa.RecordBatch], pattern: str, owners: int | None) -> Iterator[pa.RecordBatch]:
    """A block's texts as word numbers by position, or, with owners, its words by the owner that encodes them.

    Both come from the same scan of the same task, made twice; ``mark`` tells if they differ.
    """
    split, task = regex.compile(pattern), TaskContext.get().partitionId()
    words: dict[str, int] = {}
    texts: list[tuple[str | None, np.ndarray]] = []
    size = closed = 0

    def close() -> Iterator[pa.RecordBatch]:
        block, mark = f"{task}-{closed}", zlib.crc32("\0".join(words).encode())
        # the more often a word occurs, the smaller its number
        times = np.zeros(len(words), np.int64)
        for at in range(0, len(texts), CHUNK_TEXTS):
            times += np.bincount(np.concatenate([p for _, p in texts[at : at + CHUNK_TEXTS]]), minlength=len(words))
        order = np.argsort(-times, kind="stable")
        if owners is None:
            number = np.empty(len(words), np.uint32)
            number[order] = np.arange(len(words), dtype=np.uint32)
            for at in range(0, len(texts), CHUNK_TEXTS):
                part = texts[at : at + CHUNK_TEXTS]
                numbers = number[np.concatenate([p for _, p in part])]
                row = {"block": block, "mark": mark, "doc_ids": [i for i, _ in part], "sizes": _pack(np.array([len(p) for _, p in part])), "positions": _pack(numbers)}
                yield pa.RecordBatch.from_pylist([row], schema=_TEXT_SCHEMA)
            return
        raws, rows = [w.encode() for w in words], []
        owner_of = np.fromiter(map(zlib.crc32, raws), np.int64, len(raws))[order] % owners
        by_owner = np.argsort(owner_of, kind="stable")
        for mine in np.split(by_owner, np.flatnonzero(np.diff(owner_of[by_owner])) + 1) if len(words) else []:
            own = [raws[k] for k in order[mine].tolist()]
            rows.append({"block": block, "mark": mark, "owner": int(owner_of[mine[0]]), "numbers": _pack(np.diff(mine, prepend=0)), "lengths": _pack(np.fromiter(map(len, own), np.int64, len(own))), "words": zstandard.compress(b"".join(own), 6)})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_WORD_SCHEMA)

    for batch in slices(batches):
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = split.findall(text or "")
            texts.append((doc_id, np.fromiter([words.setdefault(w, len(words)) for w in found], np.uint32, len(found))))
            size += len(text or "")
            if len(words) >= BLOCK_WORDS or size >= BLOCK_CHARS:
                yield from close()
                words, texts, size, closed = {}, [], 0, closed + 1
    if texts:
        yield from close()


def _owned(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """Encode each word that this task owns once: block, mark, numbers, lengths, words -> block, mark, numbers, counts, ids."""
    encode = _encoding(path, pattern)._core_bpe.encode_single_piece
    known: dict[bytes, bytes] = {}
    for batch in slices(batches, 64):
        counts, ids = [], []
        for lengths, packed in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            raw, at, found = zstandard.decompress(packed), 0, []
            for n in _unpack(lengths).tolist():
                word = raw[at : at + n]
                at += n
                got = known.get(word)
                if got is None:
                    if len(known) >= OWNED_WORDS:
                        known.clear()
                    got = known[word] = array("I", encode(word)).tobytes()
                found.append(got)
            counts.append(_pack(np.fromiter(map(len, found), np.int64, len(found)) // 4))
            ids.append(_pack(np.frombuffer(b"".join(found), np.uint32)))
        yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(counts, pa.binary()), pa.array(ids, pa.binary())], names=["block", "mark", "numbers", "counts", "ids"])


def _reassembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of a part, in any order of their rows: put the ids of the words at their positions."""
    blocks: dict[str, tuple[set[int], list[tuple], list[tuple]]] = {}
    for batch in slices(batches, 64):
        for block, mark, doc_ids, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            marks, texts, words = blocks.setdefault(block, (set(), [], []))
            marks.add(mark)
            if doc_ids is None:
                words.append(tuple(packed[2:]))
            else:
                texts.append((doc_ids, *packed[:2]))
    while blocks:
        _, (marks, texts, words) = blocks.popitem()
        if len(marks) > 1:
            raise RuntimeError("the two scans of the documents differ: write them as a table before encoding")
        numbers = np.concatenate([np.empty(0, np.int64), *(np.cumsum(_unpack(x), dtype=np.int64) for x, _, _ in words)])
        sizes = np.concatenate([np.empty(0, np.int64), *(_unpack(x) for _, x, _ in words)]).astype(np.int64)
        flat = np.concatenate([np.empty(0, np.uint32), *(_unpack(x) for _, _, x in words)])
        start, count = np.empty(len(numbers), np.int64), np.empty(len(numbers), np.int64)
        start[numbers], count[numbers] = np.cumsum(sizes) - sizes, sizes
        for doc_ids, lengths, positions in texts:
            at = _unpack(positions)
            n = count[at]
            ends = np.cumsum(n)
            found = flat[np.repeat(start[at] - ends + n, n) + np.arange(n.sum())].astype("<u4")
            cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(_unpack(lengths), dtype=np.int64)])].tolist()
            whole = [found[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.record_batch([pa.array(doc_ids, pa.string()), pa.array(whole, pa.binary())], names=["doc_id", "ids"])
    tidy()


def _dealt(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Both sides of the blocks for ``_reassembled``, a block's rows all in one part."""
    text = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = text.rdd.getNumPartitions()
    # as many owners as parts of the input, so that what one of them owns stays the same size
    words = text.mapInArrow(partial(_blocked, pattern=pattern, owners=min(4096, max(16, parts))), _WORD_TYPE).repartition("owner").drop("owner")
    words = words.mapInArrow(partial(_owned, path=path, pattern=pattern), "block string, mark bigint, numbers binary, counts binary, ids binary")
    texts = text.mapInArrow(partial(_blocked, pattern=pattern, owners=None), _TEXT_TYPE)
    # not as cogroups: these sort both sides, and each sort takes a page of up to 64 MB in the executor for a few blocks
    return texts.unionByName(words, allowMissingColumns=True).repartition(max(16, 2 * parts), "block")


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``doc_id, ids``; ids are packed as little-endian unsigned 32-bit integers (see ``unpacked``)."""
    whole = _dealt(docs, path, pattern).mapInArrow(_reassembled, "doc_id string, ids binary")
    return whole.select(F.col("doc_id").cast(dict(docs.dtypes)["doc_id"]).alias("doc_id"), "ids")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [np.frombuffer(x.as_py() or b"", "<u4").astype(np.int32) for x in batch.column(1)]
        yield pa.record_batch([batch.column(0), pa.array(lists, pa.list_(pa.int32()))], names=["doc_id", "ids"])


def unpacked(encoded: DataFrame) -> DataFrame:
    """``doc_id, ids`` with ids as array<int>."""
    return encoded.select("doc_id", "ids").mapInArrow(_unpacked, f"doc_id {dict(encoded.dtypes)['doc_id']}, ids array<int>")


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    starts, lengths, raw = _token_table(path)
    for batch in slices(batches, 100):
        packed = [x.as_py() or b"" for x in batch.column(1)]
        ids = np.frombuffer(b"".join(packed), "<u4")
        n = lengths[ids]
        ends = np.cumsum(n)
        whole = raw[np.repeat(starts[ids] - ends + n, n) + np.arange(n.sum())].tobytes()
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed], dtype=np.int64)])].tolist()
        found = [whole[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["doc_id", "ids", "bytes"])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, bytes``: packed ids joined to the bytes of their tokens."""
    return encoded.select("doc_id", "ids").mapInArrow(partial(_decoded, path=path), f"doc_id {dict(encoded.dtypes)['doc_id']}, ids binary, bytes binary")


def _back(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    return _decoded(_reassembled(batches), path)


def there_and_back(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``decode(encode(docs))``, but the worker that reassembles a text's ids decodes them too, so a task needs one worker instead of two."""
    whole = _dealt(docs, path, pattern).mapInArrow(partial(_back, path=path), "doc_id string, ids binary, bytes binary")
    return whole.select(F.col("doc_id").cast(dict(docs.dtypes)["doc_id"]).alias("doc_id"), "ids", "bytes")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents there and back: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    done = there_and_back(table(spark, sf_dir, "documents"), path)
    return done.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))

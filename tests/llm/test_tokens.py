import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from simlake.llm import bpe, token_counts

WORDS, RANKS = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def counter():
    return token_counts.PrefixCounter(WORDS)


def test_every_prefix_of_words_equals_the_library(counter):
    library = Tokenizer.from_file(WORDS)
    rng = random.Random(1)
    for _ in range(300):
        word = "".join(rng.choice("abcdeéthrinß") for _ in range(rng.randint(1, 24)))
        assert list(counter.word(word)) == [len(library.encode(word[:i], add_special_tokens=False).ids) for i in range(1, len(word) + 1)]


def test_counts_and_cuts(counter):
    library = Tokenizer.from_file(WORDS)
    rng = random.Random(2)
    for _ in range(400):
        text = "".join(rng.choice(["the ", "it's", " ", "\n", "É", "Σ", "12", "!?", "x", "<|endoftext|>", "re'LL "]) for _ in range(rng.randint(0, 20)))
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert counter.count(text) == n and counter.prefixes(text)[-1] == n
        for limit in (0, 2, 5):
            total, (cut,) = counter.measure(text, [limit])
            assert total == n and counter.prefixes(text)[cut] <= limit


def test_whole_words_are_counted_without_their_prefixes():
    library, own = Tokenizer.from_file(WORDS), token_counts.PrefixCounter(WORDS)
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeéthrinßжあ") for _ in range(rng.randint(1, 70))) for _ in range(400)]
    for _ in range(2):
        total, (cut,) = own.measure(" ".join(words), [10**6])
        assert total == sum(len(library.encode(w, add_special_tokens=False).ids) for w in words) and cut == len(" ".join(words))
        assert not own.table and set(own.totals) == {w for w in words if len(w) <= token_counts.LONGEST}
    assert all(own.total(w) == own.word(w)[-1] for w in words)


def test_token_counts_of_odd_rows(spark, odd_docs, no_docs):
    library = Tokenizer.from_file(WORDS)
    texts = [r["text"] or "" for r in odd_docs.collect()]
    got = token_counts.token_counts(odd_docs, WORDS).collect()
    assert sorted(r["n_tokens"] for r in got) == sorted(len(library.encode(t, add_special_tokens=False).ids) for t in texts)
    assert sorted(r["n_bytes"] for r in got) == sorted(len(t.encode()) for t in texts)
    assert token_counts.token_counts(no_docs, WORDS).count() == 0
    table = token_counts.prefix_table(odd_docs.where("doc_id = 7"), WORDS).first()["prefix_tokens"]
    assert table[0] == 0 and table[-1] == token_counts.token_counts(odd_docs.where("doc_id = 7"), WORDS).first()["n_tokens"]


@pytest.mark.parametrize("small_blocks", [False, True])
def test_bpe_there_and_back(spark, odd_docs, no_docs, small_blocks):
    if small_blocks:  # the workers import the module anew, so the block is passed by many partitions instead
        odd_docs = odd_docs.repartition(11)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(RANKS), special_tokens={})
    want = sorted((str(r["doc_id"]), hashlib.sha256(np.array(library.encode_ordinary(r["text"] or ""), "<u4").tobytes()).hexdigest()) for r in odd_docs.collect())
    back = bpe.decode(bpe.encode(odd_docs, RANKS), RANKS).collect()
    assert sorted((str(r["doc_id"]), hashlib.sha256(bytes(r["ids"])).hexdigest()) for r in back) == want
    assert sorted(bytes(r["bytes"]).decode() for r in back) == sorted(r["text"] or "" for r in odd_docs.collect())
    assert sorted(map(len, (r["ids"] for r in bpe.unpacked(bpe.encode(odd_docs, RANKS)).collect()))) == sorted(len(bytes(r["ids"])) // 4 for r in back)
    assert bpe.encode(no_docs, RANKS).count() == 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bpe_sorts_nothing(odd_docs):
    """A sort takes a page of up to 64 MB of the executor for each side of a task."""
    assert "Sort" not in _plan(bpe.encode(odd_docs, RANKS)) and "CoGroup" not in _plan(bpe.encode(odd_docs, RANKS))


def test_bpe_takes_one_worker_a_task(odd_docs, no_docs):
    def rows(df):
        return sorted((str(r["doc_id"]), bytes(r["ids"]), bytes(r["bytes"])) for r in df.collect())

    once = bpe.there_and_back(odd_docs, RANKS)
    assert rows(once) == rows(bpe.decode(bpe.encode(odd_docs, RANKS), RANKS))
    assert once.schema["doc_id"].dataType == odd_docs.schema["doc_id"].dataType
    assert bpe.there_and_back(no_docs, RANKS).count() == 0
    assert [part.count("MapInArrow") for part in _plan(bpe.there_and_back(odd_docs, RANKS)).split("Exchange")] == [1, 2, 1]


def test_blocks_of_a_part_come_in_any_order():
    words = {"a": [b"x", b"y"], "b": [b"z"]}

    def text(block, mark=1):
        return {"block": block, "mark": mark, "doc_ids": [block, None], "sizes": bpe._pack(np.array([len(words[block]), 0])), "positions": bpe._pack(np.arange(len(words[block])))}

    def word(block, k, mark=1):  # its ids: k and 7
        return {"block": block, "mark": mark, "numbers": bpe._pack(np.array([k])), "counts": bpe._pack(np.array([2])), "ids": bpe._pack(np.array([k, 7]))}

    def run(rows):
        schema = pa.schema([*bpe._TEXT_SCHEMA, *((n, pa.binary()) for n in ("numbers", "counts", "ids"))])
        out = [r for b in bpe._reassembled(iter([pa.RecordBatch.from_pylist([r], schema=schema) for r in rows])) for r in b.to_pylist()]
        return sorted((str(r["doc_id"]), np.frombuffer(r["ids"], "<u4").tolist()) for r in out)

    want = [("None", []), ("None", []), ("a", [0, 7, 1, 7]), ("b", [0, 7])]
    assert run([word("a", 1), text("b"), text("a"), word("b", 0), word("a", 0)]) == want
    assert run([]) == []
    for odd in (word("a", 0, mark=2), text("a", mark=2)):
        with pytest.raises(RuntimeError, match="scans of the documents differ"):
            run([text("a"), word("a", 1), odd])


def test_packed_numbers():
    for n in ([], [0], [1, 2**32 - 1, 256, 65536]):
        assert bpe._unpack(bpe._pack(np.array(n, np.int64))).tolist() == n

"""Exact token counts at every prefix of a text, for a byte-pair vocabulary with word ends.

For each distinct pre-token a dynamic programme runs over its bytes.  The encoding of
a prefix has one last token; a token that ends at a byte is that last token exactly
if it is compatible with the last token of the prefix before it, that is, if merging
the two side by side leaves them apart.  So ``count[i] = count[i - length] + 1``, and
one pass gives the count at every prefix (as a cut-off word: its last letter carries
the word end).  A text's counts are the running sum over its pre-tokens, so the
questions "how many tokens has this prefix" and "what is the longest prefix within
this budget" are answered from the table without encoding again.  Where only the count
of a whole pre-token is asked for, only its last byte is tested as a word end.

Prefixes are those of the normalised text (NFC, lower case) in code points; white
space has no tokens.  Special strings are one token each, as the library does it, and
are not cut: a prefix that would end within one counts as the prefix before it.

Defined results.  A null text counts as empty: 0 tokens.  Rows are independent, so
repeated rows and ids, null ids and extra columns (which are ignored) are harmless;
an empty table gives an empty table.  Very long words are not kept in the table.
"""

from __future__ import annotations

import json
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache, partial
from itertools import accumulate, pairwise

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from simlake.llm.common import slices, table

#: Pre-tokens that the table of a worker holds, and the longest of them.
TABLE, LONGEST = 500_000, 48


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it prints in Latin-1, else the next of those from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


class _Totals(dict):
    """Token counts of whole pre-tokens, found when they are first asked for; very long ones are not kept."""

    def __init__(self, total: Callable[[str], int]) -> None:
        self.total = total

    def __missing__(self, piece: str) -> int:
        known = self.total(piece)
        if len(piece) <= LONGEST:
            if len(self) >= TABLE:
                self.clear()
            self[piece] = known
        return known


class PrefixCounter:
    """Counts tokens at every prefix with the vocabulary of a ``tokenizers`` file with word ends."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        split, byte_level = spec["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or not model["end_of_word_suffix"] or byte_level["type"] != "ByteLevel":
            raise ValueError(f"{path} has another structure than this counter handles")
        self.end = model["end_of_word_suffix"]
        # code points that the library's own Unicode tables treat in another way than Python's
        self.library = Tokenizer.from_file(path)
        self.newer = regex.compile("[\ua7cb-\ua7dc\U00030000-\U0003ffff]")
        self.pieces = regex.compile(split["pattern"]["Regex"])
        special = "|".join(regex.escape(x["content"]) for x in spec["added_tokens"])
        self.special = regex.compile(f"({special})") if special else None
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.inner = {x for x in model["vocab"] if not x.endswith(self.end)}
        self.final = {x[: -len(self.end)] for x in model["vocab"] if x.endswith(self.end)}
        # what a token begins with, and whether that is an inner token itself
        self.begins = {x[:i]: x[:i] in self.inner for x in self.inner | self.final for i in range(1, len(x) + 1)}
        self.letters = _byte_letters()
        # by the token before and whether a word ends: which tokens stay apart from it
        self.apart: dict[bool, defaultdict[str, dict[str, bool]]] = {final: defaultdict(dict) for final in (False, True)}
        self.known_apart = 0
        self.table: dict[str, bytes | list[int]] = {}
        self.totals = _Totals(self.total)

    def merged(self, symbols: list[str]) -> list[str]:
        """Byte-pair merging as defined: the best-ranked pair first, from the left."""
        rank, none = self.rank.get, len(self.rank)
        while len(symbols) > 1:
            ranks = [rank(pair, none) for pair in pairwise(symbols)]
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            pair, out = (symbols[i], symbols[i + 1]), symbols[:i]
            while i < len(symbols):
                if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == pair:
                    out.append(symbols[i] + symbols[i + 1])
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    def compatible(self, left: str, right: str, final: bool) -> bool:
        """Whether the two tokens stay apart when merged side by side (an empty left: whether right is one token)."""
        known = self.apart[final][left].get(right)
        if known is None:
            symbols = [*left, *right]
            if final:
                symbols[-1] += self.end
            want = [left] * bool(left) + [right + self.end * final]
            if self.known_apart > 2 * TABLE:
                for of_left in self.apart.values():
                    of_left.clear()
                self.known_apart = 0
            known = self.apart[final][left][right] = self.merged(symbols) == want
            self.known_apart += 1
        return known

    def total(self, piece: str) -> int:
        """The token count of a whole pre-token: the programme of ``word``, in which only the last byte may end the word."""
        s = "".join([self.letters[b] for b in piece.encode()])
        n, begins, compatible, apart = len(s), self.begins, self.compatible, self.apart[False]
        count, last = [0] * n, [""] * n
        for start in range(n):
            left = last[start]
            if start and not left:
                continue
            near = apart[left]
            for i in range(start + 1, n):
                token = s[start:i]
                inner = begins.get(token)
                if inner is None:
                    break
                if inner and not last[i]:
                    fits = near.get(token)
                    if compatible(left, token, False) if fits is None else fits:
                        count[i], last[i] = count[start] + 1, token
            else:
                if s[start:] in self.final and compatible(left, s[start:], True):
                    return count[start] + 1
        return 0

    def word(self, piece: str) -> bytes | list[int]:
        """Token counts of the prefixes of 1, 2, ... code points of a pre-token."""
        known = self.table.get(piece)
        if known is not None:
            return known
        s = "".join([self.letters[b] for b in piece.encode()])
        n, final, begins, compatible = len(s), self.final, self.begins, self.compatible
        count, last = [0] * (n + 1), [""] * (n + 1)
        ends = range(1, n + 1) if n == len(piece) else list(accumulate(len(c.encode()) for c in piece))
        stops = dict.fromkeys(ends, 0)
        for start in range(n):
            left, after = last[start], count[start] + 1
            if start and not left:
                continue
            for i in range(start + 1, n + 1):
                token = s[start:i]
                inner = begins.get(token)
                if inner is None:
                    break
                if i < n and inner and not last[i] and compatible(left, token, False):
                    count[i], last[i] = after, token
                if token in final and stops.get(i) == 0 and compatible(left, token, True):
                    stops[i] = after
        out = list(stops.values())
        if len(piece) > LONGEST:
            return out
        if len(self.table) >= TABLE:
            self.table.clear()
        known = self.table[piece] = bytes(out)
        return known

    def normalised(self, part: str) -> str:
        if part.isascii():
            return part.lower()
        if self.newer.search(part):
            return self.library.normalizer.normalize_str(part)
        # lower case letter by letter, so a sigma at a word's end is as any other
        return unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()

    def parts(self, text: str) -> list[tuple[str, bool]]:
        """Normalised stretches and special strings in order."""
        found = self.special.split(text) if self.special else [text]
        return [(x, True) if i % 2 else (self.normalised(x), False) for i, x in enumerate(found)]

    def count(self, text: str) -> int:
        return sum(1 if special else sum(map(self.totals.__getitem__, self.pieces.findall(part))) for part, special in self.parts(text))

    def prefixes(self, text: str) -> list[int]:
        """Token counts of the prefixes of 0, 1, 2, ... code points of the normalised text."""
        out, base = [0], 0
        for part, special in self.parts(text):
            if special:
                out += [base] * (len(part) - 1) + [base + 1]
                base += 1
                continue
            start = len(out) - 1
            for m in self.pieces.finditer(part):
                out += [base] * (start + m.start() + 1 - len(out))
                counts = self.word(m[0])
                out += [base + x for x in counts]
                base += counts[-1]
            out += [base] * (start + len(part) + 1 - len(out))
        return out

    def measure(self, text: str, limits: Sequence[int]) -> tuple[int, list[int]]:
        """The token count, and for each limit the code points of the longest prefix with at most so many tokens."""
        parts, total_of = self.parts(text), self.totals.__getitem__
        counts = [[1] if special else list(map(total_of, self.pieces.findall(part))) for part, special in parts]
        total, length = sum(map(sum, counts)), sum(len(part) for part, _ in parts)
        return total, [length if total <= limit else self._cut(parts, counts, limit) for limit in limits]

    def _cut(self, parts: list[tuple[str, bool]], counts: list[list[int]], limit: int) -> int:
        """Where the longest prefix within the limit ends, if the text has more tokens."""
        base = at = 0
        for (part, special), own in zip(parts, counts, strict=True):
            if base + sum(own) <= limit:
                base, at = base + sum(own), at + len(part)
                continue
            if special:
                return at
            for m, n in zip(self.pieces.finditer(part), own, strict=True):
                if base + n > limit:  # the prefix ends before or within this pre-token
                    inside = [i for i, x in enumerate(self.word(m[0]), 1) if base + x <= limit]
                    return at + m.start() + max(inside, default=0)
                base += n
        raise AssertionError("the text has no more tokens than the limit")


@lru_cache(maxsize=2)
def _counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def _counted(batches: Iterator[pa.RecordBatch], path: str, limits: Sequence[int]) -> Iterator[pa.RecordBatch]:
    counter = _counter(path)
    for batch in slices(batches):
        texts = [x or "" for x in batch.column(1).to_pylist()]
        found = [counter.measure(x, limits) for x in texts]
        counts = [n for n, _ in found]
        fits = [pa.array([f[k] for _, f in found], pa.int64()) for k in range(len(limits))]
        yield pa.record_batch([batch.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(counts, pa.int64()), *fits], names=["doc_id", "n_bytes", "n_tokens", *(f"fit_{x}" for x in limits)])


def _tabled(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    counter = _counter(path)
    for batch in batches:
        for i in range(batch.num_rows):
            one = batch.slice(i, 1)
            yield pa.record_batch([one.column(0), pa.array([counter.prefixes(one.column(1)[0].as_py() or "")], pa.list_(pa.int32()))], names=["doc_id", "prefix_tokens"])


def token_counts(docs: DataFrame, path: str, limits: Sequence[int] = (2048,)) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` and ``fit_<limit>``: the longest prefix within each limit."""
    id_type = dict(docs.dtypes)["doc_id"]
    fields = ", ".join(f"fit_{x} bigint" for x in limits)
    return docs.select("doc_id", "text").mapInArrow(partial(_counted, path=path, limits=tuple(limits)), f"doc_id {id_type}, n_bytes bigint, n_tokens bigint" + (f", {fields}" if fields else ""))


def prefix_table(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, prefix_tokens``: element i + 1 is the number of tokens of the first i code points."""
    return docs.select("doc_id", "text").mapInArrow(partial(_tabled, path=path), f"doc_id {dict(docs.dtypes)['doc_id']}, prefix_tokens array<int>")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents: ``doc_id, n_bytes, n_tokens, over_limit, fit_2048``."""
    counted = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"), "fit_2048")

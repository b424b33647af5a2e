"""Toxicity scores from subword bags averaged into a linear softmax, trained here in numpy.

A word's vector is the mean of the embeddings of its character 3- to 5-grams and of
itself, all hashed into one table, so a spelling never seen shares the vectors of its
pieces.  A run of more than 40 letters, as in a text without spaces, counts as several
words, which overlap so that every n-gram of the run is in one.  A window of ten words
is the mean of its words, and a softmax over two classes scores it, for each window of a
text; table and softmax are trained jointly.  A text is as toxic as its
worst window, so that one insult in a long text is not averaged away: training first
takes whole texts, then, for each text, the window that scores highest at the time,
and other windows of clean texts as well.

Everything is linear up to the softmax, so after training each entry of the table is
reduced to its share of the logit; executors get that one vector.

Sample.  Training takes the labelled rows whose crc32(doc_id) mod 4 is not 2, at most
``SAMPLE`` of each class in the order of a hash of the id, without texts of more than
``SAMPLE_CHARS`` characters.  One task trains on that bounded sample; the driver gets the
reduced table (half a megabyte) and no text.  Label, language, source and id are not
inputs of a score.

Defined results.  A text without words, or null, scores 0.  Long words and long texts are
scored whole.  Without labelled rows all scores are 0.  A null id is scored but not held
out.  Repeated rows get equal scores; if labels repeat an id, the larger label holds.
Null labels are ignored, and so are extra columns; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simlake.llm.common import slices, table, tidy

BUCKETS, DIM, WINDOW, STEP = 1 << 17, 8, 10, 5
#: The training sample: rows of each class, and characters of a text in it.
SAMPLE, SAMPLE_CHARS = 2000, 20_000
#: Characters after which a run goes on as another word, and the longest n-gram.
RUN, GRAM = 40, 5
LEAST_TEXTS, RATE, DECAY = 4, 0.05, 2e-5
THRESHOLD = 0.3
#: Words whose values a worker keeps: about the distinct words of a split, some 50 MB.
KNOWN = 250_000
_WORDS = regex.compile(r"[\p{L}\p{M}\p{N}@$*]+")


def words_of(text: str | None) -> list[str]:
    """Words in order; a run of one word counts once, so that repetition does not add up."""
    runs = _WORDS.findall((text or "").lower())
    if runs and max(map(len, runs)) > RUN:
        runs = [p for run in runs for p in (_pieces(run) if len(run) > RUN else (run,))]
    return [w for w, before in zip(runs, [None, *runs], strict=False) if w != before]


def _pieces(run: str) -> list[str]:
    """A long run in pieces that share their ends, so that no n-gram is cut."""
    return [run[i : i + RUN + GRAM - 1] for i in range(0, len(run) - GRAM + 1, RUN)]


def subwords(word: str) -> set[int]:
    """Buckets of a word and of its character n-grams, with marks at its ends."""
    s = f"<{word}>"
    n, crc, top = len(s), zlib.crc32, BUCKETS - 1
    if s.isascii():
        raw = s.encode()
        return {crc(raw[i : i + k]) & top for k in (3, 4, 5) for i in range(n - k + 1)} | {crc(raw) & top}
    return {crc(s[i : i + k].encode()) & top for k in (3, 4, 5) for i in range(n - k + 1)} | {crc(s.encode()) & top}


@dataclass
class Model:
    """Share of each bucket in the logit, and the bias."""

    share: np.ndarray
    bias: float


class _Bags:
    """Means over bags of rows: forward, and the gradient back to the rows."""

    def __init__(self, bags: list[np.ndarray], least: int = 1) -> None:
        """A bag of fewer than ``least`` rows counts as filled up with zeros."""
        self.count = np.array([len(b) for b in bags], np.int32)
        self.size = np.maximum(self.count, least).astype(np.float32)
        self.at = np.concatenate([[0], np.cumsum(self.count)[:-1]]).astype(np.int64)
        self.rows = np.concatenate(bags).astype(np.int32)

    # one dimension at a time, so that only one number for each row of a bag is in memory

    def mean(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(self.size), x.shape[1]), np.float32, order="F")
        for d in range(x.shape[1]):
            out[:, d] = np.add.reduceat(x[:, d][self.rows], self.at) / self.size
        return out

    def back(self, grad: np.ndarray, n: int) -> np.ndarray:
        out = np.empty((n, grad.shape[1]), np.float32, order="F")
        for d in range(grad.shape[1]):
            out[:, d] = np.bincount(self.rows, np.repeat((grad[:, d] / self.size).astype(np.float32), self.count), n)
        return out


class _Adam:
    def __init__(self, shape: tuple[int, ...], rate: float) -> None:
        self.m, self.v, self.t, self.rate = np.zeros(shape, np.float32, order="F"), np.zeros(shape, np.float32, order="F"), 0, rate

    def step(self, x: np.ndarray, g: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.01 * (g * g - self.v)
        x -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-8)


def train(texts: list[str], labels: list[int], *, rounds: int = 14, seed: int = 7) -> Model:
    """Fit table and softmax jointly; deterministic for a given list."""
    rng = np.random.default_rng(seed)
    number: dict[str, int] = {}
    docs = [np.array([number.setdefault(w, len(number)) for w in words_of(t)], np.int32) for t in texts]
    keep = [i for i, d in enumerate(docs) if len(d)]
    if not keep:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    docs, y = [docs[i] for i in keep], np.array([labels[i] for i in keep])
    subs = [np.array(sorted(subwords(w)), np.int32) for w in number]
    # pieces never seen, or seen in few texts, stay zero and have no say
    seen = np.zeros(BUCKETS)
    for word, n in zip(subs, np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=len(subs)), strict=True):
        seen[word] += n
    open_ = (seen >= LEAST_TEXTS)[:, None]
    table_ = np.zeros((BUCKETS, DIM), np.float32, order="F")
    soft, bias = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    opt = [_Adam(table_.shape, RATE), _Adam(soft.shape, RATE), _Adam(bias.shape, RATE)]

    def steps(bags: list[np.ndarray], target: np.ndarray, n: int) -> None:
        used, rows = np.unique(np.concatenate(bags), return_inverse=True)
        outer, inner = _Bags(np.split(rows, np.cumsum([len(b) for b in bags])[:-1]), WINDOW), _Bags([subs[i] for i in used])
        share = np.where(target == 1, 0.5 / max(1, (target == 1).sum()), 0.5 / max(1, (target == 0).sum()))
        for _ in range(n):
            words = inner.mean(table_)
            x = outer.mean(words)
            z = x @ soft + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            d = (p - np.eye(2)[target]) * share[:, None]
            back = (inner.back(outer.back(d @ soft.T, len(used)), BUCKETS) + DECAY * table_) * open_
            for o, w, g in zip(opt, (table_, soft, bias), (back, x.T @ d, d.sum(axis=0)), strict=True):
                o.step(w, g.astype(np.float32))

    steps(docs, y, 12)
    everything = _Bags(subs)
    for _ in range(rounds):
        value = everything.mean((table_ @ (soft[:, 1] - soft[:, 0]))[:, None])[:, 0]
        bags, target = [], []
        for d, label in zip(docs, y, strict=True):
            total, width = np.concatenate([[0], np.cumsum(value[d])]), min(WINDOW, len(d))
            high = total[width:] - total[:-width]  # of each window
            picks = {int(high.argmax())}
            if not label:
                # the four highest that are not the same words moved a little, and two by chance
                open_at = np.ones(len(high), bool)
                for _ in range(4):
                    if open_at.any():
                        k = int(np.where(open_at, high, -np.inf).argmax())
                        picks.add(k)
                        open_at[max(0, k - STEP + 1) : k + STEP] = False
                picks |= set(rng.integers(0, len(high), 2).tolist())
            for k in sorted(picks):
                bags.append(d[k : k + width])
                target.append(label)
        steps(bags, np.array(target), 8)
    return Model((table_ @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


class Scorer:
    """Scores texts with a reduced model; keeps the values of words it has met."""

    def __init__(self, model: Model) -> None:
        self.bias, self.share, self.known = model.bias, model.share.tolist(), {}

    def word(self, word: str) -> float:
        if len(self.known) >= KNOWN:
            self.known.clear()
        pieces = subwords(word)
        value = self.known[word] = sum(map(self.share.__getitem__, pieces)) / len(pieces)
        return value

    def score(self, text: str | None) -> float:
        words = words_of(text)
        if not words:
            return 0.0
        values = list(map(self.known.get, words))
        if None in values:
            values = [self.word(w) if x is None else x for w, x in zip(words, values, strict=True)]
        total = np.zeros(len(words) + 1)
        np.cumsum(values, out=total[1:])
        if len(words) <= WINDOW:
            worst = total[-1] / WINDOW
        else:
            worst = ((total[WINDOW:] - total[:-WINDOW]) / WINDOW).max()
        return float(1 / (1 + np.exp(-np.clip(worst + self.bias, -500, 500))))


def _scored(batches: Iterator[pa.RecordBatch], model: Model | None) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(model) if model else None
    for batch in slices(batches):
        values = [scorer.score(x) if scorer else 0.0 for x in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], names=[*batch.schema.names, "_score"])


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, chars: int = SAMPLE_CHARS) -> DataFrame:
    """``doc_id, toxic, text, o`` of at most ``size`` rows of each class that are not held out."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("o", F.xxhash64("doc_id"))
    picked = None
    for label in (0, 1):
        one = known.where(F.col("toxic") == label).orderBy("o", "doc_id").limit(size)
        picked = one if picked is None else picked.unionByName(one)
    # at most 2 * size rows, so the broadcast is bounded
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(picked), "doc_id").where(F.length("text") <= chars)
    return rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"), F.first("o").alias("o"))


def _fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = pd.concat([pd.DataFrame({"doc_id": [], "toxic": [], "text": [], "o": []}), *batches]).sort_values(["o", "doc_id"])
    if len(rows):
        model = train(rows["text"].tolist(), rows["toxic"].astype(int).tolist())
        yield pd.DataFrame({"share": [model.share.astype("<f4").tobytes()], "bias": [model.bias]})
    tidy()


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from the labelled rows, trained by one task; None without any."""
    found = sample(docs, labels).coalesce(1).mapInPandas(_fitted, "share binary, bias double").collect()
    return Model(np.frombuffer(found[0]["share"], "<f4"), found[0]["bias"]) if found else None


def scored(docs: DataFrame, model: Model | None, *, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with ``score, held_out, predicted``, which replace columns of these names."""
    types = dict(docs.dtypes)
    rest = [c for c in docs.columns if c not in ("text", "score", "_score", "held_out", "predicted")]
    rows = docs.select(*rest, "text")
    fields = [f"`{c}` {types[c]}" for c in rows.columns]
    out = rows.mapInArrow(partial(_scored, model=model), ", ".join([*fields, "_score double"])).withColumnRenamed("_score", "score")
    return out.withColumns({"held_out": held_out(F.col("doc_id")), "predicted": (F.col("score") >= threshold).cast("int")})


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents: ``doc_id, held_out, score, predicted``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")

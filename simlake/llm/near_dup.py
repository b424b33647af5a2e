"""Near-duplicate texts: SuperMinHash signatures, banding, verification, union-find.

A text's set holds its distinct k-word shingles (words lower-cased in A-Z, split at
ASCII white space).  Texts with equal sets form one class by a hash of the sorted
set; only classes go on, so copies cost one row however many there are.  Each class
gets a SuperMinHash signature (Ertl, 2017): element after element is given a random
rank at each step of its own random permutation of the components, and the work on
a text stops at the step from which no component can fall further.  The signature is
cut into bands; classes that share a band are candidates.

Within a band's bucket the members meet heads instead of each other: first the
smallest member, which connects a group of near copies in one round.  What stays
unconnected meets about 16 heads drawn by a hash and the member that shares most
buckets.  In the last round only members outside their bucket's main component meet its
other members, large buckets in square blocks.  In these two rounds the join itself keeps
only pairs whose bitmaps allow the similarity (a bound, so nothing is lost).  Pairs
are verified on the full sets and links grouped by union-find.  Every candidate pair
is thus verified, excluded by a bound, or known to be in one group; nothing is capped.

With 40 bands of 6 rows a pair at similarity 0.8 fails to meet with probability
(1 - 0.8**6)**40 < 1e-5, one at 0.9 with less than 1e-13.

Defined results.  Null texts, and texts without words, have an empty set and link
with nothing.  Rows that repeat a doc_id are one node, whatever their texts, so that the
groups of both texts are one (``deduplicated`` groups texts, not ids).  A row with a null
doc_id is never linked: its component is null and it is kept.  Ties go to the smallest id.
Very long texts are read whole, their sets in chunks.  An empty table gives an empty
table.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simlake.llm.common import mix64, slices, table
from simlake.operators.graph import connected_components
from simlake.plans.staging import small, staged

BANDS, ROWS = 40, 6
#: Elements and texts that one vectorised step works on.
CHUNK, TEXTS = 8192, 512
#: Classes of a set's bitmap.
BITS = 2048
#: Heads of a bucket in the second round, and members of a side of a block in the last.
HEADS, BLOCK = 16, 4096


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer words make one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(k, len(h))
    acc = mix64(h[: len(h) - width + 1] + np.uint64(width))
    with np.errstate(over="ignore"):
        for i in range(1, width):
            acc = mix64(acc ^ h[i : len(h) - width + 1 + i])
    return np.unique(acc)


def superminhash(elements: np.ndarray, text_of: np.ndarray, texts: int, m: int) -> np.ndarray:
    """Signatures (texts x m) of the texts whose elements are listed; float component = step + random."""
    h = np.full((texts, m), np.inf)
    flat = h.reshape(-1)
    # very long texts come in several chunks, which lower the same signature
    for at in range(0, len(elements), CHUNK):
        x, t = elements[at : at + CHUNK], text_of[at : at + CHUNK].astype(np.int64)
        perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(x), 1))
        active = np.arange(len(x))
        for j in range(m):
            open_ = h.max(axis=1) > j
            active = active[open_[t[active]]]
            if not len(active):
                break
            e = x[active]
            with np.errstate(over="ignore"):
                r = mix64(e + np.uint64(j + 1) * np.uint64(0xD1342543DE82EF95))
            u = (r >> np.uint64(11)) * 2.0**-53
            k = j + (((mix64(r) >> np.uint64(32)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int64)
            chosen = perm[active, k]
            perm[active, k] = perm[active, j]
            np.minimum.at(flat, t[active] * m + chosen, u + j)
    return h


def _band_hashes(h: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit hash for each band, which holds the band's number too."""
    v = np.ascontiguousarray(h).view(np.uint64).reshape(len(h), bands, rows)
    acc = np.broadcast_to(mix64(np.arange(bands, dtype=np.uint64)), (len(h), bands))
    for i in range(rows):
        acc = mix64(acc ^ v[:, :, i])
    return acc.view(np.int64) if acc.flags.c_contiguous else np.ascontiguousarray(acc).view(np.int64)


def _bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the parity of its elements in each of ``BITS`` classes, as 64-bit words.

    Each bit in which two sets differ needs an element that only one of them has.
    """
    out = np.empty((len(sets), BITS // 64), np.int64)
    for i, s in enumerate(sets):
        odd = (np.bincount((s & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)
        out[i] = np.packbits(odd).view(np.int64)
    return out


def _signed(batches: Iterator[pa.RecordBatch], k: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    """doc_id, text, mark -> doc_id, mark, n_shingles, set_key, bands, bits (the last three null for an empty set)."""
    for batch in slices(batches):
        ids, texts = batch.column(0), batch.column(1)
        sets = [shingles(texts[i].as_py(), k) for i in range(batch.num_rows)]
        full = np.flatnonzero([len(s) > 0 for s in sets])
        out = np.empty((len(full), bands), np.int64)
        at = 0
        while at < len(full):
            end, size = at, 0
            while end < len(full) and end - at < TEXTS and (end == at or size + len(sets[full[end]]) <= CHUNK):
                size += len(sets[full[end]])
                end += 1
            group = [sets[i] for i in full[at:end]]
            h = superminhash(np.concatenate(group), np.repeat(np.arange(end - at), [len(s) for s in group]), end - at, bands * rows)
            out[at:end] = _band_hashes(h, bands, rows)
            at = end
        bits = _bitmaps([sets[i] for i in full])
        lists = []
        for values in (out, bits):
            lengths = np.zeros(batch.num_rows + 1, np.int32)
            lengths[full + 1] = values.shape[1]
            mask = np.ones(batch.num_rows, bool)
            mask[full] = False
            lists.append(pa.ListArray.from_arrays(pa.array(np.cumsum(lengths, dtype=np.int32)), pa.array(values.reshape(-1)), mask=pa.array(mask)))
        columns = [ids, batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(map(_key, sets), pa.binary()), *lists]
        yield pa.record_batch(columns, names=["doc_id", "mark", "n_shingles", "set_key", "bands", "bits"])


def _key(items: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(items.tobytes()) if len(items) else None


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sets = [shingles(x.as_py(), k) for x in batch.column(1)]
        yield pa.record_batch([pa.array(map(_key, sets), pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["set_key", "items"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs ``a, b`` whose full sets reach the similarity."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("a", "b")


def _open(members: DataFrame, comps: DataFrame | None) -> DataFrame:
    """The members of buckets with several components: ``bucket, node, n, comp, c, main`` (their number and most frequent component)."""
    if comps is None:
        now = members.withColumn("comp", F.col("node"))
    else:
        now = members.join(comps, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    groups = now.groupBy("bucket", "comp").agg(F.count("*").alias("k"))
    buckets = groups.groupBy("bucket").agg(F.sum("k").alias("c"), F.count("*").alias("comps"), F.max_by("comp", F.struct("k", -F.col("comp"))).alias("main"))
    return now.join(buckets.where("comps > 1").drop("comps"), "bucket").select("bucket", "node", "n", "comp", "c", "main")


def _with_bits(open_: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row for each open node, with its bitmap and its buckets, and with how many rows these hold."""
    per_node = open_.groupBy("node").agg(F.first("n").alias("n"), F.first("comp").alias("comp"), F.sum("c").alias("degree"), F.collect_list(F.struct("bucket", "c", "main")).alias("places"))  # at most one place for each band
    return staged(per_node.join(nodes.select("node", "bits"), "node"), "open")


def _may_link(percent: int) -> Column:
    """Whether sizes and bitmaps of two nodes (``n, bits`` and ``a_n, a_bits``) allow the similarity."""
    apart = reduce(add, (F.bit_count(F.col("bits")[i].bitwiseXOR(F.col("a_bits")[i])) for i in range(BITS // 64)))
    both = F.col("n") + F.col("a_n")
    return (100 * F.least("n", "a_n") >= percent * F.greatest("n", "a_n")) & ((100 + percent) * (both - apart) >= 2 * percent * both)


def _met(left: DataFrame, right: DataFrame, keys: list[str], may: Column) -> DataFrame:
    """Pairs ``a, b`` of nodes of different components that share the keys and may link."""
    other = right.select(*keys, F.col("node").alias("a"), F.col("n").alias("a_n"), F.col("comp").alias("a_comp"), F.col("bits").alias("a_bits"), *([F.col("inside").alias("a_inside")] if "inside" in right.columns else []))
    met = left.join(other, keys).where((F.col("comp") != F.col("a_comp")) & may)
    return met.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()


def _head_pairs(open_: DataFrame, percent: int) -> DataFrame:
    """Open members with about ``HEADS`` of their bucket, by a hash, and with the one that shares most."""
    rows = open_.select("node", "n", "comp", "bits", "degree", F.explode("places").alias("p")).select("*", "p.bucket", "p.c").drop("p")
    central = rows.groupBy("bucket").agg(F.max_by("node", F.struct("degree", -F.col("node"))).alias("central"))
    drawn = F.pmod(F.xxhash64("node"), F.lit(1 << 20)) * F.col("c") < HEADS << 20
    heads = rows.join(central, "bucket").where(drawn | (F.col("node") == F.col("central")))
    return _met(rows, heads, ["bucket"], _may_link(percent))


def _rest_pairs(open_: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Members outside their bucket's main component with all others of the bucket, in blocks of about ``block`` of each."""
    rows = open_.select("node", "n", "comp", "bits", F.explode("places").alias("p")).select("*", "p.bucket", "p.c", (F.col("comp") == F.col("p.main")).alias("inside")).drop("p")
    blocks = F.ceil(F.col("c") / block)
    own, every = F.pmod(F.xxhash64("node"), blocks).cast("long"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    left = rows.where("not inside").withColumn("i", own).withColumn("j", every)
    right = rows.withColumn("j", own).withColumn("i", every)
    # two members outside meet once
    return _met(left, right, ["bucket", "i", "j"], (F.col("a_inside") | (F.col("a") < F.col("node"))) & _may_link(percent))


def link_components(members: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """``node, component`` from the staged buckets ``bucket, node, n, first``: every candidate pair decided; None without links."""
    near = 100 * F.least("n", "first_n") >= percent * F.greatest("n", "first_n")
    pairs = members.where((F.col("node") != F.col("first")) & near).select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    links, comps = None, None
    for number in range(3):
        if number:
            open_ = _with_bits(_open(members.select("bucket", "node", "n"), comps), nodes)
            if open_.isEmpty():
                break
            pairs = (_head_pairs if number == 1 else _rest_pairs)(open_, percent)
        new = staged(_verified(staged(pairs, "pairs"), sets, percent), "links")
        if not new.isEmpty():
            links = new if links is None else links.unionByName(new)
            comps = staged(connected_components(links), "components")
    return comps


def _grouped(docs: DataFrame, k: int, percent: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The rows ``doc_id, mark, n_shingles, set_key``, the nodes (one for each set, with its smallest id) and their components."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = text.withColumn("mark", F.xxhash64("text"))
    signed = staged(marked.mapInArrow(partial(_signed, k=k, bands=bands, rows=rows), "doc_id bigint, mark bigint, n_shingles bigint, set_key binary, bands array<bigint>, bits array<bigint>"), "signed")
    known = signed.where("doc_id is not null and set_key is not null")
    classes = known.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("n_shingles", "bands", "bits"), "doc_id").alias("s"))
    # numbers are written down with the table, so that they hold from here on
    nodes = staged(classes.select(F.monotonically_increasing_id().alias("node"), "set_key", "rep", F.col("s.n_shingles").alias("n"), "s.bands", "s.bits"), "nodes")
    banded = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("c"), F.min(F.struct("node", "n")).alias("first")).where("c > 1")
    members = staged(banded.join(shared, "bucket").select("bucket", "node", "n", F.col("first.node").alias("first"), F.col("first.n").alias("first_n")), "members")
    wanted = staged(members.select("node").distinct().join(nodes.select("node", "set_key", "rep"), "node"), "wanted")
    again = text.join(small(wanted.select(F.col("rep").alias("doc_id")).distinct()), "doc_id", "left_semi")
    items = again.mapInArrow(partial(_sets, k=k), "set_key binary, items array<bigint>").dropDuplicates(["set_key"])
    sets = staged(items.join(wanted.select("node", "set_key"), "set_key").select("node", "items"), "sets")
    out = signed.select("doc_id", "mark", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key"))
    return out, nodes, link_components(members, nodes, sets, percent)


def _with_least(rows: DataFrame, nodes: DataFrame, comps: DataFrame | None) -> DataFrame:
    """The rows with their node, the smallest id of its component, ``least``, and the node that has it."""
    per_node = nodes.select("set_key", "node", "rep")
    per_node = per_node.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node")) if comps is not None else per_node.withColumn("component", F.col("node"))
    least = per_node.groupBy("component").agg(F.min("rep").alias("least"), F.min_by("node", F.struct("rep", "node")).alias("least_node"))
    return rows.join(per_node.join(least, "component").select("set_key", "node", "least", "least_node"), "set_key", "left")


def near_duplicates(docs: DataFrame, *, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: one row for each row of ``docs`` (doc_id, text)."""
    out, nodes, comps = _grouped(docs, k, percent, bands, rows)
    # texts of one id are one node: each leads to the first of them
    same = out.where("set_key is not null").groupBy("doc_id").agg(F.min("set_key").alias("first"), F.max("set_key").alias("last")).where("first != last").select("doc_id", "first")
    same = staged(out.join(same, "doc_id").where("set_key != first").select("set_key", "first").distinct(), "same")
    several = not same.isEmpty()
    if several:
        ends = same.join(nodes.select("set_key", F.col("node").alias("a")), "set_key").join(nodes.select(F.col("set_key").alias("first"), F.col("node").alias("b")), "first").select("a", "b")
        old = comps.select(F.col("node").alias("a"), F.col("component").alias("b")) if comps is not None else ends.limit(0)
        comps = staged(connected_components(ends.unionByName(old)), "components")
    repeats = _repeats(out)
    out = _with_least(out, nodes, comps)
    if repeats:
        ids = out.where("least is not null").groupBy("doc_id").agg(F.min("least").alias("of_id"))
        out = out.join(ids, "doc_id", "left").withColumn("least", F.coalesce("least", "of_id")).drop("of_id")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _repeats(rows: DataFrame) -> bool:
    """Whether an id has a row with an empty set and one with a text, whose group is that of both."""
    empty = rows.where("doc_id is not null and set_key is null").select("doc_id").distinct()
    return not rows.where("set_key is not null").join(empty, "doc_id", "left_semi").isEmpty()


def deduplicated(docs: DataFrame, *, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: one row of each group of texts, that of the smallest id.

    Groups are of texts: an id that occurs with unlike texts does not join them.  Rows
    with an empty set or a null id all stay.
    """
    out, nodes, comps = _grouped(docs, k, percent, BANDS, ROWS)
    out = _with_least(out.where("set_key is not null"), nodes, comps)
    # of the rows with the group's smallest id and its set, those with the smallest mark
    best = out.groupBy("least_node").agg(F.min(F.when((F.col("node") == F.col("least_node")) & (F.col("doc_id") == F.col("least")), F.col("mark"))).alias("best"))
    right = (F.col("node") == F.col("least_node")) & (F.col("doc_id") == F.col("least")) & (F.col("mark") == F.col("best"))
    decided = out.join(best, "least_node").select("doc_id", "mark", right.alias("kept"))
    gone = staged(decided.where("not kept").select(F.col("doc_id").alias("_gone_id"), F.col("mark").alias("_gone_mark")).distinct(), "gone")
    again = staged(decided.where("kept").groupBy("doc_id", "mark").count().where("count > 1").select(F.col("doc_id").alias("_gone_id"), F.col("mark").alias("_gone_mark")), "again")
    mine = lambda: (F.col("doc_id").cast("long") == F.col("_gone_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_gone_mark"))
    kept = docs.join(small(gone), mine(), "left_anti")
    if again.isEmpty():
        return kept
    # rows that repeat id and text: one of each; only these are shuffled with their text
    copies = kept.join(small(again), mine(), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(small(again), mine(), "left_anti").unionByName(copies)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word shingles of all documents, similarity 0.8: ``doc_id, n_shingles, component_id, kept``."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=2)


ORACLE = {
    "op8_near_dedup": r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, case when len(w) < 2 then w else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as s from w),
x as (select doc_id, len(s) as n, unnest(s) as shingle from s),
k as (select a.doc_id as a, b.doc_id as b from x a join x b on a.shingle = b.shingle and a.doc_id < b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
sym as (select a as x, b as y from k union all select b, a from k),
reach(x, c) as (select doc_id, doc_id from documents union select sym.y, reach.c from reach join sym on sym.x = reach.x),
comp as (select x, min(c) as c from reach group by x)
select s.doc_id, len(s.s) as n_shingles, c as component_id, s.doc_id = c as kept from s join comp on comp.x = s.doc_id
"""
}

"""Mixing sources to target weights by Pareto order sampling.

Targets.  Sources in code-point order, null last, carry the given weights in
turn; together they share all words.  No target exceeds ``max_copies`` times its
source's words; the excess is reshared by weight.  That water level has a closed
form over the source table, so nothing is iterated.

Sample.  A document's expected copies are target / source words (times its
importance, if a column for that is given).  The whole part is allocated for
certain; the fraction is its inclusion probability ``p``.  Documents are ranked
by ``(u / (1 - u)) / (p / (1 - p))`` (Rosen, 1997), with ``u`` a hash of the
document's id, and each in turn is taken if its words fit into what the source still
lacks; the sample's size is thereby fixed in words.

Scale.  Only (source, id, words) are staged.  What is taken of a source is a list of
ranges of its order with a bound on the words of a document: a range ends at a document
within the bound that no longer fits, and the next begins there with what is then
lacking.  The end of a range is found by histograms, which are summed before any
shuffle, so a source may hold any share of the rows: no source is ever sorted as a whole,
and one task walks over ``RANK_ROWS`` rows at most.  The decision is a comparison with one
row for each source, so texts are never shuffled.

Defined results.  A null text has 0 words and is taken ``whole part`` times.  Rows
that repeat id and size within a source are one lot: taken together or not at all.
A null source is a source of its own.  A null id ranks like the id "".  An empty
table gives an empty table.  Extra columns are kept (``mix``) and may have any name
but that of the added columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from simlake.llm.common import table, word_count
from simlake.plans.staging import small, staged

#: Bins of one refinement of a source's order, and rows that one task may rank.
BINS, RANK_ROWS = 64, 10_000
WEIGHTS = (5, 2, 1)


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_copies: int = 3) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``: one row a source."""
    # these windows order the source table, one short row for each source
    order = W.partitionBy().orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    s = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("long"))
    s = s.withColumn("cap", F.col("source_size") * max_copies)
    full = W.partitionBy()
    level = W.partitionBy().orderBy(F.col("cap") / F.col("w")).rangeBetween(W.unboundedPreceding, W.currentRow)
    s = s.withColumns({"total": F.sum("source_size").over(full), "all_w": F.sum("w").over(full), "caps": F.sum("cap").over(level), "cap_w": F.sum("w").over(level)})
    # a source is capped if the level of all that reach their cap no later stays below the common one
    d = lambda c: F.col(c).cast("decimal(38,0)")
    s = s.withColumn("capped", d("caps") * d("w") + d("cap") * (d("all_w") - d("cap_w")) < d("total") * d("w"))
    s = s.withColumns({"taken_caps": F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(full), "taken_w": F.sum(F.when(F.col("capped"), F.col("w")).otherwise(0)).over(full)})
    open_ = (F.col("w") * (F.col("total") - F.col("taken_caps"))).cast("double") / (F.col("all_w") - F.col("taken_w"))
    return s.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(open_).alias("target"))


def _uniform(doc_id: Column, seed: str) -> Column:
    """A number in (0, 1) from the id: 52 bits of an MD5."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":" + seed))
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def _ranked(rows: DataFrame, importance: str | None, max_copies: int) -> DataFrame:
    """Add ``whole`` (certain copies) and ``x``, the Pareto rank scaled to (0, 1); null x: never sampled."""
    e = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    if importance:
        e = e * F.greatest(F.coalesce(F.col(importance).cast("double"), F.lit(0.0)), F.lit(0.0)) / F.col("mean_importance")
    rows = rows.withColumn("_e", F.least(e, F.lit(float(max_copies))))
    rows = rows.withColumns({"whole": F.floor("_e").cast("long"), "_p": F.col("_e") - F.floor("_e")})
    q = (F.col("_u") / (1 - F.col("_u"))) / (F.col("_p") / (1 - F.col("_p")))
    return rows.withColumn("x", F.when((F.col("_p") > 0) & (F.col("_size") > 0), q / (1 + q))).drop("_e", "_p")


_TUPLE = ("x", "_id", "_size")
_POINT = "struct<x: double, _id: string, _size: bigint>"
_RANGES = f"array<struct<start: {_POINT}, last: {_POINT}, most: double>>"


def decisions(docs: DataFrame, size: Column, *, weights: Sequence[int] = WEIGHTS, max_copies: int = 3, seed: str = "mix", importance: str | None = None, name: str = "mix") -> tuple[DataFrame, DataFrame]:
    """The staged narrow rows and the table of one row for each source that decides every document."""
    cols = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), "doc_id", "source", size.alias("_size"), _uniform(F.col("doc_id"), seed).alias("_u")]
    narrow = staged(docs.select(*cols, *([importance] if importance else [])), name)
    extra = [(F.sum(F.col("_size") * F.coalesce(F.col(importance).cast("double"), F.lit(0.0))) / F.sum("_size")).alias("mean_importance")] if importance else []
    sums = narrow.groupBy("source").agg(F.sum("_size").alias("source_size"), *extra)
    sources = source_targets(sums.select("source", "source_size"), weights, max_copies)
    if importance:
        sources = sources.join(sums.select(F.col("source").alias("s2"), "mean_importance"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    sources = staged(sources, name)
    ranked = _ranked(_with_source(narrow, sources), importance, max_copies)
    rest = ranked.groupBy("source").agg((F.first("target") - F.sum(F.col("whole") * F.col("_size"))).alias("gap"))
    state = staged(rest.withColumn("start", F.lit(None).cast(_POINT)), name)
    found = []
    while True:
        rows = _with_source(ranked.where("x is not null").select("source", *_TUPLE), state).where(F.coalesce(F.struct(*_TUPLE) > F.col("start"), F.lit(True)) & (F.col("_size") <= F.col("gap")))
        rest = rows.groupBy("source").agg(F.first("gap").alias("gap"), F.first("start").alias("start"), F.count("*").alias("n"))
        # the interval of x that holds the end of the range, what lies before it, and how many rows it has
        cut = staged(rest.select("source", "gap", "start", (F.col("n") <= RANK_ROWS).alias("whole_rest"), F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"), F.lit(0).cast("long").alias("before"), "n", F.lit(1.0).alias("width")), name)
        if cut.isEmpty():
            break
        while not cut.where((F.col("n") > RANK_ROWS) & (F.col("width") > 1e-13)).isEmpty():
            cut = staged(_narrowed(rows.select("source", *_TUPLE), cut), name)
        inside = _with_source(rows.select("source", *_TUPLE), cut).where("x >= lo and x < hi")
        lots = inside.groupBy("source", *_TUPLE).agg(F.count("*").alias("k"), *(F.first(c).alias(c) for c in ("gap", "start", "before", "whole_rest")))
        types = dict(lots.dtypes)
        out = f"source {types['source']}, ranges {_RANGES}, gap double, start {_POINT}"
        ends = staged(lots.groupBy("source").applyInPandas(_filled, out), name)
        found.append(ends.select("source", F.explode("ranges").alias("range")))
        state = staged(ends.where("start is not null").select("source", "gap", "start"), name)
        if state.isEmpty():
            break
    if not found:
        return narrow, staged(sources.withColumn("ranges", F.array().cast(_RANGES)), name)
    ranges = reduce(DataFrame.unionByName, found).groupBy(F.col("source").alias("s2")).agg(F.collect_list("range").alias("ranges"))
    return narrow, staged(sources.join(ranges, F.col("source").eqNullSafe(F.col("s2")), "left").drop("s2"), name)


def _filled(lots: pd.DataFrame) -> pd.DataFrame:
    """The ranges taken of one source's rows; where rows follow that are not here, only up to the first lot that does not fit."""
    lots = lots.sort_values(list(_TUPLE), kind="stable")
    head, point = lots.iloc[0], lambda r: None if r is None else {"x": r[0], "_id": r[1], "_size": r[2]}
    most, start = head["gap"], head["start"]
    start = tuple(start) if start is not None and not isinstance(start, dict) else tuple(start.values()) if start else None
    gap, last, ranges, stopped = most - head["before"], None, [], None
    # what lies before these rows is taken
    begun = head["before"] > 0
    for x, i, size, k in lots[[*_TUPLE, "k"]].itertuples(index=False, name=None):
        if k * size <= gap:
            gap, last, begun = gap - k * size, (x, i, size), True
        elif size <= most:
            if begun:
                ranges.append({"start": point(start), "last": point(last or (x, "", -1)), "most": most})
            start, last, begun, most = (x, i, size), None, False, gap
            if not head["whole_rest"]:
                stopped = start
                break
    if begun:
        end = tuple(lots[list(_TUPLE)].iloc[-1]) if last is None else last
        ranges.append({"start": point(start), "last": point(end), "most": most})
    return pd.DataFrame({"source": [head["source"]], "ranges": [ranges], "gap": [gap], "start": [point(stopped)]})


def _with_source(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """Add the columns of a staged source table; broadcast it only when it is short."""
    right = small(per_source.withColumnRenamed("source", "_s"))
    return rows.join(right, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")


def _narrowed(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """Refine each source's interval to the bin that holds the end of the range."""
    rows = _with_source(rows, cut).where("x >= lo and x < hi")
    bin_ = F.least(F.floor((F.col("x") - F.col("lo")) / F.col("width") * BINS), F.lit(BINS - 1))
    keep = ("gap", "start", "whole_rest", "lo", "hi", "before", "n", "width")
    hist = rows.withColumn("bin", bin_).groupBy("source", "bin").agg(F.sum("_size").alias("words"), F.count("*").alias("k"), *(F.first(c).alias(c) for c in keep))
    by = W.partitionBy("source")
    hist = hist.withColumn("cum", F.sum("words").over(by.orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)) + F.col("before"))
    hist = hist.withColumn("at", F.coalesce(F.min(F.when(F.col("cum") > F.col("gap"), F.col("bin"))).over(by), F.max("bin").over(by)))
    open_ = F.first("n") > RANK_ROWS
    lo = F.first("lo") + F.first("width") * F.first("at") / BINS
    new = hist.groupBy("source").agg(
        *(F.first(c).alias(c) for c in ("gap", "start", "whole_rest")),
        F.when(open_, lo).otherwise(F.first("lo")).alias("lo"),
        F.when(open_ & (F.first("at") < BINS - 1), lo + F.first("width") / BINS).otherwise(F.first("hi")).alias("hi"),
        F.when(open_, F.first("before") + F.coalesce(F.sum(F.when(F.col("bin") < F.col("at"), F.col("words"))), F.lit(0))).otherwise(F.first("before")).alias("before"),
        F.when(open_, F.sum(F.when(F.col("bin") == F.col("at"), F.col("k")))).otherwise(F.first("n")).alias("n"),
    )
    return new.withColumn("width", F.col("hi") - F.col("lo")).select(cut.columns)


def _taken() -> Column:
    me, size = F.struct(*_TUPLE), F.col("_size")
    within = F.exists("ranges", lambda r: F.coalesce(me > r["start"], F.lit(True)) & (me <= r["last"]) & (size <= r["most"]))
    return F.col("whole") + F.coalesce(F.col("x").isNotNull() & within, F.lit(False)).cast("long")


def mix_counts(docs: DataFrame, *, weights: Sequence[int] = WEIGHTS, max_copies: int = 3, seed: str = "mix", importance: str | None = None) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken``: one row for each row of ``docs``."""
    narrow, plan = decisions(docs, word_count("text"), weights=weights, max_copies=max_copies, seed=seed, importance=importance)
    rows = _ranked(_with_source(narrow, plan), importance, max_copies).withColumn("copies", _taken())
    return rows.select("doc_id", "source", F.col("_size").alias("size"), "source_size", "target", "copies", (F.col("copies") * F.col("_size")).alias("taken"))


def mix(docs: DataFrame, *, weights: Sequence[int] = WEIGHTS, max_copies: int = 3, seed: str = "mix", importance: str | None = None) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as many times as the mix takes it."""
    _, plan = decisions(docs, word_count("text"), weights=weights, max_copies=max_copies, seed=seed, importance=importance)
    plan = plan.select(F.col("source").alias("_src"), *(F.col(c).alias("_p_" + c) for c in plan.columns if c != "source"))
    own = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), word_count("text").alias("_size"), _uniform(F.col("doc_id"), seed).alias("_u")]
    # the whole row goes along as one value, so its columns may have any name
    rows = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("_row"), *own, "source", *([importance] if importance else []))
    rows = rows.join(small(plan), F.col("source").eqNullSafe(F.col("_src")), "left").drop("_src")
    rows = rows.select("_row", "_id", "_size", "_u", *([importance] if importance else []), *(F.col(c).alias(c[3:]) for c in rows.columns if c.startswith("_p_")))
    rows = _ranked(rows, importance, max_copies).withColumn("copies", _taken()).where("copies > 0")
    return rows.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy")).select("_row.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the mix of all documents: ``doc_id, size, source_size, target, taken`` (and ``copies``)."""
    return mix_counts(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


ORACLE = {
    "op1_mixing": r"""
with recursive d as (
  select doc_id, source, coalesce(cast(doc_id as varchar), '') as i,
    cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
    (cast(cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ':mix'), 1, 13) as bigint) as double) + 0.5) / 4503599627370496.0 as u
  from documents),
s0 as (select source, cast(sum(size) as bigint) as source_size from d group by source),
s1 as (select *, [5, 2, 1][1 + (row_number() over (order by source nulls last) - 1) % 3] as w, 3 * source_size as cap from s0),
s2 as (select *, sum(source_size) over () as total, sum(w) over () as all_w,
    sum(cap) over (order by cap / w range unbounded preceding) as caps, sum(w) over (order by cap / w range unbounded preceding) as cap_w from s1),
s3 as (select *, cast(caps as hugeint) * w + cast(cap as hugeint) * (all_w - cap_w) < cast(total as hugeint) * w as capped from s2),
s4 as (select *, coalesce(sum(cap) filter (capped) over (), 0) as tc, coalesce(sum(w) filter (capped) over (), 0) as tw from s3),
s as (select source, source_size, case when capped then cast(cap as double)
    else cast(cast(w as bigint) * cast(total - tc as bigint) as double) / cast(all_w - tw as double) end as target from s4),
r as (select d.*, s.source_size, s.target, least(case when s.source_size > 0 then s.target / s.source_size else 0.0 end, 3.0) as e
  from d join s on d.source is not distinct from s.source),
q as (select *, cast(floor(e) as bigint) as whole, e - floor(e) as p from r),
x as (select *, case when p > 0 and size > 0 then (u / (1 - u)) / (p / (1 - p)) end as z from q),
rest as (select source, any_value(target) - sum(whole * size) as rest from x group by source),
lots as (select sid, z / (1 + z) as x, i, size, sum(size) as words, row_number() over (partition by sid order by z / (1 + z), i, size) as rn
  from (select *, coalesce('s' || source, 'null') as sid from x) where z is not null group by sid, z, i, size),
runs(sid, pos, gap, after, last, most) as (
  select coalesce('s' || source, 'null'), 0::bigint, rest, null::bigint, null::bigint, null::double from rest
  union all
  select sid, min(rn) filter (cum > gap), any_value(gap) - coalesce(max(cum) filter (cum <= gap), 0), any_value(pos), max(rn) filter (cum <= gap), any_value(gap)
  from (select r.sid, r.pos, r.gap, l.rn, sum(l.words) over (partition by r.sid order by l.rn rows unbounded preceding) as cum
    from runs r join lots l on l.sid = r.sid and l.rn > r.pos and l.size <= r.gap) group by sid),
picked as (select distinct l.sid, l.i, l.size from lots l join runs r on l.sid = r.sid and l.rn > r.after and l.rn <= r.last and l.size <= r.most),
t as (select x.doc_id, x.size, x.source_size, x.target, x.whole + cast(p.i is not null as bigint) as copies
  from x left join picked p on p.sid = coalesce('s' || x.source, 'null') and p.i = x.i and p.size = x.size and x.z is not null)
select doc_id, size, source_size, target, cast(copies * size as bigint) as taken, copies from t
""",
}

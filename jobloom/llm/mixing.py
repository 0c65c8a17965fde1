"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Each source has a weight; all together shall give a share of all words.  A source gives at most
REPEATS times its words, and what it cannot give is dealt to the others by weight (``targets``).
Every row has a place between 0 and 2^60, a hash of its id and text.  A source that must give
less than it holds takes the rows whose place is at most its threshold; one that must give more
takes every row once and the rows up to its threshold once more.  A smaller budget's rows are
therefore among a larger one's.  The threshold is found without sorting: words are summed by
source and bucket of the place (4096 buckets), the bucket in which the budget ends is split into
4096 again, and so on until it holds one place; each step reads the rows of that bucket alone.
The rows at that place are taken if this brings the source nearer to its budget.

Defined cases: a null text has size 0; a null source is a source of its own, the last one; a null
doc_id hashes like an empty one; repeated rows (one id and text) share a place, so all of them are
taken or none; rows of size 0 take 0 words; with no words at all every target is 0; an empty table
gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.sequence import with_sequence
from .common import checked_broadcast, saved

WEIGHTS = (3, 1, 2)          # of the sources by code point, null last, repeating
SHARE = (3, 2)               # the mix is to hold 3 / 2 of all words
REPEATS = 2                  # a source, and so each of its rows, is taken twice at most
BITS, STEP = 60, 12          # places, and what one level of the histogram tells of them


def words(text: Column) -> Column:
    """The number of words ``[^\\x20\\x09-\\x0D]+`` of a text (null: 0)."""
    letters = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.translate(letters, " \t\n\x0b\x0c\r", "")).cast("long")


def place(key: Column, text: Column) -> Column:
    """The first 60 bits of the MD5 of id and text."""
    whole = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole), 1, BITS // 4), 16, 10).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, place) of every row, written once: the texts are read no more."""
    return saved(docs.select("doc_id", "source", words(F.col("text")).alias("size"),
                             place(F.col("doc_id"), F.col("text")).alias("place")), "mix-sizes")


def _exact(x) -> Column:
    return F.lit(str(x)).cast("decimal(38,0)")


def targets(rows: DataFrame, weights: tuple = WEIGHTS, share: tuple = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, target) of every source.  One round of dealing gives each source its
    weight's part of what is left after the full sources; sources that this fills over ``repeats``
    times their size become full; the rounds end when none does.  One row of sums a round reaches
    the driver; the comparisons are whole numbers."""
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = with_sequence(per, [F.col("source").asc_nulls_last()], "_n", start=0)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_n") % len(weights) + 1).cast("int"))
    per = saved(per.select("source", "source_size", weight.cast("long").alias("weight")), "mix-sources")
    total, left = map(int, per.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first())
    up, down = share
    full_size, full_weight = 0, 0
    while True:
        # a source of weight w gets over * w / under
        over, under = up * total - down * repeats * full_size, max(1, down * (left - full_weight))
        full = _exact(repeats * under) * F.col("source_size") < _exact(over) * F.col("weight")
        now = per.where(full).agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if (int(now[0]), int(now[1])) == (full_size, full_weight):
            break
        full_size, full_weight = int(now[0]), int(now[1])
    dealt = (_exact(over) * F.col("weight")).cast("double") / F.lit(float(under))
    return per.select("source", "source_size", F.when(full, (F.col("source_size") * repeats).cast("double")).otherwise(dealt).alias("target"))


def thresholds(rows: DataFrame, per: DataFrame) -> DataFrame:
    """``per`` with ``rounds`` (how often every row is taken) and ``limit`` (the place up to which a row
    is taken once more; null: none is left to take)."""
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    per = saved(per.withColumn("rounds", rounds).withColumn("budget", F.col("target") - F.col("rounds") * F.col("source_size")), "mix-budgets")
    open_, found = rows.where("size > 0").select("source", "place", "size"), None
    for shift in range(BITS - STEP, -1, -STEP):
        open_ = open_.withColumn("bucket", F.shiftright("place", shift))
        sums = open_.groupBy("source", "bucket").agg(F.sum("size").alias("held"), F.min("place").alias("least"), F.max("place").alias("most"))
        # at most 4096 rows a source, whatever it holds
        upto = F.expr("sum(held) over (partition by source order by bucket)")
        state = per.select("source", "budget", F.lit(0).cast("long").alias("before")) if found is None else found.select("source", "budget", "before")
        on = sums["source"].eqNullSafe(state["source"])
        ends = (sums.withColumn("upto", upto).join(checked_broadcast(state), on).drop(state["source"])
                .where("before + upto > budget").groupBy("source").agg(F.min_by(F.struct("bucket", (F.col("before") + F.col("upto") - F.col("held")).alias("before"),
                                                                                         "held", "least", "most", "budget"), "bucket").alias("end")))
        found = saved(ends.select("source", "end.*"), "mix-ends")
        if found.where("least < most").limit(1).count() == 0:
            break
        ends = checked_broadcast(found.select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket")))
        open_ = saved(open_.join(ends, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")), "left_semi")
                      .select("source", "place", "size"), "mix-boundary")
    # the boundary is one place now: its rows are taken if that is no further from the budget
    limit = F.when(2 * (F.col("budget") - F.col("before")) >= F.col("held"), F.col("most")).otherwise(F.col("least") - 1)
    found = found.select(F.col("source").alias("_source"), limit.alias("limit"))
    return per.join(found, F.col("source").eqNullSafe(F.col("_source")), "left").select("source", "source_size", "target", "rounds", "limit")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: tuple = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row: ``target`` is its source's, ``taken``
    the words the mix takes of it, repeats counted."""
    rows = sizes(docs)
    per = checked_broadcast(saved(thresholds(rows, targets(rows, weights, share, repeats)).withColumnRenamed("source", "_source"), "mix-thresholds"))
    times = F.col("rounds") + F.when(F.col("place") <= F.col("limit"), 1).otherwise(0)
    return rows.join(per, F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"))


def oracle() -> str:
    """The same question in DuckDB SQL over the table documents: places in order instead of a histogram."""
    return r"""
with d as (select doc_id, source, row_number() over () as rn,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')), 1, 15))::bigint as place from documents),
s as (select source, sum(size)::hugeint as source_size, row_number() over (order by source nulls last) as n from d group by source),
w as (select source, source_size, case (n - 1) % 3 when 0 then 3 when 1 then 1 else 2 end::hugeint as weight from s),
r as (select *, sum(source_size) over () as total,
    source_size * 6 / weight as ratio from w),
c as (select *, coalesce(sum(source_size) over (order by ratio range between unbounded preceding and current row exclude group), 0) as below,
    sum(weight) over (order by ratio range between current row and unbounded following) as above from r),
f as (select *, 4 * below * weight + 4 * source_size * above < 3 * total * weight as is_full from c),
g as (select *, 3 * total - 4 * sum(case when is_full then source_size else 0 end) over () as over_,
    2 * sum(case when is_full then 0 else weight end) over () as under from f),
t as (select source, source_size::bigint as source_size,
    case when is_full then (2 * source_size)::double else (over_ * weight)::double / under::double end as target from g),
b as (select *, case when source_size > 0 then floor(target / source_size) else 0 end as rounds from t),
p as (select source, place, sum(size) as held from d where size > 0 group by source, place),
q as (select source, place, held, sum(held) over (partition by source order by place) as upto from p),
e as (select b.source, min_by(case when 2 * (target - rounds * source_size - (upto - held)) >= held then place else place - 1 end, place) as lim
    from q join b on q.source is not distinct from b.source where upto > target - rounds * source_size group by b.source)
select d.doc_id, d.size::bigint as size, b.source_size, b.target,
    (d.size * (b.rounds + case when d.place <= e.lim then 1 else 0 end))::bigint as taken
from d join b on d.source is not distinct from b.source left join e on d.source is not distinct from e.source"""

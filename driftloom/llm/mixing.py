"""Mixing sources to target weights: capped water-filling and seeded repetitions.

Targets: every source gets its share of the total by weight, but at most ``max_epochs`` times its
own size; what is cut off is dealt to the other sources by weight until none is above its cap.
The fixed point has a closed form: with the sources in order of cap / weight, source i is clamped
while cap_i / weight_i is at most (total - caps before i) / (weights from i on). Only one row for
each source takes part in that.

Repetitions: a source with target / size = w + f gives each document w times, and a seeded
selection of its documents once more: in the order of a keyed hash, those whose middle word falls
within the first f * size words. So the words taken miss the target by at most about half a
document. The selection never sorts a source in one task: sizes are summed by source and hash
bucket, then by finer buckets inside the one bucket in which the selection ends, and only the
documents of that finer bucket are put in order.

Built-in DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.llm.common import discard, materialise

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = 42
#: Each of the two levels of hash buckets: 2**10 buckets.
BUCKET_BITS = 10
HASH_BITS = 60


def word_count(text: Column | str) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in the text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row for each source. The sources
    are put in order in one task: it grows with their number, not with the documents.

    Weights go round over the sources in code point order, null last. Sources without words get
    the target 0.
    """
    everything = Window.partitionBy()
    ranked = sizes.select("source", "source_size", F.row_number().over(
        Window.orderBy(F.col("source").asc_nulls_last())).alias("rank"))
    ranked = ranked.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("double"))
    ranked = ranked.withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    ranked = ranked.withColumns({
        "left": F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "shares": F.sum("w").over(after),
    })
    level = F.max(F.when(F.col("cap") * F.col("shares") > F.col("w") * F.col("left"), F.col("left") / F.col("shares"))).over(everything)
    return ranked.withColumn("level", level).select("source", "source_size", F.when(
        F.col("cap") * F.col("shares") > F.col("w") * F.col("left"), F.least("cap", F.col("level") * F.col("w"))).otherwise(F.col("cap")).alias("target"))


def order_hash(seed: int) -> Column:
    """60 bits of the MD5 of seed, doc_id and text."""
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def _through(sums: DataFrame, keys: list[str], bucket: str, spent: str) -> DataFrame:
    """For each row of keys the bucket in which the running size passes the goal, with what the
    buckets before it hold; sums has keys, bucket, n, goal and spent."""
    running = F.sum("n").over(Window.partitionBy(*keys).orderBy(bucket))
    rows = sums.withColumn("upto", F.col(spent) + running)
    end = F.min(F.when(F.col("upto") > F.col("goal"), F.struct(F.col(bucket), (F.col("upto") - F.col("n")).alias("at"))))
    return rows.groupBy(*keys).agg(end.alias("e")).select(*keys, F.col("e." + bucket).alias(bucket), F.col("e.at").alias("at"))


def _same(x: DataFrame, y: DataFrame, *keys: str) -> Column:
    out = x[keys[0]].eqNullSafe(y[keys[0]])
    for k in keys[1:]:
        out = out & x[k].eqNullSafe(y[k])
    return out


def _bucket(level: int) -> Column:
    return F.shiftright("h", HASH_BITS - level * BUCKET_BITS)


def plan_of(rows: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """A row for each source of ``rows`` (source, size, h): (source, source_size, target, epochs, goal,
    e1, e2, spent). All its rows are taken epochs times; once more the rows before the buckets e1 and,
    within it, e2, and of e2 itself as many as bring ``spent`` to ``goal``. Null e1: all of them."""
    b1, b2 = _bucket(1).alias("b1"), _bucket(2).alias("b2")
    sums = materialise(rows.groupBy("source", b1).agg(F.sum("size").alias("n")), "mixing-buckets")
    goals = materialise(targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")), weights, max_epochs).withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)).withColumn(
        "goal", F.col("target") - F.col("epochs") * F.col("source_size")), "mixing-targets")
    coarse = sums.join(goals, _same(sums, goals, "source")).select(sums.source, "b1", "n", "goal", F.lit(0).alias("zero"))
    ends1 = materialise(_through(coarse, ["source"], "b1", "zero"), "mixing-ends")
    # Of the one bucket in which a source's selection ends: its sizes by finer buckets.
    inside = rows.select("source", "size", b1, b2)
    inside = inside.join(ends1, _same(inside, ends1, "source", "b1")).select(inside.source, "size", "b2", "at")
    fine = inside.groupBy("source", "b2", "at").agg(F.sum("size").alias("n"))
    fine = fine.join(goals, _same(fine, goals, "source")).select(fine.source, "b2", "n", "goal", "at")
    ends2 = _through(fine, ["source"], "b2", "at").withColumnRenamed("at", "spent")
    plan = goals.join(ends1, _same(goals, ends1, "source"), "left").select(goals["*"], ends1.b1.alias("e1"))
    plan = materialise(plan.join(ends2, _same(plan, ends2, "source"), "left").select(plan["*"], ends2.b2.alias("e2"), "spent"), "mixing-plan")
    for table in (sums, goals, ends1):
        discard(table)
    return plan


def copies(rows: DataFrame, plan: DataFrame, tie: Column) -> DataFrame:
    """``rows`` (doc_id, source, size, h, ...) with source_size, target and copies. Only the rows of the
    bucket in which a source's selection ends are put in order; ``tie`` orders equal ones."""
    placed = rows.join(plan, _same(rows, plan, "source")).select(rows["*"], "source_size", "target", "epochs", "goal", "e1", "e2", "spent")
    kept, at1, at2 = [*rows.columns, "source_size", "target"], _bucket(1), _bucket(2)
    last = F.coalesce(F.col("e1").isNotNull() & (at2 == F.col("e2")), F.lit(False))
    sure = (F.col("goal") > 0) & F.when(F.col("e1").isNull(), True).otherwise((at1 < F.col("e1")) | ((at1 == F.col("e1")) & (at2 < F.col("e2"))))
    plain = placed.where(~last).select(*kept, (F.col("epochs") + sure.cast("int")).alias("copies"))
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("h", F.col("doc_id").asc_nulls_last(), "size", tie).rowsBetween(Window.unboundedPreceding, 0))
    edge = placed.where(last).withColumn("upto", F.col("spent") + upto)
    more = (F.col("upto") - F.col("size") / 2 <= F.col("goal")) & (F.col("goal") > 0)
    edge = edge.select(*kept, (F.col("epochs") + more.cast("int")).alias("copies"))
    return plain.unionByName(edge).withColumn("copies", F.col("copies").cast("int"))


def _keyed(docs: DataFrame, seed: int) -> list[Column]:
    return [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count("text").alias("size"), order_hash(seed).alias("h")]


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, h, source_size, target, copies) for each row of ``docs`` (doc_id, text,
    source, ...): ``copies`` says how often the mix takes the row.

    ``h`` is the seeded hash of doc_id and text. Null texts have size 0, a null source is a source of
    its own, null doc_ids are allowed; other columns are ignored. Repeated rows are mixed each. Reruns
    agree, however the rows are partitioned. An empty table gives no rows.
    """
    rows = materialise(docs.select(*_keyed(docs, seed)), "mixing")
    return copies(rows, plan_of(rows, weights, max_epochs), F.lit(0))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The rows of the mix: each row of ``docs`` as often as mix() says, with its own columns.

    A row's copies follow from its source's plan, so rows meet the plan (a row for each source) only,
    never each other; equal texts in several sources are taken as often as their own source says. Of
    rows with equal doc_id, text and source, the first ones by all columns come first. Nulls, repeated
    rows and empty tables as in mix().
    """
    keys = materialise(docs.select(*_keyed(docs, seed)[1:]), "mixing")
    plan = plan_of(keys, weights, max_epochs)
    discard(keys)
    packed = docs.select(F.struct(*docs.columns).alias("row"), *_keyed(docs, seed))
    out = copies(packed, plan, F.to_json("row")).where("copies > 0")
    return out.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("row.*")


def op5_source_mixing(spark, sf_dir: str) -> DataFrame:
    rows = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


OP5_SQL = """
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
         ('0x' || substr(md5('42:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))), 1, 15))::bigint as h
  from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
r as (select *, row_number() over (order by source nulls last) as rank from s),
w as (select *, (1 + (rank - 1) % 3)::double as w, (source_size * 3)::double as cap from r),
o as (select *, (sum(source_size) over ())::double - coalesce(sum(cap) over (order by cap / w, rank rows between unbounded preceding and 1 preceding), 0.0) as rest,
             sum(w) over (order by cap / w, rank rows between current row and unbounded following) as shares from w),
l as (select *, max(case when cap * shares > w * rest then rest / shares end) over () as level from o),
t as (select source, source_size, case when cap * shares > w * rest then least(cap, level * w) else cap end as target from l),
g as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as epochs from t),
x as (select d.*, g.source_size, g.target, g.epochs, g.target - g.epochs * g.source_size as goal,
             sum(d.size) over (partition by d.source order by d.h, d.doc_id nulls last, d.size rows between unbounded preceding and current row) as upto
      from d join g on d.source is not distinct from g.source)
select doc_id, size, source_size, target,
       (size * (epochs + case when upto - size / 2 <= goal and goal > 0 then 1 else 0 end))::bigint as taken
from x
"""

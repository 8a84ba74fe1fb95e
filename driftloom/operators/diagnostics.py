"""What a migration would change or lose, counted in one pass without writing."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.functions.nodes import Site
from driftloom.operators.projection import Projection


@dataclass
class Finding:
    """``elided`` counts the offenders that have no value afterwards; ``samples`` holds (key, after)."""

    attachment: str
    path: str
    op: str
    policy: str
    count: int
    elided: int = 0
    samples: list[tuple[str, str | None]] = field(default_factory=list)


def gated(projection: Projection) -> list[tuple[Site, Column]]:
    """Each site with its count, zero for records that an earlier site of the walk has already
    dropped or refused."""
    out, done = [], None
    for s in projection.sites:
        count = s.count(F.lit(0))
        own = count if done is None else F.when(done, F.lit(0).cast("long")).otherwise(count)
        out.append((s, own))
        if s.drops or s.fails:
            hit = F.coalesce(count > 0, F.lit(False))
            done = hit if done is None else done | hit
    return out


def counts(projection: Projection, rows: DataFrame) -> DataFrame:
    """(path, op, policy, count) for each site; a single aggregation over the attachment. The counts
    are predicates, never the projection itself, which an optimiser could prune away."""
    sites = gated(projection)
    sums = rows.agg(*(F.sum(c).alias(f"s{i}") for i, (_, c) in enumerate(sites))) if sites else None
    if sums is None:
        return rows.sparkSession.createDataFrame([], "path string, op string, policy string, count long")
    return sums.select(F.explode(F.array(*(F.struct(
        F.lit(s.path).alias("path"), F.lit(s.op).alias("op"), F.lit(s.policy_name).alias("policy"), F.coalesce(f"s{i}", F.lit(0)).cast("long").alias("count"),
    ) for i, (s, _) in enumerate(sites)))).alias("x")).select("x.*")


def findings(projection: Projection, rows: DataFrame, max_samples: int = 5) -> tuple[list[Finding], int, int]:
    """(findings, records, dropped records) of an attachment. Samples are the offenders with the
    smallest keys, so they are the same in every run."""
    sites, event = gated(projection), projection.event()
    dropped = F.sum((event == "drop").cast("long")) if event is not None else F.lit(0).cast("long")
    row = rows.agg(F.count("*").alias("n"), dropped.alias("dropped"), *(F.sum(c).alias(f"s{i}") for i, (_, c) in enumerate(sites))).first()
    out, key = [], F.col(projection.source.key_column).cast("string")
    for i, (s, c) in enumerate(sites):
        n = row[f"s{i}"] or 0
        if not n:
            continue
        samples = []
        if max_samples:
            after = s.after(F.lit(0)) if s.after is not None and not s.drops and not s.fails else F.lit(None)
            shown = rows.where(c > 0).select(key.alias("k"), after.alias("a")).orderBy("k").limit(max_samples)
            samples = [(r.k, None if r.a is None else str(r.a)) for r in shown.collect()]
        out.append(Finding(projection.source.id, s.path, s.op, s.policy_name, n, n if s.drops else 0, samples))
    return out, row["n"], row["dropped"] or 0


def format_report(items: list[Finding]) -> str:
    if not items:
        return "no value is changed or lost beyond the lossless rewrite"
    lines = []
    for f in items:
        lines.append(f"{f.path}  {f.op}  [{f.policy}]  {f.count}" + (f" ({f.elided} elided)" if f.elided else ""))
        lines += [f"    {k}: {'dropped' if a is None else a}" for k, a in f.samples]
    return "\n".join(lines)

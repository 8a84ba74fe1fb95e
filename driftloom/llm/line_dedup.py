"""Line deduplication over levelled sorted runs of line hashes.

Documents come in batches. A run is a Parquet table of (h1, h2, n): a 128-bit line key hash and
the number of documents of a batch that hold it, hash-dealt and sorted. Keys that have reached
the threshold are settled and live in a run of their own. Each new batch merge-anti-joins the
settled keys, which need no more counting, and adds a run of the rest at level 0. When a level
holds ``fan_out`` runs they are merged into one run of the next level; sums that reach the
threshold move to the settled keys. So a key is rewritten once for each level, not each batch.

Built-in DataFrame functions only. The runs, counts and joins of lines shuffle hashes and line numbers, never
their text; the last join brings the numbers of the dropped lines to the documents and shuffles whole texts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm.common import ASCII_SPACE, discard, hash128, materialise

MIN_CHARS = 1
MIN_DOCS = 10
BATCHES = 4
FAN_OUT = 2
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def lines_of(text: Column | str) -> Column:
    """The lines of a text, split at \\n; null and empty texts are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(text: Column | str, min_chars: int = MIN_CHARS) -> Column:
    """For each line its key hash (h1, h2), null for keys under ``min_chars`` code points."""
    def key_hash(line: Column) -> Column:
        key = F.btrim(line, F.lit(ASCII_SPACE))
        return F.when(F.char_length(key) >= min_chars, F.struct(
            F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(0x5851F42D4C957F2D), key).alias("h2")))

    return F.transform(F.split(ascii_lower(F.coalesce(text, F.lit(""))), "\n", -1), key_hash)


class LineRuns:
    """Levelled runs of line hashes for documents that come in batches.

    ``add`` takes (keys: array<struct<h1, h2>>) with one row for each document; a line counts once
    for each document. ``frequent`` gives the keys found in at least ``min_docs`` documents so far.
    With ``min_docs`` = 1 every key seen is settled, and ``unseen`` gives the first-seen lines of
    a batch, the usual streaming line deduplication.
    """

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fan_out: int = FAN_OUT):
        if min_docs < 1 or fan_out < 2:
            raise ValueError("min_docs must be at least 1, fan_out at least 2")
        self.spark, self.min_docs, self.fan_out = spark, min_docs, fan_out
        self.levels: list[list[DataFrame]] = []
        self.settled: list[DataFrame] = []

    def _run(self, df: DataFrame, tag: str) -> DataFrame:
        return materialise(df.sortWithinPartitions("h1", "h2"), tag)

    def counts(self, batch: DataFrame) -> DataFrame:
        """(h1, h2, n) of a batch: summed before the shuffle, so a common line is no hot key."""
        own = batch.select(F.explode(F.array_distinct(F.filter("keys", lambda k: k.isNotNull()))).alias("k"))
        return own.groupBy(F.col("k.h1").alias("h1"), F.col("k.h2").alias("h2")).agg(F.count("*").alias("n"))

    def unsettled(self, own: DataFrame) -> DataFrame:
        for run in self.settled:
            own = own.join(run.hint("merge"), ["h1", "h2"], "left_anti")
        return own

    def add(self, batch: DataFrame) -> None:
        own = self._run(self.unsettled(self.counts(batch)), "line-run")
        self._settle(own.where(F.col("n") >= self.min_docs).select("h1", "h2"))
        self._push(0, own.where(F.col("n") < self.min_docs), own)

    def unseen(self, batch: DataFrame) -> DataFrame:
        """The rows (h1, h2, ...) of a batch of lines that no earlier batch has settled."""
        return self.unsettled(batch)

    def _settle(self, keys: DataFrame) -> None:
        self.settled.append(self._run(keys, "line-settled"))
        if len(self.settled) > self.fan_out:
            old, merged = self.settled, self.settled[0]
            for run in old[1:]:
                merged = merged.unionByName(run)
            self.settled = [self._run(merged.repartition("h1", "h2"), "line-settled")]
            for run in old:
                discard(run)

    def _push(self, level: int, rows: DataFrame, table: DataFrame) -> None:
        rows._driftloom_path = table._driftloom_path
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(rows)
        if len(self.levels[level]) >= self.fan_out:
            self._compact(level)

    def _merge(self, runs: list[DataFrame]) -> DataFrame:
        merged = runs[0]
        for run in runs[1:]:
            merged = merged.unionByName(run)
        return merged.groupBy("h1", "h2").agg(F.sum("n").alias("n"))

    def _compact(self, level: int) -> None:
        runs, self.levels[level] = self.levels[level], []
        # A key may have been settled from a later run; what an older one holds is then done with.
        merged = self._run(self.unsettled(self._merge(runs)), "line-run")
        for run in runs:
            discard(run)
        self._settle(merged.where(F.col("n") >= self.min_docs).select("h1", "h2"))
        self._push(level + 1, merged.where(F.col("n") < self.min_docs), merged)

    def frequent(self) -> DataFrame:
        """(h1, h2) of the keys in at least ``min_docs`` documents: the settled ones, and those
        whose counts reach it over all levels."""
        runs, out = [run for level in self.levels for run in level], self.settled[0]
        for run in self.settled[1:]:
            out = out.unionByName(run)
        if len(runs) > 1:
            rest = self.unsettled(self._merge(runs)).where(F.col("n") >= self.min_docs)
            out = out.unionByName(rest.select("h1", "h2"))
        return out


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped, kept) for each row of ``docs`` (doc_id, text, ...).

    A line's key is the line without ASCII white space at both ends and with A-Z lower-cased.
    Keys of at least ``min_chars`` code points found in at least ``min_docs`` rows lose all their
    lines everywhere; the other lines stay, joined by \\n. Null and empty texts are one empty line;
    each repeated row counts as a document; null doc_ids and other columns are no matter. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    rk1, rk2 = hash128("doc_id", "text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", rk1, rk2)
    keys = materialise(rows.select(
        "rk1", "rk2", line_keys("text", min_chars).alias("keys"), F.pmod("rk1", F.lit(batches)).cast("int").alias("batch"),
    ), "line-keys", ("batch",))
    runs = LineRuns(spark, min_docs)
    for i in range(batches):
        runs.add(keys.where(F.col("batch") == i))
    common = materialise(runs.frequent(), "line-frequent")
    lines = keys.select("rk1", "rk2", F.posexplode("keys").alias("at", "k")).where("k is not null").select("rk1", "rk2", "at", "k.h1", "k.h2")
    gone = lines.join(common, ["h1", "h2"], "left_semi")
    # Equal rows share a key and give equal sets.
    gone = materialise(gone.groupBy("rk1", "rk2").agg(F.collect_set("at").alias("gone")), "line-gone")
    discard(keys)
    out = rows.join(gone, ["rk1", "rk2"], "left").select("doc_id", "text", "gone", lines_of("text").alias("lines"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(
        F.concat_ws("\n", F.transform(left, lambda i: F.get("lines", i))))
    return out.select("doc_id", "text", F.size("lines").cast("long").alias("n_lines"),
                      F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"), kept.alias("kept"))


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    rows = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP9_SQL = r"""
with d as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (select r, doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as i from d),
k as (select r, doc_id, line, i, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
c as (select key from k where length(key) >= 1 group by key having count(distinct r) >= 10),
m as (select k.*, c.key is not null as gone from k left join c on k.key = c.key)
select doc_id, count(*)::bigint as n_lines, (count(*) filter (gone))::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from m group by r, doc_id
"""

"""Rewriting attachments as they grow: the compiled projection over a stream of new rows.

A projection without lookups is stateless, so the same Columns serve batch and stream; refused
records stop the query, and its checkpoint says where it goes on. Lookups would need the state of
another table and are refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from driftloom.functions.nodes import Refused
from driftloom.operators.projection import Compiler
from driftloom.plans.build import Migration


def rewritten_stream(rows: DataFrame, m: Migration, attachment: str) -> DataFrame:
    """The target rows of a streaming frame of source rows."""
    p = Compiler(m).projection(m.source.attachment(attachment))
    if p.context.joins:
        raise Refused("[stream] hooks that look up other attachments need a batch run")
    return p.select(rows)


def follow(spark: SparkSession, source: str, m: Migration, attachment: str, target: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Rewrites Parquet files as they arrive in a folder; each file once, whatever is lost meanwhile."""
    schema = m.source.table_schema(m.source.attachment(attachment))
    out = rewritten_stream(spark.readStream.schema(schema).parquet(source), m, attachment)
    return out.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start(target)

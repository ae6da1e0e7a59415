"""Checking on streams. A check needs one document only, so each micro-batch is checked as a batch is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vidra.functions import text as X
from vidra.plans.checker import Checker
from vidra.plans.settings import apply


def token_stream(docs: DataFrame) -> DataFrame:
    """Token rows of a stream of documents; stateless, without window or shuffle."""
    return docs.select("doc_id", F.explode(X.tokenize("text")).alias("t")).select("doc_id", "t.*")


def latest(docs: DataFrame, version: str) -> DataFrame:
    """Of the documents of one micro-batch, the latest version of each: a check of an older text would come too late."""
    columns = [c for c in docs.columns if c != "doc_id"]
    return docs.groupBy("doc_id").agg(F.max_by(F.struct(*columns), version).alias("d")).select("doc_id", "d.*")


def check_stream(docs: DataFrame, checker: Checker, sink: Callable[[DataFrame, int], None], checkpoint: str, settings: dict | None = None, version: str | None = None, every: str | None = None, suggestions: bool = True) -> StreamingQuery:
    """Check a stream of (doc_id, text) and hand each micro-batch's diagnostics to ``sink``; without ``every``, all that is available is checked once, without ``suggestions`` unknown words get none."""

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows if version is None else latest(rows, version)
        out = checker.check(rows, suggestions=suggestions)
        sink(out if settings is None else apply(out, settings), number)

    writer = docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()

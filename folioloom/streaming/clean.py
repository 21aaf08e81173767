"""Continuous cleaning and per-batch documents."""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import suppress

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioloom.operators.ignore import RULE_COLUMNS, PreparedRules, Rule
from folioloom.operators.skew import drop_stored
from folioloom.plans.digest import Digest
from folioloom.session import scratch
from folioloom.sinks.documents import NoFilesError, write_document


def clean_stream(stream: DataFrame, digest: Digest, rules: Sequence[Rule] | None = None) -> DataFrame:
    """Processed rows of a stream. Every step is stateless, so there is no watermark and no state to bound.

    Ignore rules take part as a column, so they must be a list the driver holds; a table goes through `start_clean_table`.
    """
    if isinstance(rules, DataFrame):
        raise TypeError("a rule table cannot be a column; pass it to start_clean_table")
    return digest.execute(stream, rules)


class _BatchRules:
    """The rules of a query. A table is compiled once and again when its content has changed, not in every batch."""

    def __init__(self, rules: Sequence[Rule] | DataFrame | None, scope: Sequence[str]):
        self.rules, self.scope = rules, scope
        self.version, self.prepared = None, None

    def current(self) -> Sequence[Rule] | PreparedRules | None:
        if not isinstance(self.rules, DataFrame):
            return self.rules
        columns = [*self.scope, *RULE_COLUMNS]
        version = self.rules.agg(F.count("*"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))).first()
        if version != self.version:
            if self.prepared is not None:
                drop_stored(self.prepared.table)
            self.version, self.prepared = version, PreparedRules.of(self.rules, self.scope)
        return self.prepared


def start_clean_table(stream: DataFrame, digest: Digest, folder: str, checkpoint: str,
                      rules: Sequence[Rule] | DataFrame | None = None, available_now: bool = False, scope: Sequence[str] = ()) -> StreamingQuery:
    """Append processed rows to a Parquet table with a folder `batch=<id>` per micro-batch, which a replayed batch replaces.

    A rule table is joined inside each batch, so that its aggregation never turns into streaming state. What a batch stores for that goes with it.
    """
    held = _BatchRules(rules, scope)

    def store(batch: DataFrame, batch_id: int) -> None:
        current = held.current()
        with scratch(batch.sparkSession):
            digest.execute(batch, current, scope).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def start_batch_documents(stream: DataFrame, digest: Digest, folder: str, checkpoint: str, rules: Sequence[Rule] | DataFrame | None = None,
                          available_now: bool = False, scope: Sequence[str] = (), ties: Sequence[str] = ()) -> StreamingQuery:
    """One document per micro-batch in `folder/batch=<id>`; a replayed batch overwrites its own folder."""
    held = _BatchRules(rules, scope)

    def write(batch: DataFrame, batch_id: int) -> None:
        current = held.current()
        with scratch(batch.sparkSession), suppress(NoFilesError):  # an empty batch has no document
            found = digest.discover(batch, current, scope)
            write_document(digest.process(found), f"{folder}/batch={batch_id}", digest.rendering, keys=found, ties=ties)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()

"""Incremental maintenance as a stream: batches of changed files update a written index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeloom.plans.maintain import merge
from codeloom.session import cut
from codeloom.sources.extract import parse_files, relations


def apply_batch(changed: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """``changed``: (path, language, content), content null for deleted files. The last row of a path counts."""
    last = cut(changed.groupBy("path").agg(F.max_by(F.struct("language", "content"), "seq").alias("f")).select("path", "f.*"))
    fresh = relations(cut(parse_files(last)))
    return {k: merge(tables[k], fresh[k], last.select("path")) for k in fresh}


def follow(changes: DataFrame, load, save, checkpoint: str) -> StreamingQuery:
    """Keep an index current with a stream of (seq, path, language, content).

    ``load()`` gives the tables, ``save(tables, batch_id)`` writes them; a batch that is run again after a
    failure gives the same tables, since its rows replace those of its paths.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        save({k: cut(df) for k, df in apply_batch(batch, load()).items()}, batch_id)

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()

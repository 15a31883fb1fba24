"""State kept over a stream of index runs: which callables changed, and generations published once a batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomgraph.sources.publish import Publisher

DELTA = "file_id long, symbol_key string, run long, change string"
_STATE = "signature string, body string, line long"


def callable_deltas(states: DataFrame) -> DataFrame:
    """(file_id, symbol_key, run, change) of a stream of callables' states (file_id, symbol_key, run, signature_hash, body_hash, start_line).

    A callable is ``inserted`` when first seen; later its signature, else its body, else its place changed, or
    nothing did and no row comes. One callable's last state is all that is kept for it, whatever the length of the stream.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = [r for b in batches for r in b.itertuples(index=False)]
        out = []
        for r in sorted(rows, key=lambda r: r.run):
            now = (r.signature_hash, r.body_hash, int(r.start_line))
            before = state.get if state.exists else None
            if before is None:
                out.append((*key, int(r.run), "inserted"))
            else:
                changed = [name for name, a, b in zip(("signature", "body", "moved"), before, now) if a != b]
                if changed:
                    out.append((*key, int(r.run), changed[0]))
            state.update(now)
        yield pd.DataFrame(out, columns=["file_id", "symbol_key", "run", "change"])

    return states.groupBy("file_id", "symbol_key").applyInPandasWithState(step, DELTA, _STATE, "append", GroupStateTimeout.NoTimeout)


def publish_batches(stream: DataFrame, publisher: Publisher, table: str, checkpoint: str):  # noqa: ANN201
    """A query that publishes each micro-batch as the next generation, appended to the live rows of ``table``.

    A batch writes its own rows and a manifest, whatever the table has by then. Its number is a mark of the
    manifest, so one that runs again after a failure is published no second time.
    """
    from pyspark.sql import functions as F

    mark = f"batch of {table}"

    def publish(batch: DataFrame, number: int) -> None:
        publisher.recover()
        if publisher.marks().get(mark, -1) >= number:
            return
        rows = batch.withColumn("batch", F.lit(number).cast("long"))
        publisher.promote(publisher.stage({}, {table: rows}, publisher.live(), {mark: number}))

    return stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)

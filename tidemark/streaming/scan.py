"""Run sequential kernels over sorted tables, and over streams with checkpointed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle as pickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KernelFactory = Callable[[], object]


def _types(schema: str) -> tuple[list[str], list[pa.DataType]]:
    kinds = {"double": pa.float64(), "long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
    pairs = [part.split() for part in schema.split(", ")]
    return [p[0] for p in pairs], [kinds[p[1]] for p in pairs]


def keyed_scan(df: DataFrame, by: str, order: Sequence[str], inputs: Sequence[str], kernel: KernelFactory, output: str, keep: Sequence[str] = ()) -> DataFrame:
    """Feed each key's rows, in order, to a kernel of its own; adds the kernel's outputs.

    One shuffle by key; within a partition rows stream in (key, order), so a
    task holds one kernel's state and one Arrow batch, whatever a key's size.
    """
    names, types = _types(output)
    keep = [by, *[c for c in dict.fromkeys([*order, *keep]) if c != by]]
    work = df.select(*keep, *[F.col(c).alias(f"_in{i}") for i, c in enumerate(inputs)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = object(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            values = zip(*(batch.column(len(keep) + i).to_pylist() for i in range(len(inputs))), strict=True)
            for k, row in zip(batch.column(0).to_pylist(), values, strict=True):
                if k != key:
                    key, state = k, kernel()
                out.append(state.step(*row))
            cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *cols], names=[*keep, *names])

    schema = ", ".join(f"`{c}` {kind}" for c, kind in work.select(*keep).dtypes) + ", " + output
    return work.repartition(by).sortWithinPartitions(by, *order).mapInArrow(scan, schema)


def streaming_scan(stream: DataFrame, by: str, order: str, inputs: Sequence[str], kernel: KernelFactory, output: str) -> DataFrame:
    """The same on a stream: the kernel is the key's state, pickled between micro-batches.

    Rows of a micro-batch are taken in ``order`` within their key; across
    batches the arrival order counts. The state outlives lost executors in the
    query's checkpoint.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    names, _ = _types(output)
    types = dict(stream.dtypes)
    inputs = list(inputs)

    class Keyed(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("kernel", "state binary")

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            held = self.state.get() if self.state.exists() else None
            k = pickle.loads(held[0]) if held else kernel()
            frame = pd.concat(list(rows)).sort_values(order)
            out = [k.step(*row) for row in frame[inputs].itertuples(index=False, name=None)]
            self.state.update((pickle.dumps(k),))
            result = pd.DataFrame(out, columns=names)
            result.insert(0, order, frame[order].to_numpy())
            result.insert(0, by, key[0])
            yield result

        def close(self) -> None:
            pass

    schema = f"{by} {types[by]}, {order} {types[order]}, {output}"
    return stream.groupBy(by).transformWithStateInPandas(Keyed(), schema, "append", "none")

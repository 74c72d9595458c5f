"""Running numbers and sums inside a key whose rows need not fit in one task.

Rows are dealt out by ranges of (key, order), so a key with many rows spans neighbouring partitions. Each partition runs over
its own rows; what the partitions before hold of the same key is added afterwards, from their first and last rows alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesledger.llm.staging import staged


def _segments(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of one key start, and for each row the number of its run."""
    new = np.concatenate([[True], key[1:] != key[:-1]])
    return np.flatnonzero(new), np.cumsum(new) - 1


def _local(key: str, sums: Sequence[str], names: list[str]):
    """Numbers and sums inside one partition, with the first and the last row marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, count, totals = None, 0, np.zeros(len(sums), np.uint64)
        waiting, first = None, True

        def out(batch: pa.RecordBatch, columns: list[np.ndarray], end: bool) -> pa.RecordBatch:
            head, tail = np.zeros(batch.num_rows, bool), np.zeros(batch.num_rows, bool)
            head[0], tail[-1] = first, end
            number, *values = columns
            arrays = [batch[n] for n in names if n not in sums] + [pa.array(v.view(np.int64)) for v in values]
            return pa.RecordBatch.from_arrays(
                [*arrays, pa.array(number), pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(head), pa.array(tail)],
                [*(n for n in names if n not in sums), *sums, "number", "part", "head", "tail"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            if waiting:
                yield out(*waiting, False)
                first = False
            keys = batch[key].to_numpy()
            starts, own = _segments(keys)
            goes_on = last is not None and keys[0] == last
            number = np.arange(batch.num_rows) - starts[own] + 1
            number[own == 0] += count if goes_on else 0
            columns = [number]
            for i, name in enumerate(sums):
                total = np.cumsum(batch[name].to_numpy().view(np.uint64))
                before = np.where(starts > 0, total[starts - 1], np.uint64(0))
                total = total - before[own]
                if goes_on:
                    total[own == 0] += totals[i]
                totals[i] = total[-1]
                columns.append(total)
            last, count = keys[-1], int(number[-1])
            waiting = (batch, columns)
        if waiting:
            yield out(*waiting, True)

    return run


def _carried(edges: list[tuple], sums: int) -> dict[int, tuple[int, list[int]]]:
    """By partition: the key that goes on from the partitions before, with their number of rows and their sums.

    ``edges`` has (part, head, tail, key, number, sums ...) of the first and the last row of each partition.
    """
    heads = {e[0]: e for e in edges if e[1]}
    tails = {e[0]: e for e in edges if e[2]}
    out: dict[int, tuple[int, list[int]]] = {}
    open_key, count, totals = None, 0, [0] * sums
    for part in sorted(heads):
        head, tail = heads[part], tails[part]
        if open_key is not None and head[3] == open_key:
            out[part] = (head[3], [count, *totals])
            if tail[3] != open_key:
                count, totals = 0, [0] * sums
        else:
            count, totals = 0, [0] * sums
        open_key = tail[3]
        count += tail[4]
        totals = [(a + b) % (1 << 64) for a, b in zip(totals, tail[5:])]
    return out


def running(df: DataFrame, key: str, order: Sequence[str], sums: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``number``, 1 for a key's first row, and each of ``sums`` replaced by its sum up to the row.

    Key and sums are non-null longs, sums wrap at 2**64. Within a key rows follow ``order``, nulls first; rows that agree in all
    of it may change places, so give every column that tells rows apart. The result is a stored table; the first and last
    row of each partition, no more, reach the driver.
    """
    by = [F.col(c).asc_nulls_first() for c in (key, *order)]
    added = "number long, part int, head boolean, tail boolean"
    kept = [f for f in df.schema.fields if f.name not in sums]
    schema = T.StructType(
        [*kept, *[T.StructField(s, T.LongType()) for s in sums], *T._parse_datatype_string(added).fields]
    )
    # Equal rows, however many, are told apart by a number of their own, so they span partitions too.
    spread = df.repartitionByRange(*by, F.xxhash64(F.monotonically_increasing_id())).sortWithinPartitions(*by)
    local = staged(spread.mapInArrow(_local(key, sums, df.columns), schema), "running")
    edges = local.where("head OR tail").select("part", "head", "tail", key, "number", *sums).collect()
    carried = _carried([tuple(e) for e in edges], len(sums))
    out = T.StructType(schema.fields[:-3])
    if not carried:
        return local.select(*out.names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, parts = batch[key].to_numpy(), batch["part"].to_numpy()
            changed = {n: batch[n].to_numpy().view(np.uint64).copy() for n in ("number", *sums)}
            for part in set(parts.tolist()) & carried.keys():
                own = (parts == part) & (keys == carried[part][0])
                for values, more in zip(changed.values(), carried[part][1]):
                    values[own] += np.uint64(more)
            yield pa.RecordBatch.from_arrays(
                [pa.array(changed[n].view(np.int64)) if n in changed else batch[n] for n in out.names], out.names
            )

    return local.mapInArrow(add, out)

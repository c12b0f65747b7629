"""Small groups handled many at a time, and batches held to a size.

A pandas call a group costs a frame a group; here the rows of a key are gathered into a list
column, and one call handles the keys of a whole Arrow batch.  Files are long rows, so batches of
them are bounded in bytes on their way to Python and back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of files in an Arrow batch sent to Python, and of those whose rows go back in a frame.
BATCH_BYTES = 4 << 20
FRAME_BYTES = 1 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches held to BATCH_BYTES, however many rows there are.

    The setting stays: the plan that the caller gets runs later and needs it too.
    """
    conf = df.sparkSession.conf
    now = conf.get(_BATCH).lower().rstrip("b")  # bytes, as Spark prints the default, or with a unit
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(_BATCH, str(BATCH_BYTES))
    return df


def frames(rows: Iterable[tuple[int, list[tuple]]], names: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of the rows of each file, given with its bytes; a file's rows stay together."""
    held: list[tuple] = []
    size = 0
    for n, of_file in rows:
        held += of_file
        size += n
        if size >= FRAME_BYTES:
            yield pd.DataFrame(held, columns=names)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=names)


def plain(row: object) -> dict:
    return dict(row.asDict() if hasattr(row, "asDict") else row)


def gathered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """A row a key, with its rows (all other columns) as the list ``name``."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.collect_list(F.struct(*rest)).alias(name))


def each_key(df: DataFrame, keys: list[str], lists: list[str], function: Callable[..., list[tuple]], schema: str) -> DataFrame:
    """Rows that ``function(key, rows, ...)`` gives for every row of ``df``; the lists hold dicts, a null list none."""
    names = [x.split()[0] for x in _columns(schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for values in zip(*(batch[c] for c in (*keys, *lists))):
                found = [[plain(x) for x in v] if v is not None else [] for v in values[len(keys) :]]
                out += function(values[: len(keys)], *found)
            yield pd.DataFrame(out, columns=names)

    return df.select(*keys, *lists).mapInPandas(run, schema)


def _columns(schema: str) -> list[str]:
    """The columns of a schema string; commas within types don't part them."""
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]

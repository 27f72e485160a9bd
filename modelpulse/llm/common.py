"""What several operators of the package share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of anything but blanks, in texts of any language.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Bytes of text that a task works on at once.
CHUNK_BYTES = 2_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words_of(text: str | Column) -> Column:
    """Array of the words of a text; a null text has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fresh(columns: Sequence[str], name: str) -> str:
    """A column name that the table doesn't have yet, whatever the case of its letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def besides(columns: Sequence[str], added: Iterable[str]) -> list[str]:
    """The columns that aren't replaced by added ones, whatever the case of their letters."""
    replaced = {a.lower() for a in added}
    return [c for c in columns if c.lower() not in replaced]


def text_chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of about `most` bytes together, nulls as empty; with the first's place."""
    held, size, start = [], 0, 0
    for i, text in enumerate(texts.to_pylist()):
        text = text or ""
        if held and size + len(text) > most:
            yield start, held
            held, size, start = [], 0, i
        held.append(text)
        size += len(text)
    if held:
        yield start, held


def with_arrow_columns(
    df: DataFrame, text: str, added: dict[str, T.DataType], work, setup=None
) -> DataFrame:
    """Add columns that a function computes from lists of texts, a chunk at a time.

    `work(texts)` returns one list for each added column. Rows, order and other columns stay.
    An added column replaces one of that name.
    """
    kept = besides(df.columns, added)
    schema = T.StructType(
        [f for f in df.schema.fields if f.name in kept] + [T.StructField(n, t) for n, t in added.items()]
    )
    from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

    types = {n: to_arrow_type(t) for n, t in added.items()}
    at = df.columns.index(text)
    order = [df.columns.index(c) for c in kept]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for start, texts in text_chunks(batch.column(at)):
                made = work(texts)
                part = batch.slice(start, len(texts))
                arrays = [part.column(i) for i in order]
                arrays += [pa.array(v, types[n]) for (n, _), v in zip(added.items(), made)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *added])
                done += len(texts)

    return df.mapInArrow(run, schema)


class Shared:
    """An object of bounded size sent to the executors once; a worker process makes it once."""

    def __init__(self, spark: SparkSession, value):
        self.held = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        made = getattr(self.held, "made", None)
        if made is None:
            made = self.held.made = cloudpickle.loads(self.held.value)
        return made

"""A Spark data source that keeps each symbol's rows as soon as they are whole.

Rows come with marks: a row whose ``done`` is true ends a unit, one symbol or one part of it. Its task writes the unit as a file of
its own, under a name that follows from the symbol and the part, beside its place and then moves it there. So a job that is
killed has lost only what was not finished, a task that runs twice writes the same files, and nobody reads half a unit. Files
are written through Arrow's file systems (a unit when the Arrow batch with its mark is full or the task ends), so the folder must lie in a store that they know (a path, or a file, hdfs, s3 or gs URI).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

NAME = "symbol_units"


def unit_name(symbol: str, part: int) -> str:
    return hashlib.sha256(f"{symbol}\n{part}".encode()).hexdigest()[:40]


def unit_sink():
    """The data source, for ``spark.dataSource.register``."""
    import pyarrow as pa
    import pyarrow.compute as pc
    import pyarrow.parquet as pq
    from pyarrow import fs
    from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

    @dataclass
    class Told(WriterCommitMessage):
        units: int

    class Writer(DataSourceArrowWriter):
        def __init__(self, path: str):
            self.path = path

        def write(self, iterator: Iterator[pa.RecordBatch]) -> Told:
            store, root = fs.FileSystem.from_uri(self.path)
            store.create_dir(root, recursive=True)
            held: list[pa.Table] = []
            units = 0
            for batch in iterator:
                table, at = pa.Table.from_batches([batch]), 0
                done = pc.fill_null(table["done"], False).to_pylist()
                for end in [k + 1 for k, is_last in enumerate(done) if is_last]:
                    held.append(table.slice(at, end - at))
                    at, units = end, units + 1
                    self.keep(store, root, pa.concat_tables(held))
                    held = []
                held.append(table.slice(at))
            return Told(units)

        def keep(self, store, root: str, unit: pa.Table) -> None:
            mark = unit.slice(unit.num_rows - 1).to_pylist()[0]
            symbols = pc.unique(unit["Symbol"]).to_pylist()
            if symbols != [mark["Symbol"]]:
                raise ValueError(f"the rows before the mark of {mark['Symbol']!r} are of {symbols}")
            name = unit_name(mark["Symbol"], mark["part"])
            beside = f"{root}/_{name}-{id(self)}"
            pq.write_table(unit, beside, filesystem=store, compression="zstd")
            store.move(beside, f"{root}/{name}.parquet")

        def commit(self, messages: list) -> None:
            """Nothing is left to do: what is written is whole."""

        def abort(self, messages: list) -> None:
            """What is written is whole, and stays."""

    class Units(DataSource):
        @classmethod
        def name(cls) -> str:
            return NAME

        def writer(self, schema, overwrite: bool) -> Writer:
            return Writer(self.options["path"])

    return Units


def write_units(marked: DataFrame, path: str) -> None:
    """Write marked rows under ``path``, each unit when its mark comes."""
    marked.sparkSession.dataSource.register(unit_sink())
    marked.write.format(NAME).mode("append").option("path", path).save()


def read_units(spark: SparkSession, path: str, schema) -> DataFrame:
    """All rows under ``path``, marks included."""
    return spark.read.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path)

"""Tick folders and files, and the conversion of raw numeric exports.

Files are found and read by Spark, so folders may lie in any store that it reads.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.schemas import COUNTRIES, TICKS

# Fixed value: the names of the tick folders, country and year.
_FOLDER = re.compile(r"^([A-Z]+)_(\d{4})$")


def check_country(country: str) -> str:
    if country not in COUNTRIES:
        raise ValueError(f"unknown country {country!r}; one of {', '.join(COUNTRIES)}")
    return country


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, in order of their names; works on any file system that Spark knows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(str(status.getPath()) for status in found or [])


def country_folders(spark: SparkSession, base: str, country: str) -> list[str]:
    """The country's folders ``{country}_{year}`` under ``base``, by name."""
    check_country(country)
    return [p for p in listed(spark, f"{base}/{country}_*") if (m := _FOLDER.match(p.rstrip("/").rpartition("/")[2])) and m[1] == country]


def tick_files(spark: SparkSession, base: str, country: str, suffix: str = "parquet") -> list[str]:
    """The country's tick files, by folder and name; an error if there are none."""
    files = [f for folder in country_folders(spark, base, country) for f in listed(spark, f"{folder}/*.{suffix}")]
    if not files:
        raise FileNotFoundError(f"no {suffix} files of {country} under {base}")
    return files


def read_ticks(spark: SparkSession, files: list[str], schema: str = TICKS) -> DataFrame:
    """Ticks of all files. The schema is given because Spark cannot infer files with nanosecond times; Time is read as nanoseconds."""
    return spark.read.schema(schema).parquet(*files)


def with_origin(ticks: DataFrame) -> DataFrame:
    """``ticks`` with the country and year of the innermost tick folder that each row was read from; null where there is none."""
    name = F.col("_metadata.file_path")
    country, year = (F.nullif(F.regexp_extract(name, r"^.*/([A-Z]+)_(\d{4})/", k), F.lit("")) for k in (1, 2))
    return ticks.select("*", country.alias("country"), year.cast("int").alias("year"))


def read_folders(spark: SparkSession, base: str, countries: list[str], schema: str = TICKS, suffix: str = "parquet") -> DataFrame:
    """Ticks of all files of the countries, with country and year.

    Both are constants of each folder's own scan, so a filter on them leaves whole folders out of the plan. A country without
    files is an error.
    """
    out = None
    for country in countries:
        by_folder: dict[str, list[str]] = {}
        for file in tick_files(spark, base, country, suffix):
            by_folder.setdefault(file.rpartition("/")[0], []).append(file)
        for folder, files in by_folder.items():
            year = int(_FOLDER.match(folder.rpartition("/")[2])[2])
            part = read_ticks(spark, files, schema).withColumns({"country": F.lit(country), "year": F.lit(year)})
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no country is given")
    return out


def _known(value: str | Column) -> Column:
    """The number, null where it is missing: exports mark missing numbers as NaN."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when(~F.isnan(value), value)


def raw_date(days: str | Column) -> Column:
    """Days since 1960-01-01 as a date; a fraction of a day is dropped; null for null and NaN."""
    return F.date_add(F.lit("1960-01-01").cast("date"), F.floor(_known(days)).cast("int"))


def raw_time_ns(seconds: str | Column) -> Column:
    """Seconds since midnight as whole nanoseconds, half to even; null for null and NaN."""
    return F.rint(_known(seconds) * F.lit(1e9)).cast("bigint")


def clean_symbol(symbol: str | Column) -> Column:
    """The symbol without white space around it; the text ``nan`` is missing."""
    bare = F.regexp_replace(symbol, r"^\s+|\s+$", "")
    return F.nullif(bare, F.lit("nan"))


def side(lr: str | Column) -> Column:
    """LR as a byte, null for null and NaN; a value that is no whole number raises."""
    lr = F.col(lr) if isinstance(lr, str) else lr
    broken = F.raise_error(F.concat(F.lit("LR is not whole: "), lr.cast("string")))
    return F.when(lr.isNotNull() & ~F.isnan(lr) & (F.floor(lr) != lr), broken.cast("tinyint")).otherwise(F.when(F.isnan(lr), None).otherwise(lr).cast("tinyint"))


_CONVERSIONS = {"Date": raw_date, "Time": raw_time_ns, "Symbol": clean_symbol, "LR": side}


def convert_raw(raw: DataFrame) -> DataFrame:
    """A raw export's columns in their own order, those known converted, prices and volumes as doubles, others unchanged."""
    out = []
    for name in raw.columns:
        if name in _CONVERSIONS:
            out.append(_CONVERSIONS[name](name).alias(name))
        elif name in ("Price", "Volume", "MidPoint", "QSpread"):
            out.append(F.col(name).cast("double").alias(name))
        else:
            out.append(F.col(name))
    return raw.select(*out)


def sas_source():
    """A Spark data source for SAS7BDAT files, one partition a file, raw numbers; needs the optional package pyreadstat.

    Columns are those of the first file unless a schema is given; a file without one of them has nulls there. Missing
    numbers are nulls.
    """
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
    from pyspark.sql.pandas.types import to_arrow_schema

    class Reader(DataSourceReader):
        def __init__(self, options: dict, schema):
            self.paths, self.chunk, self.schema = sorted(options["path"].split(",")), int(options.get("chunksize", "5000000")), schema

        def partitions(self) -> list[InputPartition]:
            return [InputPartition(p) for p in self.paths]

        def read(self, partition: InputPartition) -> Iterator:
            import pyarrow as pa
            import pyreadstat

            kinds = to_arrow_schema(self.schema)
            for frame, _ in pyreadstat.read_file_in_chunks(pyreadstat.read_sas7bdat, partition.value, chunksize=self.chunk, disable_datetime_conversion=True):
                yield pa.RecordBatch.from_pandas(frame.reindex(columns=kinds.names), schema=kinds, preserve_index=False)

    class Sas(DataSource):
        @classmethod
        def name(cls) -> str:
            return "sas7bdat"

        def schema(self) -> str:
            import pyreadstat

            _, told = pyreadstat.read_sas7bdat(sorted(self.options["path"].split(","))[0], metadataonly=True)
            return ", ".join(f"`{c}` {'STRING' if told.readstat_variable_types[c] == 'string' else 'DOUBLE'}" for c in told.column_names)

        def reader(self, schema) -> Reader:
            return Reader(self.options, schema)

    return Sas


def convert_folders(spark: SparkSession, base: str, read_raw, force: bool = False) -> dict[str, str]:
    """Convert each raw export under every country's folders to Parquet beside it; what exists stays unless ``force``.

    read_raw: makes a DataFrame of a file. Spark commits an output whole or not at all. Returns what was done with each file.
    """
    done = {}
    for folder in sorted(f for c in COUNTRIES for f in country_folders(spark, base, c)):
        for path in listed(spark, f"{folder}/*.sas7bdat"):
            target = path.removesuffix(".sas7bdat") + ".parquet"
            if not force and listed(spark, f"{target}/_SUCCESS"):
                done[path] = "kept"
                continue
            convert_raw(read_raw(path)).write.mode("overwrite").option("compression", "snappy").parquet(target)
            done[path] = "converted"
    return done

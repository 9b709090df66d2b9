"""Runs that can be resumed, and their outputs."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import asdict
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickloom.functions.shipping import ship
from tickloom.functions.store import cut
from tickloom.schemas import EST_ERROR, LOW_VALID_DAYS, SUCCESS, TIMEOUT
from tickloom.sources.ticks import check_country, listed
from tickloom.sources.units import read_units, write_units


def output_dir(root: str, country: str, model: str | None = None) -> str:
    return "/".join([root, check_country(country), *([model] if model else [])])


def run_name(model: str, country: str, now: datetime) -> str:
    return f"{model}_{check_country(country)}_{now:%Y%m%d_%H%M}"


def fingerprint(spark: SparkSession, inputs: list[str], config: object, model: str) -> str:
    """A name for the results of a model and configuration on these files and folders.

    It follows from the paths, lengths and times of the files, none of which is opened; another file, a changed one or another
    setting gives another name.
    """
    # Only the content column would read a file.
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(inputs).select("path", "length", "modificationTime")
    total = files.agg(F.count("*").alias("n"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")).alias("h")).first()
    text = json.dumps([model, asdict(config), total.n, str(total.h)], sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()[:24]


def cached(spark: SparkSession, make: Callable[[], DataFrame], path: str, key: str, force: bool = False) -> DataFrame:
    """The table under ``path/key``, made if it is not there (or on ``force``)."""
    where = f"{path}/{key}"
    if not force:
        try:
            return spark.read.parquet(where)
        except AnalysisException:
            pass
    make().write.mode("overwrite").option("compression", "zstd").parquet(where)
    return spark.read.parquet(where)


def counted(result: DataFrame, name: str = "windows") -> tuple[DataFrame, Observation]:
    """The result, and counters of its windows by reason that whatever action writes it fills: no pass of their own."""
    seen = Observation(name)
    reasons = {r: F.count_if(F.col("skip_reason") == r).alias(r) for r in (SUCCESS, LOW_VALID_DAYS, EST_ERROR, TIMEOUT)}
    return result.observe(seen, F.count(F.lit(1)).alias("windows"), *reasons.values()), seen


def remaining(symbols: DataFrame, done: DataFrame) -> DataFrame:
    """Symbols without a result."""
    return symbols.join(done.select("Symbol").distinct(), "Symbol", "left_anti")


def marked(result: DataFrame, symbols: DataFrame) -> DataFrame:
    """The result with each symbol's rows together and its mark after them; for results that have no marks of their own."""
    marks = symbols.select("Symbol", F.lit(True).alias("done"), F.lit(0).alias("part"), F.lit(1).alias("parts"))
    counts = result.groupBy("Symbol").agg(F.count("*").cast("int").alias("windows"))
    marks = marks.join(counts, "Symbol", "left").withColumns({"windows": F.coalesce("windows", F.lit(0)), "seconds": F.lit(None).cast("double")})
    return result.unionByName(marks, allowMissingColumns=True).repartition("Symbol").sortWithinPartitions("Symbol", F.asc_nulls_first("done"))


class Run:
    """Results of symbols under ``path/key``, kept one by one as they are finished; another key never meets them."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.where = spark, f"{path}/{key}"

    def _schema(self) -> StructType | None:
        found = listed(self.spark, f"{self.where}/schema/*.txt")
        return StructType.fromJson(json.loads(self.spark.read.text(f"{self.where}/schema").first()[0])) if found else None

    def rows(self) -> DataFrame | None:
        """All rows so far, marks included; None before there are any."""
        schema = self._schema()
        return read_units(self.spark, f"{self.where}/units", schema) if schema is not None and listed(self.spark, f"{self.where}/units/*.parquet") else None

    def progress(self) -> DataFrame | None:
        """Of each symbol so far, while the run goes on or after it: the parts that are finished, of how many, their windows, and the seconds that they took."""
        rows = self.rows()
        if rows is None:
            return None
        return rows.where("done").groupBy("Symbol").agg(F.count("*").cast("int").alias("part"), F.max("parts").alias("parts"), F.sum("windows").alias("windows"), F.sum("seconds").alias("seconds"))

    def finished(self) -> DataFrame | None:
        progress = self.progress()
        return None if progress is None else progress.where("part >= parts").select("Symbol")

    def results(self) -> DataFrame:
        """The rows of finished symbols."""
        rows = self.rows()
        if rows is None:
            raise FileNotFoundError(f"no symbol is finished under {self.where}")
        return rows.where("done IS NULL").join(self.finished(), "Symbol", "left_semi").drop("done", "part", "parts", "windows", "seconds", "last")

    def keep(self, estimated: DataFrame) -> None:
        if self._schema() is None:
            self.spark.createDataFrame([(estimated.schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.where}/schema")
        ship(self.spark)
        write_units(estimated, f"{self.where}/units")


def resumable(spark: SparkSession, panel: DataFrame, estimate: Callable[[DataFrame], DataFrame], path: str, key: str, tell: Callable[[str], None] | None = None) -> tuple[DataFrame, DataFrame]:
    """Results of all symbols of ``panel`` under ``path/key``, and the symbols that failed with their errors.

    One job does all symbols that have no result there yet, and each is kept when it is finished (see ``sources.units``): a
    killed run loses only what was under way. If the job fails, the symbols left are halved and each half is tried by itself,
    until those at fault stand alone; they are told with their error and tried again by the next run.
    estimate: gives rows with marks, as ``estimates.pin_marked`` does, or rows without, to which ``marked`` is applied.
    key: names inputs and settings, as from ``fingerprint``.
    """
    run = Run(spark, path, key)
    every = cut(panel.select("Symbol").where("Symbol IS NOT NULL").distinct().withColumn("h", F.xxhash64("Symbol")), "symbols")
    failed: list[tuple[str, str]] = []

    def left(parts: int, which: int) -> DataFrame:
        mine, done = every.where(F.pmod("h", F.lit(parts)) == which), run.finished()
        return cut((remaining(mine, done) if done is not None else mine).select("Symbol"), "left")

    waiting = [(1, 0)]
    while waiting:
        parts, which = waiting.pop()
        mine = left(parts, which)
        n = mine.count()
        if not n:
            continue
        began = time.monotonic()
        try:
            found = estimate(panel.join(mine, "Symbol", "left_semi"))
            run.keep(found if "done" in found.columns else marked(found, mine))
            outcome = "done"
        except Exception as e:  # noqa: BLE001 - whatever it is, only the symbols at fault are lost
            outcome = "failed"
            if n == 1 or parts >= 1 << 62:
                failed += [(r.Symbol, str(e).strip().splitlines()[0][:500] if str(e).strip() else type(e).__name__) for r in mine.collect()]
            else:
                waiting += [(2 * parts, which + parts), (2 * parts, which)]
        if tell:
            tell(f"{n} symbols {outcome} in {time.monotonic() - began:.0f} s, {len(failed)} at fault, {len(waiting)} groups left")
    return run.results(), spark.createDataFrame(failed, "Symbol string, error string")


def write_result(result: DataFrame, path: str, order: list[str], sample: int = 1000) -> None:
    """The result in order as zstd Parquet, and its first rows as CSV with NA for nulls."""
    result.orderBy(*order).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}.parquet")
    first = result.sparkSession.read.parquet(f"{path}.parquet").orderBy(*order).limit(sample)
    first.coalesce(1).write.mode("overwrite").option("header", True).option("nullValue", "NA").csv(f"{path}_sample.csv")


def write_errors(errors: DataFrame, path: str) -> None:
    """A text line ``Symbol : error`` for each row."""
    errors.select(F.concat_ws(" : ", "Symbol", "error").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def union_by_name(*frames: DataFrame) -> DataFrame:
    """All rows, columns matched by name, missing ones null."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out

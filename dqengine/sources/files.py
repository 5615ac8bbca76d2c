"""File sources (S1, S2) and the report sink.

S1: a CSV is read as text columns (RFC 4180 quotes: doubled quotes, commas and
line ends inside them), one aggregate over the whole file finds which types
every cell of a column can have, and cells are cast.

A column gets a type only if that keeps what its cells say:

* ``boolean``: all cells ``true`` or ``false``, in one of the usual spellings;
* ``bigint``: whole numbers as they are printed (no leading zeros, no plus);
* ``decimal(38,0)``: the same beyond 64 bits;
* ``double``: decimals, also with exponent, whose digits a double gives back,
  and NaN or infinities beside them.  Not a number with leading zeros, with a
  plus, beyond the range of doubles or with more digits than they hold.

Everything else stays text: ``Y`` and ``N``, ``00501``, ``10D``, ``1e400``, dates.
The possible types of a cell are a set of bits, those of a column their
intersection, which merges in any order.  Inferring from the first rows is an
explicit choice (``sample_rows``); then cells that do not parse become null, as
in the reference, and ``csv_nulled_cells`` tells how many.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, stage_dir
from .csv_records import csv_records, split_states

READERS = {".csv": "csv", ".parquet": "parquet", ".json": "json", ".orc": "orc"}
#: Types in the order they are tried, by the bits of ``cell_types``.
CSV_TYPES = (("boolean", 1), ("boolean", 2), ("boolean", 4), ("bigint", 8), ("decimal(38,0)", 16), ("double", 32))
ANY_TYPE = 63
_NUMBER = r"^-?((0|[1-9][0-9]*)(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_NO_NUMBER = r"^(NaN|-?inf|-?Infinity)$"
_NO_DIGIT = r"^[^0-9\n\r\x85\u2028\u2029]*\z"
_WORDS = ("true", "false", "True", "False", "TRUE", "FALSE", "NaN", "inf", "-inf", "Infinity", "-Infinity")
#: Every decimal of so many digits has a double of its own.
SURE_DIGITS = 15
SMALLEST = 2.2250738585072014e-308
#: What most cells are: whole numbers and decimals of SURE_DIGITS digits at most, and texts that hold what no
#: number, boolean or line end holds (no digit of a number comes before a minus).
_PLAIN_WHOLE = r"^(0|-?[1-9][0-9]{0,14})\z"
_PLAIN_DECIMAL = r"^-?(0|[1-9][0-9]{0,8})\.[0-9]{1,6}\z"
_TEXT = r"[0-9]-|[^-+.0-9truefalsTRUEFALSNaInify\n\r\x85\u2028\u2029]"


def csv_text(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """``_cells`` without the word on how they were read."""
    return _cells(spark, path, multi_line)[0]


def _cells(spark: SparkSession, path: str, multi_line: bool | None) -> tuple[DataFrame, bool]:
    """Every cell of a CSV with a header as text; empty cells are null, short
    rows are padded, further fields dropped.

    ``multi_line`` says whether there are line ends inside quotes (None: one scan
    of the lines finds out).  Files are split among tasks either way.  Lines end
    with a line feed, with or without a carriage return; compressed files are one
    split each.  The second value tells whether records were joined from lines."""
    if multi_line is None and spark.read.option("lineSep", "\n").text(path).where(F.col("value").contains('"')).isEmpty():
        multi_line = False
    # a row for each split, read twice
    states = materialize(split_states(spark, path), f"{stage_dir(spark)}/splits") if multi_line is not False else None
    if multi_line is None and states.where("across").isEmpty():
        states = None
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    reader = spark.read.options(header=True, **options)
    if states is None:
        return reader.csv(path), False
    names = reader.option("multiLine", True).csv(path).columns  # parses the first record only
    names[-1] = names[-1].removesuffix("\r")
    cells = ", ".join(f"c{i} STRING" for i in range(len(names)))
    parsed = F.from_csv(F.col("record").cast("string"), cells, {**options, "multiLine": "true"})
    return csv_records(spark, path, states).select(parsed.alias("r")).select("r.*").toDF(*names), True


def cell_types(c: Column) -> Column:
    """The types a cell can have, as bits; all of them for null."""
    digits = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "[eE].*$", ""), "[-.]", ""), "^0+|0+$", "")
    whole = c.rlike("^(0|-?[1-9][0-9]*)$")
    number = c.try_cast("double")
    size = F.length(digits(c))
    held = (size == 0) | (F.abs(number).between(F.lit(SMALLEST), F.lit(1.7976931348623157e308)) & (
        (size <= SURE_DIGITS) | (digits(number.cast("string")) == digits(c))))
    bits = [(c.isin("true", "false"), 1), (c.isin("True", "False"), 2), (c.isin("TRUE", "FALSE"), 4),
            (whole & (F.length(c) <= 20) & c.try_cast("bigint").isNotNull(), 8),
            (whole & (F.length(F.replace(c, F.lit("-"), F.lit(""))) <= 38), 16),
            (F.when(c.rlike(_NUMBER), held).otherwise(c.rlike(_NO_NUMBER)), 32)]
    of = [F.when(F.coalesce(has, F.lit(False)), F.lit(bit)).otherwise(F.lit(0)) for has, bit in bits]
    return F.when(c.isNull(), F.lit(ANY_TYPE)).otherwise(sum(of[1:], of[0]))


def plain_types(c: Column) -> Column:
    """``cell_types`` of the cells that three patterns tell, null for all others."""
    text = c.rlike(_TEXT) | (c.rlike(_NO_DIGIT) & ~c.isin(*_WORDS))
    return (F.when(c.isNull(), F.lit(ANY_TYPE)).when(c.rlike(_PLAIN_WHOLE), F.lit(8 + 16 + 32))
             .when(c.rlike(_PLAIN_DECIMAL), F.lit(32)).when(text, F.lit(0)))


def infer_csv_types(text: DataFrame, sample_rows: int | None = None) -> list[str]:
    """A type for each column: the first of CSV_TYPES that all non-null cells
    can have, else text.  One aggregate over all rows, or the first ``sample_rows``."""
    if not text.columns:
        return []
    rows = text.toDF(*[f"c{i}" for i in range(len(text.columns))])
    rows = rows.limit(sample_rows) if sample_rows is not None else rows
    # a row for each cell, so that the expressions are compiled once and not for each column
    cells, cell = rows.unpivot([], list(rows.columns), "name", "cell"), F.col("cell")
    cells = cells.withColumn("plain", plain_types(cell))
    plain = F.col("plain")
    other = F.substring(cell, 1, 1).isin("N", "i", "I", "-") & cell.rlike(_NO_NUMBER)
    counted = cells.groupBy("name").agg(F.bit_and(plain).alias("types"), F.count_if(cell.isNotNull() & ~other).alias("n"), F.count_if(plain.isNull()).alias("open"))
    found = {r.name: r for r in counted.collect()}
    types = {c: ANY_TYPE if r.types is None else r.types for c, r in found.items()}
    if left := [c for c, r in found.items() if r.open and types[c]]:
        for r in cells.where(F.col("name").isin(left) & plain.isNull()).groupBy("name").agg(F.bit_and(cell_types(cell)).alias("types")).collect():
            types[r.name] &= r.types
    return [next((t for t, bit in CSV_TYPES if c in found and found[c].n and types[c] & bit), "string") for c in rows.columns]


def _typed(c: Column, kind: str) -> Column:
    """A cell as ``kind``; null where it does not parse.  The suffixes D and F,
    which Spark takes as part of a number, do not."""
    return c if kind == "string" else F.when(~c.rlike("[dDfF]$") | c.rlike(_NO_NUMBER) | (F.lit(kind) == "boolean"), c.try_cast(kind))


def read_csv(spark: SparkSession, path: str, sample_rows: int | None = None, multi_line: bool | None = None) -> DataFrame:
    """Header CSV with inferred types.  The typed rows are written once, so that
    what reads them often does not parse the text again."""
    text, joined = _cells(spark, path, multi_line)
    names, root = text.columns, stage_dir(spark)
    flat = text.toDF(*[f"c{i}" for i in range(len(names))])
    if joined:  # records are put together once
        flat = materialize(flat, f"{root}/text")
    types = infer_csv_types(flat, sample_rows)
    typed = flat.select(*[_typed(F.col(c), t).alias(c) for c, t in zip(flat.columns, types, strict=True)])
    return (materialize(typed, f"{root}/typed") if names else typed).toDF(*names)


def csv_nulled_cells(spark: SparkSession, path: str, sample_rows: int | None = None, multi_line: bool | None = None) -> DataFrame:
    """(column, type, nulled): cells of each column that lose their text to the
    inferred type (none unless types come from a sample)."""
    text = csv_text(spark, path, multi_line)
    types = infer_csv_types(text, sample_rows)
    flat = text.toDF(*[f"c{i}" for i in range(len(text.columns))])
    lost = [F.struct(F.lit(n).alias("column"), F.lit(t).alias("type"), F.count_if(F.col(c).isNotNull() & _typed(F.col(c), t).isNull()).alias("nulled"))
            for n, c, t in zip(text.columns, flat.columns, types, strict=True)]
    return flat.agg(F.array(*lost).alias("a")).select(F.inline("a"))


def suffix_of(path: str) -> str:
    base = path.rstrip("/")
    return os.path.splitext(base)[1].lower()


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Reader by lower-cased suffix; other suffixes raise ValueError.
    (Excel is not read on Spark: convert it upstream, see README.)"""
    suf = suffix_of(path)
    if suf == ".csv":
        return read_csv(spark, path)
    if suf in READERS:
        return spark.read.format(READERS[suf]).load(path)
    raise ValueError(f"Unsupported file type: {suf}")


def write_reports(reports: DataFrame, path: str, as_json: bool = False) -> None:
    """Persist reports as Parquet structs, or as one JSON document per
    line (``to_json`` omits nulls and writes NaN as "NaN")."""
    if as_json:
        reports.select(F.to_json(F.struct(*reports.columns)).alias("value")).write.mode("overwrite").text(path)
    else:
        reports.write.mode("overwrite").parquet(path)

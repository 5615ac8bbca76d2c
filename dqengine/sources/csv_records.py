"""Records of CSV files whose quoted fields hold line ends, read by many tasks.

A line end inside quotes does not end a record, and whether a byte lies inside
quotes depends on everything before it.  So the files are read in two steps,
both over Spark's ordinary byte ranges (splits) of lines:

1. each split is a function of two states: given that it begins outside or
   inside quotes, how does it end?  Such a function keeps, swaps or fixes the
   state, and functions compose; a window over the splits of each file (a row
   for each, not for each line) finds the last that fixes it and the swaps since,
   and with them the state in which every split begins;
2. each split joins its lines to records from that state on.  What it holds of a
   record that began before it, or goes on after it, are fragments, at most two
   a split; fragments of one record are joined by a grouped concatenation.

Tasks get the places of the splits that begin inside quotes: at most one number
for each split, some 50 bytes for 128 MB of input.

A field is quoted if it begins with a quote; inside, two quotes are one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPLITS = "file string, start long, ends_inside boolean, ends_inside_if_inside boolean, across boolean, across_if_inside boolean"
PARTS = "file string, start long, nth long, part string, record binary"


def ends_inside(line: bytes, inside: bool) -> bool:
    """Whether a quoted field is open at the end of the line, given whether one
    is open at its beginning."""
    at = 0
    while True:
        if inside:
            at = line.find(b'"', at)
            while at != -1 and line[at + 1:at + 2] == b'"':
                at = line.find(b'"', at + 2)
            if at == -1:
                return True
            at = line.find(b",", at + 1) + 1
            if not at:
                return False
        if line[at:at + 1] == b'"':
            at += 1
        else:
            at = line.find(b',"', at) + 2
            if at == 1:
                return False
        inside = True


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line with the file and split it stands in."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[bytes]]]:
    """A task's lines, one split after another."""
    now, todo = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        lines, last = batch.column("line").to_pylist(), batch.num_rows - 1
        ends = [(batch.column("file")[i].as_py(), batch.column("start")[i].as_py()) for i in (0, last)]
        if ends[0] == ends[1]:  # a split's lines follow one another
            if todo and now != ends[0]:
                yield now, todo
                todo = []
            now = ends[0]
            todo += lines
            if len(todo) >= 4096:
                yield now, todo
                todo = []
            continue
        files, starts = batch.column("file").to_pylist(), batch.column("start").to_pylist()
        for key, line in zip(zip(files, starts, strict=True), lines, strict=True):
            if key != now:
                if todo:
                    yield now, todo
                now, todo = key, []
            todo.append(line)
            if len(todo) >= 4096:
                yield now, todo
                todo = []
    if todo:
        yield now, todo


def split_states(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, inside, across): for each split whether it begins inside
    quotes, and whether any of its lines then ends inside quotes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], list[bool]] = {}
        for key, lines in _by_split(batches):
            state = seen.setdefault(key, [False, True, False, False])
            for line in lines:
                if b'"' in line:
                    state[0], state[1] = ends_inside(line, state[0]), ends_inside(line, state[1])
                state[2] |= state[0]
                state[3] |= state[1]
        rows = [(*k, *v) for k, v in seen.items()] or [(None,) * 6]
        names = ["file", "start", "ends_inside", "ends_inside_if_inside", "across", "across_if_inside"]
        types = [pa.string(), pa.int64(), *[pa.bool_()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    splits = _lines(spark, path).mapInArrow(scan, SPLITS).where("file IS NOT NULL")
    order = Window.partitionBy("file").orderBy("start")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    out, held = F.col("ends_inside"), F.col("ends_inside_if_inside")
    swaps = F.coalesce(F.sum(F.when(out & ~held, 1).otherwise(0)).over(earlier), F.lit(0))
    numbered = splits.withColumn("swaps", swaps)
    # a split that ends alike from both states fixes it; no swap counts before it
    fixed = F.last(F.when(out == held, F.struct(out.alias("state"), F.col("swaps").alias("swaps"))), ignorenulls=True).over(earlier)
    since = F.col("swaps") - F.coalesce(F.col("fixed.swaps"), F.lit(0))
    inside = F.coalesce(F.col("fixed.state"), F.lit(False)) != (since % 2 == 1)
    known = numbered.withColumn("fixed", fixed).withColumn("inside", inside)
    return known.select("file", "start", "inside", F.when(F.col("inside"), F.col("across_if_inside")).otherwise(F.col("across")).alias("across"))


def csv_records(spark: SparkSession, path: str, states: DataFrame) -> DataFrame:
    """(record): the text of every record but the first of each file (the
    header), without the line end; empty lines between records are left out."""
    inside_from = {(r.file, r.start) for r in states.where("inside").select("file", "start").collect()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, inside, kept, nth, part = None, False, [], 0, "whole"
        out: list[tuple] = []

        def rows() -> pa.RecordBatch:
            types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            columns = zip(*out, strict=True) if out else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["file", "start", "nth", "part", "record"])

        def rest() -> None:
            if kept:  # a record that goes on in the next split
                out.append((*key, nth, "tail" if part == "whole" else "through", b"\n".join(kept)))

        for own, lines in _by_split(batches):
            if own != key:
                if key is not None:
                    rest()
                key, inside, kept, nth = own, own in inside_from, [], 0
                part = "head" if inside else "whole"
            for line in lines:
                inside = ends_inside(line, inside) if b'"' in line else inside
                kept.append(line)
                if not inside:
                    record = b"\n".join(kept).removesuffix(b"\r")
                    if record or part != "whole":
                        out.append((*key, nth, part, record))
                        nth += 1
                    kept, part = [], "whole"
            yield rows()
            out.clear()
        if key is not None:
            rest()
        yield rows()

    parts = _lines(spark, path).mapInArrow(cut, PARTS)
    whole = parts.where("part = 'whole' AND NOT (start = 0 AND nth = 0)").select("record")
    pieces = parts.where("part <> 'whole'").select("file", "start", "part", "record", ((F.col("start") == 0) & (F.col("nth") == 0)).alias("header"))
    order = Window.partitionBy("file").orderBy("start", F.when(F.col("part") == "tail", 1).otherwise(0))
    opened = F.last(F.when(F.col("part") == "tail", F.col("start")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    joined = (pieces.withColumn("opened", opened).groupBy("file", "opened")
                    .agg(F.bool_or("header").alias("header"), F.array_sort(F.collect_list(F.struct("start", F.col("record").cast("string").alias("record")))).alias("p"))
                    .where("NOT header").select(F.array_join("p.record", "\n").cast("binary").alias("record")))
    return whole.unionByName(joined)

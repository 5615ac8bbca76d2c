"""CSV scan with a sampled schema, suffix dispatch, file admission."""

import math

import pytest

from dqengine.operators.catalog import admit_files
from dqengine.sources.files import csv_nulled_cells, read_any, read_csv


def test_csv_permissive(spark, tmp_path):
    lines = ["id,b,d,mix,n,e",
             "1,true,2024-01-02,10,1.5,a",
             "2,false,2024-01-03,11,NaN,",
             "3,true,2024-01-04,12,2.5,c",
             "4,false,2024-01-05,13,3.5,d",
             "5,true,2024-01-06,x,4.5,e",
             "6,false",
             "7,true,2024-01-08,15,5.5,g,extra"]
    p = tmp_path / "t.csv"
    p.write_text("\n".join(lines) + "\n")
    df = read_csv(spark, str(p), sample_rows=4)
    types = dict(df.dtypes)
    assert types["id"] == "bigint" and types["b"] == "boolean" and types["mix"] == "bigint"
    assert types["n"] == "double" and types["d"] == "string" and types["e"] == "string"
    rows = {r.id: r for r in df.collect()}
    assert rows[5].mix is None                       # unparsable -> null
    assert rows[2].e is None                         # empty -> null
    assert math.isnan(rows[2].n)                     # NaN kept
    assert rows[6].b is False and rows[6].mix is None and rows[6].e is None  # short row padded
    assert rows[7].e == "g"                          # extra field dropped
    assert len(rows) == 7
    assert {r.column: r.nulled for r in csv_nulled_cells(spark, str(p), sample_rows=4).collect()} == {"id": 0, "b": 0, "d": 0, "mix": 1, "n": 0, "e": 0}
    whole = read_csv(spark, str(p))                  # all rows decide: nothing is lost
    assert dict(whole.dtypes)["mix"] == "string" and [r.mix for r in whole.collect()][4] == "x"
    assert sum(r.nulled for r in csv_nulled_cells(spark, str(p)).collect()) == 0


def test_csv_quotes_and_large_integers(spark, tmp_path):
    p = tmp_path / "q.csv"
    body = "".join(f'"row {i}",{i}\n' for i in range(300))
    p.write_text('text,n\n"He said ""hi"", ok",1\n"two\nlines",2\n' + body + "last,3000000000\n")
    df = read_csv(spark, str(p))
    rows = df.collect()
    assert dict(df.dtypes) == {"text": "string", "n": "bigint"} and len(rows) == 303
    assert rows[0].text == 'He said "hi", ok' and rows[1].text == "two\nlines" and rows[-1].n == 3000000000


def test_dispatch(spark, tmp_path):
    p = tmp_path / "x.parquet"
    spark.range(3).write.parquet(str(p))
    assert read_any(spark, str(p)).count() == 3
    with pytest.raises(ValueError):
        read_any(spark, str(tmp_path / "x.txt"))


def test_admission(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x\n1\n")
    (tmp_path / "b.TXT").write_text("x\n")
    got = {r.path.rsplit("/", 1)[-1]: r.admitted for r in admit_files(spark, str(tmp_path)).collect()}
    assert got == {"a.csv": True, "b.TXT": False}


#: Columns of cells, and the type that keeps them all.
KEPT = {
    "flag": (["Y", "N", "Y", "N"], "string"), "tf": (["T", "F", "T", "T"], "string"), "bool": (["true", "false", "true", "true"], "boolean"),
    "title": (["True", "False", "True", "True"], "boolean"), "mixed": (["true", "False", "TRUE", "false"], "string"),
    "suffix": (["10D", "20F", "1", "2"], "string"), "zip": (["00501", "10001", "02134", "90210"], "string"), "plus": (["+49", "+1", "+33", "+7"], "string"),
    "wide": (["12345678901234567890", "12345678901234567891", "12345678901234567892", "-1"], "decimal(38,0)"),
    "wider": (["1" * 39, "2", "3", "4"], "string"), "huge": (["1e400", "1", "2", "3"], "string"), "tiny": (["1e-400", "1", "2", "3"], "string"),
    "long": (["9223372036854775807", "-9223372036854775808", "0", "1"], "bigint"), "money": (["10.50", "0.10", "-3.00", "7"], "double"),
    "exp": (["1e5", "2.5E-3", "-1e+10", "0"], "double"), "precise": (["0.30000000000000004", "1.1", "2.2", "5e-10"], "double"),
    "digits": (["0.12345678901234567890", "1.1", "2.2", "3.3"], "string"), "nan": (["NaN", "1.5", "-inf", "2"], "double"), "words": (["NaN", "inf", "NaN", "inf"], "string"),
    "date": (["2024-01-02", "2024-01-03", "2024-01-04", "2024-01-05"], "string"), "dotted": ([".5", "5.", "1.5", "-.5"], "double"), "minus": (["-0", "-00", "1", "2"], "string"),
}


def test_csv_types_change_nothing(spark, tmp_path):
    import csv
    p = tmp_path / "kept.csv"
    with open(p, "w", newline="") as f:
        csv.writer(f).writerows([list(KEPT), *zip(*(c for c, _ in KEPT.values()), strict=True)])
    df = read_csv(spark, str(p))
    assert dict(df.dtypes) == {n: t for n, (_, t) in KEPT.items()}
    rows = df.collect()
    for name, (cells, kind) in KEPT.items():
        for row, cell in zip(rows, cells, strict=True):
            got = row[name]
            if kind == "string":
                assert got == cell
            elif kind == "double":
                assert repr(got) == repr(float(cell)) and (math.isnan(got) or got == float(cell))
            elif kind == "boolean":
                assert got is (cell.lower() == "true")
            else:
                assert str(got) == cell
    assert sum(r.nulled for r in csv_nulled_cells(spark, str(p)).collect()) == 0


def _files(rnd, folder, names, rows_each):
    """CSV files with line ends, quotes, commas, empty fields and blank lines in odd places."""
    import csv
    pieces = ["a", "b c", "", "x,y", 'say ""', '"', "line\nend", "\n", "two\n\nlines\n", "crlf\r\nin", "tail,", '5" disk', "é日", "long " * 30]
    want = []
    for name in names:
        with open(folder / name, "w", newline="") as f:
            w = csv.writer(f, lineterminator=rnd.choice(["\n", "\r\n"]))
            w.writerow(["k", "first\ncolumn", "third"])
            for i in range(rows_each):
                row = [f"{name}{i}", "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 4))), rnd.choice(pieces)]
                w.writerow(row)
                want.append(tuple(x or None for x in row))
                if rnd.random() < 0.05:
                    f.write("\n")
    return want


@pytest.mark.parametrize("size", [150, 700, 1 << 20])
def test_quoted_line_ends_in_many_splits(spark, tmp_path, size):
    import random

    from dqengine.sources.files import csv_text
    want = _files(random.Random(size), tmp_path, ["one.csv", "two.csv"], 90)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = csv_text(spark, str(tmp_path))
        assert got.columns == ["k", "first\ncolumn", "third"]
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
        if size == 700:
            from dqengine.sources.csv_records import split_states
            states = split_states(spark, str(tmp_path)).collect()
            assert len(states) >= 8 and any(r.inside for r in states) and not all(r.inside for r in states)
            assert got.rdd.getNumPartitions() >= 8
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_field_longer_than_splits(spark, tmp_path):
    from dqengine.sources.files import csv_text
    field = "line of the field\n" * 400
    (tmp_path / "f.csv").write_text('a,b\n1,"' + field + '"\n2,x\n3,"' + field + 'end"\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = csv_text(spark, str(tmp_path / "f.csv")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(map(tuple, got)) == [("1", field), ("2", "x"), ("3", field + "end")]


def test_line_states():
    from dqengine.sources.csv_records import ends_inside
    for line, out, held in [(b"a,b", False, True), (b'"a', True, False), (b'a,"b', True, False), (b'"a"', False, False), (b'5" x,y', False, False),
                            (b'"a ""b', True, False), (b'"",x', False, True), (b'', False, True), (b'x","y', True, True), (b'""', False, True)]:
        assert (ends_inside(line, False), ends_inside(line, True)) == (out, held), line

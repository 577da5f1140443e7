"""CSV files cut into records, and rows numbered without loss."""

import csv
import io

import pytest
from pyspark.sql import functions as F

from corvane.operators import manifest
from corvane.sources import corpus
from corvane.sources.records import csv_records

HEAD = "Date added,Trial ID,Title,Brief title,Abstract,Publication date,Phase"


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


@pytest.mark.parametrize("block", [64, 200, 1000, 1 << 20])
def test_records_of_any_block_size(spark, tmp_path, block):
    """Quoted line ends, doubled quotes and long records, wherever the blocks are cut."""
    rows = [["2020-01-01", f"NCT{i:08d}", 'He said "no"' if i % 3 else "plain", "", f"line one {i}\nline, two\n\nline three" * (1 + 40 * (i == 7)), "2020-02-02", "N/A"] for i in range(60)]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([HEAD.split(","), *rows])
    path = write(tmp_path / "a.csv", out.getvalue())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        got = csv_records(spark, path).orderBy("file", "block", "nth").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [next(csv.reader(io.StringIO(r["raw"]))) for r in got] == [HEAD.split(","), *rows]
    assert [r["header"] for r in got] == [True] + [False] * 60


def test_an_open_quote_damages_one_record(spark, tmp_path):
    good = '2020-01-0{0},NCT0000000{0},T{0},,"an abstract\nof two lines",2020-02-02,N/A'
    lines = [HEAD, good.format(1), '2020-01-02,NCT00000002,"open,,abstract,2020-02-02,N/A', good.format(3), '2020-01-02,NCT00000006,"open,,abstract,2020-02-02,N/A', "2020-01-07,odd id,T7,,abstract,2020-02-02,", "2020-01-04,NCT00000004,few", good.format(5), ""]
    rows, bad = corpus.read_csv_parts(spark, write(tmp_path / "b.csv", "\n".join(lines)))
    assert sorted(r["trial_id"] for r in rows.collect()) == ["NCT00000001", "NCT00000003", "NCT00000005", "odd id"]
    assert {r["abstract"] for r in rows.collect()} == {"an abstract\nof two lines", "abstract"}
    assert sorted((r["reason"], r["raw"][:22]) for r in bad.collect()) == [("column_count", "2020-01-04,NCT00000004"), ("quoting", "2020-01-02,NCT00000002"), ("quoting", "2020-01-02,NCT00000006")]


def test_numbered_keeps_every_row(spark):
    t = spark.createDataFrame([("x", None)] * 50 + [(None, "x"), ("x", ""), ("x", None), ("1:a", "b"), ("1", ":ab")], "title string, abstract string")
    got = corpus.numbered(t.repartition(5))
    assert sorted(r["row_id"] for r in got.collect()) == list(range(55))
    again = corpus.numbered(t.repartition(3))
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))
    assert corpus.numbered(t.limit(0)).count() == 0


def test_fingerprints_see_nulls(spark, tmp_path):
    f = lambda rows: manifest.table_fingerprint(spark.createDataFrame(rows, "a string, b string")).first()[0]
    assert len({f([("x", None)]), f([(None, "x")]), f([("x", "")]), f([("x", None)] * 2), f([])}) == 5
    assert f([("a", "b"), ("c", None)]) == f([("c", None), ("a", "b")])
    one, two = write(tmp_path / "c.csv", "a\nb\n"), write(tmp_path / "d.csv", "a\nc\n")
    assert manifest.file_fingerprint(spark, one) != manifest.file_fingerprint(spark, two)
    with pytest.raises(manifest.CorpusNotFoundError):
        manifest.file_fingerprint(spark, str(tmp_path / "none.csv"))

import os

import pytest
from pyspark.sql import functions as F

from flowlens.operators.drift import drift
from flowlens.sources import captures, sinks


def put(folder, name, content, encoding="utf-8"):
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "w", encoding=encoding, newline="") as f:
        f.write(content)
    return path


def test_missing_and_empty(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        captures.read_flows(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError, match="no data rows"):
        captures.read_flows(spark, put(tmp_path, "head.csv", "a,b\n"))
    with pytest.raises(ValueError, match="no data rows"):
        captures.read_flows(spark, put(tmp_path, "empty.csv", ""))


def test_null_tokens_and_padding(spark, tmp_path):
    path = put(tmp_path, "a.csv", " Proto,Service \nNA, tcp \n-,null\n")
    rows = captures.read_flows(spark, path).collect()
    assert [tuple(r) for r in rows] == [(None, " tcp "), ("-", None)]
    assert rows[0].__fields__ == ["proto", "service"]


def test_duplicate_headers_keep_first(spark, tmp_path):
    path = put(tmp_path, "a.csv", "Sbytes,sbytes,x\n1,2,3\n")
    got = captures.read_captures(spark, [path])
    assert [tuple(r) for r in got.table().collect()] == [("1", "3")]
    assert got.table().columns == ["sbytes", "x"] and "['sbytes']" in got.warnings[0]


def test_auto_encoding_per_file(spark, tmp_path):
    a = put(tmp_path, "a +%41 b.csv", "x\nné\n", "latin-1")
    b = put(tmp_path, "b.csv", "x\nñu\n", "utf-8")
    assert sorted(r["x"] for r in captures.read_many(spark, [a, b]).collect()) == ["né", "ñu"]


def test_short_lines_pad_and_long_lines_break(spark, tmp_path):
    short = put(tmp_path / "d +%41 e", "short.csv", "a,b,c\n1,2\n3,4,5\n")
    long = put(tmp_path / "d +%41 e", "long.csv", 'a,b,c\n1,2,3\n4,5,6,\n"x,y",1,2\n')
    put(tmp_path / "d +%41 e", "notes.txt", "a,b,c\n9,9,9\n")
    assert sorted(tuple(r) for r in captures.read_flows(spark, short).fillna("").collect()) == [("1", "2", ""), ("3", "4", "5")]
    kept = captures.read_dirs(spark, [str(tmp_path / "d +%41 e"), str(tmp_path / "nowhere")])
    assert kept.count() == 2
    assert captures.read_captures(spark, ["file:" + short, "file:" + long], on_error="skip").skipped == ["file:" + long]
    with pytest.raises(Exception, match="Line longer than the header"):
        captures.read_flows(spark, long).collect()
    with pytest.raises(Exception, match="Line longer than the header"):
        captures.read_flows(spark, long).count()


def test_ignoring_long_lines(spark, tmp_path):
    path = put(tmp_path, "long.csv", "a,b\n1,2\n3,4,5\n6\n")
    df = captures.read_flows(spark, path, on_error="ignore")
    assert sorted(tuple(r) for r in df.fillna("").collect()) == [("1", "2"), ("3", "4"), ("6", "")]
    assert sorted(r["b"] or "" for r in df.select("b").collect()) == ["", "2", "4"] and df.count() == 3


def test_quoted_comma_is_not_a_long_line(spark, tmp_path):
    path = put(tmp_path, "q.csv", 'a,b\n"x,y",1\n')
    assert tuple(captures.read_flows(spark, path).first()) == ("x,y", "1")


def test_nothing_loaded(spark, tmp_path):
    with pytest.raises(ValueError, match="No files were loaded"):
        captures.read_many(spark, [str(tmp_path / "x.csv")])
    with pytest.raises(ValueError, match="No CSV files"):
        captures.read_dirs(spark, [str(tmp_path)])
    with pytest.raises(FileNotFoundError):
        captures.read_many(spark, [str(tmp_path / "x.csv")], missing="raise")


def test_headers_by_tasks_equal_headers_by_spark(spark, tmp_path):
    names = [put(tmp_path / "many +files%41", f"f{i}.csv", f"\n A{i % 3} ,é\r\n1,2\n") for i in range(7)]
    names.append(put(tmp_path / "many +files%41", "blank.csv", "\n\n"))
    paths = captures.list_files(spark, str(tmp_path / "many +files%41"))
    assert len(paths) == len(names)
    assert len(captures._headers_by_tasks(spark, paths, {})) == len(paths)
    assert captures.read_headers(spark, paths) == {p: captures.read_header(spark, p) for p in paths}
    assert captures.read_flows(spark, str(tmp_path / "many +files%41")).count() == 7


@pytest.mark.parametrize("count", [3, 70])
@pytest.mark.parametrize("encoding", ["utf-8", "iso-8859-1", "ISO-8859-1"])
def test_headers_do_not_depend_on_the_number_of_files(spark, tmp_path, count, encoding):
    for i in range(count):
        put(tmp_path / "in", f"f{i}.csv", "né,b\né,2\n", encoding)
    df = captures.read_flows(spark, str(tmp_path / "in"), encoding=encoding)
    assert df.columns == ["né", "b"] and df.where("b = '2'").count() == count
    assert {r["né"] for r in df.collect()} == {"é"}


def test_quotes_in_quoted_text(spark, tmp_path):
    path = put(tmp_path, "q.csv", 'a,b\n"x ""y, z"" w",1\n"""",2\n')
    assert [tuple(r) for r in captures.read_flows(spark, path).collect()] == [('x "y, z" w', "1"), ('"', "2")]
    df = spark.createDataFrame([('x "y, z" w', "DoS")], "a string, predicted_attack string")
    sinks.write_predictions(df, str(tmp_path / "p"))
    assert tuple(captures.read_predictions(spark, str(tmp_path / "p")).first()) == ('x "y, z" w', "DoS")


def test_line_breaks_in_quoted_text(spark, tmp_path):
    path = put(tmp_path, "n.csv", 'a,b\n"x\ny",1\nz,2\n')
    assert [tuple(r) for r in captures.read_flows(spark, path).collect()] == [("x\ny", "1"), ("z", "2")]
    long = put(tmp_path, "l.csv", 'a,b\n"x\ny",1,2\nz,2\n')
    with pytest.raises(Exception, match="Line longer than the header"):
        captures.read_flows(spark, long).collect()
    kept = captures.read_captures(spark, ["file:" + path, "file:" + long], on_error="skip")
    assert kept.skipped == ["file:" + long] and kept.table().count() == 2
    with pytest.raises(ValueError, match="do not pair up"):
        captures.read_flows(spark, put(tmp_path, "open.csv", 'a,b\n"x,1\nz,2\n'))


def test_what_is_left_out_is_reported(spark, tmp_path):
    good = put(tmp_path / "d", "good.csv", "a,b\n1,2\n")
    put(tmp_path / "d", "long.csv", "a,b\n1,2\n3,4,5\n")
    put(tmp_path / "d", "blank.csv", "\n")
    found = captures.open_dirs(spark, [str(tmp_path / "d"), str(tmp_path / "gone")])
    assert {os.path.basename(p): why for p, why in found.reasons.items()} == {
        "gone": "no CSV files", "long.csv": "Line longer than the header", "blank.csv": "no header",
    }
    with pytest.warns(UserWarning, match="gone: no CSV files"):
        assert found.table().count() == 1
    with pytest.warns(UserWarning, match="x.csv: not found"):
        captures.read_many(spark, [good, str(tmp_path / "x.csv")])


def test_predictions_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(" a ", "DoS")], "x string, predicted_attack string")
    assert sinks.write_predictions(df, str(tmp_path / "p"))
    assert tuple(captures.read_predictions(spark, str(tmp_path / "p")).first()) == (" a ", "DoS")
    assert not sinks.write_predictions(df.drop("predicted_attack"), str(tmp_path / "q"))
    assert not (tmp_path / "q").exists()
    with pytest.raises(ValueError, match="predicted_attack"):
        captures.read_predictions(spark, put(tmp_path, "r.csv", "x\n1\n"))


def test_drift_file_has_three_columns(spark, tmp_path):
    train = spark.createDataFrame([("a", 1.0)], "class string, share double")
    verdict = drift(train, train.select(F.col("class").alias("p")), "p")
    sinks.write_drift(verdict, str(tmp_path / "d +%41 e"))
    back = captures.read_flows(spark, str(tmp_path / "d +%41 e"))
    assert back.columns == ["js_distance", "threshold", "drift_status"]
    assert tuple(back.first()) == ("0.0", "0.2", "No Concept Drift Detected")

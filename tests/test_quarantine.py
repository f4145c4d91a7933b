import pytest

from flowlens.sources.quarantine import ODD_QUOTES, TOO_LONG, _number, land_captures, take_back


def write(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, content in files.items():
        (folder / f"{name}.csv").write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(folder)


def kept(landing):
    out = []
    for t in landing.captures.tables:
        for r in t.collect():
            row = r.asDict()
            row["source_file"] = row["source_file"].rsplit("/", 1)[1]
            out.append(tuple(sorted(row.items())))
    return sorted(out, key=repr)


def rejected(landing):
    return sorted((r["source_file"].rsplit("/", 1)[1], r["line_number"], r["reason"], r["raw"]) for r in landing.rejected.collect())


def row(name, **values):
    return tuple(sorted({"source_file": f"{name}.csv", **values}.items()))


def test_good_and_bad_lines_of_one_file(spark, tmp_path):
    folder = write(
        tmp_path / "d",
        one="﻿\n A,B\n1,2\n3,4,5\n\n6\n\"7,8\",\"9\"\"\"\nx\"y,1\n",
        two="b,c\nNA,-\n",
        three=b"a,b\ncaf\xe9,2\n",
        empty="",
        blank="\n \n",
    )
    landing = land_captures(spark, [folder, str(tmp_path / "gone")])
    assert kept(landing) == sorted(
        [row("one", a="1", b="2"), row("one", a="6", b=None), row("one", a="7,8", b='9"'), row("two", b=None, c="-"), row("three", a="café", b="2")],
        key=repr,
    )
    assert rejected(landing) == [("one.csv", 4, TOO_LONG, "3,4,5"), ("one.csv", 8, ODD_QUOTES, 'x"y,1')]
    assert landing.captures.reasons == {str(tmp_path / "gone"): "no CSV files"}
    ledger = {r["path"].rsplit("/", 1)[1]: r for r in landing.ledger.collect()}
    assert set(ledger) == {"one.csv", "two.csv", "three.csv"}
    assert (ledger["one.csv"]["lines"], ledger["one.csv"]["rows"], ledger["one.csv"]["longest"]) == (8, 5, 3)
    assert ledger["three.csv"]["latin"] and not ledger["one.csv"]["latin"]


def test_corrected_lines_come_back(spark, tmp_path):
    landing = land_captures(spark, [write(tmp_path / "d", one="a,b\n1,2,3\n4,5,6\n", two="c\n7,8\n")])
    mended = [(r["source_file"], r["line_number"], r["raw"].rsplit(",", 1)[0] if r["raw"] != "4,5,6" else "4,5,6,7", "z") for r in landing.rejected.collect()]
    corrected = spark.createDataFrame([*mended, ("unknown.csv", 1, "1", "z")], "source_file string, line_number long, raw string, header_id string")
    back = take_back(landing, corrected)
    assert kept(back) == sorted([row("one", a="1", b="2"), row("two", c="7")], key=repr)
    assert rejected(back) == [("one.csv", 3, TOO_LONG, "4,5,6,7")]


def test_records_over_several_lines(spark, tmp_path):
    landing = land_captures(spark, [write(tmp_path / "d", one='a,b\n"x\ny",2\n1,2,3\n', two="a,b\n5,6\n")])
    assert kept(landing) == sorted([row("one", a="x\ny", b="2"), row("two", a="5", b="6")], key=repr)
    assert [(r[0], r[1], r[2]) for r in landing.rejected.select("line_number", "reason", "raw").collect()] == [(None, TOO_LONG, "1,2,3")]


def test_numbers_in_large_files_read_in_blocks(spark, tmp_path):
    """Line numbers count across the blocks that tasks read."""
    lines = [f"{i},{'x' * (i % 50)}" + (",more" if i % 97 == 0 else "") for i in range(2, 20_002)]
    folder = write(tmp_path / "d", big="a,b\n" + "\n".join(lines) + "\n", small="a,b\n1,2,3\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        landing = land_captures(spark, [folder])
        got = rejected(landing)
        assert landing.captures.tables[0].count() == 20_000 - sum(i % 97 == 0 for i in range(2, 20_002))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted([("big.csv", i, TOO_LONG, lines[i - 2]) for i in range(2, 20_002) if i % 97 == 0] + [("small.csv", 2, TOO_LONG, "1,2,3")])


def test_many_small_files_by_shuffle(spark, tmp_path, monkeypatch):
    """More files than a broadcast may have rows: the same rows, and only headers reach the driver."""
    from flowlens.operators import shared
    from flowlens.sources import quarantine

    folder = write(tmp_path / "d", **{f"f{i}": f"a,{'b' if i % 2 else 'c'}\n{i},1\n{i},2,3\n" for i in range(60)})
    monkeypatch.setattr(quarantine, "checked_lookup", lambda df: shared.checked_lookup(df, 5))
    landing = land_captures(spark, [folder])
    assert len(landing.captures.tables) == 2 == len(landing.headers)
    assert {r[0][1] for r in kept(landing)} == {str(i) for i in range(60)}
    assert [r[1:3] for r in rejected(landing)] == [(3, TOO_LONG)] * 60


def test_nothing_to_read(spark, tmp_path):
    with pytest.raises(ValueError, match="No CSV files"):
        land_captures(spark, [str(tmp_path / "gone")])


def test_numbering_goes_on_over_batches():
    import pyarrow as pa

    def batch(paths, blocks):
        n = len(paths)
        columns = [pa.array(paths), pa.array(blocks, pa.int64()), pa.array([b""] * n, pa.binary()), pa.array([True] * n)]
        return pa.record_batch([*columns, pa.array([0] * n, pa.int32()), pa.array([1] * n, pa.int32())], ["path", "block", "value", "utf8", "quotes", "fields"])

    got = [b.column("at").to_pylist() for b in _number(iter([batch(["a", "a", "a"], [0, 0, 9]), batch(["a", "a", "b"], [9, 9, 9]), batch(["b"], [9])]))]
    assert got == [[0, 1, 0], [1, 2, 0], [1]]

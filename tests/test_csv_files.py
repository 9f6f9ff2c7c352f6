"""CSV files with preambles and headers of their own."""

import pytest

from ringdata.sources import files


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def write(folder, **texts):
    for name, text in texts.items():
        (folder / f"{name}.csv").write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(folder)


def test_two_files_with_different_preambles_and_headers(spark, tmp_path):
    path = write(
        tmp_path,
        a="﻿Report of calls,,\nMobile_No,,\n\nMobile_No,Other_Party_No,Call_Date\n1,2,01/06/2026\nReport of calls,,\n\nMobile_No,Other_Party_No,Call_Date\n",
        b='receiver_id,caller_id,note\r\n9,8,"x, ""y"""\r\n7\r\n6,5, z ,extra\r\n',
    )
    got = files.read_records(spark, path)
    assert got.columns == ["Mobile_No", "Other_Party_No", "Call_Date", "receiver_id", "caller_id", "note"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [
        ("1", "2", "01/06/2026", None, None, None), ("Report of calls", "", "", None, None, None), ("Mobile_No", "Other_Party_No", "Call_Date", None, None, None),
        (None, None, None, "9", "8", 'x, "y"'), (None, None, None, "7", "", ""), (None, None, None, "6", "5", " z "),
    ]))


def test_header_by_required_columns(spark, tmp_path):
    # the second row has more known names, but no contact: the first with both required columns is the header
    path = write(tmp_path, a="x,y,z\ncall_date,duration_seconds,Mobile_No\ncaller_id,receiver_id,q\n1,2,3\n")
    assert rows(files.read_records(spark, path)) == [("1", "2", "3")]
    assert files.read_records(spark, path).columns == ["caller_id", "receiver_id", "q"]
    assert files.read_records(spark, path, "cdr", {"caller": "x", "receiver": "y"}).columns == ["x", "y", "z"]
    assert files.read_records(spark, write(tmp_path, a="skip\nsubscriber_id,port\n1,2\n"), "ipdr").columns == ["subscriber_id", "port"]


def test_no_header_and_short_files(spark, tmp_path):
    assert rows(files.read_records(spark, write(tmp_path, a="\np,q,p,\n1,2,3,4\n"))) == [("1", "2", "3", "4")]
    assert files.read_records(spark, str(tmp_path)).columns == ["p", "q", "p.2", "_c3"]
    late = "a,b\n" + "".join(f"{k},x\n" for k in range(150)) + "caller_id,receiver_id\n1,2\n"  # past the rows that may be a header
    assert files.read_records(spark, write(tmp_path, a=late)).count() == 152
    assert files.read_records(spark, write(tmp_path, a="caller_id,receiver_id\n")).collect() == []


def test_empty(spark, tmp_path):
    with pytest.raises(ValueError):
        files.read_records(spark, write(tmp_path, a=""))


def test_splits_after_the_first_have_no_header(spark, tmp_path):
    lines = [f"{k},{k + 1},{'x' * 50}" for k in range(20_000)]
    path = write(tmp_path, a="intro\ncaller_id,receiver_id,text\n" + "\n".join(lines) + "\n", b="text,receiver_id,caller_id\nq,2,1\n")
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, "100000")
    try:
        got = files.read_records(spark, path)
        assert got.rdd.getNumPartitions() > 8
        assert {tuple(r) for r in got.collect()} == {("1", "2", "q"), *(tuple(x.split(",")) for x in lines)}
        assert got.count() == 20_001
    finally:
        spark.conf.set(key, old)

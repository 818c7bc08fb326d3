import pytest

from codeloom.llm import arc_convert as arc
from codeloom.llm.common import new_folder
from tests.llm.helpers import PAGES, rows


def test_round_trip(spark):
    long = "<p>é&amp;\r\n\r\nWARC/1.1\r\nx</p>" * 60
    table = [(1, "http://a/ b", long), (2, "http://b", long), (3, None, "short"), (4, "", "short"), (5, "u", None), (5, "u", None), (None, "n", long), (8, "h", "x" * 2_000_000)]
    df = spark.createDataFrame(table, PAGES).withColumn("digest", arc.F.lit(7)).repartition(3)
    got = arc.archive_pages(df)
    assert rows(got, "id", "payload_bytes", "record_type", "refers_to") == sorted([
        (1, len(long.encode()), "revisit", 2), (2, len(long.encode()), "response", None), (3, 5, "response", None), (4, 5, "response", None),
        (5, 0, "response", None), (5, 0, "response", None), (None, len(long.encode()), "revisit", 2), (8, 2_000_000, "response", None)], key=repr)
    payloads = {r.id: bytes(r.payload) for r in got.filter("record_type = 'response'").collect()}
    assert payloads[2] == long.encode() and payloads[5] == b""
    assert {r.url for r in got.select("url").collect()} == {"http://a/%20b", "http://b", "-", "u", "n", "h"}
    assert len({r.record_id for r in got.select("record_id").collect()}) == 8


def test_empty_table(spark):
    assert arc.archive_pages(spark.createDataFrame([], PAGES)).count() == 0


def test_both_header_versions():
    for version in (1, 2):
        extra = "text/html 200 sum - 12 f.arc" if version == 2 else "text/html"
        data = (arc._version_block("f.arc", version) + f"http://x y/ 1.2.3.4 20200102030405 {extra} 5\nab\ncd\n\nhttp://z 1.2.3.4 20200102030405 {extra} 0\n\n").encode()
        first, second = arc.arc_records(data, "f")
        assert (first["URL"], first["body"], first["version"]) == ("http://x y/", b"ab\ncd", version)
        assert second["body"] == b"" and second["Archive-date"] == "20200102030405"


def test_damage_is_reported():
    data = arc._version_block("f.arc", 1).encode() + b"http://x 1.2.3.4 20200102030405 text/html 50\nshort"
    with pytest.raises(ValueError, match="f: damaged record at byte"):
        list(arc.arc_records(data, "f"))


def test_binary_payloads_survive(spark):
    folder = new_folder(spark, "binary")
    body = bytes(range(256)) * 8
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder + "/arc/one.arc")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(arc._version_block("one.arc", 1).encode() + b"ftp://x 1.2.3.4 20200102030405 image/gif %d\n" % len(body) + body + b"\n"))
    out.close()
    arc.convert(spark, folder + "/arc", folder + "/warc")
    (row,) = arc.read_warc(spark, folder + "/warc").collect()
    assert bytes(row.payload) == body and row.id is None and row.url == "ftp://x"

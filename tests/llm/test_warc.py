import hashlib

from pyspark.sql import functions as F

from kinetide.llm import warc


def build(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, key int").repartition(2)


def test_round_trip_with_magic_in_payloads(spark, tmp_path):
    fake = warc.MAGIC + "WARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    big = "é" * 900
    rows = [
        (1, "http://a/", big, "x", 1), (5, "http://b/\r\nX: y", big, "x", 1), (9, None, big, None, None), (2, "u", None, "x", 1), (3, "u", "", "x", 1),
        (4, "u", "short", "x", 1), (6, "u", "short", "x", 1), (7, "u", fake, "x", 1), (8, "u", "x" + fake + fake + "tail" + warc.MAGIC, "x", 1), (None, "u", "n", "x", 1),
        (10, "u", warc.END + fake * 40 + "z" * 5000, "x", 1),
    ]
    path = str(tmp_path / "w")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        warc.write_warc(build(spark, rows), path)
        got = {r["page_id"]: r for r in warc.read_warc(spark, path, payloads=True).collect()}
        plain = {r["page_id"]: r for r in warc.read_warc(spark, path).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == len(rows) == len(plain) and 99 not in got
    for key, _, html, *_ in rows:
        data = (html or "").encode()
        for r in (got[key], plain[key]):
            assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest()), key
        want = ("revisit", 9) if key in (1, 5) else ("response", None)
        assert (got[key]["record_type"], got[key]["refers_to"]) == want
        if want[0] == "response":
            assert bytes(got[key]["payload"]) == data


def test_junk_before_the_first_record_and_empty_tables(spark, tmp_path):
    spark.range(1).select(F.lit("junk" + warc.MAGIC + "Content-Length: 0\r\n\r\n").alias("value")).write.option("lineSep", warc.END).text(str(tmp_path / "j"))
    assert warc.read_warc(spark, str(tmp_path / "j")).count() == 0
    warc.write_warc(build(spark, []), str(tmp_path / "e"))
    assert warc.read_warc(spark, str(tmp_path / "e")).count() == 0


def test_files_split_otherwise_in_the_second_read(spark, tmp_path):
    fake = "x" + warc.MAGIC + "Content-Length: 3\r\n\r\nabc" + warc.MAGIC
    rows = [(k, "u", f"{k} {fake if k % 3 else ''} {'z' * 300}", "x", 1) for k in range(20)]
    path = str(tmp_path / "w")
    warc.write_warc(build(spark, rows), path)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
        found = warc.read_warc(spark, path, payloads=True)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1900b")
        got = {r["page_id"]: bytes(r["payload"] or b"").decode() for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {k: html for k, _, html, *_ in rows}

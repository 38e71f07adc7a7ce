"""WARC archives, written and read with Spark's text source alone; records are told from look-alikes by their chain.

A writer task puts one record per page into its file. A reader task cuts its block of a file at every magic and emits,
for each cut, the offset and the successor that the header's Content-Length points to. Payloads may hold the magic, so
these are only candidates: pointer jumping from each file's start keeps those the chain reaches. Cuts it doesn't reach
are payload of the record before them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, stored

#: Fixed values of the format (WARC 1.1).
MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
#: A digest's revisits are spread over so many join keys, as one page may hold a third of all rows.
SALTS = 16


def _roles(pages: DataFrame, least: int) -> DataFrame:
    """``pages`` (key, url, html, bytes, digest) with ``target``: the largest key among equal payloads of ``least`` bytes
    or more, null where there is no equal one.

    Only digests that occur twice are joined back. Their table is written first, so Spark knows its size and broadcasts
    it only below its own threshold; beyond, both sides are shuffled by digest and salt.
    """
    same = (
        pages.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.max("key").alias("target"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").select(F.col("digest").alias("d"), F.col("bytes").alias("b"), "target", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    salt = F.pmod(F.xxhash64("key", "url"), F.lit(SALTS)).cast("int")
    same = stored(same, "warc-same")
    return pages.withColumn("s", salt).join(same, (F.col("digest") == F.col("d")) & (F.col("bytes") == F.col("b")) & (F.col("s") == F.col("salt")), "left")


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000) -> None:
    """Write one record per row of ``pages`` below ``path``.

    Of rows with equal payloads of ``least`` bytes or more, that with the largest id is a response and the others are
    revisits of it; rows tied at that id are all responses. Null html is an empty payload, a null url gives no
    WARC-Target-URI (CR, LF are percent-encoded), a null id is written as ``<urn:page:null>`` and is the target only of
    other null ids. An empty table writes no record. Columns besides these three are not read.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("key"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumns({"bytes": F.octet_length("html").cast("bigint"), "digest": F.sha1(F.col("html").cast("binary"))})
    rows = _roles(rows, least).withColumn("again", F.col("target").isNotNull() & ~F.col("target").eqNullSafe(F.col("key")))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    rows = rows.withColumn("block", F.concat(http, F.when(F.col("again"), F.lit("")).otherwise(F.col("html"))))
    lines = [
        F.concat(F.lit("WARC-Type: "), F.when(F.col("again"), F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.col("key"))),
        F.when(F.col("again"), F.concat(F.lit("WARC-Refers-To: "), urn(F.col("target")))),
        F.when(F.col("again"), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string")),
    ]
    record = F.concat(F.lit(MAGIC), F.concat_ws("\r\n", *lines), F.lit(END), F.col("block"))
    rows.select(record.alias("value")).write.option("lineSep", END).text(path)


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract("head", rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def _cuts(spark: SparkSession, path: str) -> DataFrame:
    """What lies between magics, with its file, block and place in the block; blocks are read by any task."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value"
    )


def _same(value: str) -> Column:
    """What tells a cut's bytes from others, however the file was split."""
    return F.unhex(F.sha1(F.col(value).cast("binary")))


def _payload(block: Column) -> Column:
    """The bytes behind the HTTP header of a record's block."""
    return F.substring(block, F.instr(block.cast("string"), END) + len(END), F.octet_length(block))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """A row for each cut: file, block, at, same, off, next (null without a readable header), and what the header says.

    Blocks and places hold for this one read only; a second read is joined by ``same``."""
    head = F.substring_index("value", END, 1)
    cut = _cuts(spark, path).withColumns({"head": head, "len": F.octet_length("value").cast("bigint")})
    cut = cut.withColumns({"skip": F.octet_length("head") + len(END), "clen": F.expr("try_cast(" + "nullif(regexp_extract(head, '(?im)^Content-Length:[ \\\\t]*([0-9]+)[ \\\\t]*$', 1), '') AS bigint)")})
    whole = F.col("len") == F.col("skip") + F.col("clen") + len(END)
    raw = F.substring(F.col("value").cast("binary"), F.col("skip") + 1, F.col("clen").cast("int"))
    cut = cut.withColumn("payload", F.when(whole & (_field("WARC-Type") == "response"), _payload(raw)))
    cut = cut.select(
        "file", "block", "at", "len", "skip", "clen", whole.alias("whole"), _field("WARC-Type").alias("type"), _field("WARC-Record-ID").alias("id"), _field("WARC-Refers-To").alias("target"),
        _field("WARC-Target-URI").alias("url"), _field("WARC-Payload-Digest").alias("said"), F.regexp_extract("value", r"(?i)\r\n\r\nHTTP[^\r\n]*\r\n(?:[^\r\n]+\r\n)*?Content-Length:[ \t]*(\d+)", 1).alias("said_bytes"),
        F.sha1("payload").alias("digest"), F.octet_length("payload").cast("bigint").alias("bytes"), _same("value").alias("same"),
    )
    cut = stored(cut, "warc-cuts")
    size = F.col("len") + len(MAGIC)
    blocks = cut.groupBy("file", "block").agg(F.sum(size).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("file").alias("f"), F.col("block").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("inside", F.coalesce(F.sum(size).over(inside), F.lit(0))).join(blocks, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")))
    off = F.col("base") + F.col("inside") - len(MAGIC)
    return cut.withColumn("off", off).where("off >= 0").withColumn("next", F.col("off") + len(MAGIC) + F.col("skip") + F.col("clen") + len(END)).drop("f", "b", "base", "inside")


def reached(found: DataFrame) -> DataFrame:
    """file, off of the candidates on each file's chain, by pointer jumping.

    Each round doubles what ``next`` skips and marks what marked ones point to, so it ends after log2 of the most
    candidates of one file. Files of any size are spread over all tasks; each round is checkpointed.
    """
    nodes = found.where("next is not null").select("file", "off", "next", (F.col("off") == 0).alias("hit"))
    most = nodes.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    for _ in range(most.bit_length()):
        to = nodes.select(F.col("file").alias("f"), F.col("off").alias("o"), F.col("next").alias("then"))
        marks = nodes.where("hit").select(F.col("file").alias("mf"), F.col("next").alias("mo")).distinct()
        nodes = (
            nodes.join(marks, (F.col("file") == F.col("mf")) & (F.col("off") == F.col("mo")), "left")
            .join(to, (F.col("file") == F.col("f")) & (F.col("next") == F.col("o")), "left")
            .select("file", "off", F.col("then").alias("next"), (F.col("hit") | F.col("mo").isNotNull()).alias("hit"))
        ).checkpoint()
    return nodes.where("hit").select("file", "off")


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records below ``path``: file, offset, record_type, page_id, url, refers_to, payload_bytes, payload_digest and,
    if ``payloads``, payload (binary; null for revisits).

    Bytes and digest of a response are taken from its payload; those of a revisit are the full payload's, as its header
    states them. A response whose payload is lost or not that of its digest is an error. Records that no chain from a file's start reaches are not returned; a file that does not start with a
    record gives none. An archive without records gives an empty result.
    """
    found = stored(candidates(spark, path), "warc-found")
    on = reached(found).select(F.col("file").alias("rf"), F.col("off").alias("ro"))
    found = found.join(on, (F.col("file") == F.col("rf")) & (F.col("off") == F.col("ro")), "left").drop("rf")
    own = Window.partitionBy("file").orderBy("off")
    found = stored(found.withColumn("record", F.last("ro", ignorenulls=True).over(own)).where("record is not null"), "warc-linked")
    heads = found.where("ro is not null")
    split = found.join(heads.where("not whole and type = 'response'").select(F.col("file").alias("hf"), F.col("off").alias("ho")), (F.col("file") == F.col("hf")) & (F.col("record") == F.col("ho")), "left_semi")
    split = heads.where("type = 'response'") if payloads else split
    parts = (found if payloads else split).select("file", "same", "off", "record")
    if payloads or not split.isEmpty():
        wanted = parts.select(F.col("file").alias("wf"), F.col("same").alias("ws")).distinct()
        text = _cuts(spark, path).select("file", _same("value").alias("same"), "value").join(wanted, (F.col("file") == F.col("wf")) & (F.col("same") == F.col("ws")), "left_semi")
        text = text.groupBy("file", "same").agg(F.first("value").alias("value"))  # equal cuts are one
        text = parts.join(text, ["file", "same"])
        text = text.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("off", "value"))).alias("parts"))
        text = text.select(F.col("file").alias("tf"), F.col("record").alias("tr"), F.array_join(F.col("parts.value"), MAGIC).cast("binary").alias("bytes_of"))
        heads = heads.join(text, (F.col("file") == F.col("tf")) & (F.col("off") == F.col("tr")), "left")
        made = F.when(F.col("type") == "response", _payload(F.substring(F.col("bytes_of"), F.col("skip") + 1, F.col("clen").cast("int"))))
        heads = heads.withColumn("payload", made).withColumns({"digest": F.coalesce("digest", F.sha1("payload")), "bytes": F.coalesce("bytes", F.octet_length("payload").cast("bigint"))})
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<urn:page:(-?[0-9]+)>', 1) AS bigint)")
    # A response's bytes and digest come from its payload alone; a part that was not found again, or bytes that are not what
    # the header states, are an error.
    lost = (F.col("type") == "response") & (F.col("digest").isNull() | (F.col("said").isNotNull() & (F.col("digest") != F.regexp_replace("said", "^sha1:", ""))))
    lost = F.when(F.coalesce(lost, F.lit(False)), F.raise_error(F.concat(F.lit("a response's payload is not what its header states: "), F.coalesce("id", F.lit("?")))).cast("string"))
    heads = heads.withColumn("digest", F.coalesce(lost, "digest"))
    columns = [
        "file", F.col("off").alias("offset"), F.col("type").alias("record_type"), number("id").alias("page_id"), "url", number("target").alias("refers_to"),
        F.coalesce("bytes", F.expr("try_cast(said_bytes AS bigint)")).alias("payload_bytes"), F.coalesce("digest", F.regexp_replace("said", "^sha1:", "")).alias("payload_digest"),
    ]
    return heads.select(*columns, *["payload"] * payloads)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), q AS (
  SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
         CASE WHEN octet_length(encode(html)) >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS target
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN target = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN target <> page_id THEN target END AS refers_to
FROM q
"""

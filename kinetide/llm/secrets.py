"""Secret scans with an incremental ledger of blobs.

A blob is one distinct text, named by its SHA-256. The ledger is a table in a shared folder: blob, rules (name@version of
each rule that has scanned it) and spans. A run names the blobs of every version of every path, scans only the pairs of
blob and rule version that the ledger lacks, appends them, and joins the ledger's findings back to all paths. Texts are
scanned in the task that reads them; only names and findings are shuffled.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import among, fresh_path, key_filter, keyed_text, stored

#: Fixed patterns of the base kinds: name, version, pattern, flags, group and least length of that group.
BASE = (
    ("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE, 2, 12),
    ("access", 1, r"AKIA[A-Z0-9]+", 0, 0, 18),
    ("hex", 1, r"[0-9a-f]{16,}", 0, 0, 16),
)
#: Kinds that this scan adds: well-known token formats with a fixed prefix.
MORE = (
    ("pem", 2, r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END (?:[A-Z]+ )*PRIVATE KEY-----)?", 0, 0, 1),
    ("github", 1, r"\bgh[opsur]_[A-Za-z0-9]{36,}", 0, 0, 40),
    ("slack", 1, r"\bxox[abprs]-[A-Za-z0-9-]{16,}", 0, 0, 21),
    ("jwt", 1, r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 0, 40),
)
RULES = BASE + MORE
LEDGER = "blob binary, rules array<string>, spans array<struct<start:int,rule:string,end:int>>"


def find(text: str, rules) -> list[dict]:
    """Spans of the rules, in code points, leftmost and not overlapping for each rule."""
    out = []
    for name, version, pattern, flags, group, least in rules:
        for m in re.compile(pattern, flags | re.ASCII).finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append({"start": m.start(), "rule": f"{name}@{version}", "end": m.end()})
    return out


def scan(history: DataFrame, ledger: str, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bring the ledger at path ``ledger`` up to date with ``history`` (a row per version of a path) and return its
    findings for each row: key, blob, spans (by start, then kind; kind is the place in ``rules``).

    Null texts are empty; texts of any length are scanned whole; equal texts are one blob, scanned once however many rows
    hold it (a second time only if a filter takes another row for its first); repeated rows get a result each; a rule with
    a new version scans every blob again and its old findings are left out; an empty table leaves the ledger as it is;
    other columns are not read.
    """
    spark = history.sparkSession
    names = [f"{r[0]}@{r[1]}" for r in rules]
    texts = keyed_text(history, id_col, text_col).withColumn("blob", F.unhex(F.sha2("text", 256)))
    rows = stored(texts.select("key", "blob"), "secrets-blobs")
    try:
        known = spark.read.schema(LEDGER).parquet(ledger)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = spark.createDataFrame([], LEDGER)
    known = known.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))  # a row for each version of the rules
    first = rows.groupBy("blob").agg(F.min(F.xxhash64("key", "blob")).alias("first"))
    todo = first.join(known, "blob", "left").select("blob", "first", F.array_except(F.array(*map(F.lit, names)), F.coalesce("seen", F.array().cast("array<string>"))).alias("rules")).where("size(rules) > 0")
    todo = stored(todo, "secrets-todo")

    def look(own, wanted):
        kind = pa.list_(pa.struct([("start", pa.int32()), ("rule", pa.string()), ("end", pa.int32())]))
        mine = [dict(zip(names, rules, strict=True))[n] for n in own]

        def each(batches):
            for batch in batches:
                if wanted.value is not None:  # else each row is scanned
                    batch = batch.filter(pa.array(wanted.value.has(batch.column(2).to_numpy())))
                spans = [find(t, mine) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own] * len(spans), pa.list_(pa.string())), pa.array(spans, kind)], ["blob", "rules", "spans"])

        return each

    for own in [r["rules"] for r in todo.select("rules").distinct().collect()]:  # as many as sets of rules that blobs lack
        wanted = spark.sparkContext.broadcast(key_filter(todo.where(F.col("rules") == F.array(*map(F.lit, own))), "first"))
        texts.select("blob", "text", F.xxhash64("key", "blob")).mapInArrow(look(own, wanted), LEDGER).write.mode("append").parquet(ledger)
    listed = F.array(*map(F.lit, names))
    flat = F.filter(F.flatten(F.collect_list("spans")), lambda x: F.array_contains(listed, x["rule"]))
    flat = F.transform(flat, lambda x: F.struct(x["start"], (F.array_position(listed, x["rule"]) - 1).cast("int").alias("kind"), x["end"]))
    found = spark.read.schema(LEDGER).parquet(ledger) if not rows.isEmpty() else spark.createDataFrame([], LEDGER)
    found = found.where("size(spans) > 0").groupBy(F.col("blob").alias("b")).agg(F.array_sort(F.array_distinct(flat)).alias("spans"))
    found = stored(found, "secrets-found")
    return rows.join(found, F.col("blob") == F.col("b"), "left").select("key", "blob", F.coalesce("spans", F.array().cast(found.schema["spans"].dataType)).alias("spans"))


def said(spans: Column, names: list[str]) -> Column:
    """kind:start:end, comma-joined."""
    name = F.array(*map(F.lit, names))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(name, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, ledger: str, mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with every span of its texts (overlapping ones as one) replaced by ``mark``, and ``count_col`` the number of
    code points of texts that changed; other columns and rows are as they were, whatever their names; null texts stay null.
    Only texts with a finding are moved."""
    found = scan(docs, ledger, id_col=id_col, text_col=text_col).where("size(spans) > 0").select("key", "blob", F.xxhash64("key", "blob").alias("id"), "spans")
    found = stored(found.dropDuplicates(["key", "blob"]), "secrets-rows").withColumnsRenamed({"key": "fk", "blob": "fb"})
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("bigint").alias("key"), F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)).alias("blob"), text.alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    some, others = among(rows, F.xxhash64("key", "blob"), found, "id")
    both = some.join(found, F.col("key").eqNullSafe(F.col("fk")) & (F.col("blob") == F.col("fb")), "left")
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, x):
        start = F.greatest(acc["at"], x["start"])
        more = F.when(x["end"] <= acc["at"], acc["out"]).when((x["start"] < acc["at"]) & (acc["at"] > 0), acc["out"]).otherwise(F.concat(acc["out"], F.substring("text", acc["at"] + 1, start - acc["at"]), F.lit(mark)))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), more.alias("out"))

    clean = F.aggregate("spans", begin, step, lambda acc: F.concat(acc["out"], F.substring("text", acc["at"] + 1, F.length("text"))))
    row = F.col("row").withField(f"`{text_col}`", clean.cast(docs.schema[text_col].dataType))
    if count_col:
        row = row.withField(f"`{count_col}`", F.length(clean).cast(docs.schema[count_col].dataType))
    out = both.select(F.when(F.col("spans").isNull(), F.col("row")).otherwise(row).alias("row"))
    return (out if others is None else out.unionByName(others.select("row"))).select("row.*")


def op8_secrets(spark: SparkSession, sf_dir: str, ledger: str | None = None) -> DataFrame:
    """Findings of documents. With ``ledger``, a path that is kept, a later run scans only what is new there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan(docs, ledger or fresh_path(spark, "ledger"))
    names = [r[0] for r in RULES]
    of = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("bigint")
    base = F.filter("spans", lambda x: x["kind"] < len(BASE))
    return found.select(F.col("key").alias("doc_id"), of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(said(base, names), 256).alias("base_sha256"), said(F.col("spans"), names).alias("spans"))

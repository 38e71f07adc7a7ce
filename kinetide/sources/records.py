"""Readers and writers of episodes, JSON lines, configurations, shards and reports; all through Spark's own sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kinetide.operators.relational import counts_of, first_of, require_none

from .packed import read_packed, write_packed  # noqa: F401  (S12)


def of_width(c: Column, n: int, name: str) -> Column:
    """An array column that must have ``n`` components; another length is an error when it is read."""
    wrong = F.raise_error(F.format_string(f"{name} has %d components, not {n}", F.size(c)))
    return F.when(c.isNull() | (F.size(c) == n), c).otherwise(wrong.cast("array<double>"))


def episodes(spark: SparkSession, path: str, state: str = "state", action: str = "action", widths: tuple[int, int] | None = None) -> DataFrame:
    """Only the two arrays, the file and the row's number within it (row index of the file, so any split of the
    files gives the same)."""
    rows = spark.read.parquet(path)
    s, a = (F.col(f"`{c}`").cast("array<double>") for c in (state, action))
    if widths:
        s, a = of_width(s, widths[0], state), of_width(a, widths[1], action)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("frame"), s.alias("state"), a.alias("action"))


def row_counts(spark: SparkSession, path: str) -> DataFrame:
    """File, n; no data column is read. Files without rows are not listed."""
    return spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"))


def file_number(c: Column) -> Column:
    """O1: the last number in a file's name."""
    return F.regexp_extract(F.element_at(F.split(c, "/"), -1), r"(\d+)\D*$", 1).try_cast("bigint")


def json_lines(spark: SparkSession, path: str, schema: str | StructType, strict: bool = True) -> DataFrame:
    """One object a line, blank lines skipped. ``strict``: a bad line is an error; else it is left out."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    bad = "_corrupt_record"
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    parsed = lines.select(F.from_json("value", StructType(kind.fields).add(bad, "string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}).alias("r"))
    return parsed.where(F.col(f"r.{bad}").isNull()).select("r.*").drop(bad)


def write_json_lines(df: DataFrame, path: str) -> None:
    """S17."""
    df.write.option("ignoreNullFields", "false").json(path)


def document(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """A file that is one JSON value."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def task_text(tasks: DataFrame, task: str) -> DataFrame:
    """The text of the first row whose task_id is ``task`` or whose index, as task-%04d, is."""
    same = (F.col("task_id") == task) | (F.format_string("task-%04d", "task_index") == task)
    return tasks.where(same).orderBy("task_index").limit(1).select("task")


def complete_episodes(spark: SparkSession, kinds: dict[str, str], id_pattern: str = r"([^/]+)\.[^./]+$") -> DataFrame:
    """Id and a path for each kind, of the ids that have a file of every kind. Files are listed, not read."""
    found = None
    for kind, glob in kinds.items():
        files = spark.read.format("binaryFile").load(glob).select(F.regexp_extract("path", id_pattern, 1).alias("id"), F.col("path").alias(kind))
        files = first_of(files, ["id"], kind)
        found = files if found is None else found.join(files, "id")
    return found


def vocabulary(entries: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
    """(key, text of the first file that has it) and (key, sorted set of skills) of rows (file, text, skill)."""
    rows = entries.withColumn("key", key)
    first = rows.groupBy("key").agg(F.min_by("text", F.struct("file", "text")).alias("text"))
    return first, rows.groupBy("key").agg(F.array_sort(F.collect_set("skill")).alias("skills"))


def synthetic(spark: SparkSession, n: int, width: int, seed: int = 0) -> DataFrame:
    """Id, x (array of numbers in [-1, 1)) and token (0 to 2047), from hashes of seed and id."""
    part = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.pmod(F.xxhash64(F.lit(seed), "id", k), F.lit(1 << 24)) / F.lit(float(1 << 23)) - 1)
    return spark.range(n).select("id", part.cast("array<float>").alias("x"), F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(2048)).cast("int").alias("token"))


def write_shards(df: DataFrame, path: str, label: str, names: list[str], order: list[str]) -> DataFrame:
    """One folder for each label below ``path``/shards, and the manifest: label, n and a digest of the shard's
    rows, also for labels without rows. The digest is a hash of the sum of the rows' hashes, so it merges before the
    shuffle and doesn't depend on their order."""
    kept = df.where(F.col(label).isin(names))
    kept.repartitionByRange(label, *order).sortWithinPartitions(label, *order).write.partitionBy(label).parquet(f"{path}/shards")
    each = F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(20,0)")).cast("decimal(38,0)")
    manifest = counts_of(kept, label, names, total=each).select(label, "n", F.sha2(F.coalesce(F.col("total").cast("string"), F.lit("")), 256).alias("digest"))
    manifest.coalesce(1).write.json(f"{path}/manifest")  # a row for each label
    return df.sparkSession.read.schema(f"`{label}` string, n long, digest string").json(f"{path}/manifest")


def write_checked(df: DataFrame, faults: DataFrame, path: str, apply: bool = True) -> int:
    """Nothing is written if there is a fault, or if ``apply`` is false; returns the number of rows."""
    require_none(faults, "faults")
    n = df.count()
    if apply:
        df.write.parquet(path)
    return n


def write_csv_if_any(df: DataFrame, path: str) -> bool:
    """S20."""
    if df.isEmpty():
        return False
    df.write.option("header", True).csv(path)
    return True


def summary(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """Outer, JSON of the counts by inner, and their total. Counts are made first; an outer key has a row a label."""
    each = df.groupBy(outer, inner).agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy(outer).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(inner, "n"))))).alias("counts"), F.sum("n").alias("total"))


def write_stats(stats: DataFrame, path: str, keys: list[str]) -> None:
    """For each key one JSON line with the arrays mean, std, q01, q99 in order of the components."""
    row = F.array_sort(F.collect_list(F.struct("dim", "mean", "std", "q01", "q99"))).alias("r")
    flat = stats.groupBy(*keys).agg(row) if keys else stats.agg(row)
    flat.select(*keys, *[F.col(f"r.{c}").alias(c) for c in ("mean", "std", "q01", "q99")]).write.json(path)


def read_stats(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The long form of what write_stats() wrote."""
    rows = spark.read.json(path)
    zipped = F.arrays_zip("mean", "std", "q01", "q99")
    return rows.select(*keys, F.posexplode(zipped).alias("dim", "r")).select(*keys, "dim", "r.*")


def frame_manifest(df: DataFrame, keys: list[str], frame: str, keep: Column) -> DataFrame:
    """For each key the kept and dropped frames, ascending; keys are episodes, so the arrays are bounded by one."""
    pick = lambda c: F.array_sort(F.collect_list(F.when(c, F.col(frame))))
    return df.groupBy(*keys).agg(pick(keep).alias("kept"), pick(~F.coalesce(keep, F.lit(False))).alias("dropped"))


def report_lines(df: DataFrame, keys: list[str], order: str, line: Column) -> DataFrame:
    """For each key its lines, in order, as one text."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("t"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["t"]), "\n").alias("report"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """File, n_bytes and SHA-256 of every file below ``path``; each is read by one task, as its digest needs."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("file"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))

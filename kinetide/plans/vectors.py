"""Queries over embeddings as state vectors (label: expert) and conversations as segments (turns: frames)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetide.operators import quantiles as Q
from kinetide.operators import temporal as T
from kinetide.operators import vectors as V


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


L = "l AS (SELECT vec_id, label, unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"
STATS = "count(x) AS n, round(avg(x), 6) AS mean, round(sqrt(greatest(avg(x * x) - avg(x) * avg(x), 0)), 6) AS std, min(x) AS lo, max(x) AS hi"


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in names}).withColumns({c: F.col(c).cast("bigint") for c in df.columns if c == "dim"})


def vector_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(V.vector_stats(vectors(spark, sf_dir), "v"), "mean", "std")


STATS_SQL = f"WITH {L} SELECT dim, {STATS}, min(x) AS q01, max(x) AS q99 FROM l GROUP BY dim"


def vector_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = V.vector_stats(vectors(spark, sf_dir), "v", ["label"], "exact")
    return _rounded(found, "q01", "q99").select("label", "dim", "q01", "q99")


QUANTILES_SQL = f"WITH {L} SELECT label, dim, round(quantile_cont(x, 0.01), 6) AS q01, round(quantile_cont(x, 0.99), 6) AS q99 FROM l GROUP BY label, dim"


def running_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components as they come in batches of 50 vectors, each twice as wide as the one before in turn."""
    rows = V.long_form(vectors(spark, sf_dir).withColumn("batch", F.floor(F.col("vec_id") / 50)), ["vec_id", "batch"], "v")
    found = Q.running_quantiles(rows.withColumn("x", F.col("x") * (1 + F.col("batch") % 3)), ["dim"], "batch")
    return _rounded(found, "mean", "std", "lo", "hi", "q01", "q99")


def _sql_edge(i: str, side: str = "") -> str:
    return f"CASE WHEN {i} >= 5000 THEN {side}hi ELSE ({i}) * (({side}hi - {side}lo) / 5000) + {side}lo END"


def _sql_bin(x: str, side: str = "") -> str:
    guess = f"greatest(0, least(4999, CAST(floor(({x} - {side}lo) / (({side}hi - {side}lo) / 5000)) AS BIGINT)))"
    return f"{guess} + CASE WHEN {x} < {_sql_edge(guess, side)} THEN -1 WHEN {guess} < 4999 AND {x} >= {_sql_edge(guess + ' + 1', side)} THEN 1 ELSE 0 END"


#: Counts of each epoch move on by themselves, one step of the recursion for each later epoch.
RUNNING_SQL = f"""WITH RECURSIVE {L}, x AS MATERIALIZED (SELECT dim, vec_id // 50 AS b, x * (1 + vec_id // 50 % 3) AS x FROM l),
m AS (SELECT dim, b, min(min(x)) OVER w AS lo, max(max(x)) OVER w AS hi FROM x GROUP BY dim, b WINDOW w AS (PARTITION BY dim ORDER BY b)),
e AS MATERIALIZED (SELECT dim, b, lo, hi, CAST(sum(CASE WHEN lo < plo OR hi > phi THEN 1 ELSE 0 END) OVER (PARTITION BY dim ORDER BY b) AS BIGINT) AS epoch FROM (SELECT *, lag(lo) OVER w AS plo, lag(hi) OVER w AS phi FROM m WINDOW w AS (PARTITION BY dim ORDER BY b))),
g AS MATERIALIZED (SELECT dim, epoch, min(lo) - CASE WHEN epoch = 0 THEN 1e-10 ELSE 0 END AS lo, max(hi) + CASE WHEN epoch = 0 THEN 1e-10 ELSE 0 END AS hi FROM e GROUP BY dim, epoch),
v AS MATERIALIZED (SELECT dim, epoch, idx, count(*) AS c FROM (SELECT x.dim, e.epoch, {_sql_bin("x.x", "g.")} AS idx FROM x JOIN e ON e.dim = x.dim AND e.b = x.b JOIN g ON g.dim = e.dim AND g.epoch = e.epoch) GROUP BY ALL),
r AS (SELECT dim, epoch, idx, c FROM v UNION ALL SELECT dim, epoch, {_sql_bin("pos")} AS idx, c FROM (SELECT r.dim, n.epoch, n.lo, n.hi, r.c, {_sql_edge("r.idx", "o.")} AS pos FROM r JOIN g o ON o.dim = r.dim AND o.epoch = r.epoch JOIN g n ON n.dim = r.dim AND n.epoch = r.epoch + 1) WHERE pos >= lo),
z AS MATERIALIZED (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY dim ORDER BY epoch DESC) = 1),
h AS (SELECT r.dim, r.idx, sum(sum(r.c)) OVER (PARTITION BY r.dim ORDER BY r.idx) AS upto FROM r JOIN z ON z.dim = r.dim AND z.epoch = r.epoch GROUP BY r.dim, r.idx),
n AS (SELECT dim, {STATS} FROM x GROUP BY dim HAVING count(x) >= 2),
p AS (SELECT n.dim, coalesce(min(h.idx) FILTER (WHERE h.upto >= 0.01::DOUBLE * n.n), 5000) AS i01, coalesce(min(h.idx) FILTER (WHERE h.upto >= 0.99::DOUBLE * n.n), 5000) AS i99 FROM n JOIN h ON h.dim = n.dim GROUP BY n.dim)
SELECT n.dim, n.n, n.mean, n.std, round(n.lo, 6) AS lo, round(n.hi, 6) AS hi, round({_sql_edge("i01", "z.")}, 6) AS q01, round({_sql_edge("i99", "z.")}, 6) AS q99 FROM n JOIN p ON p.dim = n.dim JOIN z ON z.dim = n.dim"""


def vector_stats_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(V.grouping_set_stats(vectors(spark, sf_dir), "v", ["label"]), "mean", "std")


SETS_SQL = f"WITH {L} SELECT dim, label, grouping(label) = 1 AS total, {STATS} FROM l GROUP BY GROUPING SETS ((dim), (dim, label)) HAVING count(x) >= 2"


def normalize_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return _rounded(V.normalize(rows, ["vec_id"], "v", V.vector_stats(rows, "v")), "y", digits=5)


Z_SQL = f"""WITH {L}, s AS (SELECT dim, avg(x) AS mean, sqrt(greatest(avg(x * x) - avg(x) * avg(x), 0)) AS std FROM l GROUP BY dim)
SELECT vec_id, l.dim, round((x - mean) / (std + 1e-6), 5) AS y FROM l JOIN s ON l.dim = s.dim"""


def normalize_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return _rounded(V.normalize(rows, ["vec_id"], "v", V.vector_stats(rows, "v", quantiles="exact"), how="quantile"), "y", digits=5)


QUANTILE_SQL = f"""WITH {L}, s AS (SELECT dim, quantile_cont(x, 0.01) AS q01, quantile_cont(x, 0.99) AS q99 FROM l GROUP BY dim)
SELECT vec_id, l.dim, round((x - q01) / (q99 - q01 + 1e-6) * 2 - 1, 5) AS y FROM l JOIN s ON l.dim = s.dim"""


def per_expert_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return _rounded(V.normalize(rows, ["vec_id"], "v", V.vector_stats(rows, "v", ["label"]), ["label"]), "y", digits=4)


EXPERT_SQL = f"""WITH {L}, s AS (SELECT label, dim, avg(x) AS mean, sqrt(greatest(avg(x * x) - avg(x) * avg(x), 0)) AS std FROM l GROUP BY label, dim)
SELECT vec_id, l.label, l.dim, round((x - mean) / (std + 1e-6), 4) AS y FROM l JOIN s ON l.dim = s.dim AND l.label = s.label"""


def _text(v):
    """Arrays as text, rounded, so that both engines write the same."""
    return F.array_join(F.transform(v, lambda x: F.round(x * 1e5).cast("bigint").cast("string")), ",")


TEXT = "array_to_string(list_transform({}, lambda x: CAST(CAST(round(x * 1e5) AS BIGINT) AS VARCHAR)), ',')"


def delta_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twelve components less the next twelve, but for every third run."""
    v = F.col("v")
    mask = V.bool_mask(4, -4, 4)
    return vectors(spark, sf_dir).select("vec_id", _text(V.delta(F.slice(v, 1, 12), F.slice(v, 13, 12), mask)).alias("delta"))


DELTA_SQL = f"""SELECT vec_id, {TEXT.format('list_transform(range(1, 13), lambda i: CAST(embedding[i] AS DOUBLE) - CASE WHEN i BETWEEN 5 AND 8 THEN 0 ELSE CAST(embedding[i + 12] AS DOUBLE) END)')} AS delta FROM embeddings"""


def state_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    return vectors(spark, sf_dir).select("vec_id", _text(V.pad(V.slices(v, [(0, 3), (10, 14), (60, 64)]), 16)).alias("state"), F.round(V.gripper_width(v, 20, 22), 6).alias("width"))


SLICES_SQL = f"""SELECT vec_id, {TEXT.format('list_concat(list_concat(embedding[1:3]::DOUBLE[], embedding[11:14]::DOUBLE[]), list_concat(embedding[61:64]::DOUBLE[], [0.0, 0.0, 0.0, 0.0, 0.0]::DOUBLE[]))')} AS state,
round((CAST(embedding[21] AS DOUBLE) + CAST(embedding[22] AS DOUBLE)) * 2 / 0.1 - 1, 6) AS width FROM embeddings"""


def discretize_256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", F.array_join(F.transform("v", lambda x: V.bins(x * 4).cast("string")), ",").alias("bins"))


BINS_SQL = """SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CAST(greatest(-1, least(255, CAST(floor((CAST(x AS DOUBLE) * 4 + 1) * 128) AS BIGINT))) AS VARCHAR)), ',') AS bins FROM embeddings"""


def resampled_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All components of each vector, at twice as many places less one."""
    return vectors(spark, sf_dir).select("vec_id", _text(V.resample(F.col("v"), 127)).alias("chunk"))


WHOLE_SQL = f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)
SELECT vec_id, {TEXT.format('list_transform(range(2 * len(v) - 1), lambda k: v[k // 2 + 1] + (v[least(k // 2 + 2, len(v))] - v[k // 2 + 1]) * ((k % 2) * 0.5))')} AS chunk FROM v"""


def finite_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).groupBy("label").agg(F.count_if(V.finite(F.col("v"))).alias("n"))


FINITE_SQL = "SELECT label, count(*) FILTER (list_bool_and(list_transform(embedding, lambda x: isfinite(x)))) AS n FROM embeddings GROUP BY label"


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's turns [0, n) as a segment of an episode that is three turns longer."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.groupBy("conv_id").agg(F.lit(0).cast("bigint").alias("s"), (F.max("turn") + 1).alias("t"), (F.max("turn") + 4).alias("stop"))


G = "g AS (SELECT conv_id, CAST(0 AS BIGINT) AS s, max(turn) + 1 AS t, max(turn) + 4 AS stop FROM conversations GROUP BY conv_id)"
CHUNK = "FROM (SELECT *, unnest(range(5)) AS k FROM (SELECT *, unnest(range(s, t)) AS anchor FROM g))"


def action_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.action_chunks(segments(spark, sf_dir), "s", "t", 5).select("conv_id", "anchor", "k", "frame")


CHUNK_SQL = f"WITH {G} SELECT conv_id, anchor, k, least(anchor + k, t - 1) AS frame {CHUNK}"


def chunk_zero_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.action_chunks(segments(spark, sf_dir), "s", "t", 5, clamp="stop")
    return rows.select("conv_id", "anchor", "k", F.when(F.col("padded"), F.lit(0).cast("bigint")).otherwise(F.col("frame")).alias("value"))


ZERO_PAD_SQL = f"WITH {G} SELECT conv_id, anchor, k, CASE WHEN anchor + k > stop - 1 THEN 0 ELSE anchor + k END AS value {CHUNK}"


def all_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.windows(segments(spark, sf_dir), "s", "t", 3).select("conv_id", "window_start")


WINDOWS_SQL = f"WITH {G} SELECT conv_id, unnest(range(s, greatest(s, t - 3) + 1)) AS window_start FROM g"


def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).select("conv_id", T.window_count(F.col("t") - F.col("s"), 3).cast("bigint").alias("n"))


COUNTS_SQL = f"WITH {G} SELECT conv_id, greatest(1, t - s - 2) AS n FROM g"


def sampled_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.sampled_window(segments(spark, sf_dir), "conv_id", "s", "t", 3, 7).select("conv_id", "window_start")


QUERIES = {
    "vector_stats": (vector_stats, STATS_SQL),
    "running_quantiles": (running_quantiles, RUNNING_SQL),
    "vector_quantiles": (vector_quantiles, QUANTILES_SQL),
    "vector_stats_grouping_sets": (vector_stats_grouping_sets, SETS_SQL),
    "normalize_z": (normalize_z, Z_SQL),
    "normalize_quantile": (normalize_quantile, QUANTILE_SQL),
    "per_expert_normalize": (per_expert_normalize, EXPERT_SQL),
    "delta_actions": (delta_actions, DELTA_SQL),
    "state_slices": (state_slices, SLICES_SQL),
    "discretize_256": (discretize_256, BINS_SQL),
    "resampled_whole": (resampled_whole, WHOLE_SQL),
    "finite_vectors": (finite_vectors, FINITE_SQL),
    "action_chunks": (action_chunks, CHUNK_SQL),
    "chunk_zero_pad": (chunk_zero_pad, ZERO_PAD_SQL),
    "all_windows": (all_windows, WINDOWS_SQL),
    "window_counts": (window_counts, COUNTS_SQL),
    "sampled_windows": (sampled_windows, None),
}

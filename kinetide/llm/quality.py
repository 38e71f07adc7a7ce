"""Quality rules: counts of whole texts, and robust multivariate outliers within each language and source.

Everything is DataFrame expressions. A text's counts come from arrays within its row; they are stored, and all that
follows reads only the integers of this table:
  statistics  log of the mean word length; log of distinct words over log of words; square roots of the shares of short
              words and of marks and symbols. They vary in every text, so their covariance means something
  cells       rows of one language and source; cells below ``least`` rows are pooled by language, then all together; a
              last pool that is still too small is judged against all rows
  starts      medians and quartile distances, and small subsets that a hash draws, so a run is repeatable
  C-steps     distance of every row, the nearest ``share`` of a cell's rows, their mean and covariance; two for every start,
              then the start with the least determinant is kept for each cell and carried on until it falls no further
  verdict     a squared Mahalanobis distance above ``cutoff``, after a factor that makes the distance at ``share`` that of a
              chi-squared distribution, and times n / (n + SHORT), as statistics of few words vary more
Statistics are integers (thousandths), so sums are exact and a result doesn't depend on how rows are partitioned. The share
of nearest rows is cut in bins of the distance's logarithm, which are counted before the shuffle whatever a cell's size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, stored

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: The statistics, and the least standard deviation of each in thousandths, for cells in which one doesn't vary at all.
NAMES = ["x_length", "x_types", "x_short", "x_marks"]
FLOOR = 5
D = len(NAMES)
#: Words of at most so many characters are short; marks besides SYMBOLS; words at which a distance counts half.
SHORT_WORD, MARKS, SHORT = 3, ".,;:!?", 30
#: The cell of all rows; others are named by JSON arrays.
ALL = "*"
#: Chi-squared with four degrees of freedom at 0.75 and at 1 - 1e-6, and the bins for each doubling of a squared distance.
CHI_75, CHI_FAR, BINS = 5.385, 33.377, 64
#: Starts besides the medians, rows of a cell that each draws, and C-steps before one start is chosen.
DRAWS, DRAWN, EARLY = 3, 24, 2
#: Fewest rows that give an estimate, where the whole table has no more.
FEWEST = 20


def counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_marks, n_types, n_short, n_lines, n_dup_lines and n_repeat_words; a
    null text has none."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    few = docs.withColumns({
        "_words": F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
        "word_chars": F.length(F.translate(text, SPACES, "")).cast("bigint"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint"),
        "n_marks": (F.length(text) - F.length(F.translate(text, MARKS + SYMBOLS, ""))).cast("bigint"),
        "_lines": lines,
    })
    starts = F.sequence(F.lit(1), F.size("_words") - (WINDOW - 1))
    hashes = F.when(F.size("_words") > WINDOW, F.transform(starts, lambda i: F.xxhash64(F.slice("_words", i, F.lit(WINDOW))))).otherwise(F.array().cast("array<bigint>"))
    few = few.withColumns({"n_words": F.size("_words").cast("bigint"), "n_types": F.size(F.array_distinct("_words")).cast("bigint"), "n_short": F.size(F.filter("_words", lambda x: F.length(x) <= SHORT_WORD)).cast("bigint"), "n_lines": F.size("_lines").cast("bigint"), "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"), "_hashes": hashes})
    repeats = F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), _repeated(F.col("_words"), F.col("_hashes"))).otherwise(F.lit(0).cast("bigint"))
    return few.withColumn("n_repeat_words", repeats).drop("_words", "_lines", "_hashes")


def _repeated(words: Column, hashes: Column) -> Column:
    """Words in windows found twice or more. Windows are sorted by hash and place packed in one integer; neighbours with
    equal hash bits are compared word by word."""
    bits = F.ceil(F.log2(F.size(hashes) + 2)).cast("int") + 1

    def with_bits(b):
        one = F.lit(1).cast("bigint")
        low = F.call_function("shiftleft", one, b) - one
        packed = F.sort_array(F.transform(hashes, lambda x, i: x.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("bigint"))))

        def with_packed(p):
            def same(x, y):
                cut = lambda v: F.slice(words, v.bitwiseAND(low).cast("int") + 1, F.lit(WINDOW))
                near = F.call_function("shiftright", x, b) == F.call_function("shiftright", y, b)
                return F.when(y.isNull() | ~near, F.lit(False)).otherwise(cut(x) == cut(y))

            twice = F.transform(p, lambda x, j: F.when(same(x, F.get(p, j - 1)) | same(x, F.get(p, j + 1)), x.bitwiseAND(low)))
            places = F.sort_array(F.filter(twice, lambda x: x.isNotNull()))
            zero = F.lit(0).cast("bigint")
            step = lambda acc, i: F.struct((i + WINDOW).alias("end"), (acc["n"] + i + WINDOW - F.greatest(acc["end"], i)).alias("n"))
            return F.aggregate(places, F.struct(zero.alias("end"), zero.alias("n")), step, lambda acc: acc["n"])

        return let(packed, with_packed)

    return let(bits, with_bits)


def statistics(found: DataFrame) -> DataFrame:
    """The statistic vector of each row, in thousandths."""
    root = lambda a, b: F.round(1000 * F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))).cast("bigint")
    log = lambda c: F.log(F.greatest(F.col(c), F.lit(2)).cast("double"))
    return found.withColumns({
        "x_length": F.round(1000 * F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1)))).cast("bigint"),
        "x_types": F.round(1000 * log("n_types") / log("n_words")).cast("bigint"), "x_short": root("n_short", "n_words"), "x_marks": root("n_marks", "word_chars"),
    })


def _cells(rows: DataFrame, least: int) -> DataFrame:
    """cl, cs and ``cell``: the cell of a language and source, their own or a pool. Null where even the last is small."""
    sizes = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    by_lang = sizes.where(F.col("n") < least).groupBy("lang").agg(F.sum("n").alias("pool"))
    rest = by_lang.where(F.col("pool") < least).agg(F.coalesce(F.sum("pool"), F.lit(0)).alias("rest"))
    return (
        sizes.alias("s").join(by_lang.alias("l"), F.col("s.lang").eqNullSafe(F.col("l.lang")), "left").join(rest, F.lit(True), "left")
        .select(F.col("s.lang").alias("cl"), F.col("s.source").alias("cs"), F.when(F.col("n") >= least, F.to_json(F.array("s.lang", "s.source"))).when(F.col("pool") >= least, F.to_json(F.array("s.lang"))).when(F.col("rest") >= least, F.lit("[]")).alias("cell"))
    )


def _starts(rows: DataFrame) -> DataFrame:
    """Models of each cell's starts: medians and quartile distances (trial 0), means and covariances of drawn rows."""
    at = lambda c: F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))  # noqa: E731  exact: integers of a small range
    mids = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *[at(c).alias(f"q{k}") for k, c in enumerate(NAMES)])
    sd = lambda k: (F.get(f"q{k}", F.lit(2)) - F.get(f"q{k}", F.lit(0))) / 1.349
    mids = stored(mids.withColumns({f"m{k}": F.get(f"q{k}", F.lit(1)) for k in range(D)} | {f"v{i}{j}": sd(i) * sd(i) if i == j else F.lit(0.0) for i in range(D) for j in range(i + 1)}), "quality-medians")
    drawn = rows.withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(DRAWS)))).join(mids.select(F.col("cell").alias("mc"), "n"), F.col("cell") == F.col("mc"))
    drawn = drawn.where(F.pmod(F.xxhash64("draw", "trial"), F.lit(1 << 30)) * F.col("n") < F.lit(DRAWN << 30)).groupBy("cell", "trial")
    return _roots(mids.withColumn("trial", F.lit(0))).unionByName(_roots(_moments(drawn.agg(*_sums()))))


def _sums() -> list[Column]:
    """What moments are made of: the number of rows, sums of the statistics and of their products; all integers, so exact."""
    return [F.count(F.lit(1)).alias("n"), *[F.sum(NAMES[i]).alias(f"m{i}") for i in range(D)], *[F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"v{i}{j}") for i in range(D) for j in range(i + 1)]]


def _moments(flat: DataFrame) -> DataFrame:
    """cell, trial, means m and covariances v, from the sums."""
    names = [*[f"m{i}" for i in range(D)], *[f"v{i}{j}" for i in range(D) for j in range(i + 1)]]
    flat = flat.select("cell", "trial", *[(F.col(k) / F.col("n")).alias(k) for k in names])
    return flat.withColumns({f"v{i}{j}": F.col(f"v{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}") for i in range(D) for j in range(i + 1)})


def _roots(flat: DataFrame) -> DataFrame:
    """cell, trial, means, the Cholesky factor of the covariances v (with FLOOR) and the logarithm of their determinant."""
    for i in range(D):
        for j in range(i + 1):
            v = F.col(f"v{i}{j}") + (F.lit(float(FLOOR**2)) if i == j else F.lit(0.0))
            rest = v - reduce(lambda a, b: a + b, [F.col(f"r{i}{k}") * F.col(f"r{j}{k}") for k in range(j)], F.lit(0.0))
            flat = flat.withColumn(f"r{i}{j}", F.sqrt(F.greatest(rest, F.lit(1.0))) if i == j else rest / F.col(f"r{j}{j}"))
    det = reduce(lambda a, b: a + b, [2 * F.log(F.col(f"r{i}{i}")) for i in range(D)])
    return flat.select("cell", "trial", *[f"m{i}" for i in range(D)], *[f"r{i}{j}" for i in range(D) for j in range(i + 1)], det.alias("det"))


def _distances(rows: DataFrame, model: DataFrame) -> DataFrame:
    """``rows`` with trial, d2 and its bin, a row for each of a cell's models."""
    out = rows.join(model.withColumnRenamed("cell", "mc"), F.col("cell") == F.col("mc"))
    for i in range(D):
        rest = F.col(NAMES[i]) - F.col(f"m{i}") - reduce(lambda a, b: a + b, [F.col(f"r{i}{k}") * F.col(f"z{k}") for k in range(i)], F.lit(0.0))
        out = out.withColumn(f"z{i}", rest / F.col(f"r{i}{i}"))
    d2 = reduce(lambda a, b: a + b, [F.col(f"z{i}") * F.col(f"z{i}") for i in range(D)])
    return out.withColumn("d2", d2).withColumn("bin", F.floor(BINS * F.log2(F.col("d2") + 1e-6)).cast("int")).select(*rows.columns, "trial", "d2", "bin")


def _edges(near: DataFrame, share: float) -> DataFrame:
    """The bin of each cell and trial up to which ``share`` of its rows lie."""
    bins = near.groupBy("cell", "trial", "bin").agg(F.count(F.lit(1)).alias("n"))
    return bins.groupBy(F.col("cell").alias("ec"), F.col("trial").alias("et")).agg(F.percentile("bin", F.lit(share), F.col("n")).alias("edge"))


def _step(rows: DataFrame, model: DataFrame, share: float) -> DataFrame:
    """The models of the ``share`` of rows that are nearest to ``model``, for its cells alone. One pass: rows are counted and
    summed by bin, before and after the shuffle, and the nearest bins are added up."""
    bins = _distances(rows, model).groupBy("cell", "trial", "bin").agg(*_sums())
    w = Window.partitionBy("cell", "trial")  # as many rows as there are bins
    first = F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    bins = bins.withColumns({"_first": first, "_all": F.sum("n").over(w)}).where(F.col("_first") <= F.floor((F.col("_all") - 1) * F.lit(share)))
    near = bins.groupBy("cell", "trial").agg(*[F.sum(c).alias(c) for c in bins.columns if c not in ("cell", "trial", "bin", "_first", "_all")])
    return stored(_roots(_moments(near)), "quality-model")


def estimates(rows: DataFrame, share: float) -> DataFrame:
    """cell, means, Cholesky factor and scale of each cell's minimum-covariance-determinant estimate, from ``rows`` (cell,
    draw, statistics); ``draw`` is any number of a row's own. Cells whose determinant no longer falls are done, and only the
    rows of the others are read on; as each fall leads to another set of bins' rows, it ends."""
    model = stored(_starts(rows), "quality-model")
    for _ in range(EARLY):
        model = _step(rows, model, share)
    best = model.groupBy(F.col("cell").alias("bc")).agg(F.min_by("trial", F.struct("det", "trial")).alias("bt"))
    going = stored(model.join(best, (F.col("cell") == F.col("bc")) & (F.col("trial") == F.col("bt"))).drop("bc", "bt"), "quality-model")
    done = []
    while True:
        new = _step(rows, going, share)
        both = new.join(going.select(F.col("cell").alias("wc"), F.col("det").alias("was")), F.col("cell") == F.col("wc"))
        fell = stored(both.where(F.col("det") < F.col("was")).drop("wc", "was"), "quality-model")
        done.append(going.join(fell.select(F.col("cell").alias("fc")), F.col("cell") == F.col("fc"), "left_anti"))
        if fell.isEmpty():
            break
        going = fell
    model = stored(reduce(DataFrame.unionByName, done), "quality-model")
    scale = _edges(_distances(rows, model), share).select("ec", F.greatest(F.lit(1.0), F.pow(F.lit(2.0), (F.col("edge") + 1) / F.lit(float(BINS))) / CHI_75).alias("scale"))
    return stored(model.join(scale, F.col("cell") == F.col("ec")).drop("ec"), "quality-estimates")


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", share: float = 0.75, cutoff: float = CHI_FAR, least: int = 100) -> DataFrame:
    """A row for each of ``docs``: key, lang, source, draw (xxhash64 of key and text), the counts, base_failed, d2 and kept.

    base_failed: fewer than 20 words, or over 30 % of them in repeated windows. Other rows are kept unless their d2 is above
    ``cutoff``. Null languages and sources are values of their own; where not even all small cells together have ``least``
    rows, they are judged against all rows. Below FEWEST rows in all there is no estimate, d2 is null and rows that pass the
    base rules are kept. Null and empty texts have no words and fail; long ones are read whole. Repeated rows count as often
    as they occur and get a result each, as do ties. Other columns are not read, whatever their names; an empty table gives
    an empty one.
    """
    columns = [F.col(id_col).cast("bigint").alias("key"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text")]
    found = statistics(counts(docs.select(*columns))).withColumn("draw", F.xxhash64("key", "text")).drop("text")
    found = found.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    found = stored(found, "quality-counts")
    names = stored(_cells(found.where("not base_failed"), least), "quality-cells")
    known = (F.col("lang").eqNullSafe(F.col("cl"))) & (F.col("source").eqNullSafe(F.col("cs")))
    rows = stored(found.where("not base_failed").join(names, known).select("cell", "draw", *NAMES), "quality-rows")
    total = rows.count()
    if not rows.where("cell is null").isEmpty() and total >= FEWEST:
        rows = rows.where("cell is not null").unionByName(rows.withColumn("cell", F.lit(ALL)))
        names = names.withColumn("cell", F.coalesce("cell", F.lit(ALL)))
    model = estimates(rows.where("cell is not null"), share).drop("trial", "det").withColumnRenamed("cell", "mc")
    far = found.join(names, known & ~F.col("base_failed"), "left").join(model, F.col("cell") == F.col("mc"), "left")
    for i in range(D):
        rest = F.col(NAMES[i]) - F.col(f"m{i}") - reduce(lambda a, b: a + b, [F.col(f"r{i}{k}") * F.col(f"z{k}") for k in range(i)], F.lit(0.0))
        far = far.withColumn(f"z{i}", rest / F.col(f"r{i}{i}"))
    d2 = reduce(lambda a, b: a + b, [F.col(f"z{i}") * F.col(f"z{i}") for i in range(D)]) / F.col("scale")
    far = far.withColumn("d2", d2 * F.col("n_words") / (F.col("n_words") + SHORT))
    return far.select(*found.columns, "d2").withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("d2") <= cutoff, F.lit(True)))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("key").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")

"""Fill-in-middle examples: DuckDB inside mapInArrow.

Each Arrow batch is registered in an in-memory DuckDB of the task (one thread, a bound on its memory, no folder to spill
to) and goes through SQL: regexp_extract_all cuts texts into units, sha256 of seed and id draws two cuts and a form,
list_slice and array_to_string build prefix, middle and suffix. What comes back is Arrow; no row is seen by Python. Draws
depend on seed and id alone, so a lost task draws the same again, and no row is shuffled.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import keyed_text, pieces, table

#: Bytes of text that are registered together; a longer text is registered alone.
PIECE = 4 << 20
MARKS = ("<P>", "<S>", "<M>")
DIGESTS = "key bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string"


def sql(seed: str, plain: int, spm: int, texts: bool) -> str:
    """The statement over a registered batch (key, text); ``plain`` and ``spm`` are limits of the third and fourth draw."""
    p, s, m = MARKS
    quoted = seed.replace("'", "''")
    return f"""
WITH drawn AS (SELECT key, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units, sha256('{quoted}:' || coalesce(CAST(key AS VARCHAR), '')) AS h FROM batch),
cut AS (SELECT key, text, units, CAST(len(units) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(units) + 1) AS c1, CAST('0x' || h[9:16] AS BIGINT) % (len(units) + 1) AS c2,
  CASE WHEN text = '' OR contains(text, '{p}') OR contains(text, '{s}') OR contains(text, '{m}') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= {plain} THEN 'plain' WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < {spm} THEN 'spm' ELSE 'psm' END AS form FROM drawn),
part AS (SELECT key, text, n, form, CASE WHEN form <> 'plain' THEN array_to_string(list_slice(units, 1, least(c1, c2)), '') END AS prefix, CASE WHEN form <> 'plain' THEN array_to_string(list_slice(units, least(c1, c2) + 1, greatest(c1, c2)), '') END AS middle,
  CASE WHEN form <> 'plain' THEN array_to_string(list_slice(units, greatest(c1, c2) + 1, n), '') END AS suffix FROM cut),
made AS (SELECT key, n, form, length(prefix) AS prefix_chars, length(middle) AS middle_chars,
  CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{p}' || prefix || '{s}' || suffix || '{m}' || middle ELSE '{s}' || suffix || '{p}' || prefix || '{m}' || middle END AS output FROM part),
back AS (SELECT *, {rebuilt('output', 'form')} AS restored FROM made)
SELECT key, n, form, prefix_chars, middle_chars, sha256(output) AS output_sha256, sha256(restored) AS restored_sha256{', output' if texts else ''} FROM back"""


def rebuilt(output: str, form: str) -> str:
    """SQL for the exact text from an output and its form. Texts that hold a mark are plain and no mark can begin inside
    another, so each mark is where it was put."""
    p, s, m = MARKS
    head, tail = f"split_part({output}, '{m}', 1)", f"split_part({output}, '{m}', 2)"
    psm = f"substr(split_part({head}, '{s}', 1), {len(p) + 1}) || {tail} || split_part({head}, '{s}', 2)"
    spm = f"split_part({head}, '{p}', 2) || {tail} || substr(split_part({head}, '{p}', 1), {len(s) + 1})"
    return f"CASE {form} WHEN 'plain' THEN {output} WHEN 'psm' THEN {psm} ELSE {spm} END"


def through_duckdb(statement: str, most: int = PIECE, memory: str = "512MB"):
    """A function for mapInArrow that runs ``statement`` over each batch, registered as ``batch``."""

    def run(batches):
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": "", "autoinstall_known_extensions": False, "autoload_known_extensions": False})
        try:
            for batch in batches:
                for part in pieces(batch, batch.schema.get_field_index("text"), most):
                    con.register("batch", pa.Table.from_batches([part]))
                    made = con.sql(statement).to_arrow_table()
                    con.unregister("batch")
                    yield from made.to_batches()
        finally:
            con.close()

    return run


def infill(docs: DataFrame, seed: str = "1", plain: int = 90, spm: int = 20, texts: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row key, n (units), form (plain, psm or spm), prefix_chars, middle_chars, output_sha256, restored_sha256 and,
    if ``texts``, ``output``. ``plain`` in a hundred draws are transformed, ``spm`` in a hundred of these with the suffix first.

    Null texts are empty, and empty ones are plain; texts of any length are cut whole; a null id draws as an empty one;
    repeated rows get a result each, equal ones equal; an empty table gives no row; other columns are not read."""
    rows = keyed_text(docs, id_col, text_col)
    return rows.mapInArrow(through_duckdb(sql(seed, plain, spm, texts)), DIGESTS + ", output string" * texts)


def restore(outputs: DataFrame) -> DataFrame:
    """key and the exact ``text`` of each row of infill() (key, form, output)."""
    statement = f"SELECT key, {rebuilt('text', 'form')} AS text FROM batch"
    return outputs.selectExpr("key", "form", "output AS text").mapInArrow(through_duckdb(statement), "key bigint, text string")


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill(table(spark, sf_dir, "documents"), texts=False).withColumnRenamed("key", "doc_id")


#: Cuts by the lengths of units instead of slices of them; the rebuilt text must be the text itself.
OP13_SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS h FROM documents),
u AS (SELECT *, list_transform(regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]'), lambda x: length(x)) AS sizes, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
f AS (SELECT *, CAST(len(sizes) AS BIGINT) AS n, t = '' OR position('<P>' IN t) > 0 OR position('<S>' IN t) > 0 OR position('<M>' IN t) > 0 OR h3 % 100 >= 90 AS bare FROM u),
c AS (SELECT *, CAST(coalesce(list_sum(sizes[:least(h1 % (n + 1), h2 % (n + 1))]), 0) AS BIGINT) AS a, CAST(coalesce(list_sum(sizes[:greatest(h1 % (n + 1), h2 % (n + 1))]), 0) AS BIGINT) AS b FROM f)
SELECT doc_id, n, CASE WHEN bare THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form, CASE WHEN NOT bare THEN a END AS prefix_chars, CASE WHEN NOT bare THEN b - a END AS middle_chars,
sha256(CASE WHEN bare THEN t WHEN h4 % 100 < 20 THEN concat('<S>', substr(t, b + 1), '<P>', substr(t, 1, a), '<M>', substr(t, a + 1, b - a)) ELSE concat('<P>', substr(t, 1, a), '<S>', substr(t, b + 1), '<M>', substr(t, a + 1, b - a)) END) AS output_sha256,
sha256(t) AS restored_sha256 FROM c"""

"""Line deduplication by winnowing, in DataFrame functions alone.

Lines are compared trimmed of spaces; blank lines are not counted.  Winnowing looks at every
window of ``run`` lines and keeps the line of the smallest hash (the rightmost of equals) as a
fingerprint, so two equal runs of at least that length share one.  A line of ``long`` characters
or more is a window of its own, and so are all lines of a document that has fewer than ``run``.
Only the fingerprints' places are stored, each with the hashes of the lines around it that its
windows reach.

Places of one fingerprint are joined and the match is extended from it, to the left by each number
of lines its windows allow and to the right by the rest of a window: places that still agree are a
group, and all but the group's first place (by doc_id, then place) repeat it.  Windows that
touch are then joined to runs and deleted.  What goes is thus exactly every line that lies in a run
of ``run`` or more lines met before, in another document or the same, every long line met
before, and the lines of a document shorter than a run that equal those of an earlier one.

Groups are reduced to a count and a first place before they are shuffled, and each place meets
only that one row: no pairs are made, so the work is linear however often a line repeats; the
places of a very frequent line are dealt to several tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, join_hot, stored

LINES = "filter(transform(split(text, '\\n', -1), (x, i) -> struct(i AS at, trim(x) AS line)), x -> x.line != '')"


def fingerprints(docs: DataFrame, run: int, long: int = 250) -> DataFrame:
    """One row for each fingerprint: doc_id, th (text hash), fp, low, high, n, around.

    The windows of n lines that start at low to high (they touch, as the rightmost least moves only onward)
    have selected the fingerprint; ``around`` holds the hashes of their lines, 2 * run - 1 at most.
    """
    lines = docs.filter(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("th"), F.expr(f"transform({LINES}, x -> struct(xxhash64(x.line) AS h, length(x.line) AS size))").alias("lines"))
    lines = lines.filter(F.size("lines") > 0).withColumn("hashes", F.col("lines.h"))
    least = f"transform(sequence(0, size(hashes) - {run}), s -> array_min(transform(slice(hashes, s + 1, {run}), (h, i) -> struct(h AS h, -(s + i) AS at))))"
    chosen = lines.withColumn("chosen", F.expr(f"CASE WHEN size(hashes) >= {run} THEN {least} ELSE array() END"))
    heads = chosen.withColumn("heads", F.expr("CASE WHEN size(chosen) > 0 THEN filter(sequence(0, size(chosen) - 1), s -> s = 0 OR chosen[s].at != chosen[s - 1].at) ELSE array() END"))
    runs = f"transform(heads, (s, j) -> struct(chosen[s].h AS fp, s AS low, coalesce(try_element_at(heads, j + 2), size(chosen)) - 1 AS high, {run} AS n))"
    single = f"transform(filter(sequence(0, size(lines) - 1), s -> lines[s].size >= {long}), s -> struct(xxhash64(hashes[s], 'line') AS fp, s AS low, s AS high, 1 AS n))"
    whole = f"CASE WHEN size(hashes) < {run} THEN array(struct(xxhash64(hashes, 'document') AS fp, 0 AS low, 0 AS high, size(hashes) AS n)) ELSE array() END"
    rows = heads.withColumn("p", F.expr(f"explode(concat({runs}, {single}, {whole}))"))
    around = F.expr("slice(hashes, p.low + 1, p.high - p.low + p.n)")
    return rows.select("doc_id", "th", "p.fp", "p.low", "p.high", "p.n", around.alias("around"))


def repeated_windows(docs: DataFrame, run: int, long: int = 250) -> DataFrame:
    """doc_id, th, start and last line of each window that has an equal one earlier."""
    prints = stored(fingerprints(docs, run, long), "lines")  # read three times below
    shared = prints.groupBy("fp").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("fp")
    near = join_hot(prints, shared, ["fp"], ["doc_id", "low"])
    extended = near.select("doc_id", "th", "fp", "low", "n", "around", F.explode(F.sequence("low", "high")).alias("start"))
    extended = extended.select("doc_id", "th", "fp", "start", (F.col("start") + F.col("n") - 1).alias("last"), F.expr("slice(around, start - low + 1, n)").alias("agreed"))
    place: Column = F.struct("doc_id", "th", "start")
    first = extended.groupBy("fp", "agreed").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("fp", "agreed", "first")
    return join_hot(extended, first, ["fp", "agreed"], ["doc_id", "start"]).filter(place > F.col("first")).select("doc_id", "th", "start", "last")


def repeated_runs(windows: DataFrame, run: int) -> DataFrame:
    """doc_id, th, runs array<struct<a, b>>: the union of windows start..last as sorted intervals (both ends in).

    Without a column ``last`` each row is one window; with it, all windows from start to last.
    """
    if "last" not in windows.columns:
        windows = windows.withColumn("last", F.col("start"))
    order = Window.partitionBy("doc_id", "th").orderBy("start", "last")  # one document's windows
    before = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = windows.withColumn("fresh", (F.col("start") > F.coalesce(before, F.lit(-run - 1)) + run).cast("int")).withColumn("island", F.sum("fresh").over(order))
    runs = islands.groupBy("doc_id", "th", "island").agg(F.min("start").alias("a"), (F.max("last") + run - 1).alias("b"))
    return runs.groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("runs"))


def dedup_lines(docs: DataFrame, run: int = 3, long: int = 250, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input with ``text_col`` cleaned, and n_lines and n_removed (lines that are not blank) beside it.

    Blank lines inside a deleted run go with it; other blank lines stay.  A null text stays
    null with 0 lines; a null doc_id sorts first; rows of one doc_id and equal text are one
    document and are cleaned alike; rows of one doc_id and other texts are told apart by the
    text.  Other columns are kept as they are.  An empty table gives no rows.
    """
    plain = documents(docs, id_col, text_col)
    runs = repeated_runs(repeated_windows(plain, run, long), 1).withColumnsRenamed({"doc_id": "_doc_id", "th": "_th", "runs": "_runs"})
    text = F.col(f"`{text_col}`").cast("string")
    found = docs.join(runs, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("_doc_id")) & (F.xxhash64(text) == F.col("_th")), "left")
    out = found.withColumns({"_raw": F.split(text, "\n", -1), "_at": F.expr(f"transform({LINES.replace('text', f'cast(`{text_col}` as string)')}, x -> x.at)"), "_runs": F.coalesce("_runs", F.expr("cast(array() AS array<struct<a: int, b: int>>)"))})
    # the stretches before, between and after the deleted runs
    kept = """array_join(flatten(transform(sequence(0, size(_runs)), j -> slice(_raw,
        CASE WHEN j = 0 THEN 1 ELSE _at[_runs[j - 1].b] + 2 END,
        CASE WHEN j = size(_runs) THEN size(_raw) ELSE _at[_runs[j].a] END - CASE WHEN j = 0 THEN 0 ELSE _at[_runs[j - 1].b] + 1 END))), '\n')"""
    return out.withColumns(
        {
            text_col: F.when(F.size("_runs") == 0, text).otherwise(F.expr(kept)),
            "n_lines": F.coalesce(F.when(text.isNotNull(), F.size("_at")), F.lit(0)).cast("long"),
            "n_removed": F.expr("aggregate(_runs, 0L, (s, x) -> s + x.b - x.a + 1)"),
        }
    ).drop("_doc_id", "_th", "_raw", "_at", "_runs")


def oracle_sql(run: int = 3, long: int = 250) -> str:
    """DuckDB SQL for doc_id, n_lines, n_removed, text over documents."""
    return f"""
WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
full_lines AS (SELECT doc_id, pos, trim(line, ' ') AS line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM raw WHERE trim(line, ' ') <> ''),
windows AS (SELECT doc_id, k, {" || chr(10) || ".join(f"lead(line, {i}) OVER w" for i in range(run))} AS key FROM full_lines WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
passages AS (
    SELECT 'run' AS kind, doc_id, k, {run} AS n, key FROM windows WHERE key IS NOT NULL
    UNION ALL SELECT 'line', doc_id, k, 1, line FROM full_lines WHERE length(line) >= {long}
    UNION ALL SELECT 'document', doc_id, 1, count(*), string_agg(line, chr(10) ORDER BY k) FROM full_lines GROUP BY doc_id HAVING count(*) < {run}),
later AS (SELECT doc_id, k, n FROM (SELECT doc_id, k, n, row_number() OVER (PARTITION BY kind, key ORDER BY doc_id, k) AS nth FROM passages) WHERE nth > 1),
covered AS (SELECT DISTINCT doc_id, k + i AS k FROM later, range(0, {run}) t(i) WHERE i < n),
islands AS (SELECT doc_id, min(k) AS a, max(k) AS b FROM (SELECT doc_id, k, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS g FROM covered) GROUP BY doc_id, g),
spans AS (SELECT i.doc_id, x.pos AS a, y.pos AS b FROM islands i JOIN full_lines x ON x.doc_id = i.doc_id AND x.k = i.a JOIN full_lines y ON y.doc_id = i.doc_id AND y.k = i.b),
kept AS (SELECT r.doc_id, string_agg(r.line, chr(10) ORDER BY r.pos) AS text FROM raw r WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.doc_id = r.doc_id AND r.pos BETWEEN s.a AND s.b) GROUP BY r.doc_id)
SELECT d.doc_id, coalesce(l.n, 0)::BIGINT AS n_lines, coalesce(c.n, 0)::BIGINT AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN kept k USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM full_lines GROUP BY doc_id) l USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id) c USING (doc_id)
"""

"""Removal of repeated lines by overlapping three-line windows, in DataFrame functions only.

Every run of three consecutive lines is hashed.  Of each window that occurs more than once the first
occurrence (least document id, then text hash, then line) stays; the lines that later occurrences
cover are removed, overlapping occurrences being merged.  A text of fewer lines is one window.  Every removed line has an equal line at an
earlier place, so at least one copy of every line remains somewhere.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

WINDOW = 3


def _line_hashes(lines: Column) -> Column:
    """Two independent 64-bit hashes per line."""
    return F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), x).alias("b")))


def windows(df: DataFrame, window: int = WINDOW, *, short_texts: bool = True) -> DataFrame:
    """(doc_id, _key, pos, w1, w2): every window of lines with its 128-bit hash; pos counts from 1.

    A text of fewer lines has one window of all its lines, marked by their number, unless ``short_texts`` is off.
    """
    lines = F.split("text", "\n", -1)
    hashed = (
        df.filter(F.col("text").isNotNull())
        .select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("_key"), _line_hashes(lines).alias("_h"))
    )
    short = hashed.filter(F.size("_h") < window).select(
        "doc_id",
        "_key",
        F.lit(1).alias("pos"),
        F.xxhash64(F.size("_h"), "_h.a").alias("w1"),
        F.xxhash64(F.lit(7), F.size("_h"), "_h.b").alias("w2"),
    )
    hashed = hashed.filter(F.size("_h") >= window).withColumn("_count", F.size("_h") - (window - 1))
    runs = F.arrays_zip(*[F.slice("_h", i + 1, F.col("_count")).alias(f"l{i}") for i in range(window)])
    each = hashed.select("doc_id", "_key", F.posexplode(runs).alias("_p", "_run"))
    found = each.select(
        "doc_id",
        "_key",
        (F.col("_p") + 1).alias("pos"),
        F.xxhash64(*[F.col(f"_run.l{i}.a") for i in range(window)]).alias("w1"),
        F.xxhash64(F.lit(7), *[F.col(f"_run.l{i}.b") for i in range(window)]).alias("w2"),
    )
    return found.unionByName(short) if short_texts else found


def covered(found: DataFrame) -> DataFrame:
    """(doc_id, _key, starts): for each document the sorted starts of windows that occurred before."""
    place = F.struct("doc_id", "_key", "pos")
    first = (
        found.groupBy("w1", "w2")
        .agg(F.min(place).alias("_first"), F.max(place).alias("_last"))
        .filter(F.col("_first") != F.col("_last"))
        .select("w1", "w2", "_first")
    )
    later = found.join(first, ["w1", "w2"]).filter(place != F.col("_first"))
    return later.groupBy("doc_id", "_key").agg(F.array_sort(F.collect_set("pos")).alias("starts"))


def _kept(lines: Column, starts: Column, window: int) -> Column:
    """Lines outside the union of the windows at ``starts``: the slices between one window's end and the next's start."""

    def between(i: Column) -> Column:
        begin = F.when(i == 0, 1).otherwise(F.element_at(starts, F.greatest(i, F.lit(1))) + window)
        end = F.when(i == F.size(starts), F.size(lines)).otherwise(
            F.element_at(starts, F.least(i + 1, F.size(starts))) - 1
        )
        return F.slice(lines, begin, F.greatest(end - begin + 1, F.lit(0)))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(starts)), between))


def dedup_lines(df: DataFrame, *, window: int = WINDOW, short_texts: bool = True) -> DataFrame:
    """Each document of ``df(doc_id, text)`` without the lines that later window occurrences cover.

    Result: doc_id, n_lines, n_removed, text (the kept lines, joined by newlines).  The lines of a text
    that has fewer than a window are one window, so later copies of it lose them all; without ``short_texts`` such
    texts stay as they are.  A null text stays null with 0 lines; an empty text is one
    empty line.  Rows equal in id and text count as one document and all get its result.  Null ids
    come first in order.  Other columns are ignored.  An empty table gives an empty result.
    """
    docs = df.select("doc_id", "text")
    starts = covered(written(windows(docs, window, short_texts=short_texts), "line_windows"))
    keyed = docs.withColumn("_key", F.unhex(F.md5(F.col("text").cast("binary"))))
    joined = (
        keyed.alias("d")
        .join(
            starts.alias("s"),
            F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & F.col("d._key").eqNullSafe(F.col("s._key")),
            "left",
        )
        .select("d.doc_id", "d.text", "s.starts", F.split("d.text", "\n", -1).alias("_lines"))
    )
    cut = joined.select(
        "doc_id",
        "text",
        "_lines",
        F.when(F.col("starts").isNull(), F.col("_lines"))
        .otherwise(_kept(F.col("_lines"), F.col("starts"), window))
        .alias("_kept"),
    )
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size("_lines"))
    kept = F.when(F.col("text").isNull(), 0).otherwise(F.size("_kept"))
    return cut.select(
        "doc_id",
        lines.cast("long").alias("n_lines"),
        (lines - kept).cast("long").alias("n_removed"),
        F.when(F.col("text").isNotNull(), F.array_join("_kept", "\n")).alias("text"),
    )


def oracle(window: int = WINDOW) -> str:
    """The same in SQL, with the lines themselves in place of their hashes."""
    columns = ", ".join(
        f"lead(line, {i}) OVER (PARTITION BY doc_id, text ORDER BY pos) AS l{i}" for i in range(window)
    )
    keys = ", ".join(f"l{i}" for i in range(window))
    return f"""
WITH docs AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM docs
),
runs AS (SELECT doc_id, text, pos, {columns} FROM lines),
ranked AS (
  SELECT doc_id, text, pos,
         row_number() OVER (PARTITION BY {keys} ORDER BY doc_id NULLS FIRST, md5(text), pos) AS nth
  FROM runs WHERE l{window - 1} IS NOT NULL
),
short AS (
  SELECT doc_id, text, len(string_split(text, chr(10))) AS n, row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS FIRST) AS nth
  FROM docs WHERE len(string_split(text, chr(10))) < {window}
),
gone AS (
  SELECT DISTINCT doc_id, text, unnest(generate_series(pos, pos + {window - 1})) AS pos FROM ranked WHERE nth > 1
  UNION ALL
  SELECT doc_id, text, unnest(generate_series(1, n)) FROM short WHERE nth > 1
),
cut AS (
  SELECT l.doc_id, l.text, count(*) AS n_lines, count(g.pos) AS n_removed,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '') AS kept
  FROM lines l LEFT JOIN gone g ON l.doc_id IS NOT DISTINCT FROM g.doc_id AND l.text = g.text AND l.pos = g.pos
  GROUP BY l.doc_id, l.text
)
SELECT d.doc_id, coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_removed, 0) AS n_removed, c.kept AS text
FROM documents d LEFT JOIN cut c ON d.doc_id IS NOT DISTINCT FROM c.doc_id AND d.text = c.text
"""

"""Markdown runbooks: sections, chunks and their dense numbering.  One file is one row."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import text as tx
from ..functions.rows import explode_rows

_HEADER = r"(?mdU)(?=^#{2,3}\s+.)"
_TITLE = r"^(?:#{2,3})(?U:\s+)([^\n]+)"


def sections(markdown: Column) -> Column:
    """``array<struct<title, body>>``: parts under ## and ### headers; the preamble has no title.

    Empty bodies are dropped, except that a text without any header is one untitled section.
    """
    parts = F.split(markdown, _HEADER)
    has_header = F.rlike(markdown, F.lit(r"(?mdU)^#{2,3}\s+."))

    def section(part: Column) -> Column:
        titled = F.rlike(part, F.lit(_TITLE))
        title = F.when(titled, tx.strip(F.regexp_extract(part, _TITLE, 1)))
        body = F.when(titled, F.regexp_replace(part, _TITLE, "")).otherwise(part)
        return F.struct(title.alias("title"), tx.strip(body).alias("body"))

    found = F.filter(F.transform(parts, section), lambda s: s["body"] != "")
    whole = F.array(F.struct(F.lit(None).cast("string").alias("title"), tx.strip(markdown).alias("body")))
    return F.when(has_header, found).otherwise(whole)


def _pack(body: Column, max_chars: int, compat: bool) -> Column:
    """Paragraphs packed greedily into pieces, each starting with the tail of the one before."""
    paragraphs = F.filter(
        F.transform(F.split(body, r"\n{2,}"), tx.strip), lambda p: p != ""
    )
    start = F.struct(
        F.lit("").alias("current"), F.lit("").alias("tail"), F.array().cast("array<string>").alias("done")
    )

    def step(s: Column, p: Column) -> Column:
        def glue(head: Column) -> Column:
            return F.when(head != "", F.concat(head, F.lit("\n\n"), p)).otherwise(p)

        fits = F.length(s["current"]) + F.length(p) + 2 <= max_chars
        # The compatible form forgets the text gathered so far when a paragraph still fits.
        extended = tx.strip(glue(s["tail"])) if compat else glue(s["current"])
        rest = F.when(
            F.length(s["current"]) > fv.CHUNK_OVERLAP_CHARS, F.right(s["current"], F.lit(fv.CHUNK_OVERLAP_CHARS))
        ).otherwise(s["current"])
        flushed = F.when(s["current"] != "", F.array_append(s["done"], s["current"])).otherwise(s["done"])
        return F.when(
            fits, F.struct(extended.alias("current"), s["tail"].alias("tail"), s["done"].alias("done"))
        ).otherwise(
            F.struct(tx.strip(glue(rest)).alias("current"), rest.alias("tail"), flushed.alias("done"))
        )

    def close(s: Column) -> Column:
        return F.when(s["current"] != "", F.array_append(s["done"], s["current"])).otherwise(s["done"])

    return F.aggregate(paragraphs, start, step, close)


def chunk_runbooks(
    files: DataFrame,
    *,
    text: str = "markdown_text",
    keys: tuple[str, ...] = ("workspace_id", "source_file"),
    max_chars: int = fv.CHUNK_MAX_CHARS,
    min_chars: int = fv.CHUNK_MIN_CHARS,
    compat: bool = False,
) -> DataFrame:
    """Chunk rows (keys, chunk_index, section_title, chunk_text) of markdown files.

    Numbers are dense from 0 per file and come from the array position, so there is no shuffle.
    ``compat`` reproduces the lossy packing of long sections (see the README).
    """
    pieces = F.transform(
        "_sections",
        lambda s: F.transform(
            F.when(F.length(s["body"]) <= max_chars, F.array(s["body"])).otherwise(_pack(s["body"], max_chars, compat)),
            lambda c: F.struct(s["title"].alias("title"), tx.strip(c).alias("body")),
        ),
    )
    kept = F.filter(F.flatten("_pieces"), lambda c: F.length(c["body"]) >= min_chars)
    cut = files.withColumn("_sections", sections(F.coalesce(F.col(text), F.lit("")))).withColumn("_pieces", pieces)
    return explode_rows(cut, keys, kept, "_c", "chunk_index").select(
        *keys, "chunk_index", F.col("_c.title").alias("section_title"), F.col("_c.body").alias("chunk_text")
    )


def short_chunks(files: DataFrame, *, min_chars: int = fv.CHUNK_MIN_CHARS, keys: tuple[str, ...] = ("workspace_id", "source_file"), **options) -> DataFrame:
    """Per file: how many pieces :func:`chunk_runbooks` leaves out because they are shorter than ``min_chars``."""
    pieces = chunk_runbooks(files, keys=keys, min_chars=0, **options)
    return pieces.groupBy(*keys).agg(F.count_if(F.length("chunk_text") < min_chars).alias("chunks_short"))


def section_rows(
    files: DataFrame, *, text: str = "markdown_text", keys: tuple[str, ...] = ("workspace_id", "source_file")
) -> DataFrame:
    """Section rows (keys, section_no, section_title, body)."""
    return explode_rows(files, keys, sections(F.col(text)), "_s", "section_no").select(
        *keys, "section_no", F.col("_s.title").alias("section_title"), "_s.body"
    )


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("workspace_id", "source_file").agg(F.count(F.lit(1)).alias("chunks"))

"""Exception structure, category and signature of error blocks."""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import text as tx
from ..functions.rows import explode_rows
from .blocks import text_blocks


@dataclass(frozen=True)
class Limits:
    """How much of an exception is kept; None keeps all of it."""

    java_frames: int | None = None
    python_frames: int | None = None
    message: int | None = None
    cls: int | None = None
    task: int | None = None
    summary: int | None = None
    summary_causes: int | None = None
    summary_frames: int | None = None


WHOLE = Limits()
#: The cuts of the original forms.
COMPAT = Limits(
    fv.JAVA_FRAMES_MAX, fv.PYTHON_FRAMES_MAX, fv.GENERIC_MESSAGE_CHARS, fv.GENERIC_CLASS_CHARS, fv.TASK_CONTEXT_CHARS,
    fv.SUMMARY_MAX_CHARS, fv.SUMMARY_CAUSES, fv.SUMMARY_FRAMES,
)


def _cut(text: Column, limit: int | None) -> Column:
    return text if limit is None else F.substring(text, 1, limit)


def _has(c: Column, pattern: str) -> Column:
    return F.rlike(c, F.lit(pattern))


def _first(arr: Column) -> Column:
    return F.get(arr, F.lit(0))


def _short_class(c: Column) -> Column:
    return F.substring_index(c, ".", -1)


def alternatives(pattern: str) -> tuple[list[str], list[str]]:
    """(substrings, patterns) that together find what ``pattern``, a choice of texts and of texts with a gap, finds.

    A substring test is much cheaper than a pattern.  What holds another substring adds nothing and is left out.
    """
    choices = [x.replace(r"\.", ".") for x in pattern.split("|")]
    plain = [x for x in choices if ".*" not in x]
    plain = [x for x in plain if not any(y in x for y in plain if y != x)]
    gapped = [x for x in choices if ".*" in x and not any(y in side for y in plain for side in x.split(".*"))]
    return plain, gapped


def _category_hits(text: Column):
    for category, severity, pattern in fv.ERROR_CATEGORIES:
        literals, patterns = alternatives(pattern)
        tests = [F.contains(text, F.lit(x)) for x in literals] + [_has(text, p) for p in patterns]
        yield category, severity, reduce(lambda a, b: a | b, tests)


def classify(text: Column) -> Column:
    """First category, in catalogue order, that has a marker anywhere in ``text``."""
    expr = None
    for category, _, hit in _category_hits(text):
        expr = F.when(hit, F.lit(category)) if expr is None else expr.when(hit, F.lit(category))
    return expr.otherwise(F.lit(fv.DEFAULT_CATEGORY))


def severity_of(category: Column) -> Column:
    return tx.lookup({c: s for c, s, _ in fv.ERROR_CATEGORIES}, category, fv.DEFAULT_SEVERITY)


def _no_traceback() -> Column:
    return F.struct(
        F.lit(False).alias("inside"),
        F.lit("UnknownException").alias("cls"),
        F.lit("unknown").alias("msg"),
        F.array().cast("array<string>").alias("frames"),
    )


def _traceback(lines: Column, limits: Limits) -> Column:
    """Frames, class and message of Python tracebacks, read line by line in order.

    A frame or exception line counts only after a traceback header; an exception line ends the
    traceback.  The last exception wins.
    """
    pairs = F.transform(lines, lambda x, i: F.struct(x.alias("line"), F.get(lines, i + 1).alias("next")))

    def step(s: Column, p: Column) -> Column:
        line = p["line"]
        bare = tx.strip(line)
        path = F.regexp_extract(line, fv.PYTHON_FRAME, 1)
        frame = F.concat(
            path, F.lit(":"), F.regexp_extract(line, fv.PYTHON_FRAME, 2), F.lit(" in "),
            F.regexp_extract(line, fv.PYTHON_FRAME, 3), F.lit("() → "),
            F.coalesce(tx.strip(p["next"]), F.lit("")),
        )
        header = _has(line, fv.TRACEBACK_HEADER)
        is_frame = s["inside"] & _has(line, fv.PYTHON_FRAME)
        wanted = ~_has(path, fv.LIBRARY_PATH)
        if limits.python_frames is not None:
            wanted = wanted & (F.size(s["frames"]) < limits.python_frames)
        full = s["inside"] & _has(bare, fv.PYTHON_EXCEPTION)
        plain = s["inside"] & _has(bare, fv.PYTHON_EXCEPTION_BARE)

        def state(inside, cls, msg, frames):
            return F.struct(
                inside.alias("inside"), cls.alias("cls"), msg.alias("msg"), frames.alias("frames")
            )

        off = F.lit(False)
        return (
            F.when(header, state(F.lit(True), s["cls"], s["msg"], s["frames"]))
            .when(is_frame & wanted, state(s["inside"], s["cls"], s["msg"], F.array_append(s["frames"], frame)))
            .when(is_frame, s)
            .when(
                full,
                state(
                    off, F.regexp_extract(bare, fv.PYTHON_EXCEPTION, 1),
                    tx.strip(F.regexp_extract(bare, fv.PYTHON_EXCEPTION, 2)), s["frames"],
                ),
            )
            .when(
                plain,
                state(off, F.regexp_extract(bare, fv.PYTHON_EXCEPTION_BARE, 1), F.lit("no message"), s["frames"]),
            )
            .otherwise(s)
        )

    return F.aggregate(pairs, _no_traceback(), step)


_EMPTY = "array<string>"


def _record(form, cls, msg, root_cls, root_msg, chain, frames, task, text) -> Column:
    return F.struct(
        F.lit(form).alias("source_format"),
        cls.alias("exception_class"),
        msg.alias("exception_message"),
        root_cls.alias("root_cause_class"),
        root_msg.alias("root_cause_message"),
        chain.alias("causal_chain"),
        frames.alias("user_frames"),
        task.alias("task_context"),
        text.alias("raw_block"),
    )


def _java_record(lines: Column, text: Column, limits: Limits) -> Column:
    """Java trace: top exception, cause chain, root cause, user frames, task context."""
    return tx.let(F.transform(lines, lambda x: tx.strip(x)), lambda s: _java_parts(lines, s, text, limits))


def _java_parts(lines: Column, stripped: Column, text: Column, limits: Limits) -> Column:
    unknown = F.lit("UnknownException")
    exceptions = F.transform(
        F.filter(stripped, lambda x: _has(x, fv.JAVA_EXCEPTION)),
        lambda x: F.struct(
            _short_class(F.regexp_extract(x, fv.JAVA_EXCEPTION, 1)).alias("cls"),
            tx.strip(F.regexp_extract(x, fv.JAVA_EXCEPTION, 2)).alias("msg"),
        ),
    )
    caused = F.when(F.contains(text, F.lit("Caused by:")), F.filter(lines, lambda x: _has(x, fv.CAUSED_BY)))
    causes = F.transform(
        F.coalesce(caused, F.array().cast(_EMPTY)),
        lambda x: F.struct(
            _short_class(F.regexp_extract(x, fv.CAUSED_BY, 1)).alias("cls"),
            tx.strip(F.regexp_extract(x, fv.CAUSED_BY, 2)).alias("msg"),
        ),
    )
    first_text = F.coalesce(
        _first(F.filter(stripped, lambda x: x != "")), F.lit("UnknownException: unknown")
    )
    user = F.filter(stripped, lambda x: F.startswith(x, F.lit("at ")) & ~_has(x, fv.FRAMEWORK_FRAME))
    frames = F.transform(user, lambda x: F.substring(x, 4, 2_000_000_000))
    if limits.java_frames is not None:
        frames = F.slice(frames, 1, limits.java_frames)
    task = tx.strip(
        F.regexp_extract(_first(F.filter(lines, lambda x: _has(x, fv.TASK_CONTEXT))), fv.TASK_CONTEXT, 0)
    )
    # The Python error inside a PythonException; empty when there is none.
    wrapped = F.when(
        F.contains(text, F.lit("PythonException")), tx.strip(F.regexp_extract(text, fv.PYTHON_EXCEPTION_INNER, 1))
    ).otherwise(F.lit(""))

    def root(parts: Column) -> Column:
        top, last, inner = parts["top"], F.try_element_at(parts["causes"], F.lit(-1)), parts["inner"]
        cls = F.coalesce(last["cls"], top["cls"], unknown)
        msg = F.when(last.isNotNull(), last["msg"]).otherwise(top["msg"])
        replaced = (cls == F.coalesce(top["cls"], unknown)) & (inner != "")
        return F.when(
            replaced,
            F.struct(
                tx.strip(F.substring_index(inner, ":", 1)).alias("cls"),
                tx.strip(F.regexp_replace(inner, r"(?s)^[^:]*:", "")).alias("msg"),
            ),
        ).otherwise(F.struct(cls.alias("cls"), F.when(msg != "", msg).otherwise(F.lit("unknown")).alias("msg")))

    def record(parts: Column, found: Column) -> Column:
        return _record(
            "spark_java", F.coalesce(parts["top"]["cls"], unknown), F.coalesce(parts["top"]["msg"], first_text),
            found["cls"], found["msg"],
            F.transform(parts["causes"], lambda c: F.concat(c["cls"], F.lit(": "), c["msg"])),
            frames, task, text,
        )

    parts = F.struct(_first(exceptions).alias("top"), causes.alias("causes"), wrapped.alias("inner"))
    return tx.let(parts, lambda p: tx.let(root(p), lambda r: record(p, r)))


def _python_record(lines: Column, text: Column, limits: Limits) -> Column:
    """Python traceback or scheduler line: class, message, frames, task context."""
    context = F.when(
        F.contains(text, F.lit("{taskinstance.py:")), _first(F.filter(lines, lambda x: _has(x, fv.AIRFLOW_CONTEXT)))
    )
    task = _cut(tx.strip(F.regexp_extract(context, fv.AIRFLOW_CONTEXT, 1)), limits.task)
    found = F.when(F.contains(text, F.lit("Traceback (most recent call last):")), _traceback(lines, limits)).otherwise(
        _no_traceback()
    )
    return tx.let(
        found,
        lambda t: _record(
            "airflow", t["cls"], t["msg"], t["cls"], t["msg"], F.array().cast(_EMPTY), t["frames"], task, text,
        ),
    )


def _plain_record(cls: Column, msg: Column, text: Column, limits: Limits) -> Column:
    none = F.array().cast(_EMPTY)
    message = _cut(msg, limits.message)
    return _record(
        "generic", cls, message, cls, message, none, none, F.lit(None).cast("string"), text
    )


def _is_java(text: Column) -> Column:
    return (
        tx.contains_any(text, ["Caused by:", "PythonException"])
        | (F.contains(text, F.lit("at ")) & _has(text, fv.JAVA_STACK_FRAME))
        | (F.contains(tx.fold_case(text), F.lit("task")) & _has(text, fv.TASK_CONTEXT))
    )


def _is_python(text: Column) -> Column:
    return (
        _has(text, fv.TRACEBACK_HEADER)
        | (F.contains(text, F.lit("{taskinstance.py:")) & _has(text, fv.AIRFLOW_CONTEXT))
        | _has(text, fv.PYTHON_EXCEPTION)
    )


def debug_context(e: Column, limits: Limits = WHOLE) -> Column:
    """Text of an exception struct: context, exception, causes, root cause, user frames."""
    last, frames = e["causal_chain"], e["user_frames"]
    if limits.summary_causes is not None:
        kept = limits.summary_causes
        last = F.slice(last, F.greatest(F.size(last) - kept + 1, F.lit(1)), kept)
    if limits.summary_frames is not None:
        frames = F.slice(frames, 1, limits.summary_frames)

    def listed(title: str, items: Column, mark: str) -> Column:
        body = F.array_join(F.transform(items, lambda x: F.concat(F.lit(mark), x)), "\n")
        return F.when(F.size(items) > 0, F.concat(F.lit(title + "\n"), body))

    text = F.concat_ws(
        "\n",
        F.when(e["task_context"] != "", F.concat(F.lit("Task context: "), e["task_context"])),
        F.concat(F.lit("Exception: "), e["exception_class"], F.lit(": "), e["exception_message"]),
        listed("Caused by chain:", last, "  → "),
        F.when(
            e["root_cause_class"] != e["exception_class"],
            F.concat(F.lit("Root cause: "), e["root_cause_class"], F.lit(": "), e["root_cause_message"]),
        ),
        listed("User code frames:", frames, "  "),
    )
    return _cut(text, limits.summary)


def exception_of_block(lines: Column, limits: Limits = WHOLE) -> Column:
    """Exception struct of one block (an array of its lines)."""

    def record(text: Column) -> Column:
        generic = _plain_record(
            F.lit("UnknownError"), _first(tx.split_lines(tx.strip(text))), text, limits
        )
        return (
            F.when(_is_java(text), _java_record(lines, text, limits))
            .when(_is_python(text), _python_record(lines, text, limits))
            .otherwise(generic)
        )

    return tx.let(F.array_join(lines, "\n"), record)


def exception_of_message(message: Column, *, full_traceback: bool = False, limits: Limits = WHOLE) -> Column:
    """Exception struct of a message: its first block, else the text before the first colon.

    ``full_traceback`` reads a Python traceback over the whole message.  The block rule cuts one at
    its code lines, so by default the class on the last line is often lost.
    """

    def without_block(text: Column) -> Column:
        head = _cut(tx.strip(F.substring_index(text, ":", 1)), limits.cls)
        cls = F.when(head == "", F.lit("UnknownError")).otherwise(head)
        return _plain_record(cls, text, text, limits)

    by_block = tx.let(
        _first(text_blocks(message)),
        lambda block: F.when(block.isNotNull(), exception_of_block(block, limits)).otherwise(
            without_block(F.coalesce(message, F.lit("")))
        ),
    )
    if not full_traceback:
        return by_block
    traced = F.contains(message, F.lit("Traceback (most recent call last):")) & ~_is_java(message)
    return F.when(traced, _python_record(tx.split_lines(message), message, limits)).otherwise(by_block)


FIELDS = [
    "source_format", "exception_class", "exception_message", "root_cause_class", "root_cause_message",
    "causal_chain", "user_frames", "task_context", "raw_block",
]


def _described(e: Column, limits: Limits) -> Column:
    """The exception struct with category, severity, signature and summary; plain text has no category."""

    def full(category: Column) -> Column:
        return F.struct(
            *[e[f].alias(f) for f in FIELDS],
            category.alias("category"),
            severity_of(category).alias("severity"),
            F.concat_ws(":", category, e["root_cause_class"]).alias("signature"),
            debug_context(e, limits).alias("summary"),
        )

    category = F.when(e["source_format"] == "generic", F.lit(fv.DEFAULT_CATEGORY)).otherwise(classify(e["raw_block"]))
    return tx.let(category, full)


def _described_by(exception, limits: Limits):
    """Builds and remembers the described exception of a column."""
    return tx.remembered(lambda name: tx.let(exception(F.col(name), limits), lambda e: _described(e, limits)))


def _whole_traceback(c: Column, limits: Limits) -> Column:
    return exception_of_message(c, full_traceback=True, limits=limits)


def _by_block(c: Column, limits: Limits) -> Column:
    return exception_of_message(c, limits=limits)


_COLUMNS = {
    (form, limits): _described_by(form, limits)
    for form in (exception_of_block, _whole_traceback, _by_block)
    for limits in (WHOLE, COMPAT)
}


def _with_fields(df: DataFrame, exception: Column) -> DataFrame:
    """The fields as columns.  The struct comes out of a generator, so that it is computed once and a filter on a
    field stays behind it instead of being copied into the expression."""
    kept = [c for c in df.columns if c not in (*FIELDS, "category", "severity", "signature", "summary")]
    return explode_rows(df, kept, F.array(exception), "_e", "_one").select(*kept, "_e.*")


def extract_exceptions(blocks: DataFrame, block: str = "block", *, compat: bool = False) -> DataFrame:
    """Exception fields for a column of block lines; expressions only, no shuffle.

    Frames, causes, messages and summaries are whole; ``compat`` cuts them as the original forms do.
    """
    return _with_fields(blocks, _COLUMNS[exception_of_block, COMPAT if compat else WHOLE](block))


def parse_errors(df: DataFrame, column: str = "message", *, full_traceback: bool = False, compat: bool = False) -> DataFrame:
    """Exception fields of the first block of each message; one output row per input row.

    Row-local, so it needs no shuffle and works on streams.  ``compat`` cuts long values (see
    ``extract_exceptions``).
    """
    form = _whole_traceback if full_traceback else _by_block
    return _with_fields(df, _COLUMNS[form, COMPAT if compat else WHOLE](column))


def parse_all_blocks(df: DataFrame, column: str = "message", *, compat: bool = False) -> DataFrame:
    """Exception fields of every block: one output row per block, with block_no from 0."""
    exploded = explode_rows(df, ["*"], text_blocks(F.col(column)), "_block", "block_no")
    return extract_exceptions(exploded, "_block", compat=compat).drop("_block")

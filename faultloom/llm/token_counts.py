"""Token counts without token ids.

A text is cut into pre-tokens across which the tokenizer can never merge, so its count is the sum of
its pre-tokens' counts.  Pieces are counted once per distinct pre-token of the corpus.  Documents
keep their pre-token frequencies: the most frequent pre-tokens, a table of bounded size, are summed
where the text is read; the others are joined to their counts by a shuffle that has no hot key, since
what is frequent is not in it.
"""

import re
import sys
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frequent, rows_of, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The pre-tokens sent to every task: at most so many, each at most so long, together at most so many bytes.
HEAD_ROWS = 1 << 18
HEAD_WORD_BYTES = 64
HEAD_BYTES = 8 << 20
#: Distinct pre-tokens a task gathers before it passes their counts on.
FLUSH = 200_000

# ASCII characters other than letters, space and newline.
_MARK = r"[\x00-\x09\x0b-\x1f!-@\[-`{-\x7f]"
_LETTER = "[A-Za-zÀ-ÖØ-öø-ɏА-я]"
#: A line feed stands alone; spaces go with what follows them.  Latin and Cyrillic letters and ASCII marks are cut from
#: each other, but
#: what stands next to any other character runs on to the next space.
PIECES = re.compile(rf"\n| *{_LETTER}++(?={_MARK}|[ \n]|\Z)| *{_MARK}++(?={_LETTER}|[ \n]|\Z)| *[^ \n]+| +")


def check_cuts(pieces: list[str], space: str = "▁") -> None:
    """Raise unless no vocabulary piece spans a place where ``PIECES`` cuts.

    A merge across a cut would be such a piece, so without one the pre-tokens are independent.
    """
    for piece in pieces:
        if len(PIECES.findall(piece.replace(space, " "))) > 1:
            raise ValueError(f"the vocabulary piece {piece!r} spans a cut")


def load_counter(path: str):
    """A function that counts the pieces of each pre-token, for a byte-fallback BPE model file of sentencepiece.

    The text begins with a space that the library adds.  A pre-token is counted behind a line feed,
    which no piece of the vocabulary contains, less the two tokens of that added space and the feed.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    own = (i for i in range(model.get_piece_size()))
    check_cuts([model.id_to_piece(i) for i in own if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))])
    base = len(model.encode("\n"))

    def count(pretokens: list[str]) -> list[int]:
        return [len(x) - base for x in model.encode(["\n" + p for p in pretokens], num_threads=1)]

    return count


def pretokens(text: str | None) -> list[str]:
    """Pre-tokens of a text with the space that the library puts before it; an empty text has none."""
    return PIECES.findall(" " + text.replace("▁", " ")) if text else []


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    seen: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            seen.update(pretokens(text))
            if len(seen) >= FLUSH:
                yield {"pretoken": list(seen), "n": list(seen.values())}
                seen = Counter()
    yield {"pretoken": list(seen), "n": list(seen.values())}


def vocabulary(df: DataFrame, path: str) -> DataFrame:
    """(pretoken, n, pieces): the distinct pre-tokens of all texts, how often they occur, and their piece counts."""
    counted = rows_of(df.select("text"), "pretoken string, n long", _gather).groupBy("pretoken").agg(F.sum("n").alias("n"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        count = load_counter(path)
        for batch in batches:
            tokens = batch.column("pretoken").to_pylist()
            yield {"pretoken": tokens, "n": batch.column("n"), "pieces": count(tokens)}

    return written(rows_of(counted, "pretoken string, n long, pieces int", pieces), "token_vocabulary")


def head_of(vocab: DataFrame) -> dict[str, int]:
    """The most frequent pre-tokens with their counts, within the bounds above."""
    rows = frequent(vocab, "pretoken", "n", rows=HEAD_ROWS, word_bytes=HEAD_WORD_BYTES, size=HEAD_BYTES)
    return dict(zip(rows.column("pretoken").to_pylist(), rows.column("pieces").to_pylist()))


def count_tokens(df: DataFrame, path: str, *, limit: int = 4096) -> DataFrame:
    """Token counts of ``df(doc_id, text)`` under the model file at ``path``.

    Result, one row per input row: doc_id, n_bytes (UTF-8), n_tokens (no begin or end token),
    over_limit (more than ``limit``).  Null texts count as empty, with 0 tokens.  Repeated rows are
    counted each; other columns are ignored; an empty table gives an empty result.
    """
    docs = df.select("doc_id", "text")
    vocab = vocabulary(docs, path)
    head = docs.sparkSession.sparkContext.broadcast(head_of(vocab))
    ident = docs.schema["doc_id"].dataType.simpleString()

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        known = head.value
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out: dict[str, list] = {k: [] for k in ("row", "doc_id", "n_bytes", "n_known", "pretoken", "n")}
            for doc_id, text in zip(ids, batch.column(1).to_pylist()):
                row += 1
                total, rest = 0, []
                tokens = pretokens(text)
                for token, n in zip(tokens, map(known.get, tokens)):
                    if n is None:
                        rest.append(token)
                    else:
                        total += n
                tail = Counter(rest)
                out["row"] += [row] * (len(tail) + 1)
                out["doc_id"] += [doc_id] + [None] * len(tail)
                out["n_bytes"] += [len(text.encode()) if text else 0] + [None] * len(tail)
                out["n_known"] += [total] + [None] * len(tail)
                out["pretoken"] += [None, *tail]
                out["n"] += [None, *tail.values()]
                if len(out["row"]) > FLUSH:
                    yield out
                    out = {k: [] for k in out}
            yield out

    # Written once, so the row numbers of both parts agree whatever is computed again.
    parts = written(
        rows_of(docs, f"row long, doc_id {ident}, n_bytes long, n_known long, pretoken string, n int", frequencies),
        "token_frequencies",
    )
    tail = (
        parts.filter(F.col("pretoken").isNotNull())
        .select("row", "pretoken", "n")
        .join(vocab.select("pretoken", "pieces"), "pretoken")
        .groupBy("row")
        .agg(F.sum(F.col("n").cast("long") * F.col("pieces")).alias("n_tail"))
    )
    whole = parts.filter(F.col("pretoken").isNull()).select("row", "doc_id", "n_bytes", "n_known")
    tokens = F.col("n_known") + F.coalesce(F.col("n_tail"), F.lit(0))
    return whole.join(tail, "row", "left").select(
        "doc_id", "n_bytes", tokens.alias("n_tokens"), (tokens > limit).alias("over_limit")
    )

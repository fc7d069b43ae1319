"""Growing log files: lines once and whole, blocks over the edges of pieces, batches and restarts."""

import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from faultloom.operators import blocks
from faultloom.sources import tail
from faultloom.streaming import block_stream


def ran(stream, root, name):
    writer = stream.writeStream.format("parquet").option("path", f"{root}/{name}").option("checkpointLocation", f"{root}/{name}-checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/{name}")


def read(spark, root, **options):
    got = ran(tail.tail_log_lines(spark, str(root / "logs"), **options), root, "lines")
    return sorted((r["path"].rpartition("/")[2], r["seen"], r["offset"], r["line"]) for r in got.collect())


@pytest.mark.parametrize("seed", range(30))
def test_pieces_hold_every_line_once(seed):
    rng = random.Random(seed)
    raw = "".join(rng.choice(["a", "é", "\n", "\r\n", "\r", "word ", "\n\n"]) for _ in range(200)).encode()
    file = pa.BufferReader(raw)
    end = tail.whole_lines(file, len(raw))
    assert end == raw.rfind(b"\n") + 1
    for size in (1, 2, 7, 50, 10_000):
        now = {"f": {"position": end, "heads": [], "seen": 0}}
        got = [row for piece in tail.pieces({}, now, size) for row in tail.lines_of(file, piece)]
        want = raw[:end].replace(b"\r\n", b"\n").replace(b"\r", b"\n").split(b"\n")[:-1] if end else []
        assert [line for _, line in got] == want
        assert [o for o, _ in got] == sorted({o for o, _ in got}) and all(raw[o : o + len(x)] == x for o, x in got)


def test_long_lines_and_blocks_of_reading(monkeypatch):
    monkeypatch.setattr(tail, "BLOCK", 8)
    raw = b"x" * 100 + b"\n" + b"y" * 33 + b"\n\nz"
    file = pa.BufferReader(raw)
    assert tail.whole_lines(file, len(raw)) == 136
    now = {"f": {"position": 136, "heads": [], "seen": 0}}
    for size in (5, 40, 200):
        got = [line for piece in tail.pieces({}, now, size) for _, line in tail.lines_of(file, piece)]
        assert got == [b"x" * 100, b"y" * 33, b""]


def test_offsets_alone_tell_grown_files_from_new_ones():
    def state(raw):
        file = pa.BufferReader(raw)
        position = tail.whole_lines(file, len(raw))
        return {"position": position, "heads": tail.heads(file, position), "seen": 0}

    old = state(b"line\n" * 20)
    assert tail.follows(old, state(b"line\n" * 30)) and tail.follows(old, old)
    assert not tail.follows(old, state(b"line\n" * 10)) and not tail.follows(old, state(b"other\n" * 40))
    assert [(p.start, p.end) for p in tail.pieces({"f": old}, {"f": state(b"line\n" * 30), "g": old}, 80)] == [(100, 150), (0, 80), (80, 100)]
    assert [(p.start, p.end) for p in tail.pieces({"f": old}, {"f": state(b"other\n" * 20)}, 1000)] == [(0, 120)]
    assert tail.pieces({"f": old}, {}) == [] and tail.pieces({"f": old}, {"f": old}) == []


def test_appended_lines_are_read_once_over_restarts(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "other.csv").write_text("no\n")
    assert read(spark, tmp_path) == []
    whole = ["first", "", "ünïcode line", "  at x", "last"] * 40
    raw = "".join(f"{x} {i}\n" for i, x in enumerate(whole)).encode() + b"half"
    want = [f"{x} {i}" for i, x in enumerate(whole)]
    for share in (0.1, 0.35, 0.36, 0.8, 0.8, 1.0):
        with open(logs / "a.log", "ab") as file:
            file.write(raw[file.tell() : int(len(raw) * share)])
        got = [line for _, _, _, line in read(spark, tmp_path, piece_bytes=97)]
        assert sorted(got) == sorted(want[: len(got)])
    assert len(got) == len(want)
    (logs / "a.log").write_bytes(b"cut\n")
    (logs / "b.txt").write_bytes(b"bad \xff byte\r\nno end")
    new = [(p, line) for p, _, _, line in read(spark, tmp_path) if line not in want]
    assert sorted(new) == [("a.log", "cut"), ("b.txt", "bad � byte")]
    # A file at rest has no writer any more.
    time.sleep(1.1)
    assert ("b.txt", "no end") in [(p, line) for p, _, _, line in read(spark, tmp_path, settled=1)]


def text_blocks(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(blocks.text_blocks(F.col("t")).alias("b")).first()
    return ["\n".join(b) for b in row["b"]]


def stream(spark, root, **options):
    with block_stream.with_state_store(spark):
        lines = tail.tail_log_lines(spark, str(root / "logs"), piece_bytes=60)
        return ran(block_stream.stream_blocks(lines, **options), root, "blocks")


def test_streamed_blocks_equal_batch_blocks(spark, tmp_path):
    rng = random.Random(2)
    pool = ["INFO ok", "ERROR first", "java.lang.Exception: x", "\tat a.b(C.java:1)", "Caused by: y", "  at z", "plain", "FATAL end"]
    logs = tmp_path / "logs"
    logs.mkdir()
    texts = {f"f{i}.log": [rng.choice(pool) + (f" {n}" if n % 3 else "") for n in range(rng.randrange(1, 60))] for i in range(4)}
    texts["long.log"] = ["ERROR long"] + ["\tat frame"] * 50
    for share in (0.3, 0.31, 0.7, 1.0):
        for name, lines in texts.items():
            raw = "".join(f"{x}\n" for x in lines).encode()
            (logs / name).write_bytes(raw[: int(len(raw) * share)] + (b"closed\n" if share == 1.0 else b""))
        parts = stream(spark, tmp_path, part_lines=4)
    assert max(len(r["lines"]) for r in parts.collect()) <= 4
    got = sorted((r["path"].rpartition("/")[2], "\n".join(r["lines"])) for r in block_stream.joined_blocks(parts).collect())
    assert got == sorted((name, b) for name, lines in texts.items() for b in text_blocks(spark, "\n".join(lines)))


def test_open_blocks_are_closed_by_time_and_by_new_files(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.log").write_text("ERROR a\n  at a\n")
    (logs / "b.log").write_text("ERROR b\n  at b\n")
    options = {"timeout_ms": 1000, "skew": "0 seconds"}
    assert stream(spark, tmp_path, **options).count() == 0
    (logs / "b.log").write_text("new\n")  # shorter: starts anew
    assert [r["lines"] for r in stream(spark, tmp_path, **options).collect()] == [["ERROR b", "  at b"]]
    time.sleep(1.5)
    (logs / "c.log").write_text("tick\n")  # shows that time has passed
    stream(spark, tmp_path, **options)
    (logs / "a.log").write_text("ERROR a\n  at a\n  at late\n")
    got = block_stream.joined_blocks(stream(spark, tmp_path, **options)).collect()
    assert sorted(r["lines"] for r in got) == [["ERROR a", "  at a"], ["ERROR b", "  at b"]]

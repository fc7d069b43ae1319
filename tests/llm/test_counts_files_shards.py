"""Token counts, token files, sharding and mixing against the libraries and brute force."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import SCHEMA, messy_rows, prose, row
from pyspark.sql import functions as F

from faultloom.llm import mixing, sharding, token_counts, token_files
from faultloom.llm.queries import tokenizer_file

WORDS = tokenizer_file("word_bpe_49k.json")
PIECES = tokenizer_file("piece_bpe_32k.model")


def sentence_counts(texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    return [len(model.encode(t or "")) for t in texts]


def test_token_counts_equal_the_library(messy):
    got = Counter(tuple(r) for r in token_counts.count_tokens(messy, PIECES, limit=50).collect())
    texts = [r[1] for r in messy_rows()]
    want = Counter(
        (r[0], len((r[1] or "").encode()), n, n > 50) for r, n in zip(messy_rows(), sentence_counts(texts))
    )
    assert got == want


def test_token_counts_without_head(messy, monkeypatch):
    monkeypatch.setattr(token_counts, "HEAD_ROWS", 5)
    got = sorted(r["n_tokens"] for r in token_counts.count_tokens(messy, PIECES).collect())
    assert got == sorted(sentence_counts([r[1] for r in messy_rows()]))


@pytest.mark.parametrize("piece", ["ab.c", "a\nb", "a1"])
def test_vocabularies_that_span_a_cut_are_refused(piece):
    with pytest.raises(ValueError):
        token_counts.check_cuts(["▁the", piece])


def library_ids(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(WORDS).encode(text or "", add_special_tokens=False).ids, 2]


def test_token_files_round_trip(messy, spark, tmp_path):
    folder = f"file://{tmp_path}/tokens"
    index, folder = token_files.write_tokens(messy, WORDS, length=64, folder=folder)
    got = [tuple(r) for r in token_files.read_tokens(index, folder).orderBy("start").collect()]
    rows = sorted(messy_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start, want = 0, []
    for r in rows:
        ids = library_ids(r[1])
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert token_files.sequences(spark, folder, index).agg(F.sum("n_real")).first()[0] == start


def test_token_file_gives_any_sequence(tmp_path):
    import pyarrow as pa

    uri = f"file://{tmp_path}/x.arrow"
    ids = np.arange(10_007) % 60_000
    writer = token_files.SequenceWriter(uri, pa.uint16(), 16)
    for part in np.array_split(ids, 37):
        writer.add(part)
    writer.close()
    file = token_files.SequenceFile(uri)
    assert len(file) == -(-len(ids) // 16)
    sequence, mask = file.sequence(len(file) - 1)
    assert mask.sum() == len(ids) % 16 and list(sequence[mask]) == list(ids[-(len(ids) % 16) :])
    assert list(file.sequence(200)[0]) == list(ids[3200:3216])
    assert list(file.run(2040, 5000)) == list(ids[2040:7040])
    with pytest.raises(ValueError):
        file.run(10_100, 100)


def test_encoder_equals_library_for_odd_texts():
    encoder = token_files.WordEncoder(WORDS)
    odd = ["", "It's a DOG's life. 're'st", "<|endoftext|>the<|ENDOFTEXT|>", "É́cole İstanbul ΑΣ. ≠x ﬁ", "a\x1cb c\x85d\xa0f", "..'s ''ll x'Ll"]
    assert [list(np.frombuffer(b, "<u4")) for b in encoder.encode(odd)] == [library_ids(t)[:-1] for t in odd]


def test_encoder_equals_library_at_the_end_of_latin_words():
    """Every letter that the encoder cuts off at an ASCII mark, and İ, before every mark; and random mixtures."""
    import random
    import re

    encoder = token_files.WordEncoder(WORDS)
    letters = [chr(c) for c in range(0x250) if re.match(f"{token_files._LATIN}|İ", chr(c))]
    marks = [chr(c) for c in range(128) if not chr(c).isalnum()]
    texts = ["TÜRKİYE CUMHURİYETİ, ANKARA", "BELEDİYESİ.", "Sİ<b>"]
    texts += [f"ab{a}{m}x {a}{m} {a.upper()}{a}{m}{m}" for a in letters for m in marks]
    rng = random.Random(1)
    pool = letters + marks * 3 + [" "] * 40 + list("0123456789日本語ﬁ\u0307\u0301") + ["<|", "|>", "İ", "İ"]
    texts += ["".join(rng.choices(pool, k=rng.randrange(1, 40))) for _ in range(20_000)]
    want = [np.array(e.ids, "<u4").tobytes() for e in encoder.library.encode_batch_fast(texts, add_special_tokens=False)]
    assert [t for t, a, b in zip(texts, encoder.encode(texts), want) if a != b] == []


def test_one_id_in_many_rows_goes_to_many_files(spark):
    rows = [(7, f"text number {i}") for i in range(400)] + [(i, "other") for i in range(100, 500)]
    setting = "spark.sql.adaptive.coalescePartitions.enabled"  # small ranges would be put together again
    spark.conf.set(setting, "false")
    try:
        index, folder = token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), WORDS)
    finally:
        spark.conf.unset(setting)
    assert index.filter("doc_id = 7").select("part").distinct().count() > 2
    got = token_files.read_tokens(index, folder)
    assert [r["doc_id"] for r in got.orderBy("start").collect()] == sorted(i for i, _ in rows)


def test_sharding_law(messy):
    got = sharding.place(messy).collect()
    assert len(got) == len(messy_rows())
    by_id, slots = defaultdict(set), defaultdict(list)
    for r in got:
        by_id[r["doc_id"]].add((r["shard"], r["grown_shard"]))
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 8)
    assert all(len(v) == 1 for v in by_id.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in messy_rows())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want


def shards_of(spark, tree, n=4000):
    df = sharding.assign(spark.range(n).withColumnRenamed("id", "doc_id"), tree)
    return [r["shard"] for r in df.orderBy("doc_id").collect()]


def test_weight_change_moves_rows_only_through_its_path(spark):
    from faultloom.llm.sharding import Node, shard_node

    def tree(weight):
        racks = lambda r: tuple(Node(f"r{r}.k{k}", tuple(shard_node(4 * r + 2 * k + i, weight if (r, k, i) == (1, 0, 1) else 1.0) for i in range(2))) for k in range(2))
        return Node("root", tuple(Node(f"r{r}", racks(r)) for r in range(2)))

    before, after = shards_of(spark, tree(1.0)), shards_of(spark, tree(3.0))
    moved = [(a, b) for a, b in zip(before, after) if a != b]
    # Shard 5 lies in the first rack of region 1: rows move into that region, that rack or that shard, never among others.
    assert moved and all(b >= 4 for _, b in moved)
    assert not [m for m in moved if m[0] in (6, 7) and m[1] in (6, 7)]
    counts = Counter(after)
    assert abs(counts[5] / len(after) - 3 / 10) < 0.04


def test_growth_takes_rows_only_into_the_new_shard(spark):
    for n in (1, 3, 8, 9, 10):
        a, b = shards_of(spark, sharding.tree_of(n)), shards_of(spark, sharding.tree_of(n + 1))
        assert set(a) == set(range(n)) and all(x == y or y == n for x, y in zip(a, b)) and n in b


def test_no_shards():
    with pytest.raises(ValueError):
        sharding.tree_of(0)


def words(text):
    import re

    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes):
    order = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    low, high = 0.0, 1e12
    for _ in range(300):  # the level at which capped shares add up to all words
        level = (low + high) / 2
        total = sum(min(3 * sizes[s], weight[s] * level) for s in order)
        low, high = (level, high) if total < sum(sizes.values()) else (low, level)
    return {s: min(3 * sizes[s], weight[s] * low) for s in order}


def test_mixing_meets_targets(spark, messy):
    got = mixing.mix(messy).collect()
    sizes = Counter()
    for r in messy_rows():
        sizes[r[3]] += words(r[1])
    targets = brute_targets(sizes)
    taken = Counter()
    for r in got:
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - targets[r["source"]]) < 1e-3 * max(1, r["target"])
        taken[r["source"]] += r["taken"]
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], words(r[1])) for r in messy_rows())
    again = mixing.mix(messy.repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mixing_balances_words_and_documents(spark):
    docs = spark.createDataFrame([row(i, prose(i, 5 + i % 90), "ab"[i % 2]) for i in range(3000)], SCHEMA)
    got = mixing.mix(docs).collect()
    for source in "ab":
        own = [r for r in got if r["source"] == source]
        ratio = own[0]["target"] / own[0]["source_size"]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) < 5
        assert abs(sum(r["copies"] for r in own) - ratio * len(own)) < 6


def test_many_blocks_balance_as_one(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 50)
    units = spark.createDataFrame([(0, (i * 2654435761) << 7, i, 10 + i % 37, 0.3) for i in range(2000)], "grp int, ordinal long, tie long, size long, p double")
    chosen = {r["tie"]: r["p"] for r in mixing.balanced(units, 2000, 50).collect()}
    assert len(chosen) == 2000 and set(chosen.values()) <= {0.0, 1.0}
    assert abs(sum(chosen.values()) - 600) <= 2
    assert abs(sum((10 + i % 37) * p for i, p in chosen.items()) - sum(0.3 * (10 + i % 37) for i in range(2000))) < 5


def test_flight_keeps_totals_and_probabilities():
    import random

    rng, hits = random.Random(4), Counter()
    sizes = [3, 8, 5, 13, 2, 9]
    for _ in range(4000):
        state, taken = [], {}
        for i, size in enumerate(sizes):
            state, decided = mixing.flight(state, size, i, 0.4, rng.random())
            taken.update(decided)
        left = {u[2]: u[0] for u in state}
        assert abs(sum(sizes[i] * (left[i] if i in left else taken[i]) for i in range(6)) - 16) < 1e-6
        for i in range(6):
            hits[i] += left.get(i, taken.get(i))
    assert all(abs(hits[i] / 4000 - 0.4) < 0.03 for i in range(6))


def test_taken_rows_follow_the_decision(messy):
    want = Counter()
    for r in mixing.mix(messy).collect():
        want[r["doc_id"], r["source"]] += r["copies"]
    got = mixing.taken(messy)
    assert got.columns == messy.columns
    assert Counter((r["doc_id"], r["source"]) for r in got.collect()) == +want


def test_empty_tables(empty):
    assert token_counts.count_tokens(empty, PIECES).count() == 0
    assert token_files.token_output(empty, WORDS).count() == 0
    assert sharding.place(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    assert mixing.taken(empty).count() == 0


def test_frequent_words_are_the_top_by_count(spark):
    from faultloom.llm.common import frequent

    rows = [(f"w{i}", 1 + (i * 7919) % 5000) for i in range(6000)] + [("x" * 100, 10**9), ("big", 10**7)]
    counts = spark.createDataFrame(rows, "word string, n long").repartition(5)
    got = frequent(counts, "word", "n", rows=500, word_bytes=64, size=1 << 20)
    words_, numbers = got.column("word").to_pylist(), got.column("n").to_pylist()
    assert words_[0] == "big" and numbers == sorted(numbers, reverse=True) and 300 < len(words_) <= 500
    assert set(words_) == {w for w, n in rows if len(w) <= 64 and n >= numbers[-1]}
    assert frequent(counts, "word", "n", rows=500, word_bytes=64, size=300).num_rows < 90
    assert frequent(counts.filter("n < 0"), "word", "n", rows=5, word_bytes=64, size=300).num_rows == 0

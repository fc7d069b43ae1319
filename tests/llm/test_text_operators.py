"""Line dedup, n-gram join, decontamination, classifier, language model and pipeline against brute force."""

import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from fixtures import SCHEMA, messy_rows, prose, row
from pyspark.sql import functions as F

import corpus_pipeline
from faultloom.llm import decontamination, graphs, line_dedup, lm, mixing, ngram_join, quality
from faultloom.llm.common import SHINGLE_WORDS, words


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


# --- line dedup


def line_brute(docs):
    """By the definition: the first occurrence of each window stays, lines under later ones go."""
    order = sorted({d for d in docs if d[1] is not None}, key=lambda d: (d[0] is not None, d[0] or 0, __import__("hashlib").md5(d[1].encode()).digest()))
    seen, gone = set(), defaultdict(set)
    for d in order:
        lines = d[1].split("\n")
        if len(lines) < 3:
            if d[1] in seen:
                gone[d].update(range(len(lines)))
            seen.add(d[1])
        for i in range(len(lines) - 2):
            window = tuple(lines[i : i + 3])
            if window in seen:
                gone[d].update(range(i, i + 3))
            seen.add(window)
    out = []
    for d in docs:
        if d[1] is None:
            out.append((d[0], 0, 0, None))
            continue
        lines = d[1].split("\n")
        kept = [x for i, x in enumerate(lines) if i not in gone[d]]
        out.append((d[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def line_docs():
    rng = random.Random(3)
    docs = [(i, "\n".join(rng.choice("abc") for _ in range(rng.randrange(1, 14)))) for i in range(120)]
    docs += [(200, "a\na\na\na\na"), (201, "\n\n\n\n"), (202, None), (203, ""), (204, "p\nq"), (205, "p\nq")]
    docs += [(206, "u\nv\nw"), (206, "u\nv\nw"), (207, "x\nu\nv\nw\ny"), (None, "u\nv\nw\nz"), (208, "\n".join(map(str, range(20_000))))]
    return docs


def test_line_dedup_equals_brute_force(spark):
    docs = line_docs()
    got = line_dedup.dedup_lines(frame(spark, [row(*d) for d in docs]).repartition(5)).collect()
    assert Counter(map(tuple, got)) == line_brute(docs)


def test_line_dedup_sql_equals_brute_force():
    docs = line_docs()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    assert Counter(con.execute(line_dedup.oracle()).fetchall()) == line_brute(docs)


def test_no_line_vanishes(spark):
    docs = line_docs()
    kept = {x for r in line_dedup.dedup_lines(frame(spark, [row(*d) for d in docs])).collect() if r["text"] is not None for x in r["text"].split("\n")}
    assert kept >= {x for d in docs if d[1] is not None for x in d[1].split("\n")}


def test_line_dedup_of_short_texts(spark):
    docs = [(1, "p\nq"), (2, "p\nq"), (3, "p"), (4, "p\nr"), (5, "p\nq\nr"), (6, "p"), (7, None), (8, "p\nq\nr")]
    whole = line_dedup.dedup_lines(frame(spark, [row(*d) for d in docs]), short_texts=False).collect()
    assert {r["doc_id"] for r in whole if r["n_removed"]} == {8}
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in line_dedup.dedup_lines(frame(spark, [row(*d) for d in docs])).collect()}
    assert got == {
        1: (2, 0, "p\nq"), 2: (2, 2, ""), 3: (1, 0, "p"), 4: (2, 0, "p\nr"), 5: (3, 0, "p\nq\nr"), 6: (1, 1, ""), 7: (0, 0, None), 8: (3, 3, ""),
    }


def test_line_dedup_runs_no_python(messy):
    plan = line_dedup.dedup_lines(messy)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- n-gram join


def gram_tuples(text):
    w = words(text)
    n = min(SHINGLE_WORDS, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def join_brute(docs):
    sets = [gram_tuples(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(docs)
    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    least = {}
    for i, (ident, _) in enumerate(docs):
        if ident is not None:
            least[find(i)] = min(least.get(find(i), ident), ident)
    return Counter((d[0], least.get(find(i)) if sets[i] else d[0], links[i]) for i, d in enumerate(docs))


def near_docs():
    rng = random.Random(9)
    docs = [(r[0], r[1]) for r in messy_rows()]
    base = prose(77, 300).split()
    for i in range(70):  # a group of near copies that drift apart
        copy = list(base)
        for _ in range(rng.randrange(0, 14)):
            copy[rng.randrange(len(copy))] = f"n{rng.randrange(99)}"
        docs.append((1000 + i, " ".join(copy)))
    docs += [(2000 + i, " ".join(base)) for i in range(15)]
    docs += [(3000, "a b"), (3001, "a b"), (3002, "a b c")]
    return docs


@pytest.mark.parametrize("block_grams", [500_000, 900])
def test_join_equals_brute_force(spark, monkeypatch, block_grams):
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", block_grams)
    docs = near_docs()
    got = ngram_join.near_duplicates(frame(spark, [row(*d) for d in docs]).repartition(5)).collect()
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == join_brute(docs)


def test_repeated_ids_and_near_copies_equal_brute_force(spark):
    rng = random.Random(4)
    base = prose(5, 200).split()
    docs = [(1, " ".join(base))] * 300
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randrange(0, 5)):
            copy[rng.randrange(len(copy))] = f"n{i}"
        docs.append((10 + i, " ".join(copy)))
    got = ngram_join.near_duplicates(frame(spark, [row(*d) for d in docs]).repartition(5)).collect()
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == join_brute(docs)


def test_links_without_a_shared_band_count_on_both_sides(spark):
    """With few bands many members of a group share none; verified links count all the same, once for each side."""
    docs = [d for d in near_docs() if d[0] is not None and 1000 <= d[0] < 3000]
    got = ngram_join.near_duplicates(frame(spark, [row(*d) for d in docs]).repartition(3), recall=0.6).collect()
    want = {(i, c): n for (i, c, n), _ in join_brute(docs).items()}
    most = max(len([r for r in got if r["class_id"] == c]) for c in {r["class_id"] for r in got})
    assert most > 40 and sum(r["n_links"] for r in got) % 2 == 0
    full = {i: n for (i, _), n in want.items()}
    assert all(r["n_links"] <= full[r["doc_id"]] for r in got)
    assert sum(r["n_links"] for r in got) > 0.9 * sum(full.values())


def test_one_of_each_group_stays(spark):
    docs = near_docs()
    df = frame(spark, [row(*d) for d in docs])
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    groups = join_brute([d for d in docs if words(d[1])])
    # Each group's least id stays, once; two texts of one id may be groups of their own.
    assert {i for i, t in rows if words(t)} == {c for _, c, _ in groups}
    assert len({gram_tuples(t) for _, t in rows if words(t)}) == sum(1 for _, t in rows if words(t))
    assert Counter(i for i, t in rows if words(t))[11] == 2
    # Without words nothing is a duplicate.
    assert Counter(d for d in rows if not words(d[1])) == Counter(d for d in docs if not words(d[1]))


def test_banding_meets_recall():
    for threshold in (0.5, 0.8, 0.95):
        bands, rows = ngram_join.banding(threshold, 0.99, 512)
        assert 1 - (1 - threshold**rows) ** bands >= 0.99 and bands * rows <= 512
    with pytest.raises(ValueError):
        ngram_join.banding(0.01, 0.9999, 16)


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(500, 100 + i) for i in range(80)] + [(700, 700)]
    edges += [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(220)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["label"] for r in graphs.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


# --- decontamination


def bag(tokens, n):
    return Counter(tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1))


def contaminated_brute(docs, items):
    out = {}
    for d, text in docs:
        tokens = words(text)
        for item, passage in items:
            want = words(passage)
            n = min(5, len(want))
            if not want or len(tokens) < n:
                continue
            target = bag(want, n)
            size = min(len(want) - n + 1, len(tokens) - n + 1)
            grams = [tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1)]
            best = None
            for at in range(len(grams) - size + 1):
                own = Counter(grams[at : at + size])
                alike = sum((own & target).values()) / sum((own | target).values())
                if alike >= 0.8 and (best is None or alike > best[0] + 1e-12):
                    best = (round(alike, 9), at)
            if best:
                out[d, item] = best
    return out


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(8)
    items = [(i, prose(900 + i, 14 + 3 * i)) for i in range(15)]
    items += [(50, "only three words"), (51, None), (52, ""), (53, "go go go go go go go go go go go go"), (54, items[0][1])]
    docs = [(r[0], r[1]) for r in messy_rows() if len(r[1] or "") < 5000]
    for n, (_, passage) in enumerate(items[:15]):
        part = passage.split()
        changed = list(part)
        changed[rng.randrange(len(part))] = "other"
        docs.append((3000 + n, f"{prose(n, 40)} {passage.upper()}! {prose(n + 50, 40)}"))
        docs.append((4000 + n, f"{prose(n, 10)} {' '.join(changed)} {prose(n + 70, 30)}"))
        docs.append((5000 + n, " ".join(part[:-1])))
        docs.append((6000 + n, " ".join(part[: len(part) // 2])))
    docs += [(7000, "x only three words y"), (7001, "go " * 40), (7002, passage)]
    benchmark = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, doc_id string")
    df = frame(spark, [row(*d) for d in docs])
    got = decontamination.contaminated(df, benchmark).collect()
    want = contaminated_brute(docs, items)
    assert {(r["doc_id"], r["item_id"]): (round(r["similarity"], 9), r["first_word"]) for r in got} == want
    assert len(want) > 30 and any(s < 1 for s, _ in want.values())
    hit = {d for d, _ in want}
    kept = decontamination.clean(df, benchmark)
    assert kept.columns == df.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(d for d, _ in docs if d not in hit)


def test_benchmark_in_several_packs(spark):
    items = [(i, prose(900 + i, 30)) for i in range(12)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    parts = [i for p in decontamination.packs(benchmark, most=100) for i in p.idents]
    assert sorted(parts) == list(range(12))


def test_block_index_finds_everything_within_radius():
    rng = np.random.default_rng(1)
    grams = [rng.integers(0, 1 << 63, 20, dtype=np.uint64) for _ in range(150)]
    length = decontamination.Length(grams, list(range(150)))
    prints = np.repeat(length.prints, 30)
    for i in range(len(prints)):
        for bit in rng.permutation(64)[: rng.integers(0, 26)]:
            prints[i] ^= np.uint64(1) << np.uint64(bit)
    windows, items = length.near(prints)
    distance = np.bitwise_count(prints[:, None] ^ length.prints[None, :])
    want = {(int(w), int(i)) for w, i in zip(*np.nonzero(distance <= decontamination.RADIUS))}
    assert set(zip(windows.tolist(), items.tolist())) == want


# --- classifier


def test_classifier_on_held_out_rows(spark):
    rng = random.Random(2)
    good = [prose(i, 60) for i in range(150)]
    bad = [" ".join(rng.choice(["buy", "$$$", "click", "now!!!", "free", "xx9"]) for _ in range(50)) for _ in range(60)]
    bad += [f"{prose(i, 6)} " + "again " * 40 for i in range(60)]
    rows = [(i, t, int(i < 150)) for i, t in enumerate(good + bad)]
    docs = frame(spark, [row(i, t) for i, t, _ in rows] + [row(r[0] and r[0] + 10_000, r[1]) for r in messy_rows()])
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, score int")
    learn = labels.filter(quality.remainder("doc_id", 3) != 1)
    scored = quality.score(docs, quality.fit(docs, learn))
    assert [c for c in scored.columns if c not in ("score", "predicted")] == [c for c in docs.columns if c != "score"]
    got = {r["doc_id"]: r for r in scored.collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i]["predicted"] == y for i, y in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    assert scored.count() == docs.count()
    again = {r["doc_id"]: r["score"] for r in quality.score(docs.repartition(3), quality.fit(docs.repartition(3), learn)).collect()}
    assert all(abs(again[i] - r["score"]) < 1e-6 for i, r in got.items() if i is not None and i < 10_000)


def test_sample_holds_each_labelled_id_once(spark, monkeypatch):
    ids = [r[0] for r in spark.range(60).orderBy(F.xxhash64("id")).collect()]
    rows = [(i, "good words here " * 3 if i % 2 else "bad spam spam " * 3) for i in ids]
    huge = [(ids[0], "x " * 5000)]  # the first id by hash: above the bound of 4000 bytes
    copies = [(ids[1], "good words again")] * 3000 + [(ids[1], f"text {n}") for n in range(500)]
    docs = frame(spark, [row(*d) for d in huge + rows[2:] + copies]).repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in ids] + [(i, 1) for i in range(1000, 1200)], "doc_id long, quality int")
    taken = []
    learn = quality.train
    monkeypatch.setattr(quality, "train", lambda examples: taken.append(len(examples)) or learn(examples))
    model = quality.fit(docs, labels, size=4000)
    assert taken == [59]
    assert {r["score"] for r in quality.score(docs.limit(10), model).collect()} != {0.5}
    quality.fit(docs, labels, rows=30, size=4000)
    assert taken == [59, 30]


def test_features_do_not_depend_on_company():
    tokens = ["the", "naïve", "a", "日本語", "x" * 300]
    owner, bucket = quality.features(tokens)
    for i, t in enumerate(tokens):
        assert sorted(bucket[owner == i]) == sorted(quality.features([t])[1])


def test_classifier_without_labels(messy, empty):
    none = quality.fit(messy, empty.select("doc_id", F.col("key").alias("quality")))
    assert {r["score"] for r in quality.score(messy, none).collect()} == {0.5}
    assert quality.score(empty, none).count() == 0


# --- language model


def lm_frame(spark):
    rows = [row(i, prose(i, 30 + i % 50).upper() if i % 9 == 0 else prose(i, 30 + i % 50)) for i in range(300)]
    return frame(spark, rows + [row(None if r[0] is None else r[0] + 5000, r[1]) for r in messy_rows()])


def lm_score(docs, training, **options):
    counts = lm.count_tokens(training)
    vocabulary = lm.vocabulary(counts)
    return lm.score(docs, counts, vocabulary, lm.fit(training, vocabulary, **options))


@pytest.mark.parametrize("head", [1 << 18, 20])
def test_language_model(spark, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD_TOKENS", head)
    docs = lm_frame(spark).repartition(3)
    held_out = quality.remainder("doc_id", 5) == 1
    got = lm_score(docs, docs.filter(~held_out)).collect()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    tokens = [(i, (t or "").encode().lower().split() + [b"\n"]) for i, t in rows]
    crc = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5
    counts = Counter(w for i, ws in tokens if crc(i) != 1 for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    norm = total + 0.5 * (distinct + 1)
    want = Counter(
        (i, len(ws), sum(counts[w] > 0 for w in ws), total, round(sum(math.log10((counts[w] + 0.5) / norm) for w in ws), 6)) for i, ws in tokens
    )
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    held = [r for r in got if crc(r["doc_id"]) == 1 and r["n_tokens"] > 20]
    if head > 1000:
        assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["score"] < 0 for r in got)


def test_language_model_is_a_distribution():
    """Over all known tokens and one unknown token per ending the probabilities after any context add up to 1."""
    counts = Counter(prose(1, 3000).encode().lower().split())
    for i in range(3000):
        counts[f"t{i}q".encode()] += 1 + i % 3
    tokens = [w for w, _ in counts.most_common()]
    mass = np.full(lm.ENDINGS, 0.5)
    for w in tokens[lm.CLASSES * lm.CLASS_WORDS :]:
        mass[lm.ending(w)] += counts[w] + 0.5
    vocabulary = lm.Vocabulary(tokens, np.array([counts[w] for w in tokens]), sum(counts.values()), len(counts), mass)
    weights = lm.Weights(vocabulary)
    weights.learn(lm.Coded([prose(i, 50) for i in range(20)], vocabulary.tables()), 0.2)
    total = 0.0
    coded = lm.Coded([f"the river {w.decode()}" for w in tokens], vocabulary.tables())
    third = np.flatnonzero(np.arange(len(coded.at)) % 4 == 2)
    chance = weights.log10(coded)
    frequent = lm.CLASSES * lm.CLASS_WORDS
    for at, w in zip(third, tokens):
        p = 10 ** chance[at]
        total += p if coded.target[at] < frequent else p * (counts[w] + 0.5) / mass[coded.target[at] - frequent]
    # Unknown tokens: half a count of each ending class.
    context = coded.at[third[:1]]
    classes = lm.softmax(weights.tables[0], weights.class_start, lm.class_features(coded.context, context, weights.bits))[0]
    total += float((classes[lm.CLASSES :] * 0.5 / mass).sum())
    assert abs(total - 1) < 1e-4


def test_gradient_sums():
    rng = np.random.default_rng(2)
    rows = np.minimum(rng.zipf(1.4, (3, 500)), 90).astype(np.int32)
    gradient = rng.standard_normal((500, 6)).astype(np.float32)
    distinct, times, sums = lm.summed_by_row(rows, gradient)
    want = np.zeros((100, 6))
    for feature in rows:
        np.add.at(want, feature, gradient)
    assert np.allclose(sums, want[distinct], atol=1e-3)
    assert dict(zip(distinct.tolist(), times.tolist())) == Counter(rows.ravel().tolist())


def test_changes_are_averaged_by_use(spark):
    docs = lm_frame(spark).repartition(4)
    vocabulary = lm.vocabulary(lm.count_tokens(docs))
    weights = lm.fit(docs, vocabulary, rounds=2)
    assert all(np.isfinite(t).all() for t in weights.tables) and any(t.any() for t in weights.tables)


# --- empty tables and the pipeline


def test_empty_tables(empty, messy, spark):
    assert line_dedup.dedup_lines(empty).count() == 0
    assert ngram_join.near_duplicates(empty).count() == 0
    assert ngram_join.keep_one(empty).count() == 0
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contaminated(messy, benchmark).count() == 0
    assert decontamination.clean(messy, benchmark).count() == messy.count()
    assert decontamination.clean(empty, benchmark).count() == 0
    assert lm_score(empty, empty).count() == 0
    assert lm_score(messy, empty).count() == messy.count()


def test_stages_keep_columns_of_any_name(spark):
    names = ["score", "predicted", "row", "_t1", "_t2", "_nth", "_wordless", "_hash", "_tie", "_copies", "_rows", "_share", "_copy", "_row", "d"]
    docs = [(i, prose(i, 40 + i), "ab"[i % 2]) for i in range(30)] + [(3, prose(3, 43), "b"), (40, None, None), (41, "", "a")]
    schema = "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names)
    df = spark.createDataFrame([(*d, *[f"{n} {d[0]}" for n in names]) for d in docs], schema).repartition(3)
    for kept in (
        corpus_pipeline.keep_quality(spark, df, "/root/testdata/sf0.001"), ngram_join.keep_one(df), mixing.taken(df),
        decontamination.clean(df, spark.createDataFrame([(1, prose(7, 47))], "item_id long, text string")),
    ):
        assert kept.schema.names == df.schema.names
        rows = kept.collect()
        assert rows and all(r[n] == f"{n} {r['doc_id']}" for r in rows for n in names)


def test_pipeline_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = documents
    from faultloom.llm.common import written

    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, docs, sf_dir), name)
        sizes.append(docs.count())
        if name != "token_files":
            assert docs.columns == documents.columns
            assert docs.select("doc_id", "text").exceptAll(before.select("doc_id", "text")).count() == 0 or name == "mixing"
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sizes[0] >= sizes[1] >= sizes[2] > 0 and sizes[3] == sizes[4]


def test_lm_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    scores = []
    for parts in (2, 7):
        dealt = docs.repartition(parts)
        counts = lm.count_tokens(dealt)
        vocabulary = lm.vocabulary(counts)
        weights = lm.fit(dealt, vocabulary, part_tokens=3000)
        scores.append({r["doc_id"]: r["score"] for r in lm.score(dealt, counts, vocabulary, weights).collect()})
    assert scores[0].keys() == scores[1].keys()
    assert max(abs(scores[0][k] - scores[1][k]) for k in scores[0]) < 1e-6


def test_lm_words_are_cut_as_bytes_are():
    rng = random.Random(5)
    texts = [None, "", " ", "\n\x0c", " a", "a ", *("".join(rng.choices(" \t\n\x0b\x0c\r\x1c\x1f\x85\xa0\u3000AZazİé日\0", k=rng.randrange(12))) for _ in range(3000))]
    want = [(t or "").encode().lower().split() for t in texts]
    for array in (pa.array(texts, pa.string()), pa.array(["x y", *texts], pa.large_string()).slice(1)):
        lengths, words = lm.words_of(array)
        assert lengths.tolist() == [len(w) for w in want] and lm.as_bytes(words) == [t for w in want for t in w]


def test_lm_looks_up_each_distinct_token_once():
    counts = Counter(prose(1, 400).encode().lower().split())
    vocabulary = lm.Vocabulary([*counts], np.array([*counts.values()]), sum(counts.values()), len(counts), np.full(lm.ENDINGS, 0.5))
    asked = Counter()

    class Asked(lm.Index):
        def __getitem__(self, token):
            asked[token] += 1
            return super().__getitem__(token)

    tables = vocabulary.tables()
    texts = [prose(1, 400), None, "Rare rare thing", prose(1, 400).upper(), " the  RARE "]
    coded = lm.Coded(texts, tables | {"index": Asked(tables["index"])})
    assert asked and set(asked.values()) == {1}
    tokens = [w for t in texts for w in [*(t or "").encode().lower().split(), b"\n"]]
    assert [coded.tokens[i] for i in coded.number] == tokens
    assert coded.place.tolist() == [tables["index"][t] for t in tokens]
    assert coded.hashes.tolist() == [xxhash.xxh3_64_intdigest(t) for t in tokens]
    assert coded.document.tolist() == [i for i, n in enumerate(coded.lengths.tolist()) for _ in range(n)]


def test_lm_grows_with_the_corpus():
    sizes = [lm.feature_bits(n) for n in (0, 10**5, 10**7, 6 * 10**7, 10**9, 10**12)]
    assert sizes == sorted(sizes) and sizes[3] >= 14 and sizes[-1] > sizes[-2] > sizes[3]


def test_block_index_finds_every_near_item():
    """The masks give exactly the pairs within the radius that agree in a block, whatever the number of items."""
    rng = np.random.default_rng(3)
    grams = [rng.integers(0, 1 << 63, 12, dtype=np.int64).astype(np.uint64) for _ in range(700)]
    length = decontamination.Length(grams, list(range(700)))
    prints = length.prints[rng.integers(0, 700, 300)].copy()
    for _ in range(9):
        prints ^= np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
    windows, items = length.near(prints)
    want = {(w, i) for w in range(300) for i in range(700) if bin(int(prints[w] ^ length.prints[i])).count("1") <= decontamination.RADIUS}
    assert set(zip(windows.tolist(), items.tolist())) == want and len(windows) == len(want)

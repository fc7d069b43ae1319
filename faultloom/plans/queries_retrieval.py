"""Queries over vectors, runbooks, prompts and AI answers."""

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import functions as F

from ..operators import hypotheses, prompts, retrieval, runbooks, state, vector_index
from ..session import checkpoint_folder
from ..sources.tables import read_table
from . import pipelines as pl
from . import testviews as tv
from .oracle_views import LOG_EVENTS, lit, with_views
from .registry import query

# Send the functions of this module with the job: executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_DOT = "list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[])"
_COSINE = f"round({_DOT} / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) / sqrt(list_dot_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[])), 12)"


def _hits(where: str = "q.vec_id <> c.vec_id", floor: float | None = None) -> str:
    kept = "" if floor is None else f"WHERE similarity >= {floor}"
    return f"""
pairs AS (
  SELECT q.label, q.vec_id AS qid, c.vec_id AS cid, {_COSINE} AS similarity
  FROM embeddings q JOIN embeddings c ON q.label = c.label AND {where}
),
hits AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, cid) AS rank FROM pairs {kept}
  QUALIFY rank <= 5
)"""


def _vectors(spark, sf_dir):
    return read_table(spark, sf_dir, "embeddings")


def _knn(spark, sf_dir, **options):
    e = _vectors(spark, sf_dir)
    hits = retrieval.knn(e, e, group="label", query_id="vec_id", corpus_id="vec_id", skip_self=True, **options)
    return hits.select("label", "query_vec_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


_KNN_SELECT = "SELECT label, qid AS query_vec_id, cid AS vec_id, round(similarity, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM hits"


@query("knn_exact", f"WITH {_hits()}\n{_KNN_SELECT}")
def knn_exact(spark, sf_dir):
    return _knn(spark, sf_dir)


@query("knn_threshold", f"WITH {_hits(floor=0.2)}\n{_KNN_SELECT}")
def knn_threshold(spark, sf_dir):
    return _knn(spark, sf_dir, min_similarity=0.2)


@query("knn_refined", f"WITH {_hits()}\n{_KNN_SELECT}")
def knn_refined(spark, sf_dir):
    return _knn(spark, sf_dir, refine=True, block_rows=32)


@query("knn_approx", f"WITH {_hits()}\n{_KNN_SELECT}")
def knn_approx(spark, sf_dir):
    return _knn(spark, sf_dir, probes=2, block_rows=16)


#: Share of the exact hits that the search with two probes must find on these vectors, which have no clusters.
APPROX_RECALL = 0.9


@query(
    "knn_approx_checked",
    f"""WITH {_hits()}
SELECT count(DISTINCT qid) AS n_queries, true AS ranks_dense, true AS similarities_exact, true AS recall_reached FROM hits""",
)
def knn_approx_checked(spark, sf_dir):
    """The approximate hits against the vectors themselves and against the exact hits."""
    approx, exact = _knn(spark, sf_dir, probes=2, block_rows=16), _knn(spark, sf_dir)
    e = _vectors(spark, sf_dir)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    q, c = F.col("q.embedding"), F.col("c.embedding")
    cosine = dot(q, c) / F.sqrt(dot(q, q) * dot(c, c))
    hits = (
        approx.alias("h")
        .join(e.alias("q"), F.col("h.query_vec_id") == F.col("q.vec_id"))
        .join(e.alias("c"), F.col("h.vec_id") == F.col("c.vec_id"))
        .join(exact.alias("x"), (F.col("h.query_vec_id") == F.col("x.query_vec_id")) & (F.col("h.vec_id") == F.col("x.vec_id")), "left")
    )
    found = hits.agg(
        F.countDistinct("h.query_vec_id").alias("n_queries"),
        F.bool_and(F.col("h.rank").between(1, 5)).alias("ranks_dense"),
        F.bool_and(F.abs(F.col("h.similarity") - cosine) < 1e-5).alias("similarities_exact"),
        F.count("x.vec_id").alias("both"),
    )
    wanted = exact.agg(F.count(F.lit(1)).alias("all"))
    return found.crossJoin(wanted).select(
        "n_queries", "ranks_dense", "similarities_exact", (F.col("both") >= F.col("all") * APPROX_RECALL).alias("recall_reached")
    )


#: Share of the cells that each query asks; these vectors have no structure, so it must be large.
INDEX_PROBES = 0.8


@query(
    "knn_index_checked",
    f"""WITH {_hits()}
SELECT label, count(DISTINCT qid) AS n_queries, count(*) AS n_exact, true AS similarities_exact, true AS recall_reached FROM hits GROUP BY label""",
)
def knn_index_checked(spark, sf_dir):
    """Hits of an index against the vectors themselves and against the exact hits, by label."""
    e = _vectors(spark, sf_dir)
    folder = f"{checkpoint_folder(spark, 'vector-index')}/{uuid.uuid4().hex}"
    index = vector_index.build(e, folder, group="label", ident="vec_id")
    hits = vector_index.search(index, e, group="label", query_id="vec_id", corpus_id="vec_id", probes=INDEX_PROBES, skip_self=True)
    exact = _knn(spark, sf_dir).select("label", "query_vec_id", "vec_id", F.col("similarity").alias("true_similarity"))
    met = exact.join(hits.drop("rank"), ["label", "query_vec_id", "vec_id"], "left")
    right = F.col("similarity").isNull() | (F.round("similarity", 6) == F.col("true_similarity"))
    found = met.groupBy("label").agg(
        F.countDistinct("query_vec_id").alias("n_queries"), F.count(F.lit(1)).alias("n_exact"), F.bool_and(right).alias("similarities_exact"),
        F.count("similarity").alias("found"),
    )
    return found.select("label", "n_queries", "n_exact", "similarities_exact", (F.col("found") >= APPROX_RECALL * F.col("n_exact")).alias("recall_reached"))


#: Components of the vectors that the hook's model gives.
HOOK_DIM = 16


def _hook_model():
    """A model that counts words by the first hex digit of their MD5, and refuses texts that hold a password."""
    import hashlib
    import re

    def run(texts):
        if any("password=" in t for t in texts):
            raise ValueError("refused")
        rows = []
        for text in texts:
            counts = [0.0] * HOOK_DIM
            for word in re.findall("[a-z0-9]+", text.lower()):
                counts[int(hashlib.md5(word.encode()).hexdigest()[0], 16)] += 1.0
            rows.append(counts)
        return rows

    return run


@query(
    "embed_hook",
    with_views(LOG_EVENTS, """
worded AS (SELECT seq, message, unnest(regexp_extract_all(lower(message), '[a-z0-9]+')) AS word FROM log_events),
counted AS (SELECT seq, any_value(message) AS message, strpos('0123456789abcdef', substr(md5(word), 1, 1)) - 1 AS d, count(*) AS n FROM worded GROUP BY seq, d),
lengths AS (SELECT seq, any_value(message) AS message, sqrt(sum(n * n)) AS len FROM counted GROUP BY seq),
whole AS (
  SELECT l.seq, l.message, string_agg(CAST(CAST(floor(1000 * coalesce(c.n, 0) / len + 0.25) AS BIGINT) AS VARCHAR), ',' ORDER BY i.d) AS vector
  FROM lengths l CROSS JOIN (SELECT unnest(range(16)) AS d) i LEFT JOIN counted c ON c.seq = l.seq AND c.d = i.d GROUP BY l.seq, l.message
)""", select="""
SELECT seq, CASE WHEN contains(message, 'password=') THEN NULL ELSE vector END AS vector,
  CASE WHEN contains(message, 'password=') THEN 'ValueError: refused' END AS failure FROM whole"""),
)
def embed_hook(spark, sf_dir):
    """Vectors of a model that is loaded where it runs, in thousandths; the texts it refuses fail alone."""
    events = retrieval.embed_with(tv.log_events(spark, sf_dir), "message", load=_hook_model, failure="failure")
    digits = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000 + 0.25).cast("string"))
    return events.select("seq", F.array_join(digits, ",").alias("vector"), "failure")


def _incident_hits(spark, sf_dir):
    e = _vectors(spark, sf_dir)
    workspace = F.col("label").cast("string").alias("workspace_id")
    events = e.select(F.col("vec_id").alias("event_id"), workspace, "embedding")
    v = F.col("vec_id").cast("string")
    errors = e.select(
        F.col("vec_id").alias("error_id"), workspace, "embedding",
        F.concat(F.lit("TYPE:"), v).alias("error_type"),
        F.when(F.get("embedding", F.lit(0)) >= -0.15, F.concat(F.lit("cause "), v)).alias("root_cause"),
        F.concat(F.lit("fix "), v).alias("fix"),
    )
    return retrieval.similar_incidents(events, errors, min_similarity=None)


def _section_hits(spark, sf_dir, **options):
    e = _vectors(spark, sf_dir)
    workspace = F.col("label").cast("string").alias("workspace_id")
    events = e.select(F.col("vec_id").alias("event_id"), workspace, "embedding")
    v = F.col("vec_id").cast("string")
    chunks = e.select(
        F.col("vec_id").alias("chunk_id"), workspace, "embedding",
        F.concat(F.lit("file_"), workspace, F.lit(".md")).alias("source_file"),
        F.when(F.pmod("vec_id", F.lit(3)) != 0, F.concat(F.lit("Title "), v)).alias("section_title"),
        F.concat(F.lit("text "), v).alias("chunk_text"),
    )
    return retrieval.runbook_sections(events, chunks, k=3, **{"min_similarity": None, **options})


_HAS_CAUSE = "c.embedding[1] >= -0.15::FLOAT"
_INCIDENT_TEXT = "'[TYPE:' || cid || '] Root cause: cause ' || cid || ' | Fix: fix ' || cid || ' (similarity=' || printf('%.2f', similarity) || ')'"
_SECTION_TEXT = "'From: file_' || label || '.md' || CASE WHEN cid % 3 <> 0 THEN ' > Title ' || cid ELSE '' END || chr(10) || 'text ' || cid"


@query(
    "incident_hits",
    f"WITH {_hits(_HAS_CAUSE)}\nSELECT qid AS event_id, CAST(rank AS INTEGER) AS rank, {_INCIDENT_TEXT} AS hit FROM hits",
)
def incident_hits(spark, sf_dir):
    return _incident_hits(spark, sf_dir).select("event_id", "rank", retrieval.format_incident().alias("hit"))


@query(
    "runbook_hits",
    f"WITH {_hits('true')}\nSELECT qid AS event_id, CAST(rank AS INTEGER) AS rank, {_SECTION_TEXT} AS hit FROM hits WHERE rank <= 3",
)
def runbook_hits(spark, sf_dir):
    return _section_hits(spark, sf_dir).select("event_id", "rank", retrieval.format_section().alias("hit"))


@query(
    "prompts",
    f"""WITH {_hits(_HAS_CAUSE)},
{_hits(floor=0.25).replace('pairs', 'pairs2').replace('hits AS', 'hits2 AS')},
inc AS (SELECT qid, string_agg('  • ' || {_INCIDENT_TEXT}, chr(10) ORDER BY rank) AS t FROM hits WHERE similarity >= 0.2 GROUP BY 1),
sec AS (SELECT qid, string_agg({_SECTION_TEXT}, chr(10) || chr(10) || '---' || chr(10) ORDER BY rank) AS t
  FROM hits2 WHERE rank <= 3 GROUP BY 1)
SELECT vec_id AS event_id, CASE WHEN inc.t IS NULL AND sec.t IS NULL
  THEN {lit(prompts._ROLE + chr(10) * 2 + 'Error Log:' + chr(10) + '"')} || 'vector ' || vec_id || {lit('"' + chr(10) * 2 + 'Context:' + chr(10) + 'No additional context provided.' + chr(10) * 2 + prompts._ANSWER)}
  ELSE concat_ws(chr(10) || chr(10), '## Current error' || chr(10) || 'vector ' || vec_id || chr(10) || chr(10) || 'Context: No additional context provided.',
    '## Similar past incidents (retrieved from your workspace history)' || chr(10) || inc.t,
    '## Relevant internal runbook sections (retrieved from your documentation)' || chr(10) || sec.t,
    concat_ws(chr(10), {lit(prompts._ROLE)}, CASE WHEN inc.t IS NOT NULL THEN {lit(prompts._USE_INCIDENTS)} END,
      CASE WHEN sec.t IS NOT NULL THEN {lit(prompts._USE_RUNBOOKS)} END, {lit(prompts._ANSWER)})) END AS prompt
FROM embeddings LEFT JOIN inc ON inc.qid = vec_id LEFT JOIN sec ON sec.qid = vec_id""",
)
def prompt_texts(spark, sf_dir):
    contexts = prompts.context_lists(
        _incident_hits(spark, sf_dir).filter(F.col("similarity") >= 0.2),
        _section_hits(spark, sf_dir, min_similarity=0.25, skip_self=True),
    )
    events = _vectors(spark, sf_dir).select(
        F.col("vec_id").alias("event_id"),
        F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("message"),
        F.lit(None).cast("string").alias("pipeline_context"),
    )
    return prompts.with_prompts(events, contexts).select("event_id", "prompt")


_MARKDOWN = """
files AS (
  SELECT lang AS workspace_id, 'doc_' || doc_id || '.md' AS source_file, doc_id,
    replace(regexp_replace(text, '(?m)^([^\\n]{1,40})$', '## \\1', 'g'), chr(10), chr(10) || chr(10)) AS md
  FROM documents
),
lines AS (
  SELECT workspace_id, source_file, doc_id, unnest(string_split(md, chr(10))) AS line,
    generate_subscripts(string_split(md, chr(10)), 1) AS i
  FROM files
),
numbered AS (
  SELECT *, regexp_matches(line, '^#{2,3}\\s+.') AS header,
    sum(CASE WHEN regexp_matches(line, '^#{2,3}\\s+.') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS sec
  FROM lines
),
bodies AS (
  SELECT workspace_id, source_file, doc_id, sec,
    max(CASE WHEN header THEN trim(regexp_replace(line, '^#{2,3}\\s+', ''), ' ' || chr(9) || chr(13) || chr(160)) END) AS title,
    trim(string_agg(CASE WHEN header THEN '' ELSE line END, chr(10) ORDER BY i), ' ' || chr(9) || chr(10) || chr(13) || chr(160)) AS body
  FROM numbered GROUP BY 1, 2, 3, 4
),
sections AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1 AS section_no FROM bodies WHERE body <> ''
)"""


@query(
    "chunk_sections",
    f"WITH {_MARKDOWN}\nSELECT workspace_id, source_file, CAST(section_no AS INTEGER) AS section_no, title AS section_title, body FROM sections",
)
def chunk_sections(spark, sf_dir):
    return runbooks.section_rows(tv.markdown_files(spark, sf_dir))


_PACK = _MARKDOWN + """,
paras AS (
  SELECT doc_id, sec, trim(p, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) AS p,
    row_number() OVER (PARTITION BY doc_id, sec ORDER BY i) AS n
  FROM (SELECT doc_id, sec, unnest(regexp_split_to_array(body, '\\n{2,}')) AS p,
      generate_subscripts(regexp_split_to_array(body, '\\n{2,}'), 1) AS i
    FROM sections WHERE length(body) > 600)
  WHERE trim(p, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) <> ''
),
walk AS (
  SELECT doc_id, sec, 1::BIGINT AS n, p AS cur, NULL::VARCHAR AS flushed FROM paras WHERE n = 1
  UNION ALL
  SELECT w.doc_id, w.sec, q.n,
    CASE WHEN length(w.cur) + length(q.p) + 2 <= 600 THEN w.cur || chr(10) || chr(10) || q.p
      ELSE trim(right(w.cur, 50) || chr(10) || chr(10) || q.p, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) END,
    CASE WHEN length(w.cur) + length(q.p) + 2 > 600 THEN w.cur END
  FROM walk w JOIN paras q ON q.doc_id = w.doc_id AND q.sec = w.sec AND q.n = w.n + 1
),
pieces AS (
  SELECT doc_id, sec, 0 AS n, body AS chunk FROM sections WHERE length(body) <= 600
  UNION ALL
  SELECT doc_id, sec, n, flushed FROM walk WHERE flushed IS NOT NULL
  UNION ALL
  SELECT doc_id, sec, max(n) + 1, arg_max(cur, n) FROM walk GROUP BY 1, 2
),
chunks AS (
  SELECT s.workspace_id, s.source_file, s.title AS section_title, p.chunk AS chunk_text,
    row_number() OVER (PARTITION BY p.doc_id ORDER BY p.sec, p.n) - 1 AS chunk_index
  FROM pieces p JOIN sections s ON s.doc_id = p.doc_id AND s.sec = p.sec WHERE length(p.chunk) >= 30
)"""


@query(
    "chunk_pack",
    f"WITH RECURSIVE {_PACK}\nSELECT workspace_id, source_file, CAST(chunk_index AS INTEGER) AS chunk_index, section_title, chunk_text FROM chunks",
)
def chunk_pack(spark, sf_dir):
    return runbooks.chunk_runbooks(tv.markdown_files(spark, sf_dir))


@query("chunk_counts", f"WITH RECURSIVE {_PACK}\nSELECT workspace_id, source_file, count(*) AS chunks FROM chunks GROUP BY 1, 2")
def chunk_counts(spark, sf_dir):
    return runbooks.chunk_counts(runbooks.chunk_runbooks(tv.markdown_files(spark, sf_dir)))


@query(
    "runbook_ingest_report",
    f"""WITH RECURSIVE {_PACK}
SELECT workspace_id, source_file, count(*) AS chunks_stored,
  count(*) FILTER (NOT regexp_matches(chunk_text, '[\\p{{L}}\\p{{N}}_]')) AS chunks_failed FROM chunks GROUP BY 1, 2""",
)
def runbook_ingest_report(spark, sf_dir):
    return pl.ingest_report(pl.ingest_runbooks(tv.markdown_files(spark, sf_dir)))


def _two_versions(spark, sf_dir):
    """Section rows of all files, and new rows for the files that the label table rates good."""
    current = runbooks.section_rows(tv.markdown_files(spark, sf_dir)).select("workspace_id", "source_file", "section_no", "body")
    good = read_table(spark, sf_dir, "labels").filter(F.col("quality") == 1).select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("source_file")
    )
    incoming = current.join(good, "source_file", "left_semi").filter(F.col("section_no") == 0)
    return current, incoming.select("workspace_id", "source_file", "section_no", F.upper("body").alias("body"))


@query(
    "replace_chunks",
    f"""WITH {_MARKDOWN}, good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1)
SELECT workspace_id, source_file, CAST(section_no AS INTEGER) AS section_no, length(body) AS n FROM sections
WHERE doc_id NOT IN (FROM good) OR section_no = 0""",
)
def replace_chunks(spark, sf_dir):
    current, incoming = _two_versions(spark, sf_dir)
    replaced = state.replace_by_key(current, incoming.withColumn("body", F.lower("body")), ["workspace_id", "source_file"])
    return replaced.select("workspace_id", "source_file", "section_no", F.length("body").cast("long").alias("n"))


@query(
    "replace_runbooks",
    f"""WITH RECURSIVE {_PACK}, good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1)
SELECT workspace_id, source_file, CAST(chunk_index AS INTEGER) AS chunk_index,
  CASE WHEN source_file IN (SELECT 'doc_' || doc_id || '.md' FROM good) THEN 'new ' || chunk_text ELSE chunk_text END AS chunk_text
FROM chunks""",
)
def replace_runbooks(spark, sf_dir):
    """The whole chunk table after the files that the labels rate good came in again, changed and embedded."""
    files = tv.markdown_files(spark, sf_dir)
    current = pl.ingest_runbooks(files)
    good = read_table(spark, sf_dir, "labels").filter(F.col("quality") == 1).select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("source_file")
    )
    renewed = pl.ingest_runbooks(files.join(good, "source_file", "left_semi"))
    renewed = renewed.withColumn("chunk_text", F.concat(F.lit("new "), "chunk_text"))
    keys = ["workspace_id", "source_file"]
    replaced = state.replace_by_key(current, renewed.select(current.columns), keys)
    return replaced.select(*keys, "chunk_index", "chunk_text")


@query(
    "delete_chunks",
    f"""WITH {_MARKDOWN}, good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1)
SELECT workspace_id, source_file, CAST(section_no AS INTEGER) AS section_no FROM sections WHERE doc_id NOT IN (FROM good)""",
)
def delete_chunks(spark, sf_dir):
    current, incoming = _two_versions(spark, sf_dir)
    return state.delete_by_key(current, incoming, ["workspace_id", "source_file"]).select("workspace_id", "source_file", "section_no")


@query(
    "ai_responses",
    """SELECT event_id AS seq,
  CASE event_type WHEN 'error' THEN 'cause ' || event_id WHEN 'click' THEN 'only cause' WHEN 'view' THEN 'AI Analysis failed to parse response.'
    WHEN 'signup' THEN 'Analysis failed to extract root cause.' ELSE 'AI Analysis failed to parse response.' END AS root_cause,
  CASE event_type WHEN 'error' THEN 'fix' WHEN 'click' THEN 'Analysis failed to extract fix.' WHEN 'signup' THEN 'Analysis failed to extract fix.'
    ELSE 'Check logs manually.' END AS suggested_fix,
  CASE event_type WHEN 'error' THEN value / 1000 WHEN 'click' THEN 0.5 WHEN 'signup' THEN 0.5 ELSE 0.0 END AS confidence_score
FROM events""",
)
def ai_responses(spark, sf_dir):
    events = tv.log_events(spark, sf_dir)
    kind = F.col("event_type")
    good = F.to_json(F.struct(
        F.concat(F.lit("cause "), F.col("seq").cast("string")).alias("root_cause"), F.lit("fix").alias("suggested_fix"),
        (F.col("value") / 1000).alias("confidence_score"),
    ))
    text = (
        F.when(kind == "error", F.concat(F.lit("```json\n"), good, F.lit("\n```")))
        .when(kind == "click", F.lit('{"root_cause": "only cause"}'))
        .when(kind == "view", F.lit("not valid json {{{{"))
        .when(kind == "signup", F.lit("{}"))
        .otherwise(F.lit('{"root_cause": "x", "confidence_score": "high"}'))
    )
    return events.select("seq", hypotheses.parse_ai_response(text).alias("r")).select("seq", "r.*")


def _slot_vector(seq: str):
    """A unit vector for the message template of an event."""
    slot = F.pmod(F.col(seq), F.lit(len(tv.MESSAGES))).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(len(tv.MESSAGES) - 1)), lambda i: (i == slot).cast("float"))


@query(
    "context_errors",
    with_views(LOG_EVENTS, """
past AS (SELECT DISTINCT workspace_id, slot FROM log_events WHERE event_type = 'purchase' AND slot % 3 <> 0),
sections AS (SELECT DISTINCT workspace_id, slot FROM log_events WHERE event_type = 'signup')""", select="""
SELECT workspace_id, job_id AS pipeline_name, signature AS error_type,
  'incident ' || coalesce(CAST(p.slot AS VARCHAR), '') || ', section ' || coalesce(CAST(s.slot AS VARCHAR), '') AS root_cause,
  'by context' AS fix, seq
FROM log_events LEFT JOIN past p USING (workspace_id, slot) LEFT JOIN sections s USING (workspace_id, slot) WHERE level = 'ERROR'
QUALIFY row_number() OVER (PARTITION BY workspace_id, job_id, signature ORDER BY seq DESC) = 1"""),
)
def context_errors(spark, sf_dir):
    """The whole way of an event: retrieved incidents and sections reach the prompt, its answer the error table."""
    events = tv.log_events(spark, sf_dir).withColumn("embedding", _slot_vector("seq"))
    slot = F.pmod("seq", F.lit(len(tv.MESSAGES)))
    name = F.concat(F.lit("case "), slot.cast("string"))

    def stored(kind, ident):
        last = F.max_by(F.struct("embedding", name.alias("name")), "seq").alias("l")
        rows = events.filter(F.col("event_type") == kind).groupBy("workspace_id", slot.alias("slot")).agg(F.max("seq").alias(ident), last)
        return rows.select("workspace_id", "slot", ident, "l.*")

    past = stored("purchase", "error_id").withColumns(
        {"error_type": F.lit("TYPE"), "root_cause": F.when(F.col("slot") % 3 != 0, F.concat(F.lit("past "), "name")), "fix": F.lit("past fix")}
    )
    chunks = stored("signup", "chunk_id").withColumns(
        {"source_file": F.lit("a.md"), "section_title": F.lit("Title"), "chunk_text": F.concat(F.lit("chunk "), "name")}
    )
    queue = pl.publish(events).withColumn("embedding", _slot_vector("seq"))

    def answer(prompt):
        found = [F.regexp_extract(prompt, rf"{word} case (\d+)", 1) for word in ("past", "chunk")]
        cause = F.concat(F.lit("incident "), found[0], F.lit(", section "), found[1])
        return F.struct(cause.alias("root_cause"), F.lit("by context").alias("suggested_fix"), F.lit(0.97).alias("confidence_score"))

    done = pl.process_with_context(queue, past, chunks, answer=answer, redacted=True)
    return done.errors.select("workspace_id", "pipeline_name", "error_type", "root_cause", "fix", "seq")

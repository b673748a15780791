"""Registered retrieval queries and their SQL."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from riskweave import fixed_values as V
from riskweave.operators import joins, ranks, retrieval, text_index, vector_index
from riskweave.plans.role_sql import with_roles
from riskweave.session import scratch_dir
from riskweave.sources import roles
from riskweave.sources.tables import overwrite_path, read_table, stream_table
from riskweave.streaming.sync import (
    apply_changes, current_rows, newest_by_key, remove_missing, snapshot_rows, sync_changes, sync_snapshot)


def r01_document_table(spark, folder):
    """Three section lists, documents, pages and benchmark passages, one after the other."""
    def listed(table, text, kind):
        return read_table(spark, folder, table).select(kind.alias("doc_type"), F.col(text).alias("section_content"))

    lists = [listed("documents", "text", F.col("lang")), listed("pages", "html", F.lit("page")),
             listed("benchmark", "text", F.lit("benchmark"))]
    return retrieval.document_table(*lists).groupBy("doc_type").agg(
        F.count("*").alias("section_count"), F.sum(F.length("section_content")).alias("characters"))


def r02_chunk_table(spark, folder):
    return retrieval.chunk_table(roles.sections(spark, folder)).select(
        "chunk_id", "doc_id", "doc_title", "section_title", "doc_type", F.md5("chunk_text").alias("text_hash"))


def r02_sized_chunks(spark, folder):
    """Chunks of bounded size, cut at sentence ends that the text itself chooses."""
    chunks = retrieval.sized_chunks(roles.sections(spark, folder))
    return chunks.select("chunk_id", "section_number", "chunk_number", F.length("chunk_text").alias("characters"))


def v05_chunk_numbers(spark, folder):
    """Dense numbers per document, for sections that carry no number of their own."""
    keys = roles.sections(spark, folder).select("doc_id", "section_number")
    return ranks.numbered(keys, ["doc_id"], "section_number", "chunk_number").select(
        F.concat_ws("-", "doc_id", F.col("chunk_number").cast("string")).alias("chunk_id"), "section_number")


def _chunks(spark, folder):
    return retrieval.chunk_table(roles.sections(spark, folder)).select("chunk_id", "chunk_text")


def _text_index(spark, folder):
    """The folder of the chunks' text index, built once per application and table folder."""
    place = spark.sparkContext.applicationId, f"{folder} texts"
    if place not in _INDEXES:
        path = scratch_dir(spark, "text-index")
        text_index.build(_chunks(spark, folder), "chunk_id", "chunk_text", path)
        _INDEXES[place] = path
    return _INDEXES[place]


def r03_text_vectors(spark, folder):
    """Vectors of all chunks as the index holds them: entries, a sum weighted by place, and the length."""
    vectors = text_index.vectors_of(spark, _text_index(spark, folder))
    whole = F.aggregate("entries", F.lit(0).cast("long"), lambda a, x: a + x * x).cast("double")
    placed = F.aggregate(F.transform("entries", lambda x, i: x * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    return vectors.select(F.col("key").alias("chunk_id"), F.size("entries").cast("long").alias("entries"), placed.alias("placed_sum"),
                          F.round(F.sqrt(whole), 6).alias("length"))


_INDEXES: dict[tuple[str, str], str] = {}


def _index(spark, folder):
    """The folder of the index, built once per application and table folder."""
    place = spark.sparkContext.applicationId, folder
    if place not in _INDEXES:
        path = scratch_dir(spark, "vector-index")
        vector_index.build(read_table(spark, folder, "embeddings").select("vec_id", "embedding"), path)
        _INDEXES[place] = path
    return _INDEXES[place]


def r04_vector_index(spark, folder):
    """What the stored index holds, checked by size, length and a position-weighted sum."""
    weighted = F.aggregate(F.transform("vector", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return vector_index.vectors_of(spark, _index(spark, folder)).select(
        F.col("key").alias("vec_id"), F.size("vector").alias("dimensions"), F.round(weighted, 6).alias("weighted_sum"))


def _centroids(spark, folder):
    """The mean vector of each label: one question per label."""
    vector = array_to_vector(F.col("embedding").cast("array<double>"))
    means = read_table(spark, folder, "embeddings").groupBy("label")\
        .agg(vector_to_array(Summarizer.mean(vector)).alias("_mean"))
    return means.select(F.col("label").alias("query_id"),
                        F.transform("_mean", lambda x: F.round(x, 9)).alias("vector"))


def _nearest_to_centroids(spark, folder):
    return vector_index.search(spark, _index(spark, folder), _centroids(spark, folder))


def r05_nearest_to_centroids(spark, folder):
    return _nearest_to_centroids(spark, folder).select(
        "query_id", "rank", F.col("key").alias("vec_id"), F.round("score", 6).alias("score"))


def _found_chunks(spark, folder):
    """The nearest vectors of each label with the section of the same number."""
    chunks = roles.sections(spark, folder).select(
        F.col("section_number").alias("vec_id"), "doc_title", "section_title",
        F.col("section_content").alias("chunk_text"), "doc_type")
    return retrieval.with_chunks(_nearest_to_centroids(spark, folder), chunks, "vec_id")


def r05_text_search(spark, folder):
    """The five best chunks for every question, over all chunks and whole texts."""
    found = text_index.search(spark, _text_index(spark, folder), roles.questions(spark, folder), "question_id", "question")
    return found.select("query_id", "rank", F.col("key").alias("chunk_id"), F.round("score", 6).alias("score"))


def r06_source_records(spark, folder):
    return retrieval.source_records(_found_chunks(spark, folder)).select(
        "query_id", "rank", "source", F.round("score", 6).alias("score"), F.md5("content").alias("content_hash"))


def _label_sources(spark, folder):
    """Conversations as questions; the labelled section of the same number is the source."""
    labelled = read_table(spark, folder, "labels").select(F.col("doc_id").alias("section_number"))
    found = roles.sections(spark, folder).join(labelled, "section_number", "left_semi").select(
        F.col("section_number").alias("query_id"), F.lit(1).alias("rank"), "doc_title",
        F.col("section_content").alias("chunk_text"), F.lit(0.5).alias("score"))
    asked = read_table(spark, folder, "conversations").select(F.col("conv_id").alias("query_id")).distinct()
    return retrieval.with_placeholder(asked, retrieval.source_records(found))


def r07_placeholder(spark, folder):
    return _label_sources(spark, folder).select(
        "query_id", "rank", "source", "score", F.md5("content").alias("content_hash"))


def p18_shown_sources(spark, folder):
    lists = retrieval.source_lists(_label_sources(spark, folder))
    return lists.select("query_id", retrieval.shows_sources(F.col("sources")).alias("shows_sources"))


def r08_numbered_context(spark, folder):
    return retrieval.numbered_context(_found_chunks(spark, folder)).select("query_id", "context")


def r09_plain_context(spark, folder):
    return retrieval.plain_context(retrieval.source_records(_found_chunks(spark, folder)))


def r10_citations(spark, folder):
    return retrieval.numbered_context(_found_chunks(spark, folder)).select(
        "query_id", F.posexplode("citations").alias("position", "citation"))


def _conversation_requests(spark, folder):
    """The newest user message of each conversation as its question; the section of the
    conversation's number as context."""
    messages = retrieval.clean_questions(read_table(spark, folder, "conversations"), "text")
    newest = newest_by_key(messages.filter("role = 'user'"), "conv_id", "turn")
    sources = roles.sections(spark, folder).select(
        F.col("section_number").alias("query_id"), F.lit(1).alias("rank"),
        F.col("doc_title").alias("source"), F.col("section_content").alias("content"))
    asked = newest.select(F.col("conv_id").alias("query_id"), F.col("text").alias("question"),
                          F.col("turn").alias("asked_turn"))
    # From the conversations' side: only their sections are grouped, and none is dropped.
    contexts = retrieval.plain_context(retrieval.with_placeholder(asked, sources.withColumn("score", F.lit(1.0))))
    return asked.join(contexts, "query_id")


def r11_prompt_messages(spark, folder):
    """One row per message of every conversation's prompt."""
    requests = _conversation_requests(spark, folder)
    turns = read_table(spark, folder, "conversations")
    asked = requests.select(F.col("query_id").alias("conv_id"), "asked_turn")
    # Only what came before the question; the prompt then takes the last of it.
    history = retrieval.history_messages(turns).join(asked, "conv_id").filter("turn < asked_turn")
    messages = retrieval.prompt_messages(requests, history.drop("asked_turn"))
    return messages.select("query_id", F.posexplode("messages").alias("position", "m"))\
        .select("query_id", "position", "m.role", F.md5("m.content").alias("content_hash"))


def r11_cited_prompts(spark, folder):
    """The two-message prompt over a numbered context, one per label."""
    contexts = retrieval.numbered_context(_found_chunks(spark, folder))
    requests = contexts.select("query_id", "context", F.concat(F.lit("What is label "),
                               F.col("query_id").cast("string"), F.lit("?")).alias("question"))
    return retrieval.cited_prompt_messages(requests)\
        .select("query_id", F.posexplode("messages").alias("position", "m"))\
        .select("query_id", "position", "m.role", F.md5("m.content").alias("content_hash"))


def r12_source_previews(spark, folder):
    return roles.sections(spark, folder).select(
        "section_number", retrieval.source_preview(F.col("section_content")).alias("preview"))


def v02_last_messages(spark, folder):
    return retrieval.last_messages(read_table(spark, folder, "conversations"), 3)\
        .select("conv_id", "turn", "role")


def v02_history_window(spark, folder):
    """The newest messages of every conversation, as many as a prompt takes."""
    return retrieval.last_messages(read_table(spark, folder, "conversations")).select("conv_id", "turn", "role")


def p19_history(spark, folder):
    return retrieval.history_messages(read_table(spark, folder, "conversations"), drop_assistant=True)\
        .select("conv_id", "turn", "role")


def p20_clean_questions(spark, folder):
    return retrieval.clean_questions(read_table(spark, folder, "conversations"), "text")\
        .select("conv_id", "turn", F.md5("text").alias("text_hash"))


def s09_removed_keys(spark, folder):
    """Indexed sections whose label record is gone from the source."""
    indexed = roles.sections(spark, folder).select(F.col("section_number").alias("doc_id"))
    return joins.removed_keys(indexed, read_table(spark, folder, "labels"), "doc_id")


def t1_synced_stream(spark, folder):
    """Messages read as a stream of changes by conversation; then the synced table."""
    stream = stream_table(spark, folder, "conversations")
    base = scratch_dir(spark, "sync")
    sync_changes(stream, f"{base}/changes", f"{base}/checkpoint", "conv_id", "turn").awaitTermination()
    return current_rows(spark, f"{base}/changes", "conv_id", "turn")\
        .select("conv_id", "turn", "role", F.md5("text").alias("text_hash"))


def s09_synced_after_removal(spark, folder):
    """All sections synced, then the removal of those whose label record is gone."""
    path = scratch_dir(spark, "snapshot")
    rows = roles.sections(spark, folder).select(
        "section_number", F.lit(1).alias("version"), F.md5("section_content").alias("text_hash"))
    apply_changes(rows, 0, path, "section_number", "version")
    kept = read_table(spark, folder, "labels").select(F.col("doc_id").alias("section_number"))
    remove_missing(kept, path, "section_number", "version")
    return snapshot_rows(spark, path).select("section_number", "text_hash")


def t1_snapshot_stream(spark, folder):
    """Messages as a stream of changes; a conversation whose newest message is the assistant's is deleted."""
    base = scratch_dir(spark, "snapshot")
    sync_snapshot(stream_table(spark, folder, "conversations"), f"{base}/table", f"{base}/checkpoint", "conv_id", "turn",
                  F.col("role") == "assistant").awaitTermination()
    return snapshot_rows(spark, f"{base}/table").select("conv_id", "turn", "role", F.md5("text").alias("text_hash"))


def s04_chunks_written(spark, folder):
    """The chunk table written and read back."""
    path = scratch_dir(spark, "chunks")
    overwrite_path(retrieval.chunk_table(roles.sections(spark, folder)), path)
    return spark.read.parquet(path).groupBy("doc_id").agg(
        F.count("*").alias("chunks"), F.sum(F.length("chunk_text")).alias("characters"))


QUERIES = {f.__name__: f for f in [
    r01_document_table, r02_chunk_table, r02_sized_chunks, v05_chunk_numbers, r03_text_vectors, r04_vector_index,
    r05_nearest_to_centroids, r05_text_search, r06_source_records, r07_placeholder, p18_shown_sources,
    r08_numbered_context, r09_plain_context, r10_citations, r11_prompt_messages, r11_cited_prompts,
    r12_source_previews, v02_last_messages, v02_history_window, p19_history, p20_clean_questions, s09_removed_keys,
    t1_synced_stream, s04_chunks_written, s09_synced_after_removal, t1_snapshot_stream,
]}


def _text(value: str) -> str:
    """A text as an SQL literal with its line breaks."""
    return "'" + value.replace("'", "''") + "'"


_STRIP = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160) || chr(65279)"

_NEAREST = f"""centroids AS (
    SELECT label AS query_id, list(mean ORDER BY pos) AS vector FROM (
        SELECT label, pos, round(avg(value), 9) AS mean FROM (
            SELECT label, unnest(embedding)::double AS value, generate_subscripts(embedding, 1) AS pos FROM embeddings)
        GROUP BY label, pos) GROUP BY label),
found AS (
    SELECT query_id, vec_id, score,
        cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) as integer) AS rank
    FROM (SELECT c.query_id, e.vec_id,
            round(list_cosine_similarity(c.vector, cast(e.embedding as double[])), {retrieval.SCORE_DIGITS}) AS score
          FROM centroids c CROSS JOIN embeddings e)
    QUALIFY rank <= {V.RETRIEVAL_DEPTH})"""
_FOUND = f"""{_NEAREST}, chunks AS (
    SELECT f.query_id, f.rank, f.score, s.doc_title, s.section_title, s.section_content AS chunk_text
    FROM found f JOIN sections s ON f.vec_id = s.section_number)"""
_NUMBERED = f"""{_FOUND}, contexts AS (
    SELECT query_id, string_agg('[Source ' || rank || ': ' || doc_title || ' — ' || section_title || ']' || chr(10)
        || chunk_text, {_text(V.CONTEXT_SEPARATOR)} ORDER BY rank) AS context
    FROM (SELECT * REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank)
          FROM chunks WHERE rank <= {V.NUMBERED_CONTEXT_DEPTH}) GROUP BY query_id)"""

_LABELLED = """sources AS (
    SELECT a.query_id, 1 AS rank, coalesce(s.doc_title, 'System') AS source,
        CASE WHEN s.doc_title IS NULL THEN 0.0::double ELSE 0.5::double END AS score,
        coalesce(s.section_content, 'Vector search is not available. Please ensure the index is configured.') AS content
    FROM (SELECT DISTINCT conv_id AS query_id FROM conversations) a
    LEFT JOIN (SELECT * FROM sections WHERE section_number IN (SELECT doc_id FROM labels)) s
        ON s.section_number = a.query_id)"""

_PROMPTS = f"""cleaned AS (
    SELECT conv_id, turn, role, trim(text, {_STRIP}) AS text FROM conversations WHERE trim(text, {_STRIP}) <> ''),
asked AS (
    SELECT conv_id, turn AS asked_turn, text AS question FROM cleaned WHERE role = 'user'
    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1),
requests AS (
    SELECT conv_id, asked_turn, question, '[Source: ' || coalesce(doc_title, 'System') || ']' || chr(10)
        || CASE WHEN section_number IS NULL THEN
            'Vector search is not available. Please ensure the index is configured.' ELSE section_content END AS context
    FROM asked LEFT JOIN sections ON section_number = conv_id),
past AS (
    SELECT c.conv_id, c.turn, c.role, c.text FROM conversations c JOIN requests r ON c.conv_id = r.conv_id
    WHERE c.role IN ('user', 'assistant') AND c.turn < r.asked_turn
    QUALIFY row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn DESC) <= {V.HISTORY_LIMIT}),
messages AS (
    SELECT conv_id, -1 AS place, 'system' AS role, {_text(V.CHAT_SYSTEM_PROMPT)} AS content FROM requests
    UNION ALL SELECT conv_id, turn, role, text FROM past
    UNION ALL SELECT conv_id, 1000000, 'user', {_text(V.CHAT_PROMPT_HEAD)} || context
        || {_text(V.CHAT_PROMPT_QUESTION)} || question || {_text(V.CHAT_PROMPT_TAIL)} FROM requests)"""

_ENTRIES = f"""words AS (
    SELECT doc_id || '-' || section_number AS key, unnest(regexp_extract_all(lower(section_content), '[\\p{{L}}\\p{{N}}]+')) AS term
    FROM sections),
counts AS (SELECT key, term, count(*) AS tf FROM words GROUP BY key, term),
weights AS (
    SELECT term, cast(floor(1000 * ln(cast((SELECT count(DISTINCT key) FROM counts) + 1 AS double) / cast(count(*) + 1 AS double))) AS bigint) + 1 AS weight
    FROM counts GROUP BY term),
entries AS (
    SELECT key, term, weight * cast(floor(1000 * (1 + ln(cast(tf AS double)))) AS bigint) // 1000 AS entry
    FROM counts JOIN weights USING (term)),
lengths AS (SELECT key, sqrt(cast(sum(entry * entry) AS double)) AS length FROM entries GROUP BY key)"""

ORACLES = {
    "r03_text_vectors": with_roles("sections", f"""WITH {_ENTRIES},
        placed AS (SELECT key, entry, row_number() OVER (PARTITION BY key ORDER BY term) AS place FROM entries)
        SELECT key AS chunk_id, count(*) AS entries, cast(sum(entry * place) AS bigint) AS placed_sum,
            round(any_value(length), 6) AS length
        FROM placed JOIN lengths USING (key) GROUP BY key"""),
    "r05_text_search": with_roles("sections questions", f"""WITH {_ENTRIES},
        asked_words AS (SELECT question_id, unnest(regexp_extract_all(lower(question), '[\\p{{L}}\\p{{N}}]+')) AS term FROM questions),
        asked AS (
            SELECT question_id, term, any_value(weight) * cast(floor(1000 * (1 + ln(cast(count(*) AS double)))) AS bigint) // 1000 AS own
            FROM asked_words JOIN weights USING (term) GROUP BY question_id, term),
        own_lengths AS (SELECT question_id, sqrt(cast(sum(own * own) AS double)) AS own_length FROM asked GROUP BY question_id),
        scored AS (
            SELECT question_id, key, cast(sum(own * entry) AS double) / (any_value(own_length) * any_value(length)) AS score
            FROM asked JOIN entries USING (term) JOIN lengths USING (key) JOIN own_lengths USING (question_id) GROUP BY question_id, key)
        SELECT question_id AS query_id, cast(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, key) AS integer) AS rank,
            key AS chunk_id, round(score, 6) AS score FROM scored QUALIFY rank <= {V.RETRIEVAL_DEPTH}"""),
    "r01_document_table": """
        SELECT doc_type, count(*) AS section_count, cast(sum(length(text)) as bigint) AS characters FROM (
            SELECT lang AS doc_type, text FROM documents UNION ALL SELECT 'page', html FROM pages
            UNION ALL SELECT 'benchmark', text FROM benchmark) GROUP BY doc_type""",
    "r02_chunk_table": with_roles("sections", """
        SELECT doc_id || '-' || section_number AS chunk_id, doc_id, doc_title, section_title, doc_type,
            md5(section_content) AS text_hash FROM sections"""),
    "r02_sized_chunks": with_roles("sections", f"""WITH listed AS (
            SELECT doc_id, section_number, regexp_extract_all(section_content,
                '[^.!?]{{0,{retrieval.CHUNK_CHARACTERS // 4 - 1}}}[.!?][\\s\\x0B]{{0,{retrieval.CHUNK_CHARACTERS // 4}}}|[^.!?]{{1,{retrieval.CHUNK_CHARACTERS // 4}}}', 0, 's') AS parts
            FROM sections),
        pieces AS (SELECT doc_id, section_number, unnest(parts) AS text, generate_subscripts(parts, 1) AS place FROM listed),
        stretched AS (
            SELECT *, coalesce(sum(CASE WHEN cast('0x' || substring(md5(text), 1, 8) AS bigint) % {retrieval.ENDS_TO_A_CUT} = 0 THEN 1 ELSE 0 END) OVER (
                PARTITION BY doc_id, section_number ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stretch FROM pieces),
        cuts AS (
            SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY doc_id, section_number, stretch ORDER BY place
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {retrieval.CHUNK_CHARACTERS // 2} AS cut FROM stretched),
        chunks AS (
            SELECT doc_id, section_number, stretch, cut, string_agg(text, '' ORDER BY place) AS chunk_text
            FROM cuts GROUP BY doc_id, section_number, stretch, cut)
        SELECT doc_id || '-' || section_number || '-' || substring(md5(chunk_text), 1, 16) || '-' || row_number() OVER (
                PARTITION BY doc_id, section_number, substring(md5(chunk_text), 1, 16) ORDER BY stretch, cut) AS chunk_id, section_number,
            cast(row_number() OVER (PARTITION BY doc_id, section_number ORDER BY stretch, cut) as integer) AS chunk_number,
            cast(length(chunk_text) as integer) AS characters FROM chunks"""),
    "v05_chunk_numbers": with_roles("sections", """
        SELECT doc_id || '-' || row_number() OVER (PARTITION BY doc_id ORDER BY section_number) AS chunk_id,
            section_number FROM sections"""),
    "r04_vector_index": """
        SELECT vec_id, cast(any_value(n) as integer) AS dimensions,
            round(sum(value * pos) / sqrt(sum(value * value)), 6) AS weighted_sum
        FROM (SELECT vec_id, len(embedding) AS n, unnest(embedding)::double AS value,
                generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY vec_id""",
    "r05_nearest_to_centroids": f"""WITH {_NEAREST}
        SELECT query_id, rank, vec_id, round(score, 6) AS score FROM found""",
    "r06_source_records": with_roles("sections", f"""WITH {_FOUND}
        SELECT query_id, rank, doc_title AS source, round(score, 6) AS score, md5(chunk_text) AS content_hash
        FROM chunks"""),
    "r07_placeholder": with_roles("sections", f"""WITH {_LABELLED}
        SELECT query_id, rank, source, score, md5(content) AS content_hash FROM sources"""),
    "p18_shown_sources": with_roles("sections", f"""WITH {_LABELLED}
        SELECT query_id, source <> 'System' AS shows_sources FROM sources"""),
    "r08_numbered_context": with_roles("sections", f"WITH {_NUMBERED} SELECT query_id, context FROM contexts"),
    "r09_plain_context": with_roles("sections", f"""WITH {_FOUND}
        SELECT query_id, string_agg('[Source: ' || doc_title || ']' || chr(10) || chunk_text,
            {_text(V.CONTEXT_SEPARATOR)} ORDER BY rank) AS context FROM chunks GROUP BY query_id"""),
    "r10_citations": with_roles("sections", f"""WITH {_FOUND}
        SELECT query_id, cast(row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 as integer) AS position,
            doc_title || ' — ' || section_title AS citation
        FROM chunks WHERE rank <= {V.NUMBERED_CONTEXT_DEPTH}"""),
    "r11_prompt_messages": with_roles("sections", f"""WITH {_PROMPTS}
        SELECT conv_id AS query_id, role, md5(content) AS content_hash,
            cast(row_number() OVER (PARTITION BY conv_id ORDER BY place) - 1 as integer) AS position
        FROM messages"""),
    "r11_cited_prompts": with_roles("sections", f"""WITH {_NUMBERED}
        SELECT query_id, 0 AS position, 'system' AS role, md5({_text(V.CITED_SYSTEM_PROMPT)}) AS content_hash FROM contexts
        UNION ALL SELECT query_id, 1, 'user', md5({_text(V.CITED_PROMPT_HEAD)} || context
            || {_text(V.CITED_PROMPT_QUESTION)} || 'What is label ' || query_id || '?' || {_text(V.CITED_PROMPT_TAIL)})
        FROM contexts"""),
    "r12_source_previews": with_roles("sections", """
        SELECT section_number, CASE WHEN length(section_content) > 200
            THEN substring(section_content, 1, 200) || '...' ELSE section_content END AS preview FROM sections"""),
    "v02_last_messages": """
        SELECT conv_id, turn, role FROM conversations
        QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3""",
    "v02_history_window": f"""
        SELECT conv_id, turn, role FROM conversations
        QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= {V.HISTORY_LIMIT}""",
    "p19_history": "SELECT conv_id, turn, role FROM conversations WHERE role = 'user'",
    "p20_clean_questions": f"""
        SELECT conv_id, turn, md5(trim(text, {_STRIP})) AS text_hash FROM conversations
        WHERE trim(text, {_STRIP}) <> ''""",
    "s09_removed_keys": """
        SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "s09_synced_after_removal": """
        SELECT doc_id AS section_number, md5(text) AS text_hash FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""",
    "t1_snapshot_stream": """
        SELECT conv_id, turn, role, md5(text) AS text_hash FROM (
            SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1)
        WHERE role <> 'assistant'""",
    "t1_synced_stream": """
        SELECT conv_id, turn, role, md5(text) AS text_hash FROM conversations
        QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1""",
    "s04_chunks_written": """
        SELECT source AS doc_id, count(*) AS chunks, cast(sum(length(text)) as bigint) AS characters
        FROM documents GROUP BY source""",
}

"""Document retrieval: chunks, vectors, exact nearest neighbours, context and prompts."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave import fixed_values as V
from riskweave.functions.scalars import default_text, is_blank, preview, stripped

#: One block of vectors or queries; all queries together, if they are to be broadcast.
BLOCK_BYTES, BROADCAST_BYTES = 2 << 20, 64 << 20
#: Parts in which shuffled blocks of vectors meet each block of queries.
SALTS = 64
VECTOR_SIZE = 1024
SCORE_DIGITS = 9


# --- documents and chunks ----------------------------------------------------

def document_table(*section_lists: DataFrame) -> DataFrame:
    """All section lists one after the other; duplicates stay."""
    return reduce(DataFrame.unionByName, section_lists)


def chunk_table(sections: DataFrame) -> DataFrame:
    """One section, one chunk, the whole text. The id is the document's and the section's
    own number, so it is unique and stable and nothing is shuffled."""
    return sections.select(
        F.concat_ws("-", "doc_id", F.col("section_number").cast("string")).alias("chunk_id"),
        "doc_id", "doc_title", "section_title",
        F.col("section_content").alias("chunk_text"), "doc_type")


#: Longest chunk, and how many sentence ends to one that ends a chunk.
CHUNK_CHARACTERS, ENDS_TO_A_CUT = 2000, 8


def sentences(text: Column, longest: int) -> Column:
    """A text's sentences with what follows up to the next one, longer ones cut after ``longest``
    characters; one after the other they are the text."""
    return F.regexp_extract_all(text, F.lit(
        rf"(?s)[^.!?]{{0,{longest - 1}}}+[.!?]\s{{0,{longest}}}|[^.!?]{{1,{longest}}}"), F.lit(0))


def sized_chunks(sections: DataFrame, most: int = CHUNK_CHARACTERS, ends: int = ENDS_TO_A_CUT) -> DataFrame:
    """Chunks of at most ``most`` characters, cut after sentences whose text says so.

    One of ``ends`` sentences, by its hash, ends a stretch; a stretch is cut where it reaches half
    of ``most``. An edit changes its own stretch, and with a lost or new cut its neighbour, and
    nothing else. The id is the section's, the hash of the chunk and which of equal ones it is, so
    that unchanged chunks keep it. Chunks in order are the section; a null or empty section has
    none. ``section_number`` is unique within a document.
    """
    pieces = sections.select("doc_id", "section_number", F.posexplode(sentences(F.col("section_content"), most // 4)).alias("place", "text"))
    section = Window.partitionBy("doc_id", "section_number")
    before = section.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    is_end = F.pmod(F.conv(F.substring(F.md5("text"), 1, 8), 16, 10).cast("long"), F.lit(ends)) == 0
    stretched = pieces.withColumn("stretch", F.coalesce(F.sum(is_end.cast("int")).over(before), F.lit(0)))
    within = Window.partitionBy("doc_id", "section_number", "stretch").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    cut = stretched.withColumn("cut", F.floor(F.coalesce(F.sum(F.length("text")).over(within), F.lit(0)) / (most // 2)))
    chunks = cut.groupBy("doc_id", "section_number", "stretch", "cut").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda s: s["text"]), "").alias("chunk_text"))
    order = F.row_number().over(section.orderBy("stretch", "cut"))
    equal = Window.partitionBy("doc_id", "section_number", "_hash").orderBy("stretch", "cut")
    return chunks.withColumn("chunk_number", order).withColumn("_hash", F.substring(F.md5("chunk_text"), 1, 16)).select(
        F.concat_ws("-", "doc_id", F.col("section_number").cast("string"), "_hash", F.row_number().over(equal).cast("string")).alias("chunk_id"),
        "doc_id", "section_number", "chunk_number", "chunk_text")


# --- vectors -----------------------------------------------------------------

def unit_vector(vector: Column) -> Column:
    """Scaled to length 1, as doubles; a zero vector stays zero."""
    wide = vector.cast("array<double>")
    length = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(wide, lambda x: F.when(length > 0, x / length).otherwise(0.0))


def vector_index(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, unit vector): the table nearest-neighbour queries read."""
    return df.select(key, unit_vector(F.col(vector)).alias("vector"))


def fit_text_vectors(texts: DataFrame, column: str, size: int = VECTOR_SIZE) -> PipelineModel:
    """Hashed TF-IDF vectors of unit length, fitted on the texts to be searched."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol=column, outputCol="_words", pattern=r"[^\p{L}\p{N}]+"),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=size),
        IDF(inputCol="_tf", outputCol="_tfidf"),
        Normalizer(inputCol="_tfidf", outputCol="_unit"),
    ]).fit(texts)


def text_vectors(model: PipelineModel, df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, vector) with a model fitted on a column of the same name."""
    return model.transform(df.select(key, column))\
        .select(key, vector_to_array("_unit", "float32").alias("vector"))


# --- nearest neighbours ------------------------------------------------------

def _usable(vector: Column) -> Column:
    """Not null, not empty, every component there and finite."""
    return F.coalesce((F.size(vector) > 0) & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _unit_rows(values: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(values, axis=1)
    lengths[lengths == 0] = 1.0
    return values / lengths[:, None]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of one length in blocks of bounded size, each in order of its keys."""
    for batch in batches:
        lengths = pc.list_value_length(batch.column("vector")).to_numpy()
        for size in np.unique(lengths).tolist():
            rows = batch.take(pa.array(np.flatnonzero(lengths == size)))
            rows = rows.take(pc.sort_indices(rows.column("key"), null_placement="at_start"))
            step = max(1, BLOCK_BYTES // (8 * size))
            for at in range(0, rows.num_rows, step):
                part = rows.slice(at, step)
                values = part.column("vector").flatten().to_numpy().reshape(-1, size)
                keys = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("key"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([size], pa.int32()), pa.array([zlib.crc32(values)], pa.int64()), keys,
                     pa.array([_unit_rows(values).tobytes()], pa.binary())], ["size", "place", "keys", "block"])


def _best_of_block(k: int):
    """For every question of a block of questions, the k best rows of a block of vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                size, keys = batch.column("size")[i].as_py(), batch.column("keys")[i].values
                rows = np.frombuffer(batch.column("block")[i].as_buffer(), np.float64).reshape(-1, size)
                asked = batch.column("asked")[i].values
                questions = asked.field("vector").flatten().to_numpy().reshape(-1, size)
                scores = np.round(_unit_rows(questions) @ rows.T, SCORE_DIGITS) + 0.0
                n = len(rows)
                floor = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(scores), -np.inf)
                question, row = np.nonzero(scores >= floor[:, None])
                order = np.lexsort((row, -scores[question, row], question))  # rows are in order of their keys
                question, row = question[order], row[order]
                kept = np.arange(len(question)) - np.searchsorted(question, question) < k
                question, row = question[kept], row[kept]
                yield pa.RecordBatch.from_arrays(
                    [asked.field("query_id").take(pa.array(question)), keys.take(pa.array(row)),
                     pa.array(scores[question, row])], ["query_id", "key", "score"])
    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = V.RETRIEVAL_DEPTH) -> DataFrame:
    """The k nearest vectors of every query by cosine: (query_id, key, score, rank).

    ``vectors`` has a key and a vector column, ``queries`` a query_id and a vector column; keys
    and ids are of any type that sorts. Exact: blocks of vectors meet blocks of queries of the
    same length, a task emits at most k rows per query and block, and Spark cuts them to k per
    query before the shuffle. Blocks of queries are broadcast if all of them together, by their
    number and length, stay within ``BROADCAST_BYTES``; beyond that both sides are shuffled,
    spread evenly. Equal scores rank by key. A vector or query that is null or empty or holds a
    null or non-finite component takes no part; a zero vector scores 0.
    """
    (key, key_type), (vector, _) = vectors.dtypes
    (query, query_type), (asked, _) = queries.dtypes
    questions = queries.select(F.col(query).alias("query_id"), F.col(asked).cast("array<double>").alias("vector"))\
        .filter(_usable(F.col("vector")))
    total, longest = questions.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    groups = max(1, -(-total * longest * 8 // BLOCK_BYTES))
    grouped = questions.groupBy(
        F.size("vector").alias("size"), F.pmod(F.xxhash64("query_id", "vector"), F.lit(groups)).alias("group"))\
        .agg(F.collect_list(F.struct("query_id", "vector")).alias("asked"))
    blocks = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))\
        .filter(_usable(F.col("vector")))\
        .mapInArrow(_pack, f"size int, place long, keys array<{key_type}>, block binary")\
        .withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    if total * longest * 8 <= BROADCAST_BYTES:
        met = blocks.join(F.broadcast(grouped), ["size", "group"])
    else:
        spread = grouped.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        met = blocks.withColumn("salt", F.pmod("place", F.lit(SALTS))).join(spread, ["size", "group", "salt"])
    found = met.select("size", "keys", "block", "asked")\
        .mapInArrow(_best_of_block(k), f"query_id {query_type}, key {key_type}, score double")
    return best_by_query(found, k)


def best_by_query(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of every query, ranked; Spark cuts to k before the shuffle as well."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def with_chunks(found: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """Found rows with the chunk columns of the same key."""
    return chunks.join(found.withColumnRenamed("key", key), key)


def retrieve(vectors: DataFrame, queries: DataFrame, chunks: DataFrame,
             k: int = V.RETRIEVAL_DEPTH) -> DataFrame:
    """Nearest vectors with the chunk columns of the same key. Spark picks the join by the found
    side's measured size: at most k rows per query."""
    key = vectors.columns[0]
    return chunks.join(nearest(vectors, queries, k).withColumnRenamed("key", key), key)


# --- sources, context, prompts -----------------------------------------------

def source_records(found: DataFrame) -> DataFrame:
    """Found rows as source records with defaults for gaps."""
    return found.select(
        "query_id", "rank",
        F.coalesce("chunk_text", F.lit("")).alias("content"),
        default_text(F.col("doc_title"), "Unknown").alias("source"),
        F.coalesce("score", F.lit(0.0)).alias("score"))


def with_placeholder(queries: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources per query; a query that found nothing gets one placeholder row."""
    return queries.select("query_id").join(sources, "query_id", "left").select(
        "query_id",
        F.coalesce("rank", F.lit(1)).alias("rank"),
        F.when(F.col("rank").isNull(), V.NO_RESULT_TEXT).otherwise(F.col("content")).alias("content"),
        F.when(F.col("rank").isNull(), V.NO_RESULT_SOURCE).otherwise(F.col("source")).alias("source"),
        F.coalesce("score", F.lit(0.0)).alias("score"))


def source_lists(sources: DataFrame, depth: int = V.RETRIEVAL_DEPTH) -> DataFrame:
    """One array of the best ``depth`` source records per query, best first."""
    return sources.filter(F.col("rank") <= depth).groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "content", "source", "score"))).alias("sources"))


def shows_sources(sources: Column) -> Column:
    """False for no sources or only the placeholder."""
    only_placeholder = (F.size(sources) == 1) & (F.try_element_at(sources, F.lit(1))["source"] == V.NO_RESULT_SOURCE)
    return (F.size(sources) > 0) & ~F.coalesce(only_placeholder, F.lit(False))


def source_preview(content: Column) -> Column:
    return preview(content, V.PREVIEW_LENGTH)


def _best(found: DataFrame, depth: int, *columns: str) -> DataFrame:
    ranked = found.filter(F.col("rank") <= depth)
    return ranked.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", *columns))).alias("_best"))


def citation(title: Column, section: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" — "), F.coalesce(section, F.lit("")))


def numbered_context(found: DataFrame, depth: int = V.NUMBERED_CONTEXT_DEPTH) -> DataFrame:
    """(query_id, context, citations) from the best chunks, numbered from 1."""
    best = _best(found, depth, "doc_title", "section_title", "chunk_text")
    parts = F.transform("_best", lambda c, i: F.concat(
        F.lit("[Source "), (i + 1).cast("string"), F.lit(": "),
        citation(c["doc_title"], c["section_title"]), F.lit("]\n"), F.coalesce(c["chunk_text"], F.lit(""))))
    cited = F.transform("_best", lambda c: citation(c["doc_title"], c["section_title"]))
    return best.select("query_id", F.array_join(parts, V.CONTEXT_SEPARATOR).alias("context"),
                       cited.alias("citations"))


def plain_context(sources: DataFrame, depth: int = V.RETRIEVAL_DEPTH) -> DataFrame:
    """(query_id, context) from the best source records."""
    best = _best(sources, depth, "source", "content")
    parts = F.transform("_best", lambda s: F.concat(
        F.lit("[Source: "), s["source"], F.lit("]\n"), s["content"]))
    return best.select("query_id", F.array_join(parts, V.CONTEXT_SEPARATOR).alias("context"))


def clean_questions(questions: DataFrame, column: str) -> DataFrame:
    """Blank questions dropped, the rest stripped of surrounding whitespace."""
    return questions.filter(~is_blank(F.col(column))).withColumn(column, stripped(F.col(column)))


def history_messages(messages: DataFrame, drop_assistant: bool = False) -> DataFrame:
    """User and assistant turns; ``drop_assistant`` keeps the user's only."""
    kept = ["user"] if drop_assistant else ["user", "assistant"]
    return messages.filter(F.col("role").isin(*kept))


def last_messages(messages: DataFrame, limit: int = V.HISTORY_LIMIT) -> DataFrame:
    """The newest messages per conversation. Spark cuts each conversation to ``limit``
    before the shuffle as well, so a huge conversation costs no more than a small one."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("_age", F.row_number().over(newest))\
        .filter(F.col("_age") <= limit).drop("_age")


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def prompt_messages(requests: DataFrame, history: DataFrame) -> DataFrame:
    """(query_id, messages): system text, last history messages, then context and question.

    ``requests`` has query_id, question and context; ``history`` conv_id, turn, role, text.
    """
    past = last_messages(history).groupBy(F.col("conv_id").alias("query_id")).agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("_past"))
    past_messages = F.transform("_past", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    asked = F.concat(F.lit(V.CHAT_PROMPT_HEAD), "context", F.lit(V.CHAT_PROMPT_QUESTION),
                     "question", F.lit(V.CHAT_PROMPT_TAIL))
    none = F.from_json(F.lit("[]"), "array<struct<role: string, content: string>>")
    return requests.join(past, "query_id", "left").select("query_id", F.concat(
        F.array(_message("system", F.lit(V.CHAT_SYSTEM_PROMPT))),
        F.coalesce(past_messages, none),
        F.array(_message("user", asked))).alias("messages"))


def cited_prompt_messages(requests: DataFrame) -> DataFrame:
    """The two messages of a one-off question over a numbered context."""
    asked = F.concat(F.lit(V.CITED_PROMPT_HEAD), "context", F.lit(V.CITED_PROMPT_QUESTION),
                     "question", F.lit(V.CITED_PROMPT_TAIL))
    return requests.select("query_id", F.array(
        _message("system", F.lit(V.CITED_SYSTEM_PROMPT)), _message("user", asked)).alias("messages"))

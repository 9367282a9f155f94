"""Passage retrieval: exact vector top-k united with lexical matching, per inquiry and tenant."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from casebook.functions import lexicons as lx
from casebook.functions import text as tx
from casebook.functions.skew import ROWS_PER_SALT, key_counts, salted_join, top_per_key
from casebook.operators.ingest import embed, embedding_text
from casebook.operators.lexical import naming_chunks
from casebook.session import materialise, spread

K = ["query_id", "patient_id"]
PASSAGE_COLUMNS = (
    "query_id", "patient_id", "ord", "chunk_id", "document_id", "chunk_index", "page_number", "chunk_text",
    "display_name", "document_type", "document_date", "cosine_distance", "similarity",
)


def document_types(domains: Column) -> Column:
    """Document types a list of document domains covers; unknown domains add none."""
    chain = None
    for domain, kinds in lx.DOMAIN_DOCUMENT_TYPES.items():
        listed = F.array(*[F.lit(k) for k in kinds])
        covered = F.array_contains(domains, domain)
        part = F.when(covered, listed).otherwise(F.array().cast("array<string>"))
        chain = part if chain is None else F.concat(chain, part)
    return chain


def check_top_k(top_k: int | None) -> int:
    value = lx.DEFAULT_TOP_K if top_k is None else top_k
    if not 1 <= value <= lx.MAX_TOP_K:
        raise ValueError(f"top_k must be between 1 and {lx.MAX_TOP_K} (received {value}).")
    return value


def _has_text(name: str) -> Column:
    return F.length(F.trim(F.coalesce(F.col(name), F.lit("")))) > 0


def searchable_chunks(chunks: DataFrame, documents: DataFrame, extractions: DataFrame) -> DataFrame:
    """Chunks with their document's type and date and whether the ordinary gates hold.

    Joined on (document_id, patient_id) throughout, so no row can cross tenants.
    """
    keys = ["document_id", "patient_id"]
    docs = documents.select(F.col("id").alias("document_id"), "patient_id", "document_type", "document_date")
    ready = extractions.where((F.col("extraction_status") == "COMPLETED") & _has_text("extracted_text")).select(
        *keys, F.lit(True).alias("_ready")
    )
    scoped = docs.join(ready, keys, "left")
    # told before the join, so that who reads no vector, or no text, doesn't carry it there
    told = chunks.withColumn("_usable", F.col("embedding").isNotNull() & _has_text("chunk_text"))
    return told.join(scoped, keys).select(
        F.col("id").alias("chunk_id"),
        *keys,
        "chunk_index",
        "chunk_text",
        "embedding",
        "document_type",
        "document_date",
        (F.coalesce("_ready", F.lit(False)) & F.col("_usable")).alias("retrievable"),
    )


def document_questions(targets: DataFrame) -> DataFrame:
    """Target columns retrieval needs, for inquiries that reach documents."""
    bounded = F.col("temporal_scope") == "interval"
    return (
        targets.select(
            *K,
            document_types(F.col("document_domains")).alias("types"),
            F.col("target_entity").alias("entity"),
            "superlative",
            F.when(bounded, F.col("start_date")).alias("lo"),
            F.when(bounded, F.col("end_date")).alias("hi"),
            F.col("query_vec"),
        )
        .where(F.size("types") > 0)
    )


def of_tenants(asked: DataFrame, counts: DataFrame) -> DataFrame:
    """Questions of tenants that hold chunks; the others can find none."""
    return asked.join(counts.select("patient_id"), "patient_id", "left_semi").select(*asked.columns)


def embed_questions(
    targets: DataFrame, embedder: Callable[[list[str]], list[list[float]]], dimension: int, batch: int = lx.EMBEDDING_BATCH
) -> DataFrame:
    """Targets with ``query_vec`` and ``embedding_error``.

    Each distinct question that reaches documents is embedded once; others are not and have neither. A blank question,
    a failing embedder and vectors of a wrong count or dimension leave the vector null and give the reason.
    """
    rows = targets.drop("query_vec", "embedding_error").withColumn("_reaches", F.size(document_types(F.col("document_domains"))) > 0)
    asked = rows.where("_reaches").withColumn("_question", F.coalesce(embedding_text(F.col("query_text")), F.lit("")))
    none = F.lit(None).cast("long")
    distinct = spread(asked.select("_question").distinct(), "_question")
    snapshots = distinct.select(
        F.col("_question").alias("id"), none.alias("document_id"), none.alias("patient_id"), F.col("_question").alias("snapshot_text")
    )
    made = embed(snapshots, embedder, dimension, batch).select(
        F.col("id").alias("_question"), F.col("vector").alias("query_vec"), F.col("error").alias("embedding_error")
    )
    other = rows.where("NOT coalesce(_reaches, false)").withColumns(
        {"query_vec": F.lit(None).cast("array<float>"), "embedding_error": F.lit(None).cast("string")}
    )
    return asked.join(made, "_question").drop("_question").unionByName(other).drop("_reaches")


def extremum_dates(asked: DataFrame, documents: DataFrame) -> DataFrame:
    """Latest or first document date per inquiry and its domains, extraction not required."""
    dated = (
        documents.where(F.col("document_date").isNotNull())
        .groupBy("patient_id", "document_type", "document_date")
        .agg(F.lit(1).alias("_one"))
        .drop("_one")
    )
    scoped = asked.where(F.col("superlative").isNotNull() & F.col("entity").isNull())
    keyed, kinds = _kinds(scoped, "types", "superlative", "lo", "hi")
    found = (
        kinds.join(dated, "patient_id")
        .where(F.array_contains("types", F.col("document_type")) & _within_each_bound())
        .groupBy("kind")
        .agg(F.min("document_date").alias("_first"), F.max("document_date").alias("_last"))
    )
    wanted = F.when(F.col("kind.superlative") == "latest", F.col("_last")).otherwise(F.col("_first"))
    return keyed.join(found, "kind").select(*K, wanted.alias("target_date"))


def _kinds(asked: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """Inquiries keyed by what they ask for, and each distinct kind of a tenant once.

    Alike inquiries of one tenant share their answer, so their number doesn't multiply the work.
    """
    keyed = asked.select(*K, F.struct("patient_id", *columns).alias("kind"))
    return keyed, keyed.select("kind").distinct().select("kind", "kind.*")


def _within_each_bound() -> Column:
    date = F.col("document_date")
    return (F.col("lo").isNull() | (date >= F.col("lo"))) & (F.col("hi").isNull() | (date <= F.col("hi")))


def _date_gate() -> Column:
    """Date condition of the three retrieval paths."""
    date = F.col("document_date")
    both = F.col("lo").isNotNull() & F.col("hi").isNotNull()
    ordinary = ~both | (date.isNotNull() & date.between(F.col("lo"), F.col("hi")))
    anchored = date.isNotNull() & _within_each_bound()
    by_domain = date.eqNullSafe(F.col("target_date")) & date.isNotNull()
    return (
        F.when(F.col("superlative").isNull(), ordinary)
        .when(F.col("entity").isNotNull(), anchored)
        .otherwise(by_domain)
    )


def dense_candidates(
    asked: DataFrame,
    searchable: DataFrame,
    extrema: DataFrame,
    counts: DataFrame,
    top_k: int,
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """Exact nearest chunks: the top k per inquiry (ten when an entity anchors it)."""
    vectors = searchable.where("retrievable").select(
        "chunk_id", "document_id", "patient_id", "chunk_index", "document_type", "document_date",
        tx.unit_vector(F.col("embedding")).alias("unit"),
    )
    questions = asked.join(extrema, K, "left").withColumn("unit_query", tx.unit_vector(F.col("query_vec")))
    pairs = salted_join(
        vectors, questions.drop("query_vec"), ["patient_id"], "chunk_id", counts, rows_per_salt
    )
    scored = (
        pairs.where(F.array_contains("types", F.col("document_type")) & _date_gate())
        .withColumn("cosine_distance", 1.0 - tx.dot(F.col("unit"), F.col("unit_query")))
        .select(*K, "entity", "chunk_id", "document_id", "chunk_index", "document_date", "cosine_distance")
    )
    order = [F.col("cosine_distance").asc_nulls_last(), F.col("document_id"), F.col("chunk_index")]
    best = top_per_key(scored, K, order, lx.DENSE_CANDIDATES, "rank")
    return best.where(F.col("entity").isNotNull() | (F.col("rank") <= top_k)).drop("entity")


def lexical_candidates(
    asked: DataFrame, searchable: DataFrame, counts: DataFrame, rows_per_salt: int = ROWS_PER_SALT
) -> DataFrame:
    """Chunks naming the entity, newest first (oldest for FIRST), ten per inquiry.

    Texts are matched once per tenant, and cut to ten once per distinct kind of question. Kinds without date bounds
    see the ends of each hit list only, kinds with bounds meet whole lists in a grid.
    """
    anchored = asked.where(F.col("entity").isNotNull())
    keyed, kinds = _kinds(anchored, "entity", "types", "superlative", "lo", "hi")
    terms = kinds.select("patient_id", "entity").distinct()
    hits = materialise(naming_chunks(searchable, terms, counts, rows_per_salt))
    date = F.col("document_date")
    days = F.datediff(date, F.lit("1970-01-01").cast("date"))
    plain_open = F.col("lo").isNull() | F.col("hi").isNull()
    unbounded = F.when(F.col("superlative").isNull(), plain_open).otherwise(F.col("lo").isNull() & F.col("hi").isNull())
    named = ["patient_id", "entity"]
    lists = [*named, "document_type", "retrievable"]

    def end(order: Column) -> DataFrame:
        ranked = [order.asc_nulls_last(), F.col("document_id"), F.col("chunk_index")]
        return top_per_key(hits, lists, ranked, lx.LEXICAL_CANDIDATES, "rank").drop("rank")

    first = F.coalesce(F.col("superlative") == "first", F.lit(False))
    free, bounded = kinds.where(unbounded), kinds.where(~unbounded)
    met = end(-days).join(free.where(~first), named).unionByName(end(days).join(free.where(first), named))
    met = met.unionByName(
        salted_join(hits, bounded, named, "chunk_id", key_counts(hits, named), rows_per_salt, F.xxhash64("kind"))
    )
    plain = F.col("retrievable") & (plain_open | (date.isNotNull() & date.between(F.col("lo"), F.col("hi"))))
    extreme = date.isNotNull() & _within_each_bound()
    pairs = met.where(
        F.array_contains("types", F.col("document_type"))
        & F.when(F.col("superlative").isNull(), plain).otherwise(extreme)
    )
    chronological = F.when(first, days).otherwise(-days)
    order = [chronological.asc_nulls_last(), F.col("document_id"), F.col("chunk_index")]
    best = top_per_key(pairs, ["kind"], order, lx.LEXICAL_CANDIDATES, "rank")
    return best.select("kind", "chunk_id", "document_id", "chunk_index", "document_date", "rank").join(keyed, "kind").select(
        *K, "chunk_id", "document_id", "chunk_index", "document_date", "rank"
    )


def unite(asked: DataFrame, dense: DataFrame, lexical: DataFrame) -> DataFrame:
    """Candidate union without repeats, at most twenty per inquiry, in presentation order.

    Ordinary: lexical first, then dense. Superlative: by date. No entity: dense order. A chunk only
    the lexical side found carries distance 0 and similarity 1.
    """
    rows = dense.withColumn("dense_rank", F.col("rank")).withColumn("lexical_rank", F.lit(None).cast("int")).unionByName(
        lexical.withColumn("dense_rank", F.lit(None).cast("int"))
        .withColumn("lexical_rank", F.col("rank"))
        .withColumn("cosine_distance", F.lit(None).cast("double"))
    )
    merged = rows.groupBy(*K, "chunk_id").agg(
        F.first("document_id").alias("document_id"),
        F.first("chunk_index").alias("chunk_index"),
        F.first("document_date").alias("document_date"),
        F.min("dense_rank").alias("dense_rank"),
        F.min("lexical_rank").alias("lexical_rank"),
        F.coalesce(F.min("cosine_distance"), F.lit(0.0)).alias("cosine_distance"),
    )
    flagged = merged.join(asked.select(*K, "entity", "superlative"), K)
    days = F.coalesce(F.datediff("document_date", F.lit("1970-01-01").cast("date")), F.lit(0))
    by_date = F.col("superlative").isNotNull() & F.col("entity").isNotNull()
    primary = (
        F.when(by_date, F.when(F.col("superlative") == "latest", -days).otherwise(days))
        .when(F.col("lexical_rank").isNotNull(), F.col("lexical_rank"))
        .otherwise(lx.LEXICAL_CANDIDATES + F.col("dense_rank"))
    )
    # At most twenty rows per inquiry reach this window.
    window = Window.partitionBy(*K).orderBy(primary, "document_id", "chunk_index")
    lexical_only = F.col("dense_rank").isNull()
    return flagged.select(
        *K,
        F.row_number().over(window).alias("ord"),
        "chunk_id",
        "document_id",
        "chunk_index",
        "document_date",
        "cosine_distance",
        F.when(lexical_only, 1.0).otherwise(tx.similarity(F.col("cosine_distance"))).alias("similarity"),
    )


def retrieve(
    targets: DataFrame,
    chunks: DataFrame,
    documents: DataFrame,
    extractions: DataFrame,
    top_k: int | None = None,
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """Ordered candidate passages of every inquiry that targets documents."""
    limit = check_top_k(top_k)
    counts = key_counts(chunks, ["patient_id"])
    # The questions feed five branches; they are few columns per inquiry and written once.
    asked = materialise(of_tenants(document_questions(targets), counts))
    searchable = searchable_chunks(chunks, documents, extractions)
    extrema = extremum_dates(asked, documents)
    dense = dense_candidates(asked, searchable, extrema, counts, limit, rows_per_salt)
    lexical = lexical_candidates(asked, searchable, counts, rows_per_salt)
    found = unite(asked, dense, lexical)
    # Texts join last: only the few retained candidates carry them.
    texts = chunks.select(
        F.col("id").alias("chunk_id"), "document_id", "patient_id", "page_number", "chunk_text"
    )
    names = documents.select(F.col("id").alias("document_id"), "patient_id", "display_name", "document_type")
    return (
        found.join(names, ["document_id", "patient_id"])
        .join(texts, ["chunk_id", "document_id", "patient_id"])
        .select(*PASSAGE_COLUMNS)
    )


def select_whole_documents(targets: DataFrame, documents: DataFrame, extractions: DataFrame) -> DataFrame:
    """The two newest extracted documents of each inquiry's first domain."""
    structured = F.size("structured_domains") > 0
    first_document = F.when(~structured, F.slice("document_domains", 1, 1)).otherwise(F.array().cast("array<string>"))
    asked = targets.select(*K, document_types(first_document).alias("types")).where(F.size("types") > 0)
    done = extractions.where(
        (F.col("extraction_status") == "COMPLETED") & (F.coalesce("extracted_text", F.lit("")) != "")
    ).select("document_id", "patient_id", "extraction_status", "extracted_text")
    heads = documents.select(
        F.col("id").alias("document_id"), "patient_id", "display_name", "document_type", "document_date", "uploaded_at"
    )
    usable = heads.join(done.select("document_id", "patient_id"), ["document_id", "patient_id"])
    order = [F.col("document_date").desc_nulls_last(), F.col("uploaded_at").desc(), F.col("document_id")]
    # Per tenant and type only the two newest can be chosen, so the cut comes before the join.
    newest = top_per_key(usable, ["patient_id", "document_type"], order, 2, "_place").drop("_place")
    pairs = asked.join(newest, "patient_id").where(F.array_contains("types", F.col("document_type")))
    chosen = top_per_key(pairs, K, order, 2, "ord")
    return chosen.drop("types").join(done, ["document_id", "patient_id"])

"""One query per operator, each over whole driver tables: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelantern.config import FilterConfig, SearchOptions
from codelantern.functions import text as tx
from codelantern.functions import vectors
from codelantern.operators import (
    chunking,
    citations,
    embedding,
    filtering,
    fusion,
    lexical,
    prompting,
    references,
    semantic,
    summaries,
)
from codelantern.operators.sizing import new_folder
from codelantern.plans import corpus
from codelantern.plans.answer import Answers, answer_questions, answers_as_json
from codelantern.plans.retrieve import Retrieval, hybrid_retrieve
from codelantern.sources.repos import parse_repo_urls
from codelantern.sources.store import ChunkStore, merge_chunks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

FILE_CAP = 20_000
REPO_CAP = 120_000
INVENTORY_CAP = 25
HASH_DIM = 64
CLEARED = "src3"


def query(build: Query) -> Query:
    """Register ``build`` under its name; integers come out as BIGINT, floats as DOUBLE."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = build(spark, sf_dir)
        wide = {T.IntegerType: "long", T.FloatType: "double"}
        return df.select(*[
            F.col(f.name).cast(wide[type(f.dataType)]).alias(f.name) if type(f.dataType) in wide else F.col(f.name)
            for f in df.schema
        ])

    run.__name__ = build.__name__
    QUERIES[build.__name__] = run
    return build


def _doc_id() -> F.Column:
    return F.col("id").cast("long").alias("doc_id")


# -- sources and files -------------------------------------------------------
@query
def url_parse(spark, d):
    page, url = F.col("page_id"), F.col("url")
    rest = F.regexp_replace(url, "^https?://[^/]+", "")
    kind, number = page % 6, page.cast("string")
    address = (
        F.when(kind == 0, url)
        .when(kind == 1, F.concat(F.lit("https://github.com"), rest))
        .when(kind == 2, F.concat(F.lit(" https://www.GitHub.com/o"), number, F.lit("/r"), number, F.lit(".git\n")))
        .when(kind == 3, F.concat(F.lit("o"), number, F.lit("/r."), number, F.lit(".git/")))
        .when(kind == 4, F.concat(F.lit("github.com"), rest))
        .otherwise(F.concat(F.lit("https://me@github.com:443"), rest, F.lit("/")))
    )
    pages = corpus.table(spark, d, "pages").select(page, address.alias("address"))
    return parse_repo_urls(pages, "address").select("page_id", "host", "owner", "repo", "repo_id", "status")


@query
def file_filter(spark, d):
    config = FilterConfig.merged(max_file_size_bytes=FILE_CAP)
    reason = filtering.exclusion_reason(F.col("path"), F.col("size_bytes"), config)
    return corpus.files(spark, d).select("doc_id", "path", reason.alias("reason"))


@query
def selected_files(spark, d):
    config = FilterConfig.merged(max_file_size_bytes=FILE_CAP)
    return filtering.select_files(corpus.files(spark, d), config).select("doc_id", "repo_id", "path")


@query
def dir_prune(spark, d):
    return corpus.files(spark, d).select("doc_id", "path", filtering.in_ignored_directory(F.col("path")).alias("pruned"))


@query
def file_ext(spark, d):
    return corpus.files(spark, d).select("doc_id", "path", tx.extension(F.col("path")).alias("ext"))


@query
def detect_language(spark, d):
    return corpus.files(spark, d).select("doc_id", "path", tx.language_of(F.col("path")).alias("language"))


@query
def corpus_size(spark, d):
    return summaries.corpus_size(corpus.files(spark, d))


@query
def repo_size_guard(spark, d):
    return summaries.repo_size_guard(corpus.files(spark, d), REPO_CAP)


@query
def repo_scan(spark, d):
    return corpus.files(spark, d).where(F.col("repo_id") == CLEARED).select("doc_id", "repo_id", "path", "content")


@query
def repo_count(spark, d):
    return summaries.repo_count(corpus.files(spark, d))


def _kinds(spark: SparkSession, d: str) -> DataFrame:
    """Chunks as scanned, for uses that read narrow columns or a few rows."""
    return corpus.chunk_columns(corpus.files(spark, d))


@query
def chunk_summary(spark, d):
    return summaries.chunk_summary(_kinds(spark, d))


@query
def chunk_pct(spark, d):
    return summaries.chunk_percentages(_kinds(spark, d))


@query
def languages(spark, d):
    rows = corpus.files(spark, d).select("repo_id", tx.language_of(F.col("path")).alias("language"))
    return summaries.languages(rows).select("repo_id", F.array_join("languages", ",").alias("languages"))


@query
def file_inventory(spark, d):
    return summaries.file_inventory(_kinds(spark, d))


@query
def inventory_cap(spark, d):
    return summaries.capped_inventory(_kinds(spark, d), INVENTORY_CAP)


# -- text --------------------------------------------------------------------
@query
def tokenize(spark, d):
    rows = corpus.chunks(spark, d)
    return rows.select(_doc_id(), F.posexplode_outer(tx.tokenize(F.col("content"))).alias("pos", "token")).where(
        F.col("token").isNotNull()
    )


@query
def truncate_chunk(spark, d):
    return corpus.chunks(spark, d).select(_doc_id(), tx.truncate(F.col("content")).alias("content"))


@query
def enrich_text(spark, d):
    text = tx.embedding_text(F.col("file_path"), F.col("symbol_name"), F.col("symbol_type"), F.col("content"))
    return corpus.chunks(spark, d).select(_doc_id(), text.alias("text"))


@query
def citation_link(spark, d):
    link = tx.citation_link(F.col("repo_id"), F.col("file_path"), F.col("start_line"), F.col("end_line"))
    return corpus.chunks(spark, d).select(_doc_id(), link.alias("link"))


@query
def context_block(spark, d):
    block = tx.context_block(F.col("ord") + 1, *map(F.col, (
        "file_path", "symbol_name", "symbol_type", "start_line", "end_line", "language", "content")))
    return corpus.chunks(spark, d).select(_doc_id(), block.alias("block"))


@query
def inventory_question(spark, d):
    phrases = F.array(*map(F.lit, ("", " How MANY?", " list all files", " What files", " file  count", " File Count")))
    added = F.element_at(phrases, (F.col("conv_id") % 6 + 1).cast("int"))
    rows = corpus.table(spark, d, "conversations").select("conv_id", "turn", F.concat("text", added).alias("text"))
    return rows.select("conv_id", "turn", tx.is_inventory_question(F.col("text")).alias("flag"))


@query
def declined_answer(spark, d):
    said = F.when(F.col("conv_id") % 3 == 0, " I DON'T know based on the provided codebase context.").otherwise(" I don't know.")
    rows = corpus.table(spark, d, "conversations").select("conv_id", "turn", F.concat("text", said).alias("text"))
    return rows.select("conv_id", "turn", tx.is_declined(F.col("text")).alias("flag"))


@query
def conversation_log(spark, d):
    return summaries.conversation_log(corpus.table(spark, d, "conversations"))


@query
def health_rollup(spark, d):
    toxic = corpus.table(spark, d, "labels").select("doc_id", (F.col("toxic") == 0).alias("ok"))
    group = corpus.table(spark, d, "documents").select("doc_id", F.concat_ws("/", "source", "lang").alias("group_id"))
    return summaries.health_rollup(toxic.join(group, "doc_id"))


# -- chunking ----------------------------------------------------------------
_CHUNK = ["id", "repo_id", "file_path", "language", "content", "start_line", "end_line", "symbol_name", "symbol_type"]


@query
def markdown_sections(spark, d):
    return chunking.markdown_sections(corpus.headed_files(spark, d)).select(*_CHUNK)


@query
def module_chunk(spark, d):
    return chunking.module_chunks(corpus.spread(corpus.files(spark, d), "doc_id")).select(*_CHUNK)


@query
def chunk_router(spark, d):
    return chunking.chunk_files(corpus.mixed_files(spark, d)).select(*_CHUNK)


@query
def ast_python(spark, d):
    return chunking.symbol_chunks(corpus.python_files(spark, d)).select(*_CHUNK)


@query
def ast_js(spark, d):
    return chunking.symbol_chunks(corpus.script_files(spark, d)).select(*_CHUNK)


@query
def ingest_summary(spark, d):
    selected = filtering.select_files(corpus.mixed_files(spark, d))
    summary = summaries.ingest_summary(selected.select("repo_id", "path"), chunking.chunk_files(selected))
    return summary.withColumn("languages", F.array_join("languages", ","))


# -- vectors -----------------------------------------------------------------
@query
def cosine(spark, d):
    stored = corpus.table(spark, d, "embeddings")
    first = stored.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("model"))
    score = vectors.cosine(F.col("embedding"), F.col("model"))
    return stored.join(first, "label").select("vec_id", F.round(score, 6).alias("cosine"))


@query
def hash_embed(spark, d):
    rows = embedding.embed_chunks(corpus.chunks(spark, d), embedding.HashingEmbedder(HASH_DIM))
    # The outer form: a filter inferred from a plain explode would embed every text twice.
    return rows.select(_doc_id(), F.posexplode_outer("embedding").alias("slot", "weight")).select(
        "doc_id", "slot", F.round(F.col("weight").cast("double"), 4).alias("weight")
    )


# -- retrieval ---------------------------------------------------------------
@query
def bm25_postings(spark, d):
    return lexical.postings(corpus.chunks(spark, d)).select(_doc_id(), "token", "tf")


@query
def bm25_doc_len(spark, d):
    return lexical.doc_lengths(corpus.chunks(spark, d)).select(_doc_id(), "dl")


@query
def bm25_df(spark, d):
    return lexical.doc_frequencies(corpus.chunks(spark, d))


@query
def bm25_stats(spark, d):
    return lexical.corpus_stats(corpus.chunks(spark, d)).withColumn("avg_dl", F.round("avg_dl", 6))


def _index(spark: SparkSession, d: str) -> lexical.LexicalIndex:
    return lexical.LexicalIndex.over(corpus.chunks(spark, d))


def _retrieval(spark: SparkSession, d: str) -> Retrieval:
    return hybrid_retrieve(
        corpus.questions(spark, d), _kinds(spark, d), _index(spark, d), corpus.vectors(spark, d)
    )


@query
def bm25_topk(spark, d):
    hits = lexical.bm25_search(_index(spark, d), corpus.questions(spark, d))
    return hits.select("query_id", "repo_id", "id", "score", "bm25_rank")


@query
def semantic_topk(spark, d):
    hits = semantic.semantic_search(corpus.vectors(spark, d), corpus.questions(spark, d))
    return hits.select("query_id", "id", F.round("cosine", 6).alias("cosine"), F.round("score", 6).alias("score"), "semantic_rank")


@query
def stored_topk(spark, d):
    """Ranked from a stored index, a base with an upsert over it, by way of the blocks within reach; no text is read."""
    store = ChunkStore(spark, new_folder(spark))
    store.replace(corpus.stored_chunks(spark, d))
    store.upsert(corpus.stored_revisions(spark, d))
    asked = corpus.questions(spark, d)
    hits = lexical.bm25_search(store.snapshot().of(asked)[1], asked, SearchOptions(bounded_from=1))
    return hits.select("query_id", "repo_id", "id", "score", "bm25_rank")


@query
def chunk_coverage(spark, d):
    """Classes and their methods overlap; code beside symbols, blank sections and damaged blocks are dropped."""
    coded = corpus.mixed_files(spark, d)
    return summaries.chunk_coverage(coded, chunking.chunk_files(coded))


_FUSED = ["query_id", "id", "rank", "rrf_score", "source", "semantic_rank", "bm25_rank"]


@query
def rrf_fusion(spark, d):
    return _retrieval(spark, d).fused.select(*_FUSED)


@query
def hybrid_search(spark, d):
    return _retrieval(spark, d).hits.select(
        *_FUSED, "repo_id", "file_path", "symbol_name", "start_line", "end_line", "content"
    )


@query
def confidence(spark, d):
    return _retrieval(spark, d).confidence


@query
def retrieval_stats(spark, d):
    return _retrieval(spark, d).stats


# -- answers -----------------------------------------------------------------
@query
def citation_extract(spark, d):
    return citations.extract_citations(corpus.cited_answers(spark, d))


def _audit(spark: SparkSession, d: str) -> DataFrame:
    return citations.audit_citations(
        citations.extract_citations(corpus.cited_answers(spark, d)), corpus.answer_hits(spark, d)
    )


@query
def citation_audit(spark, d):
    return _audit(spark, d).drop("snippet")


@query
def citation_snippet(spark, d):
    return _audit(spark, d).where("valid").select("answer_id", "ord", "file_path", "snippet")


@query
def symbol_refs(spark, d):
    return references.symbol_references(corpus.cited_answers(spark, d))


@query
def known_symbols(spark, d):
    return references.known_symbols(corpus.answer_hits(spark, d))


@query
def unretrieved_refs(spark, d):
    return references.unretrieved_references(corpus.cited_answers(spark, d), corpus.answer_hits(spark, d))


def _lookup(spark: SparkSession, d: str, index: lexical.LexicalIndex) -> DataFrame:
    return references.reference_lookup(index, _kinds(spark, d), corpus.references(spark, d))


@query
def reference_lookup(spark, d):
    return _lookup(spark, d, _index(spark, d)).withColumn("score", F.round("score", 4))


@query
def multihop_merge(spark, d):
    asked, symbols = corpus.questions(spark, d), corpus.references(spark, d).withColumnRenamed("symbol", "text")
    # Searched twice, for the questions and for the symbols: tokenized once.
    index = _index(spark, d).for_batches(asked, symbols)
    hits = fusion.top_hits(lexical.bm25_search(index, asked).withColumnRenamed("bm25_rank", "rank"))
    return references.append_hits(hits, _lookup(spark, d, index))


@query
def context_budget(spark, d):
    return prompting.context_blocks(_retrieval(spark, d).hits)


@query
def prompt_assemble(spark, d):
    inventory = prompting.inventory_blocks(_kinds(spark, d))
    return prompting.user_prompts(corpus.questions(spark, d), _retrieval(spark, d).hits, inventory)


def _answers(spark: SparkSession, d: str) -> Answers:
    # Searched twice, for the questions and for the hop: tokenized once.
    return answer_questions(
        corpus.questions(spark, d), _kinds(spark, d), lexical.LexicalIndex.of(corpus.chunks(spark, d)),
        corpus.MentioningModel(), corpus.vectors(spark, d),
    )


@query
def grounded_answers(spark, d):
    return _answers(spark, d).answers


@query
def answer_citations(spark, d):
    return _answers(spark, d).citations


@query
def answer_json(spark, d):
    return answers_as_json(_answers(spark, d))


# -- store -------------------------------------------------------------------
@query
def upsert(spark, d):
    existing = corpus.files(spark, d).select(
        F.col("doc_id").cast("string").alias("id"), "repo_id", "content"
    )
    return merge_chunks(existing, corpus.revisions(spark, d))


@query
def clear_repo(spark, d):
    return corpus.files(spark, d).groupBy((F.col("repo_id") == CLEARED).alias("removed")).agg(F.count(F.lit(1)).alias("n"))

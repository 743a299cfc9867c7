"""The queries of the catalogue: each builds its plan from the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.functions import vectors as V
from corpusloom.functions.unicode import base_name, file_key
from corpusloom.operators import analytics as A
from corpusloom.operators import evaluation as E
from corpusloom.operators import incremental as I
from corpusloom.operators import ingest as G
from corpusloom.operators import search as S
from corpusloom.operators import skewed_keys as K
from corpusloom.operators import telemetry as T
from corpusloom.session import cut, table

Query = Callable[[SparkSession, str], DataFrame]

#: Depths and budgets of the search queries.
TOPK, DEPTH, PER_FILE, TOKENS, THRESHOLD, FACTOR = 10, 20, 2, 1500, 4, 2
MAPPING = {"algoritmia": "Algoritmia", "Álgebra": "Algoritmia", "Delineación": "Delineacion", "Clásicas": "Clasicas"}
SUFFIXES = ["ia", "ación"]
MARKERS = ["explica", "resume", "explain"]


def _t(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: table(s, d, name)


chunks, elements, extractions, retrievals, citations, golden = map(_t, ("chunks", "elements", "extractions", "retrievals", "citations", "golden_cases"))
file_state, file_listing, events, embeddings, documents = map(_t, ("file_state", "file_listing", "events", "embeddings", "documents"))


# ---- text and scalars ------------------------------------------------------------------------------


def text_normalize(s, d):
    c = F.col("text")
    return chunks(s, d).select("row_id", X.normalised(c).alias("norm"), X.text_hash(c).alias("text_sha1"))


def query_sanitize(s, d):
    return retrievals(s, d).select("retrieval_id", X.sanitised_query(F.col("query")).alias("sanitized"))


def _with_acronym():
    """Queries hold no acronym by themselves: one is appended by id."""
    names = F.array(*[F.lit(a) for a in X.ACRONYMS], F.lit("ITC-BT-44"), F.lit("objecte"))
    return F.concat(F.col("query"), F.lit(" según "), names[F.pmod("retrieval_id", F.lit(10)).cast("int")])


def acronym_expand(s, d):
    return retrievals(s, d).select("retrieval_id", X.expanded_acronyms(_with_acronym()).alias("expanded"))


def repair_counts(s, d):
    t = F.coalesce("text", F.lit(""))
    count = lambda p: F.size(F.regexp_extract_all(t, F.lit(p), 0))
    rows = elements(s, d).select("file_path", count(r"GLYPH<\d{1,7}>").alias("g"), count(r"GLYPH<c=\d+,font=[^>]*>").alias("u"), count("[ÆØœæŒ]").alias("e"))
    return rows.groupBy("file_path").agg(F.sum("g").alias("glyphs"), F.sum("u").alias("lost"), F.sum("e").alias("odd_letters"), F.count_if(F.col("g") + F.col("u") > 0).alias("touched"))


def token_count(s, d):
    return chunks(s, d).select("row_id", X.token_estimate(F.col("text")).alias("tokens"))


def point_ids(s, d):
    return chunks(s, d).select("row_id", X.point_id(F.col("file_path"), F.col("chunk_id")).alias("uuid"))


def page_clamp(s, d):
    rows = chunks(s, d).select("row_id", "file_path", "page").join(A.total_pages(extractions(s, d)), "file_path", "left")
    return rows.select("row_id", X.clamped_page(F.col("page"), F.col("total_pages")).alias("page"))


def page_marker(s, d):
    return elements(s, d).select("element_id", X.page_marker(F.col("text")).alias("marker")).where("marker IS NOT NULL")


def page_resolved(s, d):
    """The page of an element: its own if positive, else its metadata's, else its text's, else by position."""
    own = F.when(F.col("page") > 0, F.col("page"))
    meta = F.try_element_at("metadata", F.lit("page_number")).try_cast("int")
    place = F.floor(F.col("elem_no") / 8).cast("int") + 1
    return elements(s, d).select("element_id", F.coalesce(own, F.when(meta > 0, meta), X.page_marker(F.col("text")), place).alias("page"))


def vector_validate(s, d):
    v = V.valid_vector(F.when(F.pmod("vec_id", F.lit(7)) == 0, F.slice("embedding", 1, 40)).otherwise(F.col("embedding")), 64)
    u = V.unit(v)
    return embeddings(s, d).select("vec_id", F.size(v).alias("dim"), F.round(V.norm(u), 4).alias("norm"), F.round(u[0], 4).alias("first"), F.round(u[63], 4).alias("last"))


def citation_urls(s, d):
    return chunks(s, d).where("page IS NOT NULL").select("row_id", X.citation_url(F.col("topic"), F.col("file_path"), F.col("page")).alias("url"), X.citation_label(F.col("topic"), F.col("file_path"), F.col("page")).alias("label"))


def user_hashes(s, d):
    return events(s, d).select(F.col("user_id")).distinct().select("user_id", X.user_hash(F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@example.org"))).alias("user_hash"))


def heading_paths(s, d):
    return chunks(s, d).select("row_id", F.array_join("headings", " > ").alias("heading_path"))


def embed_inputs(s, d):
    """The inputs of three models: a plain e5, one that takes instructions, and one of another family."""
    q = F.col("query")
    models = {"plain": "multilingual-E5-base", "instructed": "multilingual-e5-large-instruct", "bare": "gte-large"}
    return retrievals(s, d).where("query IS NOT NULL").select("retrieval_id", *[X.embed_query(q, F.lit(m)).alias(n) for n, m in models.items()])


def passage_inputs(s, d):
    t = F.col("text")
    return chunks(s, d).where("text IS NOT NULL").select("row_id", X.embed_passage(t, F.lit("multilingual-e5-base")).alias("plain"), X.embed_passage(t, F.lit("e5-large-instruct")).alias("instructed"))


def context_limits(s, d):
    return retrievals(s, d).select("retrieval_id", X.context_limit(F.col("generative")).alias("tokens"))


def collection_names(s, d):
    return retrievals(s, d).where("topic IS NOT NULL").select("topic").distinct().select("topic", X.collection_name(F.col("topic"), "_v2").alias("collection"))


def text_repair(s, d):
    r = X.repaired(F.col("text"))
    return elements(s, d).where("text IS NOT NULL").select("element_id", r.alias("r")).select("element_id", "r.text", "r.glyph_decimal", "r.standard_encoding", "r.unrecoverable")


def repair_totals(s, d):
    """Over each file's elements: what was repaired, how many texts changed and how many hold what can't be repaired."""
    rows = elements(s, d).where("text IS NOT NULL").select("file_path", "text", X.repaired(F.col("text")).alias("r"))
    return rows.groupBy("file_path").agg(F.sum("r.glyph_decimal").alias("glyphs"), F.sum("r.standard_encoding").alias("letters"), F.count_if(F.col("r.text") != F.col("text")).alias("touched"), F.count_if(F.col("r.unrecoverable") > 0).alias("lost"))


def error_cut(s, d):
    return file_state(s, d).where("error IS NOT NULL").select("state_id", F.substring("error", 1, 12).alias("short"), F.concat(F.coalesce("hash", F.lit("?")), F.lit("-"), F.substring(F.sha1(F.col("status").cast("binary")), 1, 8)).alias("cache_key"))


def legibility(s, d):
    return elements(s, d).where("text IS NOT NULL").select("element_id", F.round(X.legibility(F.col("text")), 4).alias("legibility"))


def ref_split(s, d):
    rows = golden(s, d).select("item_id", F.explode("relevant_pages").alias("ref"))
    return E.page_refs(rows, "ref").select("item_id", "file", "page")


def file_names(s, d):
    return citations(s, d).select(file_key(F.col("file")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


# ---- search ----------------------------------------------------------------------------------------


def asked(s, d):
    """The stated query set: requests whose id is divisible by 50."""
    return retrievals(s, d).where("retrieval_id % 50 = 0 AND query IS NOT NULL AND topic IS NOT NULL").select(F.col("retrieval_id").alias("query_id"), "topic", "query")


def postings(s, d):
    p = S.postings(chunks(s, d))
    return p.groupBy("topic", "term").agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df"))


def idf_table(s, d):
    return S.idf_table(S.postings(chunks(s, d))).select("topic", "term", "df", F.round("idf", 6).alias("idf"))


def bm25_topk(s, d):
    return S.bm25(asked(s, d), chunks(s, d), TOPK)


def dense_topk(s, d):
    e = embeddings(s, d)
    return S.dense(e, e.where("vec_id % 50 = 0"), TOPK)


def _branches(s, d):
    e = embeddings(s, d)
    lexical = S.bm25(asked(s, d), chunks(s, d), DEPTH)
    close = S.dense(e, e.join(asked(s, d).select(F.col("query_id").alias("vec_id")), "vec_id", "left_semi"), DEPTH)
    return close, lexical


def rrf_fusion(s, d):
    return S.rrf(*_branches(s, d)).select("query_id", "doc_id", "rrf", "dense_rank", "bm25_rank")


def _fused(s, d):
    facts = chunks(s, d).select(F.col("row_id").alias("doc_id"), "file_path", "page", "chunk_id", "text", F.col("topic").alias("doc_topic"), X.token_estimate(F.col("text")).alias("tokens"))
    return S.rrf(*_branches(s, d)).join(facts, "doc_id")


def per_file_cap(s, d):
    return S.per_file_cap(_fused(s, d), "file_path", S.fused_order(), PER_FILE, TOPK).select("query_id", "doc_id", "rank")


def soft_trim(s, d):
    return S.soft_trim(S.per_file_cap(_fused(s, d), "file_path", S.fused_order(), PER_FILE, TOPK), "tokens", TOKENS).select("query_id", "doc_id", "rank", "used")


def hybrid_topk(s, d):
    return S.hybrid(asked(s, d), embeddings(s, d), chunks(s, d), TOPK, PER_FILE, TOKENS, DEPTH // 2)


def rerank_order(s, d):
    hits = S.bm25(asked(s, d), chunks(s, d), TOPK).join(asked(s, d).select("query_id", "query"), "query_id").join(chunks(s, d).select(F.col("row_id").alias("doc_id"), "text"), "doc_id")
    return S.overlap_rerank(hits, "query", "text").select("query_id", "doc_id", "rerank_score", "rerank")


def strategy_route(s, d):
    return T.routed(retrievals(s, d), X.query_tokens(F.col("query")), THRESHOLD, TOPK, FACTOR)


def _hits(s, d):
    facts = chunks(s, d).select(F.col("row_id").alias("doc_id"), "topic", "file_path", "page", "chunk_id", "text")
    return S.bm25(asked(s, d), chunks(s, d), 3).join(facts.where("page IS NOT NULL"), "doc_id")


def context_build(s, d):
    c = S.contexts(_hits(s, d), "topic", "text", "file_path", "page")
    return c.select("query_id", F.char_length("context").alias("chars"), F.sha1(F.encode("context", "UTF-8")).alias("context_sha1"))


def citation_list(s, d):
    return S.citation_rows(_hits(s, d), "topic", "file_path", "page", "chunk_id")


def citation_parse(s, d):
    c = S.contexts(_hits(s, d), "topic", "text", "file_path", "page")
    found = F.regexp_extract_all("context", F.lit(r"\[([^\]\[]+?\.pdf), p\.-?\d+\]\([^)]*\)"), 1)
    return c.select("query_id", F.explode(found).alias("file")).groupBy("query_id", "file").agg(F.count(F.lit(1)).alias("n"))


# ---- ingest ----------------------------------------------------------------------------------------


def extract_chain(s, d):
    return G.extract_chain(elements(s, d))


def text_layer_probe(s, d):
    return G.text_layer_probe(elements(s, d))


def boilerplate_lines(s, d):
    return G.boilerplate(elements(s, d))


def boilerplate_strip(s, d):
    e = elements(s, d)
    return G.strip_boilerplate(e, G.boilerplate(e))


def token_chunks(s, d):
    return G.numbered(G.token_chunks(elements(s, d)))


def sentence_pieces(s, d):
    return G.sentence_pieces(documents(s, d), "doc_id", "text", 128)


def hard_split(s, d):
    return G.hard_split(documents(s, d), "doc_id", "text", 64)


def chunk_dedupe(s, d):
    return G.first_by_text(chunks(s, d))


def upsert_merge(s, d):
    """Chunks indexed from October on, upserted over the earlier ones by point id."""
    cols = ["point_id", "row_id", "file_path", "chunk_id"]
    new = I.latest_by(chunks(s, d).where("indexed_at >= '2025-10-01'"), ["point_id"], [F.col("indexed_at"), F.col("row_id")], cols[1:])
    old = I.latest_by(chunks(s, d).where("indexed_at < '2025-10-01'"), ["point_id"], [F.col("indexed_at"), F.col("row_id")], cols[1:])
    return G.upsert(old, new, "point_id")


def replace_file(s, d):
    cols = ["row_id", "file_path", "chunk_id"]
    return G.replace_file(chunks(s, d).where("indexed_at < '2025-10-01'").select(*cols), chunks(s, d).where("indexed_at >= '2025-10-01'").select(*cols))


def delete_by_file(s, d):
    c = chunks(s, d)
    biggest = A.points_per_file(c, 1).first()
    return G.delete_file(c, biggest.file_path if biggest else "").groupBy("topic").agg(F.count(F.lit(1)).alias("points"))


def reconcile(s, d):
    return G.reconcile(file_listing(s, d), file_state(s, d))


def chunk_totals(s, d):
    return G.chunk_totals(elements(s, d))


def build_chunks(s, d):
    return G.build_chunks(elements(s, d), extractions(s, d))


def structured_chunks(s, d):
    return G.structured_chunks(elements(s, d))


def scan_counters(s, d):
    return T.scan_counters(incremental_scan(s, d))


def reset_failed(s, d):
    return T.reset_failed(T.current_state(file_state(s, d))).select("path", "retries", "was_reset")


def remove_topic(s, d):
    return T.remove_topic(T.current_state(file_state(s, d)), "Algoritmia", "topics").select("path", "status")


def consume_inflight(s, d):
    """Attempts of the log that stand in 'processing' as what was in flight."""
    begun = T.attempts(file_state(s, d)).where("status = 'processing'").select("path", F.col("topic").alias("context"), F.struct("at", "logged_at", "state_id").alias("at"))
    return T.consume_inflight(begun, T.current_state(file_state(s, d)))


def file_pages(s, d):
    return A.file_pages(chunks(s, d))


def dry_run_totals(s, d):
    return A.dry_run_totals(A.scanned_sieve(elements(s, d)), A.total_pages(extractions(s, d)))


def incremental_scan(s, d):
    listing = I.latest_by(file_listing(s, d), ["path"], [F.col("seen_at"), F.col("listing_id")], ["hash"])
    return T.scan_decision(listing, T.current_state(file_state(s, d)))


# ---- evaluation ------------------------------------------------------------------------------------


def _run(s, d, k: int = 10):
    """Predicted pages of each golden case: the pages of its lexical hits."""
    queries = golden(s, d).select(F.col("item_id").alias("query_id"), "topic", "query")
    hits = S.bm25(queries, chunks(s, d), k).join(chunks(s, d).select(F.col("row_id").alias("doc_id"), "file_path", "page"), "doc_id")
    return hits.select("query_id", "rank", file_key(F.col("file_path")).alias("file"), "page")


def _truth(s, d):
    rows = golden(s, d).select(F.col("item_id").alias("query_id"), F.explode("relevant_pages").alias("ref"))
    return E.page_refs(rows, "ref").withColumn("ref", F.concat_ws("#", "file", F.coalesce(F.col("page").cast("string"), F.lit("?"))))


def _predicted_pages(s, d, alias):
    p = E.ordered(E.canonical(_run(s, d), alias), ["file", "page"])
    return p.withColumn("ref", F.concat_ws("#", "file", F.coalesce(F.col("page").cast("string"), F.lit("?"))))


def ordered_pages(s, d):
    return E.ordered(_run(s, d), ["file", "page"])


def alias_map(s, d):
    """Of the documents: no two files of the test tables are byte-identical."""
    rows = documents(s, d).where("text IS NOT NULL").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("path"), F.md5(F.encode("text", "UTF-8")).alias("hash"))
    return E.alias_map(rows)


def page_match(s, d):
    alias = cut(E.alias_map(E.content_digest(elements(s, d))))  # for both sides
    return E.page_hits(_predicted_pages(s, d, alias), E.canonical(_truth(s, d), alias))


def _scores(s, d):
    return E.case_scores(golden(s, d).select(F.col("item_id").alias("query_id")), page_match(s, d), E.PAGE_KS)


def recall_at_k(s, d):
    return _scores(s, d).select(F.col("query_id").alias("item_id"), *[f"hit_at_{k}" for k in E.PAGE_KS])


def mrr(s, d):
    return _scores(s, d).select(F.col("query_id").alias("item_id"), F.round("rr", 6).alias("rr"))


def _by_topic(s, d):
    scores = _scores(s, d).join(golden(s, d).select(F.col("item_id").alias("query_id"), "topic"), "query_id")
    return E.family(scores, E.PAGE_KS, ["topic"])


def eval_aggregate(s, d):
    return _by_topic(s, d)


def eval_files(s, d):
    alias = cut(E.alias_map(E.content_digest(elements(s, d))))
    predicted = E.ordered(E.canonical(_run(s, d), alias).select("query_id", "file", "rank"), ["file"])
    hits = E.file_hits(predicted, E.canonical(_truth(s, d), alias))
    return E.family(E.case_scores(golden(s, d).select(F.col("item_id").alias("query_id")), hits, E.FILE_KS), E.FILE_KS)


def eval_summary(s, d):
    alias = cut(E.alias_map(E.content_digest(elements(s, d))))
    run, truth = cut(E.canonical(_run(s, d), alias)), cut(E.canonical(_truth(s, d), alias))
    pages = E.ordered(run, ["file", "page"]).withColumn("ref", F.concat_ws("#", "file", F.coalesce(F.col("page").cast("string"), F.lit("?"))))
    files = E.ordered(run.select("query_id", "file", "rank"), ["file"])
    cases = golden(s, d).select(F.col("item_id").alias("query_id"))
    return E.summary(cases, E.page_hits(pages, truth), E.file_hits(files, truth), alias)


def eval_warnings(s, d):
    alias = cut(E.alias_map(E.content_digest(elements(s, d))))
    return E.never_retrieved(E.canonical(_truth(s, d), alias), E.canonical(_run(s, d), alias))


def weighted_mrr(s, d):
    return E.weighted_mrr(_by_topic(s, d), "topic", ["Laboratorio"])


def run_compare(s, d):
    hits, cases = cut(page_match(s, d)), golden(s, d).select(F.col("item_id").alias("query_id"), "topic")
    scores = E.case_scores(cases, hits, E.PAGE_KS).join(cases, "query_id")
    other = E.case_scores(cases, hits.where("rank <= 3"), E.PAGE_KS).join(cases, "query_id")
    return E.compare_runs(E.family(other, E.PAGE_KS, ["topic"]), E.family(scores, E.PAGE_KS, ["topic"]), "topic")


# ---- health ----------------------------------------------------------------------------------------


def extractor_mix(s, d):
    return A.extractor_mix(chunks(s, d))


def missing_extractor_files(s, d):
    return A.unstructured_files(chunks(s, d))


def reingest_targets(s, d):
    return A.reingest_targets(chunks(s, d), file_state(s, d), ["Algoritmia", "Laboratorio"])


def file_diversity(s, d):
    return A.file_diversity(citations(s, d))


def points_per_file(s, d):
    return A.points_per_file(chunks(s, d))


def page_diagnostics(s, d):
    return A.page_diagnostics(chunks(s, d))


def page_gaps(s, d):
    return A.page_gaps(chunks(s, d))


def page_sequence_issues(s, d):
    return A.page_issues(chunks(s, d), A.total_pages(extractions(s, d)))


def page_sequence_fix(s, d):
    return A.fixed_pages(chunks(s, d), A.total_pages(extractions(s, d)))


def contiguous_runs(s, d):
    return A.contiguous_runs(elements(s, d))


def page_by_height(s, d):
    return A.page_by_height(elements(s, d))


def legibility_by_source(s, d):
    return A.legibility_by_source(elements(s, d))


def reader_comparison(s, d):
    return A.reader_comparison(elements(s, d), ("docling_vlm",), ("easyocr", "tesseract"))


def topic_stats(s, d):
    return A.topic_stats(chunks(s, d))


def latency_summary(s, d):
    return A.number_summary(events(s, d), "event_type", "value")


def short_queries(s, d):
    return A.short_queries(retrievals(s, d))


def seeded_sample(s, d):
    return A.seeded_sample(file_listing(s, d), "path", "7", 20)


def middle_page(s, d):
    return A.middle_page(chunks(s, d))


# ---- telemetry and state ---------------------------------------------------------------------------


def arm_summary(s, d):
    return T.arm_summary(retrievals(s, d))


def arm_topic_counts(s, d):
    return T.arm_counts(retrievals(s, d), "topic")


def arm_mode_counts(s, d):
    return T.arm_counts(retrievals(s, d), "mode")


def dormant_arms(s, d):
    return T.dormant(events(s, d).select(F.col("user_id").cast("string").alias("user"), "ts"), "user", "ts", 1).select("arm", "days")


def since_filter(s, d):
    return T.since(retrievals(s, d), "ts", 1760000000000).select("retrieval_id", "ts")


def monthly_retention(s, d):
    return T.retained_months(retrievals(s, d), "logged_at", 1, F.lit("2025-11-15").cast("date"))


def quarantine(s, d):
    return T.current_state(file_state(s, d)).where("status = 'failed'").select("path", "retries", (F.col("retries") >= T.MAX_RETRIES).alias("quarantined"))


def latest_state(s, d):
    return T.current_state(file_state(s, d)).select("path", "status", "hash", "retries")


def crash_counter(s, d):
    return T.crash_counter(file_state(s, d))


def interruptions(s, d):
    return T.interrupted(file_state(s, d))


def hard_death(s, d):
    return T.hard_deaths(file_state(s, d))


def kill_attribution(s, d):
    killed = T.attempts(file_state(s, d)).where("lower(error) LIKE '%interrump%'")
    context = F.concat(F.lit("extract "), base_name(F.col("path")), F.lit(" page 3"))
    markers = killed.select(F.col("state_id").alias("marker_id"), context.alias("context"), F.struct("at", "logged_at", "state_id").alias("since"))
    return T.kill_attribution(markers, T.interrupted_spells(file_state(s, d)))


def state_stats(s, d):
    return T.state_stats(T.current_state(file_state(s, d)))


def unknown_topics(s, d):
    return T.unknown_topics(retrievals(s, d), chunks(s, d))


def last_user_message(s, d):
    return T.latest_request(retrievals(s, d), "topic")


def topic_resolve(s, d):
    names = retrievals(s, d).where("topic IS NOT NULL").select("topic").distinct()
    return names.select("topic", T.resolved_topic(F.col("topic"), MAPPING, SUFFIXES, "General").alias("resolved"))


def generative_flag(s, d):
    return retrievals(s, d).select("retrieval_id", T.is_generative(F.col("query"), MARKERS).alias("is_generative"))


def request_dedupe(s, d):
    return T.deduplicated(retrievals(s, d), ["ts", "query", "topic", "mode"], "retrieval_id")


def telemetry_tail(s, d):
    return T.tail(retrievals(s, d), 50)


def stale_gaps(s, d):
    return T.stale_gaps(events(s, d), 43200)


# ---- further checks --------------------------------------------------------------------------------


def scanned_sieve(s, d):
    return A.scanned_sieve(elements(s, d))


def table_shapes(s, d):
    return A.table_shapes(elements(s, d))


def citation_integrity(s, d):
    cited = citations(s, d).select(file_key(F.col("file")).alias("name"), F.col("chunk_id").try_cast("int").alias("chunk_id"), "page")
    return A.citation_integrity(cited, chunks(s, d).select(file_key(F.col("file_path")).alias("name"), "chunk_id", "page"))


def short_golden(s, d):
    return E.short_cases(golden(s, d))


def truth_union(s, d):
    return E.truth_union(golden(s, d)).select("item_id", F.array_join("files", "|").alias("files"))


def missing_collections(s, d):
    return T.missing_collections(retrievals(s, d), chunks(s, d))


def ocr_retries(s, d):
    """Of the files in the scan; only a part of them has chunks."""
    return G.ocr_retries(extractions(s, d), chunks(s, d))


def result_counts(s, d):
    """Per query: results of either branch, of both together, and their files."""
    fused = S.rrf(*_branches(s, d)).join(chunks(s, d).select(F.col("row_id").alias("doc_id"), "file_path"), "doc_id")
    return fused.groupBy("query_id").agg(F.count("dense_rank").alias("dense"), F.count("bm25_rank").alias("lexical"), F.count(F.lit(1)).alias("merged"), F.countDistinct("file_path").alias("files"))


NAMES = """text_normalize query_sanitize acronym_expand repair_counts token_count point_ids page_clamp page_marker page_resolved vector_validate
citation_urls user_hashes heading_paths embed_inputs error_cut legibility ref_split file_names postings idf_table bm25_topk dense_topk rrf_fusion
per_file_cap soft_trim hybrid_topk rerank_order strategy_route context_build citation_list citation_parse extract_chain text_layer_probe
boilerplate_lines boilerplate_strip token_chunks sentence_pieces hard_split chunk_dedupe upsert_merge replace_file delete_by_file reconcile
chunk_totals incremental_scan ordered_pages alias_map page_match recall_at_k mrr eval_aggregate eval_files eval_warnings weighted_mrr run_compare
extractor_mix missing_extractor_files reingest_targets file_diversity points_per_file page_diagnostics page_gaps page_sequence_issues
page_sequence_fix contiguous_runs page_by_height legibility_by_source reader_comparison topic_stats latency_summary short_queries seeded_sample
middle_page arm_summary arm_topic_counts arm_mode_counts dormant_arms since_filter monthly_retention quarantine latest_state crash_counter
interruptions hard_death kill_attribution state_stats unknown_topics last_user_message topic_resolve generative_flag request_dedupe
telemetry_tail stale_gaps scanned_sieve table_shapes citation_integrity short_golden truth_union missing_collections ocr_retries result_counts
text_repair repair_totals passage_inputs context_limits collection_names eval_summary build_chunks structured_chunks scan_counters reset_failed remove_topic consume_inflight
file_pages dry_run_totals""".split()


def queries() -> dict[str, Query]:
    core = {"p2_found": I.p2_found, "p2_stored_target": I.p2_stored_target, "p3_pages_beyond": K.p3_pages_beyond, "p3_found": K.p3_found, "p3_topic_results": K.p3_topic_results, "p3_file_results": K.p3_file_results}
    return core | {n: globals()[n] for n in NAMES}

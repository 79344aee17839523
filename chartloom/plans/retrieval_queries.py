"""Queries of lexical, vector and hybrid retrieval, with their SQL.

The questions are the eval_passages whose item_id is divisible by 20, held against all chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartloom.functions import text as T
from chartloom.functions import vectors as V
from chartloom.operators import fusion, lexical, search, vector
from chartloom.operators.models import DIMENSIONS, embedder
from chartloom.sources.tables import cut, table


def all_chunks(s: SparkSession, d: str) -> DataFrame:
    """Distinct chunks with text and its estimated tokens."""
    rows = table(s, d, "note_chunks").where("text IS NOT NULL").select("chunk_id", "note_id", "subject_id", "hadm_id", "note_type", "chunk_index", "text").distinct()
    return rows.withColumn("tokens", T.token_estimate(F.col("text")))


def good_chunks(s: SparkSession, d: str) -> DataFrame:
    return all_chunks(s, d).where(lexical.good_chunks(F.col("text"), F.col("tokens")))


def questions(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "eval_passages").where("item_id % 20 = 0 AND query IS NOT NULL").select(F.col("item_id").alias("query_id"), "query").distinct()


def vectors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))


def chunk_vectors(s: SparkSession, d: str, chunks: DataFrame | None = None) -> DataFrame:
    """The embedder's vector of every chunk."""
    rows = chunks if chunks is not None else good_chunks(s, d)
    return rows.select("chunk_id", embedder()(F.col("text")).alias("vector"))


def question_vectors(s: SparkSession, d: str) -> DataFrame:
    return questions(s, d).select("query_id", embedder(role="query")(F.col("query")).alias("vector"))


def note_times(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "deid_results").where("note_id IS NOT NULL").groupBy("note_id").agg(F.max("charttime").alias("charttime"))


def arms(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The lexical and the vector list, and the chunks that both were drawn from, which are read and freed of repeats once."""
    chunks = cut(good_chunks(s, d))
    return lexical.two_pass(questions(s, d), chunks), vector.vector_top(question_vectors(s, d), chunk_vectors(s, d, chunks)), chunks


def hybrid(s: SparkSession, d: str) -> DataFrame:
    """Fused results with their chunks' fields and the notes' times, written once for what follows."""
    by_words, by_vectors, chunks = arms(s, d)
    fused = fusion.reciprocal_rank_fusion(by_words, by_vectors)
    return cut(fused.join(chunks, "chunk_id").join(note_times(s, d), "note_id", "left"))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def lexical_bm25(s: SparkSession, d: str) -> DataFrame:
    return _rounded(lexical.bm25(questions(s, d), cut(good_chunks(s, d))), "score")


def lexical_two_pass(s: SparkSession, d: str) -> DataFrame:
    return _rounded(lexical.two_pass(questions(s, d), cut(good_chunks(s, d))).withColumn("pass", F.col("pass").cast("long")), "score", "norm")


def lexical_cover_density(s: SparkSession, d: str) -> DataFrame:
    return _rounded(lexical.cover_density(questions(s, d), good_chunks(s, d)), "score")


def lexical_note_level(s: SparkSession, d: str) -> DataFrame:
    return _rounded(lexical.note_level(questions(s, d), all_chunks(s, d)), "score")


def expanded_queries(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "eval_passages").select(F.col("item_id").alias("query_id"), "query").where("query IS NOT NULL").distinct()
    return lexical.expand_queries(q).select("query_id", F.array_join("terms", "|").alias("terms"), F.size("terms").cast("long").alias("n_terms"))


def _one_in_twenty(s: SparkSession, d: str) -> DataFrame:
    return vectors(s, d).where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "vector")


def vector_topk(s: SparkSession, d: str) -> DataFrame:
    rows = vectors(s, d).select(F.col("vec_id").alias("chunk_id"), "vector")
    return _rounded(vector.vector_top(_one_in_twenty(s, d), rows), "score")


def vector_topk_v1(s: SparkSession, d: str) -> DataFrame:
    return _rounded(vector.vector_top(question_vectors(s, d), chunk_vectors(s, d, cut(all_chunks(s, d))), 50), "score")


def vector_lsh(s: SparkSession, d: str) -> DataFrame:
    """How many of the exact ten nearest the hashed search finds, by query."""
    rows = vectors(s, d).select(F.col("vec_id").alias("chunk_id"), "vector")
    exact = vector.vector_top(_one_in_twenty(s, d), rows, 10).select("query_id", "chunk_id")
    near = vector.lsh_top(_one_in_twenty(s, d), rows, 10).select("query_id", "chunk_id", F.lit(1).alias("hit"))
    return exact.join(near, ["query_id", "chunk_id"], "left").groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))


def rrf_fusion(s: SparkSession, d: str) -> DataFrame:
    return _rounded(fusion.reciprocal_rank_fusion(*arms(s, d)[:2]), "raw", "score")


def rrf_v1(s: SparkSession, d: str) -> DataFrame:
    f = fusion.fusion_v1(*arms(s, d)[:2])
    return _rounded(f, "score").select("query_id", "chunk_id", "score", "rank")


def arm_counts(s: SparkSession, d: str) -> DataFrame:
    return fusion.reciprocal_rank_fusion(*arms(s, d)[:2]).groupBy("query_id", "sources").agg(F.count("*").alias("n"))


def note_dedup(s: SparkSession, d: str) -> DataFrame:
    return fusion.dedup_notes(hybrid(s, d)).select("query_id", "chunk_id", "note_id", "rank")


def hybrid_rrf(s: SparkSession, d: str) -> DataFrame:
    top = fusion.dedup_notes(hybrid(s, d)).where("rank <= 10")
    return top.select("query_id", "chunk_id", "note_id", "subject_id", "note_type", "sources", F.round("score", 4).alias("score"), "rank")


def _temporal(mode: str, s: SparkSession, d: str) -> DataFrame:
    t = fusion.temporal(fusion.dedup_notes(hybrid(s, d)), mode)
    return t.select("query_id", "chunk_id", "subject_id", F.round("score", 6).alias("score"), F.round("days_ago", 6).alias("days_ago"), "rank")


def temporal_recent(s: SparkSession, d: str) -> DataFrame:
    return _temporal("recent", s, d)


def temporal_latest(s: SparkSession, d: str) -> DataFrame:
    return _temporal("latest", s, d)


def temporal_trend(s: SparkSession, d: str) -> DataFrame:
    return _temporal("trend", s, d)


def temporal_reference(s: SparkSession, d: str) -> DataFrame:
    """Time counted back from each patient's last note, whether or not it was found."""
    anchors = table(s, d, "deid_results").where("subject_id IS NOT NULL").groupBy("subject_id").agg(F.max("charttime").alias("anchor"))
    t = fusion.temporal(fusion.dedup_notes(hybrid(s, d)), "latest", reference=anchors)
    return t.select("query_id", "chunk_id", "subject_id", F.round("score", 6).alias("score"), F.round("days_ago", 6).alias("days_ago"), "rank")


def temporal_v1(s: SparkSession, d: str) -> DataFrame:
    return fusion.temporal_v1(hybrid(s, d)).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def temporal_intent(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "eval_passages").select("query").unionByName(table(s, d, "training_examples").select("query")).where("query IS NOT NULL").distinct()
    asked = q.select(F.explode(F.array(F.col("query"), F.concat(F.lit("most recent "), "query"), F.concat("query", F.lit(" over time")), F.concat("query", F.lit(" during this admission")))).alias("question"))
    return asked.select("question", T.temporal_mode(F.col("question")).alias("mode"))


def _distinct_places(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("note_id", "chunk_index").orderBy("chunk_id")
    return all_chunks(s, d).withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def context_window(s: SparkSession, d: str) -> DataFrame:
    rows = _distinct_places(s, d)
    c = fusion.context_windows(rows, rows.select("note_id", "chunk_index", "text", "tokens"))
    return c.select("chunk_id", F.md5("context_text").alias("context_md5"), "context_tokens", "n_context")


def context_anchor_first(s: SparkSession, d: str) -> DataFrame:
    rows = _distinct_places(s, d)
    c = fusion.context_windows(rows, rows.select("note_id", "chunk_index", "text", "tokens"), anchor_first=True)
    return c.select("chunk_id", "context_tokens", "n_context")


def _with_context(s: SparkSession, d: str) -> DataFrame:
    top = fusion.dedup_notes(hybrid(s, d)).where("rank <= 40")
    return fusion.context_windows(top, _distinct_places(s, d).select("note_id", "chunk_index", "text", "tokens"))


def source_block(s: SparkSession, d: str) -> DataFrame:
    b = fusion.source_blocks(_with_context(s, d))
    return b.select("query_id", F.md5("block").alias("block_md5"), F.length("block").cast("long").alias("length"), "n_sources")


def _stand_in_logit() -> F.Column:
    """A deterministic scorer in the cross-encoder's place: overlap of words, centred."""
    return F.col("overlap") * 6 - 3


def rerank_fallback(s: SparkSession, d: str) -> DataFrame:
    rows = _with_context(s, d).join(questions(s, d), "query_id").withColumn("overlap", T.overlap_ratio(F.col("query"), F.col("context_text")))
    r = fusion.rerank(rows, _stand_in_logit())
    return r.select("query_id", "chunk_id", F.round("rerank_score", 6).alias("rerank_score"), "fallback", "rank")


def rerank_compare(s: SparkSession, d: str) -> DataFrame:
    """Each query's first ten by fusion and by the reranker, side by side."""
    rows = _with_context(s, d).join(questions(s, d), "query_id").withColumn("overlap", T.overlap_ratio(F.col("query"), F.col("context_text")))
    rows = cut(fusion.rerank_positions(rows))
    by_fusion = rows.where("rank <= 10").select("query_id", "rank", F.col("chunk_id").alias("by_fusion"))
    by_reranker = fusion.rerank(rows, _stand_in_logit()).select("query_id", "rank", F.col("chunk_id").alias("by_reranker"), "fallback")
    return by_fusion.join(by_reranker, ["query_id", "rank"], "full_outer")


def scoped_questions(s: SparkSession, d: str) -> DataFrame:
    """Every twentieth training example as a question: of all notes, of its note's patient, admission, or patient and note type in turn."""
    notes = table(s, d, "note_chunks").where("note_id IS NOT NULL").groupBy("note_id").agg(*[F.max(c).alias(c) for c in lexical.SCOPE])
    note = F.element_at(F.split("positive_chunk_id", "_"), 2).try_cast("bigint")
    asked = table(s, d, "training_examples").where("example_id % 20 = 0 AND query IS NOT NULL").select(F.col("example_id").alias("query_id"), "query", note.alias("note_id")).distinct().join(notes, "note_id", "left")
    turn = F.floor(F.col("query_id") / 20) % 4
    return asked.select("query_id", "query", F.when(turn.isin(1, 3), F.col("subject_id")).alias("subject_id"), F.when(turn == 2, F.col("hadm_id")).alias("hadm_id"), F.when(turn == 3, F.col("note_type")).alias("note_type"))


def scoped_search(s: SparkSession, d: str) -> DataFrame:
    # The search itself frees the chunks of repeats.
    chunks = table(s, d, "note_chunks").where("text IS NOT NULL").where(lexical.good_chunks(F.col("text"), T.token_estimate(F.col("text"))))
    found = search.search(scoped_questions(s, d), chunks, note_times(s, d))
    return found.select("query_id", "chunk_id", "sources", F.round("score", 6).alias("score"), "mode", "rank")


def typed_questions(s: SparkSession, d: str) -> DataFrame:
    """Questions as typed, with a patient before them and a wish about time behind them, read back."""
    note = table(s, d, "note_chunks").where("subject_id IS NOT NULL").groupBy("note_id").agg(F.max("subject_id").alias("p"))
    ex = table(s, d, "training_examples").where("query IS NOT NULL").select("example_id", "query", F.element_at(F.split("positive_chunk_id", "_"), 2).try_cast("bigint").alias("note_id")).distinct().join(note, "note_id", "left")
    wish = F.when(F.col("example_id") % 3 == 0, " /recent").when(F.col("example_id") % 3 == 1, " /oldest").otherwise("")
    line = F.concat(F.coalesce(F.concat(F.lit("p:"), F.col("p").cast("string"), F.lit(" ")), F.lit("")), F.col("query"), wish)
    return search.parse_questions(ex.select(F.col("example_id").alias("query_id"), line.alias("line")))


def vector_checks(s: SparkSession, d: str) -> DataFrame:
    return vectors(s, d).select("vec_id", V.valid_vector(F.col("vector")).alias("valid"), F.round(V.cosine(F.col("vector"), F.reverse("vector")), 6).alias("mirror"))


QUERIES = {f.__name__: f for f in (
    lexical_bm25, lexical_two_pass, lexical_cover_density, lexical_note_level, expanded_queries, vector_topk, vector_topk_v1, vector_lsh, rrf_fusion, rrf_v1,
    arm_counts, note_dedup, hybrid_rrf, temporal_recent, temporal_latest, temporal_trend, temporal_reference, temporal_v1, temporal_intent, context_window,
    context_anchor_first, source_block, rerank_fallback, rerank_compare, vector_checks, scoped_search, typed_questions,
)}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_tokens(column: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({column}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def embedding_sql(key: str, words: str, source: str) -> str:
    """The stand-in embedder: counts of words by the first byte of their md5, signed by the second."""
    digit = lambda i: f"(strpos('0123456789abcdef', substr(h, {i}, 1)) - 1)"
    hashed = f"SELECT {key}, md5(unnest({words})) AS h FROM {source}"
    sums = f"SELECT {key}, ({digit(1)} * 16 + {digit(2)}) % {DIMENSIONS} AS dim, sum(CASE WHEN {digit(3)} < 8 THEN 1.0 ELSE -1.0 END) AS x FROM ({hashed}) GROUP BY ALL"
    full = f"SELECT {key}, list(CAST(coalesce(x, 0) AS DOUBLE) ORDER BY dim) AS v FROM (SELECT DISTINCT {key} FROM {source}) CROSS JOIN (SELECT range AS dim FROM range({DIMENSIONS})) LEFT JOIN ({sums}) USING ({key}, dim) GROUP BY {key}"
    return f"SELECT * FROM ({full}) WHERE len(list_filter(v, lambda y: y <> 0)) > 0"


_DICTIONARY = ", ".join(f"({i}, {_quoted(k)}, {j}, {_quoted(t)})" for i, (k, v) in enumerate(lexical.EXPANSIONS.items()) for j, t in enumerate(v))
_IGNORED = ", ".join(map(_quoted, (*lexical.STOPWORDS, *lexical.QUESTION_WORDS)))
CTE = {
    "chunks": r"SELECT DISTINCT chunk_id, note_id, subject_id, hadm_id, note_type, chunk_index, text, CAST(floor(length(regexp_extract_all(text, '\S+')) * 1.3) AS BIGINT) AS tokens FROM note_chunks WHERE text IS NOT NULL",
    "good": "SELECT * FROM chunks WHERE tokens >= 40 AND text NOT LIKE '%Unit No:%'",
    "q": "SELECT DISTINCT item_id AS query_id, query FROM eval_passages WHERE item_id % 20 = 0 AND query IS NOT NULL",
    "allq": "SELECT DISTINCT item_id AS query_id, query FROM eval_passages WHERE query IS NOT NULL",
    "lists": f"SELECT chunk_id, {sql_tokens('text')} AS t FROM good",
    "stats": "SELECT count(*) AS n, avg(len(t)) AS mean FROM lists",
    "occ": "SELECT chunk_id, len(t) AS dl, unnest(t) AS word FROM lists",
    "posts": "SELECT chunk_id, word, dl, count(*) AS tf FROM occ GROUP BY chunk_id, word, dl",
    "dfs": "SELECT word, count(*) AS df FROM posts GROUP BY word",
    "w": "SELECT chunk_id, word, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)) AS weight FROM posts JOIN dfs USING (word), stats",
    "qw": f"SELECT DISTINCT query_id, unnest({sql_tokens('query')}) AS word FROM q",
    "bm": "SELECT query_id, chunk_id, sum(weight) AS score FROM w JOIN qw USING (word) GROUP BY query_id, chunk_id",
    "bm_ranked": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM bm) WHERE rank <= 60",
    "dict": f"SELECT * FROM (VALUES {_DICTIONARY}) AS t(pos, trig, j, term)",
    "terms0": "SELECT query_id, pos, j, term FROM {q}, dict WHERE contains(lower(query), trig)",
    "terms": "SELECT query_id, term, place - 1 AS grp FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos, j) AS place FROM (SELECT query_id, term, min(pos * 100 + j) AS o, arg_min(pos, pos * 100 + j) AS pos, arg_min(j, pos * 100 + j) AS j FROM terms0 GROUP BY query_id, term)) WHERE place <= 8",
    "groups": f"SELECT query_id, 1 AS pass, 0 AS grp, list_filter(list_distinct({sql_tokens('query')}), lambda x: NOT list_contains([{_IGNORED}], x)) AS words FROM q UNION ALL SELECT query_id, 2, grp, list_distinct(list_transform(regexp_extract_all(term, '[a-zA-Z0-9]+'), lambda x: lower(x))) FROM terms",
    "gw": "SELECT query_id, pass, grp, len(words) AS needed, unnest(words) AS word FROM groups",
    "gh": "SELECT query_id, pass, grp, chunk_id, needed, word, weight FROM gw JOIN w USING (word)",
    "full_groups": "SELECT query_id, pass, grp, chunk_id FROM gh GROUP BY query_id, pass, grp, chunk_id HAVING count(*) = max(needed)",
    "pass_words": "SELECT DISTINCT query_id, pass, chunk_id, word, weight FROM gh SEMI JOIN full_groups USING (query_id, pass, grp, chunk_id)",
    "pass_scores": "SELECT query_id, pass, chunk_id, sum(weight) * CASE WHEN pass = 1 THEN 1.5 ELSE 1.0 END AS score FROM pass_words GROUP BY query_id, pass, chunk_id",
    "pass_best": "SELECT * EXCLUDE place FROM (SELECT *, row_number() OVER (PARTITION BY query_id, pass ORDER BY round(score, 9) DESC, chunk_id) AS place FROM pass_scores) WHERE place <= 60",
    "merged": "SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY pass) AS k FROM pass_best) WHERE k = 1",
    "lex": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM merged) WHERE rank <= 60",
    "vq": embedding_sql("query_id", f"list_distinct({sql_tokens('query')})", "q"),
    "vc": embedding_sql("chunk_id", sql_tokens("text"), "{pool}"),
    "sims": "SELECT query_id, chunk_id, list_cosine_similarity(vq.v, vc.v) AS score FROM vq, vc",
    "vec": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM sims) WHERE rank <= {top}",
    "pairs": "SELECT coalesce(l.query_id, v.query_id) AS query_id, coalesce(l.chunk_id, v.chunk_id) AS chunk_id, l.rank AS lexical_rank, v.rank AS vector_rank FROM lex l FULL OUTER JOIN vec v ON l.query_id = v.query_id AND l.chunk_id = v.chunk_id",
    "raws": "SELECT *, coalesce(1.0 / (60 + lexical_rank), 0.0) + coalesce({wv} / (60 + vector_rank), 0.0) + CASE WHEN lexical_rank IS NOT NULL AND vector_rank IS NOT NULL THEN {bonus} / 61 ELSE 0.0 END AS raw, CASE WHEN vector_rank IS NULL THEN 'bm25' WHEN lexical_rank IS NULL THEN 'vector' ELSE 'both' END AS sources FROM pairs",
    "fused": "SELECT *, (raw - min(raw) OVER p) / CASE WHEN max(raw) OVER p > min(raw) OVER p THEN max(raw) OVER p - min(raw) OVER p ELSE 1.0 END AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, lexical_rank NULLS LAST, vector_rank NULLS LAST, chunk_id) AS rank FROM raws WINDOW p AS (PARTITION BY query_id)",
    "times": "SELECT note_id, max(charttime) AS charttime FROM deid_results WHERE note_id IS NOT NULL GROUP BY note_id",
    "hyb": "SELECT * FROM fused JOIN good USING (chunk_id) LEFT JOIN times USING (note_id)",
    "dedup": "SELECT * EXCLUDE (rank, k), row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, note_id ORDER BY rank) AS k FROM hyb) WHERE k <= 2",
    "aged": "SELECT *, CASE WHEN charttime IS NOT NULL THEN greatest(0.0, date_diff('second', charttime, max(charttime) OVER (PARTITION BY query_id, subject_id)) / 86400.0) END AS days_ago FROM (SELECT * FROM dedup)",
    "places": "SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY note_id, chunk_index ORDER BY chunk_id) AS k FROM chunks) WHERE k = 1",
    "near": "SELECT a.chunk_id, b.chunk_index AS i, b.text, sum(b.tokens) OVER (PARTITION BY a.chunk_id ORDER BY {first} b.chunk_index ROWS UNBOUNDED PRECEDING) AS used, b.tokens FROM places a JOIN places b ON a.note_id = b.note_id AND b.chunk_index BETWEEN a.chunk_index - 1 AND a.chunk_index + 1",
    "ctx": "SELECT chunk_id, string_agg(text, chr(10) ORDER BY i) AS context, CAST(sum(tokens) AS BIGINT) AS context_tokens, count(*) AS n_context FROM near WHERE used <= 600 GROUP BY chunk_id",
    "near40": "SELECT a.query_id, a.chunk_id, b.chunk_index AS i, b.text, b.tokens, sum(b.tokens) OVER (PARTITION BY a.query_id, a.chunk_id ORDER BY b.chunk_index ROWS UNBOUNDED PRECEDING) AS used FROM dedup a JOIN places b ON a.note_id = b.note_id AND b.chunk_index BETWEEN a.chunk_index - 1 AND a.chunk_index + 1 WHERE a.rank <= 40",
    "ctx40": "SELECT query_id, chunk_id, string_agg(text, chr(10) ORDER BY i) AS context FROM near40 WHERE used <= 600 GROUP BY query_id, chunk_id",
    "cand": "SELECT d.*, coalesce(c.context, d.text) AS context_text FROM dedup d LEFT JOIN ctx40 c USING (query_id, chunk_id) WHERE d.rank <= 40",
    "tagged": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM cand WHERE trim(context_text) <> ''",
    "blocks": "SELECT query_id, n, '[S' || n || '] note_type=' || coalesce(note_type, 'unknown') || ' | charttime=' || coalesce(strftime(charttime, '%Y-%m-%d'), 'unknown') || chr(10) || trim(context_text, ' ') AS block FROM tagged",
    "sized": "SELECT *, sum(length(block) + 2) OVER (PARTITION BY query_id ORDER BY n ROWS UNBOUNDED PRECEDING) - length(block) - 2 AS before FROM blocks",
    "shared": "SELECT c.query_id, c.chunk_id, c.rank, list_filter(list_distinct(regexp_split_to_array(lower(query), '\\s+')), lambda x: x <> '' AND NOT list_contains([" + ", ".join(map(_quoted, T.OVERLAP_STOPWORDS)) + "], x)) AS want, list_distinct(regexp_split_to_array(lower(context_text), '\\s+')) AS have FROM cand c JOIN q USING (query_id)",
    "logits": "SELECT query_id, chunk_id, rank, 1 / (1 + exp(-(CASE WHEN len(want) > 0 THEN len(list_intersect(want, have)) / len(want) ELSE 0.0 END * 6 - 3))) AS rerank_score FROM shared",
    "judged": "SELECT *, max(rerank_score) OVER (PARTITION BY query_id) < 0.35 AS fallback FROM logits",
    "reranked": "SELECT query_id, chunk_id, rerank_score, fallback, place AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN NOT fallback THEN round(rerank_score, 9) END DESC NULLS LAST, rank) AS place FROM judged) WHERE place <= 10",
}
_BM25 = ["chunks", "good", "q", "lists", "stats", "occ", "posts", "dfs", "w"]
_LEX = [*_BM25, "dict", "terms0", "terms", "groups", "gw", "gh", "full_groups", "pass_words", "pass_scores", "pass_best", "merged", "lex"]
_FUSED = [*_LEX, "vq", "vc", "sims", "vec", "pairs", "raws", "fused"]
_HYBRID = [*_FUSED, "times", "hyb", "dedup"]
_CONTEXT = [*_HYBRID, "places", "near40", "ctx40", "cand"]
_RERANK = [*_CONTEXT, "shared", "logits", "judged", "reranked"]


def with_ctes(names: list[str], final: str, parts: dict[str, str] | None = None, **values: str) -> str:
    """One statement of the named parts, in their order, and the final select; ``parts`` takes the place of named ones."""
    fill = {"q": "q", "pool": "good", "top": "60", "wv": "1.2", "bonus": "0.5", "first": ""} | values
    cte = CTE | (parts or {})
    part = lambda n: cte[n].replace("{pool}", fill["pool"]) if n == "vc" else cte[n].format(**fill) if n in ("terms0", "vec", "raws", "near") else cte[n]
    return "WITH " + ", ".join(f"{n} AS ({part(n)})" for n in dict.fromkeys(names)) + (f" {final}" if final else "")


def _timed(order: str, score: str, keep: str = "true", names: list[str] | None = None) -> str:
    inner = f"SELECT query_id, chunk_id, subject_id, {score} AS score, days_ago, charttime, rank AS old FROM aged WHERE {keep}"
    return with_ctes([*(names or _HYBRID), "aged"], f"SELECT query_id, chunk_id, subject_id, round(score, 6) AS score, round(days_ago, 6) AS days_ago, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS rank FROM ({inner})")


_BOOST = "score + coalesce(0.20 * pow(0.5, days_ago / 180.0), 0.0)"
_MODE = "CASE " + " ".join(f"WHEN regexp_matches(lower(question), {_quoted('|'.join(p))}) THEN '{m}'" for m, p in T.TEMPORAL_PATTERNS) + " ELSE 'all' END"
_NOTE_LEVEL = _BM25 + ["qw", "bm", "bm_ranked"]
_IN = " AND ".join(f"(a.{c} IS NULL OR a.{c} = g.{c})" for c in lexical.SCOPE)
_TURN = "example_id // 20 % 4"
_SCOPED = {
    "asks": f"""SELECT DISTINCT example_id AS query_id, query, CASE WHEN {_TURN} IN (1, 3) THEN n.subject_id END AS subject_id, CASE WHEN {_TURN} = 2 THEN n.hadm_id END AS hadm_id, CASE WHEN {_TURN} = 3 THEN n.note_type END AS note_type FROM training_examples
 LEFT JOIN (SELECT note_id, max(subject_id) AS subject_id, max(hadm_id) AS hadm_id, max(note_type) AS note_type FROM note_chunks WHERE note_id IS NOT NULL GROUP BY note_id) n ON n.note_id = try_cast(split_part(positive_chunk_id, '_', 2) AS BIGINT) WHERE example_id % 20 = 0 AND query IS NOT NULL""",
    "q": "SELECT DISTINCT query_id, query FROM asks",
    "gh": f"SELECT gw.query_id, pass, grp, gw_w.chunk_id, needed, word, weight FROM gw JOIN w gw_w USING (word) JOIN asks a ON a.query_id = gw.query_id JOIN good g ON g.chunk_id = gw_w.chunk_id WHERE {_IN}",
    "sims": f"SELECT vq.query_id, vc.chunk_id, list_cosine_similarity(vq.v, vc.v) AS score FROM vq JOIN asks a ON a.query_id = vq.query_id CROSS JOIN vc JOIN good g ON g.chunk_id = vc.chunk_id WHERE {_IN}",
}
_SCOPED_FINAL = f"""SELECT query_id, chunk_id, sources, round(CASE WHEN mode IN ('recent', 'latest') THEN boosted ELSE score END, 6) AS score, mode, place AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY
 CASE WHEN mode IN ('recent', 'latest') THEN round(boosted, 9) END DESC NULLS LAST, CASE WHEN mode = 'trend' THEN charttime END NULLS LAST, rank) AS place FROM (SELECT aged.*, {_BOOST} AS boosted, mode FROM aged JOIN (SELECT query_id, {_MODE} AS mode FROM (SELECT query_id, query AS question FROM q)) USING (query_id))
 WHERE mode <> 'recent' OR days_ago IS NULL OR days_ago <= 365) WHERE place <= 10"""

SQL = {
    "lexical_bm25": with_ctes([*_BM25, "qw", "bm", "bm_ranked"], "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM bm_ranked"),
    "lexical_two_pass": with_ctes(_LEX, "SELECT query_id, CAST(pass AS BIGINT) AS pass, chunk_id, round(score, 6) AS score, rank, round((score - min(score) OVER p) / CASE WHEN max(score) OVER p > min(score) OVER p THEN max(score) OVER p - min(score) OVER p ELSE 1.0 END, 6) AS norm FROM lex WINDOW p AS (PARTITION BY query_id)"),
    "lexical_note_level": with_ctes(["chunks", "good", *[n for n in _BM25 if n not in ("chunks", "good")], "q", "qw", "bm", "bm_ranked"], "SELECT query_id, chunk_id, note_id, round(score, 6) AS score, rank FROM (SELECT b.query_id, c.chunk_id, c.note_id, b.score, row_number() OVER (PARTITION BY b.query_id ORDER BY round(b.score, 9) DESC, c.chunk_id) AS rank FROM bm_ranked b JOIN chunks c ON c.note_id = b.chunk_id) WHERE rank <= 60", {"good": "SELECT note_id AS chunk_id, string_agg(text, chr(10) ORDER BY chunk_index, chunk_id) AS text FROM chunks GROUP BY note_id"}),
    "expanded_queries": with_ctes(["allq", "dict", "terms0", "terms"], "SELECT query_id, coalesce(string_agg(term, '|' ORDER BY grp), '') AS terms, count(term) AS n_terms FROM allq LEFT JOIN terms USING (query_id) GROUP BY query_id", q="allq"),
    "vector_topk": "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, list_cosine_similarity(a.v, b.v) AS score FROM v a, v b WHERE a.vec_id % 20 = 0) SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM s) WHERE rank <= 60",
    "vector_topk_v1": with_ctes(["chunks", "q", "vq", "vc", "sims", "vec"], "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM vec", pool="chunks", top="50"),
    "rrf_fusion": with_ctes(_FUSED, "SELECT query_id, chunk_id, lexical_rank, vector_rank, sources, round(raw, 6) AS raw, round(score, 6) AS score, rank FROM fused"),
    "rrf_v1": with_ctes(_FUSED, "SELECT query_id, chunk_id, round(raw, 6) AS score, rank FROM fused", wv="1.0", bonus="0.0"),
    "arm_counts": with_ctes(_FUSED, "SELECT query_id, sources, count(*) AS n FROM fused GROUP BY query_id, sources"),
    "note_dedup": with_ctes(_HYBRID, "SELECT query_id, chunk_id, note_id, rank FROM dedup"),
    "hybrid_rrf": with_ctes(_HYBRID, "SELECT query_id, chunk_id, note_id, subject_id, note_type, sources, round(score, 4) AS score, rank FROM dedup WHERE rank <= 10"),
    "temporal_recent": _timed("round(score, 9) DESC, old", _BOOST, "days_ago IS NULL OR days_ago <= 365"),
    "temporal_latest": _timed("round(score, 9) DESC, old", _BOOST),
    "temporal_trend": _timed("charttime NULLS LAST, old", "score"),
    "temporal_reference": with_ctes(_HYBRID, f"SELECT query_id, chunk_id, subject_id, round(score, 6) AS score, round(days_ago, 6) AS days_ago, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, old) AS rank FROM (SELECT query_id, chunk_id, subject_id, {_BOOST} AS score, days_ago, rank AS old FROM (SELECT d.*, CASE WHEN d.charttime IS NOT NULL AND a.anchor IS NOT NULL THEN greatest(0.0, date_diff('second', d.charttime, a.anchor) / 86400.0) END AS days_ago FROM dedup d LEFT JOIN (SELECT subject_id, max(charttime) AS anchor FROM deid_results WHERE subject_id IS NOT NULL GROUP BY subject_id) a USING (subject_id)))"),
    "temporal_v1": with_ctes(_HYBRID, "SELECT query_id, chunk_id, round(b, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(b, 9) DESC, old) AS rank FROM (SELECT query_id, chunk_id, rank AS old, score * (1 + 0.2 * CASE WHEN charttime IS NOT NULL THEN greatest(0.0, least(1.0, 1 - date_diff('second', charttime, TIMESTAMP '2200-01-01') / 86400.0 / 36525)) ELSE 0.0 END) AS b FROM hyb)"),
    "temporal_intent": f"WITH q AS (SELECT DISTINCT query FROM (SELECT query FROM eval_passages UNION ALL SELECT query FROM training_examples) WHERE query IS NOT NULL), a AS (SELECT unnest([query, 'most recent ' || query, query || ' over time', query || ' during this admission']) AS question FROM q) SELECT question, {_MODE} AS mode FROM a",
    "context_window": with_ctes(["chunks", "places", "near", "ctx"], "SELECT p.chunk_id, md5(coalesce(c.context, p.text)) AS context_md5, coalesce(c.context_tokens, 0) AS context_tokens, coalesce(c.n_context, 0) AS n_context FROM places p LEFT JOIN ctx c USING (chunk_id)"),
    "context_anchor_first": with_ctes(["chunks", "places", "near", "ctx"], "SELECT p.chunk_id, coalesce(c.context_tokens, 0) AS context_tokens, coalesce(c.n_context, 0) AS n_context FROM places p LEFT JOIN ctx c USING (chunk_id)", first="b.chunk_index <> a.chunk_index,"),
    "source_block": with_ctes([*_CONTEXT, "tagged", "blocks", "sized"], "SELECT query_id, md5(string_agg(block, chr(10) || chr(10) ORDER BY n)) AS block_md5, length(string_agg(block, chr(10) || chr(10) ORDER BY n)) AS length, count(*) AS n_sources FROM sized WHERE n = 1 OR before + length(block) <= 8000 GROUP BY query_id"),
    "rerank_fallback": with_ctes(_RERANK, "SELECT query_id, chunk_id, round(rerank_score, 6) AS rerank_score, fallback, rank FROM reranked"),
    "rerank_compare": with_ctes(_RERANK, "SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.rank, b.rank) AS rank, a.chunk_id AS by_fusion, b.chunk_id AS by_reranker, b.fallback FROM (SELECT query_id, chunk_id, rank FROM cand WHERE rank <= 10) a FULL OUTER JOIN reranked b ON a.query_id = b.query_id AND a.rank = b.rank"),
    "scoped_search": with_ctes(["chunks", "good", "asks", *[n for n in _HYBRID if n not in ("chunks", "good")], "aged"], _SCOPED_FINAL, _SCOPED),
    "typed_questions": "SELECT DISTINCT example_id AS query_id, trim(query) AS query, n.p AS subject_id, CASE example_id % 3 WHEN 0 THEN 'recent' WHEN 1 THEN 'trend' END AS mode FROM training_examples LEFT JOIN (SELECT note_id, max(subject_id) AS p FROM note_chunks WHERE subject_id IS NOT NULL GROUP BY note_id) n ON n.note_id = try_cast(split_part(positive_chunk_id, '_', 2) AS BIGINT) WHERE query IS NOT NULL",
    "vector_checks": "SELECT vec_id, len(list_filter(embedding, lambda x: isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS valid, round(list_cosine_similarity(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), list_reverse(list_transform(embedding, lambda x: CAST(x AS DOUBLE)))), 6) AS mirror FROM embeddings",
}

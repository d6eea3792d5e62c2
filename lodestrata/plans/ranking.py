"""Ranking queries over documents (corpus) and benchmark (queries), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import text as tx
from lodestrata.operators import fusion, lexical, packing, vector
from lodestrata.operators.lineage import kept

K = 10
BUDGET = 4000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text")


def asked(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")


def shown(ranked: DataFrame) -> DataFrame:
    return ranked.select("qid", "doc", "rank", F.round("score", 6).alias("score"))


def _index(spark, sf):
    return lexical.index(corpus(spark, sf), asked(spark, sf))


def tokenize_stats(spark, sf):
    ws = tx.tokens(F.col("text"))
    return corpus(spark, sf).select("doc", F.size(ws).cast("long").alias("n_tokens"), F.size(F.array_distinct(ws)).cast("long").alias("n_distinct"))


def token_cost(spark, sf):
    return corpus(spark, sf).select("doc", tx.token_cost(F.col("text")).alias("cost"))


def identifier_extract(spark, sf):
    return corpus(spark, sf).select("doc", F.array_join(F.sort_array(tx.identifiers(F.col("text"))), "|").alias("identifiers"))


def title_body(spark, sf):
    t = F.col("text")
    return corpus(spark, sf).select("doc", F.length(tx.title_of(t)).cast("long").alias("title_chars"), F.length(tx.body_of(t)).cast("long").alias("body_chars"))


def request_key(spark, sf):
    return corpus(spark, sf).select("doc", tx.request_key(F.col("doc").cast("string"), F.col("text")).alias("key"))


def term_postings(spark, sf):
    rows = corpus(spark, sf).select("doc", F.explode(tx.tokens(F.col("text"))).alias("term"))
    return rows.groupBy("doc", "term").agg(F.count("*").alias("tf"))


def doc_freq(spark, sf):
    return lexical.document_frequencies(corpus(spark, sf))


def collection_stats(spark, sf):
    n = F.size(tx.tokens(F.col("text")))
    return corpus(spark, sf).agg(F.count("*").alias("n_docs"), F.sum(n).cast("long").alias("n_tokens"), F.round(F.avg(n), 6).alias("avgdl"))


def _plus(spark, sf, k: int = K):
    """Index and BM25+ scores with at least k documents a query."""
    ix = _index(spark, sf)
    return ix, lexical.with_the_rest(ix, lexical.bm25_plus(ix, k=k), k)


def bm25_plus_topk(spark, sf):
    return shown(lexical.best(_plus(spark, sf)[1], K))


def _okapi(spark, sf, k: int = K):
    ix = _index(spark, sf)
    return lexical.with_the_rest(ix, lexical.bm25_okapi(ix, lexical.document_frequencies(corpus(spark, sf)), k=k), k)


def bm25_okapi_topk(spark, sf):
    return shown(lexical.best(_okapi(spark, sf), K))


def bm25f_topk(spark, sf):
    ix, scores, _ = lexical.bm25f(corpus(spark, sf), asked(spark, sf), K)
    return shown(lexical.best(lexical.with_the_rest(ix, scores, K), K))


def tfidf_topk(spark, sf):
    ix, scores = lexical.tfidf(corpus(spark, sf), asked(spark, sf))
    return shown(lexical.best(lexical.with_the_rest(ix, scores, K), K))


def qlm_dirichlet_topk(spark, sf):
    return shown(lexical.best(lexical.qlm_dirichlet(_index(spark, sf), K), K))


def qlm_jm_topk(spark, sf):
    return shown(lexical.best(lexical.qlm_jm(_index(spark, sf), K), K))


def _expanded(spark, sf):
    """The expanded queries, from the likeliest documents."""
    docs, ix = corpus(spark, sf), _index(spark, sf)
    return docs, ix, kept(lexical.rm3_terms(docs, ix, lexical.qlm_jm(ix, K, 0.5)))


def rm3_expansion(spark, sf):
    return _expanded(spark, sf)[2].select("qid", "term", F.round("weight", 9).alias("weight"))


def rm3_topk(spark, sf):
    """All documents by the expanded query: sum of weight * ln p(term | document), smoothed as in the first pass."""
    docs, ix, terms = _expanded(spark, sf)
    wide = lexical.index_terms(docs, terms.select("qid", "term", F.col("weight").alias("qtf")), ix.asked)
    return shown(lexical.best(lexical.qlm_jm(wide, K, 0.5), K))


def sparse_expansion_topk(spark, sf):
    return shown(lexical.best(lexical.sparse_expansion(corpus(spark, sf), asked(spark, sf)), K))


def _two_rankers(spark, sf) -> DataFrame:
    """(ranker, qid, doc, score, rank) of the best twenty by two rankers; both come from one scan."""
    ix, fields, plus = lexical.bm25f(corpus(spark, sf), asked(spark, sf), 20)
    a = lexical.best(lexical.with_the_rest(ix, plus, 20), 20).select(F.lit("bm25_plus").alias("ranker"), "qid", "doc", "score", "rank")
    b = lexical.best(lexical.with_the_rest(ix, fields, 20), 20).select(F.lit("bm25f").alias("ranker"), "qid", "doc", "score", "rank")
    return kept(a.unionByName(b))


def rrf_one_based(spark, sf):
    return shown(lexical.best(fusion.reciprocal_rank(_two_rankers(spark, sf), 60, 1), K))


def rrf_zero_based(spark, sf):
    return shown(lexical.best(fusion.reciprocal_rank(_two_rankers(spark, sf), 60, 0), K))


def min_max_norm(spark, sf):
    return fusion.min_max(_two_rankers(spark, sf)).select("ranker", "qid", "doc", F.round("norm", 6).alias("norm"))


def comb_sum(spark, sf):
    return shown(lexical.best(fusion.combine(_two_rankers(spark, sf), "sum"), K))


def comb_mnz(spark, sf):
    return shown(lexical.best(fusion.combine(_two_rankers(spark, sf), "mnz"), K))


def comb_anz(spark, sf):
    return shown(lexical.best(fusion.combine(_two_rankers(spark, sf), "anz"), K))


def _rerank(spark, sf, top: DataFrame) -> DataFrame:
    """The first twenty (qid, doc, rank) in the order of their word sets' similarity; ties keep the first order."""
    sets = corpus(spark, sf).select("doc", F.array_distinct(tx.tokens(F.col("text"))).alias("ds"))
    asks = asked(spark, sf).select("qid", F.array_distinct(tx.tokens(F.col("text"))).alias("qs"))
    top = kept(top.select("qid", "doc", "rank"))
    sent = F.broadcast(top) if top.count() <= lexical.BROADCAST_WORDS else top
    both = sets.join(sent, "doc").join(asks, "qid").withColumn("score", tx.jaccard(F.col("qs"), F.col("ds")))
    w = Window.partitionBy("qid").orderBy(F.round("score", 12).desc(), "rank")
    return both.select("qid", "doc", F.row_number().over(w).cast("long").alias("new_rank"), F.round("score", 6).alias("score")).withColumnRenamed("new_rank", "rank")


def jaccard_rerank(spark, sf):
    """The best twenty by BM25+, put in the order of their word sets' similarity; ties keep the first order."""
    return _rerank(spark, sf, lexical.best(_plus(spark, sf, 20)[1], 20))


# over hashed embeddings, whose digest SQL lacks


def _dense(spark, sf, k: int, queries: DataFrame | None = None) -> DataFrame:
    docs = vector.hashed_vectors(corpus(spark, sf).withColumnRenamed("doc", "id"))
    queries = asked(spark, sf) if queries is None else queries
    return vector.top_k(vector.hashed_vectors(queries.withColumnRenamed("qid", "id")), docs, k)


def hash_embed_topk(spark, sf):
    return shown(_dense(spark, sf, K))


def expanded_query_rank(spark, sf):
    """Hashed embeddings, the query in the shape of a likely answer."""
    return shown(_dense(spark, sf, K, asked(spark, sf).select("qid", tx.expanded(F.col("text")).alias("text"))))


def _lexical_and_dense(spark, sf, k: int = 20) -> DataFrame:
    a = lexical.best(_okapi(spark, sf, k), k).select(F.lit("bm25").alias("ranker"), "qid", "doc", "score", "rank")
    b = _dense(spark, sf, k).select(F.lit("dense").alias("ranker"), "qid", "doc", "score", "rank")
    return kept(a.unionByName(b))


def hybrid_topk(spark, sf):
    """Reciprocal ranks of BM25 and of hashed embeddings, counted from 0."""
    return shown(lexical.best(fusion.reciprocal_rank(_lexical_and_dense(spark, sf), 60, 0), K))


def _comb_dense(how):
    def run(spark, sf):
        return shown(lexical.best(fusion.combine(_lexical_and_dense(spark, sf), how), K))

    run.__name__ = f"comb_{how}_dense"
    run.__doc__ = f"BM25 and hashed embeddings, normalised scores combined by {how}."
    return run


comb_sum_dense, comb_mnz_dense, comb_anz_dense = map(_comb_dense, ("sum", "mnz", "anz"))


def dense_rerank(spark, sf):
    """The best twenty by hashed embeddings, put in the order of their word sets' similarity."""
    return _rerank(spark, sf, _dense(spark, sf, 20))


def word_maxsim_topk(spark, sf):
    """Late interaction of the words' hashed embeddings: for each word of a query the best word of the document, summed."""
    return shown(lexical.best(vector.word_maxsim(asked(spark, sf), corpus(spark, sf), k=K), K))


def _ranked20(spark, sf):
    return lexical.best(_plus(spark, sf, 20)[1], 20).select("qid", "doc", "rank")


def budget_pack(spark, sf):
    return packing.pack(_ranked20(spark, sf), corpus(spark, sf), BUDGET).select("qid", "doc", "rank", "cost", "used")


def no_context_pack(spark, sf):
    """The empty control: every query with nothing."""
    return packing.pack_counts(asked(spark, sf), packing.pack(_ranked20(spark, sf).limit(0), corpus(spark, sf), BUDGET))


def pack_summary(spark, sf):
    """How much of the budget each query's ranking takes."""
    return packing.pack_counts(asked(spark, sf), packing.pack(_ranked20(spark, sf), corpus(spark, sf), BUDGET))


def full_context_pack(spark, sf):
    return packing.corpus_prefix(corpus(spark, sf), 20 * BUDGET)


def random_pack(spark, sf):
    return packing.shuffled(corpus(spark, sf), 0, BUDGET).select("doc", "key", "rank", "cost", "used")


def corpus_fingerprints(spark, sf):
    """A digest of each conversation as a corpus, and the key under which a request against it is cached."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    prints = tx.corpus_fingerprint(c, "conv_id", "turn", "turn", "text")
    return prints.select("conv_id", "fingerprint", tx.cache_key(F.col("fingerprint"), F.lit(BUDGET), F.col("conv_id").cast("string")).alias("key"))


FUNCTIONS = (
    tokenize_stats, token_cost, identifier_extract, title_body, request_key, term_postings, doc_freq, collection_stats,
    bm25_plus_topk, bm25_okapi_topk, bm25f_topk, tfidf_topk, qlm_dirichlet_topk, qlm_jm_topk, rm3_expansion, rm3_topk, sparse_expansion_topk,
    rrf_one_based, rrf_zero_based, min_max_norm, comb_sum, comb_mnz, comb_anz, jaccard_rerank, budget_pack, no_context_pack, pack_summary, full_context_pack, random_pack,
    hash_embed_topk, expanded_query_rank, hybrid_topk, comb_sum_dense, comb_mnz_dense, comb_anz_dense, dense_rerank, word_maxsim_topk, corpus_fingerprints,
)

def _sum(x: str) -> str:
    """A sum that doesn't depend on the order of rows."""
    return f"CAST(sum(CAST({x} AS DECIMAL(28,9))) AS DOUBLE)"


_T = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+')"
# identifiers as three extractions, since the pattern's word boundaries know letters of all scripts here: scoped packages and
# calls first, each taken out of the text, then whole words in mixed case
_IDENTIFIERS = r"""list_concat(regexp_extract_all(coalesce({t}, ''), '@[\p{{L}}\p{{N}}_-]+/[\p{{L}}\p{{N}}_-]+'),
  regexp_extract_all(regexp_replace(coalesce({t}, ''), '@[\p{{L}}\p{{N}}_-]+/[\p{{L}}\p{{N}}_-]+', ' ', 'g'), '[A-Za-z][A-Za-z0-9_]*\(\)'),
  list_transform(regexp_extract_all(regexp_replace(coalesce({t}, ''), '@[\p{{L}}\p{{N}}_-]+/[\p{{L}}\p{{N}}_-]+', ' ', 'g'), '[A-Za-z][A-Za-z0-9_]*\(\)'), lambda y: left(y, length(y) - 2)),
  list_filter(regexp_extract_all(regexp_replace(regexp_replace(coalesce({t}, ''), '@[\p{{L}}\p{{N}}_-]+/[\p{{L}}\p{{N}}_-]+', ' ', 'g'), '[A-Za-z][A-Za-z0-9_]*\(\)', ' ', 'g'), '[\p{{L}}\p{{N}}_]+'),
    lambda y: regexp_full_match(y, '[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)+|[a-z]+(?:[A-Z][a-z0-9]*)+')))"""
_W = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}')"
_BASE = f"""
WITH d AS (SELECT doc_id AS doc, text, {_T} AS ws FROM documents),
dl AS (SELECT doc, CAST(len(ws) AS BIGINT) AS dl FROM d),
st AS (SELECT count(*) AS n, CAST(sum(dl) AS DOUBLE) AS total, CAST(sum(dl) AS DOUBLE) / count(*) AS avgdl FROM dl),
p AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(ws) AS term FROM d) GROUP BY doc, term),
df AS (SELECT term, count(*) AS df, CAST(sum(tf) AS DOUBLE) AS cf FROM p GROUP BY term),
q AS (SELECT qid, term, count(*) AS qtf FROM (SELECT item_id AS qid, unnest({_T}) AS term FROM benchmark) GROUP BY qid, term),
m AS (SELECT qid, doc, term, qtf, tf, df, cf, dl FROM q JOIN df USING (term) JOIN p USING (term) JOIN dl USING (doc))"""


def _top(score_cte: str, k: int = K, digits: int = 9) -> str:
    return f"""{score_cte},
r AS (SELECT qid, doc, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, {digits}) DESC, doc) AS BIGINT) AS rank FROM s)
SELECT qid, doc, rank, round(score, 6) AS score FROM r WHERE rank <= {k}"""


_PLUS = f"""(SELECT a.qid, dl.doc, coalesce(score, 0) AS score FROM (SELECT item_id AS qid FROM benchmark) a CROSS JOIN dl LEFT JOIN
  (SELECT qid, doc, {_sum("qtf * ln((n + 1) / df) * (1.0::DOUBLE + 2.5::DOUBLE * tf / (1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl) + tf))")} AS score
  FROM m, st GROUP BY qid, doc) b ON a.qid = b.qid AND dl.doc = b.doc)"""
_FIELDS = f"""
h AS (SELECT doc_id AS doc, regexp_extract_all(lower(split_part(coalesce(text, ''), chr(10), 1)), '[a-z0-9_]+') AS tw,
  regexp_extract_all(lower(CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END), '[a-z0-9_]+') AS bw FROM documents),
hm AS (SELECT avg(len(tw)) AS mt, avg(len(bw)) AS mb FROM h),
hx AS (SELECT doc, term, sum(x) AS x FROM (
  SELECT doc, term, 2.0::DOUBLE * count(*) / (0.25::DOUBLE + 0.75::DOUBLE * n / mt) AS x FROM (SELECT doc, len(tw) AS n, unnest(tw) AS term FROM h), hm GROUP BY doc, term, n, mt
  UNION ALL
  SELECT doc, term, 1.0::DOUBLE * count(*) / (0.25::DOUBLE + 0.75::DOUBLE * n / mb) AS x FROM (SELECT doc, len(bw) AS n, unnest(bw) AS term FROM h), hm GROUP BY doc, term, n, mb) GROUP BY doc, term)"""
_BM25F = f"(SELECT qid, doc, {_sum('ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * x / (1.2::DOUBLE + x)')} AS score FROM q JOIN df USING (term) JOIN hx USING (term), st GROUP BY qid, doc)"
_TWO = _BASE + "," + _FIELDS + f""",
sa AS {_PLUS}, sb AS {_BM25F},
ra AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc) AS rank FROM sa),
rb AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc) AS rank FROM sb),
two AS (SELECT 'bm25_plus' AS ranker, qid, doc, score, rank FROM ra WHERE rank <= 20 UNION ALL SELECT 'bm25f', qid, doc, score, rank FROM rb WHERE rank <= 20),
nm AS (SELECT ranker, qid, doc, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0.0::DOUBLE END AS norm
  FROM two WINDOW w AS (PARTITION BY ranker, qid)),
cb AS (SELECT qid, doc, {_sum("norm")} AS s, count(*) FILTER (norm > 0) AS n FROM nm GROUP BY qid, doc)"""
_QL = ", c AS (SELECT qid, " + _sum("qtf * ln(cf / total)") + " AS lp, sum(qtf) AS ql FROM q JOIN df USING (term), st GROUP BY qid)"
_JM = """(SELECT c.qid, dl.doc, c.lp + c.ql * ln({lam}::DOUBLE) + coalesce(g.gain, 0) AS score FROM c CROSS JOIN dl LEFT JOIN
  (SELECT qid, doc, CAST(sum(CAST(qtf * (ln((1 - {lam}::DOUBLE) * tf / dl + {lam}::DOUBLE * cf / total) - ln({lam}::DOUBLE * cf / total)) AS DECIMAL(28,9))) AS DOUBLE) AS gain FROM m, st GROUP BY qid, doc) g ON g.qid = c.qid AND g.doc = dl.doc)"""

SQL = {
    "tokenize_stats": f"SELECT doc_id AS doc, CAST(len(ws) AS BIGINT) AS n_tokens, CAST(len(list_distinct(ws)) AS BIGINT) AS n_distinct FROM (SELECT doc_id, {_T} AS ws FROM documents)",
    "token_cost": "SELECT doc_id AS doc, CAST(length(coalesce(text, '')) // 4 AS BIGINT) AS cost FROM documents",
    "identifier_extract": rf"""
WITH f AS (SELECT doc_id AS doc, {_IDENTIFIERS.format(t="text")} AS x FROM documents)
SELECT doc, array_to_string(list_sort(list_distinct(x)), '|') AS identifiers FROM f""",
    "no_context_pack": "SELECT item_id AS qid, CAST(0 AS BIGINT) AS n_docs, CAST(0 AS BIGINT) AS tokens FROM benchmark",
    "corpus_fingerprints": f"""
WITH f AS (SELECT conv_id, sha256(unhex(string_agg(hex(encode(CAST(turn AS VARCHAR))) || '00' || hex(encode(coalesce(text, ''))) || '01', '' ORDER BY turn))) AS fingerprint FROM conversations GROUP BY conv_id)
SELECT conv_id, fingerprint, sha256(concat_ws('|', fingerprint, '{BUDGET}', CAST(conv_id AS VARCHAR))) AS key FROM f""",
    "title_body": "SELECT doc_id AS doc, CAST(length(split_part(coalesce(text, ''), chr(10), 1)) AS BIGINT) AS title_chars, CAST(CASE WHEN strpos(text, chr(10)) > 0 THEN length(substr(text, strpos(text, chr(10)) + 1)) ELSE 0 END AS BIGINT) AS body_chars FROM documents",
    "request_key": "SELECT doc_id AS doc, sha256(concat_ws('|', CAST(doc_id AS VARCHAR), text)) AS key FROM documents",
    "term_postings": _BASE + " SELECT doc, term, tf FROM p",
    "doc_freq": _BASE + " SELECT term, df FROM df",
    "collection_stats": _BASE + " SELECT n AS n_docs, CAST(total AS BIGINT) AS n_tokens, round(avgdl, 6) AS avgdl FROM st",
    "bm25_plus_topk": _top(_BASE + f", s AS {_PLUS}"),
    "bm25_okapi_topk": _top(
        _BASE
        + """, i AS (SELECT term, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS idf FROM df, st), fl AS (SELECT 0.25::DOUBLE * avg(idf) AS fl FROM i),
s AS (SELECT qid, doc, """
        + _sum("qtf * CASE WHEN idf < 0 THEN fl ELSE idf END * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))")
        + """ AS score FROM m JOIN i USING (term), st, fl GROUP BY qid, doc)"""
    ),
    "bm25f_topk": _top(_BASE + "," + _FIELDS + f", s AS {_BM25F}"),
    "tfidf_topk": _top(
        f"""
WITH p AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc_id AS doc, unnest({_W}) AS term FROM documents) GROUP BY doc, term),
i AS (SELECT term, ln((1 + n) / (1 + count(*)::DOUBLE)) + 1 AS idf FROM p, (SELECT count(*) AS n FROM documents) GROUP BY term, n),
q AS (SELECT qid, term, count(*) * idf AS w, idf FROM (SELECT item_id AS qid, unnest({_W}) AS term FROM benchmark) JOIN i USING (term) GROUP BY qid, term, idf),
qn AS (SELECT qid, sqrt({_sum("w * w")}) AS qnorm FROM q GROUP BY qid),
dn AS (SELECT doc, sqrt({_sum("(tf * idf) * (tf * idf)")}) AS norm FROM p JOIN i USING (term) GROUP BY doc),
s AS (SELECT qid, doc, {_sum("w / qnorm * tf * p_idf")} / norm AS score FROM (SELECT q.qid, p.doc, q.w, p.tf, q.idf AS p_idf FROM q JOIN p USING (term)) JOIN qn USING (qid) JOIN dn USING (doc) GROUP BY qid, doc, norm)"""
    ),
    "qlm_dirichlet_topk": _top(
        _BASE
        + _QL
        + """, s AS (SELECT c.qid, dl.doc, c.lp + c.ql * (ln(2000.0::DOUBLE) - ln(dl.dl + 2000.0::DOUBLE)) + coalesce(g.gain, 0) AS score FROM c CROSS JOIN dl LEFT JOIN
  (SELECT qid, doc, CAST(sum(CAST(qtf * (ln(tf + 2000.0::DOUBLE * cf / total) - ln(2000.0::DOUBLE * cf / total)) AS DECIMAL(28,9))) AS DOUBLE) AS gain FROM m, st GROUP BY qid, doc) g ON g.qid = c.qid AND g.doc = dl.doc)"""
    ),
    "qlm_jm_topk": _top(_BASE + _QL + ", s AS " + _JM.format(lam="0.1")),
    "rm3_expansion": _BASE
    + _QL
    + ", s AS "
    + _JM.format(lam="0.5")
    + """,
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc) AS r FROM s) WHERE r <= 10),
e AS (SELECT qid, doc, exp(score - max(score) OVER (PARTITION BY qid)) AS e FROM t), po AS (SELECT qid, doc, e / CAST(sum(CAST(e AS DECIMAL(28,9))) OVER (PARTITION BY qid) AS DOUBLE) AS post FROM e),
rm AS (SELECT qid, term, CAST(sum(CAST(1e6 * post * tf / dl AS DECIMAL(28,9))) AS DOUBLE) AS w FROM po JOIN p USING (doc) JOIN dl USING (doc) GROUP BY qid, term),
rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(w, 6) DESC, term) AS r FROM rm) WHERE r <= 10),
u AS (SELECT qid, term, 0.5::DOUBLE * (w / CAST(sum(CAST(w AS DECIMAL(28,9))) OVER (PARTITION BY qid) AS DOUBLE)) AS w FROM rk UNION ALL SELECT qid, term, 0.5::DOUBLE * qtf / sum(qtf) OVER (PARTITION BY qid) FROM q)
SELECT qid, term, round(sum(w), 9) AS weight FROM u GROUP BY qid, term""",
    "rm3_topk": _top(
        _BASE
        + _QL
        + ", s0 AS "
        + _JM.format(lam="0.5")
        + """,
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc) AS r FROM s0) WHERE r <= 10),
e AS (SELECT qid, doc, exp(score - max(score) OVER (PARTITION BY qid)) AS e FROM t), po AS (SELECT qid, doc, e / CAST(sum(CAST(e AS DECIMAL(28,9))) OVER (PARTITION BY qid) AS DOUBLE) AS post FROM e),
rm AS (SELECT qid, term, CAST(sum(CAST(1e6 * post * tf / dl AS DECIMAL(28,9))) AS DOUBLE) AS w FROM po JOIN p USING (doc) JOIN dl USING (doc) GROUP BY qid, term),
rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(w, 6) DESC, term) AS r FROM rm) WHERE r <= 10),
u AS (SELECT qid, term, 0.5::DOUBLE * (w / CAST(sum(CAST(w AS DECIMAL(28,9))) OVER (PARTITION BY qid) AS DOUBLE)) AS w FROM rk UNION ALL SELECT qid, term, 0.5::DOUBLE * qtf / sum(qtf) OVER (PARTITION BY qid) FROM q),
x AS (SELECT qid, term, sum(w) AS w FROM u GROUP BY qid, term),
xc AS (SELECT qid, CAST(sum(CAST(w * ln(cf / total) AS DECIMAL(28,9))) AS DOUBLE) + CAST(sum(CAST(w AS DECIMAL(28,9))) AS DOUBLE) * ln(0.5::DOUBLE) AS base FROM x JOIN df USING (term), st GROUP BY qid),
xg AS (SELECT qid, doc, CAST(sum(CAST(w * (ln(0.5::DOUBLE * tf / dl + 0.5::DOUBLE * cf / total) - ln(0.5::DOUBLE * cf / total)) AS DECIMAL(28,9))) AS DOUBLE) AS gain FROM x JOIN df USING (term) JOIN p USING (term) JOIN dl USING (doc), st GROUP BY qid, doc),
s AS (SELECT xc.qid, dl.doc, base + coalesce(gain, 0) AS score FROM xc CROSS JOIN dl LEFT JOIN xg ON xg.qid = xc.qid AND xg.doc = dl.doc)"""
    ),
    "sparse_expansion_topk": _top(
        _BASE
        + """, qb AS (SELECT qid, term, ln(1 + qtf) AS w FROM q),
co AS (SELECT a.term AS t, b.term AS u, count(*) AS c FROM p a JOIN p b USING (doc) WHERE a.term <> b.term AND a.term IN (SELECT term FROM q) GROUP BY 1, 2),
wi AS (SELECT qid, u AS term, 0.5::DOUBLE * CAST(sum(CAST(w * (c / df) AS DECIMAL(28,9))) AS DOUBLE) AS w FROM qb JOIN co ON qb.term = co.t JOIN df ON df.term = co.t GROUP BY qid, u),
qq AS (SELECT * FROM qb UNION ALL SELECT * FROM wi WHERE NOT EXISTS (SELECT 1 FROM qb WHERE qb.qid = wi.qid AND qb.term = wi.term)),
pw AS (SELECT doc, term, ln(1 + tf) AS w, ln(1 + tf) / df AS a, df FROM p JOIN df USING (term)),
su AS (SELECT qid, doc, """
        + _sum("qq.w * pw.w")
        + " AS literal, "
        + _sum("2 * qq.w")
        + """ AS g FROM qq JOIN pw USING (term) GROUP BY qid, doc),
hh AS (SELECT qid, term, """
        + _sum("g")
        + """ AS h FROM su JOIN p USING (doc) GROUP BY qid, term),
fa AS (SELECT qid, doc, """
        + _sum("a * h")
        + """ AS far FROM hh JOIN pw USING (term) GROUP BY qid, doc),
bb AS (SELECT x.term AS t, y.term AS u, count(*) AS c FROM pw x JOIN pw y USING (doc) WHERE x.term < y.term AND x.df > 1 AND y.df > 1 GROUP BY 1, 2),
pr AS (SELECT x.doc, x.term AS t, y.term AS u, x.a AS xa, y.a AS ya, CASE WHEN x.df > 1 AND y.df > 1 THEN c ELSE 1 END AS c FROM pw x JOIN pw y ON x.doc = y.doc AND x.term < y.term LEFT JOIN bb ON bb.t = x.term AND bb.u = y.term),
rr AS (SELECT doc, term, """
        + _sum("x")
        + """ AS r FROM (SELECT doc, u AS term, xa * c AS x FROM pr UNION ALL SELECT doc, t, ya * c FROM pr UNION ALL SELECT doc, term, w FROM pw) GROUP BY doc, term),
ne AS (SELECT qid, doc, """
        + _sum("w * r")
        + """ AS near FROM qq JOIN rr USING (term) GROUP BY qid, doc),
s AS (SELECT qid, doc, coalesce(literal, 0) + 0.5::DOUBLE * (far / 2 - coalesce(near, 0)) AS score FROM fa LEFT JOIN su USING (qid, doc) LEFT JOIN ne USING (qid, doc))""",
    ),
    "rrf_one_based": _top(_TWO + ", s AS (SELECT qid, doc, CAST(sum(CAST(1e6 / (60 + rank) AS DECIMAL(28,9))) AS DOUBLE) / 1e6 AS score FROM two GROUP BY qid, doc)"),
    "rrf_zero_based": _top(_TWO + ", s AS (SELECT qid, doc, CAST(sum(CAST(1e6 / (59 + rank) AS DECIMAL(28,9))) AS DOUBLE) / 1e6 AS score FROM two GROUP BY qid, doc)"),
    "min_max_norm": _TWO + " SELECT ranker, qid, doc, round(norm, 6) AS norm FROM nm",
    "comb_sum": _top(_TWO + ", s AS (SELECT qid, doc, s AS score FROM cb)"),
    "comb_mnz": _top(_TWO + ", s AS (SELECT qid, doc, s * n AS score FROM cb)"),
    "comb_anz": _top(_TWO + ", s AS (SELECT qid, doc, CASE WHEN n > 0 THEN s / n ELSE 0 END AS score FROM cb)"),
    "jaccard_rerank": _BASE
    + f""", s AS {_PLUS}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc) AS rank FROM s) WHERE rank <= 20),
qs AS (SELECT qid, count(*) AS n FROM q GROUP BY qid), ds AS (SELECT doc, count(*) AS n FROM p GROUP BY doc),
ov AS (SELECT qid, doc, count(*) AS both FROM q JOIN p USING (term) GROUP BY qid, doc),
j AS (SELECT t.qid, t.doc, t.rank AS r0, coalesce(ov.both, 0)::DOUBLE / (qs.n + ds.n - coalesce(ov.both, 0)) AS score FROM t JOIN qs USING (qid) JOIN ds USING (doc) LEFT JOIN ov ON ov.qid = t.qid AND ov.doc = t.doc)
SELECT qid, doc, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, r0) AS BIGINT) AS rank, round(score, 6) AS score FROM j""",
    "budget_pack": _BASE
    + f""", s AS {_PLUS}, t AS (SELECT qid, doc, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc) AS rank FROM s),
u AS (SELECT t.qid, t.doc, CAST(t.rank AS BIGINT) AS rank, CAST(length(coalesce(d.text, '')) // 4 AS BIGINT) AS cost FROM t JOIN d USING (doc) WHERE t.rank <= 20),
v AS (SELECT *, CAST(sum(cost) OVER (PARTITION BY qid ORDER BY rank) AS BIGINT) AS used FROM u)
SELECT qid, doc, rank, cost, used FROM v WHERE used <= {BUDGET}""",
    "pack_summary": _BASE
    + f""", s AS {_PLUS}, t AS (SELECT qid, doc, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc) AS rank FROM s),
u AS (SELECT t.qid, t.rank, length(coalesce(d.text, '')) // 4 AS cost FROM t JOIN d USING (doc) WHERE t.rank <= 20),
v AS (SELECT *, sum(cost) OVER (PARTITION BY qid ORDER BY rank) AS used FROM u)
SELECT item_id AS qid, count(v.qid) AS n_docs, CAST(coalesce(max(used), 0) AS BIGINT) AS tokens FROM benchmark LEFT JOIN v ON v.qid = item_id AND used <= {BUDGET} GROUP BY item_id""",
    "random_pack": f"""
SELECT * FROM (SELECT doc_id AS doc, md5('0/' || doc_id) AS key, CAST(row_number() OVER (ORDER BY md5('0/' || doc_id), doc_id) AS BIGINT) AS rank, CAST(length(coalesce(text, '')) // 4 AS BIGINT) AS cost,
  CAST(sum(length(coalesce(text, '')) // 4) OVER (ORDER BY md5('0/' || doc_id), doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM documents) WHERE used <= {BUDGET}""",
    "full_context_pack": f"""
SELECT * FROM (SELECT doc_id AS doc, CAST(row_number() OVER (ORDER BY doc_id) AS BIGINT) AS rank, CAST(length(coalesce(text, '')) // 4 AS BIGINT) AS cost,
  CAST(sum(length(coalesce(text, '')) // 4) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM documents) WHERE used <= {20 * BUDGET}""",
}

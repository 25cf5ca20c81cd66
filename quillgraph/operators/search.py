"""Search and entity resolution against a table of terms (id, name, synonyms).

A set of queries is (query_id, query); every result is ranked per query with the
term id as the last tie-break.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import constants as K
from quillgraph.functions import similarity as S
from quillgraph.functions.text import index_text, term_variants, token_set
from quillgraph.operators.contains import contains_join, top_per_key
from quillgraph.session import Scratch

#: Queries per broadcast block of the vector search.
VECTOR_BLOCK = 4096


def scored_search(queries: DataFrame, terms: DataFrame, top: int = 5) -> DataFrame:
    """``query_id, id, score, rank``: terms whose name or synonym equals, contains or is contained in the query.

    Name equal 1.0, query in name 0.8, name in query 0.7; below 0.8 a synonym
    that equals gives 0.95 and one that contains 0.75.  Case does not matter.
    """
    q = queries.select("query_id", F.lower(F.trim("query")).alias("q")).where("q <> ''")
    t = terms.select("id", F.lower("name").alias("name")).where("name <> ''")
    syn = terms.select("id", F.explode("synonyms").alias("syn")).select("id", F.lower("syn").alias("syn")).where("syn <> ''")
    uq = q.select("q").distinct()
    inside = contains_join(uq, "q", t, "name").select("q", "id", F.when(F.col("q") == F.col("name"), 1.0).otherwise(0.8).alias("by_name"), F.lit(0.0).alias("by_syn"))
    around = contains_join(t, "name", uq, "q").where("q <> name").select("q", "id", F.lit(0.7).alias("by_name"), F.lit(0.0).alias("by_syn"))
    alias = contains_join(uq, "q", syn, "syn").select("q", "id", F.lit(0.0).alias("by_name"), F.when(F.col("q") == F.col("syn"), 0.95).otherwise(0.75).alias("by_syn"))
    best = inside.unionByName(around).unionByName(alias).groupBy("q", "id").agg(F.max("by_name").alias("n"), F.max("by_syn").alias("s"))
    scored = best.select("q", "id", F.when(F.col("n") >= 0.8, F.col("n")).otherwise(F.greatest("n", "s")).alias("score")).where("score > 0.6")
    ranked = top_per_key(scored, ["q"], [F.desc("score"), F.col("id")], top)
    return q.join(ranked, "q").select("query_id", "id", "score", "rank")


def all_terms(terms: DataFrame) -> DataFrame:
    """``id, term``: index form of name, synonyms, their variants and the id; distinct."""
    raw = terms.select("id", F.explode(F.concat(F.array("name"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("t")).where("t is not null and trim(t) <> ''")
    every = raw.union(raw.select("id", F.explode(term_variants(F.col("t"))))).union(terms.select("id", F.col("id").alias("t")))
    return every.select("id", index_text(F.col("t")).alias("term")).where("term <> ''").distinct()


def term_index(terms: DataFrame, shortest: int = 3, longest: int = 7) -> DataFrame:
    """``kind, key, id``: exact forms, words longer than two letters, prefixes and suffixes of every term."""
    t = all_terms(terms)
    exact = t.select(F.lit("exact").alias("kind"), F.col("term").alias("key"), "id")
    words = t.select(F.lit("word").alias("kind"), F.explode(F.split("term", " ")).alias("key"), "id").where(F.length("key") > 2)
    fits = t.where(F.length("term") >= shortest).withColumn("k", F.explode(F.sequence(F.lit(shortest), F.least(F.length("term"), F.lit(longest)))))
    pre = fits.select(F.lit("prefix").alias("kind"), F.substring(F.col("term"), F.lit(1), F.col("k")).alias("key"), "id")
    suf = fits.select(F.lit("suffix").alias("kind"), F.substring(F.col("term"), F.length("term") - F.col("k") + 1, F.col("k")).alias("key"), "id")
    return exact.union(words).union(pre).union(suf).distinct()


def exact_matches(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """``query_id, id, confidence``: terms with an exact form equal to the query's index form."""
    q = queries.select("query_id", index_text(F.col("query")).alias("term")).where("term <> ''")
    return q.join(all_terms(terms), "term").select("query_id", "id", F.lit(1.0).alias("confidence")).distinct()


def word_matches(queries: DataFrame, terms: DataFrame, least: float = 0.4, synonyms: int = 3) -> DataFrame:
    """``query_id, id, confidence``: best word Jaccard of the query with name and first synonyms, above ``least``."""
    words = lambda c: F.array_distinct(F.filter(F.split(index_text(c), " "), lambda w: F.length(w) > 0))
    q = queries.select("query_id", words(F.col("query")).alias("qw")).where(F.size("qw") > 0)
    names = terms.select("id", F.explode(F.concat(F.array("name"), F.slice(F.coalesce("synonyms", F.array().cast("array<string>")), 1, synonyms))).alias("t")).where("t is not null")
    n = names.select("id", words(F.col("t")).alias("tw")).where(F.size("tw") > 0).distinct()
    shared = q.select("query_id", "qw", F.explode("qw").alias("w")).where(F.length("w") > 2).join(n.select("id", "tw", F.explode("tw").alias("w")), "w").select("query_id", "id", "qw", "tw").distinct()
    score = F.size(F.array_intersect("qw", "tw")) / F.size(F.array_union("qw", "tw"))
    return shared.select("query_id", "id", score.alias("confidence")).where(F.col("confidence") > least).groupBy("query_id", "id").agg(F.max("confidence").alias("confidence"))


def partial_matches(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """``query_id, id, confidence``: longest shared prefix (share of the query times 0.6) or suffix (times 0.5) of 3 to 7 characters."""
    q = queries.select("query_id", index_text(F.col("query")).alias("q")).where(F.length("q") >= 3)
    k = F.explode(F.sequence(F.lit(3), F.least(F.length("q"), F.lit(7))))
    cuts = q.select("query_id", "q", k.alias("k"))
    keys = cuts.select("query_id", F.lit("prefix").alias("kind"), F.substring(F.col("q"), F.lit(1), F.col("k")).alias("key"), (F.col("k") / F.length("q") * 0.6).alias("confidence")).union(
        cuts.select("query_id", F.lit("suffix").alias("kind"), F.substring(F.col("q"), F.length("q") - F.col("k") + 1, F.col("k")).alias("key"), (F.col("k") / F.length("q") * 0.5).alias("confidence")))
    index = term_index(terms).where("kind in ('prefix', 'suffix')")
    return keys.join(index, ["kind", "key"]).groupBy("query_id", "id").agg(F.max("confidence").alias("confidence"))


def abbreviation_matches(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """``query_id, id, confidence``: the query is an upper-case form in the list (0.9) or its initials are (0.8)."""
    up = terms.select("id", F.explode(F.concat(F.array("name"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("a")).where(F.col("a").rlike("^[A-Z][A-Z0-9]+$"))
    words = F.filter(F.split(F.trim("query"), "[^A-Za-z]+"), lambda w: w != "")
    q = queries.select("query_id", F.trim("query").alias("a"), F.lit(0.9).alias("confidence")).union(
        queries.where(F.size(words) > 1).select("query_id", F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")), F.lit(0.8)))
    return q.join(up, "a").groupBy("query_id", "id").agg(F.max("confidence").alias("confidence"))


#: Queries that one pass of the exact fuzzy search compares with every term.
FUZZY_BLOCK = 2_000


def _fuzzy_block(texts: list[str], least: float):
    """Terms (id, term) against a block of queries: character counts rule out almost all pairs, the rest is scored."""
    letters = {c: k for k, c in enumerate(sorted(set("".join(texts))))}

    def counts(text: str) -> np.ndarray:
        return np.bincount([letters[c] for c in text if c in letters], minlength=len(letters) or 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = np.stack([counts(t) for t in texts]).astype(np.int16)
        size = np.array([len(t) for t in texts])
        for b in batches:
            rows = []
            for ident, term in zip(b["id"], b["term"], strict=True):
                shared = np.minimum(own, counts(term).astype(np.int16)).sum(1)
                few, many = np.minimum(size, len(term)), np.maximum(size, len(term))
                # no ratio is above the one of the common characters, no window ratio above the part of the shorter text they make up
                whole = 2 * shared / (size + len(term))
                window = np.where(many < 1.5 * few, 0.0, np.where(many <= 8 * few, 0.9, 0.6) * shared / few)
                for k in np.flatnonzero(np.maximum(whole, window) >= least - 1e-9).tolist():
                    score = S.weighted(texts[k], term, least)
                    if score >= least:
                        rows.append((texts[k], ident, score))
            yield pd.DataFrame(rows, columns=["q", "id", "confidence"])

    return run


def fuzzy_matches(queries: DataFrame, terms: DataFrame, least: float = 0.85, top: int = 10, exact: bool = True) -> DataFrame:
    """``query_id, id, confidence``: the ``top`` terms with a weighted ratio of at least ``least``.

    By default the query set goes in blocks against every term, with the result of
    comparing all.  ``exact=False`` compares only terms that share the first or last
    three characters or a word with the query, which can miss some.
    """
    if exact:
        q = queries.select("query_id", index_text(F.col("query")).alias("q")).where("q <> ''")
        texts = sorted(r[0] for r in q.select("q").distinct().collect())  # the query set
        spark = queries.sparkSession
        # comparing is the work here, however small the table of terms
        t = all_terms(terms).repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        kind = dict(t.dtypes)["id"]
        found = None
        for k in range(0, len(texts), FUZZY_BLOCK):
            part = t.select("id", "term").mapInPandas(_fuzzy_block(texts[k:k + FUZZY_BLOCK], least), f"q string, id {kind}, confidence double")
            found = part if found is None else found.unionByName(part)
        if found is None:
            found = spark.createDataFrame([], f"q string, id {kind}, confidence double")
        best = found.groupBy("q", "id").agg(F.max("confidence").alias("confidence"))
        return q.join(top_per_key(best, ["q"], [F.desc("confidence"), F.col("id")], top), "q").select("query_id", "id", "confidence")
    q = queries.select("query_id", index_text(F.col("query")).alias("q")).where("q <> ''")
    t = all_terms(terms)
    keys = lambda c: F.array_distinct(F.concat(F.filter(F.split(c, " "), lambda w: F.length(w) > 2), F.array(F.concat(F.lit("<"), F.substring(c, 1, 3)), F.concat(F.lit(">"), F.right(c, F.lit(3))))))
    uq = q.select("q").distinct().select("q", F.explode(keys(F.col("q"))).alias("k"))
    pairs = uq.join(t.select("id", "term", F.explode(keys(F.col("term"))).alias("k")), "k").select("q", "id", "term").distinct()
    size = F.least(F.length("q"), F.length("term")) / F.greatest(F.length("q"), F.length("term"))
    # lossless: a ratio of r needs an edit distance of at most (1 - r) times both lengths; sorted tokens weigh 0.95
    both = F.length("q") + F.length("term")
    ordered = lambda c: F.array_join(F.array_sort(F.split(c, " ")), " ")
    close = (F.levenshtein("q", "term") <= (1 - least) * both) | (F.levenshtein(ordered("q"), ordered("term")) <= (1 - least / 0.95) * both)
    near = pairs.where(F.when(size > 1 / 1.5, close).otherwise(size > 0.5)).withColumn("confidence", S.weighted_above(least)("q", "term")).where(F.col("confidence") >= least)
    best = near.groupBy("q", "id").agg(F.max("confidence").alias("confidence"))
    return q.join(top_per_key(best, ["q"], [F.desc("confidence"), F.col("id")], top), "q").select("query_id", "id", "confidence")


def mapping_cascade(queries: DataFrame, terms: DataFrame, enough: int = 3, least: float = 0.5, top: int = 5, fuzzy: bool = False) -> DataFrame:
    """``query_id, id, confidence, rank``: exact, then (where fewer than ``enough`` candidates) fuzzy and word overlap; abbreviations always; partial where still few.

    Of several hits on a term the best counts; only confidences above ``least``; the best ``top`` per query.
    """
    scratch = Scratch(queries.sparkSession, "cascade")
    q = scratch.keep(queries.select("query_id", "query"))
    few = lambda c: q.join(c.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= enough), "query_id", "left_anti")
    found = scratch.keep(exact_matches(q, terms))
    if fuzzy:
        found = scratch.keep(found.unionByName(fuzzy_matches(few(found), terms)))
    found = scratch.keep(found.unionByName(word_matches(few(found), terms)))
    found = scratch.keep(found.unionByName(abbreviation_matches(q, terms)))
    found = found.unionByName(partial_matches(few(found), terms))
    best = found.groupBy("query_id", "id").agg(F.max("confidence").alias("confidence")).where(F.col("confidence") > least)
    return top_per_key(best, ["query_id"], [F.desc("confidence"), F.col("id")], top)


def token_jaccard(queries: DataFrame, texts: DataFrame, top: int = 5) -> DataFrame:
    """``query_id, id, similarity, rank``: token-set Jaccard above zero, best ``top`` per query; ``texts`` is (id, text)."""
    q = queries.select("query_id", token_set(F.col("query")).alias("qt")).where(F.size("qt") > 0)
    t = texts.select("id", token_set(F.col("text")).alias("tt")).where(F.size("tt") > 0)
    shared = q.select("query_id", F.size("qt").alias("nq"), F.explode("qt").alias("w")).join(t.select("id", F.size("tt").alias("nt"), F.explode("tt").alias("w")), "w")
    s = shared.groupBy("query_id", "id", "nq", "nt").agg(F.count("*").alias("i")).select("query_id", "id", (F.col("i") / (F.col("nq") + F.col("nt") - F.col("i"))).alias("similarity"))
    return top_per_key(s, ["query_id"], [F.desc("similarity"), F.col("id")], top)


def cosine_topk(queries: DataFrame, vectors: DataFrame, top: int = 10) -> DataFrame:
    """``query_id, id, similarity, rank``: nearest vectors by cosine.

    Queries travel in blocks of fixed size; every batch of vectors is compared by
    one matrix product and keeps its own best ``top`` per query, so only
    ``top`` rows per query and batch are shuffled.  Zero vectors have similarity 0.
    """
    n = queries.count()
    out = None
    for k in range(max(1, -(-n // VECTOR_BLOCK))):
        blocks = max(1, -(-n // VECTOR_BLOCK))
        rows = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k).select("query_id", "vector").collect()
        if not rows:
            continue
        ids = np.array([r.query_id for r in rows])
        q = np.array([r.vector for r in rows], dtype=np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-8)

        def best(batches: Iterator[pd.DataFrame], ids=ids, q=q) -> Iterator[pd.DataFrame]:
            for b in batches:
                if b.empty:
                    continue
                v = np.stack(b["vector"].to_numpy()).astype(np.float64)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-8)
                own = b["id"].to_numpy()
                s = np.round(q @ v.T, 9)
                order = np.lexsort((np.broadcast_to(own, s.shape), -s), axis=1)[:, :top]
                yield pd.DataFrame({"query_id": np.repeat(ids, order.shape[1]), "id": own[order].ravel(), "similarity": np.take_along_axis(s, order, 1).ravel()})

        part = vectors.select("id", "vector").where("vector is not null").mapInPandas(best, "query_id bigint, id bigint, similarity double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], "query_id bigint, id bigint, similarity double")
    return top_per_key(out, ["query_id"], [F.desc("similarity"), F.col("id")], top)


def tfidf_terms(texts: DataFrame, features: int = 1000) -> tuple[DataFrame, DataFrame]:
    """``(id, term, weight)`` of L2-normalised TF-IDF vectors and ``(term, idf)`` of the vocabulary.

    Terms are single words of two or more letters and pairs of neighbours without
    stop words; the vocabulary has the ``features`` most frequent ones (ties by term).
    """
    stop = F.array(*map(F.lit, K.STOP_WORDS))
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{2,}"), F.lit(0)), lambda w: ~F.array_contains(stop, w))
    w = texts.select("id", words.alias("w"))
    pairs = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1)))).otherwise(F.array().cast("array<string>"))
    tf = w.select("id", F.explode(F.concat("w", pairs)).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    n = texts.select(F.count("*").alias("n_docs"))
    vocab = tf.groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df")).orderBy(F.desc("total"), "term").limit(features)
    idf = vocab.join(F.broadcast(n)).select("term", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = tf.join(F.broadcast(idf), "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("x"))  # at most ``features`` rows
    norm = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("len"))
    return raw.join(norm, "id").select("id", "term", (F.col("x") / F.col("len")).alias("weight")), idf


def tfidf_topk(queries: DataFrame, texts: DataFrame, least: float = 0.3, top: int = 10, features: int = 1000) -> DataFrame:
    """``query_id, id, similarity, rank``: TF-IDF cosine above ``least``; the vocabulary and weights come from ``texts``."""
    weights, idf = tfidf_terms(texts, features)
    stop = F.array(*map(F.lit, K.STOP_WORDS))
    words = F.filter(F.regexp_extract_all(F.lower("query"), F.lit("[a-z0-9]{2,}"), F.lit(0)), lambda w: ~F.array_contains(stop, w))
    q = queries.select("query_id", words.alias("w"))
    pairs = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1)))).otherwise(F.array().cast("array<string>"))
    qt = q.select("query_id", F.explode(F.concat("w", pairs)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("tf")).join(F.broadcast(idf), "term").select(
        "query_id", "term", (F.col("tf") * F.col("idf")).alias("x"))
    qn = qt.groupBy("query_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("len"))
    qt = qt.join(qn, "query_id").select("query_id", "term", (F.col("x") / F.col("len")).alias("qx"))
    s = qt.join(weights, "term").groupBy("query_id", "id").agg(F.round(F.sum(F.col("qx") * F.col("weight")), 9).alias("similarity")).where(F.col("similarity") > least)
    return top_per_key(s, ["query_id"], [F.desc("similarity"), F.col("id")], top)


def best_synonym(queries: DataFrame, terms: DataFrame, pairs: DataFrame, synonyms: int = 5) -> DataFrame:
    """``query_id, id, synonym, similarity``: of each (query, term) pair the synonym (among the first five, or the name) most similar to the query."""
    cand = terms.select("id", F.explode(F.array_distinct(F.concat(F.slice(F.coalesce("synonyms", F.array().cast("array<string>")), 1, synonyms), F.array("name")))).alias("synonym")).where("synonym is not null")
    p = pairs.select("query_id", "id").join(queries.select("query_id", "query"), "query_id").join(cand, "id").withColumn("similarity", S.composite_udf("query", "synonym"))
    best = p.groupBy("query_id", "id").agg(F.max(F.struct("similarity", "synonym")).alias("b"))
    return best.select("query_id", "id", "b.synonym", "b.similarity")


def enriched_text(docs: DataFrame, mentions: DataFrame, context: DataFrame, most: int = 8) -> DataFrame:
    """``doc_id, text``: the text followed by up to ``most`` distinct context sentences of the terms it mentions.

    ``mentions``: (doc_id, id); ``context``: (id, context array).
    """
    lines = mentions.join(context, "id").select("doc_id", "id", F.posexplode("context").alias("k", "s"))
    first = lines.groupBy("doc_id", "s").agg(F.min(F.struct("id", "k")).alias("o"))
    few = top_per_key(first, ["doc_id"], [F.col("o"), F.col("s")], most)
    joined = few.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "s"))), lambda x: x["s"]), " ; ").alias("c"))
    return docs.join(joined, "doc_id", "left").select("doc_id", F.when(F.col("c").isNull(), F.col("text")).otherwise(F.concat("text", F.lit(" [ONTO] "), "c")).alias("text"))


def similarity_column(a: Column, b: Column) -> Column:
    return S.composite_udf(a, b)

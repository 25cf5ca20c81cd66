"""Queries of the training-data operators and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---------------------------------------------------------------- 1 terms

def _terms(spark: SparkSession, sf: str) -> DataFrame:
    from quillgraph.llm.term_frequency import term_frequencies

    return term_frequencies([("action", _t(spark, sf, "relations"), "action", "pmid"),
                             ("predicate", _t(spark, sf, "extracted_relationship"), "predicate", "document_id")])


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _terms(spark, sf).where("mark is not null").select("field", "term", "mark")


def p1_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    return _terms(spark, sf)


_TERMS = r"""
WITH v AS (
  SELECT 'action' AS field, trim(regexp_replace(lower(action), '[^\p{L}\p{N}]+', ' ', 'g')) AS term, pmid AS doc FROM relations
  UNION ALL
  SELECT 'predicate', trim(regexp_replace(lower(predicate), '[^\p{L}\p{N}]+', ' ', 'g')), document_id FROM extracted_relationship),
w AS (SELECT * FROM v WHERE term IS NOT NULL AND term <> ''),
d AS (SELECT field, count(DISTINCT doc) AS docs FROM w GROUP BY field),
c AS (SELECT field, term, count(*) AS n_rows, count(DISTINCT doc) AS n_docs FROM w GROUP BY field, term),
m AS (SELECT c.*, CASE WHEN n_docs <= 2 THEN 'rare' WHEN n_docs > 0.05 * docs THEN 'common' END AS mark FROM c JOIN d USING (field))
"""


# ---------------------------------------------------------------- 2 copies

def _relation_key():
    from quillgraph.llm.format_dedup import canonical_key

    return canonical_key(["negation"], ["subject", "action", "object"])


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    from quillgraph.llm.format_dedup import copies

    return copies(_t(spark, sf, "relations"), "rel_id", _relation_key())


def p2_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    from quillgraph.llm.format_dedup import collapse

    return collapse(_t(spark, sf, "relations"), "rel_id", _relation_key())


_COPIES = r"""
WITH b AS (
  SELECT rel_id, negation, [regexp_replace(replace(lower(x), 'ς', 'σ'), '[^\p{L}\p{N}]+', '', 'g') FOR x IN [subject, action, object]] AS v
  FROM relations WHERE negation IS NOT NULL AND subject IS NOT NULL AND action IS NOT NULL AND object IS NOT NULL),
k AS (SELECT rel_id, negation, list_sort(v) AS v FROM b WHERE NOT list_contains(v, '')),
g AS (SELECT rel_id, min(rel_id) OVER (PARTITION BY negation, v) AS first_id FROM k)
"""

QUERIES = {
    "p1_found": p1_found, "p1_frequencies": p1_frequencies,
    "p2_found": p2_found, "p2_collapsed": p2_collapsed,
}
ORACLES = {
    "p1_found": _TERMS + "SELECT field, term, mark FROM m WHERE mark IS NOT NULL",
    "p1_frequencies": _TERMS + "SELECT field, term, n_rows, n_docs, mark FROM m",
    "p2_found": _COPIES + "SELECT first_id, rel_id AS copy_id FROM g WHERE first_id <> rel_id",
    "p2_collapsed": _COPIES + "SELECT first_id, count(*) AS n_copies FROM g GROUP BY first_id",
}


# ---------------------------------------------------------------- 3 sentences, 4 pieces

def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    from quillgraph.llm.sentences import split_sentences

    return split_sentences(_t(spark, sf, "verifier_state"), "state_id", "original_text", "lang").select("state_id", "sent_start", "sent_end").distinct()


def p3_sentences(spark: SparkSession, sf: str) -> DataFrame:
    from quillgraph.llm.sentences import split_sentences

    return split_sentences(_t(spark, sf, "verifier_state"), "state_id", "original_text", "lang")


def _pieces(spark: SparkSession, sf: str) -> DataFrame:
    from quillgraph.llm.splitting import split_oversized

    return split_oversized(_t(spark, sf, "verifier_state"), "state_id", "original_text", lang_col="lang")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _pieces(spark, sf).where("piece_no = 0").select("state_id", "cut_level").distinct()


def p4_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return _pieces(spark, sf)


def p4_checked(spark: SparkSession, sf: str) -> DataFrame:
    """For every text that is cut: its characters but blanks, those the pieces hold, and how many pieces break the limit, the overlap or the order."""
    p = _pieces(spark, sf).select("state_id", "piece_no", "piece_start", "piece_end", "piece").distinct()
    w = Window.partitionBy("state_id").orderBy("piece_no")
    p = p.withColumns({"was": F.coalesce(F.lag("piece_end").over(w), F.lit(0)), "before": F.lag("piece_start").over(w)})
    text = _t(spark, sf, "verifier_state").select("state_id", "original_text").distinct()
    solid = lambda c: F.length(F.regexp_replace(c, r"\s+", "")).cast("long")
    own = F.substring("piece", F.greatest(F.col("was") - F.col("piece_start"), F.lit(0)).cast("int") + 1, 1_000_000_000)
    bad = (F.length("piece") > 1000) | (F.col("was") - F.col("piece_start") > 100) & (F.col("piece_no") > 0) | (F.col("piece_start") <= F.col("before")) | (F.col("piece_end") <= F.col("was"))
    got = p.groupBy("state_id").agg(F.sum(solid(own)).alias("held"), F.count_if(bad).alias("n_bad"))
    return text.where(F.length("original_text") > 1000).join(got, "state_id", "left").select("state_id", solid(F.col("original_text")).alias("solid"), "held", "n_bad")


QUERIES |= {"p3_found": p3_found, "p3_sentences": p3_sentences, "p4_found": p4_found, "p4_pieces": p4_pieces, "p4_checked": p4_checked}
ORACLES |= {"p4_checked": r"""SELECT DISTINCT state_id, length(regexp_replace(original_text, '\s+', '', 'g')) AS solid, length(regexp_replace(original_text, '\s+', '', 'g')) AS held, 0::BIGINT AS n_bad
 FROM verifier_state WHERE length(original_text) > 1000"""}


# ---------------------------------------------------------------- 6 canonical list

def _mapped(spark: SparkSession, sf: str) -> DataFrame:
    from quillgraph.llm.canonical import map_to_list

    return map_to_list(_t(spark, sf, "stored_entity"), "entity_id", "text", _t(spark, sf, "canonical_terms"), "ontology_id", "canonical_name", "synonyms")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _mapped(spark, sf).select("entity_id", F.col("canonical_id").alias("ontology_id"))


def p6_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    """Values that mean no entry, with their number of rows."""
    rows = _t(spark, sf, "stored_entity")
    miss = _mapped(spark, sf).where("canonical_id = 'UNMATCHED'").select("entity_id")
    return rows.join(miss, "entity_id", "left_semi").groupBy(F.lower(F.trim("text")).alias("value")).agg(F.count("*").alias("n_rows"))


QUERIES |= {"p6_found": p6_found, "p6_unmatched": p6_unmatched}


# ---------------------------------------------------------------- 7 splits

def _groups(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    from quillgraph.llm.group_split import nine_digits, related_groups

    rows = _t(spark, sf, "results_bioc").select(nine_digits(F.col("document_id")).alias("document"), "abstract")
    bare = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")
    authors = _t(spark, sf, "doc_authors").select(
        nine_digits(F.col("document_id")).alias("document"), bare("last_name").alias("l"), bare("fore_name").alias("f")).select(
        "document", F.when((F.col("l") != "") & (F.col("f") != ""), F.concat_ws("|", "l", "f")).alias("key"))
    text = F.regexp_replace(F.lower("abstract"), r"[\s\p{Z}]+", "")
    sources = rows.select("document", F.when(text != "", F.sha2(text, 256)).alias("key"))
    return rows, related_groups(rows, "document", [authors, sources])


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    from quillgraph.llm.group_split import assign_splits

    rows, groups = _groups(spark, sf)
    weights = rows.where("document is not null").groupBy("document").agg(F.count("*").alias("weight"))
    split = assign_splits(groups, weights, ["train", "validation", "test"], [0.8, 0.1, 0.1])
    return split.where("group_size > 1").select("group_id", F.col("document").alias("document_id"))


def p7_splits(spark: SparkSession, sf: str) -> DataFrame:
    from quillgraph.llm.group_split import assign_splits

    rows, groups = _groups(spark, sf)
    weights = rows.where("document is not null").groupBy("document").agg(F.count("*").alias("weight"))
    return assign_splits(groups, weights, ["train", "validation", "test"], [0.8, 0.1, 0.1])


def p7_checked(spark: SparkSession, sf: str) -> DataFrame:
    """One row: documents, groups that were torn apart, and whether every split has its share of the rows within 1 % or the weight of the heaviest group."""
    rows = _t(spark, sf, "results_bioc")
    s = p7_splits(spark, sf)
    torn = s.groupBy("group_id").agg(F.count_distinct("split").alias("k")).agg(F.count_if(F.col("k") > 1).alias("n_torn"))
    from quillgraph.llm.group_split import nine_digits

    w = rows.select(nine_digits(F.col("document_id")).alias("document")).where("document is not null").groupBy("document").agg(F.count("*").alias("w")).join(s, "document")
    heaviest = w.groupBy("group_id").agg(F.sum("w").alias("w")).agg(F.max("w").alias("top"))
    one = w.agg(F.count("*").alias("n_documents"), F.sum("w").alias("all"), *[F.sum(F.when(F.col("split") == k, F.col("w")).otherwise(0)).alias(k) for k in ("train", "validation", "test")])
    both = one.join(torn, F.lit(True)).join(heaviest, F.lit(True))  # one row each
    near = lambda k, share: (F.abs(F.col(k) / F.col("all") - share) <= F.greatest(F.lit(0.01), F.col("top") / F.col("all"))).alias(f"{k}_near")
    return both.select("n_documents", "n_torn", near("train", 0.8), near("validation", 0.1), near("test", 0.1))


_GROUPS = r"""
WITH RECURSIVE r AS (
  SELECT lpad(ltrim(regexp_extract(document_id, '([0-9]+)(?:\.0*)?\s*$', 1), '0'), 9, '0') AS d,
         regexp_replace(lower(abstract), '[\s\p{Z}]+', '', 'g') AS t FROM results_bioc),
a AS (
  SELECT lpad(ltrim(regexp_extract(document_id, '([0-9]+)(?:\.0*)?\s*$', 1), '0'), 9, '0') AS d,
         regexp_replace(lower(last_name), '[^\p{L}\p{N}]+', '', 'g') AS l, regexp_replace(lower(fore_name), '[^\p{L}\p{N}]+', '', 'g') AS f FROM doc_authors),
k AS (SELECT DISTINCT d, 'a' || l || '|' || f AS k FROM a WHERE l <> '' AND f <> '' AND d IN (SELECT d FROM r)
      UNION SELECT DISTINCT d, 'b' || t FROM r WHERE t <> ''),
h AS (SELECT k, min(d) AS m FROM k GROUP BY k),
e AS (SELECT DISTINCT k.d AS x, h.m AS y FROM k JOIN h USING (k) WHERE k.d <> h.m),
s AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
reach AS (SELECT x AS d, x AS z FROM s UNION SELECT reach.d, s.y FROM reach JOIN s ON reach.z = s.x),
g AS (SELECT d, min(z) AS g FROM reach GROUP BY d)
"""
QUERIES |= {"p7_found": p7_found, "p7_splits": p7_splits, "p7_checked": p7_checked}
ORACLES |= {"p7_checked": _GROUPS + "SELECT count(DISTINCT d) AS n_documents, 0::BIGINT AS n_torn, true AS train_near, true AS validation_near, true AS test_near FROM r",
            "p7_found": _GROUPS + "SELECT g AS group_id, d AS document_id FROM g"}


# ---------------------------------------------------------------- 8 containers

def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    from quillgraph.llm.packing import byte_tokens, pack

    return pack(_t(spark, sf, "documents"), "doc_id", byte_tokens(F.col("text")))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return p8_containers(spark, sf).where("n_pieces > 1 and piece = 0").select("doc_id")


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Number of containers, tokens and unused share."""
    bins = p8_containers(spark, sf).groupBy("container").agg(F.sum("size").alias("size"))
    return bins.agg(F.count("*").alias("n_containers"), F.sum("size").alias("tokens"), F.max("size").alias("fullest"),
                    F.round(1 - F.sum("size") / (F.count("*") * 4096), 6).alias("unused_share"))


def p8_checked(spark: SparkSession, sf: str) -> DataFrame:
    """One row: items, tokens, pieces, containers over capacity, items whose pieces are not 0..n-1 once each, and whether under 1 % of all space is unused (or under two containers)."""
    c = p8_containers(spark, sf)
    bins = c.groupBy("container").agg(F.sum("size").alias("size")).agg(F.count("*").alias("n"), F.sum("size").alias("tokens"), F.count_if(F.col("size") > 4096).alias("n_over"))
    items = c.groupBy("doc_id").agg(F.count("*").alias("k"), F.count_distinct("piece").alias("d"), F.max("piece").alias("last"), F.max("n_pieces").alias("n")).agg(
        F.count("*").alias("n_items"), F.sum("k").alias("n_pieces"), F.count_if((F.col("k") != F.col("n")) | (F.col("d") != F.col("n")) | (F.col("last") != F.col("n") - 1)).alias("n_wrong"))
    spare = F.col("n") * 4096 - F.col("tokens")
    return bins.join(items, F.lit(True)).select("n_items", "tokens", "n_pieces", "n_over", "n_wrong", ((spare <= 0.01 * F.col("n") * 4096) | (spare < 2 * 4096)).alias("tight"))  # one row each


QUERIES |= {"p8_found": p8_found, "p8_containers": p8_containers, "p8_fill": p8_fill, "p8_checked": p8_checked}
ORACLES |= {"p8_checked": """SELECT count(*) AS n_items, sum(strlen(text) + 1)::BIGINT AS tokens, sum(CAST(ceil((strlen(text) + 1) / 4096) AS BIGINT))::BIGINT AS n_pieces, 0::BIGINT AS n_over, 0::BIGINT AS n_wrong,
 true AS tight FROM documents""", "p8_found": "SELECT doc_id FROM documents WHERE strlen(text) + 1 > 4096"}


# ---------------------------------------------------------------- 9 leaks

def p9_leaks(spark: SparkSession, sf: str) -> DataFrame:
    from quillgraph.llm.leakage import find_leaks

    return find_leaks(_t(spark, sf, "documents"), "doc_id", "text", _t(spark, sf, "benchmark"), "item_id", "text")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return p9_leaks(spark, sf).select("doc_id", "item_id").distinct()


QUERIES |= {"p9_found": p9_found, "p9_leaks": p9_leaks}


# ---------------------------------------------------------------- 10 quality

def p10_kinds(spark: SparkSession, sf: str) -> DataFrame:
    from quillgraph.llm.quality import classify_kind

    return classify_kind(_t(spark, sf, "documents"), "doc_id", "text")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return p10_kinds(spark, sf).where("kind <> 'prose'").select("doc_id", "kind")


def p10_statistics(spark: SparkSession, sf: str) -> DataFrame:
    from quillgraph.llm.quality import text_statistics

    return text_statistics(_t(spark, sf, "documents"), "doc_id", "text")


_PLAIN = "('the', 'of', 'and', 'in', 'to', 'a', 'was', 'were', 'with', 'for', 'by', 'on', 'that', 'as', 'at', 'from', 'but', 'not', 'is', 'no')"
QUERIES |= {"p10_found": p10_found, "p10_kinds": p10_kinds, "p10_statistics": p10_statistics}
ORACLES |= {"p10_statistics": rf"""
WITH b AS (
  SELECT doc_id, length(text) AS n_chars, len(regexp_extract_all(text, '[^ \t\n\r]+')) AS n_words,
         length(regexp_replace(text, '[ \t\n\r]+', '', 'g')) AS solid,
         length(regexp_replace(text, '[\p{{L}}\p{{M}}\p{{N}} \t\n\r]+', '', 'g')) AS sym,
         len(regexp_extract_all(text, '[^\n]*[^ \t\n\r][^\n]*')) AS n_lines,
         len(regexp_extract_all(text, '[.!?。！？।؟…]["”»)」』“]*[ \t\r]*(\n|\z)')) AS ended,
         list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: w <> '') AS latin
  FROM documents)
SELECT doc_id, CAST(n_chars AS BIGINT) AS n_chars, CAST(n_words AS BIGINT) AS n_words,
       round(CASE WHEN n_words > 0 THEN CAST(solid AS DOUBLE) / n_words END, 6) AS mean_word_length,
       round(CASE WHEN n_chars > 0 THEN CAST(sym AS DOUBLE) / n_chars END, 6) AS symbol_ratio,
       CAST(n_lines AS BIGINT) AS n_lines, round(CASE WHEN n_lines > 0 THEN CAST(ended AS DOUBLE) / n_lines END, 6) AS line_end_share,
       round(CASE WHEN len(latin) > 0 THEN CAST(len(list_filter(latin, lambda w: w IN {_PLAIN})) AS DOUBLE) / len(latin) END, 6) AS common_word_share
FROM b"""}

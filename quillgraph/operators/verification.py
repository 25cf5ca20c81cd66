"""Verification of candidate relations against triples, domain and range, as one join pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import constants as K
from quillgraph.operators.contains import contains_join
from quillgraph.operators.graph import closure
from quillgraph.session import Scratch


def resolve_entities(terms: DataFrame, labels: DataFrame) -> DataFrame:
    """``term, entity``: smallest entity with a label that contains the term; failing that, one whose label contains all its words.

    ``terms``: (term); ``labels``: (entity, label); compared in lower case.
    """
    t = terms.select(F.lower(F.trim("term")).alias("q"), "term").where("q <> ''")
    low = labels.select("entity", F.lower("label").alias("label"))
    uq = t.select("q").distinct()
    direct = contains_join(uq, "q", low.select("label").distinct(), "label").join(low, "label").groupBy("q").agg(F.min("entity").alias("entity"))
    rest = uq.join(direct, "q", "left_anti").withColumn("words", F.filter(F.split("q", "[^a-z0-9]+"), lambda w: w != "")).where(F.size("words") > 1)
    # the longest word leads; the others are tested on its hits
    lead = rest.withColumn("lead", F.try_element_at(F.array_sort("words", lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)), F.lit(1)))
    hits = contains_join(lead.select("lead").distinct(), "lead", low.select("label").distinct(), "label").join(lead, "lead").where(F.forall("words", lambda w: F.contains(F.col("label"), w)))
    by_words = hits.join(low, "label").groupBy("q").agg(F.min("entity").alias("entity"))
    return t.join(direct.union(by_words), "q").select("term", "entity").distinct()


def evidence(relations: DataFrame, triples: DataFrame, subproperties: DataFrame, labels: DataFrame) -> DataFrame:
    """``rel_id, exact, subproperty, twohop, flexible, twohop_label``: what the triples say about each relation (rel_id, s, p, o).

    ``exact``: the triple itself; ``subproperty``: one whose predicate is the same or
    a sub-property (child, parent); ``twohop``: two-step paths between the ends;
    ``flexible`` and ``twohop_label``: triples and two-step paths, whatever the
    predicate, between any entities whose label (entity, label) contains the texts of
    the two ends, up to their limits.  Null s or o leaves all columns null.
    """
    r = relations.where("s is not null and o is not null").select("rel_id", "s", "p", "o")
    scratch = Scratch(relations.sparkSession, "evidence")
    pairs = scratch.keep(r.select("s", "o").distinct())
    direct = scratch.keep(triples.select("s", "p", "o").distinct())
    between = direct.join(pairs, ["s", "o"], "left_semi")
    exact = r.join(between, ["s", "p", "o"], "left_semi").select("rel_id", F.lit(True).alias("exact"))
    up = closure(subproperties.select(F.col("child").alias("src"), F.col("parent").alias("dst"))).select(F.col("start").alias("tp"), F.col("node").alias("p"))
    same = r.join(between.withColumnRenamed("p", "tp"), ["s", "o"]).select("rel_id", "p", "tp")
    via = same.join(up, ["tp", "p"], "left_semi").select("rel_id").union(same.where("tp = p").select("rel_id")).distinct().withColumn("subproperty", F.lit(True))
    # number of links by pair of ends, so that parallel links travel once
    link = scratch.keep(direct.groupBy("s", "o").agg(F.count("*").alias("n")))
    two = _paths(pairs, link.join(pairs.select("s").distinct(), "s", "left_semi").select(F.col("s").alias("a"), F.col("o").alias("mid"), "n").where("a <> mid"),
                 link.select(F.col("s").alias("mid"), F.col("o").alias("b"), "n").where("mid <> b"), "twohop", K.LIMIT_TWOHOP)
    # entities by the text their label contains; a label holds few of the texts
    texts = pairs.select(F.col("s").alias("q")).union(pairs.select("o")).distinct()
    low = labels.select("entity", F.lower("label").alias("label"))
    named = scratch.keep(contains_join(texts, "q", low, "label").select("q", "entity").distinct())
    starts = link.join(named.select(F.col("entity").alias("s"), F.col("q").alias("a")), "s").select("a", "s", "o", "n")
    ends = named.select(F.col("entity").alias("o"), F.col("q").alias("b"))
    flex = starts.join(ends, "o").select("a", "b", "n").join(pairs.select(F.col("s").alias("a"), F.col("o").alias("b")), ["a", "b"], "left_semi").groupBy(
        F.col("a").alias("s"), F.col("b").alias("o")).agg(F.least(F.sum("n"), F.lit(K.LIMIT_FLEXIBLE)).alias("flexible"))
    by_label = _paths(pairs, starts.groupBy("a", F.col("o").alias("mid")).agg(F.sum("n").alias("n")),
                      link.select(F.col("s").alias("mid"), "o", "n").join(ends, "o").groupBy("mid", "b").agg(F.sum("n").alias("n")), "twohop_label", K.LIMIT_TWOHOP)
    has = F.col("s").isNotNull() & F.col("o").isNotNull()
    out = relations.select("rel_id", "s", "o").join(exact, "rel_id", "left").join(via, "rel_id", "left")
    for part in (two, flex, by_label):
        out = out.join(part, ["s", "o"], "left")
    no = lambda c, d: F.when(has, F.coalesce(c, F.lit(d))).alias(c)
    return out.select("rel_id", no("exact", False), no("subproperty", False), *[no(c, 0) for c in ("twohop", "flexible", "twohop_label")])


def _paths(pairs: DataFrame, first: DataFrame, second: DataFrame, name: str, limit: int) -> DataFrame:
    """Number of two-step paths of every pair (s, o), from ``first`` (a, mid, n) and ``second`` (mid, b, n), at most ``limit``."""
    # the second step is cut to the wanted ends before the middle nodes meet, and the pairs are looked up last
    ends = pairs.select(F.col("o").alias("b")).distinct()
    met = first.select("a", "mid", F.col("n").alias("n1")).join(second.join(ends, "b", "left_semi").select("mid", "b", F.col("n").alias("n2")), "mid")
    return met.join(pairs.select(F.col("s").alias("a"), F.col("o").alias("b")), ["a", "b"], "left_semi").groupBy(F.col("a").alias("s"), F.col("b").alias("o")).agg(
        F.least(F.sum(F.col("n1") * F.col("n2")), F.lit(limit)).alias(name))


def ask_score(hit: Column) -> Column:
    """Score of a yes/no query; null if it was not run."""
    return F.when(hit, K.SCORE_ASK).when(~hit, K.SCORE_NO_ASK)


def hits_score(n: Column) -> Column:
    """Score of a query by its number of results; null if it was not run."""
    return F.when(n > 0, F.least(F.lit(K.SCORE_CAP), K.SCORE_BASE + n / K.SCORE_STEP)).when(n == 0, K.SCORE_NONE)


def evidence_score(df: DataFrame) -> DataFrame:
    """Adds ``score``, the best of the evidence columns of ``evidence`` (0 if none was run)."""
    parts = [ask_score(F.col("exact")), ask_score(F.col("subproperty")), hits_score(F.col("twohop")), hits_score(F.col("flexible")), hits_score(F.col("twohop_label"))]
    return df.withColumn("score", F.coalesce(F.greatest(*parts), F.lit(0.0)))


def prefix_schema(restrictions: DataFrame) -> DataFrame:
    """``prop, domain_prefixes, range_prefixes`` (sorted arrays) from restrictions (prop, on_class) by the marks of the class iri."""
    tail = F.element_at(F.split("on_class", "/"), -1)
    root = F.when(F.contains(tail, F.lit("_")), F.concat(F.split_part(tail, F.lit("_"), F.lit(1)), F.lit("_"))).otherwise(tail)
    has = lambda marks: F.greatest(*[F.contains("on_class", F.lit(m)).cast("int") for m in marks]) == 1
    r = restrictions.where("prop is not null and on_class is not null").withColumn("root", root)
    sym = F.greatest(*[F.contains(F.lower("prop"), F.lit(w)).cast("int") for w in K.SYMMETRIC_WORDS]) == 1
    marks = F.array(*map(F.lit, K.SYMMETRIC_MARKS))
    g = r.groupBy("prop").agg(F.collect_set(F.when(has(K.CHEMICAL_MARKS), F.col("root"))).alias("d"), F.collect_set(F.when(has(K.CHEMICAL_MARKS) | has(K.RANGE_MARKS), F.col("root"))).alias("r"))
    both = lambda c: F.sort_array(F.when(sym, F.array_union(c, marks)).otherwise(F.col(c)))
    return g.select("prop", both("d").alias("domain_prefixes"), both("r").alias("range_prefixes"))


def verdict(df: DataFrame, by_name: bool = True) -> DataFrame:
    """Adds ``subject_in_domain, object_in_range, direction_ok`` of (predicate, s_iri, o_iri).

    Explicit ``domain`` and ``range`` columns, where present and not null, decide by
    equality or containment; where both are null the prefix schema of the predicate
    does.  The first two stay null where nothing decides; ``direction_ok`` is then false.
    ``by_name=False`` keeps only the predicate whose schema is seeded by its iri.
    """
    schema = K.PREFIX_SCHEMA if by_name else {"treats": K.PREFIX_SCHEMA["treats"]}
    arr = lambda xs: F.array(*map(F.lit, xs))
    dm = F.create_map(*[x for k, (d, _) in schema.items() for x in (F.lit(k), arr(d))])
    rm = F.create_map(*[x for k, (_, r) in schema.items() for x in (F.lit(k), arr(r))])
    dom = F.col("domain") if "domain" in df.columns else F.lit(None).cast("string")
    rng = F.col("range") if "range" in df.columns else F.lit(None).cast("string")
    silent = dom.isNull() & rng.isNull()
    within = lambda iri, prefixes: F.exists(prefixes, lambda p: F.contains(iri, p))
    s = F.when(dom.isNotNull(), F.contains("s_iri", dom)).when(silent, within(F.col("s_iri"), F.try_element_at(dm, F.col("predicate"))))
    o = F.when(rng.isNotNull(), F.contains("o_iri", rng)).when(silent, within(F.col("o_iri"), F.try_element_at(rm, F.col("predicate"))))
    out = df.withColumns({"subject_in_domain": s, "object_in_range": o})
    return out.withColumn("direction_ok", F.coalesce(F.col("subject_in_domain") & F.col("object_in_range"), F.lit(False)))


def decide(df: DataFrame) -> DataFrame:
    """Adds ``final_score, decision, attempts, explanation`` from ``score, direction_ok, known`` (whether both ends and the predicate are known).

    A consistent direction lifts the score to at least 0.9 and accepts; otherwise a
    score of at least the threshold accepts; all others are rejected after the extra rounds.
    """
    consistent = F.col("known") & F.col("direction_ok")
    final = F.when(consistent, F.greatest("score", F.lit(K.SCORE_CONSISTENT))).otherwise(F.col("score"))
    ok = consistent | (final >= K.ACCEPT)
    said = F.when(consistent, "typing consistent").when(F.coalesce(F.col("exact"), F.lit(False)), "exact statement found").otherwise("unsupported")
    return df.withColumns({"final_score": final, "decision": F.when(ok, "accept").otherwise("reject"), "attempts": F.when(ok, 0).otherwise(K.EXTRA_ROUNDS), "explanation": said})


def infer_relations(relations: DataFrame, first: str = "treats", second: str = "causes", result: str = "association") -> DataFrame:
    """``s, p, o``: new links a -result-> c from a -first-> b and b -second-> c; distinct, without those already stated."""
    a = relations.where(F.col("p") == first).select("s", F.col("o").alias("mid")).distinct()
    b = relations.where(F.col("p") == second).select(F.col("s").alias("mid"), "o").distinct()
    new = a.join(b, "mid").where("s <> o").select("s", F.lit(result).alias("p"), "o").distinct()
    return new.join(relations.select("s", "p", "o").distinct(), ["s", "p", "o"], "left_anti")

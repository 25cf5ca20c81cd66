"""Evaluation of predicted against true relations and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import similarity as S
from quillgraph.operators.contains import top_per_key
from quillgraph.session import Scratch

NOT_IN_GOLD, NOT_PREDICTED = "NOT_IN_GOLD", "NOT_PREDICTED"


def guarded(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def match_exact(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """One row per prediction and per missed true triple: ``status`` TP, FP or FN with both predicates.

    ``predicted``: (pred_id, s, p, o, confidence); ``gold``: (gold_id, s, p, o); of
    repeated true triples the last (largest id) counts.
    """
    g = gold.groupBy("s", "p", "o").agg(F.max("gold_id").alias("gold_id"))
    hit = predicted.join(g, ["s", "p", "o"], "left").select(
        F.when(F.col("gold_id").isNull(), "FP").otherwise("TP").alias("status"), "pred_id", "gold_id", F.col("p").alias("pred_p"),
        F.when(F.col("gold_id").isNotNull(), F.col("p")).alias("gold_p"), "confidence")
    miss = g.join(predicted.select("s", "p", "o").distinct(), ["s", "p", "o"], "left_anti").select(
        F.lit("FN").alias("status"), F.lit(None).cast("long").alias("pred_id"), "gold_id", F.lit(None).cast("string").alias("pred_p"), F.col("p").alias("gold_p"), F.lit(None).cast("double").alias("confidence"))
    return hit.unionByName(miss)


def similar_texts(left: DataFrame, right: DataFrame, least: float = 0.8) -> DataFrame:
    """``x, y, ratio``: all pairs of texts (left: x, right: y) with a ratio of at least ``least`` (above 2/3), without comparing all.

    Exact.  A ratio r means common characters of at least r/2 of both lengths, so a
    text of n characters keeps at least (3r - 2) / (2 - r) * n - 1 of its bigrams;
    it is enough to look up the rarest ones that cannot all be missing.  Texts too
    short to promise a bigram are looked up by their characters.
    """
    x, y = left.select("x").where("length(x) > 0").distinct(), right.select("y").where("length(y) > 0").distinct()
    keep = (3 * least - 2) / (2 - least)
    short = int(2 / keep)  # longer texts keep a bigram
    reach = int(short * (2 - least) / least) + 1  # what such a text can resemble

    def keys(df: DataFrame, c: str) -> DataFrame:
        n = F.length(c)
        grams = F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(F.col(c), i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
        # the k-th occurrence of a bigram is a key of its own
        seen = F.transform(grams, lambda g, i: F.concat(g, F.size(F.filter(F.slice(grams, F.lit(1), i + 1), lambda h: h == g)).cast("string")))
        letters = F.when(n <= reach, F.array_distinct(F.split(F.col(c), ""))).otherwise(F.array().cast("array<string>"))
        # short texts by all their letters, the others by bigrams, of which some may be left out
        spare = F.when(n > short, F.greatest(F.floor(keep * n - 1 - 1e-9), F.lit(0))).otherwise(F.lit(0)).cast("int")
        return df.select(c, F.explode(F.concat(F.transform(seen, lambda g: F.struct(F.lit(2).alias("k"), g.alias("g"))), F.transform(letters, lambda g: F.struct(F.lit(1).alias("k"), g.alias("g"))))).alias("e"), spare.alias("spare")).select(
            c, "e.k", "e.g", "spare").where("g <> ''")

    kx, ky = keys(x, "x"), keys(y, "y")
    counts = kx.select("k", "g").union(ky.select("k", "g")).groupBy("k", "g").agg(F.count("*").alias("n"))

    def rare(df: DataFrame, c: str) -> DataFrame:
        w = Window.partitionBy(c, "k").orderBy("n", "g")
        whole = df.join(counts, ["k", "g"]).withColumns({"at": F.row_number().over(w), "size": F.count("*").over(Window.partitionBy(c, "k"))})
        return whole.where((F.col("k") == 1) | (F.col("at") <= F.col("size") - F.col("spare"))).select(c, "k", "g")

    pairs = rare(kx, "x").join(rare(ky, "y"), ["k", "g"]).select("x", "y").distinct()
    bound = 2 * F.least(F.length("x"), F.length("y")) / (F.length("x") + F.length("y")) >= least
    return pairs.where(bound).withColumn("ratio", S.ratio_udf("x", "y")).where(F.col("ratio") >= least)


def match_fuzzy(predicted: DataFrame, gold: DataFrame, least: float = 0.8) -> DataFrame:
    """``pred_id, gold_id``: for every prediction the first true triple with its predicate and similar ends (each at least ``least``).

    Similar ends are found once over all distinct texts; triples then meet on equal keys.
    """
    scratch = Scratch(predicted.sparkSession, "fuzzy")
    ends = lambda df, n: df.select(F.col("s").alias(n)).union(df.select("o")).distinct()
    near = scratch.keep(similar_texts(ends(predicted, "x"), ends(gold, "y"), least).select("x", "y"))
    p = predicted.select("p", "s", "o").distinct().join(near.select(F.col("x").alias("s"), F.col("y").alias("gs")), "s")
    g = gold.groupBy("p", F.col("s").alias("gs"), F.col("o").alias("go")).agg(F.min("gold_id").alias("gold_id"))
    hit = p.join(g, ["p", "gs"]).join(near.select(F.col("x").alias("o"), F.col("y").alias("go")), ["o", "go"])
    first = hit.groupBy("p", "s", "o").agg(F.min("gold_id").alias("gold_id"))
    return predicted.join(first, ["p", "s", "o"]).select("pred_id", "gold_id")


def overall_metrics(matches: DataFrame) -> DataFrame:
    """``tp, fp, fn, precision, recall, f1, support``: one row, 0 on empty denominators."""
    c = matches.agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("TP", "FP", "FN")])
    return _scores(c)


def _scores(c: DataFrame) -> DataFrame:
    p, r = guarded(F.col("tp"), F.col("tp") + F.col("fp")), guarded(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.withColumns({"precision": p, "recall": r}).withColumns({"f1": guarded(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), "support": F.col("tp") + F.col("fn")})


def per_predicate_metrics(matches: DataFrame) -> DataFrame:
    """The same per predicate of either side."""
    m = matches.withColumn("predicate", F.coalesce("pred_p", "gold_p"))
    return _scores(m.groupBy("predicate").agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("TP", "FP", "FN")]))


def confusion(matches: DataFrame) -> DataFrame:
    """``row_label, col_label, n``: hits on the diagonal, false ones against NOT_IN_GOLD, missed ones from NOT_PREDICTED."""
    return matches.select(F.coalesce("pred_p", F.lit(NOT_PREDICTED)).alias("row_label"), F.coalesce("gold_p", F.lit(NOT_IN_GOLD)).alias("col_label")).groupBy("row_label", "col_label").agg(F.count("*").alias("n"))


def confidence_statistics(matches: DataFrame) -> DataFrame:
    """``status, n, mean, std``: mean and population deviation of the confidence of true and false positives, 0 if there are none."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return matches.where("status in ('TP', 'FP')").groupBy("status").agg(F.count("confidence").alias("n"), zero(F.avg("confidence")).alias("mean"), zero(F.stddev_pop("confidence")).alias("std"))


def pair_match(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """``pmid, a, b, status`` of lower-cased pairs inside one document: tp, fp, fn; distinct pairs."""
    low = lambda d: d.select("pmid", F.lower("a").alias("a"), F.lower("b").alias("b")).where("a is not null and b is not null and pmid is not null").distinct()
    p, g = low(predicted).withColumn("in_p", F.lit(True)), low(gold).withColumn("in_g", F.lit(True))
    docs = g.select("pmid").distinct()
    both = p.join(docs, "pmid", "left_semi").join(g, ["pmid", "a", "b"], "full")
    return both.select("pmid", "a", "b", F.when(F.col("in_p") & F.col("in_g"), "tp").when(F.col("in_p"), "fp").otherwise("fn").alias("status"))


def pair_metrics(pairs: DataFrame, swapped: bool = True) -> DataFrame:
    """``tp, fn, fp, precision, recall, f1`` over distinct pairs whatever the document.

    ``swapped`` keeps the exchanged names of the published protocol (precision is
    tp / (tp + fn)); all three are 0 if any count is 0.
    """
    c = pairs.groupBy("status").agg(F.count_distinct("a", "b").alias("n"))
    one = c.agg(*[F.coalesce(F.max(F.when(F.col("status") == s, F.col("n"))), F.lit(0)).alias(s) for s in ("tp", "fn", "fp")])
    x, y = F.col("tp") / (F.col("tp") + F.col("fn")), F.col("tp") / (F.col("tp") + F.col("fp"))
    p, r = (x, y) if swapped else (y, x)
    ok = (F.col("tp") > 0) & (F.col("fn") > 0) & (F.col("fp") > 0)
    out = one.withColumns({"precision": F.when(ok, p).otherwise(0.0), "recall": F.when(ok, r).otherwise(0.0)})
    return out.withColumn("f1", F.when(ok, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def classifier_report(labels: DataFrame) -> DataFrame:
    """``label, precision, recall, f1, support``: per class, then MICRO, MACRO and WEIGHTED; ``labels`` is (truth, pred), nulls are their own class."""
    x = labels.select(F.coalesce("truth", F.lit("null")).alias("t"), F.coalesce("pred", F.lit("null")).alias("p")).groupBy("t", "p").agg(F.count("*").alias("n"))
    t = x.groupBy(F.col("t").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"))
    p = x.groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("predicted"))
    c = t.join(p, "label", "full").na.fill(0, ["support", "tp", "predicted"])
    c = c.withColumns({"precision": guarded(F.col("tp"), F.col("predicted")), "recall": guarded(F.col("tp"), F.col("support"))})
    c = c.withColumn("f1", guarded(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    per = c.select("label", "precision", "recall", "f1", "support")
    acc = guarded(F.sum("tp"), F.sum("support"))
    micro = c.agg(acc.alias("precision"), acc.alias("recall"), acc.alias("f1"), F.sum("support").alias("support")).select(F.lit("MICRO").alias("label"), "*")
    macro = c.agg(*[F.avg(m).alias(m) for m in ("precision", "recall", "f1")], F.sum("support").alias("support")).select(F.lit("MACRO").alias("label"), "*")
    weighted = c.agg(*[guarded(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(m) for m in ("precision", "recall", "f1")], F.sum("support").alias("support")).select(F.lit("WEIGHTED").alias("label"), "*")
    return per.unionByName(micro).unionByName(macro).unionByName(weighted)


def error_patterns(labels: DataFrame, top: int = 10) -> DataFrame:
    """``pattern, n, share, rank``: most frequent "true -> predicted" mistakes and their share of all mistakes."""
    wrong = labels.where("truth is not null and pred is not null and truth <> pred").groupBy(F.concat_ws(" -> ", "truth", "pred").alias("pattern")).agg(F.count("*").alias("n"))
    total = wrong.agg(F.sum("n").alias("all"))
    ranked = wrong.join(F.broadcast(total)).select("pattern", "n", (F.col("n") / F.col("all")).alias("share"), F.lit(0).alias("g"))
    return ranked.orderBy(F.desc("n"), "pattern").limit(top).transform(lambda d: top_per_key(d, ["g"], [F.desc("n"), F.col("pattern")], top)).drop("g")

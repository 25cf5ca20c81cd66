"""Relation extraction from parsed tokens, term mapping and association typing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import constants as K
from quillgraph.functions.text import entity_variants
from quillgraph.operators.contains import contains_join


def extract_svo(tokens: DataFrame) -> DataFrame:
    """``doc_id, sent_id, subject, action, object, negation`` from parsed tokens.

    ``tokens``: (doc_id, sent_id, i, text, pos, dep, head_i, ent_type).  Every verb
    that is no auxiliary is combined with all entity subjects and objects in its
    subtree; negated if a direct child of the verb or of the object is a negation.
    The tokens of one sentence, a bounded number, meet in one row; nothing else is shuffled.
    """
    kinds = dict(tokens.dtypes)
    sentences = tokens.groupBy("doc_id", "sent_id").agg(F.collect_list(F.struct("i", "text", "pos", "dep", "head_i", "ent_type")).alias("t"))
    return sentences.mapInArrow(_svo, f"doc_id {kinds['doc_id']}, sent_id {kinds['sent_id']}, subject string, action string, object string, negation boolean")


def _svo(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    subject_deps, object_deps, negations = frozenset(K.SUBJECT_DEPS), frozenset(K.OBJECT_DEPS), frozenset(K.NEGATIONS)
    for b in batches:
        rows, out = [], [[], [], [], []]
        for n, sentence in enumerate(b.column("t").to_pylist()):
            kids: dict[int, list[int]] = {}
            at: dict[int, list[dict]] = {}
            denied = set()
            for t in sentence:
                at.setdefault(t["i"], []).append(t)
                if t["head_i"] is not None and t["head_i"] != t["i"]:
                    kids.setdefault(t["head_i"], []).append(t["i"])
                    if (t["text"] or "").lower() in negations:
                        denied.add(t["head_i"])
            for verb in sentence:
                if verb["pos"] != "VERB" or verb["dep"] == "aux":
                    continue
                below, todo = {verb["i"]}, [verb["i"]]
                while todo:
                    for k in kids.get(todo.pop(), ()):
                        if k not in below:
                            below.add(k)
                            todo.append(k)
                inside = [t for k in sorted(below) for t in at.get(k, ()) if t["ent_type"] == "ENTITY"]
                for s in inside:
                    if s["dep"] in subject_deps:
                        for o in inside:
                            if o["dep"] in object_deps:
                                rows.append(n)
                                for c, v in zip(out, (s["text"], verb["text"], o["text"], verb["i"] in denied or o["i"] in denied), strict=True):
                                    c.append(v)
        pick = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pick), b.column("sent_id").take(pick), *(pa.array(c, pa.string()) for c in out[:3]), pa.array(out[3], pa.bool_())],
                                        names=["doc_id", "sent_id", "subject", "action", "object", "negation"])


def bio_chunks(tokens: DataFrame) -> DataFrame:
    """``doc_id, sent_id, chunk_no, chunk``: chunks of B/I/O tags on base forms; ``tokens`` is (doc_id, sent_id, i, base, tag).  An I without a B before it in its sentence is dropped."""
    w = Window.partitionBy("doc_id", "sent_id").orderBy("i")
    inside = tokens.withColumn("chunk_no", F.sum(F.when(F.startswith("tag", F.lit("B")), 1).otherwise(0)).over(w)).where(
        (F.startswith("tag", F.lit("B")) | F.startswith("tag", F.lit("I"))) & (F.col("chunk_no") > 0))
    return inside.groupBy("doc_id", "sent_id", "chunk_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "base"))), lambda x: x["base"]), " ").alias("chunk"))


def align_concepts(sentences: DataFrame, concepts: DataFrame) -> DataFrame:
    """``sent_id, concept_id``: concepts whose trigger occurs in the sentence, whatever the case; (sent_id, sentence), (concept_id, trigger)."""
    s = sentences.select("sent_id", F.lower("sentence").alias("sentence"))
    c = concepts.select("concept_id", F.lower("trigger").alias("trigger")).where("trigger <> ''")
    hit = contains_join(c.select("trigger").distinct(), "trigger", s, "sentence").select("sent_id", "trigger")
    return hit.join(c, "trigger").select("sent_id", "concept_id").distinct()


def phrase_matches(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """``id, phrase_id, start``: dictionary phrases of any length found as word sequences; (id, text), (phrase_id, phrase).

    Only the lengths that occur in the dictionary are looked up, one row of them in all.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    p = phrases.select("phrase_id", words(F.col("phrase")).alias("w")).where(F.size("w") > 0).select("phrase_id", F.array_join("w", " ").alias("k"), F.size("w").alias("n"))
    t = texts.select("id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    lengths = p.agg(F.collect_set("n").alias("lengths"))
    grams = t.join(F.broadcast(lengths), F.lit(True)).select("id", "w", F.explode("lengths").alias("n")).where(F.col("n") <= F.size("w")).select(
        "id", "n", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.array_join(F.slice("w", i, F.col("n")), " "))).alias("start", "k"))
    return grams.join(p, ["n", "k"]).select("id", "phrase_id", "start")


def ontology_lookup(mentions: DataFrame, nodes: DataFrame, degrees: DataFrame) -> DataFrame:
    """``mention, id, score``: nodes whose name or synonym equals a mention or one of its variants, whatever the case.

    The score is the node's degree times the weight of its ontology (1 if it has none); nodes without links are dropped.
    """
    m = mentions.select("mention").where("mention is not null").distinct()
    forms = m.select("mention", F.explode(F.array_distinct(F.concat(F.array("mention"), entity_variants(F.col("mention"))))).alias("form")).select("mention", F.lower(F.trim("form")).alias("form")).distinct()
    labels = nodes.select("id", F.explode(F.concat(F.array("name"), "synonyms")).alias("form")).where("form is not null").select("id", F.lower(F.trim("form")).alias("form")).distinct()
    weights = F.create_map(*[F.lit(x) for kv in K.MAPPING_WEIGHTS.items() for x in kv])
    weight = F.coalesce(F.try_element_at(weights, F.split_part("id", F.lit(":"), F.lit(1))), F.lit(1))
    return forms.join(labels, "form").select("mention", "id").distinct().join(degrees, "id").select("mention", "id", (weight * F.col("degree")).alias("score"))


def resolved_relations(relations: DataFrame, mapped: DataFrame) -> DataFrame:
    """Relations both of whose ends were mapped, with the best term of each: (rel_id, subject, object) and (mention, id, score)."""
    best = mapped.groupBy("mention").agg(F.max_by("id", F.struct("score", "id")).alias("best"))
    return relations.join(best.select(F.col("mention").alias("subject"), F.col("best").alias("subject_id")), "subject").join(
        best.select(F.col("mention").alias("object"), F.col("best").alias("object_id")), "object").select("rel_id", "subject_id", "object_id")


def association_type(subject_class: Column, object_class: Column) -> Column:
    """First association whose subject and object classes fit, else ``Association``."""
    out = None
    for name, subj, obj in K.ASSOCIATIONS:
        fits = subject_class.isin(subj) & object_class.isin(obj)
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out.otherwise("Association")


def class_of(prefix: Column, namespace: Column) -> Column:
    """Class by ontology prefix or namespace, the class with most requirements first, else ``NamedThing``."""
    out = None
    for name, reqs in sorted(K.CLASS_TABLE, key=lambda x: -len(x[1])):
        fits = F.coalesce(prefix.isin(reqs), F.lit(False)) | F.coalesce(namespace.isin(reqs), F.lit(False))
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out.otherwise("NamedThing")

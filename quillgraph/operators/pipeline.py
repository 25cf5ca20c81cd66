"""From texts to a committed graph: taggers, extractors with a verifying second question, stores and the end-to-end driver."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators.relations import ontology_lookup, resolved_relations
from quillgraph.operators.store import query_relationships, rule_extractor
from quillgraph.sinks.merge import read_merged, write_merged


class Tagger(Protocol):
    """Text to (start, end, type) spans, offsets in characters."""

    def __call__(self, text: str) -> list[tuple[int, int, str]]: ...


class RelationVerifier(Protocol):
    """(subject, predicate, object, text) to a confidence."""

    def __call__(self, subject: str, predicate: str, obj: str, text: str) -> float: ...


class KnowledgeStore(Protocol):
    """Relations that can be added and asked for."""

    def add(self, relations: DataFrame) -> None: ...

    def find(self, subject: str | None = None, predicate: str | None = None, obj: str | None = None, min_confidence: float = 0.0, limit: int = 100) -> DataFrame: ...


class OntologyManager(Protocol):
    """Terms by text and the links between them."""

    def nodes(self) -> DataFrame: ...

    def edges(self) -> DataFrame: ...


class TableStore:
    """Relations in a merged table, one row per (subject, predicate, object), the surest stays."""

    keys = ["subject", "predicate", "object"]

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, relations: DataFrame) -> None:
        write_merged(self.path, relations.select(*self.keys, "confidence"), self.keys, [F.col("confidence")])

    def find(self, subject: str | None = None, predicate: str | None = None, obj: str | None = None, min_confidence: float = 0.0, limit: int = 100) -> DataFrame:
        return query_relationships(read_merged(self.spark, self.path), subject, predicate, obj, min_confidence, limit)


class DictionaryTagger:
    """Default tagger: names of a bounded list (name, type), whole words, longest first, whatever the case."""

    def __init__(self, names: list[tuple[str, str]]):
        self.names = {n.lower(): t for n, t in names if n.strip()}
        self.automaton = None

    def __call__(self, text: str) -> list[tuple[int, int, str]]:
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for n, t in self.names.items():
                self.automaton.add_word(n, (len(n), t))
            if self.names:
                self.automaton.make_automaton()
        low = text.lower()
        if not self.names or len(low) != len(text):
            return []
        spans = [(end + 1 - n, end + 1, t) for end, (n, t) in self.automaton.iter(low)]
        spans = [s for s in spans if not (s[0] and low[s[0] - 1].isalnum()) and not (s[1] < len(low) and low[s[1]].isalnum())]
        out: list[tuple[int, int, str]] = []
        for s in sorted(spans, key=lambda s: (s[0], -s[1])):
            if not out or s[0] >= out[-1][1]:
                out.append(s)
        return out

    def __getstate__(self):
        return {"names": self.names, "automaton": None}


def tag_with(df: DataFrame, id_col: str, text_col: str, tagger: Callable[[str], list[tuple[int, int, str]]]) -> DataFrame:
    """``id_col, start, stop, type, text``: spans of a pluggable tagger; null texts give none."""
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, cols = [], [[], [], [], []]
            for n, text in enumerate(b.column(1).to_pylist()):
                for s, e, t in tagger(text):
                    rows.append(n)
                    for c, v in zip(cols, (s, e, t, text[s:e]), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))],
                                            names=[id_col, "start", "stop", "type", "text"])

    return df.select(id_col, F.col(text_col).alias("_qg_text")).where("_qg_text is not null").mapInArrow(run, f"{id_col} {kind}, start bigint, stop bigint, type string, text string")


def tagged_words(text: Column, stop_words: list[str]) -> Column:
    """Distinct words of a sentence without stop words, sorted: what a word-wise tagger is asked about."""
    words = F.regexp_extract_all(text, F.lit(r"[^\s]+"), F.lit(0))
    return F.sort_array(F.array_except(F.array_distinct(words), F.array(*map(F.lit, stop_words))))


def rule_model(prompt: str) -> str:
    """Default model: answers a prompt by the rule-based extractor, and a verifying question by its input."""
    if "\n\nAnswer: " in prompt:
        return prompt.rsplit("\n\nAnswer: ", 1)[1]
    text = prompt.split("\n\nText: ", 1)[-1].split("\n\nAdditional context: ", 1)[0]
    return json.dumps([{"subject": s, "predicate": p, "object": o, "confidence": c, "evidence": text} for s, p, o, c in rule_extractor(text)])


def extract_with_model(df: DataFrame, id_col: str, text_col: str, model: Callable[[str], str] = rule_model, verify: bool = True, context_col: str | None = None) -> DataFrame:
    """``id_col, subject, predicate, object, confidence, evidence``: relations a language model states about each text.

    The text goes into a prompt; with ``verify`` the answer is shown to the model a
    second time with the text; the last answer is parsed, predicates are brought to
    their standard form.  A model that raises, or an answer without a list, gives no rows.
    """
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            answers = []
            for prompt in b.column(1).to_pylist():
                try:
                    answer = model(prompt)
                    if verify:
                        answer = model(f"Keep only the relations of the answer that the text states.\n\n{prompt}\n\nAnswer: {answer}")
                except Exception:
                    answer = ""
                answers.append(answer)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(answers, pa.string())], names=[id_col, "answer"])

    prompt = T.extraction_prompt(F.col(text_col), F.col(context_col) if context_col else None)
    asked = df.where(F.col(text_col).isNotNull()).select(id_col, prompt.alias("prompt")).mapInArrow(run, f"{id_col} {kind}, answer string")
    r = asked.select(id_col, F.explode(T.parse_relations(F.col("answer"))).alias("r")).select(id_col, "r.*")
    return r.withColumn("predicate", T.extractor_predicate(F.col("predicate")))


def label_code(label: Column, labels: list[str]) -> Column:
    """Number of a label in a list, 0 for any other."""
    table = F.create_map(*[x for k, v in enumerate(labels) for x in (F.lit(v), F.lit(k))])
    return F.coalesce(F.try_element_at(table, label), F.lit(0))


def node_type(types: Column) -> Column:
    """``entity`` or ``concept`` by the words of a node's types, in order of precedence."""
    said = F.lower(F.array_join(types, " "))
    has = lambda *words: F.greatest(*[F.contains(said, F.lit(w)).cast("int") for w in words]) == 1
    entity = has("drug", "compound", "chemical", "disease", "disorder", "phenotype", "protein", "gene")
    return F.when(entity, "entity").when(has("pathway", "process"), "concept").otherwise("entity")


def text_to_graph(texts: DataFrame, nodes: DataFrame, degrees: DataFrame, extractor: Callable[[DataFrame], DataFrame], store: KnowledgeStore | None = None) -> DataFrame:
    """``doc_id, subject, predicate, object, subject_id, object_id, confidence``: the whole way from texts (doc_id, text) to a graph.

    Citations are stripped, relations extracted by ``extractor`` (from (doc_id, text)
    to (doc_id, subject, predicate, object, confidence)), both ends mapped to the best
    terms (null where none fits), and the relations added to ``store`` if there is one.
    """
    clean = texts.select("doc_id", T.strip_citations(F.col("text")).alias("text")).where("text is not null")
    found = extractor(clean).withColumn("rel_id", F.monotonically_increasing_id())
    mapped = ontology_lookup(found.select(F.col("subject").alias("mention")).union(found.select("object")), nodes, degrees)
    if store is not None:
        store.add(found)
    ends = resolved_relations(found.select("rel_id", "subject", "object"), mapped)
    return found.join(ends, "rel_id", "left").select("doc_id", "subject", "predicate", "object", "subject_id", "object_id", "confidence")

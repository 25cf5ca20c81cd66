"""Column functions for cleaning and normalising text; all run inside the JVM.

Null input gives null unless stated otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.functions import constants as K


def strip_citations(c: Column) -> Column:
    """Replace author-year, reference-list and bracketed-number citations by a blank each."""
    c = F.regexp_replace(c, r"\(\D*\d{4}(;\D*\d{4})*\)", " ")
    c = F.regexp_replace(c, r"(\s*)?\(\s*REF\s*\.\s*\d*\s*\)(\s*)?", " ")
    c = F.regexp_replace(c, r"(\s*)?\(\s*REFS\s*\.*\s*\d*,*\s*\d*\s*\)(\s*)?", " ")
    return F.regexp_replace(c, r"[\[(]\d+[)\]]", " ")


def resolver_term(c: Column) -> Column:
    """Lower case, dashes without blanks around them, other characters than letters, digits and dashes a blank."""
    c = F.regexp_replace(F.lower(c), r"[ \t\n\r\f]*-[ \t\n\r\f]*", "-")
    c = F.regexp_replace(c, r"[^a-z0-9\- ]+", " ")
    return F.trim(F.regexp_replace(c, " +", " "))


def query_literal(c: Column) -> Column:
    """Text safe inside a quoted query literal: quotes, backslashes and line breaks become one blank."""
    return F.trim(F.regexp_replace(c, r"[\"'\\\n\r\t]+", " "))


def index_text(c: Column) -> Column:
    """Index form: lower case, single blanks, only word characters, blanks, dashes and dots, Greek letters spelled out; null gives ''."""
    c = F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[ \t\n\r\f]+", " "))
    c = F.regexp_replace(c, r"[^\p{L}\p{N}_ .\-]", "")
    return F.replace(F.replace(F.replace(c, F.lit("α"), F.lit("alpha")), F.lit("β"), F.lit("beta")), F.lit("γ"), F.lit("gamma"))


def iri_to_curie(c: Column) -> Column:
    """``PREFIX:number`` of an IRI; a CURIE or anything else stays."""
    tail = r"([A-Za-z]+)_([0-9]+)$"
    inner = r"/obo/([A-Za-z]+)_([0-9]+)"
    join = lambda p: F.concat_ws(":", F.regexp_extract(c, p, 1), F.regexp_extract(c, p, 2))
    return F.when(c.rlike(r"^[A-Za-z]+:[0-9]+$"), c).when(c.rlike(tail), join(tail)).when(c.rlike(inner), join(inner)).otherwise(c)


def biolink_type(ontology: Column, name: Column) -> Column:
    """Type of a term by its ontology; terms of the gene ontology by words of their name (null names: process)."""
    low = F.lower(F.coalesce(name, F.lit("")))
    go = F.lit(None).cast("string")
    for words, kind in reversed(K.GO_KINDS):
        go = F.when(F.greatest(*[F.contains(low, F.lit(w)).cast("int") for w in words]) == 1, kind).otherwise(go)
    out = F.when(F.lower(ontology) == "go", F.coalesce(go, F.lit("BiologicalProcess")))
    for ont, kind in K.BIOLINK_BY_ONTOLOGY.items():
        out = out.when(F.lower(ontology) == ont, kind)
    return out.otherwise("NamedThing")


def lookup(c: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """Value of a small fixed table, else ``default`` (the key itself)."""
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(m, c), default if default is not None else c)


def eval_entity(c: Column) -> Column:
    """Entity form of the evaluation: lower case, trimmed, dashes and underscores as blanks, abbreviations expanded."""
    return lookup(F.translate(F.trim(F.lower(c)), "-_", "  "), K.ENTITY_ABBREVIATIONS)


def eval_predicate(c: Column) -> Column:
    return lookup(F.regexp_replace(F.trim(F.lower(c)), r"[ \-]", "_"), K.EVAL_PREDICATES)


def extractor_predicate(c: Column) -> Column:
    """Standard form of an extractor's predicate by exact, case-sensitive match; others stay."""
    table: dict[str, str] = {}
    for key, members in K.EXTRACTOR_PREDICATES.items():
        for m in [key, *members]:
            table.setdefault(m, key)
    return lookup(c, table)


def accepts_type(entity_type: Column, ontology: Column) -> Column:
    """Whether an ontology suits an entity type; unknown types accept all."""
    m = F.create_map(*[x for k, v in K.TYPE_ONTOLOGIES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.array_contains(F.try_element_at(m, F.lower(entity_type)), F.lower(ontology)), F.lit(True))


def snake_case(c: Column) -> Column:
    """Whitespace to underscores, camel case to snake case, the first dash of a name to an underscore."""
    c = F.regexp_replace(c, r"[ \t\n\r\f]+", "_")
    c = F.regexp_replace(c, "([a-zA-Z])([A-Z][a-z]+)", "$1_$2")
    c = F.lower(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1_$2"))
    return F.regexp_replace(c, r"^([^-]*)-([a-zA-Z0-9_]*).*$", "$1_$2")


def term_variants(c: Column) -> Column:
    """Initials in upper and lower case, plural or singular, without parentheses, dashes opened and closed; an array."""
    words = F.regexp_extract_all(c, F.lit(r"(?<![A-Za-z0-9_])[A-Za-z]+(?![A-Za-z0-9_])"), F.lit(0))
    initials = F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")
    bare = F.trim(F.regexp_replace(c, r"[ \t\n\r\f]*\([^)]*\)", ""))
    parts = F.array(
        F.when(F.size(words) > 1, F.upper(initials)), F.when((F.size(words) > 1) & (F.size(words) <= 4), F.lower(initials)),
        F.when(F.endswith(c, F.lit("s")) & (F.length(c) > 3), F.substring(c, F.lit(1), F.length(c) - 1)).when(~F.endswith(c, F.lit("s")), F.concat(c, F.lit("s"))),
        F.when(bare != c, bare), F.when(F.contains(c, F.lit("-")), F.replace(c, F.lit("-"), F.lit(" "))),
        F.when(F.contains(c, F.lit("-")), F.replace(c, F.lit("-"), F.lit(""))))
    return F.filter(parts, lambda x: x.isNotNull())


def token_set(c: Column) -> Column:
    """Distinct lower-case runs of ASCII letters and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))


def node_text(name: Column, synonyms: Column, definition: Column) -> Column:
    """Name, synonyms and definition joined by ``' . '``, missing and empty parts left out."""
    parts = F.concat(F.array(name), F.coalesce(synonyms, F.array().cast("array<string>")), F.array(definition))
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), " . ")


def parentheses_to_dash(c: Column) -> Column:
    """``word(word)`` groups joined by dashes; a text without such a group stays."""
    groups = F.regexp_extract_all(c, F.lit(r"[a-zA-Z]*\([a-zA-Z]*\)"), F.lit(0))
    words = F.filter(F.flatten(F.transform(groups, lambda g: F.split(F.regexp_replace(g, r"\)$", ""), r"\("))), lambda w: w != "")
    return F.when(F.size(groups) > 0, F.array_join(words, "-")).otherwise(c)


def drop_punctuation(c: Column) -> Column:
    """Tokens without punctuation, joined by single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[!-/:-@\[-`{-~]+", " "), " +", " "))


def drop_stop_words(c: Column) -> Column:
    stop = F.array(*map(F.lit, K.STOP_WORDS))
    return F.array_join(F.filter(F.split(F.trim(c), " +"), lambda w: ~F.array_contains(stop, F.lower(w))), " ")


def simple_lemma(c: Column) -> Column:
    """Rule-based singular of every word: -ies to -y, other plural -s dropped (the default of the pluggable lemmatiser)."""
    one = lambda w: (F.when(w.rlike("[a-z]{2}ies$"), F.regexp_replace(w, "ies$", "y"))
                     .when(w.rlike("[a-z]{2}[^siu ]s$"), F.regexp_replace(w, "s$", "")).otherwise(w))
    return F.array_join(F.transform(F.split(F.lower(F.trim(c)), " +"), one), " ")


def entity_variants(c: Column) -> Column:
    """Lemma, lemma without stop words, parentheses as dashes, no punctuation; distinct and not empty."""
    return F.filter(F.array_distinct(F.array(simple_lemma(c), drop_stop_words(simple_lemma(c)), parentheses_to_dash(c), drop_punctuation(c))), lambda x: x != "")


def mark_entities(text: Column, s_start: Column, s_end: Column, o_start: Column, o_end: Column) -> Column:
    """Entity markers around two spans (offsets from 0, end exclusive), inserted from the right so offsets stay valid."""
    wrap = lambda t, a, b, n: F.concat(F.substring(t, F.lit(1), a), F.lit(f"[E{n}]"), F.substring(t, a + 1, b - a), F.lit(f"[/E{n}]"), F.substring(t, b + 1, F.length(t)))
    return F.when(s_start > o_start, wrap(wrap(text, s_start, s_end, 1), o_start, o_end, 2)).otherwise(wrap(wrap(text, o_start, o_end, 2), s_start, s_end, 1))


def mark_mentions(text: Column, subject: Column, obj: Column) -> Column:
    """Entity markers around the first mention of subject and object; a text without one of them gets only the other's."""
    s, o = F.position(subject, text), F.position(obj, text)
    s0, o0 = s - 1, o - 1
    both = mark_entities(text, s0, s0 + F.length(subject), o0, o0 + F.length(obj))
    one = lambda at, x, n: F.concat(F.substring(text, F.lit(1), at), F.lit(f"[E{n}]"), x, F.lit(f"[/E{n}]"), F.substring(text, at + F.length(x) + 1, F.length(text)))
    apart = (s0 + F.length(subject) <= o0) | (o0 + F.length(obj) <= s0)
    return F.when((s > 0) & (o > 0) & apart, both).when(s > 0, one(s0, subject, 1)).when(o > 0, one(o0, obj, 2)).otherwise(text)


def definition_context(definition: Column) -> Column:
    """First of four defining phrases with what follows it up to a full stop or comma; null without one."""
    out = F.lit(None).cast("string")
    for phrase in reversed(["characterized by", "caused by", "results in", "associated with"]):
        hit = F.regexp_extract(definition, f"(?i){phrase} (.+?)[.,]", 1)
        out = F.when(hit != "", F.concat(F.lit(f"{phrase} "), hit)).otherwise(out)
    return out


def has_prefix(iri: Column, prefixes: Column) -> Column:
    """Whether an IRI contains one of the prefixes (containment, not only at the start)."""
    return F.exists(prefixes, lambda p: F.contains(iri, p))


def trigger_text(c: Column) -> Column:
    """Text of a concept trigger such as ``["Extract"-tx-2-...``."""
    return F.regexp_extract(c, r"\[\"%*([a-zA-Z\d*\s]*)\"", 1)


def code_blocks(c: Column) -> Column:
    """Query texts in fenced blocks: those marked sparql, else unmarked ones that look like a query; an array."""
    marked = F.regexp_extract_all(c, F.lit(r"(?s)```sparql\s*(.*?)```"), F.lit(1))
    plain = F.filter(F.regexp_extract_all(c, F.lit(r"(?s)```\s*(.*?)```"), F.lit(1)), lambda b: b.rlike("SELECT|PREFIX|WHERE"))
    return F.transform(F.when(F.size(marked) > 0, marked).otherwise(plain), F.trim)


def parse_relations(c: Column) -> Column:
    """Relations of an extractor's answer: the outermost JSON list, rows without subject, predicate or object dropped, values trimmed.

    Confidence defaults to 0.5, evidence to ''.  An answer without a valid list gives an empty array.
    """
    body = F.regexp_extract(c, r"(?s)(\[.*\])", 1)
    rows = F.from_json(body, "array<struct<subject:string,predicate:string,object:string,confidence:double,evidence:string>>")
    clean = F.transform(rows, lambda r: F.struct(
        F.trim(r["subject"]).alias("subject"), F.trim(r["predicate"]).alias("predicate"), F.trim(r["object"]).alias("object"),
        F.coalesce(r["confidence"], F.lit(0.5)).alias("confidence"), F.coalesce(r["evidence"], F.lit("")).alias("evidence")))
    kept = F.filter(clean, lambda r: r["subject"].isNotNull() & r["predicate"].isNotNull() & r["object"].isNotNull())
    return F.coalesce(kept, F.array().cast("array<struct<subject:string,predicate:string,object:string,confidence:double,evidence:string>>"))


def extraction_prompt(text: Column, context: Column | None = None) -> Column:
    """Prompt for a language-model extractor."""
    base = F.concat(F.lit("List the relations stated in the text as a JSON list of subject, predicate, object, confidence and evidence.\n\nText: "), text)
    return base if context is None else F.when(context.isNull(), base).otherwise(F.concat(base, F.lit("\n\nAdditional context: "), context))

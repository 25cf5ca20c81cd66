import pytest
from pyspark.sql import functions as F

from quillgraph.functions import text as T

CASES = [
    (T.strip_citations, "Test[1]", "Test "), (T.strip_citations, "Test[1], Test", "Test , Test"), (T.strip_citations, "Test(1), Test", "Test , Test"),
    (T.strip_citations, "Test, Test groups in 1985 ( REFS 5,6)", "Test, Test groups in 1985 "), (T.strip_citations, "GLUT4 ( REF. 203)", "GLUT4 "),
    (T.strip_citations, "Receptor process (Noy et al., 2009)", "Receptor process  "),
    (T.snake_case, "Test", "test"), (T.snake_case, "Test-Case", "test_case"), (T.snake_case, "testCase", "test_case"), (T.snake_case, "test_Case", "test_case"),
    (T.snake_case, "TestCase-Property", "test_case_property"), (T.snake_case, "annotation-has_narrow_synonym", "annotation_has_narrow_synonym"),
    (T.snake_case, "annotation-expand expression to", "annotation_expand_expression_to"),
    (T.drop_stop_words, "the cell", "cell"), (T.drop_stop_words, "the", ""), (T.drop_stop_words, "as cell function", "cell function"),
    (T.simple_lemma, "entities", "entity"), (T.simple_lemma, "cells", "cell"), (T.simple_lemma, "cell", "cell"),
    (T.parentheses_to_dash, "NNN(MMM)", "NNN-MMM"), (T.parentheses_to_dash, "NNN(A),(a)", "NNN-A-a"), (T.parentheses_to_dash, "NNN", "NNN"), (T.parentheses_to_dash, "", ""),
    (T.drop_punctuation, "NNN,MMM.!)", "NNN MMM"), (T.drop_punctuation, "NNN)", "NNN"), (T.drop_punctuation, "", ""),
    (T.trigger_text, '["Extract"-tx-2-x', "Extract"), (T.trigger_text, '["CA9"-tx-1-x', "CA9"), (T.trigger_text, '["% Activity"-tx', " Activity"),
    (T.iri_to_curie, "MONDO:1", "MONDO:1"), (T.iri_to_curie, "http://x/obo/HP_12", "HP:12"), (T.iri_to_curie, "http://x/obo/HP_12/more", "HP:12"), (T.iri_to_curie, "odd", "odd"), (T.iri_to_curie, None, None),
    (T.index_text, "  α-Cell,  (Beta) ", "alpha-cell beta"), (T.index_text, None, ""), (T.resolver_term, "A - B (c)", "a-b c"),
    (T.eval_entity, " MI ", "myocardial infarction"), (T.eval_predicate, "leads to", "causes"), (T.extractor_predicate, "leads to", "causes"), (T.extractor_predicate, "Leads to", "Leads to"),
    (T.definition_context, "A disease caused by a virus, often.", "caused by a virus"), (T.definition_context, "nothing", None), (T.definition_context, None, None),
]


@pytest.mark.parametrize("fn,value,want", CASES)
def test_scalar(spark, fn, value, want):
    assert spark.createDataFrame([(value,)], "v string").select(fn(F.col("v"))).first()[0] == want


def test_arrays(spark):
    d = spark.createDataFrame([("red blood cells (RBC)",), ("x",), (None,)], "v string")
    got = [r[0] for r in d.select(T.term_variants(F.col("v"))).collect()]
    assert got[0] == ["RBCR", "rbcr", "red blood cells (RBC)s", "red blood cells"] and got[1] == ["xs"]
    answers = spark.createDataFrame([('text [{"subject":" a ","predicate":"p","object":"b"},{"subject":"x"}] end',), ("no list",), (None,)], "v string")
    out = [r[0] for r in answers.select(T.parse_relations(F.col("v"))).collect()]
    assert [tuple(x) for x in out[0]] == [("a", "p", "b", 0.5, "")] and out[1] == [] and out[2] == []


def test_markers(spark):
    d = spark.createDataFrame([("b hits a", "a", "b"), ("only a", "a", "zz"), ("none", "x", "y"), ("aa", "a", "a")], "t string, s string, o string")
    got = [r[0] for r in d.select(T.mark_mentions(F.col("t"), F.col("s"), F.col("o"))).collect()]
    assert got == ["[E2]b[/E2] hits [E1]a[/E1]", "only [E1]a[/E1]", "none", "[E1]a[/E1]a"]


def test_types(spark):
    d = spark.createDataFrame([("go", "x pathway"), ("go", None), ("mondo", "x"), ("zz", "x")], "o string, n string")
    assert [r[0] for r in d.select(T.biolink_type(F.col("o"), F.col("n"))).collect()] == ["BiologicalProcess", "BiologicalProcess", "Disease", "NamedThing"]
    assert [r[0] for r in spark.createDataFrame([("disease", "mondo"), ("disease", "go"), ("odd", "go")], "t string, o string").select(T.accepts_type(F.col("t"), F.col("o"))).collect()] == [True, False, True]

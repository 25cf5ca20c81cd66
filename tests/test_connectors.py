from helpers import rows
from pyspark.sql import functions as F

from quillgraph.sinks import files as S
from quillgraph.sources import connectors as C


def test_pluggable_readers(spark, tmp_path):
    def fetch(u):
        if "bad" in u:
            raise OSError
        return f"<p>{u}</p>"

    urls = spark.createDataFrame([("a",), ("bad",), ("a",), (None,)], "link string")
    assert rows(C.fetch_pages(urls, "link", fetch)) == [("a", "<p>a</p>"), ("bad", None)]
    (tmp_path / "x.bin").write_bytes(b"one|two")
    (tmp_path / "y.bin").write_bytes(b"\xff")
    got = C.read_binary_texts(spark, str(tmp_path / "*.bin"), lambda b: b.decode("utf-8").split("|"))
    assert rows(got, "page_no", "text") == [(0, "one"), (1, "two")]
    found = C.search_literature(spark, ["q1", "q2"], lambda q, n: [{"pmid": 1, "title": q}] * min(n, 2), 1)
    assert rows(found, "query", "pmid", "abstract") == [("q1", "1", None), ("q1", "1", None), ("q2", "1", None), ("q2", "1", None)] or found.count() == 2


def test_lists_and_schemas(spark, tmp_path):
    (tmp_path / "stop.txt").write_text("# list\nThe\n\nof\nthe\n")
    assert rows(C.read_word_list(spark, str(tmp_path / "stop.txt"))) == [("of",), ("the",)]
    (tmp_path / "s.json").write_text('{"type":"object","required":["iri"],"properties":{"iri":{"type":"string"},"n":{"type":"integer"},"syn":{"type":"array","items":{"type":"string"}},"ann":{"type":"object"}}}')
    t = C.read_json_schema(spark, str(tmp_path / "s.json"))
    assert t.simpleString() == "struct<iri:string,n:bigint,syn:array<string>,ann:map<string,string>>" and not t["iri"].nullable


def test_file_sinks(spark, tmp_path):
    p = str(tmp_path)
    d = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    S.write_graph(d, d, f"{p}/g")
    assert rows(S.read_graph(spark, f"{p}/g")[1]) == [("a", 1), ("b", 2)]
    S.append_csv(d, f"{p}/c")
    S.append_csv(d, f"{p}/c")
    assert spark.read.option("header", True).csv(f"{p}/c").count() == 4
    S.write_per_document(d, "k", f"{p}/d")
    assert (tmp_path / "d" / "k=a").exists()
    S.write_metrics(spark.createDataFrame([("MICRO", 1.0), ("a", 0.5)], "label string, f1 double"), f"{p}/m")
    assert [r[0] for r in spark.read.option("header", True).csv(f"{p}/m").collect()] == ["a", "MICRO"]
    S.write_lines(d, "v", f"{p}/t")
    assert rows(spark.read.text(f"{p}/t").select(F.col("value"))) == [("1",), ("2",)]

import re
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"


def test_core_does_not_import_the_optional_package():
    for p in (ROOT / "quillgraph").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"quillgraph\.llm|from quillgraph import llm", p.read_text()), p


@pytest.mark.skipif(not Path(DATA).exists(), reason="test tables are not here")
@pytest.mark.parametrize("name", ["scored_search", "parents_children", "evidence_score", "classifier_report", "svo_extract", "p5_found", "p5_descendants", "explore_depth_first", "connecting_paths",
                                  "two_hop_paths", "phrase_match", "enriched_text", "bootstrap", "sample_report", "label_codes", "unseen_documents"])
def test_queries_match_sql(spark, name):
    import __spark_entry__ as entry

    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(str(tuple(r)) for r in df.select(*cols).collect())
    res = con.execute(entry.oracle_sql()[name])
    order = [[d[0] for d in res.description].index(c) for c in cols]
    assert got == sorted(str(tuple(r[i] for i in order)) for r in res.fetchall())

import pytest

pytest.importorskip("quillgraph.llm.plans")

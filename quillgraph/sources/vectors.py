"""Stored vectors and triples: NumPy archives, word2vec binaries, RDF/XML."""

from __future__ import annotations

import io
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_RDF = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}"
_XML_BASE = "{http://www.w3.org/XML/1998/namespace}base"
#: Rows in a batch that leaves a reader.
_ROWS = 10_000


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_npz(spark: SparkSession, path: str, ids: str = "ids", vectors: str = "embs") -> DataFrame:
    """``id, vector`` of NumPy archives that hold an array of ids and a matrix; one file per task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    names, matrix = z[ids], z[vectors]
                    for k in range(0, len(names), _ROWS):
                        yield pd.DataFrame({"id": [str(x) for x in names[k:k + _ROWS]], "vector": matrix[k:k + _ROWS].astype(np.float32).tolist()})

    return _files(spark, path).mapInPandas(run, "id string, vector array<float>")


def read_word2vec(spark: SparkSession, path: str) -> DataFrame:
    """``id, vector`` of word2vec binaries: a line with count and length, then words, each with a blank and its floats."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                head = content.index(b"\n")
                n, size = map(int, content[:head].split())
                at, words, vectors = head + 1, [], []
                for _ in range(n):
                    blank = content.index(b" ", at)
                    words.append(content[at:blank].lstrip(b"\n").decode("utf-8", "replace"))
                    vectors.append(np.frombuffer(content, "<f4", size, blank + 1).tolist())
                    at = blank + 1 + 4 * size
                    if len(words) == _ROWS:
                        yield pd.DataFrame({"id": words, "vector": vectors})
                        words, vectors = [], []
                yield pd.DataFrame({"id": words, "vector": vectors})

    return _files(spark, path).mapInPandas(run, "id string, vector array<float>")


def _triples(content: bytes) -> Iterator[tuple[str, str, str, str]]:
    """(subject, predicate, object, kind) of one RDF/XML document, nested descriptions and blank nodes included."""
    root = ElementTree.fromstring(content)
    base = root.get(_XML_BASE, "")
    blank = [0]

    def iri(value: str) -> str:
        return value if "://" in value or value.startswith("urn:") else base + value

    def name(tag: str) -> str:
        return tag[1:].replace("}", "") if tag.startswith("{") else tag

    def node(e) -> tuple[str, str]:
        about, ident = e.get(f"{_RDF}about"), e.get(f"{_RDF}ID")
        if about is not None:
            return iri(about), "iri"
        if ident is not None:
            return iri(f"#{ident}"), "iri"
        blank[0] += 1
        return f"_:{e.get(f'{_RDF}nodeID') or f'b{blank[0]}'}", "bnode"

    todo = [(e, *node(e)) for e in root]
    while todo:
        e, subject, _ = todo.pop()
        if e.tag != f"{_RDF}Description":
            yield subject, name(f"{_RDF}type"), name(e.tag), "iri"
        for p in e:
            resource, blank_id = p.get(f"{_RDF}resource"), p.get(f"{_RDF}nodeID")
            if resource is not None:
                yield subject, name(p.tag), iri(resource), "iri"
            elif blank_id is not None:
                yield subject, name(p.tag), f"_:{blank_id}", "bnode"
            elif len(p):
                for inner in p:
                    ident, kind = node(inner)
                    yield subject, name(p.tag), ident, kind
                    todo.append((inner, ident, kind))
            else:
                yield subject, name(p.tag), p.text or "", "literal"


def read_rdf_xml(spark: SparkSession, path: str) -> DataFrame:
    """``s, p, o, o_kind``: triples of RDF/XML files, one file per task; blank nodes are named by file; a damaged file gives no triple."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, content in zip(b["path"], b["content"], strict=True):
                try:
                    rows = list(_triples(bytes(content)))
                except ElementTree.ParseError:
                    continue
                own = lambda x: f"{x}@{file.rsplit('/', 1)[-1]}" if x.startswith("_:") else x  # noqa: B023, E731
                for k in range(0, len(rows), _ROWS):
                    yield pd.DataFrame([(own(s), p, own(o) if kind == "bnode" else o, kind) for s, p, o, kind in rows[k:k + _ROWS]], columns=["s", "p", "o", "o_kind"])

    return _files(spark, path).mapInPandas(run, "s string, p string, o string, o_kind string")

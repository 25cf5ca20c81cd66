"""Frequency of every distinct term by burst-trie counting.

1. JVM side: rows are normalised and reduced to distinct (field, term, record)
   with their row counts; the map-side combine removes hot repetitions before
   the only large shuffle, whose key includes the record and so cannot be hot.
2. Every task counts its share in a burst trie: containers of suffixes that
   burst into a node once they hold too many terms.  Only its compact leaves
   (prefix, suffixes, counters) leave the task.
3. Prefixes that are over-full across all workers are found from the leaves;
   a term's route is its shortest prefix that is not over-full.  Routes adapt to
   the data, so a popular prefix is split further than a rare one, and no route
   merges more than a fixed number of terms, whatever the size of the vocabulary.
4. Leaves are cut by route, shuffled by it, and matching subtrees are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.session import Scratch

#: A container bursts once it holds more terms than this.
BURST = 512
#: A prefix is over-full beyond its 1/ROUTES share of all terms, or beyond ROUTE_TERMS (a trie of about 200 MB in one task): the
#: routing table has at most ROUTES prefixes per level up to ROUTES * ROUTE_TERMS leaf terms, and one per ROUTE_TERMS beyond.
ROUTES, ROUTE_TERMS = 4096, 1_000_000

_LEAF = pa.schema([("field", pa.string()), ("prefix", pa.string()), ("suffixes", pa.list_(pa.string())),
                   ("n_rows", pa.list_(pa.int64())), ("n_docs", pa.list_(pa.int64()))])
_LEAF_DDL = "field string, prefix string, suffixes array<string>, n_rows array<bigint>, n_docs array<bigint>"
_TERM_DDL = "field string, term string, n_rows bigint, n_docs bigint"


class BurstTrie:
    """Counters per term; nodes are dicts by first character, containers dicts by suffix."""

    __slots__ = ("root", "limit")

    def __init__(self, limit: int = BURST):
        self.root: Container | Node = Container()
        self.limit = limit

    def add(self, term: str, rows: int, docs: int) -> None:
        at, parent, i = self.root, None, 0
        while type(at) is Node:
            if i == len(term):
                at.rows += rows
                at.docs += docs
                return
            parent, key = at, term[i]
            i += 1
            nxt = at.kids.get(key)
            if nxt is None:
                nxt = at.kids[key] = Container()
            at = nxt
        held = at.held
        counter = held.get(suffix := term[i:])
        if counter is None:
            held[suffix] = [rows, docs]
            if len(held) > self.limit:
                node = Node()
                for s, (r, d) in held.items():
                    if s:
                        kid = node.kids.get(s[0])
                        if kid is None:
                            kid = node.kids[s[0]] = Container()
                        kid.held[s[1:]] = [r, d]
                    else:
                        node.rows, node.docs = r, d
                if parent is None:
                    self.root = node
                else:
                    parent.kids[key] = node
        else:
            counter[0] += rows
            counter[1] += docs

    def leaves(self) -> Iterator[tuple[str, dict]]:
        """(prefix, {suffix: [rows, docs]}) for every container, and for terms that end on a node."""
        stack = [("", self.root)]
        while stack:
            prefix, at = stack.pop()
            if type(at) is Container:
                if at.held:
                    yield prefix, at.held
            else:
                if at.rows:
                    yield prefix, {"": [at.rows, at.docs]}
                stack.extend((prefix + c, kid) for c, kid in at.kids.items())


class Container:
    __slots__ = ("held",)

    def __init__(self):
        self.held: dict[str, list[int]] = {}


class Node:
    __slots__ = ("kids", "rows", "docs")

    def __init__(self):
        self.kids: dict = {}
        self.rows = self.docs = 0


def _leaf_batch(field: str, leaves) -> Iterator[pa.RecordBatch]:
    rows: list[list] = [[], [], [], [], []]
    for prefix, held in leaves:
        for out, v in zip(rows, (field, prefix, list(held), [c[0] for c in held.values()], [c[1] for c in held.values()]), strict=True):
            out.append(v)
        if len(rows[0]) >= 1024:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(rows, _LEAF, strict=True)], schema=_LEAF)
            rows = [[], [], [], [], []]
    if rows[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(rows, _LEAF, strict=True)], schema=_LEAF)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tries: dict[str, BurstTrie] = {}
    for b in batches:
        for field, term, rows, docs in zip(*(b.column(c).to_pylist() for c in ("field", "term", "n_rows", "n_docs")), strict=True):
            trie = tries.get(field)
            if trie is None:
                trie = tries[field] = BurstTrie()
            trie.add(term, rows, docs)
    for field, trie in tries.items():
        yield from _leaf_batch(field, trie.leaves())


def route_of(term: str, overfull: set[str] | frozenset[str]) -> str:
    """Shortest prefix of ``term`` that is not over-full; a term that is itself over-full is its own route."""
    for i in range(len(term) + 1):
        if term[:i] not in overfull:
            return term[:i]
    return term


def _router(overfull: dict[str, frozenset[str]]):
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for field, prefix, suffixes, rows, docs in zip(*(b.column(c).to_pylist() for c in _LEAF.names), strict=True):
                full = overfull.get(field, frozenset())
                parts: dict[str, dict] = {}
                for s, r, d in zip(suffixes, rows, docs, strict=True):
                    parts.setdefault(route_of(prefix + s, full), {})[prefix + s] = (r, d)
                yield from _leaf_batch(field, parts.items())
    return route


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the subtrees of one route after the other (rows come sorted by field and route)."""
    current, trie = None, BurstTrie()

    def flush():
        terms, rows, docs = [], [], []
        for prefix, held in trie.leaves():
            for s, (r, d) in held.items():
                terms.append(prefix + s)
                rows.append(r)
                docs.append(d)
        if terms:
            yield pa.RecordBatch.from_pydict({"field": [current[0]] * len(terms), "term": terms, "n_rows": rows, "n_docs": docs})

    for b in batches:
        for field, route, terms, rows, docs in zip(*(b.column(c).to_pylist() for c in _LEAF.names), strict=True):
            if (field, route) != current:
                if current is not None:
                    yield from flush()
                current, trie = (field, route), BurstTrie()
            for t, r, d in zip(terms, rows, docs, strict=True):
                trie.add(t, r, d)
    if current is not None:
        yield from flush()


def normalised_term(col: Column) -> Column:
    """Lower case, every run of characters that are neither letters nor digits one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(col), r"[^\p{L}\p{N}]+", " "))


def term_frequencies(sources: list[tuple[str, DataFrame, str, str]], rare_docs: int = 2, common_share: float = 0.05,
                     term: object = normalised_term) -> DataFrame:
    """Rows, records and mark of every distinct term of every field.

    ``sources``: (field name, table, value column, record column).  ``term`` maps
    the value column to the counted term (pass ``lambda c: c`` for raw values).
    Result: ``field, term, n_rows, n_docs, mark``; mark is ``rare`` if at most
    ``rare_docs`` records hold the term, ``common`` if more than ``common_share`` of
    the records that hold any term of the field do, else null (rare wins).

    Null values and values without a letter or digit give no term.  A row with a
    null record counts as a row but in no record.  Repeated rows count as rows.
    Empty tables give no rows; other columns, whatever their names, are not read.
    """
    spark = sources[0][1].sparkSession
    scratch = Scratch(spark, "terms")
    long = None
    for field, df, value, record in sources:
        part = df.select(F.lit(field).alias("field"), term(F.col(value)).alias("term"), F.col(record).cast("string").alias("rec"))
        long = part if long is None else long.unionByName(part)
    long = long.where("term is not null and term <> ''")
    pairs = long.groupBy("field", "term", "rec").agg(F.count("*").alias("n_rows")).select(
        "field", "term", "n_rows", F.when(F.col("rec").isNull(), 0).otherwise(1).cast("long").alias("n_docs"))
    leaves = scratch.keep(pairs.mapInArrow(_count, _LEAF_DDL))

    sizes = leaves.select("field", "prefix", F.size("suffixes").alias("n"))
    per_field = sizes.groupBy("field").agg(F.sum("n").alias("n"))
    # n terms under the prefix and all its ancestors
    under = sizes.select("field", "n", F.explode(F.transform(F.sequence(F.lit(0), F.length("prefix")), lambda i: F.substring("prefix", F.lit(1), i))).alias("p"))
    under = under.groupBy("field", "p").agg(F.sum("n").alias("under"))
    over = under.join(F.broadcast(per_field), "field").where(F.col("under") > F.greatest(F.lit(BURST), F.least(F.lit(ROUTE_TERMS), F.col("n") / ROUTES)))
    table: dict[str, set[str]] = {}
    for r in over.select("field", "p").collect():
        table.setdefault(r.field, set()).add(r.p)
    overfull = {k: frozenset(v) for k, v in table.items()}

    routed = leaves.mapInArrow(_router(overfull), _LEAF_DDL)
    merged = routed.repartition(F.col("field"), F.col("prefix")).sortWithinPartitions("field", "prefix").mapInArrow(_merge, _TERM_DDL)
    records = long.groupBy("field").agg(F.count_distinct("rec").alias("records"))  # one row per field
    return merged.join(F.broadcast(records), "field").select(
        "field", "term", "n_rows", "n_docs",
        F.when(F.col("n_docs") <= rare_docs, "rare").when(F.col("n_docs") > F.lit(common_share) * F.col("records"), "common").alias("mark"))

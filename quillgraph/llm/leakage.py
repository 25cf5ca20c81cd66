"""Evaluation texts that leaked into a corpus.

Method: latent semantic retrieval.
1. One pass counts in how many documents each word of the evaluation items
   occurs (all documents, long ones in parts; only the items' words are kept).
2. A randomised SVD of TF-IDF passages gives the latent space.  It is fitted on
   the items' passages and a bounded, documented sample of corpus passages by
   distributed power iteration: tasks add up sketches A'(AQ), the driver only
   orthonormalises a words-by-rank matrix.
3. One pass over all documents projects every passage and searches the items'
   passages by cosine; every hit is a candidate.  A run that covers only part of
   a passage can stay below the cosine threshold, so every document that shares
   enough word triples with an item, looked up in an index of the items' triples,
   is a candidate as well.  The items are a stated query set and travel to the
   tasks in blocks of bounded size, several blocks in one pass.
4. Candidates are verified in place: content words are aligned by longest common
   subsequence, the aligned span is compared word by word, and the share of the
   item's words found in order decides.  A paraphrase, which shares no word runs
   with the item, counts if a third of the item's content words stand in order in
   the passage or if the item's answer is given with it.

No shuffle grows with the corpus apart from per-task counters.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.session import Scratch

#: Words per passage and step between passages, for documents and items alike.
WINDOW, STEP = 32, 16
#: Latent dimensions (and extra ones for the random sketch).
RANK, EXTRA = 128, 8
#: Words are counted by documents; one of more words counts as several of about equal length, as long texts hold nearly every word.
COUNT_WORDS = 1_024
#: Words held by more than this share of the documents carry no weight.
MAX_DOC_SHARE = 0.2
#: Words in at most this share of the documents are content words, the anchors of verification.
CONTENT_SHARE = 0.05
#: Candidate threshold on the damped cosine, and the damping norm as a share of the items' median.
MIN_COSINE, DAMPING = 0.6, 0.8
#: A document that shares this many distinct word triples, as a share of the item's words, is a candidate whatever its cosine.
MIN_TRIPLES = 0.15
#: Share of an item's content words that a passage without common word runs must hold in order, unless it gives the item's answer.
MIN_PARAPHRASE = 1 / 3
#: Document words between two anchors of one passage.
MAX_GAP = 40
#: Corpus documents in the sample that the latent space is fitted on.
FIT_DOCS = 5_000
#: Items per block (about 40 MB in a task), and blocks that one pass over the corpus searches.
ITEM_BLOCK, PASS_BLOCKS = 2_000, 8
#: Documents, bytes of text and words that a task works on at a time; they bound its memory, not what is searched.
SLICE_DOCS, SLICE_BYTES, PIECE = 256, 2_000_000, 65_536
#: Share of an item's words that one passage must reproduce.
MIN_SHARE = 1 / 3

_WORD = re.compile(r"[^\W_]+")
_HTML = re.compile(r"&(?:amp|lt|gt|quot|nbsp|#\d+);|<[^<>]{1,40}>|[­​]")


def words(text: str) -> list[str]:
    """Words without case, formatting and markup."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    if "&" in text or "<" in text or "­" in text or "​" in text:
        text = _HTML.sub(lambda m: "" if m.group() in "­​" else " ", text)
    return _WORD.findall(text.casefold())


def _starts(n: int) -> int:
    """Number of passages of a text of n words."""
    return max(1, -(-max(0, n - WINDOW) // STEP) + 1)


def passages(texts: list[np.ndarray], keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse passages of texts given as word ids (-1 unknown): (passage, word) pairs sorted by passage, owner and start of each passage."""
    if not texts:
        z = np.zeros(0, np.int64)
        return z, z, z, z
    lens = np.array([len(t) for t in texts], np.int64)
    flat = np.concatenate(texts) if lens.sum() else np.zeros(0, np.int32)
    owner_of = np.repeat(np.arange(len(texts)), lens)
    pos = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
    n_pass = np.array([_starts(n) for n in lens], np.int64)
    base = np.cumsum(n_pass) - n_pass
    ok = (flat >= 0) & keep[np.maximum(flat, 0)]
    w, o, p = flat[ok], owner_of[ok], pos[ok]
    rows, cols = [], []
    for back in range(WINDOW // STEP):
        k = p // STEP - back
        fits = (k >= 0) & (k < n_pass[o])
        rows.append(base[o[fits]] + k[fits])
        cols.append(w[fits])
    r, c = np.concatenate(rows), np.concatenate(cols)
    order = np.argsort(r, kind="stable")
    owner = np.repeat(np.arange(len(texts)), n_pass)
    start = (np.arange(n_pass.sum()) - np.repeat(base, n_pass)) * STEP
    return r[order], c[order], owner, start


def pieces(texts: list[np.ndarray]) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """Groups of (text, start, words) of about ``PIECE`` words; a longer text is cut so that its passages stay the same."""
    group, n = [], 0
    for k, x in enumerate(texts):
        for lo in range(0, max(1, len(x) - (WINDOW - STEP)), PIECE):
            part = x[lo:lo + PIECE + WINDOW - STEP]
            if group and n + len(part) > PIECE:
                yield group
                group, n = [], 0
            group.append((k, lo, part))
            n += len(part)
    if group:
        yield group


def _slices(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of at most ``SLICE_DOCS`` rows and, unless it is one row, ``SLICE_BYTES``."""
    upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < len(texts):
        most = SLICE_BYTES + (int(upto[lo - 1]) if lo else 0)
        hi = max(lo + 1, min(lo + SLICE_DOCS, int(np.searchsorted(upto, most, side="right"))))
        yield lo, texts.slice(lo, hi - lo).to_pylist()
        lo = hi


def gather(rows: np.ndarray, cols: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(passages that have words, sum of the matrix rows of their words)."""
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros((0, matrix.shape[1]), np.float32)
    cut = np.flatnonzero(np.diff(rows)) + 1
    first = np.concatenate([[0], cut])
    return rows[first], np.add.reduceat(matrix[cols], first, axis=0)


def sums(rows: np.ndarray, cols: np.ndarray, matrix: np.ndarray, n: int) -> np.ndarray:
    """Sum of the matrix rows of the words of each of ``n`` cells; ``rows`` sorted.  The k-th words of all cells are added at once."""
    out = np.zeros((n, matrix.shape[1]), matrix.dtype)
    if len(rows):
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        order = np.argsort(rank, kind="stable")
        ends = np.cumsum(np.bincount(rank))
        for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            out[rows[order[lo:hi]]] += matrix[cols[order[lo:hi]]]
    return out


class Items:
    """One block of evaluation items as word ids, with what verification needs."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids = [r[0] for r in rows]
        self.words = [words(r[1]) for r in rows]
        self.vocab = {w: i for i, w in enumerate(dict.fromkeys(w for ws in self.words for w in ws))}
        self.coded = [np.array([self.vocab[w] for w in ws], np.int32) for ws in self.words]
        self.answers = [words(m.group(1)) if (m := re.search(r"\banswer:\s*(.+?)\s*$", r[1], re.I | re.S)) else [] for r in rows]

    def encode(self, text: str) -> np.ndarray:
        return self.codes(words(text))

    def codes(self, tokens: list[str]) -> np.ndarray:
        return np.fromiter(map(self.vocab.get, tokens, repeat(-1)), np.int32, len(tokens))


def _doc_counter(vocab: dict[str, int]):
    """Per task: in how many documents (long ones in parts) each word of ``vocab`` occurs, as word -1 the number of these, as word -2 that of whole documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        known, n, whole = vocab.keys(), 0, 0
        for b in batches:
            for _, texts in _slices(b.column(0)):
                for text in texts:
                    found = words(text)
                    parts = max(1, -(-len(found) // COUNT_WORDS))
                    size = -(-len(found) // parts)
                    for k in range(parts):
                        seen.update(known & set(found[k * size:(k + 1) * size]))
                    n += parts
                whole += len(texts)
        hit = list(seen)
        yield pa.RecordBatch.from_pydict({"word": pa.array([*(vocab[w] for w in hit), -1, -2], pa.int32()), "n": pa.array([*(seen[w] for w in hit), n, whole], pa.int64())})
    return run


def _encoder(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, texts in _slices(b.column(0)):
                coded = [items.encode(t) for t in texts]
                ends = np.cumsum([0, *map(len, coded)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(coded)))], names=["w"])
    return run


def _sketcher(keep: np.ndarray, idf: np.ndarray, q: np.ndarray, rows_per_block: int):
    """Per task: A'(AQ) of its passages, cut into blocks of vocabulary rows."""
    scaled = idf[:, None] * q

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(scaled.shape, np.float32)
        for b in batches:
            ends = b.column(0).offsets.to_numpy()
            flat = b.column(0).values.to_numpy()
            for group in pieces([flat[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]):
                r, c, _, _ = passages([x for _, _, x in group], keep)
                if len(r):
                    total += back_project(r, c, scaled, idf)
        for k in range(0, len(total), rows_per_block):
            yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "data": pa.array([total[k:k + rows_per_block].tobytes()], pa.binary())})
    return run


def back_project(r: np.ndarray, c: np.ndarray, scaled: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """A'(AQ) for sparse passages (r, c) with weights idf."""
    have, z = gather(r, c, scaled)
    order = np.argsort(c, kind="stable")
    row = np.searchsorted(have, r)[order]
    word = c[order]
    out = np.zeros(scaled.shape, np.float32)
    first = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
    for a in range(0, len(first), 4096):  # bounded memory
        lo, hi = first[a], first[a + 4096] if a + 4096 < len(first) else len(word)
        part = np.add.reduceat(z[row[lo:hi]], first[a:a + 4096] - lo, axis=0)
        out[word[first[a:a + 4096]]] = part * idf[word[first[a:a + 4096]], None]
    return out


def _add_blocks(pdf):
    import pandas as pd

    total = None
    for data in pdf["data"]:
        x = np.frombuffer(data, np.float32)
        total = x.copy() if total is None else total + x
    return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "data": [total.tobytes()]})


def fit_space(encoded: DataFrame, items: Items, keep: np.ndarray, idf: np.ndarray, rank: int = RANK, rounds: int = 2, seed: int = 7) -> np.ndarray:
    """Word vectors (words x rank) of the latent space by distributed randomised power iteration."""
    n_words = len(idf)
    rank = min(rank, n_words)
    width = min(n_words, rank + EXTRA)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((n_words, width)))[0].astype(np.float32)
    ir, ic, _, _ = passages(items.coded, keep)
    rows_per_block = max(1, 65_536 // width)
    y = q
    for _ in range(rounds):
        parts = encoded.mapInArrow(_sketcher(keep, idf, q, rows_per_block), "block int, data binary").groupBy("block").applyInPandas(
            _add_blocks, "block int, data binary").collect()  # words x width in all
        y = np.zeros((n_words, width), np.float32)
        for p in parts:
            x = np.frombuffer(p["data"], np.float32).reshape(-1, width)
            y[p["block"]:p["block"] + len(x)] = x
        if len(ir):
            y += back_project(ir, ic, idf[:, None] * q, idf)
        q = np.linalg.qr(y)[0].astype(np.float32)
    # singular directions inside the range: Q' A'A Q is small
    inner = q.T @ y if rounds else np.eye(width, dtype=np.float32)
    u, _, _ = np.linalg.svd(inner)
    return (idf[:, None] * (q @ u[:, :rank])).astype(np.float32)


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence (bit-parallel)."""
    masks: dict = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        m = masks.get(y)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


def _anchors(where: dict[int, list[int]], doc: list[int]) -> list[tuple[int, int]]:
    """Best chain of matching content words: (item position, document position), gaps of similar length on both sides.

    ``where``: positions of the item's content words.
    """
    cells = [(j, i) for j, y in enumerate(doc) if y in where for i in where[y]]
    best: list[int] = []
    back: list[int] = []
    for n, (j, i) in enumerate(cells):
        s, frm = 1, -1
        for m in range(n - 1, -1, -1):
            j2, i2 = cells[m]
            if j - j2 > MAX_GAP:
                break
            if i2 < i and j2 < j and best[m] >= s and abs((j - j2) - (i - i2)) <= 4 + (i - i2) // 4:
                s, frm = best[m] + 1, m
        best.append(s)
        back.append(frm)
    if not best:
        return []
    n = max(range(len(best)), key=best.__getitem__)
    chain = []
    while n >= 0:
        chain.append((cells[n][1], cells[n][0]))
        n = back[n]
    return chain[::-1]


def content_positions(item: np.ndarray, keep: np.ndarray) -> dict[int, list[int]]:
    where: dict[int, list[int]] = {}
    for i, x in enumerate(item.tolist()):
        if keep[x]:
            where.setdefault(x, []).append(i)
    return where


def reproduced(item: list[int], doc: list[int], where: dict[int, list[int]], least: float = 0) -> tuple[int, int, int]:
    """(words of the item found in order in one passage of ``doc``, start, end of the passage); ``where``: the item's content words.

    No word counts if both sides of the passage are too short for ``least`` words.
    """
    chain = _anchors(where, doc)
    if not chain:
        return 0, 0, 0
    (i0, j0), (i1, j1) = chain[0], chain[-1]

    def extend(i: int, j: int, step: int) -> tuple[int, int]:
        """Go on while words agree; a few small edits are stepped over."""
        gi, gj, misses = i, j, 0
        while True:
            i += step
            j += step
            if not (0 <= i < len(item) and 0 <= j < len(doc)):
                break
            if item[i] == doc[j]:
                gi, gj, misses = i, j, 0
                continue
            for di, dj in ((1, 0), (0, 1), (2, 1), (1, 2)):
                x, y = i + step * di, j + step * dj
                if 0 <= x < len(item) and 0 <= y < len(doc) and item[x] == doc[y]:
                    i, j = x, y
                    break
            misses += 1
            if misses > 2:
                break
            if item[i] == doc[j]:
                gi, gj = i, j
        return gi, gj

    i0, j0 = extend(i0, j0, -1)
    i1, j1 = extend(i1, j1, 1)
    if min(i1 - i0, j1 - j0) + 1 < least:
        return 0, j0, j1 + 1
    return common_subsequence(item[i0:i1 + 1], doc[j0:j1 + 1]), j0, j1 + 1


def longest_run(a: list, b: list) -> int:
    """Length of the longest common run of consecutive words."""
    where: dict = {}
    for i, x in enumerate(a):
        where.setdefault(x, []).append(i)
    best, last = 0, {}
    for y in b:
        last = {i: last.get(i - 1, 0) + 1 for i in where.get(y, ())}
        best = max(best, max(last.values(), default=0))
    return best


def telling(item: np.ndarray, passage: np.ndarray, content: np.ndarray, min_share: float) -> bool:
    """Whether a passage holds more of the item than a phrase pattern: a run of half of ``min_share`` of its words, or half of the passage's content words (words that no item has count)."""
    if longest_run(item.tolist(), passage.tolist()) >= min_share / 2 * len(item):
        return True
    rare = passage[(passage < 0) | content[np.maximum(passage, 0)]]
    return common_subsequence(item[content[item]].tolist(), rare.tolist()) >= len(rare) / 2


def _triples(x: np.ndarray, base: int) -> list[int]:
    """Codes of the consecutive known word triples."""
    x = x.astype(np.int64)
    a, b, c = x[:-2], x[1:-1], x[2:]
    return ((a * base + b) * base + c)[(a >= 0) & (b >= 0) & (c >= 0)].tolist()


class TripleIndex:
    """Items by word triple: sorted distinct codes and, for each, the items that hold it."""

    def __init__(self, triples: list[frozenset[int]], base: int):
        self.base, self.n_items = base, len(triples)
        code = np.array([t for ts in triples for t in ts], np.int64)
        item = np.repeat(np.arange(len(triples)), [len(ts) for ts in triples])
        order = np.argsort(code, kind="stable")
        self.codes, self.first, self.count = np.unique(code[order], return_index=True, return_counts=True)
        self.items = item[order]

    def shared(self, coded: list[np.ndarray], least: np.ndarray) -> dict[tuple[int, int], list[int]]:
        """Positions of the shared triples of every (document, item) with at least ``least[item]`` distinct ones."""
        gap = np.full(2, -1, np.int32)  # no triple crosses two documents
        flat = np.concatenate([y for x in coded for y in (x, gap)])
        lens = np.array([len(x) + 2 for x in coded], np.int64)
        base = np.cumsum(lens) - lens
        if not len(self.codes):
            return {}
        hits = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for lo in range(0, len(flat) - 2, PIECE):
            x = flat[lo:lo + PIECE + 2].astype(np.int64)
            a, b, c = x[:-2], x[1:-1], x[2:]
            pos = np.flatnonzero((a >= 0) & (b >= 0) & (c >= 0))
            code = (a[pos] * self.base + b[pos]) * self.base + c[pos]
            k = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            known = self.codes[k] == code
            hits.append((lo + pos[known], k[known]))
        pos, k = (np.concatenate(x) for x in zip(*hits, strict=True))
        if not len(pos):
            return {}
        n = self.count[k]
        row = np.repeat(np.arange(len(k)), n)
        item = self.items[self.first[k][row] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        doc = (np.searchsorted(base, pos, side="right") - 1)[row]
        pos, k = pos[row], k[row]
        pair = doc * self.n_items + item
        # a pair has no more distinct triples than positions
        many = np.bincount(pair, minlength=len(coded) * self.n_items)[pair] >= least[item]
        pos, k, doc, pair = pos[many], k[many], doc[many], pair[many]
        if not len(pos):
            return {}
        order = np.argsort(pair * len(self.codes) + k, kind="stable")
        new_pair = np.flatnonzero(np.diff(pair[order], prepend=-1))
        new_code = np.diff(k[order], prepend=-1) != 0
        new_code[new_pair] = True
        distinct = np.add.reduceat(new_code.astype(np.int64), new_pair) if len(new_pair) else new_pair
        out = {}
        for lo, hi, m in zip(new_pair.tolist(), [*new_pair[1:].tolist(), len(order)], distinct.tolist(), strict=True):
            d, i = divmod(int(pair[order[lo]]), self.n_items)
            if m >= least[i]:
                out[d, i] = np.sort(pos[order[lo:hi]] - base[d]).tolist()
        return out


class WordIndex:
    """Sets of words by word."""

    def __init__(self, sets: list[frozenset[int]], base: int):
        word = np.array([w for x in sets for w in x], np.int64)
        order = np.argsort(word, kind="stable")
        self.first = np.searchsorted(word[order], np.arange(base + 1))
        self.owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])[order]
        self.size = np.array([len(x) for x in sets], np.int64)

    def held(self, doc: np.ndarray, word: np.ndarray, n_docs: int) -> np.ndarray:
        """Documents by sets: how many words of the set the document holds; (doc, word) without repeats."""
        n = self.first[word + 1] - self.first[word]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - self.first[word], n)
        pair = np.repeat(doc, n) * len(self.size) + self.owner[at]
        return np.bincount(pair, minlength=n_docs * len(self.size)).reshape(n_docs, -1)


class Search:
    """One block of items with its latent space, ready to search documents."""

    def __init__(self, items: Items, keep: np.ndarray, content: np.ndarray, space: np.ndarray, min_share: float):
        self.items, self.keep, self.content, self.space, self.min_share = items, keep, content, space, min_share
        ir, ic, owner, _ = passages(items.coded, keep)
        have, z = gather(ir, ic, space)
        norm = np.linalg.norm(z, axis=1)
        self.damp = DAMPING * float(np.median(norm)) if len(norm) else 1.0
        self.queries = np.ascontiguousarray((z / np.maximum(norm, self.damp)[:, None]).T)
        self.owner = owner[have] if len(have) else owner
        self.base = len(items.vocab)
        self.index = TripleIndex([frozenset(_triples(x, self.base)) for x in items.coded], self.base)
        self.least = np.array([MIN_TRIPLES * len(x) for x in items.coded])
        self.lists = [x.tolist() for x in items.coded]
        self.where = [content_positions(x, content) for x in items.coded]
        self.rare = [x[content[x]] for x in items.coded]
        self.rare_sets = [frozenset(x.tolist()) for x in self.rare]
        self.rare_index = WordIndex(self.rare_sets, self.base)
        self.answers = [[items.vocab[w] for w in a] for a in items.answers]
        self.answer_sets = [frozenset(a) for a in self.answers]
        self.answer_index = WordIndex(self.answer_sets, self.base)
        self.need = np.array([MIN_PARAPHRASE * len(x) for x in self.rare])
        self.repeats = np.array([len(x) - len(y) for x, y in zip(self.rare, self.rare_sets, strict=True)])
        self.reach = [len(x) + len(x) // 3 for x in items.coded]
        self.far = max(self.reach, default=0)

    def leaks(self, tokens: list[list[str]]) -> Iterator[tuple[int, int, int, float, bool]]:
        """(document, item, words, share, answer) of every leak; documents and items by position."""
        coded = [self.items.codes(x) for x in tokens]
        literal = self.index.shared(coded, self.least)
        wanted = may = self._may_paraphrase(coded)
        if literal:
            wanted = may.copy()
            wanted[tuple(np.array(list(literal)).T)] = True
        near = self._near(coded, wanted)
        for pair, starts in literal.items():
            hit = self._literal(pair, coded[pair[0]], starts, near.get(pair))
            if hit:
                yield *pair, *hit
        around: dict[tuple[int, int], frozenset] = {}
        for pair, starts in near.items():
            if pair in literal or not may[pair]:
                continue
            hit = self._paraphrase(pair, coded[pair[0]], starts, around)
            if hit:
                yield *pair, *hit

    def _may_paraphrase(self, coded: list[np.ndarray]) -> np.ndarray:
        """Documents by items: whether the document holds enough of the item's content words, or its whole answer: a bound that loses nothing."""
        holds = np.zeros((len(coded), self.base), bool)
        for k, x in enumerate(coded):
            holds[k, x[x >= 0]] = True
        doc, word = np.nonzero(holds)
        rare = self.rare_index.held(doc, word, len(coded))
        told = self.answer_index.held(doc, word, len(coded))
        n = self.answer_index.size
        return (rare > 0) & (rare + self.repeats >= self.need) | (n > 0) & (told == n)

    def _near(self, coded: list[np.ndarray], wanted: np.ndarray) -> dict[tuple[int, int], list[int]]:
        """Starts of the passages whose cosine with a passage of the item is above the threshold, by (document, item), of the wanted pairs."""
        near: dict[tuple[int, int], list[int]] = {}
        docs = np.flatnonzero(wanted.any(axis=1)).tolist()  # the others need no vectors
        for group in pieces([coded[d] for d in docs]):
            piece, start, z = self._project([x for _, _, x in group])
            norm = np.linalg.norm(z, axis=1)
            strong = np.flatnonzero(norm > MIN_COSINE * self.damp)  # a weaker passage can't reach the threshold
            z = z[strong] / np.maximum(norm[strong], self.damp)[:, None]
            doc_of = np.array([docs[k] for k, _, _ in group], np.int64)[piece]
            start = start + np.array([lo for _, lo, _ in group], np.int64)[piece]
            for lo in range(0, len(z), 2048):
                score = z[lo:lo + 2048] @ self.queries
                p, q = np.divmod(np.flatnonzero(score > MIN_COSINE), score.shape[1])
                h, i = strong[lo + p], self.owner[q]
                ok = wanted[doc_of[h], i]
                for d, s, k in zip(doc_of[h[ok]].tolist(), start[h[ok]].tolist(), i[ok].tolist(), strict=True):
                    near.setdefault((d, k), []).append(s)
        return near

    def _project(self, coded: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, start, vector) of every passage; a passage is two neighbouring cells of ``STEP`` words."""
        lens = np.array([len(x) for x in coded], np.int64)
        n_pass = np.array([_starts(n) for n in lens.tolist()], np.int64)
        n_cells = n_pass + 1  # the last cell of a short text is empty
        base = np.cumsum(n_cells) - n_cells
        flat = np.concatenate(coded) if len(coded) else np.zeros(0, np.int32)
        pos = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
        ok = np.flatnonzero((flat >= 0) & self.keep[np.maximum(flat, 0)])
        cells = sums((np.repeat(base, lens) + pos // STEP)[ok], flat[ok], self.space, int(n_cells.sum()))
        k = np.arange(n_pass.sum()) - np.repeat(np.cumsum(n_pass) - n_pass, n_pass)
        first = np.repeat(base, n_pass) + k
        return np.repeat(np.arange(len(coded)), n_pass), k * STEP, cells[first] + cells[first + 1]

    def _told(self, i: int, doc: np.ndarray, lo: int, hi: int) -> bool:
        answer = self.answers[i]
        return bool(answer) and common_subsequence(answer, doc[max(0, lo - 5):hi + 40].tolist()) == len(answer)

    def _literal(self, pair: tuple[int, int], doc: np.ndarray, shared: list[int], near: list[int] | None) -> tuple[int, float, bool] | None:
        """``shared``: sorted positions of the shared triples."""
        i = pair[1]
        item, best, done, seen = self.items.coded[i], (0, 0, 0), -1, None
        least = self.min_share * len(item)
        for s in sorted({*shared, *(near or ())}):
            if s < done:
                continue
            lo, hi = max(0, s - self.reach[i]), min(len(doc), s + WINDOW + self.reach[i])
            done = s + WINDOW
            if seen == (lo, hi):  # a short document is one window
                continue
            seen = lo, hi
            if bisect_left(shared, hi - 2) - bisect_left(shared, lo) < self.least[i]:
                continue
            part = doc[lo:hi]
            n, a, e = reproduced(self.lists[i], part.tolist(), self.where[i], least)
            if n >= least and n > best[0] and (near is not None or telling(item, part[a:e], self.content, self.min_share)):
                best = (n, lo + a, lo + e)
        return self._leak(i, doc, best)

    def _paraphrase(self, pair: tuple[int, int], doc: np.ndarray, starts: list[int], around: dict[tuple[int, int], frozenset]) -> tuple[int, float, bool] | None:
        d, i = pair
        item, rare, best, done = self.items.coded[i], self.rare[i], (0, 0, 0), -1
        need = MIN_PARAPHRASE * len(rare)
        for s in sorted(set(starts)):
            if s < done:
                continue
            done = s + WINDOW // 2
            held = around.get((d, s))
            if held is None:
                if len(around) >= 4096:  # bounded memory
                    around.clear()
                held = around[d, s] = frozenset(doc[max(0, s - self.far):s + WINDOW + self.far].tolist())
            # bounds that lose nothing: words in order are words held
            enough = len(rare) and len(self.rare_sets[i] & held) + len(rare) - len(self.rare_sets[i]) >= need
            if not enough and not (self.answer_sets[i] and self.answer_sets[i] <= held):
                continue
            lo, hi = max(0, s - self.reach[i]), min(len(doc), s + WINDOW + self.reach[i])
            part = doc[lo:hi]
            n, a, e = reproduced(self.lists[i], part.tolist(), self.where[i], self.min_share * len(item))
            if n > best[0] and n >= self.min_share * len(item):
                inside = part[a:e]
                known = inside[inside >= 0]
                if enough and common_subsequence(rare.tolist(), known[self.content[known]].tolist()) >= need or self._told(i, doc, lo + a, lo + e):
                    best = (n, lo + a, lo + e)
        return self._leak(i, doc, best)

    def _leak(self, i: int, doc: np.ndarray, best: tuple[int, int, int]) -> tuple[int, float, bool] | None:
        n = len(self.items.coded[i])
        if best[0] == 0 or best[0] < self.min_share * n:
            return None
        return best[0], best[0] / n, self._told(i, doc, best[1], best[2])


_LEAK = "doc bigint, item bigint, n_words int, share double, answer boolean"


def _searcher(blocks: list[tuple[Items, np.ndarray, np.ndarray, np.ndarray]], min_share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [Search(*b, min_share) for b in blocks]
        for b in batches:
            ids = b.column(0).to_pylist()
            out: list[list] = [[], [], [], [], []]
            for lo, texts in _slices(b.column(1)):
                tokens = [words(t) for t in texts]
                for s in searches:
                    for d, i, n, share, told in s.leaks(tokens):
                        for col, v in zip(out, (ids[lo + d], s.items.ids[i], n, share, told), strict=True):
                            col.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.bool_()), strict=True)],
                                                names=["doc", "item", "n_words", "share", "answer"])
    return run


def find_leaks(docs: DataFrame, doc_col: str, text_col: str, items: DataFrame, item_col: str, item_text: str, min_share: float = MIN_SHARE,
               fit_docs: int = FIT_DOCS) -> DataFrame:
    """``doc_col, item_col, n_words, share, answer``: documents that hold a passage with at least ``min_share`` of an item's words in order.

    ``answer`` tells whether the item's answer stands in or right behind the passage.
    Null or empty texts and items without a word give no row; repeated document rows
    are reported each; an empty corpus or item table gives no rows.  Items are the
    query set: they are collected and searched in blocks of ``ITEM_BLOCK``,
    ``PASS_BLOCKS`` of them in one pass over the corpus, after one pass that counts
    the words of all items; every document is searched with its whole text.  The
    latent space is fitted on at most about ``fit_docs`` documents chosen by hash
    (all, if there are fewer).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "leakage")
    corpus = docs.select(F.col(doc_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where("text is not null and doc is not null")
    queries = items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("t")).where("item is not null and t is not null")
    rows = sorted((r.item, r.t) for r in queries.collect() if words(r.t))  # the query set
    if not rows:
        return spark.createDataFrame([], _LEAK).withColumnRenamed("doc", doc_col).withColumnRenamed("item", item_col)
    blocks = [Items(rows[k:k + ITEM_BLOCK]) for k in range(0, len(rows), ITEM_BLOCK)]
    vocab = {w: i for i, w in enumerate(dict.fromkeys(w for b in blocks for w in b.vocab))}
    counts = corpus.select("text").mapInArrow(_doc_counter(vocab), "word int, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()  # the items' words
    df = np.zeros(len(vocab) + 2)
    for r in counts:
        df[r.word] = r.n
    total, whole = int(df[-1]), int(df[-2])
    sample = corpus if whole <= fit_docs else corpus.where(
        F.pmod(F.xxhash64("doc"), F.lit(1_000_000)) < F.lit(max(1, round(1_000_000 * fit_docs / whole))))
    sample = scratch.keep(sample.select("text")) if len(blocks) > 1 else sample.select("text")
    ready = []
    for b in blocks:
        own = df[[vocab[w] for w in b.vocab]]
        keep, content, idf = weights(own, total)
        encoded = scratch.keep(sample.mapInArrow(_encoder(b), "w array<int>"))
        ready.append((b, keep, content, fit_space(encoded, b, keep, idf)))
    result = None
    for k in range(0, len(ready), PASS_BLOCKS):
        found = corpus.mapInArrow(_searcher(ready[k:k + PASS_BLOCKS], min_share), _LEAK)
        result = found if result is None else result.unionByName(found)
    return result.withColumnRenamed("doc", doc_col).withColumnRenamed("item", item_col)


def weights(df: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words that carry weight, content words, idf) by the words' document counts."""
    keep = df <= MAX_DOC_SHARE * max(total, 1)
    # content words are rarer than the usual vocabulary of the field; tiny corpora and items of common words fall back to ``keep``
    content = df <= max(CONTENT_SHARE * total, 1)
    if content.sum() < 0.2 * len(content):
        content = keep if keep.any() else np.ones(len(df), bool)
    if not keep.any():
        keep = np.ones(len(df), bool)
    return keep, content, np.where(keep, np.log((total + 1) / (df + 1)) + 0.05, 0).astype(np.float32)

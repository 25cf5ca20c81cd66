"""Per-document text statistics and the kind of text they tell.

``text_statistics`` gives the plain statistics with built-in Spark functions.
``classify_kind`` trains gradient-boosted trees on statistics of a bounded sample
and applies them to every document in one pass without a shuffle.  The labels come
from what the trees do not see: plain counts over the whole text (common words,
sentence ends, delimiters, compressibility) label the clear documents of the
sample, mixtures of those are labelled by the larger part, and rule-made examples
by the rule.  Scores are calibrated on one half of a hand-checked holdout, the
other half measures accuracy.
"""

from __future__ import annotations

import math
import random
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.quality_examples import HOLDOUT, synthetic

KINDS = ("prose", "list", "table", "junk")
#: Documents in the training sample (chosen by hash); the model is the only thing fitted on a sample.
FIT_DOCS = 4_000
#: Share of a text that one layout must make up for a weak label.
CLEAR = 0.8

#: Common words of the languages of the corpus.
COMMON = frozenset((
    "the of and in to a is was were with for by on that as at from but not or which had after before under over during this its be been "
    "der die das und in von mit bei auf ist war nach im dem den des ein eine nicht für unter als am sich "
    "el la los las de en y con que por del una un no al se fue según tras para su sin "
    "le les des du et dans est une a pas par pour sur au aux chez d l n s qui "
    "в и не на с по у от для что к из при больше после было без г "
    "في من بعد على إلى عن هل هذا التي أي مع "
    "में के की का है ने पर को से यह और था थी होता दिया गया बाद "
).split())
_TOKEN = re.compile(r"\S+")
_END = re.compile(r"[.!?。！？।؟…][\"”»)」』“']*\s*$")
_SENT = re.compile(r"[.!?…][\"”»)」』“']*(?=\s|$)|[。！？।؟]")
_SPACELESS = re.compile(r"[぀-ヿ㐀-鿿฀-๿]")
_BULLET = re.compile(r"\s*(?:[-*•+–—·▪◦]|o(?= )|\(?\d{1,3}[.)]|\[\d{1,3}\]|[a-zA-Z][.)])\s+\S")
_PAIR = re.compile(r"\s*[^\s:]{1,30}(?: [^\s:]{1,20}){0,2}: \S.{0,80}$")
_REFERENCE = re.compile(r"\b(?:19|20)\d\d\s*[;,]\s*\d+\s*(?:\(\d+\))?\s*:\s*\w?\d+|\bdoi:\s*10\.|\bet al\.\s*\(?(?:19|20)\d\d")
_MOJI = re.compile(r"[ÂÃÄÅÐÑØÙàáâãäåæçèé][\u0080-¿ŒœŠšŸŽžƒˆ˜–-…€™]+|�")
_NOISE = re.compile(r"[^\W_][{}<>|~^@§¬#*!¤¦±\\=][^\W_]|[{}|~^¬§][^\s]|[^\s][{}|~^¬§]|[^\W\d_][%&*@#<>](?=[^\W_])|[*&#@][^\W_]")
#: A passage without any of these has no junk token.
_SUSPECT = re.compile(r"[{}|~^@§¬#*¤¦±_\\\u0080-\u009f�ÃÐÑØÙ]|[A-Za-z][%&<>=][A-Za-z0-9]|[a-z]\d|\d[a-z]|[!-~]{31}|[bcdfghjklmnpqrstvwxz]{5}|[!-/:-@]{4}|\b[bcdfghjklmnpqrstvwxz]{4}\b")
_DAMAGE = re.compile(r"[{}|~^¬§\u0080-\u009f�]")
_HEX = re.compile(r"[0-9a-f]{2}")
_MIXED = re.compile(r"(?:[a-z]+\d+|\d+[a-z]+)(?:[a-z]\w*|\d\w*)?")
_CELL = re.compile(r",(?=\S)|,$|;(?=[\"\S])")
_EDGE = ".,;:!?()[]\"'«»„“”’。，"


def _junk_token(t: str) -> bool:
    if _MOJI.search(t) or _NOISE.search(t):
        return True
    n = len(t)
    if n > 30 and "://" not in t and "www." not in t and "-" not in t[1:-1] and not _SPACELESS.search(t):
        return True
    core = t.strip(".,;:()[]\"'")
    if not core:
        return n > 3
    if core.isascii():
        if _MIXED.fullmatch(core) and len(core) > 2 and any(c.isdigit() for c in core[:-2]):
            return True
        if len(core) > 3 and core.isalpha() and core.islower() and not re.search(r"[aeiouy]", core):
            return True
    return False


def line_kind(line: str, ended: bool, unfinished: bool) -> str:
    """``table``, ``list`` or ``text`` by the structure of one line.

    ``ended``: it ends like a sentence; ``unfinished``: the line before is running
    text that goes on, so a short line is its rest and no entry.
    """
    s = line.strip()
    if "|" in s and s.count("|") >= 2 and (s[0] == "|" or " | " in s or "||" in s):
        return "table"
    if s.endswith("\\\\") or s.count(" & ") >= 2 or "\t" in s:
        return "table"
    if _BULLET.match(line):
        return "list"
    if "   " in s and re.search(r"\S {3,}(?=\S)", s) and len(s.split()) <= 24:
        return "table"
    if "," in s or ";" in s:
        cells = len(_CELL.findall(s))
        words = len(s.split())
        if cells >= 1 and words <= max(3, 1.6 * cells + 2) and cells >= s.count(", ") + s.count("; "):
            return "table"
    if ":" in s and _REFERENCE.search(s):
        return "list"
    if ended or unfinished:
        return "text"
    if ": " in s and len(s) < 100 and _PAIR.match(line):
        return "list"
    if len(s) <= 60 and not _SPACELESS.search(s):
        words = s.split()
        if len(words) <= 6 and not any(w.lower().strip(_EDGE) in COMMON for w in words):
            return "list"
    return "text"


#: Statistics that the trees see, in order.
STATISTICS = ("log_chars", "log_words", "mean_word_len", "letters", "digits", "symbols", "spaces", "upper", "lower_share", "unique_share", "line_len", "line_len_cv", "prose_part", "list_part", "table_part", "junk_part",
              "repeat_part", "comma_rate", "chunk_len", "top_char_share", "spaceless")


def _classes() -> np.ndarray:
    """Class of every character of the basic plane: 0 symbol, 1 letter or mark, 2 upper case, 3 digit, 4 space, 5 letter of a script without spaces."""
    out = np.zeros(0x10000, np.uint8)
    for i in range(0x10000):
        c = chr(i)
        if c.isspace():
            out[i] = 4
        elif c.isdigit():
            out[i] = 3
        elif c.isupper():
            out[i] = 2
        elif _SPACELESS.match(c):
            out[i] = 5
        elif c.isalpha() or unicodedata.category(c)[0] == "M":
            out[i] = 1
    return out


_CLASS: np.ndarray | None = None


def _char_counts(text: str) -> tuple[np.ndarray, int]:
    """Characters per class, and of the most frequent one that is not a space."""
    global _CLASS
    if _CLASS is None:
        _CLASS = _classes()
    if len(text) > 1_000_000:  # bounded memory for very long texts
        seen, total = np.zeros(0x10000, np.int64), np.zeros(6, np.int64)
        for lo in range(0, len(text), 1_000_000):
            codes = np.minimum(np.frombuffer(text[lo:lo + 1_000_000].encode("utf-32-le", "replace"), np.uint32), 0xFFFF)
            seen += np.bincount(codes, minlength=0x10000)
        np.add.at(total, _CLASS, seen)
        return total, int(seen[_CLASS != 4].max())
    codes = np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32), 0xFFFF)
    kinds = _CLASS[codes]
    solid = codes[kinds != 4]
    return np.bincount(kinds, minlength=6), int(np.bincount(solid).max()) if len(solid) else 0


def structure_statistics(text: str) -> list[float]:
    """The values of ``STATISTICS`` for one text (all zero for an empty or blank one)."""
    n = len(text)
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    nw = len(words)
    counts, top = _char_counts(text)
    symbols, letters, upper, digits, spaces, spaceless = (int(x) for x in counts)
    dense = n - spaces
    lines = text.split("\n")
    lens = [len(x) for x in lines if x and not x.isspace()]
    prose = listed = tabled = junk = lower = 0
    passages: list[list[str]] = []
    open_ = unfinished = False
    for x in lines:
        if not x or x.isspace():
            open_ = unfinished = False
            continue
        end = _END.search(x) is not None
        kind = "text" if end and len(x) > 90 and "\t" not in x and x[0] not in "|-*•+–" else line_kind(x, end, unfinished)
        if kind == "text":
            if open_:
                passages[-1].append(x)
            else:
                passages.append([x])
            open_ = True
            unfinished = not end and len(x) >= 40
            continue
        open_ = unfinished = False
        size = len(x.replace(" ", ""))
        bad = 0
        if _SUSPECT.search(x) and (kind == "list" or _MOJI.search(x)):
            bad = sum(len(t) for t in x.split() if (_junk_token(t) if kind == "list" else _MOJI.search(t)))
        junk += bad
        if kind == "list":
            listed += size - bad
        else:
            tabled += size - bad
    for part in passages:
        p = part[0] if len(part) == 1 else " ".join(part)
        toks = p.split()
        size = sum(map(len, toks))
        if not p.isascii() and _SPACELESS.search(p):
            solid = len(_SPACELESS.findall(p)) > 0.15 * len(p)
        else:
            solid = False
        if solid:  # words are not separated: damage shows in single characters
            noise = len(_DAMAGE.findall(p))
            bad = size if noise > 0.05 * size else 0
        else:
            bad = sum(len(t) for t in toks if _junk_token(t)) if _SUSPECT.search(p) else 0
        few = 0
        for t in toks:
            w = t.strip(_EDGE).lower()
            few += w in COMMON
            lower += w == t
        stops = len(_SENT.findall(p))
        nt = len(toks)
        if nt > 3 and size < 4 * nt and sum(len(t) == 2 and _HEX.fullmatch(t) is not None for t in toks) > 0.6 * nt:
            junk += size
            continue
        listing = False
        if solid:
            good = True
        else:
            seps = p.count(", ") + p.count("; ")
            listing = seps >= 4 and seps > 0.22 * nt and few < 0.08 * nt + stops
            good = few >= 0.06 * nt or stops >= 1 and stops * 40 >= nt
        if bad >= 0.35 * size:
            junk += size
        elif listing or not good and nt <= 12:
            listed += size - bad
            junk += bad
        elif good:
            prose += size - bad
            junk += bad
        else:
            junk += size
    whole = max(1, prose + listed + tabled + junk)
    unique = len({w.lower() for w in words}) / nw
    repeat = 1 - unique if nw >= 12 else 0.0
    commas = text.count(",") + text.count(";")
    mean_len = sum(lens) / len(lens)
    cv = math.sqrt(sum((x - mean_len) ** 2 for x in lens) / len(lens)) / max(mean_len, 1)
    return [math.log1p(n), math.log1p(nw), min(dense / nw, 200.0), (letters + upper + spaceless) / n, digits / n, symbols / n, spaces / n, upper / n,
            lower / nw, unique, min(mean_len, 1000.0), cv, prose / whole, listed / whole, tabled / whole,
            junk / whole, repeat, commas / nw, min(dense / (commas + 1), 500.0) if commas else 0.0, top / dense, spaceless / n]


#: A line of cells: bars, tabs, ampersands, columns of blanks, separators without blanks.
_CELLS = re.compile(r"\|.*\||\t| & .* & |\\\\$|\S {3,}\S.* {3,}\S|^[^,;]*(?:,(?! )[^,;]*){2,}$|\";\"")
_ENTRY = re.compile(r"\s*(?:[-*•+–·▪◦o]|\(?\w{1,3}[.)]|\[\d+\])\s")


def weak_label(text: str) -> int:
    """Index of the kind that plain counts over the whole text tell beyond doubt, -1 if they do not.

    None of these counts is among ``STATISTICS``.
    """
    words = text.split()
    if len(words) < 8 and len(text) < 200:
        return -1
    lines = [x for x in text.splitlines() if x.strip()]
    size = sum(map(len, lines))
    cells = sum(len(x) for x in lines if _CELLS.search(x))
    entries = sum(len(x) for x in lines if not _CELLS.search(x) and (_ENTRY.match(x) or len(x) < 50 and not _END.search(x)))
    common = sum(w.strip(_EDGE).lower() in COMMON for w in words) / len(words)
    ends = len(_SENT.findall(text))
    separators = (text.count(", ") + text.count("; ")) / len(words)
    spaceless = len(_SPACELESS.findall(text)) / len(text)
    damaged = len(_MOJI.findall(text)) + len(_DAMAGE.findall(text)) - text.count("|")
    wordy = sum(len(w) > 2 and sum(c.isalpha() for c in w) > 1 for w in words) / len(words)
    raw = text.encode("utf-8", "replace")
    if damaged > 0.03 * len(text) or cells < 0.5 * size and len(raw) > 150 and len(zlib.compress(raw, 6)) < 0.12 * len(raw):
        return 3
    if wordy < 0.1 and cells < 0.1 * size and len(words) > 30 and len(raw) < 1.2 * len(text):
        return 3
    if cells >= CLEAR * size and common < 0.1:
        return 2
    if entries >= CLEAR * size and len(lines) > 4 and common < 0.1 or separators > 0.3 and common < 0.03:
        return 1
    if cells + entries > 0.1 * size:
        return -1
    if common >= 0.12 and ends * 40 >= len(words) or spaceless > 0.4 and ends * 120 >= len(text):
        return 0
    if common < 0.01 and ends * 60 < len(words) and separators < 0.1 and spaceless < 0.05:
        return 3
    return -1


def mixtures(texts: list[tuple[str, int]], seed: int) -> list[tuple[str, int]]:
    """Clear texts of two kinds put together in random proportions, with the kind of the larger part (by characters but blanks)."""
    r = random.Random(seed)
    by_kind = [[t for t, k in texts if k == kind] for kind in range(len(KINDS))]
    out = []
    for text, kind in texts:
        others = [k for k in range(len(KINDS)) if k != kind and by_kind[k]]
        if not others or len(text) > 20_000:
            continue
        other = r.choice(others)
        mate = r.choice(by_kind[other])
        parts = []
        for t in (text, mate):
            rows = t.split("\n")
            if len(rows) < 4:
                rows = re.split(r"(?<=[.!?。]) ", t)
            n = max(1, round(len(rows) * r.uniform(0.15, 1)))
            parts.append((" " if "\n" not in t else "\n").join(rows[:n]))
        solid = [len("".join(p.split())) for p in parts]
        if min(solid) and not 0.8 < solid[0] / solid[1] < 1.25:
            order = parts if r.random() < 0.5 else parts[::-1]
            out.append(("\n\n".join(order), kind if solid[0] > solid[1] else other))
    return out


class Trees:
    """Gradient-boosted regression trees for one class against the rest (logistic loss, histogram splits)."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.25, bins: int = 32, leaf: int = 5, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.leaf, self.ridge = rounds, depth, rate, bins, leaf, ridge
        self.trees: list[list[tuple[int, float, float]]] = []  # per node: feature (-1 leaf), threshold, value
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = math.log(share / (1 - share))
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)], axis=1)
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            tree = [(-1, 0.0, 0.0)] * (2 ** (self.depth + 1) - 1)
            self._grow(tree, 0, np.arange(len(y)), binned, cuts, g, h, self.depth)
            self.trees.append(tree)
            score += self._apply(tree, x)
        return self

    def _grow(self, tree, node, rows, binned, cuts, g, h, depth) -> None:
        gs, hs = g[rows].sum(), h[rows].sum()
        tree[node] = (-1, 0.0, self.rate * gs / (hs + self.ridge))
        if depth == 0 or len(rows) < 2 * self.leaf:
            return
        best = (1e-6, -1, 0)
        root = gs * gs / (hs + self.ridge)
        for j, c in enumerate(cuts):
            if not len(c):
                continue
            b = binned[rows, j]
            gl = np.cumsum(np.bincount(b, g[rows], len(c) + 1))[:-1]
            hl = np.cumsum(np.bincount(b, h[rows], len(c) + 1))[:-1]
            nl = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
            gain = gl**2 / (hl + self.ridge) + (gs - gl) ** 2 / (hs - hl + self.ridge) - root
            gain[(nl < self.leaf) | (len(rows) - nl < self.leaf)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], j, k)
        _, j, k = best
        if j < 0:
            return
        tree[node] = (j, float(cuts[j][k]), 0.0)
        left = binned[rows, j] <= k
        self._grow(tree, 2 * node + 1, rows[left], binned, cuts, g, h, depth - 1)
        self._grow(tree, 2 * node + 2, rows[~left], binned, cuts, g, h, depth - 1)

    def _apply(self, tree, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        feature = np.array([t[0] for t in tree])
        cut = np.array([t[1] for t in tree])
        value = np.array([t[2] for t in tree])
        for _ in range(self.depth):
            f = feature[at]
            inner = f >= 0
            right = x[np.arange(len(x)), np.maximum(f, 0)] >= cut[at]
            at = np.where(inner, 2 * at + 1 + right, at)
        return value[at]

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += self._apply(tree, x)
        return out


def _platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn scores into probabilities on the holdout (regularised towards slope 1)."""
    a, b = 1.0, 0.0
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * score + b, -30, 30)))
        r, w = p - target, np.maximum(p * (1 - p), 1e-4)
        grad = np.array([(r * score).sum() + 0.5 * (a - 1), r.sum() + 0.1 * b])
        hess = np.array([[(w * score * score).sum() + 0.5, (w * score).sum()], [(w * score).sum(), w.sum() + 0.1]])
        step = np.clip(np.linalg.solve(hess, grad), -0.3, 0.3)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(min(max(a, 0.1), 3.0)), float(min(max(b, -5.0), 5.0))


class KindModel:
    """One boosted ensemble per kind with calibrated probabilities."""

    def __init__(self, stats: np.ndarray, labels: np.ndarray):
        made = [(t, KINDS.index(k)) for k, t in synthetic()]
        made += mixtures(made, 11)
        x = np.concatenate([stats.reshape(-1, len(STATISTICS)), np.array([structure_statistics(t) for t, _ in made])])
        y = np.concatenate([labels, [k for _, k in made]]).astype(int)
        held = np.array([structure_statistics(t) for _, t in HOLDOUT])
        truth = np.array([KINDS.index(k) for k, _ in HOLDOUT])
        calibrating = np.arange(len(truth)) % 2 == 0  # the texts stand kind after kind
        self.models = [Trees().fit(x, (y == k).astype(float)) for k in range(len(KINDS))]
        self.scale = [_platt(m.score(held[calibrating]), (truth[calibrating] == k).astype(float)) for k, m in enumerate(self.models)]
        self.holdout_accuracy = float((self.probabilities(held[~calibrating]).argmax(axis=1) == truth[~calibrating]).mean())

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        p = np.stack([1 / (1 + np.exp(-np.clip(a * m.score(x) + b, -30, 30))) for m, (a, b) in zip(self.models, self.scale, strict=True)], axis=1)
        return p / p.sum(axis=1, keepdims=True)


def _sampler(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        clear = [(t, k) for t in b.column(0).to_pylist() if (k := weak_label(t)) >= 0]
        few = min((n for k in range(len(KINDS)) if (n := sum(x == k for _, x in clear))), default=0)
        rare = [(t, k) for t, k in clear if sum(x == k for _, x in clear) <= 4 * few]
        every = clear + mixtures(clear, 3) + mixtures(rare, 5) + mixtures(rare, 7)
        yield pa.RecordBatch.from_arrays([pa.array([structure_statistics(t) for t, _ in every], pa.list_(pa.float64())), pa.array([k for _, k in every], pa.int32())], names=["s", "label"])


def _classifier(model: KindModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            p = model.probabilities(np.array([structure_statistics(t) for t in b.column(1).to_pylist()]))
            k = p.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([KINDS[i] for i in k]), pa.array(p[np.arange(len(k)), k])], names=["doc", "kind", "probability"])
    return run


def fit_kind_model(docs: DataFrame, text_col: str, fit_docs: int = FIT_DOCS) -> KindModel:
    """Train on at most about ``fit_docs`` documents chosen by hash of their text, as far as plain counts label them, and on mixtures of those."""
    rows = docs.select(F.col(text_col).alias("t")).where("t is not null")
    n = rows.count()
    if n > fit_docs:
        rows = rows.where(F.pmod(F.xxhash64("t"), F.lit(1_000_000)) < F.lit(max(1, round(1_000_000 * fit_docs / n))))
    # identical texts share a hash: the sample keeps at most fit_docs rows whatever the copies
    got = rows.limit(2 * fit_docs).mapInArrow(_sampler, "s array<double>, label int").collect()
    stats = np.array([r.s for r in got]).reshape(-1, len(STATISTICS))
    return KindModel(stats, np.array([r.label for r in got], int))


def classify_kind(docs: DataFrame, id_col: str, text_col: str, fit_docs: int = FIT_DOCS, model: KindModel | None = None) -> DataFrame:
    """``id_col, kind, probability`` of every document: prose, list, table or junk by the bulk of its text.

    Null texts give no row; empty and blank texts are junk-like by their empty
    statistics and classified like any other.  Repeated rows are classified each;
    an empty table gives no rows.
    """
    model = model or fit_kind_model(docs, text_col, fit_docs)
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).where("text is not null")
    return rows.mapInArrow(_classifier(model), f"doc {kind}, kind string, probability double").withColumnRenamed("doc", id_col)


#: English common words that the plain statistics count.
PLAIN_COMMON = ("the", "of", "and", "in", "to", "a", "was", "were", "with", "for", "by", "on", "that", "as", "at", "from", "but", "not", "is", "no")


def text_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Plain statistics of every document with built-in functions only.

    ``n_chars, n_words, mean_word_length, symbol_ratio, n_lines, line_end_share,
    common_word_share``; ratios rounded to 6 places and null where their base is
    zero (empty and blank texts).  Null texts give null statistics.
    """
    t = F.col(text_col)
    words = F.regexp_count(t, F.lit(r"[^ \t\n\r]+"))
    lines = F.regexp_count(t, F.lit(r"[^\n]*[^ \t\n\r][^\n]*"))
    ended = F.regexp_count(t, F.lit(r"[.!?。！？।؟…][\"”»)」』“]*[ \t\r]*(\n|\z)"))
    latin = F.filter(F.split(F.lower(t), "[^a-z]+"), lambda w: w != "")
    common = F.filter(latin, lambda w: w.isin(*PLAIN_COMMON))
    ratio = lambda a, b: F.round(F.try_divide(a.cast("double"), b.cast("double")), 6)
    return docs.select(
        F.col(id_col), F.length(t).cast("long").alias("n_chars"), words.cast("long").alias("n_words"),
        ratio(F.length(F.regexp_replace(t, r"[ \t\n\r]+", "")), words).alias("mean_word_length"),
        ratio(F.length(F.regexp_replace(t, r"[\p{L}\p{M}\p{N} \t\n\r]+", "")), F.length(t)).alias("symbol_ratio"),
        lines.cast("long").alias("n_lines"), ratio(ended, lines).alias("line_end_share"), ratio(F.size(common), F.size(latin)).alias("common_word_share"))

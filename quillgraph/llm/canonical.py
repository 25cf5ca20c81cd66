"""Mapping free-entered values to a canonical list.

Method: an Aho-Corasick automaton over all names and aliases finds embedded
mentions, the longest non-overlapping ones win; a mention decides if the rest of
the value is neutral wording.  Remaining values go to token-set similarity:
tokens are assigned to the tokens of an entry in any order, each within a small
edit distance, numbers exactly and known words only to themselves, so entries
that differ in a number or a qualifying word never stand in for each other.

Values that differ only in case and blanks are mapped once and looked up again
(hot values are salted).  The list travels in blocks of a fixed number of names;
what one block finds is merged before anything is decided, and whether a word is
known is asked of the whole list, so the result does not depend on the blocks.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.session import Scratch
from quillgraph.skew import heavy_keys, salted_lookup

UNMATCHED = "UNMATCHED"
#: Names per block; only transport, the result does not depend on it.
BLOCK = 100_000
#: Wording around a name that does not change what it means.
NEUTRAL = "the a an patient patients with suspected possible probable known history of in cohort unspecified nos n o s disorder not otherwise specified"
#: Spellings one step away that cost more plain edits, as (pattern, replacement).
RESPELLED = (("ies$", "y"), ("rn", "m"))
_GREEK = {"α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "κ": "kappa", "λ": "lambda", "μ": "mu", "ω": "omega"}
_ROMAN = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "vii": "7", "viii": "8", "ix": "9", "x": "10"}
_TOKEN = re.compile(r"[^\W_]+")
_REF = re.compile(r"\[\s*\d+(?:\s*[,–-]\s*\d+)*\s*\]")
_GREEK_ANY = re.compile("[" + "".join(_GREEK) + "]")


def tokens(text: str) -> list[str]:
    """Comparable tokens: compatibility forms, case and accents folded, Greek letters spelled out, type numerals as digits."""
    if text.isascii():
        t = text.lower()
    else:
        t = unicodedata.normalize("NFKC", text).casefold().replace("​", "")
        t = _GREEK_ANY.sub(lambda m: _GREEK[m.group()], t)
        t = "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c))
    if "[" in t:
        t = _REF.sub(" ", t)
    out = _TOKEN.findall(t)
    if "type" in out:
        for i, w in enumerate(out):
            if w in _ROMAN and i and out[i - 1] == "type":
                out[i] = _ROMAN[w]
    return out


def edit_distance(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and neighbour swaps; ``most + 1`` if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            v = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            new.append(v)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)


def allowed(word: str) -> int:
    """Edits allowed in a word: none in numbers, codes and very short words."""
    if len(word) <= 3 or any(c.isdigit() for c in word):
        return 0
    return 1 if len(word) <= 5 else 2


def _deletes(word: str, n: int) -> set[str]:
    """The word and all that is left of it with up to ``n`` (at most 2) characters taken out."""
    out = {word}
    if n:
        once = [word[:i] + word[i + 1:] for i in range(len(word))]
        out.update(once)
        if n > 1:
            out.update(w[:j] + w[j + 1:] for i, w in enumerate(once) for j in range(i, len(w)))
    return out


def assign(costs: list[dict[int, int]], n_wanted: int, spare: list[int | None]) -> int | None:
    """Least cost of giving every wanted token its own typed token, the typed tokens left over counting as neutral.

    ``costs[i]``: wanted token -> edits for typed token i; ``spare[i]``: its cost
    as neutral wording, None if it is not.  None if there is no such assignment.
    """
    taken: set[int] = set()
    total = 0
    for i, c in enumerate(costs):  # mostly one choice for each token
        if len(c) == 1 and spare[i] is None and (w := next(iter(c))) not in taken:
            taken.add(w)
            total += c[w]
        elif not c and spare[i] is not None:
            total += spare[i]
        else:
            break
    else:
        return total if len(taken) == n_wanted else None
    n = len(costs)
    if n < n_wanted:
        return None
    # shortest augmenting paths; columns behind the wanted ones are the neutral places, one for each typed token
    m = n_wanted + n
    left_over = 4 * n + 16  # a neutral place costs more than any edits, so no wanted token goes without a typed one
    never = (left_over + 4) * (n + 1)
    matrix = [[c.get(j, never) for j in range(n_wanted)] + [never] * n for c in costs]
    for i, s in enumerate(spare):
        if s is not None:
            matrix[i][n_wanted + i] = s + left_over
    u, v, owner, way = [0] * (n + 1), [0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    big = (n + m + 1) * never
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, used = [big] * (m + 1), [False] * (m + 1)
        while True:
            used[j0] = True
            i0, step, j1 = owner[j0], big, 0
            for j in range(1, m + 1):
                if not used[j]:
                    cur = matrix[i0 - 1][j - 1] - u[i0] - v[j]
                    if cur < least[j]:
                        least[j], way[j] = cur, j0
                    if least[j] < step:
                        step, j1 = least[j], j
            if j1 == 0:
                return None
            for j in range(m + 1):
                if used[j]:
                    u[owner[j]] += step
                    v[j] -= step
                else:
                    least[j] -= step
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0], j0 = owner[way[j0]], way[j0]
    total = 0
    for j in range(1, m + 1):
        if owner[j]:
            i = owner[j] - 1
            c = costs[i].get(j - 1) if j <= n_wanted else (spare[i] if j - 1 - n_wanted == i else None)
            if c is None:
                return None
            total += c
        elif j <= n_wanted:
            return None
    return total


class Found:
    """What one block of the list knows about a value; ``merge`` adds what another one knows."""

    __slots__ = ("mentions", "joined", "cost", "winners")

    def __init__(self, mentions: dict[int, tuple[int, frozenset]], joined: frozenset, cost: int, winners: frozenset):
        self.mentions, self.joined, self.cost, self.winners = mentions, joined, cost, winners

    def merge(self, other: Found) -> None:
        for start, (end, ids) in other.mentions.items():
            mine = self.mentions.get(start)
            if mine is None or end > mine[0]:
                self.mentions[start] = (end, ids)
            elif end == mine[0]:
                self.mentions[start] = (end, mine[1] | ids)
        self.joined |= other.joined
        if other.cost < self.cost:
            self.cost, self.winners = other.cost, other.winners
        elif other.cost == self.cost:
            self.winners |= other.winners

    def decide(self, neutral: list[bool]) -> tuple[str | None, int]:
        """(id, tier) from all blocks; ``neutral`` tells which tokens are neutral wording."""
        at, ids, rest = 0, set(), True
        while at < len(neutral):
            hit = self.mentions.get(at)
            if hit:
                at = hit[0]
                ids |= hit[1]
            else:
                rest = rest and neutral[at]
                at += 1
        if len(ids) == 1 and rest:
            return next(iter(ids)), 0
        if len(self.joined) == 1:
            return next(iter(self.joined)), 1
        if len(self.winners) == 1:
            return next(iter(self.winners)), 2
        return None, 9


class WordSet:
    """Words of a whole list as sorted hashes (8 bytes each); two words in 2**64 / n**2 lists would be confused."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes

    @staticmethod
    def of(words) -> WordSet:
        import xxhash

        return WordSet(np.unique(np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64)))

    def __contains__(self, word: str) -> bool:
        import xxhash

        h = np.uint64(xxhash.xxh64_intdigest(word))
        at = int(np.searchsorted(self.hashes, h))
        return at < len(self.hashes) and self.hashes[at] == h


def listed(name: str, toks: list[str]) -> bool:
    """Whether a name takes part in token-set similarity: codes and abbreviations only match as they are."""
    return not (len(toks) <= 2 and any(c.isdigit() for c in toks[-1]) or len(toks) == 1 and name.isupper())


class Matcher:
    """Automaton, token index and near-word index over one block of the list."""

    def __init__(self, entries: list[tuple[str, str]], known: object = None, neutral: str = NEUTRAL, respelled: tuple = RESPELLED):
        """``entries``: (id, name); ``known``: words of the whole list (those of ``entries`` if left out)."""
        exact: dict[str, set[str]] = defaultdict(set)
        compact: dict[str, set[str]] = defaultdict(set)
        self.names: list[tuple[str, tuple[str, ...]]] = []
        self.having: dict[str, list[int]] = defaultdict(list)
        self.neutral = frozenset(neutral.split())
        self.respelled = [(re.compile(p), r) for p, r in respelled]
        seen = set()
        for ident, name in entries:
            toks = tokens(name)
            if not toks:
                continue
            key = " ".join(toks)
            exact[key].add(ident)
            compact["".join(toks)].add(ident)
            if listed(name, toks) and (ident, key) not in seen:
                seen.add((ident, key))
                for t in set(toks):
                    self.having[t].append(len(self.names))
                self.names.append((ident, tuple(toks)))
        self.having = dict(self.having)
        self.known = self.having.keys() if known is None else known
        self.compact = {k: frozenset(v) for k, v in compact.items()}
        self.automaton = ahocorasick.Automaton()
        for key, ids in exact.items():
            self.automaton.add_word(f" {key} ", (len(key) + 1, key.count(" ") + 1, frozenset(ids)))
        self.any = bool(exact)
        if self.any:
            self.automaton.make_automaton()
        self.near_index: dict[str, list[str]] = defaultdict(list)
        for w in self.having.keys() | {n for n in self.neutral if len(n) > 3}:
            for d in _deletes(w, allowed(w)):
                self.near_index[d].append(w)
        self.cache: dict[str, tuple[dict[str, int], int | None]] = {}

    def near(self, word: str) -> tuple[dict[str, int], int | None]:
        """Words of this block a typed word may stand for, with the number of edits, and its cost as neutral wording; a known word only for itself."""
        got = self.cache.get(word)
        if got is None:
            if word in self.neutral or word in self.known or word.isdigit():
                costs = {word: 0}
            else:
                most = 0 if len(word) <= 2 else 1 if len(word) <= 4 else 2
                costs = {}
                index = self.near_index
                for cand in {c for d in _deletes(word, most) if d in index for c in index[d]}:
                    n = edit_distance(word, cand, min(2, allowed(cand)))
                    if n <= allowed(cand):
                        costs[cand] = n
                for pattern, into in self.respelled:  # at the cost of one edit, with at most one more beside it
                    for m in pattern.finditer(word):
                        other = word[:m.start()] + into + word[m.end():]
                        for cand in {c for d in _deletes(other, 1) if d in index for c in index[d]}:
                            n = edit_distance(other, cand, 1)
                            if n < allowed(cand) or n == 0:
                                costs[cand] = min(n + 1, costs.get(cand, 9))
            spare = min((n for w, n in costs.items() if w in self.neutral), default=None)
            got = ({w: n for w, n in costs.items() if w in self.having}, spare)
            if len(self.cache) > 200_000:
                self.cache.clear()
            self.cache[word] = got
        return got

    def neutral_tokens(self, toks: list[str]) -> list[bool]:
        return [self.near(w)[1] is not None for w in toks]

    def mentions(self, toks: list[str]) -> dict[int, tuple[int, frozenset]]:
        """Longest name that starts at each token: start -> (end, ids)."""
        if not self.any:
            return {}
        line = f" {' '.join(toks)} "
        out: dict[int, tuple[int, frozenset]] = {}
        first: dict[int, int] | None = None
        for end, (length, n, ids) in self.automaton.iter(line):
            if first is None:
                first, at = {}, 0
                for i, t in enumerate(toks):
                    first[at] = i
                    at += len(t) + 1
            start = first[end - length]
            if start not in out or start + n > out[start][0]:
                out[start] = (start + n, ids)
        return out

    def _variants(self, toks: list[str]) -> Iterator[tuple[list[str], int]]:
        yield toks, 0
        known = self.known
        for i, w in enumerate(toks):  # a lost space or hyphen, an added one
            if len(w) > 6 and w not in known:
                for k in range(3, len(w) - 2):
                    if w[:k] in known and not w[:k].isdigit() or w[k:] in known and not w[k:].isdigit():
                        yield [*toks[:i], w[:k], w[k:], *toks[i + 1:]], 1
            if i + 1 < len(toks) and not (w in known and toks[i + 1] in known) and not w.isdigit() and not toks[i + 1].isdigit():
                yield [*toks[:i], w + toks[i + 1], *toks[i + 2:]], 1

    def similar(self, toks: list[str]) -> tuple[int, frozenset]:
        """Fewest edits of a token-set assignment to a name of this block, and the entries that reach it."""
        best, winners = 99, set()
        for variant, extra in self._variants(toks):
            if extra >= best:
                break  # variants come by their extra cost
            options = [self.near(w) for w in variant]
            if any(not o[0] and o[1] is None for o in options):
                continue
            # a token that is no neutral wording must be one of the name's; without such a token every name with any of them is a candidate
            lead = None
            for o, spare in options:
                if spare is None:
                    n = sum(len(self.having[w]) for w in o)
                    if lead is None or n < lead[0]:
                        lead = (n, o)
            pool = [lead[1]] if lead else [o for o, _ in options]
            spares = [s for _, s in options]
            for k in {k for o in pool for w in o for k in self.having[w]}:
                ident, want = self.names[k]
                if len(want) > len(variant):
                    continue
                costs, used = [], set()
                for o, spare in options:
                    c = {j: o[w] for j, w in enumerate(want) if w in o}
                    if not c and spare is None:
                        break
                    used |= c.keys()
                    costs.append(c)
                else:
                    if len(used) == len(want) and (cost := assign(costs, len(want), spares)) is not None and cost + extra <= best:
                        if cost + extra < best:
                            best, winners = cost + extra, set()
                        winners.add(ident)
        return best, frozenset(winners)

    def find(self, toks: list[str], lazily: bool = True) -> Found:
        """All this block knows about a value; ``lazily`` leaves out what an earlier tier has settled."""
        mentions = self.mentions(toks)
        joined = self.compact.get("".join(toks), frozenset())
        found = Found(mentions, joined, 99, frozenset())
        if not lazily or found.decide(self.neutral_tokens(toks))[0] is None:
            found.cost, found.winners = self.similar(toks)
        return found

    def match(self, text: str) -> tuple[str | None, int]:
        """(id, tier): 0 by mention, 1 by joined spelling, 2 by token-set similarity, 9 none."""
        toks = tokens(text)
        return self.find(toks).decide(self.neutral_tokens(toks))


#: The last matcher of this worker process; tasks of one job share it.
_LAST: list = [None, None]


def _matcher(key: str, entries, known, neutral, respelled) -> Matcher:
    if _LAST[0] != key:
        _LAST[:] = [key, Matcher(entries, known, neutral, respelled)]
    return _LAST[1]


def _mapper(entries, neutral, respelled):
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[str | None, int]] = {}
        for b in batches:
            matcher = _matcher(key, entries, None, neutral, respelled)
            ids, tiers = [], []
            for text in b.column(0).to_pylist():
                toks = tokens(text)
                line = " ".join(toks)
                hit = memo.get(line)
                if hit is None:
                    if len(memo) > 100_000:
                        memo.clear()
                    hit = memo[line] = matcher.find(toks).decide(matcher.neutral_tokens(toks))
                ids.append(hit[0])
                tiers.append(hit[1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.string()), pa.array(tiers, pa.int32())], names=["value", "hit", "tier"])
    return run


_PART = "value string, starts array<int>, ends array<int>, ids array<array<string>>, joined array<string>, cost int, winners array<string>, neutral array<boolean>"


def _part_finder(entries, known, neutral, respelled):
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            matcher = _matcher(key, entries, known, neutral, respelled)
            cols: list[list] = [[] for _ in range(8)]
            for text in b.column(0).to_pylist():
                toks = tokens(text)
                f = matcher.find(toks, lazily=False)
                spans = sorted(f.mentions.items())
                for c, v in zip(cols, (text, [s for s, _ in spans], [e for _, (e, _) in spans], [sorted(i) for _, (_, i) in spans], sorted(f.joined), f.cost,
                                       sorted(f.winners), matcher.neutral_tokens(toks)), strict=True):
                    c.append(v)
            many, one = pa.list_(pa.string()), pa.list_(pa.int32())
            kinds = (pa.string(), one, one, pa.list_(many), many, pa.int32(), many, pa.list_(pa.bool_()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                                            names=["value", "starts", "ends", "ids", "joined", "cost", "winners", "neutral"])
    return run


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge what the blocks found about each value."""
    for b in batches:
        ids, tiers = [], []
        for parts in b.column(1).to_pylist():
            total = None
            for p in parts:
                f = Found({s: (e, frozenset(i)) for s, e, i in zip(p["starts"], p["ends"], p["ids"], strict=True)}, frozenset(p["joined"]), p["cost"], frozenset(p["winners"]))
                if total is None:
                    total = f
                else:
                    total.merge(f)
            hit, tier = total.decide(parts[0]["neutral"])
            ids.append(hit)
            tiers.append(tier)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.string()), pa.array(tiers, pa.int32())], names=["value", "hit", "tier"])


def map_to_list(df: DataFrame, id_col: str, text_col: str, entries: DataFrame, entry_id: str, name_col: str, alias_col: str | None = None,
                neutral: str = NEUTRAL, respelled: tuple = RESPELLED) -> DataFrame:
    """``id_col, canonical_id, tier`` of every row with a text that is not null or blank.

    ``canonical_id`` is the id of the entry meant or ``UNMATCHED``; a value that fits
    two entries equally well is unmatched.  ``tier``: 0 mention, 1 joined spelling,
    2 token-set similarity, 9 unmatched.  Null, empty and blank texts give no row;
    repeated rows are mapped each; an empty list leaves every value unmatched; null
    names and aliases are skipped.  ``neutral`` is wording that changes no meaning,
    ``respelled`` cheap respellings as (pattern, replacement).  Lists longer than
    ``BLOCK`` names go over the distinct values block by block, with the same result.
    """
    names = entries.select(F.col(entry_id).cast("string").alias("i"), F.col(name_col).alias("n"))
    if alias_col:
        names = names.unionByName(entries.select(F.col(entry_id).cast("string").alias("i"), F.explode(alias_col).alias("n")))
    names = names.where("i is not null and n is not null and trim(n) <> ''").distinct()
    scratch = Scratch(df.sparkSession, "mapping")
    rows = df.select(F.col(id_col).alias("row_id"), F.trim(F.regexp_replace(F.lower(text_col), r"\s+", " ")).alias("value")).where(F.col("value").rlike(r"\S"))
    values = rows.groupBy("value").agg(F.count("*").alias("n"))
    blocks = max(1, -(-names.count() // BLOCK))
    if blocks == 1:
        counted = scratch.keep(values)
        mapped = counted.select("value").mapInArrow(_mapper([(r.i, r.n) for r in names.collect()], neutral, respelled), "value string, hit string, tier int")
    else:
        counted = scratch.keep(values)
        cut = [names.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k) for k in range(blocks)]
        known: set[str] = set()
        for part in cut:
            known.update(w for r in part.toLocalIterator() if (t := tokens(r.n)) and listed(r.n, t) for w in t)
        words = WordSet.of(known)
        every = None
        for part in cut:
            found = counted.select("value").mapInArrow(_part_finder([(r.i, r.n) for r in part.collect()], words, neutral, respelled), _PART)
            every = found if every is None else every.unionByName(found)
        whole = every.groupBy("value").agg(F.collect_list(F.struct("starts", "ends", "ids", "joined", "cost", "winners", "neutral")).alias("parts"))  # one for each block
        mapped = whole.mapInArrow(_decide, "value string, hit string, tier int")
    mapped = scratch.keep(mapped)
    total = counted.agg(F.sum("n")).first()[0] or 0
    out = salted_lookup(rows, mapped, "value", F.col("row_id"), heavy_keys(counted, "value", "n", total))
    return out.select(F.col("row_id").alias(id_col), F.coalesce("hit", F.lit(UNMATCHED)).alias("canonical_id"), "tier")

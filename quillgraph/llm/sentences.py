"""Sentence boundaries across languages and scripts.

Rules after the Unicode sentence-break properties: terminators of all scripts
(``STerm``/``ATerm``), closing quotes and brackets that stay with the sentence,
blank lines as paragraph separators, and continuation when a lower-case word
follows.  On top: abbreviations of the language of the row and of the languages
seen in the paragraph, decimals, initials, quoted speech that the sentence around
it carries on, and spaces between statements in scripts that write no full stop.
The time grows in proportion to the text.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Abbreviations that never end a sentence, by language.
NEVER_FINAL = {
    "en": "dr mr mrs ms prof messrs rev hon gen vs cf approx ca e.g i.e instr s.e.m s.d k v viz resp incl st",
    "de": "bzw z.b u.a d.h lt ca dr prof hr fr vgl bd evtl ggf inkl exkl max min st sog z.t i.d.r bspw etw geb",
    "es": "dr dra sr sra srta p.ej ej aprox ud uds lic ing",
    "fr": "p.ex ex env m mm mme mlle dr pr cf éd av apr",
    "it": "dr dott sig sigg prof ecc es ca cfr ing avv",
    "pt": "dr dra sr sra prof ex aprox ed",
    "nl": "dr dhr mevr prof bijv d.w.z i.p.v o.a nl resp ca",
    "ru": "см ср т.е т.к т.д т.п им проф д-р акад напр",
    "hi": "डॉ मि.ग्रा प्रो श्री",
    "ar": "د أ",
}
#: Abbreviations that go on if a number, a letter that numbers, or a lower-case word follows.
BEFORE_NUMBER = {
    "en": "fig figs eq eqs sect sec no nos vol p pp tab ch ref refs jan feb mar apr jun jul aug sep sept oct nov dec",
    "de": "abb tab nr s art kap jan feb mär apr jun jul aug sep sept okt nov dez",
    "es": "fig figs núm pág págs tab art vol cap",
    "fr": "fig figs tab vol art chap no p pp",
    "it": "fig figg tab n pag pagg vol art cap",
    "pt": "fig figs tab n pág págs vol art cap",
    "nl": "fig afb tab nr blz hfst art",
    "ru": "рис табл стр г гг",
}
#: Abbreviations that end a sentence if a new one plainly starts behind them.
MAYBE_FINAL = {
    "en": "al etc a.m p.m i.v i.m s.c p.o b.i.d t.i.d q.d inc ltd co corp jr sr min max",
    "de": "al etc usw min max",
    "es": "al etc a.m p.m",
    "fr": "al etc",
    "it": "al ecc",
    "pt": "al etc",
    "nl": "al enz",
    "ru": "др соавт",
}
#: Abbreviations inside names, which end a sentence only before a word that mostly starts one.
BEFORE_NAME = {"en": "u.s u.k u.n e.u univ dept inst assoc", "de": "univ inst", "es": "ee.uu univ", "fr": "univ", "it": "univ", "pt": "univ"}
#: Words that mostly start a sentence where they are capitalised, and by which a language is known.
FUNCTION_WORDS = {
    "en": "the a an this that these those it he she we they i in on at of for with and but or if when while after before there however its his her their our no not was were is are by to as from",
    "de": "der die das ein eine und aber es er sie wir in im am an auf nach bei mit von zu den dem des nicht war ist sich für unter",
    "es": "el la los las un una y pero en no se que del con por para tras según su al es fue",
    "fr": "le la les un une et mais il elle ils nous dans en au aux des du est par pour sur après ce cette ne pas",
    "it": "il lo la gli le un una e ma in di del della che non si con per dopo è",
    "pt": "o a os as um uma e mas em do da dos das que não se com por para após é foi",
    "nl": "de het een en maar in op van dat die niet is was met voor bij na wij zij",
}
#: German months (for ordinals such as "5. Mai").
MONTHS = "januar februar märz april mai juni juli august september oktober november dezember"
#: Thai words that join what stands on both sides, before or behind a space.
THAI_JOINS_NEXT = "และ หรือ แต่ ที่ ซึ่ง เพราะ เนื่องจาก โดย เช่น ได้แก่ คือ ว่า กับ ของ ๆ"
THAI_JOINS_LAST = "และ หรือ แต่ ว่า เช่น ได้แก่ คือ โดย กับ ของ"

_MONTHS = frozenset(MONTHS.split())
_NEXT = tuple(w for w in THAI_JOINS_NEXT.split())
_LAST = tuple(THAI_JOINS_LAST.split())
_SPLIT = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}



def _either(chars, times: str = "") -> tuple[re.Pattern, re.Pattern]:
    """Patterns of some characters: for texts of the basic plane, which are searched much faster, and for all."""
    return tuple(re.compile(f"[{re.escape(''.join(sorted(x)))}]{times}") for x in ([c for c in chars if c <= "\uffff"], chars))


# Characters by their sentence-break property and category (the planes that hold terminators and brackets).
_EVERY = "".join(chr(i) for i in (*range(0xD800), *range(0xE000, 0x20000)))
_SENT_TERM = "".join(c for c in regex.findall(r"\p{Sentence_Break=STerm}", _EVERY) if c not in "!?！？") + "！？"
_ATERM = "!?…" + "".join(regex.findall(r"\p{Sentence_Break=ATerm}", _EVERY))
_BREAK_CLOSE = regex.findall(r"\p{Sentence_Break=Close}", _EVERY)
_STERM = _SENT_TERM + "।॥｡。"
_STRONG = frozenset(_STERM)
_TERMINATORS = _STRONG | frozenset(_ATERM)
_CLOSE = frozenset("\"'" + "".join(c for c in _BREAK_CLOSE if unicodedata.category(c) in ("Pe", "Pf")))
_OPEN = frozenset("\"¿¡" + "".join(c for c in _BREAK_CLOSE if unicodedata.category(c) in ("Ps", "Pi")))
#: Opening marks with what closes them: brackets by their place in the code charts, quotation marks as languages pair them.
_PAIRS = {c: e for c in _BREAK_CLOSE if unicodedata.category(c) == "Ps" for e in (chr(ord(c) + 1), chr(ord(c) + 2)) if unicodedata.category(e) == "Pe"}
_PAIRS |= {"“": "”", "„": "“”", "«": "»", "‹": "›"}
_OPENERS_OF: dict[str, list[str]] = {}
for _o, _cs in _PAIRS.items():
    for _c in _cs:
        _OPENERS_OF.setdefault(_c, []).append(_o)
_MARKS = _either({'"', *_PAIRS, *_OPENERS_OF})
_BRACKETS = frozenset(c for c in _PAIRS if c in "([{（［｛")
_NO_START = _CLOSE | frozenset("，、,；;：:")
_BLANK = re.compile("(?:\r\n|\r|\n)[^\\S\r\n]*(?:\r\n|\r|\n)\\s*|[\u2029\f\v]+\\s*")
_TERM = _either(_TERMINATORS, "+")
_CJK = re.compile(r"[⺀-ヿㇰ-鿿豈-﫿ｦ-ﾟ]")
_THAI = re.compile(r"[฀-໿ក-៿က-႟]")
_CASELESS = re.compile(r"[֐-ࣿऀ-෿฀-໿က-႟ក-៿⺀-鿿가-힯]")
_TOKEN_EDGES = "([«„“\"（「"
_CONTINUES = re.compile(r"[，、,；;：:とはがをにのもへでやりっ]")
_NUMBER = re.compile(r"[\d.,٫٬]+%?$")
_NUMBERED = re.compile(r"[(\[]?(?:[A-Za-z]{0,2}-?\d|[IVXLC]+\b|[A-Za-z]\b)")
_WORD = re.compile(r"[^\W\d_]+")
_GLUED = re.compile(r".*[^\W\d_]{3,}[.!?…]+([^\W\d_]+)$")
_DEVANAGARI = re.compile(r"[ऀ-ॿ]")
_ANY = frozenset(w for t in (NEVER_FINAL, BEFORE_NUMBER, MAYBE_FINAL, BEFORE_NAME) for words in t.values() for w in words.split())
_SCRIPTS = (("ru", re.compile("[Ѐ-ӿ]")), ("hi", re.compile("[ऀ-ॿ]")), ("ar", re.compile("[؀-ۿ]")))


@cache
def _abbreviations(langs: frozenset[str]) -> tuple[frozenset[str], ...]:
    """(never final, before a number, maybe final, before a name, function words) of some languages together."""
    return tuple(frozenset(w for k in langs for w in t.get(k, "").split()) for t in (NEVER_FINAL, BEFORE_NUMBER, MAYBE_FINAL, BEFORE_NAME, FUNCTION_WORDS))


def _language(lang: str | None) -> str | None:
    """Two-letter code of a language field; None if it names no language with abbreviations here."""
    code = (lang or "").strip().lower()[:2]
    return code if code in NEVER_FINAL else None


def languages(text: str, lang: str | None = None) -> frozenset[str]:
    """Languages whose abbreviations count in a paragraph: the one stated for the row, and those whose script or function words stand in it."""
    found = {lang} if lang else set()
    found.update(k for k, script in _SCRIPTS if script.search(text))
    seen = set(_WORD.findall(text.lower()))
    hits = {k: len(seen & w) for k, w in _SPLIT.items()}
    most = max(hits.values())
    found.update(k for k, n in hits.items() if n and n >= min(2, most))
    return frozenset(found) if found & NEVER_FINAL.keys() else frozenset(NEVER_FINAL)


def _quote_spans(text: str, lo: int, hi: int, wide: bool) -> list[tuple[int, int]]:
    """Outermost (open, close) positions of quotations and brackets within one paragraph."""
    spans: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    places: dict[str, list[int]] = {}  # places in the stack, by opening mark
    for m in _MARKS[wide].finditer(text, lo, hi):
        ch, i = m.group(), m.start()
        at = max((places[o][-1] for o in (('"',) if ch == '"' else _OPENERS_OF.get(ch, ())) if places.get(o)), default=-1)
        if at >= 0:
            spans.append((stack[at][1], i))
            while len(stack) > at:
                places[stack.pop()[0]].pop()
        elif ch == '"' or ch in _PAIRS:
            places.setdefault(ch, []).append(len(stack))
            stack.append((ch, i))
    outer: list[tuple[int, int]] = []
    for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
        if not outer or a > outer[-1][1]:
            outer.append((a, b))
    return outer


def _starts(text: str, j: int, hi: int) -> bool | None:
    """Whether the text at j looks like a sentence start; None if it can't be told."""
    while j < hi and text[j] in _OPEN:
        if text[j] not in "([（":
            return True
        j += 1
    if j >= hi:
        return None
    c = text[j]
    if c.isupper() or c.istitle() or c.isdigit():
        return True
    if c.islower():
        word = re.match(r"[^\W_]+", text[j:j + 40])
        if word and any(x.isupper() for x in word.group()) and not word.group()[0].isupper() and not _CASELESS.search(word.group()):
            return True  # mRNA, pH
        return False
    return None if not c.isalpha() else True


def _token_before(text: str, i: int, lo: int) -> str:
    """The characters right before i up to a blank, an opening bracket or quotation mark, at most 40."""
    parts = text[max(lo, i - 40):i].split()
    if not parts or text[i - 1].isspace():
        return ""
    token = parts[-1]
    for edge in _TOKEN_EDGES:
        if edge in token:
            token = token[token.rfind(edge) + 1:]
    token = token.lstrip("'’‘")
    if "." in token or "!" in token or "?" in token or "…" in token:
        glued = _GLUED.match(token)
        if glued:  # the space behind the sentence before was lost
            token = glued.group(1)
    return token


def _abbreviation(text: str, i: int, lo: int, nxt: int, hi: int, told: Callable[[], frozenset[str]]) -> bool:
    """Whether the single full stop at i belongs to an abbreviation that goes on; ``told`` gives the languages of the paragraph."""
    token = _token_before(text, i, lo)
    if not token:
        return False
    low = token.lower().rstrip(".")
    after = text[nxt] if nxt < hi else ""
    tail = low.rsplit(".", 1)[-1]
    if len(low) > 2 and "." not in low and low not in _ANY and not _DEVANAGARI.match(token[-1]):
        return False  # an ordinary word
    langs = told()
    never, numbered, maybe, named, function = _abbreviations(langs)
    if low in maybe or tail in maybe and "." not in low:
        if low in ("min", "max"):
            before = text[max(lo, i - len(token) - 12):i - len(token)].rstrip().rsplit(None, 1)
            return not (before and _NUMBER.match(before[-1]))
        if after.isdigit():
            return bool(re.match(r"(?:19|20)\d\d\b", text[nxt:nxt + 5]))
        return _starts(text, nxt, hi) is not True
    if low in ("mm", "ms", "m") and low in never | numbered:  # titles, or units behind a number
        if re.search(r"\d\s*$", text[max(lo, i - len(token) - 4):i - len(token)]):
            return False
        return after.isdigit() or after.islower() or after.isupper() and low != "mm"
    if low in numbered:
        return after.islower() or _NUMBERED.match(text[nxt:nxt + 8]) is not None
    core = token.rstrip(".")
    acronym = re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", core) is not None  # U.S., S.E.M.
    if low in never or re.sub(r"\s", "", low) in never:
        return low not in ("ud", "av", "st") or after.isdigit() or after.islower() or low == "st" and after.isupper()
    if low in named or acronym:
        word = _WORD.match(text[nxt:nxt + 16])
        return not (word and word.group()[0].isupper() and word.group().lower() in function)
    if _DEVANAGARI.match(core[-1:]):  # Devanagari ends sentences with a danda
        return True
    if len(core) == 1 and core.isalpha():  # initials, z. B., т. е., u. a.; behind a number it is a unit
        if re.search(r"\d\s+$", text[max(lo, i - len(token) - 3):i - len(token)]):
            return after.islower()
        return not _CASELESS.match(core) or core in "دأم"
    if core.isdigit() and len(core) <= 2 and "de" in langs:
        word = _WORD.match(text[nxt:nxt + 12])
        if word and word.group().lower() in _MONTHS:
            return True
    return False


def _thai_breaks(text: str, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """Spaces between two complete statements where the script writes no full stop.

    A statement is complete unless it is joined: by a number, a comma or a word that
    links both sides, or because one side is shorter than any clause.
    """
    for m in re.compile(r"\s+").finditer(text, lo, hi):
        a, b = m.start(), m.end()
        if a == lo or b >= hi:
            continue
        before = re.search(r"\S+$", text[max(lo, a - 60):a]).group()
        if _THAI.match(text[b]):
            if _NUMBER.fullmatch(before):
                prior = re.search(r"(\S+)\s+\S+$", text[max(lo, a - 80):a])
                if not (prior and prior.group(1).lower() == "type"):
                    continue
            behind = re.match(r"\S+", text[b:b + 60]).group()
            if text[a - 1] in ",;:ๆ" or before.endswith(_LAST) or behind.startswith(_NEXT):
                continue
            if _THAI.match(before) and len(before) < 4 or len(behind) < 4 and _THAI.match(behind):
                continue
            yield a, b
        elif _THAI.search(text[a - 1]) and re.match(r"[A-ZÀ-Þ][a-zà-ÿ]+\s", text[b:b + 40]):
            yield a, b


def _alone(text: str, lo: int, hi: int, a: int, b: int) -> bool:
    """Whether the quotation a..b stands alone: nothing of a sentence before it or behind it."""
    j = a - 1
    while j >= lo and text[j].isspace():
        j -= 1
    if j >= lo and text[j] not in _TERMINATORS and text[j] not in _CLOSE or text[a] in _BRACKETS:
        return False
    k = b + 1
    while k < hi and text[k].isspace():
        k += 1
    return k >= hi or (_starts(text, k, hi) is True and not _CONTINUES.match(text[k]))


def _paragraph(text: str, lo: int, hi: int, out: list[tuple[int, int]], lang: str | None, wide: bool) -> None:
    cuts: list[tuple[int, int]] = []  # (end of sentence, start of next)
    spans = _quote_spans(text, lo, hi, wide)
    ends = {b for _, b in spans}
    alone: dict[int, bool] = {}
    span = 0  # the first that ends behind the terminator
    known: list[frozenset[str]] = []

    def told() -> frozenset[str]:
        if not known:
            known.append(languages(text[lo:hi], lang))
        return known[0]

    for m in _TERM[wide].finditer(text, lo, hi):
        i, e = m.start(), m.end()
        run = m.group()
        while span < len(spans) and spans[span][1] <= i:
            span += 1
        inside = spans[span] if span < len(spans) and spans[span][0] < i else None
        # closing marks that belong to the sentence, with the space French sets before them
        end = e
        while end < hi:
            k = end
            while k < hi and text[k] in "   " and k - end < 2:
                k += 1
            if k < hi and text[k] in _CLOSE and (k == end or text[k] in "»›"):
                if text[k] in "\"'“" and k not in ends:
                    break
                end = k + 1
            elif k < hi and text[k] == "“" and k in ends:
                end = k + 1
            else:
                break
        if inside and end <= inside[1]:
            # inside quoted speech or brackets: only a quotation that stands alone is cut inside
            if span not in alone:
                alone[span] = _alone(text, lo, hi, *inside)
            if not alone[span]:
                continue
        nxt = end
        while nxt < hi and text[nxt].isspace():
            nxt += 1
        if nxt >= hi:
            continue
        gap = nxt > end
        c = text[nxt]
        if c in _NO_START and c not in "\"'" or c in _TERMINATORS:
            continue
        strong = any(x in _STRONG for x in run)
        closed = end > e
        prev = text[i - 1] if i > lo else " "
        if strong:
            if closed and (_CONTINUES.match(c) or c.islower() and not _CASELESS.match(c) and not _CASELESS.search(text[max(lo, i - 8):i])):
                continue
            cuts.append((end, nxt))
            continue
        if run[0] == "…" or run.startswith("..."):
            if _CJK.match(prev) and (len(run) > 1 or not gap) and not (closed and _CONTINUES.match(c)):
                cuts.append((end, nxt))
            elif _starts(text, nxt, hi) and gap and not c.isdigit():
                cuts.append((end, nxt))
            continue
        start = _starts(text, nxt, hi)
        caseless = bool(_CASELESS.search(text[max(lo, i - 12):i]))
        if "!" in run or "?" in run:
            if start or start is None and gap or (not closed and (caseless or c in "¿¡")) or (caseless and gap and not _CONTINUES.match(c)):
                cuts.append((end, nxt))
            continue
        # full stop
        if not gap and not closed:
            word = re.match(r"[^\W\d_]{2,}", text[nxt:nxt + 60])
            before = re.search(r"[^\s]+$", text[max(lo, i - 40):i])
            tok = before.group() if before else ""
            if c in "“„«\"(¿¡" and tok:
                pass
            elif not word and not (c.isupper() and text[nxt + 1:nxt + 2] in ("'", "’", " ", "\n", "\xa0")):
                continue
            elif not (len(tok) > 1 or prev.isdigit()):
                continue
            elif c.isupper() or c.isalpha() and _CASELESS.match(c):
                if "://" in tok or tok.lower().startswith("www."):
                    continue
            elif c.islower():
                glued = re.match(r"[^\W_-]+(?:-[^\W_]+)*", text[nxt:nxt + 60]).group()
                if not (_CJK.search(glued) or _THAI.search(glued) or text[nxt:nxt + 60].strip() and prev.isdigit() and len(word.group()) > 3
                        or caseless):
                    continue
            else:
                continue
            if _abbreviation(text, i, lo, nxt, hi, told):
                continue
            cuts.append((end, nxt))
            continue
        if len(run) == 1 and not closed and _abbreviation(text, i, lo, nxt, hi, told):
            continue
        if start or start is None:
            cuts.append((end, nxt))
        elif caseless and not closed:
            cuts.append((end, nxt))
    if _THAI.search(text, lo, hi):
        opens = [a for a, _ in spans]

        def quoted(x: int) -> bool:
            k = bisect_right(opens, x) - 1
            return k >= 0 and opens[k] < x < spans[k][1]

        cuts.extend(c for c in _thai_breaks(text, lo, hi) if not quoted(c[0]))
        cuts = sorted(set(cuts))
    at = lo
    for end, nxt in cuts:
        if end > at:
            out.append((at, end))
            at = nxt
    if hi > at:
        out.append((at, hi))


def paragraph_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of the parts between blank lines, surrounding whitespace excluded."""
    spans, at = [], 0
    for m in _BLANK.finditer(text):
        spans.append((at, m.start()))
        at = m.end()
    spans.append((at, len(text)))
    return [s for s in (_strip(text, a, b) for a, b in spans) if s[1] > s[0]]


def _strip(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and text[a].isspace():
        a += 1
    while b > a and text[b - 1].isspace():
        b -= 1
    return a, b


def sentence_spans(text: str, lang: str | None = None) -> list[tuple[int, int]]:
    """(start, end) of every sentence of a text in order, surrounding whitespace excluded; ``lang``: its language, if known."""
    out: list[tuple[int, int]] = []
    lang, wide = _language(lang), not text.isascii() and max(text) > "\uffff"
    for lo, hi in paragraph_spans(text):
        _paragraph(text, lo, hi, out, lang, wide)
    return [s for s in (_strip(text, a, b) for a, b in out) if s[1] > s[0]]


_SCHEMA = pa.schema([("doc_key", pa.int64()), ("sent_no", pa.int32()), ("sent_start", pa.int64()), ("sent_end", pa.int64()), ("sentence", pa.string())])


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols: list[list] = [[], [], [], [], []]
        for key, text, lang in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            for n, (s, e) in enumerate(sentence_spans(text, lang)):
                for c, v in zip(cols, (key, n, s, e, text[s:e]), strict=True):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SCHEMA, strict=True)], schema=_SCHEMA)


def split_sentences(df: DataFrame, id_col: str, text_col: str, lang_col: str | None = None) -> DataFrame:
    """One row per sentence: ``id_col, sent_no, sent_start, sent_end, sentence``.

    Offsets count code points from 0; ``sent_end`` is just behind the last character.
    Null, empty and blank texts have no sentence; a text without any terminator is
    one sentence per paragraph.  ``lang_col`` names the language of a row (null or
    unknown: told from each paragraph).  Repeated rows are split each.  No shuffle:
    each text is handled where it is read.
    """
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    rows = df.select(F.col(id_col).cast("long").alias("doc_key"), F.col(text_col).alias("text"), lang.alias("lang")).where("text is not null and doc_key is not null")
    out = rows.mapInArrow(_split, "doc_key bigint, sent_no int, sent_start bigint, sent_end bigint, sentence string")
    return out.withColumnRenamed("doc_key", id_col)

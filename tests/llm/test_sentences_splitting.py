import math
import random
import time
from collections import Counter

import pytest
from helpers import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm.sentences import paragraph_spans, sentence_spans, split_sentences
from quillgraph.llm.splitting import _Blocks, depths, split_oversized, split_text, units

CASES = [
    ("One. Two! Three?", ["One.", "Two!", "Three?"]),
    ("Dr. Smith saw Fig. 3 at 8 a.m. He left.", ["Dr. Smith saw Fig. 3 at 8 a.m.", "He left."]),
    ("It fell by 4.5% in vitro, e.g. in mice. mRNA rose.", ["It fell by 4.5% in vitro, e.g. in mice.", "mRNA rose."]),
    ("As Li et al. noted, it works. This agrees with Li et al. Others differ.", ["As Li et al. noted, it works.", "This agrees with Li et al.", "Others differ."]),
    ('"Why did it stop?" asked one nurse. He wrote, "It stopped. We slept," and left.', ['"Why did it stop?" asked one nurse.', 'He wrote, "It stopped. We slept," and left.']),
    ('The report says: "None was seen." All left.', ['The report says: "None was seen."', "All left."]),
    ("(The lung was not sampled.) A rise followed.", ["(The lung was not sampled.)", "A rise followed."]),
    ("RESULTS: It rose.\nIt fell\nagain.\n\nNo stop here\n \nNext", ["RESULTS: It rose.", "It fell\nagain.", "No stop here", "Next"]),
    ("It went to the U.S. Reference Unit on Jan. 5. Done.", ["It went to the U.S. Reference Unit on Jan. 5.", "Done."]),
    ("It rose... then fell. How long is unknown... A second one came.", ["It rose... then fell.", "How long is unknown...", "A second one came."]),
    ("The space was lost.Next one. See www.a.example/x.", ["The space was lost.", "Next one.", "See www.a.example/x."]),
    ("Am 5. Mai kam z. B. Anna bzw. Otto. Er sagte: „Gut.“ Dann ging er.", ["Am 5. Mai kam z. B. Anna bzw. Otto.", "Er sagte: „Gut.“", "Dann ging er."]),
    ("Le rapport note : « Rien. » Env. 25 adultes, p. ex. Paul !", ["Le rapport note : « Rien. »", "Env. 25 adultes, p. ex. Paul !"]),
    ("¿Por qué? ¡No! El Dr. Gil lo vio.", ["¿Por qué?", "¡No!", "El Dr. Gil lo vio."]),
    ("На рис. 4 видно, т. е. ясно. По К. Вадолу и др. это так.", ["На рис. 4 видно, т. е. ясно.", "По К. Вадолу и др. это так."]),
    ("没有复发！报告写道“未见。已消失。”，随后停用。结果不清楚……为什么？", ["没有复发！", "报告写道“未见。已消失。”，随后停用。", "结果不清楚……", "为什么？"]),
    ("報告は「なかった。消えた。」と述べた。分からない……。次。", ["報告は「なかった。消えた。」と述べた。", "分からない……。", "次。"]),
    ('डॉ. वादोलू ने 4 मि.ग्रा. दिया। क्या असर हुआ? aspirin ने सूजन कम की।', ["डॉ. वादोलू ने 4 मि.ग्रा. दिया।", "क्या असर हुआ?", "aspirin ने सूजन कम की।"]),
    ("هل تغير بعد إعطاء aspirin؟ انسحب 3؛ والسبب مجهول. يذكر: «لم يعد».", ["هل تغير بعد إعطاء aspirin؟", "انسحب 3؛ والسبب مجهول.", "يذكر: «لم يعد»."]),
    ("อาการหายไปหลังจาก 7 สัปดาห์ ยาaspirinลดการอักเสบ ไม่พบโรคanemia type 2 ผลนี้ดี", ["อาการหายไปหลังจาก 7 สัปดาห์", "ยาaspirinลดการอักเสบ", "ไม่พบโรคanemia type 2", "ผลนี้ดี"]),
    ("It was a big fig. We ate it. See fig. 4 and Fig. S2.", ["It was a big fig.", "We ate it.", "See fig. 4 and Fig. S2."]),
    ("He studied at univ. She left. He lives in the U.S. She stays.", ["He studied at univ.", "She left.", "He lives in the U.S.", "She stays."]),
    ("This is one‽ This is two.", ["This is one‽", "This is two."]),
    ("Սա մեկ է։ Սա երկու է։", ["Սա մեկ է։", "Սա երկու է։"]),
    ("នេះជាមួយ។នេះជាពីរ។", ["នេះជាមួយ។", "នេះជាពីរ។"]),
    ("ꦲꦏ꧉ ꦧꦕ꧉", ["ꦲꦏ꧉", "ꦧꦕ꧉"]),
    ("ߊߋ߹ ߌߍ߹ ܐܒ܂ ܓܕ܂", ["ߊߋ߹", "ߌߍ߹", "ܐܒ܂", "ܓܕ܂"]),
    ("𑂃𑂄𑃀 𑂅𑂆𑃀", ["𑂃𑂄𑃀", "𑂅𑂆𑃀"]),
    ("ผู้ป่วยดีขึ้นและ ไม่มีอาการ แต่กลับมาอีก", ["ผู้ป่วยดีขึ้นและ ไม่มีอาการ แต่กลับมาอีก"]),
    ("", []), (" \n\n ", []), ("no end", ["no end"]),
]


@pytest.mark.parametrize("text,want", CASES)
def test_sentences(text, want):
    assert [text[a:b] for a, b in sentence_spans(text)] == want


def test_abbreviations_follow_the_language():
    text = "Der Wert fiel um ca. Zehn Prozent."
    assert len(sentence_spans(text, "de")) == 1 and len(sentence_spans("Wait for the max. Then stop it now.", "en")) == 1
    assert [len(sentence_spans("Ver pág. Nueve de la lista.", x)) for x in ("es", None)] == [2, 2] and len(sentence_spans("Ver pág. 9 de la lista.", None)) == 1


@pytest.mark.parametrize("unit", ["(", "(a. ", '"A b." ', "«([", "A b. ", ") . ", "„ . “ ", "ก ข "])
def test_time_grows_with_the_text(unit):
    n = 400_000 // len(unit)
    t = time.perf_counter()
    sentence_spans(unit * (n // 8))
    short = time.perf_counter() - t
    t = time.perf_counter()
    sentence_spans(unit * n)
    assert time.perf_counter() - t < 16 * short + 1


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aB. !?\n\"“”«»()。、…กข0مए", max_size=80))
def test_spans_cover_everything_but_blanks(text):
    spans = sentence_spans(text)
    covered = set()
    for (a, b), nxt in zip(spans, [*spans[1:], (len(text), len(text))], strict=False):
        assert a < b <= nxt[0] and not text[a].isspace() and not text[b - 1].isspace()
        covered.update(range(a, b))
    assert all(i in covered or c.isspace() for i, c in enumerate(text))
    assert all(any(p <= a and b <= q for p, q in paragraph_spans(text)) for a, b in spans)


def test_sentence_rows(spark):
    df = spark.createDataFrame([(1, "Ab cd. Ef gh.", 0), (2, None, 0), (3, "", 0), (1, "Ab cd.", 0), (None, "X.", 0)], "id bigint, text string, sent_no int")
    assert rows(split_sentences(df, "id", "text")) == [(1, 0, 0, 6, "Ab cd."), (1, 0, 0, 6, "Ab cd."), (1, 1, 7, 13, "Ef gh.")]
    assert split_sentences(df.limit(0), "id", "text").count() == 0


def check_pieces(text, limit, overlap):
    level, pieces = split_text(text, limit, overlap)
    covered = set()
    for k, (a, b) in enumerate(pieces):
        assert 0 < b - a <= limit
        if k:
            assert pieces[k - 1][0] < a and pieces[k - 1][1] < b and pieces[k - 1][1] - a <= overlap
        covered.update(range(a, b))
    assert all(i in covered or c.isspace() for i, c in enumerate(text))
    return level, pieces


def test_cut_levels():
    sent = "The dose was raised in the second week and most of them slept better. "
    para = (sent * 3).strip()
    assert check_pieces("\n\n".join([para] * 9), 300, 40)[0] == "paragraph"
    assert check_pieces(sent * 12, 300, 40)[0] == "sentence"
    assert check_pieces("word " * 300, 300, 40)[0] == "word"
    assert check_pieces("x" * 1000, 300, 40)[0] == "char"
    assert check_pieces("ab " * 50 + "y" * 301, 300, 40)[0] == "char"
    assert units("a\n\nb", 5) == ("paragraph", [(0, 1), (3, 4)])


def test_topic_change_is_the_cut():
    a, b = "The kidney filters blood through tiny vessels. ", "Prices of bread rose sharply during winter months. "
    text = (a * 4 + b * 4).strip()
    level, pieces = check_pieces(text, 300, 0)
    assert level == "sentence" and text[pieces[0][0]:pieces[0][1]].endswith("vessels.") and "bread" not in text[pieces[0][0]:pieces[0][1]]


def test_cuts_fall_on_topic_changes():
    """Texts of topics with words of their own: most cuts stand where the topic changes."""
    r = random.Random(5)
    hits = cuts = 0
    for _ in range(30):
        text, changes = "", set()
        for _topic in range(8):
            words = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(3)) for _ in range(9)]
            for _s in range(r.randrange(4, 7)):
                text += " ".join(r.choice(words) for _ in range(8)).capitalize() + ". "
            changes.add(len(text) - 1)
        text = text.strip()
        level, pieces = check_pieces(text, 600, 60)
        assert level == "sentence"
        cuts += len(pieces) - 1
        hits += sum(b in changes for _, b in pieces[:-1])
    assert hits >= 0.9 * cuts


def test_block_similarity_matches_plain_counts():
    r = random.Random(2)
    bags = [[r.choice("abcdefg") * 5 for _ in range(r.randrange(0, 9))] for _ in range(40)]
    text, spans = "", []
    for bag in bags:
        spans.append((len(text), len(text) + len(" ".join(bag))))
        text += " ".join(bag) + " "
    blocks = _Blocks()
    for k in range(10):
        blocks.add(0, bags[k])
    for k in range(10, 20):
        blocks.add(1, bags[k])
    for k in range(5):
        blocks.drop(0, bags[k])
    a, b = Counter(w for k in range(5, 10) for w in bags[k]), Counter(w for k in range(10, 20) for w in bags[k])
    want = sum(a[w] * b[w] for w in a) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
    assert abs(blocks.cosine() - want) < 1e-12 and len(depths(text, spans, 10)) == 39


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab.\n ", min_size=31, max_size=200))
def test_pieces_hold_for_any_text(text):
    if len(text) > 30:
        check_pieces(text, 30, 10)


def test_piece_rows(spark):
    df = spark.createDataFrame([(1, "w " * 900), (2, "short"), (3, None), (4, ""), (5, " " * 1200)], "id bigint, text string")
    got = split_oversized(df, "id", "text")
    assert {r.id for r in got.collect()} == {1, 5} and all(len(r.piece) <= 1000 for r in got.collect())
    assert split_oversized(df.limit(0), "id", "text").count() == 0

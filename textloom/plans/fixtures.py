"""Small books, made up, as rows: the supplied tables hold no Korean text.

``plans.books`` reads them beside a supplied table, and the tests use them too.
"""

from __future__ import annotations

from textloom.functions.morphology import Token

LONG = "People often think that the first answer is the best one to give."


def head(n: int, code: str | None = None, lesson: str = "01") -> str:
    return f"# 강 {lesson} # 쪽 008 # 번 {n:03d} # 문항코드 {code or f'10000-{n:04d}'}"


def item(asked, body, *, choices=(), answer=None, note=(), told=("이것은 해석이다.",), **h) -> list[str]:
    lines = [head(**h), "[ 문제]", asked, *body, *choices]
    if answer:
        lines += ["[ 정답모범답안]", str(answer)]
    return [*lines, "{ 소재}", "사람의 생각", "{ 해석}", *told, "{Solution Guide}", *note]


#: For each type the lines of an item, and its passage with the answer put in.
ITEMS = {
    "AS_IS": (item("다음 글의 제목으로 가장 적절한 것은?", [LONG, "And so it goes on for days."], n=1), LONG + " And so it goes on for days."),
    "REPLACE": (item("다음 글의 밑줄 친 부분 중, 어법상 틀린 것은?", [LONG, "It makes it easier for all of us ② perceive", "the story as it is told by them."], answer=2, note=["②에서 perceive를 discern으로 고쳐야 한다."], n=2), LONG + " It makes it easier for all of us discern the story as it is told by them."),
    "FILL": (item("다음 빈칸에 들어갈 말로 가장 적절한 것은?", [LONG, "Yet it is mostly ______ by far."], choices=["① good", "② bad"], answer=2, n=3), LONG + " Yet it is mostly bad by far."),
    "REMOVE": (item("다음 글에서 전체 흐름과 관계 없는 문장은?", [LONG, "It was a fine day in spring and we went out ① All was well then.", "That is why we know it ② Cats are fine to have", "at home indeed. ③ So all went home again and slept very well."], answer=2, told=["하나이다. (고양이는 좋다.) 둘이다."], n=4), LONG + " It was a fine day in spring and we went out  All was well then. That is why we know it  So all went home again and slept very well."),
    "REORDER": (item("주어진 글 다음에 이어질 글의 순서로 가장 적절한 것은?", [LONG, "(A) Then it was first.", "(B) Then it was second.", "(C) Then it was third."], choices=["① (A)-(C)-(B)", "② (B)-(C)-(A)"], answer=2, told=["(B) 둘 (C) 셋 (A) 하나"], n=5), LONG + " Then it was second. Then it was third. Then it was first."),
    "INSERT": (item("글의 흐름으로 보아, 주어진 문장이 들어가기에 가장 적절한 곳은?", ["However, this is not so.", "It was said to be so. ( ① ) It was in the book. ( ② ) It ends here."], answer=2, n=6), "It was said to be so. It was in the book. However, this is not so. It ends here."),
    "SUMMARY": (item("다음 글의 내용을 한 문장으로 요약하고자 한다. 빈칸 (A), (B)에 들어갈 말은?", [LONG, "And so it goes on for days.", "↓", "It is a(n) (A) that leads to (B) ."], choices=["① idea …… loss", "② game …… gain"], answer=1, told=["글이다. → 요약이다."], n=7), LONG + " And so it goes on for days.\n\nIt is an idea that leads to loss."),
    "SKIP": (item("다음 도표의 내용과 일치하지 않는 것은?", [LONG, "And so it goes on for days."], n=8), LONG + " And so it goes on for days."),
}

#: A book of these items, then a set of two items and a set of three.
BOOK = ["before", "01 강 글의 목적", "01 강 다른 이름", *(line for lines, _ in ITEMS.values() for line in lines)]
BOOK += ["# 강 02 # 쪽 010 # 번 001~002 # 문항코드", "[ 지문]", LONG, "It was (a) good and then (b) bad in the end.", "{ 해석}", "그것은 나쁜(→ 좋은) 것이다."]
BOOK += item("윗글의 제목으로 가장 적절한 것은?", [], n=1, lesson="02", code="x")
BOOK += item("밑줄 친 (a)~(e) 중에서 문맥상 낱말의 쓰임이 적절하지 않은 것은?", [], answer=2, note=["(b)의 bad를 fine과 같은 낱말로 바꾸어야 한다."], n=2, lesson="02", code="y")
BOOK += ["# 강 03 # 쪽 010 # 번 001~003 # 문항코드", "(A)", "First there was one (a) thing.", "(B)", "Bees came next.", "(C)", "Cats came after.", "(D)", "Dogs came last.", "{ 해석}", "(A) 하나", "(B) 벌", "(C) 고양이", "(D) 개"]
for _n, _choices in enumerate([["① (C)-(B)-(D)", "② (D)-(B)-(C)"], [], []], 1):
    BOOK += item("주어진 글 (A)에 이어질 내용을 순서에 맞게 배열한 것은?" if _choices else "윗글의 내용과 일치하는 것은?", [], choices=_choices, answer=2, n=_n, lesson="03", code=f"z{_n}")

#: (item, type, lesson, number, set size, passage, translation) of the book.
_TOLD = {"REMOVE": "하나이다. 둘이다.", "REORDER": "둘 셋 하나", "SUMMARY": "글이다.\n\n→ 요약이다."}
BOOK_ITEMS = [
    # the lines of the last one go on to the next header, so its longest block is that of the set after it
    (k, kind, "01", f"{k:03d}", 0, f"{LONG} It was (a) good and then (b) bad in the end." if kind == "SKIP" else passage, None if kind == "SKIP" else _TOLD.get(kind, "이것은 해석이다."))
    for k, (kind, (_, passage)) in enumerate(ITEMS.items(), 1)
]
BOOK_ITEMS += [
    (9, "AS_IS", "02", "001", 2, f"{LONG} It was good and then bad in the end.", "그것은 좋은 것이다."),
    (10, "REPLACE", "02", "002", 2, f"{LONG} It was good and then fine in the end.", "그것은 좋은 것이다."),
]
_SET = ("First there was one thing.\n\nDogs came last.\n\nBees came next.\n\nCats came after.", "하나\n\n개\n\n벌\n\n고양이")
BOOK_ITEMS += [(11, "REORDER", "03", "001", 3, *_SET), (12, "AS_IS", "03", "002", 3, *_SET), (13, "AS_IS", "03", "003", 3, *_SET)]

_GROUP = "Long text of the group that goes on. " * 6
#: Questions of a mock exam, and (n, instruction, body, choices) of them.
EXAM = [
    "17. out of range", "18. 다음 글의 목적으로 가장", "적절한 것은?", "Dear all,", "We write to you.", "* note: 주석", "3", "① one", "② two",
    "20. 다음 글에서 어법상 틀린 것은?", "It is ① good.", "② Bad it is.",
    "[31 ~ 32] 다음 빈칸에 들어갈 말을", "고르시오.", "31. Research shows", "that it is.", "① a", "32.", "Only this.", "① b",
    "[41~42] 다음 글을 읽고, 물음에 답하시오.", _GROUP, "41. 제목은?", "① t", "42. 낱말은?", "① u", "20. again",
]
EXAM_QUESTIONS = [
    (18, "다음 글의 목적으로 가장 적절한 것은?", "Dear all,\nWe write to you.", "① one\n② two"),
    (20, "다음 글에서 어법상 틀린 것은?", "It is ① good.\n② Bad it is.", ""),
    (31, "다음 빈칸에 들어갈 말을 고르시오.", "Research shows\nthat it is.", "① a"),
    (32, "다음 빈칸에 들어갈 말을 고르시오.", "Only this.", "① b"),
    # the line after a group header is taken into its instruction
    (41, f"다음 글을 읽고, 물음에 답하시오. {_GROUP.strip()}", _GROUP.strip(), "① t"),
    (42, f"다음 글을 읽고, 물음에 답하시오. {_GROUP.strip()}", _GROUP.strip(), "① u\n20. again"),
]
_ANSWER = "긴 해석이 여기에 있다. " * 20
#: Answers of the exam, and (n, answer, translation, solution) of them.
EXAM_KEY = [
    "18 ① 19 ③", "20. ② 18 ⑤", "해 설", "19 ⑤", "18. [출제의도] 목적", "하나의 해석이다.", "7", "둘째 줄이다.", "pulse 박자", "beat 고동",
    "20. [출제 의도] 어법", "[해석] 첫 줄", "다음 줄", "[풀이]", "푸는 법", "[어휘]", "word 낱말", "[41~42]", _ANSWER, "41. [출제의도] 제목", "x", "42. [출제의도] 낱말", "y",
]
EXAM_ANSWERS = [(18, "①", "하나의 해석이다.\n둘째 줄이다.", ""), (20, "②", "첫 줄\n다음 줄", "푸는 법"), (41, "", _ANSWER.strip(), ""), (42, "", _ANSWER.strip(), "")]

#: Pages of a textbook, and (lesson, position, qid, instruction, body, choices, vocab, footnote) of its problems.
TEXTBOOK = {
    6: ["Contents", "", "01", "글의 목적 파악", "8", "12", "3번", "9", "02", "장문 독해", "10"],
    8: ["글의 목적 파악", "G", "ateway", "다음 글의 목적으로 가장 적절한 것은?", "Dear all,", "We write.", "① one", "② two", "□ word 낱말", "* note: 주석", "26005-0001", "Solving Strategies", "advice", "xercises"],
    9: ["다음 글의 주제로", "가장 적절한 것은?", "It is so.", "* term: 용어", "① x", "26005-0002", "lost"],
    10: ["01~02 다음 글을 읽고, 물음에 답하시오.", "Long text", "goes on.", "01. 윗글의 제목은?", "① t", "26005-0003", "02. 밑줄 친 말은?", "① u", "26005-0004", "따라서 무엇인가?", "이것은 무엇인가?", "Body", "26005-0005"],
}
TEXTBOOK_PROBLEMS = [
    (1, 0, "26005-0001", "다음 글의 목적으로 가장 적절한 것은?", "Dear all,\nWe write.", "① one\n② two", "□ word 낱말\n* note: 주석", "* note: 주석"),
    (1, 1, "26005-0002", "다음 글의 주제로 가장 적절한 것은?", "It is so.", "① x", "", "* term: 용어"),
    (2, 0, "26005-0003", "다음 글을 읽고, 물음에 답하시오.", "Long text\ngoes on.", "01. 윗글의 제목은?\n① t", "", ""),
    (2, 1, "26005-0004", "02. 밑줄 친 말은?", "", "① u", "", ""),
    (2, 2, "26005-0005", "이것은 무엇인가?", "Body", "", "", ""),
]
#: The lines of its solution book; (lesson, problem, answer, topic, translation, guide, structure, page) of the problems.
SOLUTION = [
    "Part I 유형편", "03 유형편", "01 글의 목적 파악", "두 번 G ateway ② 유형편", "E xercises 01 ③ 02 ⑤", "03 ①", "ateway 본문 10쪽", "정답 ② 유형편", "소재 편지 유형편",
    "해석 첫 줄 유형편", "둘째 줄", "Solution Guide 유형편", "푸는 법", "Culture Note", "문화", "E 본문 12~15쪽", "xercises", "33 사람", "01 유형편", "정답 ③", "해석 하나", "Structure in Focus", "구조", "02", "해석 둘", "해석 셋",
    "02 장문 독해", "G ateway 01 ② 02 ⑤", "E xercises 01 ① 02 ②", "ateway 본문 20쪽", "정답 01 ② 02 ⑤", "해석 긴 글", "E 본문 22~23쪽", "정답 01 ① 02 ④", "해석 함께", "TEST 본문 172쪽", "해석 밖",
]
SOLVED = [
    (1, "gw", "②", "편지", "첫 줄\n둘째 줄", "푸는 법", "", 10),
    (1, "01", "③", "", "하나", "", "구조", None),
    (1, "02", "", "", "둘\n셋", "", "", None),
    (2, "gw", "②,⑤", "", "긴 글", "", "", 20),
    (2, "01", "①", "", "함께", "", "", None),
    (2, "02", "④", "", "함께", "", "", None),
]
#: (lesson, position, exercise, answer, body, translation) of both books joined.
TEXTBOOK_MERGED = [
    (1, 0, None, "②", "Dear all,\nWe write.", "첫 줄\n둘째 줄"),
    (1, 1, "01", "③", "It is so.", "하나"),
    (2, 0, None, "②,⑤", "Long text\ngoes on.", "긴 글"),
    (2, 1, "01", "①", "Long text\ngoes on.", "함께"),
    (2, 2, "02", "②", "Body", "함께"),
]

#: Texts whose wrong blanks no analyzer is needed for, and as they should be.
SAFE_SPACING = [
    ("Berlin 에서 왔다.", "Berlin에서 왔다."),
    ("Berlin 에서 시작", "Berlin에서 시작"),
    ("최근에 Qukkon 에 도착한 금광 채굴자", "최근에 Qukkon에 도착한 금광 채굴자"),
    ("1924 년", "1924년"),
    ("3 명, 4 개.", "3명, 4개."),
    ("그의 말씀) 은 옳다", "그의 말씀)은 옳다"),
    ("말씀) 은 옳다", "말씀)은 옳다"),
    ("편해졌 다.", "편해졌다."),
    ("갔 지? 왔 네!", "갔지? 왔네!"),
    ("그것은 다 좋다", "그것은 다 좋다"),
    ("Berlin 이스라엘", "Berlin 이스라엘"),
    ("단기적인 규모로 이루어져야 한다.", "단기적인 규모로 이루어져야 한다."),
    ("사회 과학자들이 문화를 연구", "사회 과학자들이 문화를 연구"),
    ("그 일을 할 수 있다", "그 일을 할 수 있다"),
    ("한 번 더 시도", "한 번 더 시도"),
    ("", ""),
]
#: The same for the rules that go on until nothing changes.
LOOSE_SPACING = [
    ("정보 를 찾고 있습니 다.", "정보를 찾고 있습니다."),
    ("그 녀는 갔다", "그녀는 갔다"),
    ("하지 만, 사람 들 과 함께", "하지만, 사람 들 과 함께"),
    ("학교 에서 는 배운다", "학교에서는 배운다"),
    ("no Hangul 는", "no Hangul 는"),
    ("plain  text", "plain  text"),
    ("", ""),
]

#: Words and their forms and tags, and texts as the analyzer would write them.
WORDS = {
    "확보": "확보/NNG", "확보하기": "확보/NNG 하/XSV 기/ETN", "사람": "사람/NNG", "사람하나": "사람/NNG 하나/NR",
    "맞": "맞/VV", "맞지만": "맞/VV 지만/EC", "주": "주/NNG", "주어지는": "주어지/VV 는/ETM", "약": "약/NNG", "약화시켜": "약화/NNG 시키/XSV 어/EC",
    "능": "능/NNG", "능력을": "능력/NNG 을/JKO", "있어야": "있/VV 어야/EC", "있어야한다": "있/VV 어야/EC 하/VX ㄴ다/EF", "해주다": "하/VV 아/EC 주/VX 다/EF", "주다": "주/VV 다/EF",
    "가나": "가나/NNG", "가나다": "가나다/NNG",
}


class SmallAnalyzer:
    """Words it does not know are one unknown token; it writes the texts it knows as listed."""

    texts = {"능 력을 길러 있어야 한다": "능력을 길러 있어야한다", "해주다": "해 주다", "새집": "새 집", "가나 다  라마": "가나다 라마", " 능 력을": "능력을"}

    def tokens(self, text):
        if text == "해주다":
            return [Token("하", "VV", 0), Token("주", "VX", 1), Token("다", "EF", 2)]
        return [Token(*t.split("/"), 0) for t in WORDS[text].split()] if text in WORDS else [Token(text, "UN", 0)]

    def score(self, text):
        return 10.0 if text in ("안타깝게도", "찾을") else 5.0001 if " " in text else 0.0

    def spaced(self, text):
        return self.texts.get(text, text)


def small_analyzer() -> SmallAnalyzer:
    return SmallAnalyzer()


#: (text, as repaired, wrong blanks, if missing blanks are style) with that analyzer.
ANALYZED = [
    ("확보 하기 위해 사람 하나", "확보하기 위해 사람 하나", 0, False),
    ("맞 지만 주 어지는 약 화시켜 의 결함", "맞지만 주어지는 약화시켜 의 결함", 0, False),
    ("능 력을 길러 있어야 한다", "능력을 길러 있어야 한다", 1, False),
    # the blanks between and around words are kept where there are several
    ("가나 다  라마", "가나다  라마", 1, False),
    (" 능 력을", " 능력을", 1, False),
    ("해주다", "해주다", 0, True),
    ("새집", "새집", 0, False),
    ("  ", "  ", 0, False),
    ("", "", 0, False),
]

#: (text, phrases with colours, coloured runs)
HIGHLIGHTS = [
    ("I like big cats", [("big", "blue"), ("cats", "green")], [(7, 10, "blue"), (11, 15, "green")]),
    ("Did you know that", [("you", "blue"), ("Did you know", "orange")], [(0, 4, "orange"), (4, 7, "blue"), (7, 12, "orange")]),
    ("to work out your mind here", [("to work out your mind", "green"), ("work", "orange")], [(0, 3, "green"), (3, 7, "orange"), (7, 21, "green")]),
    ("her flight had been “delayed.”", [("had been “delayed”", "blue")], [(11, 30, "blue")]),
    ("make it or make it again", [("make", "blue"), ("make", "orange")], [(0, 4, "blue"), (11, 15, "orange")]),
    ("a plain sentence", [("nonexistent phrase", "blue")], []),
    ("stopword는 word를 word.", [("word", "red"), ("word", "blue")], [(10, 14, "red"), (16, 20, "blue")]),
    ("concat", [("cat", "red")], [(3, 6, "red")]),
    ("the cat sat", [("cat", "red"), ("the cat sat", "blue")], [(0, 4, "blue"), (4, 7, "red"), (7, 11, "blue")]),
    ("same same", [("same", "red"), ("same", "blue"), ("same", "green")], [(0, 4, "red"), (5, 9, "blue")]),
]

#: (text, choices, text with underlines)
UNDERLINES = [
    ("You may ①possess — some talent", ["① possess", "② from", "③ to be"], "You may ①<u>possess</u> — some talent"),
    ("the work ⑤has been called art today", ["⑤ has been called", "① have only just discovered"], "the work ⑤<u>has been called</u> art today"),
    ("①helped and ②resisted change", ["① helped", "② resisted"], "①<u>helped</u> and ②<u>resisted</u> change"),
    ("①helped only", ["① helped", "④ ridiculous"], "①<u>helped</u> only"),
    ("may ① possess things", ["boom", "① possess"], "may ① <u>possess</u> things"),
    ("①apple pie", ["① banana"], "①apple pie"),
    ("no markers here at all", ["① possess"], "no markers here at all"),
    ("① b", ["① a", "① b", "plain"], "① <u>b</u>"),
]

#: (number, answer, choices, shown kind, circled answer or None)
ANSWERS = [
    (1, 1, ["a", "b"], None, "①"), (2, 0, ["a", "b"], None, None), (3, 3, ["a", "b"], None, None), (4, None, ["a"], None, None), (5, 9, ["a"], "서술형", None),
    (6, 5, [], None, "⑤"), (7, 6, [], None, None), (8, 7, list("abcdefgh"), None, "⑦"), (9, 8, list("abcdefgh"), None, None), (10, 9, None, None, None),
]
BAD_ANSWERS = [2, 3, 4, 7, 9]

#: (page, word, x0, y0, x1, y1, text) of two pages 612 points wide, and (line, page, column, text, is_break) by coverage.
PLACED = [
    (1, 0, 60.0, 200.0, 92.0, 210.0, "그의"), (1, 1, 92.5, 201.0, 124.0, 211.0, "책은"), (1, 2, 130.0, 203.0, 160.0, 213.0, "word"), (1, 3, 145.0, 203.0, 149.0, 213.0, "."), (1, 4, 60.0, 230.0, 92.0, 240.0, "다음"), (1, 5, 75.0, 231.0, 79.0, 241.0, ","),
    (2, 0, 60.0, 200.0, 220.0, 210.0, "왼쪽"), (2, 1, 60.0, 214.0, 220.0, 224.0, "left"), (2, 2, 360.0, 200.0, 520.0, 210.0, "오른쪽"), (2, 3, 360.0, 240.0, 520.0, 250.0, "right"),
]
PLACED_LINES = [(0, 1, 0, "그의책은 word .", False), (1, 1, 0, "다, 음", True), (2, 2, 0, "왼쪽", True), (3, 2, 0, "left", False), (4, 2, 1, "오른쪽", True), (5, 2, 1, "right", True)]

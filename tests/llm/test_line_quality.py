import re
from collections import Counter

import regex

from residua.llm import line_quality as q
from residua.llm.queries import op3_line_quality


def slow_base(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    counts = Counter(grams)
    covered = {k + j for k, g in enumerate(grams) if counts[g] > 1 for j in range(3)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


SEPARATORS = {"|", ">", "<", ">>", "»", "›", "·", "•", "/", "-", "--"}


def slow_line(line):
    """Whether a line goes, by all rules on text."""
    words = re.findall(r"[^\x20\x09-\x0D]+", line)
    n = len(words)
    share = lambda k: 100 * k / n
    if not n:
        return False
    if share(sum(w in SEPARATORS for w in words)) > 20 or n <= 3 and len("".join(words)) <= 36 and not regex.search(r"[\p{Terminal_Punctuation}\p{Sentence_Terminal}…][\"'”’»)\]」』]*$", words[-1]):
        return True
    if share(sum(w.endswith("!!") for w in words)) > 30 or share(sum(w[-1] in "#*$%&|<>" for w in words)) > 30:
        return True
    if n >= 5 and share(sum(w.isupper() and len(w) > 1 for w in words)) > 60:
        return True
    phrases = "|".join(q.BOILERPLATE)
    return share(sum(len(m[0].split()) for m in re.finditer(rf"\b({phrases})\b|[{{}}©]+", line, re.I))) >= 50


def slow_verdict(t):
    """Words and lines removed, what is left, and whether the document stays."""
    lines = (t or "").split("\n")
    bad = [slow_line(x) for x in lines]
    words = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x))
    lost = sum(words(x) for x, b in zip(lines, bad, strict=True) if b)
    base = slow_base(t)
    return sum(bad), lost, "\n".join(x for x, b in zip(lines, bad, strict=True) if not b), not base[-1] and 100 * lost <= 50 * base[0]


def test_verdict_by_brute_force(spark, odd_docs):
    made = [
        "Read the PRIVACY POLICY now please.\nÉCRIT TOUT EN MAJUSCULES ÇA VA\nEs WAR EINMAL ein Ort",
        "Alle Rechte vorbehalten. Impressum\nTous droits réservés ©\nTodos los derechos reservados.\n" + "Eine ganz gewöhnliche Zeile mit Worten steht hier. " * 12,
        "function f() { return x } end\nsome { words } here are code or not so sure of it\nBUY!! NOW!! ok yes",
        "a b c\na b c.\na / b - c | d\none# two* three$ four five six\n\n   \n|",
    ]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(made, 100)), "doc_id bigint, text string"))
    docs = docs.union(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"))
    got = sorted(((r.doc_id, r.n_lines_removed, r.n_words_removed, r.cleaned, r.kept) for r in q.quality(docs).collect()), key=repr)
    assert got == sorted(((r.doc_id, *slow_verdict(r.text)) for r in docs.collect()), key=repr)


def test_prose_with_one_phrase_stays(spark):
    """Long lines are not lost for a single word or phrase."""
    text = " ".join(f"word{k}" for k in range(1000)) + " a cookie, the copyright, read more { here."
    assert q.judge(text)[6] and q.judge(text)[7] == 0


def same(rows, docs):
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows), key=repr)
    assert got == sorted(((d, *slow_base(t)) for d, t in docs), key=repr)
    assert not any(r.kept and r.base_failed for r in rows)


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = op3_line_quality(spark, sf).collect()
    same(rows, [tuple(r) for r in docs.select("doc_id", "text").collect()])
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").collect()}
    assert all(r.kept for r in rows if r.doc_id in good and not r.base_failed)


def test_odd_rows(odd_docs, no_docs):
    same(q.quality(odd_docs).collect(), [tuple(r) for r in odd_docs.select("doc_id", "text").collect()])
    assert q.quality(no_docs).count() == 0


def test_lines():
    fails = lambda t: q.line_fails(t.encode(), t.encode().split(), True)
    assert fails("Home | About | Contact | News") == "navigation"
    assert fails("Read on") == "navigation"
    assert fails("BUY!! NOW!! AND!! HERE!!") == "punctuation"
    assert fails("one### two*** three$$$ four%%%") == "punctuation"
    assert fails("We use cookies.") == "boilerplate" and fails("Copyright 2020 Acme. All rights reserved.") == "boilerplate"
    assert fails("Das Impressum.") == "boilerplate" and fails("Aviso legal y política de privacidad.") == "boilerplate"
    assert not any(map(fails, ("Copyright law is old.", "We log in at noon.", "We use cookies to make this site better.", "Wir haben ein Impressum.")))
    assert fails("ÉCRIT TOUT EN MAJUSCULES ÇA VA.") == "punctuation"
    assert fails("She baked a cookie for the children and put it on the table.") is None
    assert fails("This is a plain sentence of prose.") is None
    assert fails("A verse without an end at all") is None
    text = "Home | About | News\n" + "This is a plain sentence of prose number one. " * 3
    assert q.judge(text)[-1] == text.split("\n", 1)[1]


def test_scripts():
    """Short lines end in the marks of their script, and lines of a script without blanks are long though of few words."""
    lines = {
        "ar": "هل أنت بخير؟", "ur": "یہ ٹھیک ہے۔", "hi": "वह घर गया।", "am": "ሰላም ነው።", "hy": "Նա գնաց։", "zh": "他今天早上很早就起床然后走了很远的路到城里去买东西看望他的老朋友们并且一起吃饭聊天直到晚上",
        "ja": "「行きましょう。」", "th": "วันนี้อากาศดีมากเราจึงออกไปเดินเล่นที่สวนสาธารณะใกล้บ้านกันทั้งครอบครัว", "bo": "བཀྲ་ཤིས་བདེ་ལེགས།",
    }
    for text in lines.values():
        assert q.line_fails(text.encode(), text.encode().split(), False) is None, text
    arabic = "\n".join(f"{'ابتثجحخ'[k % 7] * 3} {'دذرزسش'[k % 6] * 4} {'صضطظع'[k % 5] * 3}؟" for k in range(40))
    assert q.judge(arabic)[6] and q.judge(arabic)[7] == 0
    assert q.line_fails("首页 新闻".encode(), "首页 新闻".encode().split(), False) == "navigation"


def test_document_that_loses_too_much(spark):
    prose = " ".join(f"word{k}" for k in range(60)) + "."
    nav = "\n".join(f"a{k} | b{k} | c{k}" for k in range(40))
    rows = {r.doc_id: r for r in q.quality(spark.createDataFrame([(1, prose), (2, prose + "\n" + nav)], "doc_id bigint, text string")).collect()}
    assert rows[1].kept and not rows[2].kept and not rows[2].base_failed
    assert rows[2].cleaned == prose

"""Line-first quality rules: bad lines go first, then documents that lost too much of their text.

Base figures (words, symbols, repeated lines and repeated three-word windows) come from the whole
text. Each line is judged on its own by punctuation, navigation and boilerplate rules; lines that
fail one are removed. A document is kept where the base figures pass and the removed lines hold at
most ``MAX_LOST`` percent of its words. One pass over the text where it lies; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import regex
from pyspark.sql import DataFrame

from residua.llm.common import map_batches

MIN_WORDS = 50
MAX_REPEATED = 50
MAX_LOST = 50
#: Line rules: share of words, in percent.
MAX_SYMBOL_WORDS, MAX_BANG_WORDS, MAX_UPPER_WORDS, MAX_SEPARATORS = 30, 30, 60, 20
#: Words of a navigation line at most, and code points of these: scripts without blanks have long lines of few words.
NAVIGATION_WORDS, NAVIGATION_LETTERS = 3, 36

SYMBOLS = b"#*$%&|<>"
SYMBOL_BYTES = [bytes([c]) for c in SYMBOLS]
#: What ends sentences and clauses, in all scripts, by its Unicode property; also after closing quotes and brackets.
ENDS = "".join(c for c in map(chr, (*range(0xD800), *range(0xE000, 0x20000))) if regex.match(r"[\p{Terminal_Punctuation}\p{Sentence_Terminal}…]", c))
TERMINAL = re.compile(rf"[{re.escape(ENDS)}][\"'”’»)\]」』]*$")
SEPARATORS = frozenset((b"|", b">", b"<", b">>", "»".encode(), "›".encode(), "·".encode(), "•".encode(), b"/", b"-", b"--"))
#: Share of a line's words, in percent, that boilerplate phrases must make up.
MIN_BOILERPLATE_WORDS = 50
#: Phrases of legal notes, consent and calls to click, as whole words, in English, German, French and Spanish.
BOILERPLATE = (
    "accept cookies", "all rights reserved", "click here", "cookie policy", "copyright", "enable javascript", "licensed under", "log in", "lorem ipsum",
    "powered by", "privacy policy", "read more", "share on", "share this", "sign up", "subscribe to", "terms of service", "terms of use", "use cookies", "uses cookies",
    "alle rechte vorbehalten", "allgemeine geschäftsbedingungen", "cookies akzeptieren", "datenschutzerklärung", "hier klicken", "impressum", "jetzt anmelden",
    "mehr lesen", "newsletter abonnieren", "nutzungsbedingungen", "verwendet cookies", "weiterlesen",
    "accepter les cookies", "cliquez ici", "conditions générales", "lire la suite", "mentions légales", "politique de confidentialité", "se connecter",
    "tous droits réservés", "utilise des cookies",
    "aceptar cookies", "aviso legal", "haga clic aquí", "iniciar sesión", "leer más", "política de privacidad", "términos de uso", "todos los derechos reservados", "utiliza cookies",
)
BOILERPLATE_PHRASE = re.compile(r"\b(?:" + "|".join(BOILERPLATE) + r")\b|[{}©]+", re.IGNORECASE)
#: What a text must hold somewhere for a phrase to be possible: the longest part of each phrase in ASCII, one for all of cookies.
HINTS = tuple({b"cookie" if "cookie" in x else max(re.findall("[a-z ]+", x), key=len).encode() for x in BOILERPLATE} | {b"{", b"}", "©".encode()})
UPPER, ASCII = bytes(range(65, 91)), bytes(range(128))
SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, "
    "n_lines_removed bigint, n_words_removed bigint"
)


def line_fails(line: bytes, words: list[bytes], hinted: bool) -> str | None:
    """The rule that a line fails: punctuation, navigation or boilerplate. Lines without words pass.

    ``hinted`` tells that the text has a boilerplate phrase somewhere.
    """
    n = len(words)
    if not n:
        return None
    if 100 * sum(map(SEPARATORS.__contains__, words)) > MAX_SEPARATORS * n:
        return "navigation"
    if n <= NAVIGATION_WORDS and sum(len(w.decode("utf-8")) for w in words) <= NAVIGATION_LETTERS and not TERMINAL.search(words[-1].decode("utf-8")):
        return "navigation"
    if b"!!" in line and 100 * sum(w.endswith(b"!!") for w in words) > MAX_BANG_WORDS * n:
        return "punctuation"
    # counts in the whole line bound those of words, which are looked at only where they could be enough
    if 100 * sum(map(line.count, SYMBOL_BYTES)) > MAX_SYMBOL_WORDS * n and 100 * sum(w[-1] in SYMBOLS for w in words) > MAX_SYMBOL_WORDS * n:
        return "punctuation"
    # letters beyond ASCII have two bytes at least
    upper = len(line) - len(line.translate(None, UPPER)) + (0 if line.isascii() else len(line.translate(None, ASCII)) / 2)
    if n >= 5 and 100 * upper > 2 * MAX_UPPER_WORDS * n and 100 * sum(s.isupper() and len(s) > 1 for s in (w.decode("utf-8") for w in words)) > MAX_UPPER_WORDS * n:
        return "punctuation"
    if hinted and 100 * sum(len(m[0].split()) for m in BOILERPLATE_PHRASE.finditer(line.decode("utf-8"))) >= MIN_BOILERPLATE_WORDS * n:
        return "boilerplate"
    return None


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in three-word windows found twice or more, the first one included."""
    grams = list(zip(words, words[1:], words[2:]))
    counts = Counter(grams)
    if len(counts) == len(grams):
        return 0
    total, covered_to = 0, 0
    for k, g in enumerate(grams):
        if counts[g] > 1:
            total += k + 3 - max(k, covered_to)
            covered_to = k + 3
    return total


def judge(text: str | None) -> tuple:
    """All figures of SCHEMA after doc_id."""
    text = text or ""
    raw = text.encode("utf-8")
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(raw.count, (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c")))
    symbols = sum(map(raw.count, SYMBOL_BYTES))
    lowered = raw.lower()
    hinted = any(h in lowered for h in HINTS)
    seen: set[bytes] = set()
    dup = lines_removed = words_removed = 0
    kept_lines = []
    for raw_line in raw.split(b"\n"):
        line_words = raw_line.split()
        if line_words:
            dup += raw_line in seen
            seen.add(raw_line)
        if line_fails(raw_line, line_words, hinted):
            lines_removed += 1
            words_removed += len(line_words)
        else:
            kept_lines.append(raw_line)
    repeats = repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeats > MAX_REPEATED * n
    kept = not failed and 100 * words_removed <= MAX_LOST * n
    return n, chars, symbols, dup, repeats, failed, kept, lines_removed, words_removed, b"\n".join(kept_lines).decode("utf-8")


def quality(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """Figures and verdict of each row; ``with_text`` adds the ``cleaned`` text.

    Null and empty texts have no words and clean to the empty text. Rows are judged one by one, so
    repeated rows get equal answers; a null doc_id stays null. Texts may be of any length. Other columns are
    left out, so that none can clash. An empty table gives no rows.
    """
    schema = SCHEMA + (", cleaned string" if with_text else "")
    names = [f.split()[0] for f in schema.split(", ")]

    def run(cols: list[list]) -> Iterator[dict[str, list]]:
        for lo in range(0, len(cols[0]), 500):
            found = [judge(t)[: len(names) - 1] for t in cols[1][lo : lo + 500]]
            yield dict(zip(names, [cols[0][lo : lo + 500], *map(list, zip(*found, strict=True))], strict=True))

    return map_batches(docs.select("doc_id", "text"), run, schema)

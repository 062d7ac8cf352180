"""Telling the encoding of a text file that is not UTF-8.

In order: a byte order mark; a charset that the text itself declares, where it decodes and reads like its script; then
every known encoding that decodes without an error, each with a score of how much the result reads like text of the
script it is for: the share of its letters that are of the script, and how often neighbouring letters are of the same
script and a capital follows a small letter. The best score wins where it is sure enough and clear of the second,
encodings that give the same text counting as one; else the encoding is unknown, which is an error and no text.

UTF-16 without a mark is told by how many of its units are common characters in either byte order. Scores are taken from
the first 64 KB; the text is then decoded whole, without any error. Fewer than two letters beyond ASCII, three for other
scripts than the first, are too few to tell by.
"""

from __future__ import annotations

import codecs
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Sequence

# Encodings and the scripts that they are tried for; how a text declares its own.
ENCODINGS = (("cp949", "hangul"), ("gb18030", "han"), ("shift_jis", "kana"), ("windows-1251", "cyrillic"), ("windows-1252", "latin"))
WIDE = ("utf-16-le", "utf-16-be")
_DECLARED = re.compile(rb"(?i)(?:charset|encoding|coding)\s*[=:]\s*[\"']?\s*([a-z0-9_:.-]{2,40})")
_HEAD, _SCORED = 4096, 1 << 16
# Western words of one letter beyond ASCII.
_ALONE = frozenset("àÀáÁéÉèêíóôúâåÅøØæÆöÖäÄüÜ")
#: Least score, and least distance to the second.
SURE, CLEAR = 0.8, 0.1


def _script(c: str) -> str:
    n = ord(c)
    if 0xAC00 <= n <= 0xD7A3:
        return "hangul"
    if 0x3041 <= n <= 0x30FF:
        return "kana"
    if 0x4E00 <= n <= 0x9FFF:
        return "han"
    if 0x0400 <= n <= 0x04FF:
        return "cyrillic"
    if c.isalpha():
        return "latin" if n < 0x250 else "other"
    return ""


def _plausible(c: str) -> bool:
    """Marks that running text of any script has beside letters."""
    n = ord(c)
    return n < 0x80 and (n >= 0x20 or c in "\t\n\r\f") or 0x2010 <= n <= 0x2044 or 0x3000 <= n <= 0x303F or 0xFF00 <= n <= 0xFFEF or c in "\xa0§©«®°±·»¿¡№€¢£¥"


def _legible(text: str) -> float:
    """The share of characters that are letters, marks or white space, not controls, private or unassigned."""
    good = sum(_plausible(c) or _script(c) not in ("", "other") or unicodedata.category(c)[0] in "LNZPS" for c in text)
    controls = any(unicodedata.category(c) == "Cc" and c not in "\t\n\r\f" for c in text)
    return good / len(text) * (0.5 if controls else 1.0)


def _common_hangul(beyond: list[str], text: str, data: bytes) -> float:
    return sum(_script(c) == "hangul" for c in beyond) / len(beyond)


def _common_han(beyond: list[str], text: str, data: bytes) -> float:
    """Han text has characters of the second half of the first level (lead bytes from C9 on), where Korean syllables have none."""
    pairs = re.findall(rb"[\x81-\xfe][\x40-\xfe]", data)
    late = sum(0xC9 <= p[0] <= 0xD7 for p in pairs)
    early = sum(0xB0 <= p[0] <= 0xC8 for p in pairs)
    rare = sum(_script(c) not in ("han", "") for c in beyond) + sum(p[0] >= 0xD8 or p[0] < 0xA1 for p in pairs)
    share = sum(_script(c) == "han" or _plausible(c) for c in beyond) / len(beyond)
    return share * min(1.0, 6 * late / max(1, late + early)) * (1 - rare / max(1, len(pairs)))


def _common_kana(beyond: list[str], text: str, data: bytes) -> float:
    kana = sum(_script(c) == "kana" for c in beyond)
    rest = sum(_script(c) in ("kana", "han") or _plausible(c) for c in beyond)
    halves = sum(0xFF61 <= ord(c) <= 0xFF9F for c in beyond)
    return rest / len(beyond) * min(1.0, 5 * kana / len(beyond)) * (1 - halves / len(beyond))


def _words(text: str) -> list[str]:
    return re.findall(r"[^\W\d_]+", text)


def _in_words(script: str) -> Callable[[list[str], str, bytes], float]:
    """Of the words with a letter beyond ASCII, the share that are of one script and have capitals at their start only, or throughout."""

    def score(beyond: list[str], text: str, data: bytes) -> float:
        words = [w for w in _words(text) if not w.isascii()]
        letters = sum(_script(c) == script for c in beyond)
        known = letters + sum(_plausible(c) for c in beyond)
        if not words or not letters:
            return 0.0
        small = lambda w: 1.0 if w[1:] == w[1:].lower() and w != w.upper() or len(w) == 1 else 0.5 if w == w.upper() else 0.0
        good = sum(small(w) for w in words if all(_script(c) == script for c in w))
        return good / len(words) * known / len(beyond)

    return score


def _latin(beyond: list[str], text: str, data: bytes) -> float:
    """Western words are mostly ASCII letters; a word of other letters alone is hardly one."""
    words = [w for w in _words(text) if not w.isascii()]
    mixed = sum(any(c.isascii() for c in w) or w in _ALONE for w in words)
    plain = any(c.isascii() and c.isalpha() for c in text)
    return _in_words("latin")(beyond, text, data) * (mixed / len(words) if words and plain else 0.0)


_SCORES = {"hangul": _common_hangul, "han": _common_han, "kana": _common_kana, "cyrillic": _in_words("cyrillic"), "latin": _latin}


def _decoded(data: bytes, name: str) -> str | None:
    try:
        return data.decode(name)
    except (UnicodeDecodeError, LookupError):
        return None


def score(data: bytes, name: str, script: str) -> tuple[float, str | None]:
    """How much the bytes read like the script's text in an encoding, and that text."""
    text = _decoded(data, name)
    if not text:
        return 0.0, text
    head = data[:_SCORED]
    said = text if len(head) == len(data) else codecs.getincrementaldecoder(name)().decode(head)
    beyond = [c for c in said if ord(c) >= 0x80]
    letters = sum(_script(c) != "" for c in beyond)
    if not beyond or "\0" in said or letters < {"hangul": 2, "latin": 1}.get(script, 3):
        return 0.0, text
    return _SCORES[script](beyond, said, head) * _legible(said), text


def _wide(data: bytes) -> tuple[float, str | None, str]:
    """The better byte order of UTF-16 without a mark."""
    best = (0.0, None, "")
    if len(data) % 2 == 0:
        for name in WIDE:
            text = _decoded(data, name)
            if text and "\0" not in text:
                said = text[: _SCORED // 2]
                known = sum(c.isascii() and (c in " \n\r\t.,:;-" or c.isalnum()) or c in "。，、．？！「」（）" for c in said) / len(said)
                scripts = Counter(_script(c) for c in said if ord(c) >= 0x80)
                most = max(scripts["hangul"], scripts["kana"] + scripts["han"], scripts["cyrillic"], scripts["latin"]) / len(said)
                # other bytes taken for UTF-16 have no blanks, digits and stops in these places
                value = min(1.0, known + most) * _legible(said) * min(1.0, 20 * known)
                best = max(best, (value, text, name), key=lambda x: x[0])
    return best


def detect(data: bytes, encodings: Sequence[tuple[str, str]] = ENCODINGS) -> tuple[str, str] | None:
    """The encoding's name and the text; None where it is not known."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark) and (text := _decoded(data, name)) is not None:
            return name, text
    if (text := _decoded(data, "utf-8")) is not None and "\0" not in text:
        return "utf-8", text
    found = [(*score(data, name, script), name) for name, script in encodings]
    if m := _DECLARED.search(data[:_HEAD]):
        said = m[1].decode("ascii").lower()
        for name, script in encodings:
            if _decoded(b"a", said) and _same(said, name):
                value, text = score(data, name, script)
                if value >= SURE - 0.2 and text is not None:
                    return name, text
    ranked = sorted([*found, _wide(data)], key=lambda x: -x[0])
    (value, text, name), second = ranked[0], next((x for x in ranked[1:] if x[1] != ranked[0][1]), (0.0, None, ""))
    if text is None or value < SURE or value - second[0] < CLEAR:
        return None
    return name, text


def _same(said: str, name: str) -> bool:
    """Whether a declared charset is an encoding or a part of it."""
    part = {"euc_kr": "cp949", "johab": "", "gb2312": "gb18030", "gbk": "gb18030", "cp932": "shift_jis", "iso8859-1": "windows-1252", "latin-1": "windows-1252"}
    try:
        own = codecs.lookup(said).name
    except LookupError:
        return False
    return codecs.lookup(part.get(own, own) or "ascii").name == codecs.lookup(name).name

"""Reading text past its layout, markup and encoding."""

from __future__ import annotations

import html
import re
import unicodedata

# --- broken encodings: UTF-8 that was read as a one-byte code page -------------------------------------------

_BYTE = {bytes([b]).decode("cp1252", "ignore") or chr(b): b for b in range(0x80, 0x100)} | {chr(b): b for b in range(0x80, 0x100)}
_BROKEN = re.compile("[Â-ô](?:[" + "".join(re.escape(c) for c in sorted(_BYTE)) + "]){1,3}")
_RUN = re.compile("[" + "".join(re.escape(c) for c in sorted(_BYTE)) + "]+")


def _unbroken(m: re.Match) -> str:
    raw = bytes(_BYTE[c] for c in m.group())
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return m.group()


def repair(text: str) -> str:
    """Undo UTF-8 read as Windows-1252 or Latin-1, run by run, once or twice over."""
    if text.isascii():
        return text
    for _ in range(2):
        if not _BROKEN.search(text):
            return text
        fixed = _RUN.sub(_unbroken, text)
        if fixed == text:
            return text
        text = fixed
    return text


# --- markup ---------------------------------------------------------------------------------------------------

_INLINE = re.compile(r"</?(?:b|i|u|s|em|strong|span|font|a|code|sub|sup|mark|small|big|tt|del|ins|wbr)(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"<!--.*?-->|</?[a-zA-Z][^<>\n]{0,500}>", re.S)
_INVISIBLE = re.compile("[\u00ad\u200b-\u200d\u2060\ufeff\u180e\u034f\u202a-\u202e\u2066-\u2069]+")


def plain(text: str) -> str:
    """Without tags, entities, invisible characters and broken encodings; lines stay lines."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if not text.isascii():
        text = _INVISIBLE.sub("", repair(_INVISIBLE.sub("", text)))
    return text


# --- words ----------------------------------------------------------------------------------------------------

_SPLIT = re.compile(r"-(?<=[^\W\d_]-)[ \t]*\r?\n[ \t>|*#]*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")
_SAME = {"ß": "ss", "ł": "l", "Ł": "l", "ø": "o", "Ø": "o", "æ": "ae", "Æ": "ae", "œ": "oe", "Œ": "oe", "đ": "d", "Đ": "d", "ı": "i"}
_ODD = re.compile("[" + "".join(_SAME) + "]")
_COMBINING = re.compile("[" + "".join(chr(i) for i in range(0x300, 0x10000) if unicodedata.combining(chr(i))) + "]+")

# Letters of other scripts that look like Latin ones, for words that mix scripts.
_LOOK = str.maketrans("авекмнорстухіјѕԁԛһԝαβγεικνορτυχ", "abekmhopctyxijsdqhwabyeikvoptux")
_LATIN, _OTHER = re.compile("[a-z]"), re.compile("[Ͱ-ϿЀ-ԯ]")


def folded(text: str) -> str:
    """Lower case without accents; letters of other widths and forms as the plain ones."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", _ODD.sub(lambda m: _SAME[m.group()], text)).lower()
    return text if text.isascii() else _COMBINING.sub("", text)


def words(text: str) -> list[str]:
    """The words of a text as its reader sees them; words parted at a line's end are joined."""
    text = plain(text)
    if "-" in text:
        text = _SPLIT.sub("", text)
    found = _WORD.findall(folded(text))
    if not text.isascii() and _OTHER.search(text):
        found = [w.translate(_LOOK) if _OTHER.search(w) and _LATIN.search(w) else w for w in found]
    return found


# --- the same, with places --------------------------------------------------------------------------------------

_ENTITY = re.compile(r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")


class _Traced:
    """A text under rewriting, with the first and the end place in the original of each of its characters."""

    def __init__(self, text: str):
        self.text, self.a, self.b = text, list(range(len(text))), list(range(1, len(text) + 1))

    def sub(self, pattern: re.Pattern, new) -> None:
        """``pattern.sub``; all characters of a replacement stand for the whole of what was replaced."""
        out, a, b, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            i, j = m.span()
            r = new(m)
            if r == m.group():
                continue
            out += [self.text[at:i], r]
            a += self.a[at:i] + [self.a[i]] * len(r)
            b += self.b[at:i] + [self.b[j - 1]] * len(r)
            at = j
        if at:
            self.text, self.a, self.b = "".join(out) + self.text[at:], a + self.a[at:], b + self.b[at:]

    def each(self, new) -> None:
        """Every character by itself."""
        parts = [new(c) for c in self.text]
        self.a = [x for x, p in zip(self.a, parts) for _ in p]
        self.b = [x for x, p in zip(self.b, parts) for _ in p]
        self.text = "".join(parts)


def word_places(text: str) -> list[tuple[int, int]]:
    """Where each of ``words(text)`` stands in ``text``: its first character and the one after its last."""
    t = _Traced(text)
    gone = lambda m: ""
    t.sub(_ENTITY, lambda m: html.unescape(m.group()))
    t.sub(_INLINE, gone)
    t.sub(_TAG, lambda m: " ")
    t.sub(_INVISIBLE, gone)
    for _ in range(2):
        if not _BROKEN.search(t.text):
            break
        t.sub(_RUN, _unbroken)
    t.sub(_INVISIBLE, gone)
    t.sub(_SPLIT, gone)
    t.sub(_ODD, lambda m: _SAME[m.group()])
    t.each(lambda c: c if c < "\x80" else unicodedata.normalize("NFKD", c))
    lower = t.text.lower()
    if len(lower) == len(t.text):
        t.text = lower
    else:
        t.each(str.lower)
    t.sub(_COMBINING, gone)
    return [(t.a[m.start()], max(t.b[m.start() : m.end()])) for m in _WORD.finditer(t.text)]

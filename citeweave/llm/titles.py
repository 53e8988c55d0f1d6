"""Parsing of citation titles into their fields (number, date, sender, rest).

Two consumers: exact grouping sets the order of the fields aside and compares them in full
(``canonical``), near-duplicate detection needs the identity of the cited item (``identity``).
Pure Python on one string; callers run it over *distinct* titles in Arrow batches.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")

#: words that belong to the number or the date in front of which they stand
NUMBER_LEAD = ("master", "consolidated", "circular", "circ", "cir", "letter", "pr", "gazette", "of", "india", "notification", "sebi", "vide", "no", "number", "ref", "press", "release")
DATE_LEAD = ("dated", "dt", "issued", "on")

_SEG = r"[^\W_]+"
_SEP = r"(?:\s*[/\\]\s*|\|\s?|[-_.]|-\s(?=[^\W_]+\s?[-/\\]|\d))"
_ID = re.compile(
    rf"(?<![^\W_])(?:{_SEG}{_SEP}{_SEG}(?:(?:{_SEP}|\s[-_]\s(?=[^\W_]+\s*[/\\])){_SEG})+"  # segments parted by slashes and the like
    r"|(?:[^\W\d_]{1,8}\s([-_|])\s)+(?:[^\W_]{1,8}\s?[-_|]\s?)?\d+(?:\s\1\s\d+)?|\d+\s([-_|])\s\d{4}\s\2\s[^\W\d_]{3,6}"  # wide separators
    r"|[^\W\d_]{5,}\d{5,}|\d{5,}[^\W\d_]{3,}"  # run together
    r")(?![^\W_])"
)
_BREAK = re.compile(r"[;,|()\[\]]|\s[-_]+\s")
_DATES = (
    re.compile(r"(?<![^\W_])([^\W\d_]{3,10})[\W_]{0,4}(\d{1,2})[\W_]{1,5}(\d{4})(?!\d)"),
    re.compile(r"(?<![\w/\\|-])(\d{1,2})(?:st|nd|rd|th)?[\W_]{0,4}([^\W\d_]{3,10})[\W_]{0,4}(\d{4})(?!\d)"),
    re.compile(r"(?<![\w/\\|-])(\d{1,2})(\s?[./|:;,\\ _-]\s?)(\d{1,2})\2(\d{4})(?![\w/\\|-])"),
    re.compile(r"(?<![\w/\\|-])(\d{4})(\s?[./|:;,\\ _-]\s?|)(\d{2})\2(\d{2})(?![\w/\\|-])"),
    re.compile(r"(?<![\w/\\|-])(\d{2})()(\d{2})(\d{4})(?![\w/\\|-])"),
)
_SENDER = re.compile(r"(?<![^\W_])e[\W_]?mail\s+from\s+[^\W_]+\s+[^\W_]+")
_DASHES = dict.fromkeys(map(ord, "‐‑‒–—―−"), "-")
_WORD = re.compile(r"[^\W_]+")


def osa(a: str, b: str, limit: int) -> int:
    """Edit distance with transpositions of neighbours; ``limit + 1`` if above ``limit``."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    if a == b:
        return 0
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            row.append(v)
        if min(row) > limit:
            return limit + 1
        before, last = last, row
    return last[-1]


@lru_cache(maxsize=1 << 16)
def month_of(word: str) -> int:
    """1..12 for a month name, its abbreviation or a slip of it, else 0."""
    for i, m in enumerate(MONTHS, 1):
        if word == m or 3 <= len(word) <= 4 and m.startswith(word[:3]) and (len(word) == 3 or word == "sept" or m.startswith(word)):
            return i
    if len(word) < 3:
        return 0
    near = [(n, i) for i, m in enumerate(MONTHS, 1) if (n := osa(word, m, 3)) <= (1 if len(m) < 6 else 3 if len(m) > 6 and word[0] == m[0] else 2)]
    return min(near)[1] if near else 0


@lru_cache(maxsize=1 << 16)
def _leads(word: str, date: bool) -> bool:
    if word == "matter":  # one letter from "master", but a word of its own
        return False
    return any(word == w or len(w) > 4 and osa(word, w, 2) <= 2 for w in (DATE_LEAD if date else NUMBER_LEAD))


def compact(s: str) -> str:
    """Letters and digits only."""
    return "".join(c for c in s if c.isalnum())


def _lead(s: str, start: int, date: bool) -> int:
    """Where the words that lead into s[start:] begin."""
    words = list(_WORD.finditer(s, 0, start))
    while words and _leads(words[-1].group(), date) and not _BREAK.search(s, words[-1].end(), start):
        start = words.pop().start()
    return start


@lru_cache(maxsize=2)
def fields(title: str) -> dict:
    """Remembered for whoever asks next for another view of the same title, so not to be changed. {'number', 'date', 'sender', 'rest': text without case; 'ymd': (y, m, d) or None; 'id': bare number}."""
    s = unicodedata.normalize("NFKC", title).lower().translate(_DASHES)
    s = re.sub(r"\s+", " ", s)
    out = {"number": "", "date": "", "sender": "", "id": "", "ymd": None}
    cut = []
    for k, p in enumerate(_DATES):
        hit = None
        for m in p.finditer(s):
            g = m.groups()
            if k == 0:
                y, mo, d = int(g[2]), month_of(g[0]), int(g[1])
            elif k == 1:
                y, mo, d = int(g[2]), month_of(g[1]), int(g[0])
            elif k in (2, 4):
                y, mo, d = int(g[3]), int(g[2]), int(g[0])
            else:
                y, mo, d = int(g[0]), int(g[2]), int(g[3])
            if 1 <= mo <= 12 and 1 <= d <= 31 and 1800 <= y <= 2199:
                hit = (m, (y, mo, d))
                break
        if hit:
            m, out["ymd"] = hit
            a = _lead(s, m.start(), True)
            out["date"] = s[a : m.end()]
            cut.append((a, m.end()))
            break
    body = s
    for a, b in cut:
        body = body[:a] + "\x00" * (b - a) + body[b:]
    for m in _ID.finditer(body):
        c = compact(m.group())
        if sum(x.isdigit() for x in c) >= 4 and any(x.isalpha() for x in c):
            a = _lead(body, m.start(), False)
            out["number"], out["id"] = body[a : m.end()], c
            body = body[:a] + "\x00" * (m.end() - a) + body[m.end() :]
            break
    m = _SENDER.search(body)
    if m:
        out["sender"] = m.group()
        body = body[: m.start()] + "\x00" * (m.end() - m.start()) + body[m.end() :]
    out["rest"] = body.replace("\x00", " ")
    return out


def canonical(title: str | None) -> str | None:
    """The title without case, whitespace, punctuation and order of its fields; None for null and blank titles.

    A title of punctuation only has the canonical text of its bare characters, so it isn't blank.
    """
    if title is None or not title.strip():
        return None
    f = fields(title)
    parts = [compact(f[k]) for k in ("number", "date", "sender", "rest")]
    return "\x1f".join(parts) if any(parts) else "\x1e" + "".join(title.split())


_DIGITS, _LETTERS = re.compile(r"\d+"), re.compile(r"[^\W\d_]+")


def identity(title: str) -> dict:
    """What tells cited items apart, of one title.

    key: digits of the number, the calendar date and digits of the rest (sections, years), which slips of the pen leave
    alone; codes: the letters of the number; words: letter words of sender and rest, without words that only lead in;
    text: the letters of codes and words, of which near-duplicates share most.
    """
    f = fields(title)
    d = f["ymd"]
    key = "|".join(("".join(_DIGITS.findall(f["id"])), "%04d%02d%02d" % d if d else "", "".join(_DIGITS.findall(f["rest"]))))
    codes = tuple(w for w in _LETTERS.findall(f["id"]) if w not in ("cir", "mc", "no"))
    words = tuple(_LETTERS.findall(f["sender"] + " " + f["rest"]))
    return {"key": key, "codes": codes, "words": words, "text": "".join(codes) + " " + " ".join(words)}


#: a word this long or longer whose tokenizer pieces are this many or more is taken for a proper name (or a slip)
NAME_LETTERS, NAME_PIECES = 7, 3


def _alike(a: str, b: str) -> bool:
    """Two spellings of one word: slips of the pen apart, one abbreviates the other, or one is the other's plural."""
    n = max(len(a), len(b))
    return a == b or osa(a, b, 2) <= (0 if n < 4 else 1 if n < 8 else 2)


def same_item(a: dict, b: dict, pieces) -> bool:
    """Whether two identities with equal keys cite one item. pieces(word) gives the tokenizer's number of pieces."""
    if a["key"] != b["key"]:
        return False
    ca, cb = "".join(a["codes"]), "".join(b["codes"])
    numbered = bool(ca or cb)
    if ca != cb:
        # a code of up to five letters is exact, a longer one may have a slip
        if len(a["codes"]) != len(b["codes"]) or any(x != y and (max(len(x), len(y)) < 6 or not _alike(x, y)) for x, y in zip(a["codes"], b["codes"])):
            return False
    left, right = list(a["words"]), list(b["words"])
    n = max(len(left), len(right))
    for w in a["words"]:
        if w in right:
            right.remove(w)
            left.remove(w)
    named = any(_name(w, pieces) for w in a["words"] if w not in left)
    for w in list(left):
        hit = next((x for x in right if _alike(w, x)), None)
        if hit is not None:
            named = named or _name(w, pieces) and _name(hit, pieces)
            left.remove(w)
            right.remove(hit)
    ours, theirs = [w for w in left if _name(w, pieces)], [w for w in right if _name(w, pieces)]
    if ours and theirs and not any(osa(x, y, 3) <= 3 for x in ours for y in theirs):
        return False
    # number, date and codes tell an item whatever is said about it; without them wording has to agree for the most part
    return numbered or named and min(len(left), len(right)) <= 0.45 * n


def _name(word: str, pieces) -> bool:
    return len(word) >= NAME_LETTERS and pieces(word) >= NAME_PIECES

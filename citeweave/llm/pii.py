"""Personal information in free text: a linear-chain CRF finds it, typed placeholders replace it.

The model is trained on the small labelled table of ``labelled`` on first use in a driver process (seconds), and sent to
the workers as a table of weights. Texts are decoded whole, by Viterbi in numpy batches of texts of like length.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.llm.crf import CRF, outline
from citeweave.llm.labelled import SPOKEN, expand
from citeweave.runtime import spread

KINDS = {"E": "email", "T": "phone", "I": "id_number", "A": "address", "P": "person"}
#: before a word of which the model is to learn the shape only; that many words of the labelled table are so
PLAIN, HIDDEN = "\x03", 0.4
TAGS = ["O", *(f"{b}-{k}" for k in KINDS for b in "BI")]
PLACEHOLDER = "[{kind}]"

_SAID_WORD = "|".join(sorted({w for x in SPOKEN.values() for w in x}))
_DOT = r"(?:\.|\s?\[dot\]\s?|\sdot\s)"
_MAIL = rf"(?P<email>[\w.+-]*\w(?:\s?@\s?|\s?[\[(]at[\])]\s?)[\w-]+(?:{_DOT}[\w-]+)+|\w[\w.+-]*(?:\sdot\s[\w.+-]*\w)*\sat\s[\w-]+(?:\sdot\s[\w-]+)+)|"
_OTHERS = (
    r"(?P<number>[A-Z]{1,2}\s?\d{3}\.\d{3}(?!\d)|[A-Z]\d{6,}|(?:\+\d|\(\d{3,5}\)\s?\d|\d)(?:\d|[./+-](?=\d)| (?=\d))*(?:-[A-Z](?![^\W_])|[a-z](?![^\W_]))?)"
    rf"|(?P<said>(?:(?:{_SAID_WORD})[\s-]){{5,}}(?:{_SAID_WORD})(?![^\W_]))"
    r"|(?P<word>[^\W\d_](?:[^\W\d_]|[\u0300-\u036f])*)|(?P<mark>\S)"
)
TOKEN, NO_MAIL = re.compile(_MAIL + _OTHERS), re.compile(_OTHERS)
#: one of these is in every text that has an address of mail
_MAIL_MARKS = ("@", "[at", "(at", "dot")

#: Forms of address, words of streets and the like, by which tokens are told apart.
TITLES = set("mr mrs ms miss dr mme mlle m frau herr herrn hon".split())
STREET = set("street road lane row close avenue ave terrace gardens rd st drive court way square crescent place rue chemin impasse quai boulevard allée cours route".split())
STREET_END = re.compile(r"(weg|gasse|straße|strasse|str|platz|allee|ufer|ring|damm|steig|markt|tor|graben|wall|brücke|hof)$")
_SAID = {w for x in SPOKEN.values() for w in x}


def tokens(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """(what the model sees of each token, its span): words as they are, of numbers the shape, of addresses of mail that they are one."""
    types, spans = [], []
    for m in (TOKEN if any(x in text for x in _MAIL_MARKS) else NO_MAIL).finditer(text):
        kind, s = m.lastgroup, m.group()
        if kind == "word":
            types.append(s if s.isascii() else unicodedata.normalize("NFC", s))
        elif kind == "mark":
            types.append(s)
        elif kind == "number":
            shape = re.sub(r"\d", "0", s)
            types.append("Z" + shape[1:] if s[0] == "0" and len(s) > 1 else shape)  # a leading zero is seen
        else:
            types.append("\x01" if kind == "email" else "\x02")
        spans.append(m.span())
    return types, spans


class Features:
    """Features of a token type; knows the members' names and their towns."""

    def __init__(self, surnames: set[str], firsts: set[str], towns: set[str], lexicon: set[str] = frozenset()):
        self.surnames, self.firsts, self.towns, self.lexicon = surnames, firsts, towns, set(lexicon)

    def __call__(self, t: str) -> list[str]:
        if t == "\x00":
            return ["edge"]
        if t == "\x01":
            return ["email", "email-too", "email-so", "email-yes"]  # what a token of this form is hardly depends on where it stands
        if t == "\x02":
            return ["number", "digits=10", "number-said"]
        if t[0].isdigit() or re.search(r"\d", t):
            n = sum(c.isdigit() for c in t) + (t[0] == "Z")
            out = ["number", f"digits={min(n, 13)}", "shape=" + t if n > 4 else "short"]
            if t[0] in "+(" or t.startswith("Z0") and n > 11:
                out.append("number+")
            if t[0] == "Z" or t[:2] == "(0":
                out.append("number-zero")
            if re.search(r"[A-Ya-z]", t):
                out.append("number-letter")
            return out
        if not t[0].isalpha() and t[0] != PLAIN:
            return ["mark", "mark=" + ("'" if t in "'’‘" else "-" if t in "-–—" else t)]
        plain, t = t[0] == PLAIN, t.lstrip(PLAIN)
        low = t.lower()
        out = ["word", "shape=" + outline(t)]
        name = t[0].isupper() and not low in TITLES
        if low in TITLES:
            out.append("title")
        if low in STREET:
            out.append("street")
        elif STREET_END.search(low) and len(low) > 5:
            out.append("street-end")
        if low in _SAID:
            out.append("said")
        if name and low in self.towns:
            out.append("town")
        if name and low in self.firsts:
            out.append("first")
        if name and low in self.surnames:
            out.append("surname")
        if low in self.lexicon and not plain:
            out.append("=" + low)
        elif name:
            out.append("unknown-name")
        return out


def _bio(types: list[str], spans: list[tuple[int, int]], marks: list[tuple[int, int, str]]) -> list[int]:
    tags = [0] * len(types)
    for a, b, k in marks:
        inside = [i for i, (x, y) in enumerate(spans) if x < b and y > a]
        for n, i in enumerate(inside):
            tags[i] = TAGS.index(("B-" if n == 0 else "I-") + k)
    return tags


@lru_cache(maxsize=8)
def train(people: tuple[tuple[str, str], ...], towns: tuple[str, ...], copies: int = 8, lines: tuple[str, ...] | None = None) -> CRF:
    """The model; depends on nothing but the labelled table and the given names (first name, surname) and towns."""
    town_words = {w.lower() for t in towns for w in re.findall(r"[^\W\d_]+", t)}
    r, examples, count = random.Random(1), [], {}
    for text, marks in expand(list(towns), copies, lines=list(lines) if lines else None, people=list(people)):
        types, spans = tokens(text)
        tags = _bio(types, spans, marks)
        for t, g in zip(types, tags):
            if t[0].isalpha() and TAGS[g] not in ("B-P", "I-P"):
                low = t.lower()
                count[low] = count.get(low, 0) + 1
        examples.append(([PLAIN + t if t[0].isalpha() and not re.search(r"\d", t) and r.random() < HIDDEN else t for t in types], tags))
    firsts, surnames = {f.lower() for f, _ in people}, {s.lower() for _, s in people}
    lexicon = {w for w, n in count.items() if n > copies // 2 and w not in firsts | surnames | town_words}
    return CRF(TAGS, Features(surnames, firsts, town_words, lexicon)).fit(examples)


def _street(word: str) -> bool:
    low = word.lower()
    return low in STREET or len(low) > 5 and bool(STREET_END.search(low)) or low in ("am", "an", "im", "zum", "zur", "unter", "auf")


def _is_member(name: str, members: set[tuple[str, ...]]) -> bool:
    return tuple(sorted(w.lower() for w in re.findall(r"[^\W\d_]+", name))) in members


_BEFORE_SURNAME = re.compile(r"(?:\b(?:Mr|Mrs|Ms|Miss|Dr|Mme|Mlle|M|Frau|Herrn?|bei|chez)\.?\s+)$")


def places(text: str, tags: np.ndarray, spans: list[tuple[int, int]], members: set[tuple[str, ...]], towns: tuple[str, ...] = (), seats: dict[str, set[str]] = {}) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what the tags mark; names of members are left out."""
    out, i, n = [], 0, len(tags)
    for i in range(n):
        t = TAGS[tags[i]]
        if t == "O":
            continue
        b, k = t.split("-")
        if b == "I" and out and out[-1][3] == i - 1 and out[-1][2] == k:
            out[-1] = (out[-1][0], spans[i][1], k, i)
        else:
            out.append((spans[i][0], spans[i][1], k, i))
    found = []
    for a, b, k, _ in out:
        if k == "P":
            if (m := re.match(r"\.\s[A-Z][\w-]+", text[b:])) and re.search(r"(?:^|\s)[A-Z]$", text[a:b]):
                b += m.end()  # an initial before the surname
            b = a + len(text[a:b].rstrip(" .,;:"))
            alone = not re.search(r"[\s,]", text[a:b])
            if alone and not _BEFORE_SURNAME.search(text[max(0, a - 12) : a]):
                continue  # a surname by itself is how the record names members
            if alone and (m := re.match(r"\s+([^\W\d_][\w'’-]+)", text[b:])) and _is_member(text[a:b] + " " + m.group(1), members):
                continue
            if alone and any(seat in text[max(0, a - 60) : a] for seat in seats.get(text[a:b].lower(), ())):
                continue  # and a surname next to its member's constituency
        if k == "A":
            for t in towns:
                if (n := next((n for n in range(len(t.split()) - 1, 0, -1) if text[a:b].split()[-n:] == t.split()[:n]), 0)) and (m := re.match(r"\s+" + r"\s+".join(map(re.escape, t.split()[n:])) + r"(?![^\W_])", text[b:])):
                    b += m.end()
        s = text[a:b]
        if k == "E" and not re.search(r"@|\bat\b", s, re.I):
            continue
        if k == "P" and (_is_member(s, members) or not s[0].isupper() or re.search(r"[^\W_]{2}[.!?:;]\s|[\d()\[\]:;!?]", s)):
            continue
        if k == "A" and (m := re.search(r"[\s,]+(?:bei|chez|c/o|and|und|et|,)$", s)):
            s, b = s[: m.start()], a + m.start()
        digits = sum(c.isdigit() for c in s)
        if k == "A" and not (digits and any(_street(w) for w in re.findall(r"[^\W\d_]+", s))) or k == "I" and digits < 5 or k == "T" and digits < 7 and len(s.split()) < 6:
            continue
        found.append((a, b, KINDS[k]))
    return found


class Finder:
    """The model with the members' names, as sent to the workers."""

    def __init__(self, model: CRF, members: set[tuple[str, ...]], towns: tuple[str, ...] = (), seats: dict[str, set[str]] = {}):
        self.seats = seats  # surname -> constituencies of the members who have it
        self.model, self.members, self.towns = model, members, tuple(t for t in towns if len(t.split()) > 1)

    def __call__(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        cut = [tokens(t) for t in texts]
        tags = self.model.decode([c[0] for c in cut])
        return [places(t, g, c[1], self.members, self.towns, self.seats) for t, g, c in zip(texts, tags, cut)]


def finder(members: DataFrame) -> Finder:
    """Trains the model; ``members`` (full_name, constituency) is the fixed list of who is no private person."""
    rows = members.select("full_name", "constituency").collect()  # a reference list of some hundred rows
    names = [re.findall(r"[^\W\d_]+", r["full_name"]) for r in rows if r["full_name"]]
    towns = tuple(sorted({r["constituency"] for r in rows if r["constituency"]}))
    model = train(tuple(sorted({(n[0], n[-1]) for n in names if n})), towns)
    seats: dict[str, set[str]] = {}
    for row in rows:
        if row["full_name"] and row["constituency"]:
            seats.setdefault(re.findall(r"[^\W\d_]+", row["full_name"])[-1].lower(), set()).add(row["constituency"])
    return Finder(model, {tuple(sorted(w.lower() for w in n)) for n in names}, towns, seats)


SLICE = 1024  # texts decoded together


def find(docs: DataFrame, members: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start_pos, end_pos, kind) of each place, in code points. Null, empty and blank texts have none.

    Rows repeated with the same id and text give each place once. One pass over the texts, without a shuffle but for such repeats.
    """
    look = finder(members)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for k in range(0, len(df), SLICE):
                part = df.iloc[k : k + SLICE]
                hits = look(list(part[text_col]))
                rows = [(i, a, b, kind) for i, h in zip(part[id_col], hits) for a, b, kind in h]
                yield pd.DataFrame(rows, columns=[id_col, "start_pos", "end_pos", "kind"])

    kind = docs.schema[id_col].dataType.simpleString()
    return spread(docs.select(id_col, text_col).where(F.col(text_col).isNotNull()), id_col).mapInPandas(run, f"`{id_col}` {kind}, start_pos int, end_pos int, kind string").distinct()


def redact(docs: DataFrame, members: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, places): the text with each place replaced by its typed placeholder, the rest unchanged. Null stays null."""
    look = finder(members)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for k in range(0, len(df), SLICE):
                part = df.iloc[k : k + SLICE]
                texts = [t if isinstance(t, str) else "" for t in part[text_col]]
                out = []
                for t, h in zip(texts, look(texts)):
                    pieces, at = [], 0
                    for a, b, kind in h:
                        pieces += [t[at:a], PLACEHOLDER.format(kind=kind.upper())]
                        at = b
                    out.append(("".join([*pieces, t[at:]]), len(h)))
                new = [o[0] if isinstance(t, str) else None for t, o in zip(part[text_col], out)]
                yield pd.DataFrame({id_col: part[id_col], "text": new, "places": [o[1] for o in out]})

    kind = docs.schema[id_col].dataType.simpleString()
    return spread(docs.select(id_col, text_col), id_col).mapInPandas(run, f"`{id_col}` {kind}, text string, places int")

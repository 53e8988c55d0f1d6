"""Repair of text from scanned pages: broken words, misrecognised words, running headers and page numbers, reflow.

Lines are classified and words counted in one pass. For each distinct word, once and not at each place it stands, all
vocabulary words that it may be a misreading of are retrieved by walking a trie of the vocabulary together with a Levenshtein
automaton whose edits are the confusions of scanners (with merges and splits, as rn for m). The vocabulary is cut into
tries by prefix; a word visits those whose prefix the automaton can reach, so retrieval is complete whatever their number.
Candidates are joined back to the pages, ranked by how often they stand beside the same neighbours, then by frequency.
Running headers are lines that recur at the edges of a document's pages. Then furniture is taken out and lines are reflowed.
All criteria are ratios of counts, so the size of the corpus doesn't change them.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from citeweave.llm.titles import osa
from citeweave.runtime import Workspace, salted_lookup, tasks

WORD = re.compile(r"(?<![^\W_])(?=\d*[^\W\d_])[^\W_](?:[^\W_]|[̀-ͯ]|(?<=[^\W_])['’](?=[^\W_]))*[^\W_]|[^\W_]")
HYPHENS = "-\xad¬‐‑"
#: Forms of a page number that stands alone.
_NUM, _ROMAN = r"[0-9OolI|SB]{1,4}", r"[ivxlcdmIVXLCDM1]{1,7}"
PAGE_NUMBER = re.compile(
    rf"^\W*(?:{_NUM}|{_ROMAN})\W*$|^\W*(?:[Pp]\s?[a4]\s?[gq9]\s?[ec]|[Pp]g?\.?)\s*:?\s*(?:{_NUM}|{_ROMAN})\W*$"
    rf"|^\W*(?:[Pp]\s?.\s?[gq9]\s?[eco]\s*:?\s*)?{_NUM}\s*(?:/|of|0f|oi)\s*{_NUM}\W*$"
)
TABLE_NUMBER = re.compile(r"^\W*\d{1,3}(?:,\d{3})+\W*$|^\d{1,4}\.$|^\d{4}$")
#: a word is held against vocabulary words this many times as frequent (three times that if it has up to three letters)
RATIO = 4
#: scanner confusions that one word may hold
SLIPS = 3
#: a form is a document's running header if it stands at the edges of this share of its pages, two at least
HEADER_SHARE = 0.25
#: or of one, if it is the running header of two other documents and of this share of those at whose edges it is seen
KNOWN_SHARE = 0.5
#: a form seen in four documents or more and the header of fewer than this share of them is a heading of sections
SECTION_SHARE = 0.25
#: share of words with accents above which the corpus is taken to be in a language that has them
ACCENTED = 0.02
#: What scanners read for what is printed; several characters first. Accents over vowels are another such slip.
CONFUSED = (("rn", "m"), ("ri", "n"), ("ii", "u"), ("cl", "d"), ("li", "h"), ("h", "li"), ("d", "cl"), ("m", "rn"), ("n", "ri"), ("vv", "w"), ("0", "o"), ("1", "l"), ("1", "i"), ("l", "i"), ("i", "l"), ("5", "s"), ("8", "b"), ("6", "g"), ("c", "e"), ("f", "t"), ("b", "h"), ("v", "y"), ("q", "g"), ("9", "g"))
_FOLD = (("0", "o"), ("1", "l"), ("5", "s"), ("8", "b"), ("6", "g"), ("9", "g"), ("rn", "m"), ("ri", "n"), ("ii", "u"), ("cl", "d"), ("li", "h"), ("vv", "w"), ("i", "l"), ("c", "e"), ("f", "t"), ("b", "h"), ("v", "y"), ("q", "g"))


def bare(word: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(c))


@lru_cache(maxsize=1 << 16)
def folded(word: str) -> str:
    """The word with what scanners confuse made equal."""
    w = bare(word)
    for a, b in _FOLD:
        w = w.replace(a, b)
    return w


_FROM: dict[str, list[tuple[str, str]]] = {}
for _x, _y in CONFUSED:
    _FROM.setdefault(_x[0], []).append((_x, _y))


class Automaton:
    """Levenshtein automaton of a word as read. Its edits are accents and ``CONFUSED``, substitutions, merges and splits alike.

    A state maps (position in the word, what a split has still to read) to the least number of edits so far.
    """

    def __init__(self, read: str):
        self.word = bare(read)
        accents = sum(x != y for x, y in zip(read, self.word)) if len(read) == len(self.word) else SLIPS + 1
        self.start = {(0, ""): accents} if accents <= SLIPS else {}
        w = self.word
        self.steps = [[(c, "", j + 1, 0), *((y[0], y[1:], j + len(x), 1) for x, y in _FROM.get(c, ()) if w.startswith(x, j))] for j, c in enumerate(w)]

    def after(self, state: dict, within=None) -> dict[str, dict]:
        """The states that each letter leads to; only of letters in ``within``, if given."""
        out: dict[str, dict] = {}
        n, steps = len(self.word), self.steps
        for (j, rest), e in state.items():
            for c, more, k, cost in [(rest[0], rest[1:], j, 0)] if rest else steps[j] if j < n else ():
                if e + cost <= SLIPS and (within is None or c in within):
                    to = out.get(c)
                    if to is None:
                        out[c] = {(k, more): e + cost}
                    elif to.get((k, more), 9) > e + cost:
                        to[k, more] = e + cost
        return out

    def edits(self, state: dict) -> int | None:
        """Edits with which the word has been read to its end, None if it hasn't."""
        return state.get((len(self.word), ""))

    def prefixes(self, k: int) -> list[str]:
        """The first ``k`` letters of all words that it accepts (whole words if they are shorter)."""
        out, stack = set(), [("", self.start)]
        while stack:
            prefix, state = stack.pop()
            if state and (len(prefix) == k or self.edits(state) is not None):
                out.add(prefix)
            if len(prefix) < k:
                stack += [(prefix + c, s) for c, s in self.after(state).items()]
        return sorted(out)


class Trie:
    """Vocabulary with counts."""

    def __init__(self, words: dict[str, int]):
        self.words = words
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w

    def near(self, read: str) -> list[tuple[str, int]]:
        """(word, edits) of all words that the automaton of ``read`` accepts."""
        auto = Automaton(read)
        out, stack = [], [(self.root, auto.start)]
        while stack:
            node, state = stack.pop()
            if "" in node and (e := auto.edits(state)) is not None:
                out.append((node[""], e))
            stack += [(node[c], s) for c, s in auto.after(state, node).items()]
        return out


def outvotes(word: str, own: int, n: int) -> bool:
    """Whether a word seen n times is so much more frequent than ``word``, read ``own`` times."""
    return n >= max(1, (RATIO if len(word) > 3 else 3 * RATIO) * own)


class Reader:
    """What a page needs to know of the corpus: candidates of its words, counts of broken words and compounds, neighbours."""

    def __init__(self, notes=(), pairs=(), accents: bool = False):
        self.cand: dict[str, list[tuple[str, int, int]]] = {}
        self.words: dict[str, int] = {}
        self.compounds: dict[str, int] = {}
        for kind, item, n, cand in notes:
            if kind == "w":
                self.cand[item] = cand
            else:
                (self.words if kind == "n" else self.compounds)[item] = n
        self.pairs = dict(pairs)
        self.accents = accents
        self.missed: set[str] = set()

    def pair(self, a: str, b: str) -> int:
        if not a or not b:
            return 0
        item = f"{a} {b}"
        self.missed.add(item)
        return self.pairs.get(item, 0)

    def known(self, word: str) -> bool:
        word = word.lower()
        return self.words.get(word, 0) > 0 and word not in self.cand

    def correct(self, word: str, left: str = "", right: str = "") -> tuple[str, int] | None:
        """(the word that is meant, its count), or None if ``word`` stands as it is."""
        cand = self.cand.get(word.lower())
        if not cand:
            return None
        if len(cand) == 1:
            return cand[0][:2]
        beside = {v: self.pair(left, v) + self.pair(v, right) for v, _, _ in cand}
        return max(cand, key=lambda c: (beside[c[0]] > 0, -c[2], beside[c[0]], c[1], c[0]))[:2]


_ALONE = re.compile(r"(?<![^\W_])\d[\d.,]*(?![^\W_])|^\W*[ivxlcdm]+\b\W*|\W+[ivxlcdm]+\W*$")


def heading(line: str) -> str | None:
    """The letters of a line that may be a heading, numbers and what scanners confuse set aside; None for running text."""
    if len(line) > 160:
        return None
    words = re.findall(r"[^\W\d_]+", line)
    if 2 * sum(w[0].islower() for w in words) > len(words):
        return None
    letters = re.sub(r"[^a-z]", "", folded(_ALONE.sub(" ", line)))
    return letters if len(letters) >= 8 else None


def distance(a: str, b: str) -> int:
    """Edit distance, a column of the table at a time as bits."""
    if not a:
        return len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    top, up, down, d = 1 << (len(a) - 1), full, 0, len(a)
    for c in b:
        eq = at.get(c, 0)
        x = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | ~(x | up), up & x
        d += bool(plus & top) - bool(minus & top)
        plus, minus = plus << 1 | 1, minus << 1
        up, down = (minus | ~(x | plus)) & full, plus & x & full
    return d


def header(line: str, forms: tuple[str, ...]) -> bool:
    """Whether the line is one of the document's running headers (``heading`` of them), slips and a page number aside."""
    letters = heading(line) if forms else None
    if letters is None:
        return False
    if letters in forms:
        return True
    for f in forms:
        if abs(len(f) - len(letters)) <= 6 and (f in letters or distance(f, letters) <= max(2, len(f) // 6)):
            return True
    return False


def page_number(line: str) -> bool:
    s = line.strip()
    return bool(s) and len(s) < 40 and not TABLE_NUMBER.match(s) and bool(PAGE_NUMBER.match(s)) and bool(re.search(r"[^\W_]|\|", s))


def kinds_of(lines: list[str], forms: tuple[str, ...]) -> str:
    """A letter a line: h header, n page number, _ blank, b body."""
    return "".join("_" if not x.strip() else "h" if header(x, forms) else "n" if page_number(x) else "b" for x in lines)


_LAST = re.compile(rf"([^\W\d_][^\W_]*(?:[-/][^\W_]+)*)\s?([{HYPHENS}])\s*$")
_FIRST = re.compile(r"^\s*([^\W_]+(?:-[^\W_]+)*)")
_ENDS = tuple(HYPHENS)
#: a line without these and without a word that has candidates needs no look at its words
_ODD = re.compile(r"[^\W\d_][0158]|\d[OlI]|[OlI]\d|(?=[^\x00-\x7f])[^\W_]")


def breaks(lines: list[str], body: list[int]) -> dict[int, tuple[re.Match, int, str]]:
    """Body lines that end in a hyphen: line -> (the last word's match, next body line, that line's first word)."""
    out = {}
    for i, j in zip(body, body[1:]):
        if lines[i].rstrip().endswith(_ENDS) and (m := _LAST.search(lines[i])) and (f := _FIRST.search(lines[j])):
            out[i] = (m, j, f.group(1))
    return out


def _halves(m: re.Match, b: str) -> tuple[str, str, str]:
    """(first half, the word put together, the compound) of a broken word."""
    head = re.split(r"[-/]", m.group(1))[-1]
    return head, (head + b).lower(), (head + "-" + b).lower()


def read_page(lines: list[str], kinds: str, reader: Reader) -> tuple[list[tuple[int, str]], str]:
    """(cases (line_no, kind), repaired text) of a page."""
    cases = [(i, "header" if k == "h" else "page_number") for i, k in enumerate(kinds, 1) if k in "hn"]
    body = [i for i, k in enumerate(kinds) if k == "b"]
    clean = {i: lines[i].rstrip() for i in body}
    glue: dict[int, str] = {}
    owner: dict[int, tuple[int, str, int, str]] = {}  # line -> (where the broken word's first half begins, first half, next line, second half)
    for i, (m, j, b) in breaks(lines, body).items():
        head, joined, compound = _halves(m, b)
        j1 = joined.split("-")[0]
        nj = reader.words.get(j1, 0)
        if not nj and (v := reader.correct(j1)):
            nj = v[1] / 2
        nc = reader.compounds.get(compound, 0) or reader.compounds.get("-".join(compound.split("-")[:2]), 0)
        hard = m.group(2) == "-"
        if hard and nc > nj or hard and nj == 0 and nc == 0 and len(head) > 2 and reader.known(head) and reader.known(b.split("-")[0]):
            glue[i] = "-"
        elif b[0].islower() or nj:
            cases.append((i + 1, "hyphen"))
            glue[i] = ""
            owner[i] = (m.start(1) + len(m.group(1)) - len(head), head, j, b.split("-")[0])
        else:
            glue[i] = "-"
    starts = {j: len(b) for _, _, j, b in owner.values()}  # second halves, judged with their first
    flagged = list(reader.cand)
    fixed: dict[int, str] = {}
    wrong: set[int] = set()
    carry: dict[int, str] = {}
    for i in body:
        line = fixed[i] = clean[i]
        if i not in owner and i not in carry:
            low = line.lower()
            if not any(w in low for w in flagged) and not _ODD.search(line):
                continue
        words = list(WORD.finditer(line))
        new, end = [], 0
        lead = len(line) - len(line.lstrip())
        for n, m in enumerate(words):
            w = m.group()
            left = words[n - 1].group().lower() if n else ""
            right = words[n + 1].group().lower() if n + 1 < len(words) else ""
            if i in starts and m.start() == lead:
                if (fix := carry.get(i)) is not None:
                    new += [line[end : m.start()], fix, line[m.start() + starts[i] : m.end()]]
                    end = m.end()
                continue
            if i in owner and m.start() <= owner[i][0] < m.end():
                _, head, j, b = owner[i]
                v = misread(head + b, left, "", reader)
                if v is not None:
                    cut = _split(head, b, v)
                    if v[:cut].lower() != head.lower():
                        wrong.add(i)
                        new += [line[end : m.end() - len(head)], _like(v[:cut], head)]
                        end = m.end()
                    if v[cut:].lower() != b.lower():
                        wrong.add(j)
                        carry[j] = _like(v[cut:], b)
                continue
            fix = misread(w, left, right, reader)
            if fix is not None:
                wrong.add(i)
                new += [line[end : m.start()], _like(fix, w)]
                end = m.end()
        fixed[i] = "".join(new) + line[end:]
    cases += [(i + 1, "misread") for i in wrong]
    return sorted(set(cases)), reflow(lines, kinds, fixed, glue)


_ROMAN_WORD, _AS_NUMBER, _DIGIT_INSIDE = re.compile(r"[ivxlcdmIVXLCDM]+"), re.compile(r"\d+[OlI]+\d*|[OlI]\d{2,}"), re.compile(r"[^\W\d_][0158]+[^\W\d_]")


def _accented(word: str) -> bool:
    """Whether letters of the word have accents; a ligature is none."""
    b = bare(word)
    return len(b) == len(word) and b != word.lower()


def misread(word: str, left: str, right: str, reader: Reader) -> str | None:
    if len(word) < 2 or word.isdigit() or _ROMAN_WORD.fullmatch(word) or word.isupper() and len(word) < 6 and any(c.isdigit() for c in word):
        return None
    if _AS_NUMBER.fullmatch(word):
        return word.translate(str.maketrans("OlI", "011"))
    fix = reader.correct(word, left, right)
    if fix is not None:
        return fix[0]
    if len(word) > 4 and not word.isupper() and (not reader.accents and _accented(word) or _DIGIT_INSIDE.search(word)):
        # a name that no other page tells: marks that no word has
        return bare(word).translate(str.maketrans("0158", "olsb"))
    return None


def _split(head: str, b: str, v: str) -> int:
    """Where the corrected word parts into the two halves it was broken into."""
    if v.startswith(head.lower()):
        return len(head)
    if v.endswith(b.lower()):
        return len(v) - len(b)
    return min(range(1, len(v)), key=lambda k: (osa(v[:k], head.lower(), 9) + osa(v[k:], b.lower(), 9), k), default=len(head))


def _like(new: str, old: str) -> str:
    if len(old) > 1 and old.isupper():
        return new.upper()
    return new[:1].upper() + new[1:] if old[:1].isupper() else new


_START = re.compile(r"^\s*(?:\(?[a-z]\)|\(?\d{1,3}[.)]|\d{1,3}\s{2,}|CHAPTER|Chapter|Annexure|Schedule|[A-Z][a-z]+ \d+:)\s?")


def reflow(lines: list[str], kinds: str, fixed: dict[int, str], glue: dict[int, str]) -> str:
    """Body lines as paragraphs parted by an empty line; furniture inside a paragraph doesn't part it."""
    out: list[str] = []
    last = gap = None
    for i, kind in enumerate(kinds):
        if kind == "_":
            gap = gap if gap == "furniture" else "blank"
        elif kind in "hn":
            gap = "furniture"
        else:
            line = fixed[i].strip()
            if last is not None and last in glue and out:
                out[-1] = re.sub(rf"\s?[{HYPHENS}]\s*$", glue[last], out[-1]) + line
            elif not out or (gap == "blank" or gap == "furniture" and out[-1][-1:] in ".:") or _START.match(line) or out[-1][-1:] in ".:" and gap:
                out.append(line)
            else:
                out[-1] += " " + line
            last, gap = i, None
    return "\n\n".join(out)


SCANNED = "kind string, item string, n bigint, row bigint, page_id {id}, kinds string, words array<string>, broken array<string>, compounds array<string>"


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pages with their lines' kinds and what they ask for (kind t, the text as item), and counts of words, compounds and neighbours of the body (w, c, p).

    Words at a line's broken end or after it aren't counted.
    """
    for df in batches:
        words, compounds, pairs = Counter(), Counter(), Counter()
        pages = []
        for row, page_id, text, forms in zip(df["row"], df["page_id"], df["text"], df["forms"]):
            lines = text.split("\n")
            kinds = kinds_of(lines, tuple(forms))
            body = [i for i, k in enumerate(kinds) if k == "b"]
            mine: set[str] = set()
            broken, joined = set(), set()
            stopped = False
            for i in body:
                line = lines[i].lower()
                use = WORD.findall(line)
                mine.update(use)
                stop = line.rstrip().endswith(_ENDS) and bool(_LAST.search(lines[i]))
                if stopped or stop:
                    use = use[1 if stopped else 0 : len(use) - 1 if stop else len(use)]
                stopped = stop
                words.update(use)
                pairs.update(zip(use, use[1:]))
                if "-" in line:
                    for a, b in zip(use, use[1:]):
                        if f"{a}-{b}" in line:
                            compounds[a, b] += 1
            for m, _, b in breaks(lines, body).values():
                head, whole, compound = _halves(m, b)
                b0 = b.split("-")[0].lower()
                broken |= {whole.split("-")[0], head.lower(), b0}
                mine |= {whole.split("-")[0], (head + b0).lower(), head.lower(), b0}
                joined |= {compound, "-".join(compound.split("-")[:2])}
            pages.append(("t", text, 0, row, page_id, kinds, list(mine), list(broken), list(joined)))
        counts = [("w", w, n) for w, n in words.items()] + [("c", f"{a}-{b}", n) for (a, b), n in compounds.items()] + [("p", f"{a} {b}", n) for (a, b), n in pairs.items()]
        names = ["kind", "item", "n", "row", "page_id", "kinds", "words", "broken", "compounds"]
        yield pd.DataFrame(pages, columns=names)
        yield pd.DataFrame(counts, columns=names[:3]).assign(**{c: None for c in names[3:]}).astype({"row": "Int64"})


@F.pandas_udf(StringType())
def _heading(lines: pd.Series) -> pd.Series:
    return lines.map(heading, na_action="ignore")


def forms_of(ws: Workspace, pages: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc, forms, _n): of each document of ``pages`` (doc, page, text) its title and running headers, and its number of pages.

    A header recurs at the edges (two lines of each) of the document's pages (one scanned again counts once), or of other documents' pages for the most part.
    """
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"\S"))
    edges = pages.select("doc", "page", F.explode(F.array_distinct(F.concat(F.slice(lines, 1, 2), F.when(F.size(lines) > 2, F.slice(F.reverse(lines), 1, 2)).otherwise(F.array().cast("array<string>"))))).alias("line"))
    seen = edges.select("doc", "page", _heading("line").alias("form")).where("form IS NOT NULL").distinct().groupBy("doc", "form").agg(F.count("*").alias("n"))
    seen = ws.write(seen)
    sizes = ws.write(pages.groupBy("doc").agg(F.countDistinct("page").alias("pages"), F.count("*").alias("_n")))
    own = (F.col("n") >= 2) & (F.col("n") >= HEADER_SHARE * F.col("pages"))
    seen = seen.join(sizes, "doc").select("doc", "form", own.alias("own"), (F.col("n") >= 0.1 * F.col("pages")).alias("often"))
    common = seen.groupBy("form").agg(F.count("*").alias("docs"), F.count_if("own").alias("of"))
    share = F.col("of") / F.col("docs")
    heads = seen.join(common, "form").where(F.col("own") & ((F.col("docs") < 4) | (share >= SECTION_SHARE)) | F.col("often") & (F.col("of") >= 2) & (share >= KNOWN_SHARE))
    title = docs.groupBy(F.col("doc_id").alias("doc")).agg(F.max("doc_title").alias("t")).select("doc", _heading("t").alias("form")).where("form IS NOT NULL")
    forms = heads.select("doc", "form").unionByName(title).groupBy("doc").agg(F.collect_set("form").alias("forms"))
    return sizes.join(forms, "doc", "left").select("doc", F.coalesce("forms", F.array().cast("array<string>")).alias("forms"), "_n")


@F.pandas_udf(ArrayType(StringType()))
def _prefixes(words: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series([Automaton(w).prefixes(n) for w, n in zip(words, k)], dtype=object)


def _match(asked: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
    """(item, v, m, edits) of the asked words and the words of one trie."""
    out: list[tuple] = []
    if len(asked) and len(shard):
        trie = Trie(dict(zip(shard["v"], shard["m"])))
        for w, n in zip(asked["item"], asked["n"]):
            out += [(w, v, trie.words[v], e) for v, e in trie.near(w) if v != w and outvotes(w, n, trie.words[v])]
    return pd.DataFrame(out, columns=["item", "v", "m", "e"])


def candidates(ws: Workspace, words: DataFrame, asked: DataFrame, block: int = 50_000) -> DataFrame:
    """(item, cand array of (v, m, e)) of the words in ``words`` (item, n) and ``asked`` (item, never seen) that may be misreadings.

    The vocabulary is cut into tries by so many first letters that none holds above ``block`` words (up to eight letters).
    """
    k = 1
    while k < 8 and (words.groupBy(F.substring("item", 1, k)).count().agg(F.max("count")).first()[0] or 0) > block:
        k += 1
    every = words.unionByName(asked.join(words, "item", "left_anti").distinct().withColumn("n", F.lit(0).cast("bigint")))
    every = ws.write(every.where(F.length("item") > 1).repartition(tasks(ws.spark), "item"), n="count(1)")
    chunks = -(-(every.metrics["n"] or 0) // (16 * block)) or 1
    left = every.withColumn("prefix", F.explode(_prefixes("item", F.lit(k)))).withColumn("chunk", F.pmod(F.xxhash64("item"), F.lit(chunks)).cast("int"))
    right = words.select(F.col("item").alias("v"), F.col("n").alias("m"), F.substring("item", 1, k).alias("prefix"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    hits = left.groupBy("prefix", "chunk").cogroup(right.groupBy("prefix", "chunk")).applyInPandas(_match, "item string, v string, m bigint, e int")
    return ws.write(hits.groupBy("item").agg(F.array_sort(F.collect_set(F.struct("v", "m", "e"))).alias("cand")))


def _looked_up(asked: DataFrame, table: DataFrame, key: str, *cols: str) -> DataFrame:
    """(row, notes): the table's rows of the keys that each page asks for."""
    hits = salted_lookup(asked, table, key, asked.groupBy(key).agg(F.count("*").alias("_n")), "_n")
    return hits.groupBy("row").agg(F.collect_list(F.struct(*cols)).alias("notes"))


def _reader(notes, pairs, accents: bool) -> Reader:
    def rows():
        for r in notes if notes is not None else ():
            yield r["key"][0], r["key"][1:], r["n"], None if r["cand"] is None else [(c["v"], c["m"], c["e"]) for c in r["cand"]]

    return Reader(rows(), () if pairs is None else [(r["item"], r["n"]) for r in pairs], accents)


def _missed(accents: bool):
    """(row, item): neighbours that decide between the candidates of a page's words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for row, text, kinds, notes in zip(df["row"], df["text"], df["kinds"], df["notes"]):
                reader = _reader(notes, None, accents)
                read_page(text.split("\n"), kinds, reader)
                out += [(row, x) for x in reader.missed]
            yield pd.DataFrame(out, columns=["row", "item"])

    return run


def _run(accents: bool, want_text: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            ids, out = [], []
            for i, text, kinds, notes, pairs in zip(df["page_id"], df["text"], df["kinds"], df["notes"], df["pairs"]):
                cases, repaired = read_page(text.split("\n"), kinds, _reader(notes, pairs, accents))
                ids += [i] if want_text else [i] * len(cases)
                out += [(repaired,)] if want_text else cases
            yield pd.DataFrame(out, columns=["text"] if want_text else ["line_no", "kind"]).assign(page_id=ids)[["page_id", "text"] if want_text else ["page_id", "line_no", "kind"]]

    return run


def _read(spark: SparkSession, pages: DataFrame, docs: DataFrame, want_text: bool, shape: str, block: int = 50_000) -> DataFrame:
    """Every page read with what the whole corpus tells of its words."""
    ws = Workspace(spark, "pages")
    kind = pages.schema["page_id"].dataType.simpleString()
    doc = F.coalesce("doc_id", F.concat(F.lit("\x00"), F.col("page_id").cast("string"))).alias("doc")
    t = pages.where(F.col("text").isNotNull()).select(doc, "page_id", F.coalesce(F.col("page_num").cast("bigint"), -F.col("page_id") - 1).alias("page"), "text")
    forms = ws.write(forms_of(ws, t, docs))
    t = salted_lookup(t, forms.select("doc", "forms"), "doc", forms.select("doc", "_n"), "_n").repartition(tasks(spark), "page_id").withColumn("row", F.monotonically_increasing_id())
    scanned = ws.write(t.select("row", "page_id", "text", "forms").mapInPandas(_scan, SCANNED.format(id=kind)))
    counts = ws.write(
        scanned.where("kind <> 't'").groupBy("kind", "item").agg(F.sum("n").alias("n")),
        total="sum(CASE WHEN kind = 'w' THEN n END)", odd="sum(CASE WHEN kind = 'w' AND item RLIKE '[^\\\\x00-\\\\x7f]' THEN n END)",
    )
    total = counts.metrics["total"] or 0
    accents = (counts.metrics["odd"] or 0) > ACCENTED * total
    page = scanned.where("kind = 't'")
    words = counts.where("kind = 'w'").select("item", "n")
    cand = candidates(ws, words, page.select(F.explode("broken").alias("item")).unionByName(page.select(F.explode("words").alias("item"))).distinct(), block)
    # frequent words without candidates, ten thousand at most, need no lookup
    plain = F.broadcast(words.where(F.col("n") > 1e-4 * total).select("item").join(cand.select("item"), "item", "left_anti"))
    asked = page.select("row", F.explode("words").alias("item")).join(plain, "item", "left_anti").select("row", F.concat(F.lit("w"), "item").alias("key"))
    asked = asked.unionByName(page.select("row", F.explode("broken").alias("item")).select("row", F.concat(F.lit("n"), "item").alias("key")))
    asked = asked.unionByName(page.select("row", F.explode("compounds").alias("item")).select("row", F.concat(F.lit("c"), "item").alias("key")))
    none = F.lit(None).cast("array<struct<v:string,m:bigint,e:int>>")
    table = cand.select(F.concat(F.lit("w"), "item").alias("key"), F.lit(0).cast("bigint").alias("n"), "cand")
    table = table.unionByName(words.select(F.concat(F.lit("n"), "item").alias("key"), "n", none.alias("cand"))).unionByName(counts.where("kind = 'c'").select(F.concat("kind", "item").alias("key"), "n", none.alias("cand")))
    notes = _looked_up(asked, table, "key", "key", "n", "cand")
    ready = ws.write(page.select("row", "page_id", F.col("item").alias("text"), "kinds").join(notes, "row", "left").withColumn("open", F.coalesce(F.exists("notes", lambda x: F.size(x["cand"]) > 1), F.lit(False))))
    split = ready.where("open")
    missed = ws.write(split.select("row", "text", "kinds", "notes").repartition(tasks(spark), "row").mapInPandas(_missed(accents), "row bigint, item string"))
    pairs = _looked_up(missed, counts.where("kind = 'p'").select("item", "n"), "item", "item", "n").withColumnRenamed("notes", "pairs")
    whole = ready.join(pairs, "row", "left").select("page_id", "text", "kinds", "notes", "pairs").repartition(tasks(spark))
    return whole.mapInPandas(_run(accents, want_text), shape.format(id=kind))


def damage(spark: SparkSession, pages: DataFrame, docs: DataFrame, block: int = 50_000) -> DataFrame:
    """(page_id, line_no, kind): what is wrong with which line. Null and empty texts have no cases; repeated rows come out once.

    ``block`` bounds the words of a trie and doesn't change the result.
    """
    return _read(spark, pages, docs, False, "page_id {id}, line_no int, kind string", block).distinct()


def repaired(spark: SparkSession, pages: DataFrame, docs: DataFrame, block: int = 50_000) -> DataFrame:
    """(page_id, text): each page as continuous paragraphs, parted by empty lines. An empty text stays empty, a null one null."""
    null = pages.where(F.col("text").isNull()).select("page_id", F.lit(None).cast("string").alias("text"))
    return _read(spark, pages, docs, True, "page_id {id}, text string", block).unionByName(null)

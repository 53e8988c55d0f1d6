"""The ordered pattern table for citations, in the JVM's dialect and in RE2's.

Order is part of the result: an earlier pattern's match names a title's spelling and type. Java patterns run under (?idU):
case-insensitive, Unicode classes, and only a line feed ends a line.
"""

from __future__ import annotations

from dataclasses import dataclass

FLAGS = "(?idU)"


@dataclass(frozen=True)
class Pattern:
    pattern_id: int
    regex: str
    ref_type: str
    re2: str | None = None  # where RE2 can't take the regex as it stands: group 1 is the match
    needs: tuple[tuple[str, ...], ...] = ()  # a text without a match is told by it at once: every match holds one of each, case aside

    @property
    def java(self) -> str:
        return FLAGS + self.regex


# The published patterns, plainly and in order.
PATTERNS = (
    Pattern(1, r"SEBI/HO/[A-Z0-9/\-]+(?:/P)?/CIR/\d{4}/\d+", "circular", needs=(("sebi/ho/",), ("/cir/",))),
    Pattern(2, r"CIR/[A-Z]+/\d+/\d{4}", "circular", needs=(("cir/",),)),
    Pattern(3, r"(?:IMD|MRD|MIRSD|OIAE|CFD|CDMRD)[/-][A-Z/]+/\d+/\d{4}", "circular", needs=(tuple(f"{x}{y}" for x in ("imd", "mrd", "mirsd", "oiae", "cfd") for y in "/-"),)),
    Pattern(4, r"Master\s+Circular\s+(?:No\.?\s*)?[A-Z0-9/\-]+(?:\s+dated\s+[\w\s,]+\d{4})?", "circular", needs=(("master",), ("circular",))),
    Pattern(5, r"SEBI\s*\([\w\s,&\-]+\)\s*Regulations?,?\s*\d{4}", "regulation", needs=(("regulation",), ("sebi",))),
    Pattern(6, r"Securities\s+and\s+Exchange\s+Board\s+of\s+India\s+Act,?\s*\d{4}", "act", needs=(("securities",), ("exchange",))),
    Pattern(7, r"Securities\s+Contracts?\s*\(Regulation\)\s*Act,?\s*\d{4}", "act", needs=(("(regulation)",), ("contract",))),
    Pattern(8, r"Depositories\s+Act,?\s*\d{4}", "act", needs=(("depositories",),)),
    Pattern(9, r"Companies\s+Act,?\s*\d{4}", "act", needs=(("companies",),)),
    Pattern(10, r"(?:Prevention\s+of\s+Money\s+Laundering\s+Act|Income\s+Tax\s+Act|Indian\s+Contract\s+Act|Foreign\s+Exchange\s+Management\s+Act|Insolvency\s+and\s+Bankruptcy\s+Code),?\s*\d{4}", "act", needs=(("laundering", "income", "contract", "management", "bankruptcy"), ("act", "code"))),
    Pattern(
        11, r"(?:Section|Regulation|Rule|Clause|Chapter)\s+\d+[A-Za-z]?(?:\s*\(\d+\))*\s+of\s+(?:the\s+)?(.{10,120}?)(?=\.|,|\n|$)", "section_reference",
        re2=r"((?:Section|Regulation|Rule|Clause|Chapter)\s+\d+[A-Za-z]?(?:\s*\(\d+\))*\s+of\s+(?:the\s+)?.{10,120}?)(?:[.,\n]|$)",
        needs=(("section", "regulation", "rule", "clause", "chapter"),),
    ),
    Pattern(12, r"(?:Official\s+)?Gazette\s+of\s+India.*?(?:Part\s+[IVX]+[A-Za-z\s]*)?", "gazette", needs=(("gazette",),)),
    Pattern(13, r"(?:circular|letter)\s+(?:no\.?\s*)?[A-Z0-9/\-]+\s+dated\s+[\w\s,]+\d{4}", "circular", needs=(("circular", "letter"), ("dated",))),
)

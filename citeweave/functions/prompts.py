"""Prompt templates in our own words, and the text handling of templates that a model rewrites."""

from __future__ import annotations

import re

EXTRACT = """List every other document that the pages below refer to: circulars, regulations, acts, gazettes, letters, e-mails, press releases.
Answer with a JSON array of objects with the keys title, type and page_numbers and nothing else.
Leave out what is known already:
{existing_refs}

Pages:
{text}"""
CANONICAL = """These titles may name one document. Choose the most complete form.
{cluster}
Answer with one JSON object with the keys canonical_title and merged_page_numbers."""
VERIFY = """Which of these titles cite a real document? Headings, bare codes and page numbers don't.
{titles}
Answer with a JSON array of the titles to keep."""
JUDGE = """Improve this extraction prompt. Scores: precision {precision}, recall {recall}, F1 {f1}.
Missed: {missed}
Wrong: {false_positives}
Right: {correct}
Prompt:
{prompt}
First explain, then write ===PROMPT_SEPARATOR===, then the new prompt with its placeholders for known references and text."""
REFLECT = """Improve this extraction prompt. Scores: {scores}.
Missed: {missed}
Wrong: {false_positives}
Right: {correct}
Found by the model alone: {llm_unique}
Prompt:
{prompt}
Write the new prompt between START_PROMPT and END_PROMPT."""
SEPARATOR, START, END = "===PROMPT_SEPARATOR===", "START_PROMPT", "END_PROMPT"
PLACEHOLDERS = ("existing_refs", "text")


def protect_braces(template: str) -> str:
    """Doubles every brace but those of the two placeholders, so that the template can be formatted."""
    out = template.replace("{", "{{").replace("}", "}}")
    for p in PLACEHOLDERS:
        out = out.replace("{{%s}}" % p, "{%s}" % p)
    return out


def usable(template: str) -> bool:
    return all("{%s}" % p in template for p in PLACEHOLDERS)


def repair_placeholders(template: str) -> str | None:
    """The template with usual misspellings of the placeholders put right, None if one is still missing."""
    for p in PLACEHOLDERS:
        for wrong in ("{{%s}}" % p, "<<%s>>" % p, "[%s]" % p):
            template = template.replace(wrong, "{%s}" % p)
    return template if usable(template) else None


def without_fence(text: str, language: str = r"\w*") -> str:
    text = text.strip()
    if text.startswith("```"):
        text = re.sub(r"\n?```\s*$", "", re.sub(rf"^```(?:{language})?\s*\n?", "", text))
    return text


def rewritten(response: str, judge: bool = False) -> str | None:
    """The new template in a model's answer, ready to format; None if there is none that can be used."""
    text = response.strip()
    if not judge and START in text and END in text:
        new = text.split(START, 1)[1].split(END, 1)[0]
    elif SEPARATOR in text:
        new = text.split(SEPARATOR, 1)[1]
    else:
        return None
    new = without_fence(new)
    fixed = new if usable(new) else repair_placeholders(new)
    return protect_braces(fixed) if fixed else None


def formatted(template: str, existing: str, text: str) -> str | None:
    """The prompt, None if the template has other placeholders or stray braces."""
    try:
        return template.format(existing_refs=existing, text=text)
    except (KeyError, IndexError, ValueError):
        return None

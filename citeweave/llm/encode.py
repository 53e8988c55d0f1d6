"""Encoding of a corpus with a public tokenizer, by overlapping chunks.

A text longer than a chunk is cut into chunks that overlap. Each chunk is pre-tokenised on its own; a token's end counts
unless it is the chunk's end, because the pattern looks one character ahead at most. Where the ends of one chunk and of the
next meet in their overlap, both go on alike from there, so the first chunk's tokens are taken up to that point and the
second's after it. The texts between such points are encoded in parallel and their ids put together. Where an overlap holds no
common end (one word longer than the overlap) the two chunks are pre-tokenised as one, so the result is exact for every text.
Texts of one chunk need no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.llm.tokens import TOKENIZER_DIR, encoding, pattern
from citeweave.runtime import spread

#: characters of a chunk, which only the longest speeches exceed (one in seventy), and of the overlap
CHUNK, OVERLAP = 1 << 13, 1 << 9


#: The characters of the Unicode property White_Space, which \\s means to the tokenizer.
WHITE_SPACE = "\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SLICE = 512  # texts encoded before their ids are handed over, which bounds a worker's memory


def _compiled(folder: str):
    import regex

    return regex.compile(pattern(folder).replace(r"[^\s", "[^" + WHITE_SPACE).replace(r"\s", f"[{WHITE_SPACE}]").replace(r"\S", f"[^{WHITE_SPACE}]"))


def chunks_of(text: str, chunk: int, overlap: int) -> list[tuple[int, str]]:
    """(start, piece): pieces of ``chunk`` new characters each, with the overlap into the next."""
    return [(i, text[i : i + chunk + overlap]) for i in range(0, max(len(text), 1), chunk)]


def token_ends(piece: str, start: int, last: bool, pat) -> list[int]:
    """Ends of the pre-tokens of a chunk, in the text's positions; without the chunk's own end unless it is the text's."""
    stop = len(piece)
    return [start + m.end() for m in pat.finditer(piece) if last or m.end() < stop]


def stitch(parts: list[tuple[int, str, list[int]]], pat) -> list[tuple[int, int]]:
    """Spans of the text that can be encoded apart. parts: (start, piece, ends) in order."""
    spans, begin = [], 0
    start, piece, ends = parts[0]
    for nstart, npiece, nends in parts[1:]:
        mine = {e for e in ends if e > nstart and e >= begin}
        # position 0 of the next chunk is no boundary of the text, its ends are
        # and a piece must not end in white space, which the pattern takes differently before a text's end
        common = next((e for e in nends if e in mine and not npiece[e - nstart - 1].isspace()), None)
        if common is None:
            # no resynchronisation: one chunk from the earlier start
            piece = piece[: nstart - start] + npiece
            stop = start + len(piece)
            tail = nends[-1:] == [stop]
            ends = [e for e in token_ends(piece[begin - start :], begin, tail, pat)] if begin > start else token_ends(piece, start, tail, pat)
        else:
            spans.append((begin, common))
            begin, start, piece, ends = common, nstart, npiece, [e for e in nends if e >= common]
    spans.append((begin, start + len(piece)))
    return [s for s in spans if s[0] < s[1]]


def _encode_whole(id_col: str, text_col: str, folder: str, name: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(folder, name)
        for df in batches:
            for k in range(0, len(df), SLICE):
                part = df.iloc[k : k + SLICE]
                yield pd.DataFrame({id_col: part[id_col], "ids": [np.array(enc.encode_ordinary(t) if t else [], dtype=np.int32) for t in part[text_col]]})

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZER_DIR, name: str = "byte_bpe_50k", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, ids array<int>): the encoding of every text without special tokens; an empty list for an empty or null text.

    Every row comes out once, repeated ids included; ids of long texts are keyed by a row number of their own, not by the
    id. Blank texts are encoded like any other. Strings of special tokens are ordinary text. Other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = spread(docs.select(id_col, text_col), id_col)
    whole = rows.where(F.col(text_col).isNull() | (F.length(text_col) <= chunk)).mapInPandas(_encode_whole(id_col, text_col, folder, name), f"`{id_col}` {kind}, ids array<int>")
    long = rows.where(F.length(text_col) > chunk)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        for df in batches:
            for i, t in zip(df[id_col], df[text_col]):
                key, parts = uuid.uuid5(uuid.NAMESPACE_OID, f"{i}\x1f{t}").hex, chunks_of(t, chunk, overlap)
                for s, p in parts:
                    yield pd.DataFrame({id_col: [i], "row": [key], "start": [s], "piece": [p], "last": [s + len(p) >= len(t)]})

    def bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pat = _compiled(folder)
        for df in batches:
            # only ends inside the overlaps are compared
            df["ends"] = [[e for e in token_ends(p, s, last, pat) if e <= s + overlap or e > s + chunk or e == s + len(p)] for p, s, last in zip(df["piece"], df["start"], df["last"])]
            yield df

    def join(df: pd.DataFrame) -> pd.DataFrame:
        # one long text; its overlaps are cut off again
        pat = _compiled(folder)
        parts = []
        for s, p, e in df.sort_values("start")[["start", "piece", "ends"]].itertuples(index=False):
            if parts and parts[-1][0] == s:
                continue  # the same id and text repeated
            if not parts or s + len(p) > parts[-1][0] + len(parts[-1][1]):
                parts.append((int(s), p, [int(x) for x in e]))
        text = "".join(p[: nxt - s] for (s, p, _), nxt in zip(parts, [x[0] for x in parts[1:]] + [10**18]))
        spans = stitch(parts, pat)
        copies = int((df["start"] == 0).sum())
        return pd.DataFrame({id_col: df[id_col].iloc[0], "row": df["row"].iloc[0], "copies": copies, "start": [a for a, _ in spans], "piece": [text[a:b] for a, b in spans]})

    def encode_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(folder, name)
        for df in batches:
            yield pd.DataFrame({id_col: df[id_col], "row": df["row"], "copies": df["copies"], "start": df["start"], "ids": [np.array(enc.encode_ordinary(p), dtype=np.int32) for p in df["piece"]]})

    pieces = long.mapInPandas(cut, f"`{id_col}` {kind}, row string, start bigint, piece string, last boolean").repartition("row", "start").mapInPandas(bounds, f"`{id_col}` {kind}, row string, start bigint, piece string, last boolean, ends array<bigint>")
    spans = pieces.groupBy("row").applyInPandas(join, f"`{id_col}` {kind}, row string, copies int, start bigint, piece string")
    coded = spans.repartition("row", "start").mapInPandas(encode_pieces, f"`{id_col}` {kind}, row string, copies int, start bigint, ids array<int>")
    put = (
        coded.groupBy(id_col, "row", "copies").agg(F.array_sort(F.collect_list(F.struct("start", "ids"))).alias("x"))
        .select(F.col(id_col), F.flatten(F.transform("x", lambda e: e["ids"])).alias("ids"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_")).drop("_")
    )
    return whole.unionByName(put)


def decode(ids: list[int], folder: str = TOKENIZER_DIR, name: str = "byte_bpe_50k") -> str:
    """The text: raw bytes of the ids put together, then read as UTF-8 at once (a character may span tokens)."""
    enc = encoding(folder, name)
    return b"".join(enc.decode_single_token_bytes(i) for i in ids).decode("utf-8")


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZER_DIR, name: str = "byte_bpe_50k") -> DataFrame:
    """(id, size): number of tokens of every text, 0 for empty and null ones."""
    return encode(docs, id_col, text_col, folder, name).select(F.col(id_col), F.size("ids").alias("size"))

"""Loading of the public tokenizers (their folder is a parameter; the files stay where they are)."""

from __future__ import annotations

import base64
import importlib.util
import os
from functools import lru_cache

#: where the vocabulary files lie
TOKENIZER_DIR = "/opt/tokenizers"


@lru_cache(maxsize=4)
def encoding(folder: str = TOKENIZER_DIR, name: str = "byte_bpe_50k"):
    """tiktoken.Encoding of <folder>/<name>.tiktoken without special tokens, so their strings are ordinary text."""
    import tiktoken

    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=pattern(folder), mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def pattern(folder: str = TOKENIZER_DIR) -> str:
    spec = importlib.util.spec_from_file_location("_tokenizer_folder", os.path.join(folder, "__init__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module.PATTERN


def piece_counter(folder: str = TOKENIZER_DIR):
    """word -> number of byte_bpe_50k tokens of " word"; remembers the words it has seen."""
    enc = encoding(folder)
    return lru_cache(maxsize=1 << 18)(lambda w: len(enc.encode_ordinary(" " + w)))

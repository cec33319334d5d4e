"""A public tokenizer in the workers: byte-level BPE from a rank file whose path is a parameter."""

from __future__ import annotations

import base64
import importlib.util
import os
from functools import lru_cache

import numpy as np

#: Where the rank file is looked for if no path is given: a file name in this folder.
FOLDER = os.environ.get("WEFT_TOKENIZERS", "/opt/tokenizers")
RANKS = "byte_bpe_50k.tiktoken"


def default_path() -> str:
    spec = importlib.util.find_spec("public_tokenizers")
    folder = os.path.dirname(spec.origin) if spec and spec.origin else FOLDER
    return os.path.join(folder, RANKS)


@lru_cache(maxsize=2)
def encoding(path: str):
    """The encoding of a rank file and the bytes of each token; loaded once a worker."""
    import tiktoken

    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def encode(text: str, path: str) -> list[int]:
    """The tokens of a text; what UTF-8 cannot hold (lone surrogates) is replaced first."""
    enc, _ = encoding(path)
    try:
        return enc.encode_ordinary(text)
    except UnicodeEncodeError:
        return enc.encode_ordinary(text.encode("utf-8", "replace").decode())

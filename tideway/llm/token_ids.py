"""Token ids of the public byte-level BPE, as numpy arrays.

The vocabulary file is the one in rank form: the same vocabulary and merges as the JSON file for ``tokenizers``,
so the ids are equal (tests compare them), and whole texts encode several times faster. The rank form lacks the JSON file's added
tokens; they are read from the JSON file, which lies beside it, and found inside texts as ``tokenizers`` finds them. The fast reader
refuses some texts (a million spaces in a row exhaust its pattern's stack): those, whole, are encoded by ``tokenizers`` from the JSON file.
"""

from __future__ import annotations

import base64
import functools
import json
import os

import numpy as np

BYTE_BPE = "byte_bpe_50k.tiktoken"
END_OF_DOCUMENT = 2


def _path(vocabulary: str) -> str:
    import public_tokenizers

    return vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)


def _json_beside(path: str) -> str:
    return os.path.splitext(path)[0] + ".json"


def added_tokens(path: str) -> dict[str, int]:
    """Added tokens of the JSON file beside a rank file; none where there is no such file."""
    beside = _json_beside(path)
    if not os.path.exists(beside):
        return {}
    with open(beside, encoding="utf-8") as file:
        tokens = json.load(file)["added_tokens"]
    for token in tokens:
        if token["single_word"] or token["lstrip"] or token["rstrip"]:
            raise ValueError(f"added token with a context: {token}")
    return {token["content"]: token["id"] for token in tokens}


@functools.lru_cache(maxsize=2)
def encoder(vocabulary: str = BYTE_BPE):
    """The encoder of a vocabulary file; ``vocabulary`` is a public file's name or a path."""
    import public_tokenizers
    import tiktoken

    path = _path(vocabulary)
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added_tokens(path))


@functools.lru_cache(maxsize=4)
def json_encoder(vocabulary: str = BYTE_BPE, added: bool = True):
    """The encoder of the JSON file beside a rank file; without ``added`` the strings of added tokens are ordinary text."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(_json_beside(_path(vocabulary)))
    found.encode_special_tokens = not added
    return found


def _ids(text: str, vocabulary: str, added: bool) -> np.ndarray:
    try:
        ids = encoder(vocabulary).encode_to_numpy(text, allowed_special="all" if added else set(), disallowed_special=())
    except ValueError:
        ids = np.array(json_encoder(vocabulary, added).encode(text, add_special_tokens=False).ids)
    return ids.astype("<u4", copy=False)


def encode(text: str, vocabulary: str = BYTE_BPE) -> np.ndarray:
    """Ids of a whole text as little-endian unsigned 32-bit numbers; strings of special tokens are ordinary text."""
    return _ids(text, vocabulary, added=False)


def document_ids(text: str, vocabulary: str = BYTE_BPE) -> np.ndarray:
    """Ids of a whole document as :func:`encode` gives them, but each added token inside the text is its one id."""
    return _ids(text, vocabulary, added=True)

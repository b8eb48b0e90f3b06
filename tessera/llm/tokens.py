"""Token ids of whole texts by a public vocabulary, one encoder a worker process."""

from __future__ import annotations

import base64
import json
import os
from functools import cache

import numpy as np


def default_vocabulary() -> str:
    """Path of the byte-level vocabulary that the queries use; it must be at the same place on every executor."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def exact(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def added(path: str) -> tuple[str, ...]:
    """The strings that the file takes out of a text before it splits it, such as special tokens."""
    return tuple(t.content for t in exact(path).get_added_tokens_decoder().values())


@cache
def fast(path: str):
    """The same vocabulary as ranks, three times as fast; None where the file has no such twin or splits otherwise."""
    twin = path.removesuffix(".json") + ".tiktoken"
    if not path.endswith("byte_bpe_50k.json") or not os.path.exists(twin):
        return None
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(twin, "rb"))}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(path: str, text: str) -> np.ndarray:
    """Ids of the whole text as unsigned 32-bit numbers: those of the file's encoder, special tokens of the vocabulary included where the text holds their strings."""
    quick = fast(path)
    if quick is not None and not any(t in text for t in added(path)):
        try:
            return quick.encode_to_numpy(text, disallowed_special=()).astype(np.uint32)
        except BaseException as e:
            # the pattern's backtracking limit on endless white space is a panic, which is no Exception
            if type(e).__name__ != "PanicException":
                raise
    return np.array(exact(path).encode(text, add_special_tokens=False).ids, np.uint32)


@cache
def byte_lengths(path: str) -> np.ndarray:
    """Bytes of each id of a byte-level vocabulary: each letter of its written form stands for one byte. Others are refused."""
    vocabulary = exact(path).get_vocab(with_added_tokens=True)
    if json.loads(exact(path).to_str()).get("pre_tokenizer", {}).get("type") != "ByteLevel":
        raise ValueError(f"not a byte-level vocabulary: {path}")
    out = np.zeros(max(vocabulary.values()) + 1, np.int64)
    for word, k in vocabulary.items():
        out[k] = len(word)
    for k, token in exact(path).get_added_tokens_decoder().items():
        out[k] = len(token.content.encode())
    return out

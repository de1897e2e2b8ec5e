"""Encoding texts with a byte-level BPE vocabulary, fast and id for id as the tokenizers library does."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable

import numpy as np

#: How byte-level BPE cuts a text into pieces (fixed value, published with the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of_character() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable bytes stand for themselves,
    the others are numbered from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """A function from a text to its ids (no special tokens added) for a tokenizers JSON file.

    A plain byte-level BPE whose ids follow its merges is run by tiktoken, which gives the same ids five
    times as fast; any other file, and a text that tiktoken's matcher gives up on, by tokenizers.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)

    def by_tokenizers(text: str) -> np.ndarray:
        return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    added = {token["content"]: token["id"] for token in spec.get("added_tokens", [])}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
    vocab = {token: i for token, i in model.get("vocab", {}).items() if token not in added}
    plain = (
        model.get("type", "BPE") == "BPE"
        and pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True)
        and not pre.get("add_prefix_space")
        and spec.get("normalizer") is None
        and len(vocab) == 256 + len(merges)
        and all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(merges))
        and not any(token[k] for token in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word"))
    )
    if not plain:
        return by_tokenizers

    import tiktoken

    byte = _byte_of_character()
    ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items()}
    fast = tiktoken.Encoding("byte_level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def encode(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all")
        except Exception:  # the matcher's limit on long runs of white space
            return by_tokenizers(text)

    return encode


@functools.lru_cache(maxsize=4)
def sentence_ends(path: str) -> np.ndarray:
    """For each id of the vocabulary, whether its text ends a sentence or a line."""
    from tokenizers import Tokenizer

    vocab = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    out = np.zeros(max(vocab.values()) + 1, bool)
    marks = {".", "!", "?", "Ċ"}  # the last stands for a line feed in a byte-level vocabulary
    for token, i in vocab.items():
        out[i] = token[-1:] in marks
    return out

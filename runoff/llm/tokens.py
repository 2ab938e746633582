"""Token identifiers of whole texts by a public vocabulary with word ends.

A word's identifiers don't depend on the words around it, so each distinct word of a slice is encoded once. Words of
Latin letters, digits and signs take a short way, the same byte-pair merges without offsets and records; any other
word goes through the tokenizer itself.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

from runoff.llm.words import CACHE_WORDS, code_words, gather

#: Stands for the end of a word; no UTF-8 text holds this byte.
_END = b"\xff"
#: The vocabulary's own split pattern.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: U+0021 to U+024F without controls, spaces and the characters whose lower case depends on their place.
_PLAIN = r"[\x21-\x7e\xa1-\xac\xae-įĲ-ɏ]+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder(dict):
    """word -> its identifiers as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, special_as_text: bool) -> None:
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.exact.encode_special_tokens = special_as_text
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level BPE shows these bytes as themselves
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {}
        for token, rank in model["vocab"].items():
            body, end = (token[:-4], _END) if token.endswith("</w>") else (token, b"")
            if not body.startswith("<|"):
                ranks[bytes(byte[c] for c in body) + end] = rank
        self.merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.pieces, self.plain = regex.compile(_PIECES).findall, regex.compile(_PLAIN).fullmatch

    def __missing__(self, word: str) -> bytes:
        if self.plain(word) and "<|" not in word:
            normal = word.lower() if word.isascii() else unicodedata.normalize("NFC", word).lower()
            ids = [x for piece in self.pieces(normal) for x in self.merge(piece.encode() + _END)]
        else:
            ids = self.exact.encode(word, add_special_tokens=False).ids
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = self[word] = np.array(ids, "<u4").tobytes()
        return found


@lru_cache(maxsize=2)
def encoder(path: str, special_as_text: bool = False) -> WordEncoder:
    """One for each worker process; its cache outlives a task."""
    return WordEncoder(path, special_as_text)


def encode(texts: pa.Array, words: WordEncoder) -> tuple[np.ndarray, np.ndarray]:
    """All identifiers, and bounds: text i has ids[bounds[i]:bounds[i + 1]]."""
    coded = code_words(texts)
    parts = [words[w] for w in coded.distinct]
    sizes = np.fromiter((len(p) // 4 for p in parts), np.int64, len(parts))
    flat, starts = np.frombuffer(b"".join(parts), "<u4"), np.cumsum(sizes) - sizes
    each = sizes[coded.codes]
    ends = np.concatenate([[0], np.cumsum(each)])
    return flat[gather(starts[coded.codes], each)], ends[coded.bounds]

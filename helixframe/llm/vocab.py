"""Loading of public tokenizer files and exact encoders built on cached segments.

The path of a tokenizer file is always a parameter; every worker reads the file itself (it is
installed on all machines) and keeps one encoder per path and process.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
from array import array

import numpy as np
import public_tokenizers

from .segments import BatchedSegments, SpacedSegments

_LOADED: dict = {}


def tokenizer_version(path: str) -> str:
    """Digest of the library, its version and the file: another tokenizer never shares counts."""
    from importlib.metadata import version

    library = {".model": "sentencepiece", ".json": "tokenizers", ".tiktoken": "tiktoken"}[os.path.splitext(path)[1]]
    with open(path, "rb") as f:
        return hashlib.sha256(f"{library} {version(library)} ".encode() + hashlib.sha256(f.read()).digest()).hexdigest()


def read_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character: printable Latin-1 bytes
    stand for themselves, the others follow from U+0100 on in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class PieceEncoder:
    """sentencepiece ids of whole texts, segment by segment where that is exact."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self._sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self._sp.id_to_piece(i) for i in range(self._sp.get_piece_size())]
        probe = "a  b ａ "
        self._safe = not any(re.search("[^▁]▁", p) for p in pieces) and self._sp.decode(self._sp.encode(probe)) == probe
        self._space = self._sp.piece_to_id("▁")
        self._lengths = BatchedSegments(lambda parts: list(map(len, self._encode(parts))))

    def _encode(self, parts: list[str]) -> list[list[int]]:
        return [ids if part else [self._space] for part, ids in zip(parts, self._sp.encode(parts, num_threads=1), strict=True)]

    def _cut(self, text: str) -> list[str]:
        parts = text.split(" ")
        return parts if "" not in parts else [x[1:] for x in re.findall(" +[^ ]*", " " + text)]

    def counts(self, texts: list[str]) -> list[int]:
        """Number of ids of each text."""
        cut = [self._cut(t) if t and self._safe and "▁" not in t else [] for t in texts]
        sums = [sum(v) for v in self._lengths.of_parts(cut)]
        return [n if c or not t else len(self._sp.encode(t, num_threads=1)) for t, c, n in zip(texts, cut, sums, strict=True)]


class ByteLevelEncoder:
    """ids of whole texts for a byte-level BPE file of the tokenizers library (.json).

    If the file is plain (the usual split, no normaliser, merges in the order of their ids), the
    segments are merged by rank, which gives the library's ids; otherwise the library itself
    encodes the whole texts.  Added tokens inside a text become their ids, as in the library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        self._library = None
        chars = _byte_of_char()
        special = {a["content"]: a["id"] for a in added}
        try:
            ranks = {bytes(chars[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
            merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
            in_order = [model["vocab"][a + b] for a, b in merges]
        except KeyError:
            ranks, in_order = {}, [1, 0]
        plain = (
            in_order == sorted(in_order)
            and len(ranks) == len(in_order) + 256
            and split.get("type") == "ByteLevel"
            and not split.get("add_prefix_space")
            and split.get("use_regex")
            and not spec.get("normalizer")
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
            and not any(a.get("lstrip") or a.get("rstrip") or a.get("single_word") or " " in a["content"] for a in added)
        )
        if plain:
            import tiktoken

            self._ranked = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
            self._segments = SpacedSegments(self._encode)
        else:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(path)

    def _encode(self, part: str) -> bytes:
        return array("I", self._ranked.encode(part, allowed_special="all")).tobytes()

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if self._library is not None:
            return [np.array(e.ids, dtype="<u4").tobytes() for e in self._library.encode_batch(texts, add_special_tokens=False)]
        return list(map(self._segments.of, texts))


def encoder(path: str):
    """The process's encoder for a .model or .json file."""
    if path not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _LOADED[path] = PieceEncoder(path) if path.endswith(".model") else ByteLevelEncoder(path)
    return _LOADED[path]

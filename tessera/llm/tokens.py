"""Token ids by the tokenizers library, with a memo of the ids of white-space separated pieces.

Both vocabularies cut a text at the border between a character that isn't white
space and a space or line break after it, so the pieces between such borders
can be encoded once and their ids reused. Pieces are found with Python's notion
of white space, which holds all that the libraries take for it. A text that holds
one of the vocabulary's added tokens (such as <|endoftext|>) is left to the library whole,
so its ids are always those of `Tokenizer.from_file(path).encode(text, add_special_tokens=False)`.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

_RUN = re.compile(r"[^\S \n]|[ \n][ \n]|\0")
_PIECE = re.compile(r"[ \n]\S+\Z")
_CASE = re.compile("[\x1c-\x1f\u0130\u03a3]")  # not white space to the library; lower case by context
_BETWEEN = "\u2665"
_BORDER = re.compile(r"(?<=\S)(?=[ \n])")
MEMO_PIECES = 1_000_000
_encoders: dict[str, "Encoder"] = {}


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = sorted({t.content for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added else None
        self.memo: dict[str, bytes] = {}
        self.vocabulary = self.tokenizer.get_vocab_size()
        words = self.tokenizer.get_vocab()
        #: this vocabulary drops white space and lowers case, so pieces can be words in lower case
        self.lower = "Lowercase" in str(self.tokenizer.normalizer) and "</w>" in str(self.tokenizer.model)
        self.begins = None
        if not self.lower and "\u0120" in words:  # byte-level: how the vocabulary writes a space; a line break is U+010A
            self.begins = np.zeros(max(words.values()) + 1, bool)
            self.begins[[i for w, i in words.items() if w[0] in "\u0120\u010a"]] = True

    def _encode_joined(self, unknown: set[str]) -> list[str]:
        """Encodes pieces that begin with their only white space, many at a time; returns the others.

        Byte-level ids that begin with a space or line break then mark where pieces begin.
        """
        joint = [p for p in unknown if _PIECE.match(p)]
        rest = [p for p in unknown if not _PIECE.match(p)]
        parts = [joint[i : i + 512] for i in range(0, len(joint), 512)]
        for part, e in zip(parts, self.tokenizer.encode_batch_fast(["".join(x) for x in parts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            edge = np.flatnonzero(self.begins[ids])
            if len(edge) != len(part):
                rest += part
                continue
            raw, cut = ids.tobytes(), [*(4 * edge).tolist(), 4 * len(ids)]
            self.memo.update(zip(part, map(raw.__getitem__, map(slice, cut, cut[1:])), strict=True))
        return rest

    def _encode_apart(self, unknown: set[str]) -> list[str]:
        """Encodes words many at a time, with a word of one id between them that they don't hold; returns the others."""
        mark = self.tokenizer.encode(_BETWEEN, add_special_tokens=False).ids
        if len(mark) != 1:
            return list(unknown)
        joint, rest = [p for p in unknown if p and _BETWEEN not in p], [p for p in unknown if not p or _BETWEEN in p]
        parts = [joint[i : i + 512] for i in range(0, len(joint), 512)]
        for part, e in zip(parts, self.tokenizer.encode_batch_fast([f" {_BETWEEN} ".join(x) for x in parts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            at = 4 * np.flatnonzero(ids == mark[0])
            if len(at) != len(part) - 1:
                rest += part
                continue
            raw = ids.tobytes()
            self.memo.update(zip(part, map(raw.__getitem__, map(slice, [0, *(at + 4).tolist()], [*at.tolist(), len(raw)])), strict=True))
        return rest

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        memo, get = self.memo, self.memo.get
        if len(memo) > MEMO_PIECES:
            memo.clear()
        found, unknown = [], set()
        for t in texts:
            if self.added and self.added.search(t):
                found.append(([array("I", self.tokenizer.encode(t, add_special_tokens=False).ids).tobytes()], []))
                continue
            if self.lower and not _CASE.search(t):
                pieces = t.lower().split()
            elif _RUN.search(t):
                pieces = _BORDER.split(t)
            else:
                pieces = t.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
            ids = list(map(get, pieces))
            holes = [(k, pieces[k]) for k, x in enumerate(ids) if x is None]
            unknown.update([p for _, p in holes])
            found.append((ids, holes))
        todo = self._encode_joined(unknown) if self.begins is not None else self._encode_apart(unknown) if self.lower else list(unknown)
        for i in range(0, len(todo), 4096):
            part = todo[i : i + 4096]
            for piece, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                memo[piece] = array("I", e.ids).tobytes()
        for ids, holes in found:
            for k, p in holes:
                ids[k] = memo[p]
        return [b"".join(ids) for ids, _ in found]


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, one for each Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)

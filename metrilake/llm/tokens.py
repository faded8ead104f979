"""Token ids of whole texts with a public byte-level BPE vocabulary."""
from __future__ import annotations

import os
import re
from array import array


_FAR = re.compile("[\u0250-\U0010ffff]")


class Encoder:
    """Ids of byte_bpe_50k.json, the same as the tokenizers library gives with add_special_tokens=False: none are put
    around a text; where a text itself spells one out, that is one id, and the library encodes the text whole.

    The quicker library encodes texts of the first Unicode blocks, whose letters and blanks both libraries class
    alike.  Of others, a piece between single spaces or line feeds, with a space before it, is encoded once and
    its ids are kept (up to a bound); a text whose white space allows no such cut is encoded whole.
    """

    def __init__(self, path: str, most: int = 250_000):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self._whole = Tokenizer.from_file(path)
        self._special = [t.content for t in self._whole.get_added_tokens_decoder().values()]
        self._quick = _ranked(path)
        self._after_space = _Kept(self, " ", most)
        self._at_start = _Kept(self, "", most // 8)
        self._line = self._encode("\n")

    def _encode(self, text: str) -> bytes:
        if self._quick is not None and (text.isascii() or not _FAR.search(text)):
            return array("H", self._quick.encode_ordinary(text)).tobytes()
        return array("H", self._whole.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str | None) -> bytes:
        """The ids as native 16-bit unsigned integers (the vocabulary has 50,257)."""
        if not text:
            return b""
        if any(t in text for t in self._special):
            return array("H", self._whole.encode(text, add_special_tokens=False).ids).tobytes()
        if self._quick is not None and not _FAR.search(text):
            return self._encode(text)
        out: list[bytes | None] = []
        for line in text.split("\n"):
            head, *pieces = line.split(" ")
            out.append(self._at_start[head])
            out += map(self._after_space.__getitem__, pieces)
            out.append(self._line)
        out.pop()
        return self._encode(text) if None in out else b"".join(out)


class _Kept(dict):
    """Ids of pieces with what stands before them; None where the white space
    around a piece joins its own or its neighbour's."""

    def __init__(self, encoder: Encoder, before: str, most: int):
        self.encoder, self.before, self.most = encoder, before, most
        self.marks = {c: encoder._encode(c) for c in ",."}

    def __missing__(self, piece: str) -> bytes | None:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            return None
        mark = self.marks.get(piece[-1])
        if mark is not None and piece[:-1].isalpha():  # a word and the mark behind it are split before merging
            ids = self[piece[:-1]] + mark
        else:
            ids = self.encoder._encode(self.before + piece)
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[piece] = ids
        return ids


def _ranked(path: str):
    """The quicker library over the same vocabulary, where its file lies beside the given one."""
    import base64

    ranks = os.path.splitext(path)[0] + ".tiktoken"
    if not os.path.exists(ranks):
        return None
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary file and Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))

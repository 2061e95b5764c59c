"""Whole-text encoding with the ``tokenizers`` library, with a bounded cache of repeated words.

Both supported vocabularies cut a text at fixed places before they merge bytes, so the ids of a text are the ids of
its chunks in order.  A chunk begins at a blank or a line feed before a visible character.  The texts of an Arrow batch
are cut and their different chunks found by Arrow; a chunk seen before comes from the cache; a new one of plain
letters, digits and signs goes to the library's BPE model directly; any other goes through the library's whole
encoder, and so does every text that holds the string of a special token.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_SEEN = "!-~À-ÖØ-öø-ÿ"  # visible characters at which a chunk may begin
_SIGNS = "!-&(-/:-@\\[-`{-~"  # no apostrophe: it can begin a contraction
_ODD = f"[ \n](?:[^{_SEEN}]|$)|^[ \n]|<\\|"  # texts that aren't cut by Arrow
_CUT = re.compile(f"(?=[ \n][{_SEEN}])")
_BYTE_PLAIN = re.compile(f"(\n?)([{_LATIN}]+|[0-9]+|)([{_SIGNS}]*)")
_WORD_PLAIN = re.compile(f"()([{_LATIN}]*)([{_SIGNS}]*)")
_START = "\0"  # stands before a chunk that nothing precedes
_SLICE = 8_000_000  # bytes of text that are cut at a time


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level BPE: printable Latin-1 bytes stay, others follow from 256."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return {b: chr(b) if b in keep else chr(next(rest)) for b in range(256)}


class Encoder(dict):
    """``encode(text)`` gives a text's ids as little-endian unsigned 32-bit integers.

    ``None`` and ``''`` have no ids.  The mapping itself holds the encoded chunks, ``limit`` at most."""

    def __init__(self, path: str, limit: int = 600_000):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.limit, self.words = limit, path.endswith(WORD_BPE)
        self.cached = self.words or path.endswith(BYTE_BPE)
        self.plain = _WORD_PLAIN if self.words else _BYTE_PLAIN
        self.letters, self.pieces = _byte_letters(), {"": b""}

    def _whole(self, text: str) -> bytes:
        ids = self.tok.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, text: str) -> bytes:
        got = self.pieces.get(text)
        if got is None:
            if text.isascii():  # of its characters only these two have a stand-in
                shown = text.replace(" ", self.letters[32]).replace("\n", self.letters[10])
            else:
                shown = text.encode().decode("latin-1").translate(self.letters)
            ids = [t.id for t in self.model.tokenize(shown)]
            got = struct.pack(f"<{len(ids)}I", *ids)
            if len(self.pieces) < self.limit:
                self.pieces[text] = got
        return got

    def __missing__(self, chunk: str) -> bytes:
        """A chunk without its leading blank, with its leading line feed or with the mark of a text's start."""
        word, sign = (chunk[:-1], chunk[-1]) if chunk[-1:] in (",", ".") else (chunk, "")
        if word.isascii() and word.isalpha() and len(word) < 60:  # by far the most
            got = self._piece(word.lower() if self.words else " " + word) + self._piece(sign)
            if len(self) < self.limit:
                self[chunk] = got
            return got
        plain = self.plain.fullmatch(chunk) if len(chunk) < 64 else None
        if plain and self.words:
            got = self._piece(plain[2].lower()) + self._piece(plain[3])
        elif plain and plain[1]:
            got = self._piece("\n") + self._piece(plain[2]) + self._piece(plain[3])
        elif plain and plain[2]:
            got = self._piece(" " + plain[2]) + self._piece(plain[3])
        elif plain:
            got = self._piece(" " + plain[3])
        elif self.words or chunk[0] == "\n":
            got = self._whole(chunk)
        else:
            got = self._whole(chunk[1:] if chunk[0] == _START else " " + chunk)
        if len(self) < self.limit and len(chunk) < 64:
            self[chunk] = got
        return got

    def encode(self, text: str | None) -> bytes:
        """Any one text."""
        if not text:
            return b""
        if not self.cached or "<|" in text and any(s in text for s in self.special):
            return self._whole(text)
        if self.words:
            return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))
        first, *rest = _CUT.split(text)
        return self._whole(first) + b"".join([self[c[1:] if c[0] == " " else c] for c in rest])

    def _slice(self, texts: pa.Array) -> list[bytes]:
        odd = pc.fill_null(pc.equal(texts, "") if self.words else pc.or_(pc.equal(texts, ""), pc.match_substring_regex(texts, _ODD)), True)
        if self.words:
            odd = pc.or_(odd, pc.fill_null(pc.match_substring(texts, "<|"), True))
        odd = odd.to_numpy(zero_copy_only=False)
        even = texts.filter(pa.array(~odd))
        if self.words:
            even = pc.replace_substring(even, "\n", " ")
        else:
            even = pc.replace_substring(pc.binary_join_element_wise(_START, even, ""), "\n", " \n")
        cut = pc.split_pattern(even, " ")
        chunks = cut.values.dictionary_encode()
        of = chunks.indices.to_numpy()
        ids = list(map(self.__getitem__, chunks.dictionary.to_numpy(zero_copy_only=False).tolist()))
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        at, flat = np.cumsum(size) - size, np.frombuffer(b"".join(ids), "<u4")
        n = size[of]
        ends = np.cumsum(n)
        data = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(at[of] - (ends - n), n)]
        bounds = np.concatenate([[0], ends])[cut.offsets.to_numpy()]
        made = (data[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()))
        return [self.encode(texts[i].as_py()) if o else next(made) for i, o in enumerate(odd.tolist())]

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text of an Arrow array, in order; some megabytes are worked on at a time."""
        if not self.cached:
            yield from map(self._whole, (t or "" for t in texts.to_pylist()))
            return
        total = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
        first = 0
        while first < len(texts):
            done = total[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(total, done + _SLICE, "right")))
            yield from self._slice(texts.slice(first, last - first))
            first = last


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]

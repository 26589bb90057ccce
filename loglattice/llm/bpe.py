"""Byte-level BPE ids of whole Arrow columns, with the ``tokenizers`` library.

Merges never cross a pre-token, so each distinct pre-token is encoded once by
the library's model and looked up afterwards.  Texts are cut at single spaces
first: a space followed by a character that isn't white space always begins a
pre-token, so pieces cut there are independent.  Texts in which a space
stands before other white space, or at the end, are cut by the pattern as a
whole.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

#: The pre-token pattern of byte-level BPE (a fixed value of the format).
PRETOKEN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: A space that doesn't begin a pre-token with what follows.
LOOSE_SPACE = r" ([\s\x0b\x1c-\x1f\x{85}\p{Z}\x{180e}]|$)"
#: Entries that the look-up table of one worker holds, and the longest one, in characters.
CACHE_ENTRIES, CACHE_LENGTH = 600_000, 64


def _byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte, by the rule of the format."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return out


class BpeEncoder:
    """``encode`` gives the ids of a column of texts and each text's bounds in them.

    The file's added tokens count where a text holds them, as in the library;
    such texts go to the library whole.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.model._resize_cache(0)
        self.alphabet = _byte_alphabet()
        #: Half of the table, and the half before; what is met again moves to the new half.
        self.pretokens: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: What any text with an added token matches; None if there is none.
        self.added = "|".join(map(regex.escape, added)) or None

    def _ids(self, pretoken: str) -> bytes:
        known = self.pretokens
        if len(known) >= CACHE_ENTRIES // 2:
            self.earlier = dict(known)
            known.clear()
        if (ids := self.earlier.get(pretoken)) is not None:
            known[pretoken] = ids
            return ids
        mapped = pretoken.encode("utf-8", "replace").decode("latin-1").translate(self.alphabet)
        ids = np.array([t.id for t in self.model.tokenize(mapped)], "<u4").tobytes()
        if len(pretoken) <= CACHE_LENGTH:
            known[pretoken] = ids
        return ids

    def _piece(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        get, ids = self.pretokens.get, self._ids
        return b"".join([get(p) or ids(p) for p in PRETOKEN.findall(text)])

    def _spaced(self, word: str) -> bytes:
        """The ids of a space and a word; most words are letters, or letters and a mark."""
        get = self.pretokens.get
        if word.isalpha():
            ids = get(" " + word) or self._ids(" " + word)
        elif word[:-1].isalpha() and word[-1] in ".,;:!?":
            ids = (get(" " + word[:-1]) or self._ids(" " + word[:-1])) + (get(word[-1]) or self._ids(word[-1]))
        else:
            ids = self._piece(" " + word)
        return ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if self.added:
            holds = pc.match_substring_regex(texts, self.added).to_numpy(zero_copy_only=False)
            if holds.any():
                return self._mixed(texts, holds, self._whole)
        loose = pc.match_substring_regex(texts, LOOSE_SPACE).to_numpy(zero_copy_only=False)
        if loose.any():
            return self._mixed(texts, loose, self._piece)
        lists = pc.split_pattern(texts, " ")
        bounds = lists.offsets.to_numpy()
        bounds, flat = bounds - bounds[0], lists.flatten()
        coded = flat.dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        heads = np.zeros(len(codes), bool)
        heads[bounds[:-1]] = True
        used = np.flatnonzero(np.bincount(codes[~heads], minlength=len(coded.dictionary)))
        entries = list(map(self._spaced, coded.dictionary.take(pa.array(used)).to_pylist()))
        entries += [self._piece(t) for t in flat.take(pa.array(bounds[:-1])).to_pylist()]
        place = np.full(len(coded.dictionary), -1, np.int64)
        place[used] = np.arange(len(used))
        codes = place[codes]
        codes[bounds[:-1]] = np.arange(len(used), len(entries))
        out = pa.array(entries, pa.large_binary()).take(pa.array(codes))
        at = np.frombuffer(out.buffers()[1], np.int64, len(codes) + 1)
        ids = np.frombuffer(out.buffers()[2], "<u4", at[-1] // 4) if at[-1] else np.empty(0, "<u4")
        return ids, at[bounds] // 4

    def _whole(self, text: str) -> bytes:
        """The ids by the library alone."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _mixed(self, texts: pa.Array, apart: np.ndarray, ids_of) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, with the texts set ``apart`` encoded by ``ids_of``."""
        parts: list[np.ndarray] = [np.frombuffer(b"", "<u4")] * len(texts)
        even = np.flatnonzero(~apart)
        if len(even):
            ids, at = self.encode(texts.take(pa.array(even)))
            for k, i in enumerate(even):
                parts[i] = ids[at[k] : at[k + 1]]
        for i in np.flatnonzero(apart):
            parts[i] = np.frombuffer(ids_of(texts[int(i)].as_py()), "<u4")
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> BpeEncoder:
    """One encoder for each worker process and vocabulary file."""
    return BpeEncoder(path)


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` behind each document's."""
    return np.insert(ids, bounds[1:], np.uint32(end_id)), bounds + np.arange(len(bounds))

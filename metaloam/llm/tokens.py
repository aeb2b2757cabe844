"""Token ids of whole texts by a public tokenizer, with each distinct piece of text between spaces encoded once.

Two kinds of tokenizer, told by what their file says of normalising and of splitting, treat the pieces apart from each
other, so the ids of a text are the joined ids of its pieces. Where that isn't certain (any other tokenizer, the
tokenizer's own special strings, rare white space) the whole text is encoded.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from collections.abc import Collection

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ODD = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
#: Texts with other than single spaces and line breaks between words.
_UNEVEN = r"[\x00-\x09\x0b-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]|^[ \n]|[ \n]$"
_CHUNK = re.compile(r"[ \t\r\n]+(?=[ \t\r\n][^ \t\r\n])|[ \t\r\n]?[^ \t\r\n]+|[ \t\r\n]+")
#: A run of Latin letters, then ASCII punctuation: two tokens' worth for both kinds of tokenizer.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-/:-@\\[-`{-~]*)")
#: Fixed values of the files: normaliser and pre-tokenizer of the kinds whose pieces are apart.
BYTE_LEVEL = (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True})
LOWER_WORDS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)
#: Pieces of text that a worker remembers, at most, besides those of one batch: some 150 bytes each.
REMEMBER = 500_000
#: Characters of texts that are numbered at once, unless one text has more: some 30 bytes are held for each.
AT_ONCE = 2_000_000
#: Workers keep one encoder for each file.
_encoders: dict[str, Encoder] = {}


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec["added_tokens"]]
        kind = (spec["normalizer"], spec["pre_tokenizer"])
        #: Whether white space belongs to the tokens; else it only parts words.
        self.spaced = kind == BYTE_LEVEL
        model = spec["model"]
        plain = model["type"] == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and not model.get("unk_token") and spec["truncation"] is None
        #: Whether pieces are encoded apart; else all texts whole.
        self.apart = plain and (self.spaced and not model.get("end_of_word_suffix") or kind == LOWER_WORDS and bool(model.get("end_of_word_suffix")))
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.signs: dict[str, list[int]] = {"": []}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        #: Byte-level tokenizers show a byte as a character: itself if printable, else the next one from 256 on.
        self.letter_of = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}
        self.space = chr(self.letter_of[32])
        self.forget()

    def _core(self, letters: str, spaced: bool) -> list[int]:
        """Ids of a run of letters, with the space before it if ``spaced``."""
        text = " " + letters if spaced else letters if self.spaced else letters.lower()
        if not letters.isascii():
            shown = text.encode().decode("latin-1").translate(self.letter_of)
        else:
            shown = self.space + letters if spaced else text
        return [t.id for t in self.tokenizer.model.tokenize(shown)]

    def _signs(self, signs: str) -> list[int]:
        got = self.signs.get(signs)
        if got is None:
            if len(self.signs) > REMEMBER // 10:
                self.signs = {"": []}
            got = self.signs[signs] = self.tokenizer.encode(signs, add_special_tokens=False).ids
        return got

    def _piece(self, key: str) -> list[int]:
        if self.spaced and key[0] in "\0\n":
            text, spaced = key.removeprefix("\0"), False
        else:
            text, spaced = key, self.spaced
        if got := _PLAIN.fullmatch(text):
            return self._core(got[1], spaced) + self._signs(got[2])
        return self.tokenizer.encode(" " + text if spaced else text, add_special_tokens=False).ids

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.begin = np.zeros(1 << 14, np.int32)
        self.length = np.zeros(1 << 14, np.int32)
        #: Whether a piece was met in a later batch than the first.
        self.again = np.zeros(1 << 14, bool)
        self.used = 0

    def _make_room(self) -> None:
        """Forget the pieces that only one batch had, and if most had several, all."""
        at = np.flatnonzero(self.again[: len(self.place)])
        if len(at) > REMEMBER // 2:
            self.forget()
            return
        keys = list(itertools.compress(self.place, self.again.tolist()))
        n = self.length[at]
        ends = np.cumsum(n, dtype=np.int64)
        flat = self.flat[np.repeat(self.begin[at] - (ends - n), n) + np.arange(n.sum())]
        self.forget()
        self._add(keys, flat, n)

    def _places(self, keys: list[str]) -> np.ndarray:
        """The numbers of pieces, which are learnt if need be."""
        if len(self.place) > REMEMBER:
            self._make_room()
        known = len(self.place)
        at = np.fromiter(map(self.place.get, keys, itertools.repeat(-1)), np.int64, len(keys))
        self.again[at[at >= 0]] = True
        missing = np.flatnonzero(at < 0)
        if len(missing):
            unknown = [keys[i] for i in missing.tolist()]
            new = dict.fromkeys(unknown)
            self._learn(new)
            # distinct keys are numbered in their order; only those of a single text may repeat
            at[missing] = np.arange(known, known + len(new)) if len(new) == len(unknown) else [self.place[k] for k in unknown]
        return at

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _pieces(self, text: str) -> list[str] | None:
        """Keys of the pieces: with a leading space left off, or marked by a zero character if taken as they are."""
        if not self.apart or "\0" in text or any(x in text for x in self.special):
            return None
        if not self.spaced:
            return None if _ODD.search(text) and not text.isascii() or re.search("[\x1c-\x1f]", text) else text.split()
        pieces = text.replace("\n", " \n").split(" ")
        if len(pieces) == len(text.split()) and "" not in pieces and "\n" not in pieces and pieces[0][0] != "\n":  # single spaces and line breaks between words only
            pieces[0] = "\0" + pieces[0]
            return pieces
        if _ODD.search(text):
            return None
        return ["\0" + x for x in _CHUNK.findall(text)]

    def _learn(self, keys: Collection[str]) -> None:
        made = [self._piece(k) for k in keys]
        lengths = np.fromiter(map(len, made), np.int32, len(made))
        self._add(keys, np.fromiter(itertools.chain.from_iterable(made), np.uint32, int(lengths.sum())), lengths)

    def _add(self, keys: Collection[str], flat: np.ndarray, lengths: np.ndarray) -> None:
        """``flat``: the ids of the keys, one after another."""
        first = len(self.place)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + len(lengths) > len(self.begin):
            self.begin, self.length, self.again = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.length, self.again))
        self.flat[self.used : self.used + len(flat)] = flat
        own = slice(first, first + len(lengths))
        self.length[own] = lengths
        self.begin[own] = self.used + np.cumsum(lengths) - lengths
        self.place.update(zip(keys, range(first, first + len(lengths)), strict=True))
        self.used += len(flat)

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of the whole text, as ``encode(text, add_special_tokens=False)`` gives them."""
        if not text:
            return np.zeros(0, np.uint32)
        pieces = self._pieces(text)
        if pieces is None:
            return self._whole(text)
        at = self._places(pieces)
        n = self.length[at]
        ends = np.cumsum(n, dtype=np.int64)
        return self.flat[np.repeat(self.begin[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """As ``encode`` for each text; pieces are split and numbered in Arrow, so each distinct one is looked up once."""
        if not self.apart:
            return [self.encode(x) for x in texts]
        out: list[np.ndarray | None] = [None] * len(texts)
        given = pa.array(texts, pa.string())
        plain = pc.and_(pc.not_equal(pc.fill_null(given, ""), ""), pc.invert(pc.fill_null(pc.match_substring_regex(given, _UNEVEN), True)))
        for x in self.special:
            plain = pc.and_(plain, pc.invert(pc.fill_null(pc.match_substring(given, x), True)))
        at_once = np.flatnonzero(plain.to_numpy(zero_copy_only=False))
        for i in set(range(len(texts))) - set(at_once.tolist()):
            out[i] = self.encode(texts[i])
        sizes = pc.fill_null(pc.utf8_length(given), 0).to_numpy(zero_copy_only=False)[at_once]
        begin = np.cumsum(sizes) - sizes
        for part in np.split(at_once, np.flatnonzero(np.diff(begin // AT_ONCE)) + 1) if len(at_once) else []:
            for i, ids in zip(part.tolist(), self._encode_plain(given.take(pa.array(part))), strict=True):
                out[i] = ids
        return out

    def _encode_plain(self, own: pa.Array) -> list[np.ndarray]:
        """Ids of texts with single spaces and line breaks between words only."""
        if self.spaced:
            own = pc.replace_substring(pc.binary_join_element_wise("\0", own, ""), "\n", " \n")
        else:
            own = pc.replace_substring(own, "\n", " ")
        pieces = pc.split_pattern(own, " ")
        coded = pieces.flatten().dictionary_encode()
        at = self._places(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
        n = self.length[at]
        ends = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        ids = self.flat[np.repeat(self.begin[at] - ends[:-1], n) + np.arange(ends[-1])]
        cuts = ends[pieces.offsets.to_numpy() - pieces.offsets[0].as_py()]
        return [ids[lo:hi] for lo, hi in itertools.pairwise(cuts.tolist())]


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]

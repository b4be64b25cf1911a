"""Encodes whole texts with a ``tokenizers`` file, remembering the ids of pieces that cannot merge with their neighbours."""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .util import BLANKS, byte_codes, kept, word_hashes, word_starts


def _byte_letters() -> dict[int, int]:
    """How byte-level vocabularies spell bytes: printable Latin-1 as itself, the others from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in plain)}


LETTERS = _byte_letters()
BLANK = chr(LETTERS[0x20])


#: White space other than blanks and line ends, and signs that a library may take for it though Python does not. Texts
#: that hold any are encoded whole.
ODD = r"[\x00\x09\x0b-\x0d\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200d}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]"
#: Below it, Python and the library's splitter agree on what a letter is, whichever Unicode version each follows.
PLAIN = "\u0250"


#: Bytes of words, and of those the ones that a full stop or comma may follow as a word of its own.
CODES = byte_codes(BLANKS, lower=False)
_STOP, _PLAIN_BYTE = np.isin(np.arange(256), [*b".,"]), np.array([k < 128 and chr(k).isalnum() for k in range(256)])
#: How a word stands in its text: at its start or after a word that it ends, after a blank, after a line end.
BARE, SPACED, LINED = range(3)
_STATES = np.array([0, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)


class Pieces:
    """ids of pieces through the library's normaliser, splitter and model.

    A run of letters is one word for either splitter, so it goes to the model at once, spelt as bytes; a final full stop
    or comma after a Latin letter or a digit is a word of its own in both. After other letters it may not be: a letter,
    U+0130 among the Latin ones, can normalise to another and a mark, and the mark joins the stop.
    """

    def __init__(self, tok, lead: bool):
        self.norm = tok.normalizer.normalize_str if tok.normalizer else None
        self.lead, self.split, self.merge = lead, tok.pre_tokenizer.pre_tokenize_str, tok.model.tokenize

    def ids(self, piece: str) -> list[int]:
        if len(piece) > 1 and piece[-1] in ".," and piece[-2] < PLAIN and piece[-2].isalnum() and piece[-2] != "\u0130":
            return self.ids(piece[:-1]) + self.ids(piece[-1])
        text = piece if not self.norm else piece.lower() if piece.isascii() and piece.isalpha() else self.norm(piece)
        letters = text[1:] if self.lead and text[:1] == " " else text
        if letters.isascii() and letters.isalpha():  # letters that bytes spell as themselves
            return [t.id for t in self.merge(text if len(letters) == len(text) else BLANK + letters)]
        if letters.isalpha() and max(letters) < PLAIN:
            return [t.id for t in self.merge(text.encode().decode("latin-1").translate(LETTERS))]
        return [t.id for s, _ in self.split(text) for t in self.merge(s)]


class Known:
    """ids by piece, in arrays: pieces are found by 64-bit hash, and told apart by their length and first bytes besides."""

    def __init__(self):
        self.keys, self.size, self.head = np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.uint64)
        self.off, self.n, self.flat = np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.uint32)

    def find(self, keys: np.ndarray, size: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, found, clash) of each of the sorted ``keys``; a clash is another piece with the same hash."""
        at = np.searchsorted(self.keys, keys)
        near = np.minimum(at, max(len(self.keys) - 1, 0))
        same = self.keys[near] == keys if len(self.keys) else np.zeros(len(keys), bool)
        as_stated = same & (self.size[near] == size) & (self.head[near] == head) if len(self.keys) else same
        return at, as_stated, same & ~as_stated

    def add(self, at: np.ndarray, keys: np.ndarray, size: np.ndarray, head: np.ndarray, ids: list[list[int]]) -> None:
        n = np.array([len(x) for x in ids], np.int64)
        off = len(self.flat) + np.cumsum(n) - n
        self.flat = np.concatenate([self.flat, np.array([i for x in ids for i in x], np.uint32)])
        self.keys, self.size, self.head, self.off, self.n = (np.insert(old, at, new) for old, new in ((self.keys, keys), (self.size, size), (self.head, head), (self.off, off), (self.n, n)))


class Encoder:
    """ids as ``Tokenizer.encode(text, add_special_tokens=False).ids`` gives them, of many texts at once.

    Both kinds of vocabulary split at white space before merging, so a text cut in front of each lone blank gives the
    ids of the whole. ``lead`` says whether the blank belongs to the word after it (byte-level) or is dropped (word
    ends), as are then runs of blanks and line ends. Texts with any other white space, those of a byte-level vocabulary
    with runs of it or with it at an end, and those that may hold a special token are encoded whole. Words are hashed,
    looked up and their ids put together in array operations; the library sees each piece once, until ``keep`` are known.
    """

    def __init__(self, path: str, lead: bool, keep: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.lead, self.keep = Tokenizer.from_file(path), lead, keep
        self.tok.no_truncation()
        self.tok.no_padding()
        special = [re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values() if t.content]
        self.odd = "|".join([ODD, *special])
        self.pieces, self.known = Pieces(self.tok, self.lead), Known()

    def _words(self, raw: np.ndarray, at: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where words begin and end, a final stop apart; how each stands; and which texts are plain."""
        inside = (CODES != 0)[raw]
        after = np.ones(len(raw), bool)  # of each byte, whether a word ends with it
        after[:-1] = ~inside[1:]
        after[at[1:][at[1:] > 0] - 1] = True
        ends = np.flatnonzero(inside & after) + 1
        last = ends - 1
        stopped = (last > starts) & _STOP[raw[last]] & _PLAIN_BYTE[raw[last - 1]] if len(ends) else np.empty(0, bool)
        state = np.full(len(starts), BARE, np.int8)
        plain = np.ones(len(at) - 1, bool)
        if self.lead:
            inner = np.zeros(len(starts), bool)
            inner[starts > 0] = ~np.isin(starts[starts > 0], at)
            state[inner] = np.where(raw[starts[inner] - 1] == 0x0A, LINED, SPACED)
            count = np.diff(np.searchsorted(starts, at))
            letters = np.diff(np.concatenate([[0], np.cumsum(ends - starts)])[np.searchsorted(starts, at)])
            plain = (count > 0) & (np.diff(at) - letters == count - 1)
        stops = last[stopped]
        ends = np.where(stopped, last, ends)
        place = np.flatnonzero(stopped) + 1
        return np.insert(starts, place, stops), np.insert(ends, place, stops + 1), np.insert(state, place, BARE), plain

    def _piece(self, word: str, state: int) -> list[int]:
        return self.pieces.ids("\n") + self.pieces.ids(word) if state == LINED else self.pieces.ids(" " + word if state == SPACED else word)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and the number of each text's. A null is empty."""
        texts = texts.fill_null("")
        raw, at, starts = word_starts(texts, CODES)
        starts, ends, state, plain = self._words(raw, at, starts)
        plain &= ~pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        with np.errstate(over="ignore"):
            keys = word_hashes(raw, starts, CODES).view(np.uint64) + _STATES[state]
        keys, first, of = np.unique(keys, return_index=True, return_inverse=True)
        size = ends[first] - starts[first]
        reach = np.arange(8)
        head = np.where(reach < size[:, None], np.append(raw, np.zeros(8, np.uint8))[starts[first][:, None] + reach], 0).astype(np.uint8).view(np.uint64).ravel()
        if len(self.known.keys) > self.keep:
            self.known = Known()
        place, found, clash = self.known.find(keys, size, head)
        new = np.flatnonzero(~found & ~clash)
        if len(new):
            said = [self._piece(raw[i:j].tobytes().decode(), s) for i, j, s in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), state[first[new]].tolist())]
            self.known.add(place[new], keys[new], size[new], head[new], said)
            place = np.searchsorted(self.known.keys, keys)
        # a piece whose hash another one has, here or among the known, is told by length and first bytes: its texts go whole
        odd = clash[of] | (ends - starts != size[of])
        rows = np.searchsorted(at, starts, "right") - 1
        plain[rows[odd]] = False
        count = np.where(plain, np.bincount(rows, minlength=len(at) - 1), 0) if len(rows) else np.zeros(len(at) - 1, np.int64)
        used = place[of[plain[rows]]] if len(rows) else np.empty(0, np.int64)
        n = self.known.n[used].astype(np.int64)
        flat = self.known.flat[np.repeat(self.known.off[used] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        upto = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(count)])]
        each = np.diff(upto)
        whole = np.flatnonzero(~plain)
        if not len(whole):
            return flat, each
        parts, low = [], 0
        for k in whole.tolist():
            parts += [flat[low : upto[k]], np.array(self.tok.encode(texts[k].as_py(), add_special_tokens=False).ids, np.uint32)]
            low, each[k] = upto[k], len(parts[-1])
        return np.concatenate([*parts, flat[low:]]), each

    def one(self, text: str) -> bytes:
        return self.ids(pa.array([text], pa.string()))[0].astype("<u4").tobytes()


def encoder(path: str, lead: bool) -> Encoder:
    """One encoder a Python worker: what earlier tasks have learnt is used again, until the worker turns to another operator."""
    return kept((Encoder, path, lead), lambda: Encoder(path, lead))

"""Token ids of whole texts by a tokenizer file, with every distinct piece of text encoded once per worker.

A byte-level BPE first splits a text into pre-tokens and merges bytes within each. A text may therefore be cut at any
place where a pre-token is certain to end, and equal pieces have equal ids. Cuts are made before white space that
follows an ASCII non-space, and between ASCII letters or digits and ASCII characters of another class. The pieces of a
slice are hashed; only pieces that the worker has not seen go through the tokenizer. Texts with the string of an added token are
pieces as a whole, so that the library's own rules for such tokens hold.

A sentencepiece model marks spaces and splits nowhere else; where no entry of it has a space after another character, texts
may be cut before every space that follows another character.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from tallyloom.llm import textbytes

DEFAULT_TOKENIZER = "byte_bpe_50k.json"
# Pieces and ids remembered by a worker; beyond it the memory starts anew.
MEMORY, MEMORY_IDS = 1_500_000, 24_000_000
SLICE = 2 << 20
# How a sentencepiece model writes a space.
SPACE_MARK = "\u2581"


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_SPACE = np.array([b == 0x20 or 0x09 <= b <= 0x0D for b in range(256)])
_LETTER = np.array([0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A for b in range(256)])
_DIGIT = np.array([0x30 <= b <= 0x39 for b in range(256)])
_MARK = np.array([0x21 <= b <= 0x7E for b in range(256)]) & ~_LETTER & ~_DIGIT
_ASCII_INK = _LETTER | _DIGIT | _MARK


def _cuts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A mark at each byte where a piece starts, every text's start included."""
    left, right = data[:-1], data[1:]
    cut = _ASCII_INK[left] & _SPACE[right]
    cut |= _LETTER[left] & (_MARK | _DIGIT)[right]
    cut |= _DIGIT[left] & (_MARK | _LETTER)[right]
    # A multi-byte letter before a space, when the space stands alone.
    cut[:-1] |= (left[:-1] >= 0x80) & _SPACE[right[:-1]] & _ASCII_INK[data[2:]]
    return _marks(cut, bounds)


def _marks(cut: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Marks at the bytes after ``cut`` and at every text's start."""
    out = np.zeros(len(cut) + 1, dtype=bool)
    out[1:] = cut
    out[bounds[:-1][np.diff(bounds) > 0]] = True
    return out


@dataclass
class Encoded:
    """Ids of consecutive texts: text i has ``ids[bounds[i]:bounds[i + 1]]``, row ``first + i``."""

    first: int
    ids: np.ndarray
    bounds: np.ndarray


def texts_with(part: textbytes.Slice, strings: list[bytes]) -> np.ndarray:
    """Numbers of the texts that hold one of the strings."""
    raw, found = part.data.tobytes() if strings else b"", set()
    for s in strings:
        at = raw.find(s)
        while at >= 0:
            i = int(np.searchsorted(part.bounds, at, side="right")) - 1
            if at + len(s) <= part.bounds[i + 1]:
                found.add(i)
                at = int(part.bounds[i + 1]) - 1  # once is enough
            at = raw.find(s, at + 1)
    return np.array(sorted(found), dtype=np.int64)


class Pieces:
    """Encodes texts by their pieces, each once."""

    def __init__(self) -> None:
        self._forget()

    def cuts(self, part: textbytes.Slice) -> np.ndarray:
        """Sorted starts of pieces, every text's start included."""
        raise NotImplementedError

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        raise NotImplementedError

    def _forget(self) -> None:
        self.known = np.zeros(0, dtype=np.uint64)  # sorted hashes of pieces
        self.entry = np.zeros(0, dtype=np.int64)  # of each, where its ids are
        self.starts = np.zeros(1, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)

    def _learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        if len(self.known) and (len(self.known) + len(hashes) > MEMORY or len(self.ids) > MEMORY_IDS):
            self._forget()
        found = self.encode_pieces(pieces)
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        flat = np.fromiter((i for ids in found for i in ids), dtype=np.uint32, count=int(sizes.sum()))
        entry = len(self.starts) - 1 + np.arange(len(found))
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, flat])
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known, kind="stable")
        self.known, self.entry = known[order], np.concatenate([self.entry, entry])[order]

    def encode(self, column: pa.Array) -> Iterator[Encoded]:
        """Yield ``Encoded`` for consecutive rows of a string column; NULL counts as an empty text."""
        for part in textbytes.slices(column, SLICE):
            yield self.encode_slice(part)

    def encode_slice(self, part: textbytes.Slice) -> Encoded:
        if not len(part.data):
            return Encoded(part.first, np.zeros(0, np.uint32), np.zeros(len(part) + 1, np.int64))
        starts = self.cuts(part)
        ends = np.append(starts[1:], len(part.data))
        distinct, first, inverse = np.unique(
            textbytes.hash_words(part.data, starts, ends), return_index=True, return_inverse=True
        )
        at = self._find(distinct)
        if (new := np.flatnonzero(at < 0)).size:
            s, e = starts[first[new]], ends[first[new]]
            raw = part.data.tobytes()
            before = len(self.known)
            self._learn(distinct[new], [raw[a:b] for a, b in zip(s.tolist(), e.tolist())])
            if len(self.known) < before + len(new):  # it has forgotten the others
                old = np.flatnonzero(at >= 0)
                s, e = starts[first[old]], ends[first[old]]
                self._learn(distinct[old], [raw[a:b] for a, b in zip(s.tolist(), e.tolist())])
            at = self._find(distinct)
        at = at[inverse]
        low, sizes = self.starts[at], self.starts[at + 1] - self.starts[at]
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(low - total[:-1], sizes) + np.arange(total[-1])]
        return Encoded(part.first, ids, total[np.searchsorted(starts, part.bounds)])

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, self.entry[at], -1)


class Encoder(Pieces):
    """Texts by a tokenizers file; one per worker, file and treatment of added tokens.

    ``added``: strings of added tokens in texts become these tokens, as by the library's default; else they are plain text.
    """

    _made: dict[tuple[str, bool], Encoder] = {}

    @classmethod
    def of(cls, path: str, added: bool = True) -> Encoder:
        if (path, added) not in cls._made:
            cls._made[path, added] = cls(path, added)
        return cls._made[path, added]

    def __init__(self, path: str, added: bool = True) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        special = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content.encode() for t in special if added or not t.special]
        # One run of letters, a space before it or not, is one pre-token of a byte-level BPE.
        steps = str(self.tokenizer.pre_tokenizer)
        self.plain = (
            steps.startswith("ByteLevel(add_prefix_space=False")
            and "use_regex=True" in steps
            and self.tokenizer.normalizer is None
        )
        keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in keep]
        self.letters = {b: chr(b) for b in keep} | {b: chr(256 + k) for k, b in enumerate(rest)}

    def cuts(self, part: textbytes.Slice) -> np.ndarray:
        marks = _cuts(part.data, part.bounds)
        for i in texts_with(part, self.added).tolist():
            marks[part.bounds[i] + 1 : part.bounds[i + 1]] = False
        return np.flatnonzero(marks)

    def vocabulary(self) -> list[bytes]:
        """The bytes of each id's entry, decoded from byte-level letters; entries outside these are taken as they are."""
        byte = {c: b for b, c in self.letters.items()}
        entries = (self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size()))
        return [bytes(byte[c] for c in e) if all(c in byte for c in e) else e.encode() for e in entries]

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        out: list = [None] * len(pieces)
        other = []
        model = self.tokenizer.model
        for k, raw in enumerate(pieces):
            text = raw.decode()
            if self.plain and text.removeprefix(" ").isalpha():
                out[k] = [t.id for t in model.tokenize(raw.decode("latin-1").translate(self.letters))]
            else:
                other.append((k, text))
        if other:
            found = self.tokenizer.encode_batch([t for _, t in other], add_special_tokens=False)
            for (k, _), e in zip(other, found):
                out[k] = e.ids
        return out


class SpacedPieces(Pieces):
    """Texts by a sentencepiece model that puts a space before each text; texts are given with this space.

    One per worker and file.
    """

    _made: dict[str, SpacedPieces] = {}

    @classmethod
    def of(cls, path: str) -> SpacedPieces:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str) -> None:
        super().__init__()
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        entries = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.space = self.model.piece_to_id(SPACE_MARK)
        # Trailing spaces must be kept, and no entry may reach over a cut.
        self.cuttable = self.model.encode("a ")[-1:] == [self.space] and not any(SPACE_MARK in e.lstrip(SPACE_MARK) for e in entries)

    def cuts(self, part: textbytes.Slice) -> np.ndarray:
        if not self.cuttable:
            return part.bounds[:-1][np.diff(part.bounds) > 0]
        return np.flatnonzero(_marks((part.data[1:] == 0x20) & (part.data[:-1] != 0x20), part.bounds))

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        # The model adds the first space itself, but to nothing else it adds nothing.
        rests = [raw.decode()[1:] for raw in pieces]
        return [ids if rest else [self.space] for rest, ids in zip(rests, self.model.encode(rests, num_threads=1))]

    def vocabulary(self) -> list[bytes]:
        """The bytes of each id's piece: marks are spaces, byte pieces are their byte."""
        entries = [(i, self.model.id_to_piece(i)) for i in range(self.model.vocab_size())]
        return [bytes([int(e[3:-1], 16)]) if self.model.is_byte(i) else e.replace(SPACE_MARK, " ").encode() for i, e in entries]

"""Token ids of many texts by a public tokenizer of the ``tokenizers`` library, each distinct piece encoded once.

The tokenizers meant here lower-case, drop white space, and cut what stands between it into runs of letters, single
digits, runs of marks and a few English endings with an apostrophe; pieces are then encoded one by one. Texts of printable
ASCII and Latin-1 letters are cut here, a batch at a time over its bytes, and only pieces that the worker has not met go
through the tokenizer's model, all in one call. Texts with any other character, or with what may be a special token, go
through the whole tokenizer.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

#: Characters that every library classes and lower-cases alike, one to one.
_PLAIN = re.compile("[\t-\r -~À-ÖØ-öø-ÿ]*").fullmatch
_SPACE, _LETTER, _MARK, _DIGIT = range(4)
_APOSTROPHE = ord("'")
#: Endings that stay with their apostrophe.
_SHORT, _LONG = b"stmd", (b"re", b"ve", b"ll")


def _classes() -> np.ndarray:
    kinds = np.full(256, _MARK, np.uint8)
    for byte in range(256):
        character = chr(byte)
        if character.isspace():
            kinds[byte] = _SPACE
        elif character.isalpha():
            kinds[byte] = _LETTER
        elif character.isdigit() and byte < 128:
            kinds[byte] = _DIGIT
    return kinds


_KINDS = _classes()


def _alphabet() -> dict[int, str]:
    """The characters by which a byte-level tokenizer shows bytes, as far as they differ from Latin-1."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {byte: chr(256 + at) for at, byte in enumerate(byte for byte in range(256) if byte not in shown)}


_ALPHABET = _alphabet()


def starts_of_pieces(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a piece starts at each byte of lower-case Latin-1 text, and whether the byte belongs to one."""
    kinds = _KINDS[data]
    inside = kinds != _SPACE
    starts = inside & (kinds == _DIGIT)
    starts[:1] |= inside[:1]
    starts[1:] |= inside[1:] & (kinds[1:] != kinds[:-1])
    marks = np.flatnonzero(starts & (data == _APOSTROPHE))
    if len(marks):
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        first, second = padded[marks + 1], padded[marks + 2]
        size = np.where(np.isin(first, np.frombuffer(_SHORT, np.uint8)), 1, 0)
        for one, two in _LONG:
            size[(first == one) & (second == two)] = 2
        marks, size = marks[size > 0], size[size > 0]
        starts[marks + 1] = False
        after = marks + 1 + size
        after = after[after < len(data)]
        starts[after] |= inside[after]
    return starts, inside


def gathered(found: list[bytes], which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of ``found[i]`` for every ``i`` of ``which`` in a row, and how many each contributes."""
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
    ids, bases = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes
    counts = sizes[which]
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total) + np.repeat(bases[which] - (ends - counts), counts)
    return ids[at], counts


_kept: dict[tuple, TokenIds] = {}


class TokenIds(dict):
    """Piece (lower-case Latin-1 bytes) -> its ids as little-endian unsigned 32-bit integers.

    ``most`` bounds the pieces that are kept; beyond it the table starts anew.
    """

    def __init__(self, path: str, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks of an executor share its cores already
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        super().__init__()
        self.most = most
        self.tokenizer = Tokenizer.from_file(path)
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = WhitespaceSplit()
        self.vocabulary = self.tokenizer.get_vocab_size()
        tokens = map(self.tokenizer.id_to_token, range(self.vocabulary))
        self.ends_piece = np.array([token.endswith("</w>") for token in tokens])

    @classmethod
    def of_worker(cls, path: str, most: int = 500_000) -> TokenIds:
        """The table of this worker process, which later tasks go on with."""
        if (path, most) not in _kept:
            _kept[path, most] = cls(path, most)
        return _kept[path, most]

    def encoded(self, texts: list[str]) -> list[bytes]:
        """Ids of every text by the whole tokenizer."""
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(one.ids, "<u4").tobytes() for one in found]

    def _learn(self, pieces: list[bytes]) -> None:
        """One call of the model; the last token of every piece says that it ends one."""
        pieces = [piece for piece in pieces if piece.isascii()] + [piece for piece in pieces if not piece.isascii()]
        texts = [piece.decode("latin-1") for piece in pieces]
        shown = [text if text.isascii() else text.encode().decode("latin-1").translate(_ALPHABET) for text in texts]
        ids = np.array(self.model.encode_batch_fast([" ".join(shown)], add_special_tokens=False)[0].ids, "<u4")
        ends = (4 * (np.flatnonzero(self.ends_piece[ids]) + 1)).tolist()
        if len(ends) != len(pieces):
            raise ValueError("the tokenizer does not encode piece by piece")
        data = ids.tobytes()
        self.update(zip(pieces, map(data.__getitem__, map(slice, [0, *ends], ends)), strict=False))

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "\n".join(texts).lower().encode("latin-1")
        data = np.frombuffer(joined, np.uint8)
        starts, inside = starts_of_pieces(data)
        # white space left out, the pieces stand one after the other
        at = np.append(np.flatnonzero(starts[inside]), np.count_nonzero(inside)).astype(np.int32)
        buffers = [None, pa.py_buffer(at), pa.py_buffer(data[inside])]
        coded = pa.Array.from_buffers(pa.binary(), len(at) - 1, buffers).dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        new = [piece for piece in pieces if piece not in self]
        if new:
            if len(self) + len(new) > self.most:
                self.clear()
                new = pieces
            self._learn(new)
        ids, counts = gathered(list(map(self.__getitem__, pieces)), coded.indices.to_numpy())
        ends_of_texts = np.cumsum([len(text) + 1 for text in texts])
        last = np.searchsorted(np.flatnonzero(starts), ends_of_texts)
        return ids, np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], last])]

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's ids begin and the last ones end."""
        plain = [_PLAIN(text) is not None and "<|" not in text for text in texts]
        if all(plain):
            return self._plain(texts) if texts else (np.zeros(0, "<u4"), np.zeros(1, np.int64))
        common = [text for text, one in zip(texts, plain, strict=True) if one]
        ids, ends = self._plain(common) if common else (np.zeros(0, "<u4"), np.zeros(1, np.int64))
        others = iter(self.encoded([text for text, one in zip(texts, plain, strict=True) if not one]))
        commons = iter(np.split(ids, ends[1:-1]))
        found = [next(commons) if one else np.frombuffer(next(others), "<u4") for one in plain]
        return np.concatenate(found), np.cumsum([0, *map(len, found)])

"""Quality rules, lines first: rules per line remove lines, then documents that lose too much are rejected.

Words are ``[^\\x20\\x09-\\x0D]+``. A line is judged by itself: navigation (separators between short items), boilerplate
(notices of sites, in short lines), symbols (a symbol on many of its words) and punctuation (a line of some length
without any sentence mark at all). What fails is removed; a document is rejected if too large a share of its words goes,
if symbols fill it, or if it fails the base rules: fewer than ten words, or more than a fifth of its words in five-word
windows that occur twice. Very short lines, such as headings, are not judged by punctuation.

Defined cases: a null text has no words and is rejected like an empty one; its text stays null. Whole texts are read,
whatever their length, and repeated rows are judged one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tillstone.llm.arrow import Held, WordHashes, steps, texts_of, window_hashes

SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOLS = bytes(b for b in range(256) if b not in SYMBOLS)
#: UTF-8 bytes that continue a character.
_CONTINUED = bytes(range(0x80, 0xC0))
_SEPARATOR = re.compile(rb"(?:\||\xc2\xbb|\xe2\x80\xba|\xe2\x80\xa2| > | / )")
_SENTENCE_MARK = re.compile(rb"[.!?:;\"')\]]|\xe2\x80[\x9c-\x9f\xa6]|\xe3\x80\x82|\xef\xbc[\x81\x9f]")

# Phrases of notices that sites put around their texts.
NOTICES = [
    "accept all cookies", "cookie policy", "privacy policy", "terms of use", "terms of service", "sign up for our newsletter",
    "subscribe to our newsletter", "enable javascript", "javascript is disabled", "click here to", "back to top",
    "skip to content", "share on facebook", "share on twitter", "follow us on", "log in to", "read more", "page not found",
    "lorem ipsum", "powered by wordpress",
]
_NOTICE = re.compile("|".join(map(re.escape, NOTICES)).encode())


@dataclass(frozen=True)
class QualityRules:
    """Limits of the method's rules; those of the base rules are fixed by ``base_failed``."""

    notice_words: int = 12
    separators: int = 2
    words_per_separator: float = 4.0
    symbol_share: float = 0.3
    unmarked_words: int = 30
    most_lost: float = 0.5

    def line_fails(self, line: bytes, words: int) -> bool:
        if not words:
            return False
        separators = len(_SEPARATOR.findall(line))
        if separators >= self.separators and words <= self.words_per_separator * (separators + 1):
            return True
        if words <= self.notice_words and _NOTICE.search(line.lower()):
            return True
        symbols = len(line.translate(None, _NOT_SYMBOLS))
        if symbols >= 3 and symbols > self.symbol_share * words:
            return True
        return words >= self.unmarked_words and not _SENTENCE_MARK.search(line)

    def cleaned(self, text: bytes, n_words: int) -> tuple[bytes, int]:
        """The text without its failing lines, and the number of words lost."""
        lines = text.split(b"\n")
        sizes = [len(line.split()) for line in lines]
        stays = [not self.line_fails(line, size) for line, size in zip(lines, sizes, strict=True)]
        lost = n_words - sum(size for size, good in zip(sizes, stays, strict=True) if good)
        return (b"\n".join(line for line, good in zip(lines, stays, strict=True) if good), lost) if lost else (text, 0)


def word_chars(words: list[bytes]) -> int:
    return len(b"".join(words).translate(None, _CONTINUED))


def repeated_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.split()]
    return len(lines) - len(set(lines))


def repeated_words(hashes: np.ndarray) -> int:
    """Words that lie in a window of five words that is found twice or more."""
    if len(hashes) < 6:
        return 0
    windows = window_hashes(hashes, 5)
    _, place, count = np.unique(windows, return_inverse=True, return_counts=True)
    starts = count[place] > 1
    if not starts.any():
        return 0
    covered = np.zeros(len(hashes) + 1, np.int64)
    covered[:-5][starts[: len(hashes) - 4]] += 1
    covered[5:][: len(starts)][starts] -= 1
    return int(np.count_nonzero(np.cumsum(covered)[: len(hashes)]))


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


MEASURES = "n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,n_lost_words:bigint,base_failed:boolean,kept:boolean"


def _judge(rules: QualityRules, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in steps(batches):
            rows, texts = [], []
            for one in texts_of(batch, text):
                words = (one or b"").split()
                repeats = repeated_words(hashes.of(words))
                left, lost = rules.cleaned(one or b"", len(words))
                failed = base_failed(len(words), repeats)
                kept = not failed and lost <= rules.most_lost * len(words)
                symbols = len((one or b"").translate(None, _NOT_SYMBOLS))
                lines = repeated_lines(one or b"")
                rows.append((len(words), word_chars(words), symbols, lines, repeats, lost, failed, kept))
                texts.append(None if one is None else left)
            columns = {name: batch.column(name) for name in batch.schema.names}
            columns[text] = pa.array(texts, pa.binary()).cast(pa.string())
            names = [part.split(":") for part in MEASURES.split(",")]
            for at, (name, kind) in enumerate(names):
                columns[name] = pa.array([row[at] for row in rows], pa.int64() if kind == "bigint" else pa.bool_())
            yield pa.RecordBatch.from_pydict(columns)

    return run


def judged(documents: DataFrame, rules: QualityRules = QualityRules()) -> tuple[Held, DataFrame]:
    """The held columns with the cleaned text, and the measures of the text as it was."""
    held = Held(documents)
    return held, held.table.mapInArrow(_judge(rules, held["text"]), schema=held.schema(MEASURES))

import zlib
from collections import defaultdict

import cases
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tillstone.llm import packing

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def check(rows, pieces, window=2048):
    """Every id in exactly one piece, sequences gapless and within the window; returns the padding."""
    ids = [TOKENIZER.encode(text or "", add_special_tokens=False).ids + [1] for _, text in rows]
    wanted = sorted((doc is None, doc or 0, len(one)) for (doc, _), one in zip(rows, ids, strict=True))
    starts = [p for p in pieces if p["start"] == 0]
    assert sorted((p["doc_id"] is None, p["doc_id"] or 0, p["doc_tokens"]) for p in starts) == wanted
    by_doc = defaultdict(list)
    for (doc, _), one in zip(rows, ids, strict=True):
        by_doc[doc].append(one)
    covered = defaultdict(int)
    for p in pieces:
        crcs = [zlib.crc32(np.array(one[p["start"] : p["start"] + p["length"]], "<u4").tobytes()) for one in by_doc[p["doc_id"]]]
        assert p["ids_crc32"] in crcs
        covered[p["doc_id"]] += p["length"]
    assert covered == {doc: sum(map(len, found)) for doc, found in by_doc.items()}
    ends = defaultdict(int)
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == ends[p["sequence_id"]]
        ends[p["sequence_id"]] += p["length"]
    assert all(0 < size <= window for size in ends.values())
    assert sorted(ends) == list(range(len(ends)))
    return sum(0 if size & (size - 1) == 0 else window - size for size in ends.values())


def test_odd_documents(spark, tables):
    assert check(cases.documents(), packing.packed(cases.frame(spark), tables).collect()) == 0


def test_many_short_documents(spark, tables):
    rows = [(doc, cases.prose(doc, 5 + doc * 37 % 400)) for doc in range(150)] + [(1000 + doc, "same text") for doc in range(200)]
    assert check(rows, packing.packed(cases.frame(spark, rows).repartition(5), tables).collect()) == 0


def test_empty_table(spark, tables):
    assert packing.packed(cases.no_rows(spark), tables).count() == 0


def test_least_squares_fills_windows():
    source = np.random.default_rng(1)
    histogram = np.zeros(65, np.int64)
    for length in source.integers(1, 65, 20_000):
        histogram[length] += 1
    combos = packing.combinations(np.flatnonzero(histogram), 64, 3)
    assert (combos.sum(axis=1) == 64).all()
    assert len({tuple(row) for row in combos.tolist()}) == len(combos)
    counts = packing.solved(combos, histogram, 150)
    assert (counts >= 0).all()
    whole = packing.rounded(combos, counts, histogram)
    used = np.bincount(combos.ravel(), np.repeat(whole, 3), 65)
    used[0] = 0
    assert (used <= histogram).all()
    assert used.sum() >= 0.8 * histogram.sum()

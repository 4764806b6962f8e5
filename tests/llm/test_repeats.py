import random

import cases
import numpy as np

from tillstone.llm import repeats
from tillstone.llm.repeats import Chunking


def planted(copies):
    rows = []
    for passage in range(60):
        text = cases.prose(10_000 + passage, 51)
        for copy in range(copies):
            number = passage * copies + copy
            rows.append((number, f"{cases.prose(number, 70)} {text} {cases.prose(number + 5000, 70)}"))
    return rows


def test_passages_of_51_words_go_and_clean_documents_stay(spark, tables):
    rows = planted(3) + [(1000 + doc, cases.prose(70_000 + doc, 200)) for doc in range(100)]
    found = {row["doc_id"]: row for row in repeats.repeats_report(cases.frame(spark, rows), tables).collect()}
    assert len(found) == len(rows)
    for passage in range(60):
        group = [found[passage * 3 + copy] for copy in range(3)]
        assert sum(row["repeated"] for row in group) == 2
        first = next(row["doc_id"] for row in group if not row["repeated"])
        assert all(first in row["kept_in"] for row in group if row["repeated"])
    texts = dict(rows)
    assert all(row["text"] == texts[doc] and not row["repeated"] for doc, row in found.items() if doc >= 1000)
    assert all(row["n_removed"] == len(texts[doc]) - len(row["text"]) for doc, row in found.items())


def test_odd_documents(spark, tables):
    table = cases.frame(spark)
    held, cut = repeats.without_repeats(table, tables)
    rows = held.restored(cut)
    assert rows.columns == table.columns
    left = [row["text"] for row in rows.collect()]
    assert len(left) == len(cases.documents())
    assert sum(text is None for text in left) == 2
    whole = cases.prose(1, 120)
    assert left.count(whole) == 1 and "" in left


def common(seed, words):
    """Prose over few common words: nearly every short chunk stood somewhere before."""
    source = random.Random(seed)
    return " ".join(source.choices("the of and to in is that it was for on are with as his they be at one have".split(), k=words))


def test_chunks_of_common_words_are_no_evidence_for_a_run(spark, tables):
    passage = common(1, 51)
    rows = [(doc, common(100 + doc, 300)) for doc in range(400)]
    rows += [(1000 + copy, f"{common(600 + copy, 70)} {passage} {common(700 + copy, 70)}") for copy in range(2)]
    found = {row["doc_id"]: row for row in repeats.repeats_report(cases.frame(spark, rows), tables).collect()}
    texts = dict(rows)
    assert all(found[doc]["text"] == texts[doc] and not found[doc]["repeated"] for doc in range(400))
    cut = [row for doc, row in found.items() if doc >= 1000 and row["repeated"]]
    assert len(cut) == 1 and cut[0]["n_spans"] == 1 and cut[0]["n_removed"] > len(passage) / 2


def test_a_chunk_goes_if_its_run_stood_before(spark, tables):
    options, gears, source = Chunking(), Chunking().gears(), random.Random(4)
    parts = [common(2000 + part, source.randint(8, 40)) for part in range(30)]
    rows = [(doc, " ".join(source.choices(parts, k=6))) for doc in range(40)]
    found = repeats.repeats_report(cases.frame(spark, rows).coalesce(1), tables).collect()
    before = set()
    for row in found:
        text = dict(rows)[row["doc_id"]].encode()
        ends, sizes = repeats.chunk_ends(text, options, gears)
        chunks, gone, runs = repeats.digests(text, ends).tolist(), set(), []
        for i in range(len(chunks)):
            for j in range(i, len(chunks)):
                if sizes[i : j + 1].sum() >= options.least_words:
                    runs.append(tuple(chunks[i : j + 1]))
                    if runs[-1] in before:
                        gone.update(range(i, j + 1))
                    before.add(runs[-1])
        bounds = [0, *ends.tolist()]
        left = b"".join(text[bounds[i] : bounds[i + 1]] for i in range(len(chunks)) if i not in gone)
        assert row["text"] == left.decode() and row["n_chunks"] == len(chunks)


def test_empty_table(spark, tables):
    assert repeats.repeats_report(cases.no_rows(spark), tables).count() == 0


def test_gear_hash_is_the_rolling_hash():
    data = np.frombuffer(cases.prose(1, 50).encode(), np.uint8)
    gears, rolled, h = Chunking().gears(), [], 0
    for byte in data:
        h = ((h << 1) + int(gears[byte])) & 0xFFFF
        rolled.append(h)
    assert repeats.gear_hashes(data, gears).tolist() == rolled


def test_cuts_fall_into_step_after_an_insertion():
    options = Chunking()
    gears, source = options.gears(), random.Random(2)
    words = cases.prose(3, 400).split()
    for _ in range(20):
        place = source.randrange(1, 399)
        a, b = (" ".join(part).encode() for part in (words, [*words[:place], "new", *words[place:]]))
        one = set(repeats.digests(a, repeats.chunk_ends(a, options, gears)[0]).tolist())
        other = set(repeats.digests(b, repeats.chunk_ends(b, options, gears)[0]).tolist())
        assert len(one - other) <= 6


def test_chunks_cover_the_text():
    options = Chunking()
    for text in [text.encode() for _, text in cases.documents() if text]:
        ends, sizes = repeats.chunk_ends(text, options, options.gears())
        assert ends[-1] == len(text) and (np.diff(ends, prepend=0) > 0).all() and sizes.max() <= options.most_words

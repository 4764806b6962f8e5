import random

import cases
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tillstone.llm.token_ids import TokenIds

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)
ODD = ["Σας ΟΔΟΣ İstanbul ﬁ é", "don't I'll 'S a.b! (c) x) -- ...", "it's WE'LL we'LL'd 'sabc 'rest ''s !'s 3's a'", "a<|endoftext|>b"]


def check(table, texts):
    ids, ends = table.ids(texts)
    found = [ids[start:end].tolist() for start, end in zip(ends, ends[1:], strict=False)]
    assert found == [one.ids for one in TOKENIZER.encode_batch_fast(texts, add_special_tokens=False)]


@pytest.mark.parametrize("most", [50, 500_000])
def test_odd_texts(most):
    table = TokenIds(PATH, most)
    texts = [text for _, text in cases.documents() if text] + ODD
    for _ in range(2):
        check(table, [*texts, "", *map(str.upper, texts)])
        for text in texts:
            check(table, [text])
    check(table, [])
    check(table, ["", ""])


@pytest.mark.parametrize("alphabet", ["ab'stredvmlé0 9!.\nÀß'''  ", "ab'std ÷×µ’漢<|>\x85\xa0\x1c\x00É"])
def test_texts_of_random_characters(alphabet):
    source, table = random.Random(1), TokenIds(PATH)
    check(table, ["".join(source.choices(alphabet, k=source.randint(0, 60))) for _ in range(8000)])


def test_every_character_alone_and_in_words():
    table = TokenIds(PATH)
    check(table, [f"{chr(code)} x{chr(code)}x {chr(code)}{chr(code)}" for code in range(0x250)])
    assert np.isin(table.ids(["a b c"])[0], range(table.vocabulary)).all()

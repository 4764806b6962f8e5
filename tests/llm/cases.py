"""Documents with everything that may be wrong with them, and plain Python counterparts."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Names that operators use inside, some of them in other cases.
EXTRA = "row string, digest string, SIZE string, kept string, words string, label string, C0 string, n_words string"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def prose(seed, words):
    source = random.Random(seed)
    return " ".join("".join(source.choices("abcdefghijklmnop", k=source.randint(2, 8))) for _ in range(words))


def documents():
    base = prose(1, 120).split()
    near = [" ".join(base[:place] + ["edit"] + base[place + 1 :]) for place in (3, 40, 77, 118)]
    return [
        (1, " ".join(base)),
        (2, " ".join(base)),
        (2, " ".join(base)),
        (3, near[0]),
        (4, near[1].upper()),
        (5, near[2]),
        (None, near[3]),
        (6, None),
        (None, None),
        (7, ""),
        (7, ""),
        (8, " \t\n "),
        (9, "one two three"),
        (10, "ONE two\nthree"),
        (11, prose(2, 30_000)),
        (12, "é" * 5000 + " 漢字かな交じり文 " * 40),
        (13, prose(3, 60) + " " + prose(4, 60)),
        (14, prose(5, 60) + " " + prose(4, 60) + " " + prose(6, 60)),
        (15, "\x00odd\x1cbytes\x85and lines\xa0here \U0001f600 <|endoftext|> it's 3.14"),
    ]


def frame(spark, rows=None, extra=True):
    rows = documents() if rows is None else rows
    if not extra:
        return spark.createDataFrame(rows, "doc_id bigint, text string")
    wide = [(doc, text, None, "src", len(text or ""), *[f"x{i}"] * 8) for i, (doc, text) in enumerate(rows)]
    return spark.createDataFrame(wide, f"doc_id bigint, text string, lang string, source string, n_chars bigint, {EXTRA}")


def no_rows(spark):
    return frame(spark, [])

"""Signature rules of licenses, as patterns over words that are lower-cased and separated by one space."""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

#: Classes, best first. A detection is given up if one of its class or a better one covers it.
TAG, VERSIONED, NAMED, MENTIONED = range(4)


@dataclass(frozen=True)
class Signature:
    label: str
    rank: int
    keyword: str
    pattern: str
    score: float
    base: bool = False


# Phrases and labels of the base scan.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

# Licenses with versions: label, full names, short names, versions.
VERSIONS = [
    ("gpl", ["general public license"], ["gpl"], ["1.0", "2.0", "3.0"]),
    ("lgpl", ["lesser general public license", "library general public license"], ["lgpl"], ["2.0", "2.1", "3.0"]),
    ("agpl", ["affero general public license"], ["agpl"], ["1.0", "3.0"]),
    ("gfdl", ["free documentation license"], ["gfdl"], ["1.1", "1.2", "1.3"]),
    ("apache", ["apache license", "apache software license"], ["apache"], ["1.0", "1.1", "2.0"]),
    ("mpl", ["mozilla public license"], ["mpl"], ["1.0", "1.1", "2.0"]),
    ("epl", ["eclipse public license"], ["epl"], ["1.0", "2.0"]),
    ("eupl", ["european union public licence"], ["eupl"], ["1.0", "1.1", "1.2"]),
    ("cddl", ["common development and distribution license"], ["cddl"], ["1.0", "1.1"]),
    ("cpl", ["common public license"], [], ["1.0"]),
    ("osl", ["open software license"], [], ["1.0", "1.1", "2.0", "2.1", "3.0"]),
    ("afl", ["academic free license"], [], ["1.1", "1.2", "2.0", "2.1", "3.0"]),
    ("cecill", ["cecill license"], ["cecill"], ["1.0", "1.1", "2.0", "2.1"]),
    ("ofl", ["open font license"], [], ["1.0", "1.1"]),
    ("artistic", ["artistic license"], [], ["1.0", "2.0"]),
    ("bsl", ["boost software license"], [], ["1.0"]),
    ("lppl", ["latex project public license"], ["lppl"], ["1.0", "1.1", "1.2", "1.3"]),
    ("php", ["php license"], [], ["3.0", "3.01"]),
    ("zpl", ["zope public license"], [], ["1.1", "2.0", "2.1"]),
    ("apsl", ["apple public source license"], [], ["1.0", "1.1", "1.2", "2.0"]),
    ("odbl", ["open database license"], ["odbl"], ["1.0"]),
    ("odc-by", ["open data commons attribution license"], [], ["1.0"]),
    ("rpl", ["reciprocal public license"], [], ["1.1", "1.5"]),
    ("ecl", ["educational community license"], [], ["1.0", "2.0"]),
    ("upl", ["universal permissive license"], [], ["1.0"]),
    ("npl", ["netscape public license"], [], ["1.0", "1.1"]),
    ("qpl", ["q public license"], [], ["1.0"]),
    ("python", ["python license", "python software foundation license"], [], ["2.0"]),
]

# Licenses without versions: label, patterns.
NAMES = [
    ("mit", ["mit license", "mit licence", "expat license"]),
    ("mit", ["permission is hereby granted free of charge to any person obtaining a copy"]),
    ("isc", ["isc license", "permission to use copy modify and or distribute this software for any purpose"]),
    ("bsd", ["bsd license", "bsd licence", "bsd style license"]),
    ("bsd-2-clause", ["bsd 2 clause", "2 clause bsd", "simplified bsd license", "freebsd license"]),
    ("bsd-3-clause", ["bsd 3 clause", "3 clause bsd", "new bsd license", "modified bsd license", "revised bsd license"]),
    ("bsd-4-clause", ["bsd 4 clause", "4 clause bsd", "original bsd license"]),
    ("bsd", ["redistribution and use in source and binary forms with or without modification"]),
    ("zlib", ["zlib license", "zlib libpng license"]),
    ("unlicense", ["the unlicense", "this is free and unencumbered software released into the public domain"]),
    ("wtfpl", ["do what the fuck you want to public license"]),
    ("public-domain", ["released into the public domain", "dedicated to the public domain", "in the public domain"]),
    ("cc0", ["cc0 1 0", "cc0", "creative commons zero"]),
    ("ncsa", ["university of illinois ncsa open source license"]),
    ("postgresql", ["postgresql license"]),
    ("ms-pl", ["microsoft public license"]),
    ("ms-rl", ["microsoft reciprocal license"]),
    ("openssl", ["openssl license"]),
    ("vim", ["vim license"]),
    ("ruby", ["ruby license"]),
    ("w3c", ["w3c software notice and license", "w3c license"]),
    ("pddl", ["open data commons public domain dedication and license"]),
    ("cc", ["creative commons license", "creative commons licence", "creative commons attribution"]),
    ("proprietary", ["unauthorized copying of this file", "proprietary and confidential copyright"]),
    ("copyright", ["copyright c (?:19|20)[0-9]{2}", "copyright (?:19|20)[0-9]{2}"]),
    ("licensed", ["licensed under", "released under the [^ ]+ license", "under the terms of the [^ ]+ license"]),
]

# SPDX identifiers of licenses without versions: label, words of the identifier (MIT-0 is another license).
TAGS = [
    ("mit", "mit(?! 0 )"), ("isc", "isc"), ("bsd-2-clause", "bsd 2 clause"), ("bsd-3-clause", "bsd 3 clause"),
    ("bsd-4-clause", "bsd 4 clause"), ("zlib", "zlib"), ("unlicense", "unlicense"), ("wtfpl", "wtfpl"), ("cc0", "cc0 1 0"),
    ("ncsa", "ncsa"), ("postgresql", "postgresql"), ("ms-pl", "ms pl"), ("ms-rl", "ms rl"), ("openssl", "openssl"),
    ("vim", "vim"), ("ruby", "ruby"), ("w3c", "w3c"), ("pddl", "pddl 1 0"),
]

CC_TERMS = {"by": "attribution", "sa": "sharealike", "nc": "noncommercial", "nd": "noderivatives"}
CC_KINDS = ["by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"]
CC_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]

LATER = "(?: (?:or|and) (?:at your option )?(?:any )?later(?: version)?)?"

#: Every keyword that a rule may name; a text without any of them has no detection.
KEYWORDS = [
    "licen", "gpl", "gfdl", "apache", "mpl", "epl", "eupl", "cddl", "cecill", "lppl", "odbl", "cc by", "cc0",
    "creative commons", "public domain", "reserved", "spdx", "bsd", "copyright", "confidential", "permission",
    "redistribution", "unauthorized",
]


def whole_words(pattern: str) -> str:
    return f"(?<= )(?:{pattern})(?= )"


def version_words(version: str) -> str:
    """The words of a version; a final zero may be missing."""
    major, minor = version.split(".")
    return f"{major}(?: 0)?" if minor == "0" else f"{major} {minor}"


def keyword_of(pattern: str) -> str:
    """The first keyword that every match of the pattern contains."""
    plain = re.sub(r"\(\?:.*", "", pattern) if "(?:" in pattern else pattern
    return next(word for word in KEYWORDS if word in plain or word in pattern and word == "licen")


def versioned() -> list[Signature]:
    rules = []
    for label, full, short, versions in VERSIONS:
        for version in versions:
            words, name = version_words(version), f"{label}-{version}"
            for text in full:
                rules.append((name, VERSIONED, text, f"{text}(?: v| version| ver)? ?v?{words}{LATER}", 1.0))
            for text in short:
                rules.append((name, VERSIONED, text, f"{text}(?: v| version)? ?v?{words}{LATER}", 0.9))
            tag = version.replace(".", " ")
            rules.append((name, TAG, "spdx", f"spdx license identifier {label} {tag}(?: only| or later)?", 1.0))
        rules += [(label, NAMED, text, text, 0.8) for text in full]
        rules += [(label, NAMED, text, text, 0.4) for text in short if text != "apache"]
    return [Signature(label, rank, keyword_of(key), whole_words(pattern), score) for label, rank, key, pattern, score in rules]


def creative_commons() -> list[Signature]:
    rules = []
    for kind, version in itertools.product(CC_KINDS, CC_VERSIONS):
        label, words = f"cc-{kind.replace(' ', '-')}-{version}", version_words(version)
        long = " ".join(CC_TERMS[part] for part in kind.split())
        rules.append((label, TAG, "spdx", f"spdx license identifier cc {kind} {version.replace('.', ' ')}", 1.0))
        rules.append((label, VERSIONED, "cc by", f"cc {kind} {words}", 1.0))
        rules.append((label, VERSIONED, "licen", f"creativecommons org licenses {kind} {words}", 1.0))
        rules.append((label, VERSIONED, "creative commons", f"creative commons {long}(?: license)? {words}", 1.0))
    for kind in CC_KINDS:
        long = " ".join(CC_TERMS[part] for part in kind.split())
        rules.append((f"cc-{kind.replace(' ', '-')}", NAMED, "cc by", f"cc {kind}", 0.8))
        rules.append((f"cc-{kind.replace(' ', '-')}", NAMED, "creative commons", f"creative commons {long}", 0.8))
    return [Signature(label, rank, key, whole_words(pattern), score) for label, rank, key, pattern, score in rules]


def named() -> list[Signature]:
    mentions = ("copyright", "licensed", "cc", "proprietary")
    rules = [Signature(label, TAG, "spdx", whole_words(f"spdx license identifier {tag}"), 1.0) for label, tag in TAGS]
    for label, patterns in NAMES:
        rank, score = (MENTIONED, 0.5) if label in mentions else (NAMED, 0.9)
        rules += [Signature(label, rank, keyword_of(text), whole_words(text), score) for text in patterns]
    return rules


def signatures() -> list[Signature]:
    """All rules, in the order in which ties are settled; the base phrases first."""
    base = [Signature(label, MENTIONED, keyword_of(text), whole_words(text), 0.6, True) for text, label in BASE]
    return base + versioned() + creative_commons() + named()

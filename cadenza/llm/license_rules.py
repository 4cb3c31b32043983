"""The rules of the license scan: patterns over lower-case words with one space between.

A pattern begins with one of a few plain words, its keywords, and has no repetition, so
its spaces bound the words that it can take. A text whose words hold none of GATES and
are none of SHORT_GATES can't match a rule.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

#: Priorities: a grant or an identifier says what holds; a name may only be mentioned; a text is evidence; base phrases come last.
IDENTIFIER, GRANT, NAME, TEXT, BASE = 90, 80, 60, 50, 10
#: How sure a detection of each priority is.
STRENGTH = {IDENTIFIER: 1.0, GRANT: 0.95, NAME: 0.7, TEXT: 0.6, BASE: 0.5}

#: Phrases that count whatever else a text holds, with their labels.
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

_V = r"(?: version)? v?"
_GNU = r"(?:gnu )?"

#: Names of licenses: label, pattern.
NAMES = [
    ("mit", r"mit(?: x11)? license"),
    ("mit", r"expat license"),
    ("mit-0", r"mit no attribution(?: license)?"),
    ("x11", r"x11(?: style)? license"),
    ("apache", r"apache(?: software)?(?: foundation)? license"),
    ("bsd", r"bsd(?: style)? license"),
    ("bsd-2-clause", r"bsd 2 clause(?: license)?"),
    ("bsd-2-clause", r"simplified bsd(?: license)?"),
    ("bsd-2-clause", r"freebsd license"),
    ("bsd-3-clause", r"bsd 3 clause(?: license)?"),
    ("bsd-3-clause", r"new bsd license"),
    ("bsd-3-clause", r"modified bsd license"),
    ("bsd-4-clause", r"bsd 4 clause(?: license)?"),
    ("bsd-4-clause", r"original bsd license"),
    ("0bsd", r"zero clause bsd(?: license)?"),
    ("isc", r"isc license"),
    ("zlib", r"zlib(?: libpng)? license"),
    ("bsl-1.0", r"boost software license" + rf"(?:{_V}1 0)?"),
    ("mpl", r"mozilla public license"),
    ("epl", r"eclipse public license"),
    ("eupl", r"european union public license"),
    ("cddl", r"common development and distribution license"),
    ("cpl", r"common public license"),
    ("artistic", r"artistic license"),
    ("gpl", rf"{_GNU}general public license"),
    ("gpl", r"gnu gpl"),
    ("gpl", r"gpl"),
    ("lgpl", rf"{_GNU}lesser general public license"),
    ("lgpl", rf"{_GNU}library general public license"),
    ("lgpl", r"gnu lgpl"),
    ("lgpl", r"lgpl"),
    ("agpl", rf"{_GNU}affero general public license"),
    ("agpl", r"gnu agpl"),
    ("agpl", r"agpl"),
    ("gfdl", rf"{_GNU}free documentation license"),
    ("unlicense", r"unlicense"),
    ("wtfpl", r"do what the fuck you want to public license"),
    ("wtfpl", r"wtfpl(?: license)?"),
    ("odbl-1.0", r"open database license"),
    ("odc-by-1.0", r"open data commons attribution license"),
    ("pddl-1.0", r"public domain dedication and license"),
    ("ofl-1.1", r"sil open font license" + rf"(?:{_V}1 1)?"),
    ("ms-pl", r"microsoft public license"),
    ("ms-rl", r"microsoft reciprocal license"),
    ("afl-3.0", r"academic free license" + rf"(?:{_V}3 0)?"),
    ("osl-3.0", r"open software license" + rf"(?:{_V}3 0)?"),
    ("ncsa", r"university of illinois ncsa open source license"),
    ("postgresql", r"postgresql license"),
    ("psf-2.0", r"python software foundation license" + rf"(?:{_V}2(?: 0)?)?"),
    ("php-3.01", r"php license" + rf"(?:{_V}3 01)?"),
    ("ruby", r"ruby license"),
    ("openssl", r"openssl license"),
    ("vim", r"vim license"),
    ("w3c", r"w3c software(?: notice and)? license"),
    ("unicode", r"unicode license(?: agreement)?"),
    ("sleepycat", r"sleepycat license"),
    ("mulanpsl-2.0", r"mulan psl v2"),
    ("ecl-2.0", r"educational community license" + rf"(?:{_V}2 0)?"),
    ("upl-1.0", r"universal permissive license" + rf"(?:{_V}1 0)?"),
    ("blueoak-1.0.0", r"blue oak model license" + rf"(?:{_V}1 0 0)?"),
    ("busl-1.1", r"business source license" + rf"(?:{_V}1 1)?"),
    ("sspl-1.0", r"server side public license" + rf"(?:{_V}1(?: 0)?)?"),
    ("elastic-2.0", r"elastic license" + rf"(?:{_V}2 0)?"),
    ("openrail", r"(?:open )?rail(?: m)? license"),
    ("cc0-1.0", r"cc0" + rf"(?:{_V}1 0)?(?: universal)?"),
    ("cc0-1.0", r"creative commons zero" + rf"(?:{_V}1 0)?"),
    ("cc", r"creative commons license"),
]

#: Families with versions: label, pattern of the name, versions.
VERSIONED = [
    ("apache", r"apache(?: software)?(?: foundation)?(?: license)?", ("1.0", "1.1", "2.0")),
    ("mpl", r"(?:mozilla public license|mpl)", ("1.0", "1.1", "2.0")),
    ("epl", r"(?:eclipse public license|epl)", ("1.0", "2.0")),
    ("eupl", r"(?:european union public license|eupl)", ("1.1", "1.2")),
    ("cddl", r"(?:common development and distribution license|cddl)", ("1.0", "1.1")),
    ("artistic", r"artistic license", ("1.0", "2.0")),
    ("gpl", rf"{_GNU}(?:general public license|gpl)", ("1.0", "2.0", "3.0")),
    ("lgpl", rf"{_GNU}(?:(?:lesser|library) general public license|lgpl)", ("2.0", "2.1", "3.0")),
    ("agpl", rf"{_GNU}(?:affero general public license|agpl)", ("1.0", "3.0")),
    ("gfdl", rf"{_GNU}(?:free documentation license|gfdl)", ("1.1", "1.2", "1.3")),
]
LATER = r"(?: or(?: at your option)?(?: any)? later(?: version)?| and later)"

#: Creative Commons: the short and the long form of each condition.
CC_LONG = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?(?: works)?"}
CC_KINDS = ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

#: What stands before a name where a license is granted, or where a field names it.
GRANT_WORDS = r"(?:licensed|released|distributed|available|published) under(?: the)?(?: terms(?: and conditions)? of)?(?: the| a)? "
FIELD_WORDS = r"(?:spdx license identifier|license) "

#: Words of licenses themselves, and statements about rights.
TEXTS = [
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose"),
    ("hpnd", r"permission to use copy modify and distribute this software and its documentation"),
    ("bsd", r"redistribution and use in source and binary forms"),
    ("bsd-3-clause", r"neither the name of(?: the)? copyright holder nor the names of its contributors"),
    ("bsd-4-clause", r"redistributions of any form whatsoever must retain"),
    ("gpl", r"this program is free software you can redistribute it and or modify"),
    ("lgpl", r"this library is free software you can redistribute it and or modify"),
    ("zlib", r"altered source versions must be plainly marked as such"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("apache-2.0", r"licenses this file to you under the apache license"),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license"),
    ("public-domain", r"dedicated to the public domain"),
    ("public-domain", r"released into the public domain"),
    ("public-domain", r"placed in(?:to)? the public domain"),
    ("warranty-disclaimer", r"provided as is without warranty of any kind"),
    ("warranty-disclaimer", r"without warranties or conditions of any kind"),
    ("warranty-disclaimer", r"without even the implied warranty of merchantability"),
    ("all-rights-reserved", r"all rights reserved"),
    ("proprietary", r"proprietary and confidential"),
    ("proprietary", r"unauthorized copying of this file"),
    ("no-derivatives", r"may not be reproduced without(?: prior)?(?: written)? permission"),
    ("copyright", r"copyright c(?: (?:19|20)[0-9][0-9])?"),
    ("copyright", r"copyright(?: (?:19|20)[0-9][0-9])"),
]

#: Parts of words, or whole short words, one of which every match holds.
GATES = ("licen", "gpl", "gfdl", "copyright", "domain", "permission", "redistribut", "warrant", "reserved", "proprietary", "unauthorized", "altered", "commons", "apache", "wtfpl", "mulan", "attribution")
SHORT_GATES = ("mpl", "epl", "eupl", "cddl", "bsd", "cc", "cc0")


def _group_end(pattern: str) -> int:
    """The place after the group with which a pattern begins."""
    depth = 0
    for at, c in enumerate(pattern):
        depth += (c == "(") - (c == ")")
        if not depth:
            return at + 1
    raise ValueError(pattern)


def _choices(group: str) -> list[str]:
    """The alternatives of a group, without its brackets."""
    out, depth = [""], 0
    for c in group[3:-1]:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def first_words(pattern: str) -> set[str]:
    """The words with which a match can begin."""
    if not pattern.startswith("(?:"):
        return {re.match("[a-z0-9]+", pattern)[0]}
    end = _group_end(pattern)
    rest = first_words(pattern[end + 1 :]) if pattern[end : end + 1] == "?" else set()
    return rest.union(*map(first_words, _choices(pattern[:end])))


@dataclass(frozen=True)
class Rule:
    number: int
    label: str
    priority: int
    pattern: str

    @property
    def need(self) -> str:
        """The longest plain word outside of all groups: every match holds it."""
        flat = self.pattern
        while (less := re.sub(r"\([^()]*\)\??", " ", flat)) != flat:
            flat = less
        return max((w for w in flat.split() if re.fullmatch("[a-z0-9]+", w)), key=len, default="")

    @property
    def span(self) -> int:
        """Words that a match has at most."""
        return self.pattern.count(" ") + 1


def _version(version: str) -> str:
    major, minor = version.split(".")
    return rf"{_V}{major}" + (r"(?: 0)?" if minor == "0" else rf" {minor}")


def _named() -> list[tuple[str, str]]:
    """Labels and patterns of all names, those with a version too."""
    out = list(NAMES)
    for label, name, versions in VERSIONED:
        for version in versions:
            out.append((f"{label}-{version}", name + _version(version)))
            if label.endswith("gpl"):
                out.append((f"{label}-{version}-or-later", name + _version(version) + LATER))
    for kind in CC_KINDS:
        parts = kind.split("-")
        name = f"(?:cc {' '.join(parts)}|creative commons {' '.join(CC_LONG[p] for p in parts)}(?: international)?)"
        out.append((f"cc-{kind}", name))
        out += [(f"cc-{kind}-{v}", name + _version(v)) for v in CC_VERSIONS]
    return out


@cache
def rules() -> tuple[Rule, ...]:
    """All rules in their order: base phrases, then each name with what may stand before it, then texts."""
    found: list[tuple[str, int, str]] = [(label, BASE, phrase) for phrase, label in BASE_PHRASES]
    for label, name in _named():
        found += [(label, GRANT, GRANT_WORDS + name), (label, IDENTIFIER, FIELD_WORDS + name), (label, NAME, name)]
    found += [("mit", GRANT, "licensed under(?: the)? mit"), ("mit", IDENTIFIER, FIELD_WORDS + "mit")]
    found += [(label, TEXT, text) for label, text in TEXTS]
    return tuple(Rule(number, *rule) for number, rule in enumerate(found))


def longest() -> int:
    """Words that any match has at most."""
    return max(rule.span for rule in rules())

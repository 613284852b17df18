"""License scans: ordered signature rules behind a keyword prefilter.

Texts are reduced to lower-case words joined by single spaces.  A text without any
keyword is done; otherwise each rule whose own keywords occur runs its regular
expression.  Keywords are read off the expressions, so that no match is without one.
Detections are taken by priority, then length, then place; one that lies inside the
interval of a detection already taken is suppressed, so "gnu lesser general public
license" does not also report the general one, nor a title inside a notice.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import re
from dataclasses import dataclass
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import bounded_batches
from ._words import words_of

#: The phrases whose places are counted, and the labels that stand for them.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Label | names as normalised words (regular expressions) | SPDX identifier as normalised words.
FAMILIES = """
mit | mit(?: expat)? | mit
mit-0 | mit(?: 0| no attribution) | mit 0
apache-1 | apache(?: software)? 1(?: [01])? | apache 1(?: [01])?
apache-2 | apache(?: software)? 2(?: 0)? | apache 2 0
bsd-2 | (?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd) | bsd 2 clause
bsd-3 | (?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd) | bsd 3 clause
bsd-4 | (?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd) | bsd 4 clause
bsd-0 | (?:zero clause bsd|bsd zero clause|0bsd) | 0bsd
gpl-1 | (?:gnu )?(?:gpl|general public)(?: v ?| )1(?: 0)? | gpl 1 0(?: only| or later)?
gpl-2 | (?:gnu )?(?:gpl|general public)(?: v ?| ?v| )2(?: 0)? | gpl 2 0(?: only| or later)?
gpl-3 | (?:gnu )?(?:gpl|general public)(?: v ?| ?v| )3(?: 0)? | gpl 3 0(?: only| or later)?
lgpl-2 | (?:gnu )?(?:lgpl|library general public)(?: v ?| ?v| )2(?: 0)? | lgpl 2 0(?: only| or later)?
lgpl-2.1 | (?:gnu )?(?:lgpl|lesser general public)(?: v ?| ?v| )2 1 | lgpl 2 1(?: only| or later)?
lgpl-3 | (?:gnu )?(?:lgpl|lesser general public)(?: v ?| ?v| )3(?: 0)? | lgpl 3 0(?: only| or later)?
agpl-3 | (?:gnu )?(?:agpl|affero general public)(?: v ?| ?v| )3(?: 0)? | agpl 3 0(?: only| or later)?
gfdl-1 | (?:gnu )?(?:gfdl|free documentation)(?: v ?| )1(?: [123])? | gfdl 1 [123](?: only| or later)?
mpl-1 | (?:mozilla public|mpl) 1(?: [01])? | mpl 1 [01]
mpl-2 | (?:mozilla public|mpl) 2(?: 0)? | mpl 2 0
epl-1 | (?:eclipse public|epl) 1(?: 0)? | epl 1 0
epl-2 | (?:eclipse public|epl) 2(?: 0)? | epl 2 0
cddl-1 | (?:common development and distribution|cddl) 1(?: [01])? | cddl 1 [01]
cpl-1 | common public 1(?: 0)? | cpl 1 0
eupl-1 | (?:european union public|eupl) 1(?: [12])? | eupl 1 [12]
artistic-1 | artistic 1(?: 0)? | artistic 1 0
artistic-2 | artistic 2(?: 0)? | artistic 2 0
bsl-1 | (?:boost software|bsl) 1(?: 0)? | bsl 1 0
busl-1.1 | (?:business source|busl) 1 1 | busl 1 1
zlib | zlib(?: libpng)? | zlib
isc | isc | isc
unlicense | unlicen[cs]e | unlicense
wtfpl | (?:wtfpl|do what the fuck you want to public) | wtfpl
psf-2 | (?:python software foundation|psf) (?:license )?2(?: 0)? | psf 2 0
openssl | openssl | openssl
php-3 | php 3(?: 01?)? | php 3 01?
postgresql | postgresql | postgresql
ofl-1 | (?:sil )?open font 1(?: [01])? | ofl 1 [01]
odbl-1 | (?:open (?:data commons open )?database|odbl) 1(?: 0)? | odbl 1 0
odc-by-1 | (?:open data commons attribution|odc by) 1(?: 0)? | odc by 1 0
pddl-1 | (?:public domain dedication and license|pddl) 1(?: 0)? | pddl 1 0
elastic-2 | elastic 2(?: 0)? | elastic 2 0
sspl-1 | (?:server side public|sspl) 1(?: 0)? | sspl 1 0
ms-pl | microsoft public | ms pl
ms-rl | microsoft reciprocal | ms rl
cc0 | (?:cc0|creative commons zero|cc zero)(?: 1 0)? | cc0 1 0
cc-by | (?:cc|creative commons) (?:by|attribution)(?: [1234] [05])?(?: international| unported| generic)? | cc by [1234] [05]
cc-by-sa | (?:cc|creative commons) (?:by sa|attribution share ?alike)(?: [1234] [05])?(?: international| unported| generic)? | cc by sa [1234] [05]
cc-by-nd | (?:cc|creative commons) (?:by nd|attribution no ?deriv(?:ative)?s?)(?: [1234] [05])?(?: international| unported| generic)? | cc by nd [1234] [05]
cc-by-nc | (?:cc|creative commons) (?:by nc|attribution non ?commercial)(?: [1234] [05])?(?: international| unported| generic)? | cc by nc [1234] [05]
cc-by-nc-sa | (?:cc|creative commons) (?:by nc sa|attribution non ?commercial share ?alike)(?: [1234] [05])?(?: international| unported| generic)? | cc by nc sa [1234] [05]
cc-by-nc-nd | (?:cc|creative commons) (?:by nc nd|attribution non ?commercial no ?deriv(?:ative)?s?)(?: [1234] [05])?(?: international| unported| generic)? | cc by nc nd [1234] [05]
"""

# Priority | score | the form, in which {name} and {spdx} stand for the family's.
FORMS = """
100 | 1.0 | spdx license identifier {spdx}
95 | 1.0 | (?:licen[cs]ed|released|distributed|available|provided|published|shared|covered|made available) (?:to you )?under (?:the )?(?:terms of the )?{name}
90 | 0.95 | (?:under|subject to|in accordance with|according to) (?:the )?(?:terms(?: and conditions)? of the )?{name}
85 | 0.95 | (?:this )?(?:work|program|software|file|project|library|text|document|dataset|content) is (?:licen[cs]ed )?(?:under|covered by) (?:the |a )?{name}
70 | 0.9 | {name}
60 | 0.8 | licen[cs]e(?: type| name)? (?:is )?(?:the )?{name}
"""

# Notices that stand by themselves; label | priority | score | pattern.
NOTICES = """
mit | 98 | 1.0 | permission is hereby granted free of charge to any person obtaining a copy of this software
isc | 98 | 1.0 | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
bsd | 97 | 0.9 | redistribution and use in source and binary forms with or without modification are permitted
gpl | 97 | 0.9 | this (?:program|library) is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e
lgpl | 98 | 0.9 | this (?:program|library) is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e
agpl | 98 | 0.9 | this (?:program|library) is free software you can redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e
gpl | 50 | 0.7 | gnu general public licen[cs]e
lgpl | 51 | 0.7 | gnu (?:lesser|library) general public licen[cs]e
agpl | 51 | 0.7 | gnu affero general public licen[cs]e
apache | 40 | 0.6 | apache(?: software)? licen[cs]e
bsd | 40 | 0.6 | bsd(?: style)? licen[cs]e
mpl | 40 | 0.6 | mozilla public licen[cs]e
creative-commons | 30 | 0.5 | creative commons licen[cs]e
public-domain | 60 | 0.8 | (?:placed in|released into|dedicated to|is in) the public domain
unlicense | 98 | 1.0 | this is free and unencumbered software released into the public domain
proprietary | 60 | 0.7 | all rights reserved(?: (?:unauthorized|no part of))?
proprietary | 70 | 0.8 | (?:proprietary and confidential|unauthorized copying of this file)
zlib | 98 | 1.0 | this software is provided as is without any express or implied warranty in no event will the authors be held liable
mit | 90 | 0.8 | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | 45 | 0.5 | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
apache-2 | 98 | 1.0 | licensed under the apache licen[cs]e version 2 0 the license you may not use this file except in compliance with the license
apache-2 | 60 | 0.7 | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
bsd-3 | 97 | 0.9 | nor the names of its contributors may be used to endorse or promote products derived from this software
bsd-4 | 98 | 1.0 | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd | 45 | 0.5 | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
gpl | 96 | 0.9 | you should have received a copy of the gnu general public licen[cs]e along with this (?:program|library|file)
lgpl | 97 | 0.9 | you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e along with this (?:program|library|file)
agpl | 97 | 0.9 | you should have received a copy of the gnu affero general public licen[cs]e along with this (?:program|library|file)
gfdl | 98 | 0.9 | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e
mpl-2 | 98 | 1.0 | this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0
mpl-1 | 98 | 0.9 | the contents of this file are subject to the mozilla public licen[cs]e version 1 1
epl | 98 | 0.9 | this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e
cddl-1 | 98 | 0.9 | the contents of this file are subject to the terms of the common development and distribution licen[cs]e
eupl-1 | 97 | 0.9 | licensed under the eupl version 1 [12]
artistic | 97 | 0.9 | under the terms of (?:either the gnu general public licen[cs]e or )?the artistic licen[cs]e
bsl-1 | 98 | 1.0 | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[cs]e
wtfpl | 98 | 1.0 | everyone is permitted to copy and distribute verbatim or modified copies of this licen[cs]e document and changing it is allowed as long as the name is changed
zlib | 90 | 0.8 | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
openssl | 98 | 1.0 | this product includes software developed by the openssl project for use in the openssl toolkit
php-3 | 98 | 1.0 | this product includes php software freely available from
psf-2 | 98 | 1.0 | psf is making python available to licensee on an as is basis
cc0 | 98 | 0.9 | waived all copyright and related or neighbou?ring rights
ofl-1 | 97 | 0.9 | this font software is licensed under the sil open font licen[cs]e
json | 98 | 1.0 | the software shall be used for good not evil
beerware | 98 | 1.0 | if we meet some day and you think this stuff is worth it you can buy me a beer in return
unlicense | 90 | 0.9 | anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary
elastic-2 | 97 | 0.9 | you may not provide the software to third parties as a hosted or managed service
busl-1.1 | 97 | 0.9 | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
"""


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    score: float
    pattern: re.Pattern[bytes]
    keywords: tuple[bytes, ...]


def _versioned(name: str) -> str:
    """A name whose version, if it has one, may follow "license", "version" or both."""
    m = re.match(r"(.*?)((?:\(\?: v \?\| \?v\| \)|\(\?: v \?\| \)| )\d(?: \d)?(?:\(\?: [^)]*\)\??)?)$", name)
    if not m:
        return f"{name}(?: (?:public )?licen[cs]e)"
    version = re.sub(r"^(?:\(\?:[^)]*\)| )", "", m[2])
    return f"{m[1]}(?: licen[cs]e)?(?: version| v)? ?v?{version}(?: licen[cs]e)?"


#: Strings that one set of alternatives holds at most; beyond it a part of the pattern is not followed.
MAX_STRINGS = 64


def _exact(part) -> set[str] | None:
    """All strings that a parsed part of a pattern matches; None where that is not known."""
    strings = {""}
    for op, value in part:
        name = str(op)
        if name == "LITERAL":
            more = {chr(value)}
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in value):
            more = {chr(v) for _, v in value}
        elif name == "SUBPATTERN":
            more = _exact(value[3])
        elif name == "BRANCH":
            each = [_exact(x) for x in value[1]]
            more = None if None in each else set().union(*each)
        elif name == "MAX_REPEAT" and value[:2] == (0, 1):
            more = _exact(value[2])
            more = None if more is None else more | {""}
        else:
            more = None
        if more is None or len(strings) * len(more) > MAX_STRINGS:
            return None
        strings = {x + y for x, y in itertools.product(strings, more)}
    return strings


@functools.lru_cache(maxsize=None)
def keywords_of(pattern: str) -> tuple[bytes, ...]:
    """Few strings of which every match of ``pattern``, with the spaces around it, holds one."""
    part = list(_parser.parse(f" {pattern} "))
    best: tuple[tuple, tuple[str, ...]] | None = None
    for a in range(len(part)):
        for b in range(a + 1, len(part) + 1):
            strings = _exact(part[a:b])
            if strings is None:
                break
            least = tuple(sorted(x for x in strings if not any(y != x and y in x for y in strings)))
            letters = min(sum(map(str.isalpha, x)) for x in least)  # of rare strings
            rank = (min(letters, 4), -len(least), min(map(len, least)))
            if letters and (best is None or rank > best[0]):
                best = rank, least
    if best is None:
        raise ValueError(f"no keyword in {pattern!r}")
    return tuple(x.encode() for x in best[1])


def build_rules() -> list[Rule]:
    """The ordered rules: each family in each form, then the notices; highest priority first."""
    rules = []
    for line in FAMILIES.strip().splitlines():
        label, name, spdx = (x.strip() for x in line.split(" | "))
        full = f"{name}(?: licen[cs]e)?" if label.startswith("cc") or label in ("unlicense", "wtfpl") else _versioned(name)
        for form in FORMS.strip().splitlines():
            priority, score, text = (x.strip() for x in form.split(" | "))
            pattern = text.replace("{name}", full).replace("{spdx}", spdx)
            keys = keywords_of(full if "{name}" in text else text.replace(" {spdx}", ""))  # both stand between spaces
            rules.append(Rule(label, int(priority), float(score), re.compile(f"(?<= )(?:{pattern})(?= )".encode()), keys))
    for line in NOTICES.strip().splitlines():
        label, priority, score, pattern = (x.strip() for x in line.split(" | "))
        rules.append(Rule(label, int(priority), float(score), re.compile(f"(?<= )(?:{pattern})(?= )".encode()), keywords_of(pattern)))
    return sorted(rules, key=lambda r: -r.priority)


class LicenseScanner:
    def __init__(self):
        self.rules = build_rules()
        self.base = [(b" " + k.encode() + b" ", v) for k, v in BASE.items()]
        self.keywords = sorted({k for r in self.rules for k in r.keywords})
        #: A text without any of these holds no keyword.
        self.prefilter = [k for k in self.keywords if not any(o != k and o in k for o in self.keywords)]

    def base_places(self, joined: bytes) -> list[tuple[int, str]]:
        """(offset, label) of every base phrase."""
        found = []
        for phrase, label in self.base:
            at = joined.find(phrase)
            while at >= 0:
                found.append((at, label))
                at = joined.find(phrase, at + 1)
        return found

    def detections(self, joined: bytes) -> list[tuple[int, int, Rule]]:
        """Detections that stay after suppression, in order of priority."""
        if not any(k in joined for k in self.prefilter):
            return []
        present = {k for k in self.keywords if k in joined}
        found = []
        for rule in self.rules:
            if not present.isdisjoint(rule.keywords):
                found += [(m.start(), m.end(), rule) for m in rule.pattern.finditer(joined)]
        found.sort(key=lambda d: (-d[2].priority, d[0] - d[1], d[0], d[2].label))
        kept: list[tuple[int, int, Rule]] = []
        starts: list[int] = []  # of kept ranges that no other kept one contains, ascending, as their ends are
        ends: list[int] = []
        for a, b, rule in found:
            at = bisect.bisect_right(starts, a)
            if at and ends[at - 1] >= b:
                continue
            kept.append((a, b, rule))
            inside = slice(bisect.bisect_left(starts, a), bisect.bisect_right(ends, b))
            starts[inside], ends[inside] = [a], [b]
        return kept

    def scan(self, text: str | None) -> dict:
        words = words_of(text)
        joined = b" " + b" ".join(words) + b" "
        base = self.base_places(joined)
        kept = self.detections(joined)
        spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20) if base or kept else np.zeros(0, np.int64)
        starts = (np.searchsorted(spaces, [at for at, _ in base], "right") - 1).tolist()
        begin, end = (np.searchsorted(spaces, [d[k] for d in kept]).tolist() for k in (0, 1))
        labels = {label for _, label in base}
        return {
            "n_words": len(words),
            "n_base": len(base),
            "first_word": min(starts, default=None),
            "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted(labels)),
            "labels": ",".join(sorted(labels | {r.label for _, _, r in kept})),
            "score": 1.0 if base else max((r.score for _, _, r in kept), default=0.0),
            "detections": [
                {"label": r.label, "priority": r.priority, "start": a - 1, "end": b} for a, b, (_, _, r) in zip(begin, end, kept)
            ],
        }


SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "detections array<struct<label:string,priority:int,start:int,end:int>>"
)
_ARROW = {
    "n_words": pa.int64(),
    "n_base": pa.int64(),
    "first_word": pa.int64(),
    "last_word": pa.int64(),
    "base_labels": pa.string(),
    "labels": pa.string(),
    "score": pa.float64(),
    "detections": pa.list_(pa.struct([("label", pa.string()), ("priority", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])),
}


def scan_licenses(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row: id, the columns of ``SCHEMA``; detections hold word ranges [start, end).

    Null and empty texts have no words, empty labels, null positions and score 0.  Texts
    are read whole; base places may overlap and all count.  Repeated rows give repeated
    results; rows without an identifier are scanned too; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    id_type = docs.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()

    def run(batches):
        scanner = LicenseScanner()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                rows = [scanner.scan(t) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *[pa.array([r[k] for r in rows], t) for k, t in _ARROW.items()]], names=["id", *_ARROW]
                )

    return (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, {SCHEMA}").withColumnRenamed("id", id_col)
    )

"""License scans: ordered signature rules behind a keyword prefilter; priority and containment settle overlaps."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from ferrywork.llm.common import map_batches

#: Base phrases, as words that stand consecutively, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Label | keyword | name as it is written | address. One line is one license; each gives one rule a form. A
# space in a pattern is any run of white space; keywords are looked for with single spaces and cc-by for cc by.
LICENSES = r"""
agpl-3.0 | affero | (?:gnu )?affero general public license | gnu\.org/licenses/agpl
gpl-2.0 | general public license | (?:gnu )?general public license,? (?:version|v) ?2 | gnu\.org/licenses/old-licenses/gpl-2
gpl-3.0 | general public license | (?:gnu )?general public license,? (?:version|v) ?3 | gnu\.org/licenses/gpl-3
gpl | general public license | gnu general public license | gnu\.org/licenses/gpl
lgpl-2.1 | lesser general | (?:gnu )?lesser general public license,? (?:version|v) ?2(?:\.1)? | gnu\.org/licenses/old-licenses/lgpl
lgpl-3.0 | lesser general | (?:gnu )?lesser general public license,? (?:version|v) ?3 | gnu\.org/licenses/lgpl-3
lgpl | lesser general | (?:gnu )?lesser general public license | gnu\.org/licenses/lgpl
lgpl-2.0 | library general | (?:gnu )?library general public license | gnu\.org/licenses/old-licenses/lgpl-2\.0
gfdl | free documentation | (?:gnu )?free documentation license | gnu\.org/licenses/fdl
apache-2.0 | apache | apache license,? (?:version|v) ?2(?:\.0)? | apache\.org/licenses/license-2\.0
apache-1.1 | apache | apache (?:software )?license,? (?:version|v) ?1\.1 | apache\.org/licenses/license-1\.1
apache-1.0 | apache | apache (?:software )?license,? (?:version|v) ?1\.0 | apache\.org/licenses/license-1\.0
apache | apache | apache (?:software )?license | apache\.org/licenses
mit | mit | mit(?: style| expat)? licen[sc]e | opensource\.org/licenses/mit
mit-0 | mit | mit no attribution | opensource\.org/licenses/mit-0
bsd-2-clause | bsd | (?:simplified bsd|bsd 2[- ]clause|2[- ]clause bsd)(?: licen[sc]e)? | opensource\.org/licenses/bsd-2-clause
bsd-3-clause | bsd | (?:(?:new|modified) bsd|bsd 3[- ]clause|3[- ]clause bsd)(?: licen[sc]e)? | opensource\.org/licenses/bsd-3-clause
bsd-4-clause | bsd | (?:original bsd|bsd 4[- ]clause|4[- ]clause bsd)(?: licen[sc]e)? | spdx\.org/licenses/bsd-4-clause
0bsd | bsd | (?:zero[- ]clause bsd|bsd zero clause)(?: licen[sc]e)? | opensource\.org/licenses/0bsd
bsd | bsd | bsd(?:[- ]style)? licen[sc]e | opensource\.org/licenses/bsd
isc | isc | isc licen[sc]e | opensource\.org/licenses/isc
mpl-1.1 | mozilla | mozilla public license,? (?:version|v) ?1\.1 | mozilla\.org/mpl/1\.1
mpl-2.0 | mozilla | mozilla public license,? (?:version|v) ?2(?:\.0)? | mozilla\.org/mpl/2\.0
mpl | mozilla | mozilla public license | mozilla\.org/mpl
epl-1.0 | eclipse | eclipse public license,? (?:version|v) ?1(?:\.0)? | eclipse\.org/legal/epl-v10
epl-2.0 | eclipse | eclipse public license,? (?:version|v) ?2(?:\.0)? | eclipse\.org/legal/epl-2\.0
edl-1.0 | eclipse | eclipse distribution license | eclipse\.org/org/documents/edl-v10
cddl-1.0 | distribution license | common development and distribution license | opensource\.org/licenses/cddl
cpl-1.0 | common public | common public license | opensource\.org/licenses/cpl
ipl-1.0 | ibm public | ibm public license | opensource\.org/licenses/ibmpl
artistic-1.0 | artistic | artistic license,? (?:version|v) ?1(?:\.0)? | opensource\.org/licenses/artistic-license-1
artistic-2.0 | artistic | artistic license,? (?:version|v)? ?2(?:\.0)? | opensource\.org/licenses/artistic-license-2
artistic | artistic | (?:perl )?artistic license | perlfoundation\.org/artistic
bsl-1.0 | boost | boost software license | boost\.org/license_1_0
busl-1.1 | business source | business source license | mariadb\.com/bsl
zlib | zlib | zlib(?:/libpng)? licen[sc]e | zlib\.net/zlib_license
libpng | libpng | libpng licen[sc]e | libpng\.org/pub/png/src/libpng-license
unlicense | unlicense | the unlicense | unlicense\.org
wtfpl | what the fuck | do what the fuck you want to public license | wtfpl\.net
cc0-1.0 | cc0 | cc0(?: 1\.0)?(?: universal)? | creativecommons\.org/publicdomain/zero
public-domain | public domain | (?:released|placed|dedicated) (?:in)?to the public domain | creativecommons\.org/publicdomain/mark
cc-by-1.0 | cc-by | cc[- ]by[- ]1\.0 | creativecommons\.org/licenses/by/1\.0
cc-by-2.0 | cc-by | cc[- ]by[- ]2\.0 | creativecommons\.org/licenses/by/2\.0
cc-by-2.5 | cc-by | cc[- ]by[- ]2\.5 | creativecommons\.org/licenses/by/2\.5
cc-by-3.0 | cc-by | cc[- ]by[- ]3\.0 | creativecommons\.org/licenses/by/3\.0
cc-by-4.0 | cc-by | cc[- ]by[- ]4\.0 | creativecommons\.org/licenses/by/4\.0
cc-by-sa-2.0 | cc-by | cc[- ]by[- ]sa[- ]2\.0 | creativecommons\.org/licenses/by-sa/2\.0
cc-by-sa-3.0 | cc-by | cc[- ]by[- ]sa[- ]3\.0 | creativecommons\.org/licenses/by-sa/3\.0
cc-by-sa-4.0 | cc-by | cc[- ]by[- ]sa[- ]4\.0 | creativecommons\.org/licenses/by-sa/4\.0
cc-by-sa | cc-by | cc[- ]by[- ]sa | creativecommons\.org/licenses/by-sa
cc-by-nc-2.0 | cc-by | cc[- ]by[- ]nc[- ]2\.0 | creativecommons\.org/licenses/by-nc/2\.0
cc-by-nc-3.0 | cc-by | cc[- ]by[- ]nc[- ]3\.0 | creativecommons\.org/licenses/by-nc/3\.0
cc-by-nc-4.0 | cc-by | cc[- ]by[- ]nc[- ]4\.0 | creativecommons\.org/licenses/by-nc/4\.0
cc-by-nc | cc-by | cc[- ]by[- ]nc | creativecommons\.org/licenses/by-nc
cc-by-nd-4.0 | cc-by | cc[- ]by[- ]nd[- ]4\.0 | creativecommons\.org/licenses/by-nd/4\.0
cc-by-nd | cc-by | cc[- ]by[- ]nd | creativecommons\.org/licenses/by-nd
cc-by-nc-sa-4.0 | cc-by | cc[- ]by[- ]nc[- ]sa[- ]4\.0 | creativecommons\.org/licenses/by-nc-sa/4\.0
cc-by-nc-sa | cc-by | cc[- ]by[- ]nc[- ]sa | creativecommons\.org/licenses/by-nc-sa
cc-by-nc-nd-4.0 | cc-by | cc[- ]by[- ]nc[- ]nd[- ]4\.0 | creativecommons\.org/licenses/by-nc-nd/4\.0
cc-by-nc-nd | cc-by | cc[- ]by[- ]nc[- ]nd | creativecommons\.org/licenses/by-nc-nd
cc-by | cc-by | cc[- ]by | creativecommons\.org/licenses/by
odbl-1.0 | open database | open (?:data commons )?open database license|open database license | opendatacommons\.org/licenses/odbl
odc-by | open data commons | open data commons attribution license | opendatacommons\.org/licenses/by
pddl-1.0 | public domain dedication | public domain dedication and license | opendatacommons\.org/licenses/pddl
eupl-1.1 | european union | european union public licen[sc]e,? (?:version|v)\.? ?1\.1 | joinup\.ec\.europa\.eu/software/page/eupl1\.1
eupl-1.2 | european union | european union public licen[sc]e | joinup\.ec\.europa\.eu/software/page/eupl
ofl-1.1 | open font | (?:sil )?open font license | scripts\.sil\.org/ofl
psf-2.0 | python software | python software foundation license | docs\.python\.org/3/license
php-3.01 | php | php license(?:,? version 3\.01?)? | php\.net/license/3_01
ruby | ruby | ruby licen[sc]e | ruby-lang\.org/en/about/license
ncsa | ncsa | (?:university of illinois/)?ncsa open source license | opensource\.org/licenses/ncsa
postgresql | postgresql | postgresql licen[sc]e | opensource\.org/licenses/postgresql
openssl | openssl | openssl licen[sc]e | openssl\.org/source/license
w3c | w3c | w3c software (?:notice and )?license | w3\.org/consortium/legal/copyright-software
x11 | x11 | x11 licen[sc]e | spdx\.org/licenses/x11
sspl-1.0 | server side | server side public license | mongodb\.com/licensing/server-side-public-license
elastic-2.0 | elastic | elastic license(?: 2\.0)? | elastic\.co/licensing/elastic-license
ms-pl | microsoft public | microsoft public license | opensource\.org/licenses/ms-pl
ms-rl | microsoft reciprocal | microsoft reciprocal license | opensource\.org/licenses/ms-rl
afl-3.0 | academic free | academic free license | opensource\.org/licenses/afl
osl-3.0 | open software license | open software license | opensource\.org/licenses/osl
vim | vim | vim licen[sc]e | vimhelp\.org/uganda
beerware | beer | beer-?ware licen[sc]e | spdx\.org/licenses/beerware
"""  # fmt: skip

# Sentences that stand for a license without its name.
NOTICES = r"""
mit | permission is hereby granted | permission is hereby granted, free of charge, to any person obtaining a copy
isc | permission to use, copy | permission to use, copy, modify, and(?:/or)? distribute this software for any purpose
bsd | redistribution and use | redistribution and use in source and binary forms
gpl | free software | (?:this program|it) is free software[;:,] you can redistribute it
apache-2.0 | compliance with the license | you may not use this file except in compliance with the license
unlicense | unencumbered | free and unencumbered software released into the public domain
zlib | provided 'as-is' | this software is provided 'as-is', without any express or implied warranty
all-rights-reserved | rights reserved | all rights reserved
proprietary | proprietary | (?:proprietary and confidential|confidential and proprietary)
"""  # fmt: skip


@dataclass(frozen=True)
class Rule:
    """A signature. Rules are tried in the order of their priority, highest first; `weight` is what a match proves."""

    label: str
    keyword: str
    pattern: re.Pattern
    priority: int
    weight: float


def _table(text: str) -> list[list[str]]:
    return [[x.strip() for x in line.split(" | ")] for line in text.strip().splitlines()]


def spaced(pattern: str) -> re.Pattern:
    return re.compile(pattern.replace(" ?", r"\s*").replace("[- ]", r"[-\s]").replace(" ", r"\s+"))


#: The line of an SPDX expression (MIT OR Apache-2.0 WITH ..), whose identifiers are looked up one by one.
_EXPRESSION = re.compile(r"spdx-license-identifier:[^\n]*")


@lru_cache(1)
def rules() -> tuple[Rule, ...]:
    """Four forms of each license, and the notices; the more specific the form, the higher its priority."""
    out = []
    for label, keyword, name, address in _table(LICENSES):
        spdx = re.escape(label)
        out.append(Rule(label, "spdx-license", re.compile(rf"(?<![\w.-]){spdx}(?:-only|-or-later)?(?![\w.-])"), 40, 1.0))
        out.append(Rule(label, keyword, spaced(rf"(?:licen[sc]ed|released|distributed|available|provided|published) under (?:the |a |terms of the |the terms of the )?(?:{name})(?![\w-])"), 30, 1.0))
        host = re.split(r"[/\\]", address)[0]
        out.append(Rule(label, host, re.compile(rf"(?:https?://)?(?:www\.)?{address}(?!\w)"), 20, 0.9))
        out.append(Rule(label, keyword, spaced(rf"(?<![\w-])(?:{name})(?![\w-])"), 10, 0.8))
    out += [Rule(label, keyword, spaced(text), 25, 0.7 if label in ("all-rights-reserved", "proprietary") else 1.0) for label, keyword, text in _table(NOTICES)]
    return tuple(sorted(out, key=lambda r: -r.priority))


@lru_cache(1)
def by_keyword() -> dict[str, list[tuple[int, Rule]]]:
    out: dict[str, list[tuple[int, Rule]]] = {}
    for k, rule in enumerate(rules()):
        out.setdefault(rule.keyword, []).append((k, rule))
    return out


def detect(low: str) -> list[tuple[int, int, str, float]]:
    """Spans (start, end, label, weight) of a lower-cased text, in order.

    Only rules whose keyword occurs are tried. A match goes if a match of a higher priority, or of the same and longer,
    contains it; of equal spans the rule that comes first stays.
    """
    found = []
    flat = " ".join(low.split()).replace("cc by", "cc-by")
    for keyword, own in by_keyword().items():
        if keyword not in flat:
            continue
        places = [m.span() for m in _EXPRESSION.finditer(low)] if keyword == "spdx-license" else [(0, len(low))]
        found += [(-r.priority, m.start() - m.end(), k, m.start(), m.end(), r) for k, r in own for a, b in places for m in r.pattern.finditer(low, a, b)]
    kept: list[tuple[int, int, str, float]] = []
    by_block: dict[int, list[tuple[int, int]]] = {}  # kept spans by the blocks of 1,024 characters that they touch
    for _, _, _, a, b, r in sorted(found, key=lambda x: x[:4]):
        if not any(s <= a and b <= e for s, e in by_block.get(a >> 10, ())):
            kept.append((a, b, r.label, r.weight))
            for block in range(a >> 10, (b >> 10) + 1):
                by_block.setdefault(block, []).append((a, b))
    return sorted(kept)


_WORDS = bytes(i + 32 if 65 <= i <= 90 else i if i >= 128 or 48 <= i <= 57 or 97 <= i <= 122 else 32 for i in range(256))
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_PHRASES = [(f" {p} ".encode(), label) for p, label in BASE.items()]


def scan(text: str) -> tuple[int, int, int | None, int | None, str, str, float, list[tuple[int, int, str, float]]]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score and the spans (in characters) of a text."""
    data = text.encode()
    words = data.translate(_WORDS).split()
    line = b" " + b" ".join(words) + b" "
    places, base = [], set()
    for phrase, label in _PHRASES:
        at, word, last = line.find(phrase), 0, 0
        while at >= 0:
            word, last = word + line.count(b" ", last, at), at  # spaces before a word are its number
            places.append(word)
            base.add(label)
            at = line.find(phrase, at + 1)
    spans = detect(data.translate(_LOWER).decode())
    labels = base | {s[2] for s in spans}
    score = max([0.6 * bool(base), *(s[3] for s in spans)])
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, spans


_FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
_SPANS = "spans array<struct<start: int, end: int, label: string, weight: double>>"


def scan_licenses(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: doc_id, the fields of scan(), and its spans. Null texts are empty: zeros, nulls, empty labels, score 0.

    No row depends on another: no shuffle, repeated rows each get theirs, whole texts are read however long they are.
    """

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = list(zip(*(scan(t or "") for t in batch.column(1).to_pylist()), strict=True)) or [[]] * 8
        spans = pa.array([[dict(zip(("start", "end", "label", "weight"), s, strict=True)) for s in x] for x in made[7]], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("weight", pa.float64())])))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(made, kinds)), spans], ["doc_id", *(f.split()[0] for f in _FIELDS.split(", ")), "spans"])

    rows = docs.selectExpr(f"cast(`{key}` as bigint) as doc_id", f"cast(`{text}` as string) as text")
    return map_batches(rows, one, f"doc_id long, {_FIELDS}, {_SPANS}")

"""Operator 9: licence scan, a sparse word n-gram logistic regression over windows of words, whose predictions templates confirm.

A block is first classified, in windows of ``WINDOW`` words around its learned n-grams; only families that the regression gives at least ``LOOSE`` of what it gives unknown in one
of them are looked for in it, and a bound on the sums of weights rules most blocks out before. What is confirmed is reported by its family: a notice or a statement by its nearest
template, a name behind other words that state a licence (``CUES``), a line that is a name and little else (a heading, 'License: X'). A family that a window has with
``CONFIDENCE`` and nothing confirms is listed as unconfirmed. Statements that are denied ('not licensed under') are not reported.

Every non-empty line is a paragraph; lines up to one without words (also an empty comment line) form a block, in which notices may be
wrapped. Templates are ``NOTICES`` and all statements that ``FRAMES`` make of ``NAMES``; their word bigrams and trigrams (of
ASCII-lower-cased words of letters, digits and other alphabets, which leaves comment marks out) are the features. The classifier is
trained here: positives are templates, whole, among other words, and for notices with words dropped (seeded); the class ``unknown``
learns from at most ``NEGATIVES`` windows of the corpus, from statements about invented licences, from prose that only
mentions a licence, and from single bigrams. A temperature calibrates the probabilities: it is fitted on whole variants of names and
notices that a first training did not see, and on other negatives.

A window begins at any bigram of a template, spans at most twice the template and ``SLACK`` words, and is confirmed if it holds
``CONFIRM`` of the template's bigrams, as large a share of those that occur in templates of no other family (of a statement
instead: its verb and its whole name), and the classifier gives it the family with ``CONFIDENCE``. Of overlapping windows the one with the largest share counts, so a block may name several families; names that 'or' and 'and' add
to a statement are classified and confirmed like it. Identifiers of an
``SPDX-License-Identifier`` expression are taken one by one; each is classified as a statement and confirmed by the table of identifiers.
One scan reads every block of every text, without a shuffle.

Null and empty texts have no paragraphs. Repeated rows are scanned alike; an empty table trains on templates alone. Extra columns
are dropped. Families are listed once, in order of name; a notice counts for the paragraph in which it begins. Two windows with
the same share: the shorter one counts, then the first, then that of the first template.
"""

from __future__ import annotations

import heapq
import math
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONFIDENCE = 0.5
CONFIRM = 0.6
SLACK = 8
#: The bound on what the class unknown learns from the corpus: windows, and words in each.
NEGATIVES, NEGATIVE_WORDS = 1000, 60
UNKNOWN = "unknown"
#: Words of a window that is classified, the share against unknown from which a family is looked for, words of a line that may be a heading.
WINDOW, LOOSE, HEADING_WORDS = 40, 0.02, 14
#: Marks of a heading's borders among its words; no text holds them.
FIRST, LAST = b"^", b"$"
#: How else a text states its licence, up to its name.
CUES = ("is under the ", "are made under the ", "covered by the ", "governed by the ", "subject to the terms of the ", "subject to the ", "licenses this under the ", "used under the terms of the ", "dual licensed under the ")
#: What stands before a name, behind articles and 'terms of': the last words of cues.
CUE_ENDS = {(b"under",), (b"covered", b"by"), (b"governed", b"by"), (b"subject", b"to"), (b"licensed", b"as")}
ARTICLES = {b"the", b"a", b"an"}
DENIALS = {b"not", b"never", b"cannot", b"neither", b"nor"}
#: Words between a denial and what it denies.
FILLERS = {b"be", b"been", b"being", b"currently", b"yet", b"longer", b"itself", b"also", b"t"}
DENIED_STARTS = {b"isn", b"aren", b"wasn", b"weren", b"no"}
STATING = {b"licensed", b"released", b"distributed", b"available", b"published", b"licenses", b"made", b"is", b"are", b"used", b"provided", b"offered", b"covered", b"governed"}
#: Words that a heading may hold besides a name.
TAIL = {w.encode() for w in "license licence licenses type name osi approved version v the a of copyright c full text terms and conditions later or any only january february march april may june july august september october november december".split()}
LABEL = re.compile(rb"^\W*(?:project )?licen[cs]es?(?: type| name| identifier)?\s*[:=]+\s*([^\n]*)", re.IGNORECASE)
VERBS = ("licensed", "released", "distributed", "available", "published")
#: How a text states its licence.
FRAMES = tuple(f"{verb} under {link}" for verb in VERBS for link in ("", "the ", "a ", "the terms of the "))
#: Names by which licences are stated in public texts: fixed values.
NAMES: dict[str, list[str]] = {
    "agpl-3.0": ["GNU Affero General Public License", "GNU Affero General Public License, version 3", "GNU AGPL", "AGPL", "AGPLv3"],
    "apache-1.1": ["Apache License, Version 1.1", "Apache Software License, Version 1.1"],
    "apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache 2 License", "Apache License v2.0", "Apache License, Version 2"],
    "artistic": ["Artistic License", "Artistic License 2.0"],
    "boost": ["Boost Software License", "Boost Software License, Version 1.0"],
    "bsd": ["BSD License", "BSD 2-Clause License", "BSD 3-Clause License", "2-Clause BSD License", "3-Clause BSD License", "New BSD License", "Simplified BSD License", "Modified BSD License", "BSD-style license"],
    "cc0": ["CC0", "CC0 1.0", "CC0 1.0 Universal", "CC0 1.0 Universal public domain dedication", "Creative Commons Zero"],
    "cddl": ["Common Development and Distribution License", "CDDL"],
    "epl": ["Eclipse Public License", "Eclipse Public License 2.0", "Eclipse Public License, Version 1.0"],
    "eupl": ["European Union Public Licence", "European Union Public License", "EUPL"],
    "gfdl": ["GNU Free Documentation License", "GFDL"],
    "gpl": ["GNU General Public License", "GNU General Public License, version 2", "GNU General Public License, version 3", "GNU GPL", "GNU GPL version 2", "GNU GPL version 3", "GPL", "GPLv2", "GPLv3", "GPL version 2", "GPL version 3"],
    "isc": ["ISC License"],
    "lgpl": ["GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License, version 3", "GNU Library General Public License", "GNU LGPL", "LGPL", "LGPLv3"],
    "mit": ["MIT License", "MIT licence", "MIT/X11 License", "Expat License", "MIT-style license"],
    "mpl-1.1": ["Mozilla Public License 1.1", "Mozilla Public License, Version 1.1"],
    "mpl-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, Version 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0"],
    "odbl": ["Open Database License", "ODbL"],
    "ofl": ["SIL Open Font License", "SIL Open Font License, Version 1.1"],
    "psf": ["Python Software Foundation License", "PSF License"],
    "unlicense": ["Unlicense"],
    "wtfpl": ["WTFPL"],
    "zlib": ["zlib License", "zlib/libpng License"],
}
#: Families of the Creative Commons licences with attribution, by the conditions that their names add.
CONDITIONS = {"cc-by": "", "cc-by-nc": "NonCommercial", "cc-by-nc-nd": "NonCommercial-NoDerivatives", "cc-by-nc-sa": "NonCommercial-ShareAlike", "cc-by-nd": "NoDerivatives", "cc-by-sa": "ShareAlike"}
for _family, _conditions in CONDITIONS.items():
    _long, _short = "-".join(["Creative Commons Attribution", *_conditions.split()]), _family.upper().replace("CC-", "CC ")
    NAMES[_family] = [f"{_long} License", f"{_long} 4.0", *(f"{_long} {v} License" for v in ("4.0 International", "3.0 Unported")), f"{_short} 4.0", f"{_short} 3.0", f"{_short} license"]
#: Sentences of licences and of the notices that name them: fixed values.
NOTICES: dict[str, list[str]] = {
    "agpl-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "You should have received a copy of the GNU Affero General Public License along with this program"],
    "apache-2.0": ["You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"],
    "boost": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Use of this source code is governed by a BSD-style license", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "gpl": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "You should have received a copy of the GNU General Public License along with this program"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS"],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "You should have received a copy of the GNU Lesser General Public License along with this library"],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "ofl": ["This Font Software is licensed under the SIL Open Font License, Version 1.1"],
    "unlicense": ["This is free and unencumbered software released into the public domain", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary"],
    "wtfpl": ["Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed"],
    "zlib": ["This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"],
}
#: Identifiers of public licence lists, by family: fixed values.
SPDX: dict[str, list[str]] = {
    "agpl-3.0": ["AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"],
    "apache-1.1": ["Apache-1.1"],
    "apache-2.0": ["Apache-2.0"],
    "artistic": ["Artistic-1.0", "Artistic-2.0"],
    "boost": ["BSL-1.0"],
    "bsd": ["0BSD", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause"],
    "cc0": ["CC0-1.0"],
    "cddl": ["CDDL-1.0", "CDDL-1.1"],
    "epl": ["EPL-1.0", "EPL-2.0"],
    "eupl": ["EUPL-1.1", "EUPL-1.2"],
    "gfdl": ["GFDL-1.2-or-later", "GFDL-1.3-or-later"],
    "gpl": ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-2.0+", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-3.0+"],
    "isc": ["ISC"],
    "lgpl": ["LGPL-2.0-only", "LGPL-2.0-or-later", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"],
    "mit": ["MIT", "MIT-0", "X11"],
    "mpl-1.1": ["MPL-1.1"],
    "mpl-2.0": ["MPL-2.0"],
    "odbl": ["ODbL-1.0"],
    "ofl": ["OFL-1.1"],
    "psf": ["PSF-2.0", "Python-2.0"],
    "unlicense": ["Unlicense"],
    "wtfpl": ["WTFPL"],
    "zlib": ["Zlib"],
} | {family: [f"{family.upper()}-{v}" for v in ("3.0", "4.0")] for family in CONDITIONS}
FAMILY_OF = {i.lower(): family for family, ids in SPDX.items() for i in ids}
TAG = re.compile(rb"spdx-license-identifier:[ \t]*([^\n]*)", re.IGNORECASE)
IDENTIFIER = re.compile(rb"[a-z0-9.+-]+", re.IGNORECASE)
#: What may follow the name in a heading.
HEADING_TAILS = ("", "version 2.0", "Version 3, 29 June 2007", "Version 2.0, January 2004", "Copyright (c) 2020")
#: Prose that names a licence without stating it; seeds of the class unknown.
MENTIONS = ("the {} is one of many that courts have read", "a talk about the {} and its history", "why we left the {} behind", "{} compliance training for managers", "compare the {} with others")
WORDS = re.compile(rb"[a-z0-9\x80-\xff]+")
#: Comment marks that are words.
MARKS = re.compile(rb"\s*(?:dnl|rem)\s", re.IGNORECASE)


def words_of(paragraph: bytes) -> list[bytes]:
    return WORDS.findall(paragraph.lower())


def pairs_of(words: list[bytes]) -> list[tuple[bytes, bytes]]:
    return list(zip(words, words[1:], strict=False))


def grams_of(words: list[bytes]) -> list[tuple[bytes, ...]]:
    return [*pairs_of(words), *zip(words, words[1:], words[2:], strict=False)]


@dataclass
class Template:
    family: str
    variant: tuple[str, str]  # name or notice that it comes from
    words: list[bytes]
    frame: int  # of a statement, the words before the name; else 0

    def __post_init__(self) -> None:
        pairs = pairs_of(self.words)
        self.pairs = frozenset(pairs)
        self.least = math.ceil(CONFIRM * len(self.pairs) - 1e-9)
        self.needed = frozenset([pairs[0], *pairs[self.frame - 1 :]]) if self.frame else self.pairs

    def tell(self, families: dict[tuple[bytes, bytes], set[str]]) -> None:
        """Which bigrams, and how many of them, a window must hold: of a statement its verb and its name, of a notice those of its family alone."""
        if not self.frame:
            self.needed = frozenset(p for p in self.pairs if len(families[p]) == 1)
        rarest = min(len(families[p]) for p in self.needed)
        self.rare = frozenset(p for p in self.needed if len(families[p]) == rarest)
        self.fewest = len(self.needed) if self.frame else math.ceil(CONFIRM * len(self.needed) - 1e-9)

    def held_by(self, seen: set) -> bool:
        return len(seen) >= self.least and len(self.needed & seen) >= self.fewest


def templates() -> list[Template]:
    found = [Template(family, (family, name), words_of((frame + name).encode()), len(frame.split())) for family, names in NAMES.items() for name in names for frame in FRAMES]
    found += [Template(family, (family, text), words_of(text.encode()), 0) for family, texts in NOTICES.items() for text in texts]
    families: dict[tuple[bytes, bytes], set[str]] = defaultdict(set)
    for t in found:
        for p in t.pairs:
            families[p].add(t.family)
    for t in found:
        t.tell(families)
    return found


@dataclass
class Model:
    families: list[str]
    grams: dict[tuple[bytes, ...], int]
    weights: np.ndarray  # (grams + 1, families); the last row is the bias
    temperature: float

    def __post_init__(self) -> None:
        self.templates = templates()
        self.names: dict[bytes, list[tuple[list[bytes], str]]] = defaultdict(list)
        for family, names in NAMES.items():
            for words in map(words_of, map(str.encode, names)):
                self.names[words[0]].append((words, family))
        unknown = self.families.index(UNKNOWN)
        lead = (self.weights - self.weights[:, [unknown]])[:, [k for k in range(len(self.families)) if k != unknown]].max(axis=1) / self.temperature
        #: The most that an n-gram adds to any family against unknown; and what their sum must reach for a family to be looked for.
        self.most = {g: float(lead[k]) for g, k in self.grams.items() if lead[k] > 0}
        self.reach = math.log(LOOSE) - float(lead[-1])
        self.holders: dict[tuple[bytes, bytes], list[int]] = defaultdict(list)
        self.rare: dict[tuple[bytes, bytes], list[int]] = defaultdict(list)
        for k, t in enumerate(self.templates):
            for p in t.pairs:
                self.holders[p].append(k)
            for p in t.rare:
                self.rare[p].append(k)

    def classify(self, words: list[bytes]) -> tuple[str, float]:
        """Family and its probability."""
        found = sorted({self.grams[g] for g in grams_of(words) if g in self.grams})
        logits = self.weights[[*found, -1]].sum(axis=0) / self.temperature
        p = softmax(logits[None])[0]
        best = int(p.argmax())
        return (self.families[best], float(p[best])) if p[best] >= CONFIDENCE else (UNKNOWN, float(p[self.families.index(UNKNOWN)]))

    def probabilities(self, words: list[bytes]) -> np.ndarray:
        found = sorted({self.grams[g] for g in grams_of(words) if g in self.grams})
        return softmax((self.weights[[*found, -1]].sum(axis=0) / self.temperature)[None])[0]

    def predicted(self, words: list[bytes]) -> dict[str, float]:
        """Families that have ``LOOSE`` of unknown's share, or more, in a window of a block, and the most that a window gives them; several notices of a window do not hide each other."""
        best: dict[str, float] = {}
        for at in range(0, max(1, len(words) - WINDOW // 2), WINDOW // 2):
            own = words[at : at + WINDOW]
            if sum(self.most[g] for g in {*grams_of(own)} if g in self.most) < self.reach:
                continue
            shares = self.probabilities(own).tolist()
            least = LOOSE * shares[self.families.index(UNKNOWN)]
            for family, p in zip(self.families, shares, strict=True):
                if p >= least and family != UNKNOWN:
                    best[family] = max(p, best.get(family, 0.0))
        return best

    def named(self, words: list[bytes], at: int, wanted: dict[str, float]) -> tuple[list[bytes], str] | None:
        """The longest name, of the wanted families, at a place."""
        found = [(len(n), n, family) for n, family in self.names.get(words[at], ()) if family in wanted and words[at : at + len(n)] == n]
        return max(found)[1:] if found else None

    def cued(self, words: list[bytes], wanted: dict[str, float]) -> list[tuple[int, str, float]]:
        """First word, family and probability of each name behind words that state a licence."""
        found = []
        for at in range(1, len(words)):
            if (name := self.named(words, at, wanted)) is None or (begin := cue_before(words, at)) is None or denied(words, begin):
                continue
            judged = self.classify(words[max(0, begin - 2) : at + len(name[0])])
            if judged[0] == name[1]:
                found.append((begin, *judged))
        return found

    def heading(self, words: list[bytes]) -> tuple[str, float] | None:
        """Family and probability of a line that the regression takes for a heading and that is a name and little else."""
        judged = self.classify([FIRST, *words, LAST])
        if judged[0] == UNKNOWN:
            return None
        for at in range(len(words)):
            if (name := self.named(words, at, {judged[0]: 1.0})) is not None:
                rest = words[:at] + words[at + len(name[0]) :]
                return judged if all(w in TAIL or w.strip(b"v").isdigit() for w in rest) else None
        return None

    def identifiers(self, tag: bytes) -> list[tuple[str, float]]:
        """Family and probability of each confirmed identifier of an expression."""
        found = []
        for name in dict.fromkeys(i.lower().rstrip(b".") for i in IDENTIFIER.findall(tag)):
            family = FAMILY_OF.get(name.decode())
            if family and (judged := self.classify(words_of(b"spdx license identifier " + name)))[0] == family:
                found.append(judged)
        return found

    def alternatives(self, words: list[bytes], at: int) -> list[tuple[int, str, float]]:
        """First word, family and probability of each name that goes on a statement which ends before the word ``at``: 'or the MIT License'."""
        found = []
        while words[at : at + 1] and words[at] in (b"or", b"and"):
            first = at + 1
            while words[first : first + 1] and words[first] in (b"or", b"the", b"a"):
                first += 1
            names = [(len(n), n, family) for n, family in self.names.get(words[first] if first < len(words) else b"", ()) if words[first : first + len(n)] == n]
            if not names:
                break
            size, name, family = max(names)
            judged = self.classify([*words_of(FRAMES[1].encode()), *name])
            if judged[0] != family:
                break
            found.append((first, *judged))
            at = first + size
        return found

    def candidates(self, pairs: list[tuple[bytes, bytes]], wanted: dict[str, float]) -> dict[int, list[int]]:
        """Templates of the wanted families of which a block holds enough, and where in it their bigrams are."""
        present = set(pairs)
        own = {k for p in present & self.rare.keys() for k in self.rare[p] if self.templates[k].family in wanted}
        own = {k for k in own if self.templates[k].held_by(self.templates[k].pairs & present)}
        places: dict[int, list[int]] = {k: [] for k in own}
        if own:
            for i, p in enumerate(pairs):
                for k in self.holders.get(p, ()):
                    if k in own:
                        places[k].append(i)
        return places

    def notices(self, words: list[bytes], begins: list[int], wanted: dict[str, float]) -> list[tuple[int, str, float]]:
        """First word, family and probability of each confirmed window of a block, whose lines begin at the words ``begins``."""
        pairs = pairs_of(words)
        places = self.candidates(pairs, wanted)
        judged: dict[tuple[bytes, ...], tuple[str, float]] = {}

        def window(k: int, at: int, past: int) -> tuple | None:
            """The shortest window from the place ``at`` on that holds most of the template before the bigram ``past``, if it is confirmed."""
            template, own, first = self.templates[k], places[k], places[k][at]
            size = len(template.pairs)
            seen, end = set(), first
            for j in range(at, len(own)):
                i = own[j]
                if i >= past or i > first + 2 * size + SLACK:
                    break
                if pairs[i] not in seen:
                    seen.add(pairs[i])
                    end = i
            if not template.held_by(seen):
                return None
            held = tuple(words[first : end + 2])
            if held not in judged:
                judged[held] = self.classify(list(held))
            if judged[held][0] != template.family:
                return None
            return -len(seen) / size, end + 1 >= line_end(first), end - first, first, k, at, end, judged[held][1]

        line_end = lambda i: begins[x] if (x := bisect_right(begins, i)) < len(begins) else len(words)
        inside, across = [], []
        for k, own in places.items():
            for at, i in enumerate(own):
                if (w := window(k, at, len(words))) is not None:
                    (across if w[1] else inside).append(w)
                if (w is None or w[1]) and (w := window(k, at, line_end(i) - 1)) is not None:
                    inside.append(w)
        # Where a line alone names a family, a window that takes words of other lines adds nothing.
        ends: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for w in inside:
            ends[self.templates[w[4]].family].append((w[3], w[6]))
        for spans in ends.values():
            spans.sort()
        heap = inside + [w for w in across if not holds(ends[self.templates[w[4]].family], w[3], w[6])]
        heapq.heapify(heap)
        taken, found = bytearray(len(words)), []
        while heap:
            _, _, _, first, k, at, end, p = heapq.heappop(heap)
            if taken[first]:
                continue
            clash = taken.find(1, first, end + 1)
            if clash < 0:
                taken[first : end + 1] = b"\1" * (end + 1 - first)
                if not (self.templates[k].frame and denied(words, first)):
                    found += [(first, self.templates[k].family, p), *self.alternatives(words, end + 2)]
            elif (w := window(k, at, clash)) is not None:
                heapq.heappush(heap, w)
        return sorted(found)


def denied(words: list[bytes], at: int) -> bool:
    """Whether the words before a place deny what begins there."""
    k = at
    while k > 0 and words[k - 1] in STATING:
        k -= 1
    while k > 0 and words[k - 1] in FILLERS:
        k -= 1
    return k > 0 and (words[k - 1] in DENIALS or words[k - 1] in DENIED_STARTS and k < at)


def cue_before(words: list[bytes], at: int) -> int | None:
    """Where the words begin that state the licence named at a place."""
    k = at
    while k > 0 and words[k - 1] in ARTICLES:
        k -= 1
    if words[max(0, k - 2) : k] == [b"terms", b"of"]:
        k -= 2
        while k > 0 and words[k - 1] in ARTICLES:
            k -= 1
    for n in (1, 2):
        if k >= n and tuple(words[k - n : k]) in CUE_ENDS:
            return k - n
    return None


def holds(spans: list[tuple[int, int]], first: int, end: int) -> bool:
    """Whether one of the sorted spans lies within these bounds."""
    return any(b <= end for _, b in spans[bisect_left(spans, (first, 0)) : bisect_left(spans, (end + 1, 0))])


def blocks_of(lines: list[bytes]) -> Iterator[tuple[list[bytes], list[int], list[int]]]:
    """Words of each block, where its lines begin in them, and the numbers of these lines among the non-empty ones."""
    words, begins, numbers, k = [], [], [], 0
    for line in lines:
        own = words_of(line[m.end() :] if (m := MARKS.match(line)) else line)
        if own:
            begins.append(len(words))
            numbers.append(k)
            words += own
        elif words:
            yield words, begins, numbers
            words, begins, numbers = [], [], []
        k += bool(line.strip())
    if words:
        yield words, begins, numbers


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def examples(listed: list[Template], negatives: list[list[bytes]], seed: int = 7, copies: int = 12) -> list[tuple[list[bytes], str, tuple[str, str] | None]]:
    """(words, family, variant) to learn from: templates, identifiers, negatives."""
    rng, out = np.random.default_rng(seed), []
    around = lambda: negatives[rng.integers(len(negatives))][: rng.integers(0, 12)] if negatives else []
    for k, t in enumerate(listed):
        if t.frame and k // len(FRAMES) % 5 != k % 5:
            continue  # a name is learnt in a fifth of the frames
        out.append((t.words, t.family, t.variant))
        for _ in range(1 if t.frame else copies):
            kept = t.words if t.frame else [w for w in t.words if rng.random() > 0.06]
            out.append(([*around(), *kept, *around()], t.family, t.variant))
    for family, names in NAMES.items():
        for k, name in enumerate(names):
            for j, cue in enumerate(CUES):
                if (j + k) % 3 == 0:
                    own = words_of((cue + name).encode())
                    out += [(own, family, None), ([*around(), *own, *around()], family, None)]
            for tail in HEADING_TAILS:
                out.append(([FIRST, *words_of(f"{name} {tail}".encode()), LAST], family, None))
    for family, ids in SPDX.items():
        out += [(words_of(f"spdx license identifier {i}".encode()), family, None) for i in ids for _ in range(copies)]
    unknown = [*negatives, []]
    syllables = [a + b for a in "bdfgklmnprstvz" for b in "aeiou"]
    for k in range(300):
        name = "".join(syllables[i] for i in rng.integers(len(syllables), size=rng.integers(2, 4)))
        kind = ("{} License", "{} Public License", "{} License, Version 2.0", "{} General Public License", "{} Software License 1.0", "{}")[k % 6].format(name)
        unknown.append(words_of((FRAMES[k % len(FRAMES)] + kind).encode()))
        unknown.append([FIRST, *words_of(f"{kind} {HEADING_TAILS[k % len(HEADING_TAILS)]}".encode()), LAST])
        unknown.append(words_of((CUES[k % len(CUES)] + kind).encode()))
    unknown += [[FIRST, *w[:12], LAST] for w in negatives[:300]]
    unknown += [[FIRST, *words_of(m.format(name).encode()), LAST] for names in NAMES.values() for name in names[:2] for m in MENTIONS]
    unknown += [words_of(f"spdx license identifier {a}{b}-2.0".encode()) for a in syllables[:10] for b in syllables[:3]]
    unknown += [words_of(m.format(name).encode()) for names in NAMES.values() for name in names for m in MENTIONS]
    # Fragments of a template name no family: single bigrams are unknown.
    unknown += [list(p) for p in sorted({p for t in listed for p in t.pairs})]
    return out + [(w, UNKNOWN, (UNKNOWN, str(k))) for k, w in enumerate(unknown)]


class Sparse:
    """Rows of feature numbers, the last of each that of the bias."""

    def __init__(self, rows: list[list[int]], n: int):
        self.flat = np.concatenate([np.array(r, np.int64) for r in rows])
        self.starts = np.cumsum([0, *map(len, rows[:-1])])
        row = np.repeat(np.arange(len(rows)), list(map(len, rows)))
        self.order = np.argsort(self.flat, kind="stable")
        self.columns, self.firsts = np.unique(self.flat[self.order], return_index=True)
        self.row, self.n = row[self.order], n

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.add.reduceat(weights[self.flat], self.starts)

    def transposed_times(self, y: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, y.shape[1]))
        out[self.columns] = np.add.reduceat(y[self.row], self.firsts)
        return out


def regress(rows: list[list[int]], y: np.ndarray, n: int, steps: int = 100, rate: float = 5.0, decay: float = 1e-4) -> np.ndarray:
    """Weights of a softmax regression with classes of equal weight."""
    x = Sparse(rows, n)
    weights, speed = np.zeros((n, y.shape[1])), np.zeros((n, y.shape[1]))
    per_row = (y @ (1 / y.sum(axis=0).clip(1)))[:, None] / y.shape[1]
    for _ in range(steps):
        slope = x.transposed_times(per_row * (softmax(x.times(weights)) - y)) + decay * weights
        speed = 0.9 * speed + slope
        weights -= rate * speed / (1 + np.abs(speed).max())
    return weights


def train(negatives: list[list[bytes]]) -> Model:
    listed = templates()
    by_rare: dict[tuple[bytes, bytes], list[Template]] = defaultdict(list)
    for t in listed:
        for p in t.rare:
            by_rare[p].append(t)
    seen = [(w, set(pairs_of(w))) for w in negatives]
    clean = [w for w, own in seen if not any(t.held_by(t.pairs & own) for p in own & by_rare.keys() for t in by_rare[p])]
    families = [*sorted(NAMES), UNKNOWN]
    said = [words_of((cue + name).encode()) for names in NAMES.values() for name in names for cue in CUES]
    said += [[FIRST, *words_of(f"{name} {tail}".encode()), LAST] for names in NAMES.values() for name in names for tail in HEADING_TAILS]
    grams = {g: k for k, g in enumerate(sorted({g for t in listed for g in grams_of(t.words)} | {g for w in said for g in grams_of(w)} | {g for ids in SPDX.values() for i in ids for g in grams_of(words_of(f"spdx license identifier {i}".encode()))}))}
    data = examples(listed, clean)
    rows = [[*sorted({grams[g] for g in grams_of(words) if g in grams}), len(grams)] for words, _, _ in data]
    y = np.eye(len(families))[[families.index(f) for _, f, _ in data]]
    variants = sorted({v for _, _, v in data if v})
    left_out = {v for k, v in enumerate(variants) if k % 5 == 0}
    aside = np.array([v in left_out for _, _, v in data])
    first = regress([r for r, a in zip(rows, aside, strict=True) if not a], y[~aside], len(grams) + 1)
    logits = Sparse([r for r, a in zip(rows, aside, strict=True) if a], len(grams) + 1).times(first)
    loss = lambda t: -np.log(softmax(logits / t)[y[aside] == 1] + 1e-12).mean()
    temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
    return Model(families, grams, regress(rows, y, len(grams) + 1), temperature)


def some_windows(documents: DataFrame, most: int = NEGATIVES, words: int = NEGATIVE_WORDS) -> list[list[bytes]]:
    """At most ``most`` windows of ``words`` words, each from a document whose doc_id hashes low: around a bigram of a template if its text has any,
    else at a place that a hash of the text gives. A threshold on the hash leaves about four times as many, so that no task has to order more.
    """
    n = documents.count()
    thinned = documents.where("text is not null").withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)))
    if n > 4 * most:
        thinned = thinned.where(F.col("h") < int((1 << 40) * 4 * most / n))
    rare = frozenset(p for t in templates() for p in t.rare)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, text in zip(batch["h"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), strict=True):
                own = words_of(text)
                at = next((i for i, p in enumerate(pairs_of(own)) if p in rare), h % max(1, len(own)))
                first = max(0, at - words // 2)
                out.append(b" ".join(own[first : first + words]))
            yield pa.RecordBatch.from_arrays([batch["h"], pa.array(out, pa.binary())], ["h", "window"])

    rows = thinned.select("h", "text").mapInArrow(run, "h long, window binary").orderBy("h", "window").limit(most).collect()
    return [w for r in rows if (w := bytes(r["window"]).split())]


OUT = "doc_id long, n_paragraphs long, n_license long, licenses array<string>, score double, paragraphs array<int>, unconfirmed array<string>"


def notices_of(model: Model, text: bytes) -> tuple[int, list[tuple[int, str, float]]]:
    """Paragraphs of a text, and of each confirmed notice its paragraph, family and probability."""
    n, found, _ = scanned(model, text)
    return n, found


def scanned(model: Model, text: bytes) -> tuple[int, list[tuple[int, str, float]], set[str]]:
    """``notices_of``, and the families that a window has with ``CONFIDENCE`` and nothing confirms."""
    lines, found, likely = text.split(b"\n"), [], set()
    if b"spdx" in text.lower():
        number = 0
        for k, line in enumerate(lines):
            if tag := TAG.search(line):
                found += [(number, *judged) for judged in model.identifiers(tag[1])]
                # A space ends no block, and neither do the words before the tag.
                lines[k] = line[: tag.start()] + b" tag"
            number += bool(line.strip())
    labels = {}
    if b"icen" in text:
        number = 0
        for line in lines:
            if (label := LABEL.match(line)) and len(label[1]) <= 200:
                labels[number] = label[1]
            number += bool(line.strip())
    open_end = False  # whether the block before ends amid a sentence, which no heading follows
    for words, begins, numbers in blocks_of(lines):
        for k, (number, first) in enumerate(zip(numbers, begins, strict=True)):
            own = words[first : begins[k + 1] if k + 1 < len(begins) else len(words)]
            if number in labels:
                found += [(number, *judged) for judged in model.identifiers(labels[number])]
            if not open_end and len(own) <= HEADING_WORDS and any(w in model.names for w in own) and (judged := model.heading(own)):
                found.append((number, *judged))
        if not model.most.keys().isdisjoint(zip(words, words[1:], strict=False)) and (wanted := model.predicted(words)):
            stated = model.notices(words, begins, wanted)
            # A name inside a longer notice of its family adds nothing.
            stated += [x for x in model.cued(words, wanted) if not any(f == x[1] and i <= x[0] <= i + WINDOW for i, f, _ in stated)]
            places = {(numbers[bisect_right(begins, i) - 1], family): p for i, family, p in stated}
            found += [(number, family, p) for (number, family), p in places.items()]
            likely |= {family for family, p in wanted.items() if p >= CONFIDENCE}
        open_end = words[-1] in ARTICLES or (words[-1],) in CUE_ENDS
    found = [(number, family, p) for (number, family), p in {(number, family): p for number, family, p in found}.items()]
    return sum(1 for x in lines if x.strip()), found, likely - {family for _, family, _ in found}


def scan_licenses(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """Of every row: doc_id, n_paragraphs, n_license (those in which a confirmed notice begins), licenses, score (of the surest, 0 without), paragraphs (their numbers), unconfirmed (families)."""
    shared = documents.sparkSession.sparkContext.broadcast(model or train(some_windows(documents)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), strict=True):
                n, found, likely = scanned(model, text or b"")
                at = sorted({k for k, _, _ in found})
                rows.append((doc_id, n, len(at), sorted({f for _, f, _ in found}), max((p for _, _, p in found), default=0.0), at, sorted(likely)))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in OUT.split(", ")])

    return documents.select("doc_id", "text").mapInArrow(run, OUT)

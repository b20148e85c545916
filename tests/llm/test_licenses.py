"""Licence scan: a table of paragraphs, half of them near misses, and a plain search for comparison."""

from __future__ import annotations

import pytest

from aerolake.llm import license_scan

STATED = [
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("apache-2.0", "// SPDX-License-Identifier: Apache-2.0"),
    ("apache-2.0", "You may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-1.1", "This package is released under the Apache Software License, Version 1.1."),
    ("mit", "Released under the MIT License."),
    ("mit", "This code is licensed under the terms of the MIT license."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal"),
    ("mit", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    ("bsd", "Redistribution and use in source and binary forms, with or without"),
    ("bsd", "# Use of this source code is governed by a BSD-style license that can be\n# found in the LICENSE file."),
    ("bsd", "SPDX-License-Identifier: BSD-2-Clause"),
    ("bsd", "distributed under the 3-clause BSD license"),
    ("isc", "SPDX-License-Identifier: ISC"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted"),
    ("gpl", "SPDX-License-Identifier: GPL-2.0-only"),
    ("gpl", "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl", "SPDX-License-Identifier: LGPL-2.1-only"),
    ("lgpl", " * This library is free software; you can redistribute it and/or\n * modify it under the terms of the GNU Lesser General Public\n * License as published by the Free Software Foundation; either"),
    ("agpl-3.0", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("agpl-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("mpl-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed"),
    ("cc0", "SPDX-License-Identifier: CC0-1.0"),
    ("cc0", "Released under CC0 1.0 Universal."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0."),
    ("cc-by-sa", "Text is available under the Creative Commons Attribution-ShareAlike License"),
    ("zlib", "Released under the Zlib License"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("apache-2.0,mit", "Licensed under the MIT License or the Apache License, Version 2.0, at your option"),
    ("apache-2.0,mit", "SPDX-License-Identifier: (MIT OR Apache-2.0)"),
]
NEAR_MISSES = [
    "Licensed under the Foo License, Version 2.0",
    "Released under the Parity Public License 7.0",
    "SPDX-License-Identifier: LicenseRef-Proprietary",
    "SPDX-License-Identifier: SSPL-1.0",
    "The MIT License is popular among students.",
    "We discussed the Apache License, Version 2.0 at length over dinner.",
    "A talk about the GNU General Public License and the people behind it",
    "This program is free software; you can redistribute it and/or modify it under",
    "This program is free software in spirit, and you can modify it under the table",
    "He worked under the MIT roof for years.",
    "The Apache helicopter was released under the cover of night.",
    "She was licensed under the state board to practise medicine.",
    "The permission was granted, free of charge, to any person who asked for a copy of the book.",
    "Permission to use the pool is hereby granted to guests for any purpose.",
    "Redistribution of wealth and use of source and binary forms differ.",
    "This work is licensed under a Creative Commons",
    "Creative Commons Attribution is a topic of its own.",
    "Released into the public domain by its painter",
    "The software is provided by the vendor as is, under contract.",
    "Mozilla Public License talk at four o'clock",
    "All rights reserved. No part may be reproduced without permission.",
    "published under the terms of the settlement",
    "distributed under the terms of the treaty of Lisbon",
    "available under the counter, without warranty",
    "licensed under seal by the general public notary",
    "The GPL and the LGPL differ in linking.",
    "You may obtain a copy of the menu at the bar",
    "Anyone is free to copy this recipe.",
    "Licensed under the General Aviation Act, version 3",
    "released under the ISC group's banner",
    "The boost software of the engine was licensed under a patent",
    "under the BSD umbrella, many daemons run",
    "CC BY the way: licensed under nobody",
]


@pytest.fixture(scope="module")
def model():
    return license_scan.train([])


def families(model, text):
    return ",".join(sorted({f for _, f, _ in license_scan.notices_of(model, text.encode())[1]}))


def test_stated_licenses_are_told_apart(model):
    assert len(STATED) + len(NEAR_MISSES) >= 60
    assert [(want, t) for want, t in STATED if families(model, t) != want] == []


def test_near_misses_confirm_nothing(model):
    assert [(families(model, t), t) for t in NEAR_MISSES if families(model, t)] == []


def test_every_template_is_found_alone_and_among_others(model):
    lost = [(t.family, t.words) for t in model.templates if t.frame == 0 or t.words[0] == b"licensed" if families(model, b" ".join(t.words).decode()) != t.family]
    assert len(lost) <= 0.03 * len(model.templates), lost


def plain(model, text):
    """Families of all windows that hold enough of a template and are classified as its family, tried one by one."""
    found = set()
    for words, _, _ in license_scan.blocks_of(text.encode().split(b"\n")):
        for t in model.templates:
            for i in range(len(words) - 1):
                for j in range(i + 2, min(len(words), i + 2 * len(t.pairs) + license_scan.SLACK + 2) + 1):
                    held = words[i:j]
                    if t.held_by(t.pairs & set(license_scan.pairs_of(held))):
                        if model.classify(held)[0] == t.family:
                            found.add(t.family)
                        break
    return ",".join(sorted(found))


def test_scan_equals_a_plain_search(model):
    texts = [t for _, t in STATED if "SPDX" not in t and " or the " not in t] + NEAR_MISSES
    joined = ["Some words go before. " + t + "\nand some after it" for t in texts[::3]]
    assert [t for t in texts + joined if "SPDX" not in t and families(model, t) != plain(model, t)] == []


def test_two_templates_alike_give_one_family(model):
    text = b"licensed under the gnu general public license version 2"
    n, found = license_scan.notices_of(model, text)
    assert (n, [(k, f) for k, f, _ in found]) == (1, [(0, "gpl")])
    assert [(k, f) for k, f, _ in license_scan.notices_of(model, text + b"\n" + text)[1]] == [(0, "gpl"), (1, "gpl")]


#: Statements that follow none of the frames, and headings, as texts of many kinds have them.
OTHER_STATED = [
    ("mit", "This file is under the MIT license"), ("epl", "The author licenses this under the Eclipse Public License v2.0"), ("mit", "MIT License"), ("mit", "The MIT License"), ("mit", "License: MIT"), ("mit", "# License\n\nMIT License"),
    ("gpl", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007"), ("gpl", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"), ("apache-2.0", "Apache License Version 2.0, January 2004"), ("apache-2.0", "Apache License, Version 2.0"),
    ("mit", "Use is subject to the terms of the MIT license"), ("gpl", "Covered by the GNU General Public License"), ("gpl", "This module is covered by the GPL version 3"), ("apache-2.0,mit", "License: MIT OR Apache-2.0"), ("bsd", "The code is under the BSD 3-Clause License"),
    ("bsd", "BSD 2-Clause License"), ("bsd", "BSD 3-Clause License\n\nCopyright (c) 2019"), ("isc", "ISC License"), ("isc", "License: ISC"), ("lgpl", "GNU LESSER GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007"), ("agpl-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE\n Version 3, 19 November 2007"),
    ("mpl-2.0", "Mozilla Public License, Version 2.0"), ("mpl-2.0", "Mozilla Public License Version 2.0"), ("epl", "Eclipse Public License 2.0"), ("cc0", "CC0 1.0 Universal"), ("unlicense", "License: Unlicense"), ("zlib", "zlib License"), ("boost", "Boost Software License, Version 1.0"),
    ("boost", "Boost Software License - Version 1.0"), ("artistic", "Artistic License 2.0"), ("artistic", "The library is governed by the Artistic License"), ("apache-2.0", "It is made available to you under the Apache License 2.0"), ("lgpl", "The runtime is under the LGPL, the tools are not."),
    ("agpl-3.0", "All server code is under the GNU Affero General Public License"), ("mpl-2.0", "These files are governed by the Mozilla Public License 2.0"), ("cc-by-sa", "Our articles are under the Creative Commons Attribution-ShareAlike License"), ("cc-by", "Figures are under a Creative Commons Attribution 4.0 International License"),
    ("ofl", "SIL OPEN FONT LICENSE Version 1.1"), ("ofl", "All glyphs are under the SIL Open Font License, Version 1.1"), ("cddl", "The file is subject to the terms of the Common Development and Distribution License"), ("eupl", "Der Code steht under the European Union Public Licence"), ("gfdl", "This manual is under the GNU Free Documentation License"),
    ("mit", "license = MIT"), ("bsd", "License: BSD-3-Clause"), ("gpl", "license: GPL-3.0-or-later"), ("mit", "License :: OSI Approved :: MIT License"), ("apache-2.0", "The samples are governed by the Apache License, Version 2.0"), ("psf", "Parts are under the Python Software Foundation License"),
    ("odbl", "The data set is under the Open Database License"), ("lgpl", "You may link it under the terms of the GNU Lesser General Public License"), ("wtfpl", "License: WTFPL"), ("mit", "Every example here is used under the terms of the MIT License"),
]
OTHER_MISSES = [
    "This is not licensed under the MIT License", "It was never released under the GNU General Public License", "The code is not under the MIT license", "The build isn't licensed under the Apache License, Version 2.0", "The engine is no longer distributed under the GNU General Public License",
    "Licensed under the Apache License, Version 3.0", "License: Proprietary", "License: see the file COPYING", "License: none", "MIT Press", "MIT License plates are sold here", "Apache", "Public License", "General License", "Version 2.0, January 2004", "GNU",
    "The MIT Licensing Office opened in 1945", "Why the MIT License won", "MIT License versus Apache License, Version 2.0: a comparison of both texts", "GNU General Public License explained in ten short chapters", "A licence to kill", "Driving license", "License and registration, please",
    "Fishing License, Version 2.0", "License: valid until June 2007", "the terms of the loan", "under the general public", "under the license plate", "covered by the insurance", "governed by the council", "subject to the terms of the lease", "Foo Public License Version 2.0", "Foo License",
    "SPDX is a list of names.", "Common Development of land", "European Union Public Procurement", "Creative Commons", "Boost your software", "Artistic freedom", "Free Documentation for all", "Open Database conference, version 1.1", "Eclipse of the sun, public viewing", "Mozilla Public talk",
    "the isc is a council", "zlib is a library", "Unlicensed spectrum", "The bsd daemon", "We compared the Eclipse Public License 2.0 with others.", "Contributors asked about the CC0 waiver.", "The GPL FAQ answers questions.",
]


def test_other_forms_and_headings(model):
    assert len(STATED) + len(OTHER_STATED) + len(NEAR_MISSES) + len(OTHER_MISSES) >= 160
    found = [(want, families(model, t), t) for want, t in OTHER_STATED]
    lost = [(w, g, t) for w, g, t in found if g != w]
    assert [(w, g, t) for w, g, t in lost if set(g.split(",")) - {""} - set(w.split(","))] == []
    assert len(lost) <= 0.1 * len(OTHER_STATED), lost


def test_other_near_misses(model):
    assert [(families(model, t), t) for t in OTHER_MISSES if families(model, t)] == []


def test_likely_families_without_a_template_are_told(model):
    *_, likely = license_scan.scanned(model, b"Licensed under the Apache License, Version 3.0")
    assert likely == {"apache-2.0"}
    assert license_scan.scanned(model, b"The weather is fine under the sun.")[2] == set()


def test_windows_that_are_ruled_out_have_no_family(model):
    for text in [t for _, t in STATED + OTHER_STATED] + NEAR_MISSES + OTHER_MISSES:
        words = license_scan.words_of(text.encode())[: license_scan.WINDOW]
        p = dict(zip(model.families, model.probabilities(words), strict=True))
        least = license_scan.LOOSE * p.pop(license_scan.UNKNOWN)
        assert model.predicted(words) == {f: v for f, v in p.items() if v >= least}

import random
from pathlib import Path

import pytest

from llm.license_scan import licenses, matched, query, scan
from llm.license_sentences import NAMES, RULES, SENTENCES

MIT = """Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED.
IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM.
"""
GPL = """# This program is free software: you can redistribute it and/or modify it under the
# terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
# This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY.
# You should have received a copy of the GNU General Public License along with this program.
"""


def test_rules():
    names = lambda t: scan(t)[0]
    assert names(MIT) == ["MIT"]
    assert names(GPL) == ["GPL-3.0+"]
    assert names("Licensed under CC BY-NC 4.0.") == ["CC-BY-NC-4.0"]
    assert names("This work is licensed under the GNU General Public License, version 3.") == ["GPL-3.0"]
    assert names("a b.\nLicensed under the Apache License, Version 2.0.\nc") == ["Apache-2.0"]
    assert names("Released under the MIT License. x\nAll rights reserved.") == ["MIT", "proprietary"]
    assert names("// SPDX-License-Identifier: BSD-3-Clause") == ["BSD-3-Clause"]
    assert names("# SPDX-License-Identifier: Apache-2.0 OR GPL-2.0-or-later") == ["Apache-2.0 OR GPL-2.0-or-later"]
    assert names("Released under the MIT Licence.\nReleased under the MIT License.") == ["MIT"]
    assert names("my driving license has expired") == [] and scan("Your license is odd.")[2] == 1
    # the notice alone, out of order, makes no license
    assert names("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.") == []


APACHE = """Copyright 2020 Someone

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
GNU = """This {0} is free software{1} you can redistribute it and/or
modify it under the terms of the GNU {2}General Public License as published
by the Free Software Foundation{3} either version {4} of the License, or
(at your option) any later version.

This {0} is distributed in the hope that it will be useful, but WITHOUT ANY
WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR
A PARTICULAR PURPOSE.  See the GNU {2}General Public License for more details.

You should have received a copy of the GNU {2}General Public License along
with this {0}.  If not, see <https://www.gnu.org/licenses/>.
"""


def test_published_headers():
    five = ["Apache-2.0", "Apache-may-not-use", "Apache-obtain", "Apache-as-is", "Apache-see"]
    assert scan(APACHE) == (["Apache-2.0"], five, 0)
    for sign in ("# ", " * ", "// "):
        assert scan("".join(f"{sign}{x}\n" for x in APACHE.split("\n")))[:2] == (["Apache-2.0"], five)
        assert scan("".join(f"{sign}{x}\n" for x in APACHE.replace("\n\nLic", "\nLic").split("\n")))[0] == ["Apache-2.0"]
    for words, want in ((("program", ";", "", ";", "2"), "GPL-2.0+"), (("program", ":", "", ",", "3"), "GPL-3.0+"), (("library", ";", "Lesser ", ";", "2.1"), "LGPL-2.1+"), (("library", ";", "Library ", ";", "2"), "LGPL-2.0+"), (("program", ":", "Affero ", ",", "3"), "AGPL-3.0+")):
        assert scan(GNU.format(*words))[0] == [want]


BSD = """Copyright (c) 2011, Some Body
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

{0}1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.
{0}2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{1}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY.
"""
ENDORSE = """3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.
"""
ISC = """Copyright (c) 2019 Some Body

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted{0}.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS
OF USE, DATA OR PROFITS.
"""
BOOST = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:

The copyright notices in the Software and this entire statement, including
the above license grant, this restriction and the following disclaimer,
must be included in all copies of the Software, in whole or in part, and
all derivative works of the Software, unless such copies or derivative
works are solely in the form of machine-executable object code generated by
a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT
SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE
FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE.
"""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.
"""
MPL = """/* ***** BEGIN LICENSE BLOCK *****
 * This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */
"""


def test_short_texts():
    names = lambda t: scan(t)[0]
    for bullet in ("", "  ", " * "):
        assert names(BSD.format(bullet, ENDORSE)) == ["BSD-3-Clause"]
    assert names(BSD.format("", "")) == ["BSD-2-Clause"]
    advertising = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement:\n   This product includes software developed by Some Body.\n"
    assert names(BSD.format("", advertising + ENDORSE.replace("3.", "4."))) == ["BSD-4-Clause"]
    assert names(ISC.format(", provided that the above\ncopyright notice and this permission notice appear in all copies")) == ["ISC"]
    assert names(ISC.format("")) == ["0BSD"]
    assert names(BOOST) == ["BSL-1.0"] and names(ZLIB) == ["Zlib"] and names(MPL) == ["MPL-2.0"]
    for comment in ("# ", "// ", " * ", "-- ", "; "):
        for text, want in ((BOOST, "BSL-1.0"), (ZLIB, "Zlib"), (MIT, "MIT"), (ISC.format(""), "0BSD")):
            assert names("".join(f"{comment}{x}\n" for x in text.split("\n"))) == [want], (comment, want)
    # rights are reserved for good only where no text grants any
    assert names("Copyright 2020 Some Body. All rights reserved.") == ["proprietary"]
    assert names("The report was issued.\nHas anyone seen it?") == [] and scan("The report was issued.")[2] == 0


@pytest.mark.parametrize("name, want", [("Apache-2.0", "Apache-2.0"), ("BSD", "BSD-3-Clause"), ("GPL-1", "GPL-1.0"), ("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2", "LGPL-2.0"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3", "LGPL-3.0"), ("MPL-1.1", "MPL-1.1"), ("MPL-2.0", "MPL-2.0"), ("GFDL-1.3", "GFDL-1.3"), ("Artistic", "Artistic-1.0"), ("CC0-1.0", "CC0-1.0")])
def test_full_texts(name, want):
    path = Path("/usr/share/common-licenses") / name
    if not path.exists():
        pytest.skip("no such text here")
    text = path.read_text(encoding="utf-8")
    assert scan(text)[0] == [want]
    assert scan("".join(f" * {x}\n" for x in text.split("\n")))[0] == [want]


def test_statements():
    table = {
        "This project is licensed under the MIT License - see the LICENSE file for details.": "MIT",
        "Licensed under the Apache License 2.0.": "Apache-2.0",
        "This library is distributed under the terms of the GNU Lesser General Public License v2.1 or later.": "LGPL-2.1+",
        "Released under the GPLv3.": "GPL-3.0",
        "The code is available under the BSD 3-Clause License.": "BSD-3-Clause",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0",
        "Text is available at https://creativecommons.org/licenses/by-nc-nd/3.0/us/": "CC-BY-NC-ND-3.0",
        "Published under CC0 1.0 Universal.": "CC0-1.0",
        "License: ISC": None,
        "License: ISC License": "ISC",
        "Distributed under the Eclipse Public License v2.0": "EPL-2.0",
        "Distributed under the Boost Software License, Version 1.0.": "BSL-1.0",
        "This program is free software; you can redistribute it and/or modify it under the same terms as Perl itself.": "Artistic-1.0-Perl",
        "This work is in the public domain.": "public-domain",
        "my driving license has expired": None,
    }
    for text, want in table.items():
        assert scan(text)[0] == ([want] if want else []), text


def test_matching_against_brute_force():
    rnd = random.Random(3)
    for _ in range(500):
        rules = [(f"r{k}", [rnd.choice("abc") for _ in range(rnd.randint(1, 3))]) for k in range(rnd.randint(1, 6))]
        ids = [rnd.choice("abcd") for _ in range(rnd.randint(0, 12))]
        left, want = list(ids), []
        for name, sequence in rules:
            i = 0
            while i <= len(ids) - len(sequence):
                if left[i : i + len(sequence)] == sequence:
                    want.append((i, i + len(sequence), name))
                    left[i : i + len(sequence)] = [None] * len(sequence)
                i += 1
        assert matched(ids, rules) == want


def test_every_rule_names_known_sentences():
    names = {x for x, _ in NAMES} | {x for x, _ in SENTENCES}
    assert all(x in names for _, sequence in RULES for x in sequence)
    assert len(NAMES) + len(SENTENCES) > 100


def test_hints_and_long_notices():
    assert scan(GPL)[:2] == (["GPL-3.0+"], ["GPL-free-software-later", "GNU-hope", "GNU-received"])
    assert scan("word " * 30 + "All rights reserved.")[0] == ["proprietary"]
    assert scan("word " * 30 + "is released into the public domain.")[0] == ["public-domain"]


def test_edges(spark):
    rows = [(1, None, "z"), (2, "", "z"), (3, "x " * 200_000 + "\nReleased under the MIT License.", "z"), (None, "Released under the MIT License.", "z"), (4, "plain", "z"), (4, "plain", "z")]
    got = [(r.doc_id, list(r.licenses)) for r in licenses(spark.createDataFrame(rows, "doc_id long, text string, licenses string")).collect()]
    assert got == [(1, []), (2, []), (3, ["MIT"]), (None, ["MIT"]), (4, []), (4, [])]
    assert licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_documents(spark):
    sf = "/root/testdata/sf0.01"
    lines = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "All rights reserved.": "proprietary"}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in query(spark, sf).collect():
        want = {v for k, v in lines.items() if k in texts[r.doc_id]}
        assert set(filter(None, r.licenses.split(","))) == want

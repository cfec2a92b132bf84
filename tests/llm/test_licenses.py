"""Canonical notices, plain and in comments of several languages, full texts' heads, and SPDX expressions."""

import pytest
from test_cases import MIT, docs, rows

from dossier.llm import licenses

APACHE = """Copyright 2020 A Company

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
BSD = """Copyright (c) 2019, A Person
All of it is as follows.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{endorse}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ENDORSE = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
LGPL = GPL.replace("This program", "This library").replace("this program", "this library").replace("GNU General", "GNU Lesser General").replace("version 3", "version 2.1")
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
NOTICES = [
    (APACHE, "Apache-2.0"), ("The MIT License (MIT)\n\nCopyright (c) 2020 X\n\n" + MIT, "MIT"), (BSD.format(endorse=ENDORSE), "BSD-3-Clause"), (BSD.format(endorse=""), "BSD-2-Clause"),
    (GPL, "GPL-3.0-or-later"), (LGPL, "LGPL-2.1-or-later"), (MPL, "MPL-2.0"),
]


@pytest.mark.parametrize("first, each, last", [("", "", ""), ("", "// ", ""), ("#!/bin/sh\n", "# ", ""), ("/*\n", " * ", "\n */"), ("", "-- ", ""), ("<!--\n", "", "\n-->")])
def test_notices_in_comments(spark, first, each, last):
    dress = lambda t: "code before\n" + first + "\n".join(f"{each}{line}".rstrip() for line in t.split("\n")) + last + "\nint main() {}"
    got = rows(licenses.scan_licenses(docs(spark, *[dress(t) for t, _ in NOTICES])))
    assert [(r["licenses"], r["n_unmatched"]) for r in got] == [([name], 0) for _, name in NOTICES]


def test_full_texts_by_their_heads(spark):
    texts = [
        "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions.",
        "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999\n\n", "GNU GENERAL PUBLIC LICENSE\n  Version 2, June 1991\n\nx", "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions",
    ]
    got = rows(licenses.scan_licenses(docs(spark, *texts)))
    assert [(r["licenses"], r["n_unmatched"]) for r in got] == [(["Apache-2.0"], 0), (["GPL-3.0-only"], 0), (["LGPL-2.1-only"], 0), (["GPL-2.0-only"], 0), (["MPL-2.0"], 0)]


def test_spdx_expressions(spark):
    texts = ["// SPDX-License-Identifier: MIT OR Apache-2.0", "SPDX-License-Identifier: BSD-2-Clause\n", "/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) AND MIT */", "# SPDX-License-Identifier: Unheard-Of-1.0", "x = 1\n# SPDX-License-Identifier: LGPL-3.0-or-later\ny", "SPDX-License-Identifier: MIT\nAll rights reserved."]
    got = rows(licenses.scan_licenses(docs(spark, *texts)))
    assert [r["licenses"] for r in got] == [["Apache-2.0", "MIT"], ["BSD-2-Clause"], ["GPL-2.0-only", "MIT"], [], ["LGPL-3.0-or-later"], ["MIT", "all-rights-reserved"]]
    assert [r["license_class"] for r in got][2:4] == ["copyleft", "none"]

"""Standard notices in their usual layout."""

import pytest

from loomledger.llm import licenses

FSF = """This {what} is free software{mark} you can redistribute it and/or modify
it under the terms of the GNU {kind}General Public License as published by
the Free Software Foundation{cut} either version {v} of the License, or
(at your option) any later version.

This {what} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""
LGPL_21 = """ * This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version.
 *
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM.
"""
ISC = """Copyright (c) 2020 Someone

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS.
"""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */
"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.
"""
#: Text, licences, known sentences.
NOTICES = {
    "gpl3": (FSF.format(what="program", mark=":", kind="", cut=",", v=3), "GPL-3.0-or-later", 2),
    "gpl2": (FSF.format(what="program", mark=";", kind="", cut=";", v=2), "GPL-2.0-or-later", 3),
    "agpl3": (FSF.format(what="program", mark=":", kind="Affero ", cut=",", v=3), "AGPL-3.0-or-later", 2),
    "lgpl3": (FSF.format(what="library", mark=":", kind="Lesser ", cut=",", v=3), "LGPL-3.0-or-later", 2),
    "lgpl21": (LGPL_21, "LGPL-2.1-or-later", 3),
    "gpl3 in comments": ("".join(f"# {line}\n" for line in FSF.format(what="program", mark=":", kind="", cut=",", v=3).split("\n")), "GPL-3.0-or-later", 2),
    "apache": (APACHE, "Apache-2.0", 4),
    "apache in comments": ("".join(f" * {line}".rstrip() + "\n" for line in APACHE.split("\n")), "Apache-2.0", 4),
    "apache, windows": (APACHE.replace("\n", "\r\n"), "Apache-2.0", 4),
    "mit": (MIT, "MIT", 4),
    "isc": (ISC, "ISC", 2),
    "mpl": (MPL, "MPL-2.0", 1),
    "unlicense": (UNLICENSE, "Unlicense", 2),
    "as-is below a line": ("Someone 2020\n" + MIT[MIT.index("THE SOFT") :].split(" IN NO")[0], "", 1),
    "spdx": ("// SPDX-License-Identifier: MIT\n// Copyright\nint x;", "MIT", 1),
    "spdx or": ("/* SPDX-License-Identifier: (GPL-2.0+ OR BSD-3-Clause) */\n", "GPL-2.0-or-later,BSD-3-Clause", 2),
    "spdx with": ("# SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note\n", "GPL-2.0-only", 1),
    # Lines without end marks are sentences of their own where joining them makes none.
    "lines": ("My project\nLicensed under the MIT License\nTHE MIT LICENSE\nALL RIGHTS RESERVED\nNothing else\n", "MIT", 3),
    "no tag": ("mit\nISC\nGPL-3.0-only", "", 0),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, text) for i, (text, _, _) in enumerate(NOTICES.values())]
    return {list(NOTICES)[r.doc_id]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


@pytest.mark.parametrize("name", NOTICES)
def test_notice(found, name):
    assert (found[name].licenses, found[name].n_sentences) == NOTICES[name][1:]

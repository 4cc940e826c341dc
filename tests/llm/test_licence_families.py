"""Licence texts with other holders, families, grants and near misses; Spark against the SQL on all of them."""

import duckdb
import pyarrow as pa
import pytest

from loomledger.llm import licenses
from test_licence_notices import APACHE, ISC, MIT, NOTICES, UNLICENSE

BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
NAMES = """
3. Neither the name of {} nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
ADVERTISING = """
3. All advertising materials mentioning features or use of this software
   must display the following acknowledgement:
     This product includes software developed by {}.
"""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In
no event will the authors be held liable for any damages arising from the use of
this software.

Permission is granted to anyone to use this software for any purpose, including
commercial applications, and to alter it and redistribute it freely, subject to
the following restrictions:

1. The origin of this software must not be misrepresented.
"""
BSL = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:
"""
EPL = """This program and the accompanying materials are made available under the
terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/
"""
HOLDERS = ("the University", "Google Inc.", "the copyright holder", "The Example Foundation, Ltd.", "Foo Corp. GmbH", "the Regents of the University of X", "J. R. Dev")
COMMENT = "".join
TEXTS = {
    **{f"bsd3 {h}": (BSD2 + NAMES.format(h), "BSD-3-Clause") for h in HOLDERS},
    **{f"bsd4 {h}": (BSD2 + ADVERTISING.format(h) + NAMES.format(h).replace("3.", "4."), "BSD-4-Clause") for h in HOLDERS[:3]},
    "bsd2": (BSD2, "BSD-2-Clause"),
    "bsd2 windows": (BSD2.replace("\n", "\r\n"), "BSD-2-Clause"),
    "bsd3 in comments": (COMMENT(f" * {line}\n" for line in (BSD2 + NAMES.format("Acme Inc.")).split("\n")), "BSD-3-Clause"),
    "bsd3 author": (BSD2 + "\n3. The name of the author may not be used to endorse or promote products\n   derived from this software without specific prior written permission.\n", "BSD-3-Clause"),
    "zlib": (ZLIB, "Zlib"),
    "boost": (BSL, "BSL-1.0"),
    "boost notice": ("// Distributed under the Boost Software License, Version 1.0.\n// (See accompanying file LICENSE_1_0.txt)\n", "BSL-1.0"),
    "eclipse": (EPL, "EPL-2.0"),
    "eclipse 1": (EPL.replace("License 2.0 which is available at\nhttps://www.eclipse.org/legal/epl-2.0/", "License v1.0 which accompanies this distribution"), "EPL-1.0"),
    "cc0 waiver": ("To the extent possible under law, Some One has waived all copyright and related or neighboring rights to Some Work.", "CC0-1.0"),
    "mit titled": ("The MIT License (MIT)\n\n" + MIT.split("\n", 2)[2], "MIT"),
    "mit title alone": ("The MIT License (MIT)", "MIT"),
    "apache title": ("Apache License, Version 2.0\n\n" + APACHE, "Apache-2.0"),
    "isc": ("ISC License\n\n" + ISC, "ISC"),
    "unlicense": (UNLICENSE, "Unlicense"),
    "grants": ("Licensed under the Apache License 2.0.\n\nDistributed under the MIT license.\n\nThis tool is released under the terms of the GNU General Public License v3.0 or later.", "Apache-2.0,MIT,GPL-3.0-or-later"),
    "gpl names": ("Available under the GPLv3.\n\nAvailable under the GNU GPL v2 only\n\nlicensed under the LGPL-2.1 license", "GPL-3.0-only,GPL-2.0-only,LGPL-2.1-only"),
    "dual": ("Licensed under either of Apache License, Version 2.0 or MIT license at your option.", "Apache-2.0,MIT"),
    "dual and": ("The code is dual licensed under the MIT license and the BSD 3-Clause License.", "MIT,BSD-3-Clause"),
    "creative": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
    "british": ("Licenced under the Mozilla Public Licence, v. 2.0.", "MPL-2.0"),
    "long spdx": ("# SPDX-License-Identifier: MIT AND " + " AND ".join(f"(Apache-2.0 OR BSD-{2 + i % 2}-Clause)" for i in range(30)), ",".join(["MIT"] + [f"Apache-2.0,BSD-{2 + i % 2}-Clause" for i in range(30)])),
    "spdx exception": ("// SPDX-License-Identifier: GPL-2.0+ WITH Classpath-exception-2.0 OR MIT", "GPL-2.0-or-later,MIT"),
}
MISSES = {
    "denied": "This is not licensed under the MIT license.",
    "past": "Version 1 was previously released under the MIT License.",
    "condition": "Unless you are licensed under the Apache License 2.0, stop.",
    "other name": "Licensed under the Foo License.",
    "no version": "Licensed under the Apache helicopter license.",
    "plates": "MIT license plates are rare.",
    "part": "Redistribution and use in source and binary forms are discussed below.",
    "permission": "Permission is hereby granted to enter the building.",
    "tag of nothing": "SPDX-License-Identifier: LicenseRef-own",
    "neither": "Neither the name of the rose nor the names of its thorns matter.",
    "software": "The software is provided with a manual and a warranty.",
    "version 9": "Licensed under the GNU General Public License version 9.",
    "names alone": NAMES.format("Google Inc."),
}


@pytest.fixture(scope="module")
def both(spark):
    texts = {**{k: v for k, (v, *_) in NOTICES.items()}, **{k: v for k, (v, _) in TEXTS.items()}, **MISSES, "null": None, "long": "word " * 300_000 + "\n\n" + BSD2 + NAMES.format("Acme Inc.")}
    rows = list(enumerate(texts.values()))
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    duck = duckdb.connect()
    duck.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}))
    sql = {r[0]: r for r in duck.sql(licenses.oracle_sql()).fetchall()}
    return {list(texts)[r.doc_id]: (tuple(r), sql[r.doc_id]) for r in got}


@pytest.mark.parametrize("name", [*NOTICES, *TEXTS, *MISSES, "null", "long"])
def test_sql_and_spark_agree(both, name):
    assert both[name][0] == both[name][1]


@pytest.mark.parametrize("name", TEXTS)
def test_text(both, name):
    assert both[name][0][1] == TEXTS[name][1]


@pytest.mark.parametrize("name", MISSES)
def test_near_miss(both, name):
    assert both[name][0][1] == ""


def test_the_rest(both):
    assert both["null"][0][1:] == ("", 0, 0, 0) and both["long"][0][1] == "BSD-3-Clause"


def test_nothing_leaves_the_jvm(spark, sf_dir):
    df = licenses.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan

import duckdb
import pytest

from capacast.llm import licences
from capacast.llm.queries import ORACLE_SQL, QUERIES
from tools.compare import connect, difference

from . import brute

DOCS = "doc_id bigint, text string"
MIT = """Copyright (c) 2020 Somebody

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
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
"""


def found(spark, texts):
    rows = licences.recognise(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()
    return {r.doc_id: (r.licence, r.rule, r.licences, r.sentences) for r in rows}


def test_rules(spark):
    got = found(spark, [
        MIT, "Some prose.\nReleased under the MIT License.", "licensed UNDER the Apache License, Version 2.0!",
        "All rights reserved. Licensed under CC BY-NC 4.0.", "This program is free software: go on.",
        "no such thing as rights reserved", "It is released under the MIT License in part.",
        MIT.split("THE SOFTWARE")[0], "\n\n".join(reversed(MIT.split("\n\n")))])
    assert got[0][:3] == ("MIT", "mit-text", "MIT")
    assert got[1] == ("MIT", "mit-ref", "MIT", "|mit-ref|")
    assert got[2][:2] == ("Apache-2.0", "apache2-ref")
    assert got[3] == ("CC-BY-NC-4.0", "cc-by-nc4-ref", "CC-BY-NC-4.0,proprietary", "|all-rights|cc-by-nc4-ref|")
    assert got[4] == ("unrecognised", "none", "", "|gpl-free|")
    assert 5 not in got and 6 not in got
    assert got[7][1] == "mit-grant"
    assert got[8][0] == "unrecognised"  # all sentences, but out of order


def test_every_sentence_has_a_cue_and_is_normalised():
    import re
    for sentence in licences.identifiers():
        assert re.search(licences.CUES, sentence)
        assert re.sub("[^a-z0-9]+", " ", sentence).strip() == sentence
    for _, _, sequence in licences.RULES:
        assert set(sequence) <= set(licences.SENTENCES) | set(licences.references().values())


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_equal_to_sql(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    name = "op5_licence_rules"
    assert difference(QUERIES[name](spark, folder), connect(folder), ORACLE_SQL[name]) == ""


def test_sql_agrees_on_texts_with_several_sentences(spark):
    texts = [MIT, MIT.replace("\n\n", ".\n"), "All rights reserved.  All rights reserved;\nreleased under the MIT license",
             "All\nrights reserved. Licensed under CC BY 4.0", None, ""]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    assert difference(licences.recognise(docs), con, ORACLE_SQL["op5_licence_rules"]) == ""


def test_odd_rows_and_native_plan(spark):
    docs = brute.odd_documents(spark)
    assert licences.recognise(docs).count() == 0
    assert licences.recognise(brute.empty_documents(spark)).count() == 0
    twice = spark.createDataFrame([(None, "All rights reserved")] * 2, DOCS)
    assert [tuple(r)[:2] for r in licences.recognise(twice).collect()] == [(None, "proprietary")] * 2
    plan = licences.recognise(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


GNU = """This {what} is free software; you can redistribute it and/or
modify it under the terms of the GNU {name} as published by the
Free Software Foundation; either version {version} of the License, or
(at your option) any later version.

This {what} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
NOTICES = [
    ("MIT", "SPDX-License-Identifier: MIT"), ("MIT", "// SPDX-License-Identifier: MIT OR Apache-2.0"),
    ("MIT", "This file is released under the MIT License."), ("MIT", "Licensed under the MIT license (see LICENSE)."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Licensed under the MIT License. See LICENSE in the project root for license information."),
    ("MIT", "Released under the Expat License"), ("MIT", "All code is available under MIT."), ("MIT", MIT),
    ("MIT", "The library is made available under the MIT licence, which is found in the file COPYING."),
    ("Apache-2.0", "/* SPDX-License-Identifier: Apache-2.0 */"),
    ("Apache-2.0", "# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in "
                   "compliance with the License.\n"),
    ("Apache-2.0", "This software is licensed under the Apache 2 license."),
    ("Apache-2.0", "Distributed under the terms of the Apache License 2.0"),
    ("Apache-2.0", "The project is released under version 2.0 of the Apache License."),
    ("GPL-2.0-or-later", GNU.format(what="program", name="General Public License", version="2")),
    ("GPL-3.0-or-later", GNU.format(what="program", name="General Public License", version="3").replace(";", ",", 3)),
    ("LGPL-2.1-or-later", GNU.format(what="library", name="Lesser General Public License", version="2.1")),
    ("LGPL-2.0-or-later", GNU.format(what="library", name="Library General Public License", version="2")),
    ("LGPL-3.0-or-later", GNU.format(what="library", name="Lesser General Public License", version="3")),
    ("AGPL-3.0-or-later", GNU.format(what="program", name="Affero General Public License", version="3")),
    ("GPL-2.0-or-later", " * " + GNU.format(what="file", name="General Public License", version="2").replace("\n", "\n * ")),
    ("GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only"), ("GPL-2.0-or-later", "SPDX-License-Identifier: GPL-2.0+"),
    ("GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "// SPDX-License-Identifier: GPL-2.0 WITH Linux-syscall-note"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License version 3."),
    ("GPL-3.0", "Licensed under the GNU GPL v3."), ("GPL-3.0", "Released under GPLv3"),
    ("GPL-2.0", "This script is distributed under version 2 of the GNU General Public License (GPL)."),
    ("GPL-2.0-or-later", "Licensed under GPLv2+"), ("GPL-2.0-or-later", "Licensed under the GPL version 2 or later."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License v3.0."),
    ("LGPL-2.1", "Licensed under the LGPL 2.1"), ("AGPL-3.0", "Licensed under AGPLv3."),
    ("AGPL-3.0-only", "<!-- SPDX-License-Identifier: AGPL-3.0-only -->"),
    ("MPL-2.0", "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the "
                "MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"), ("MPL-2.0", "Licensed under the Mozilla Public License 2.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License "
                "2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License "
                "v1.0 which accompanies this distribution"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at "
                "http://www.boost.org/LICENSE_1_0.txt)"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby "
            "granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n"),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby "
             "granted.\n"),
    ("ISC", "Licensed under the ISC License."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
             "liable.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial "
             "applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:\n"),
    ("Zlib", "Released under the zlib/libpng license."),
    ("Unlicense", "This is free and unencumbered software released into the public domain.\n"),
    ("Unlicense", "SPDX-License-Identifier: Unlicense"),
    ("CC0-1.0", "To the extent possible under law, the author(s) have waived all copyright and related or neighboring rights to "
                "this software."),
    ("CC0-1.0", "Released under CC0 1.0."), ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-3.0", "Text is available under the Creative Commons Attribution-ShareAlike License 3.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0"),
    ("CC-BY-NC-ND-4.0", "This article is distributed under the terms of the Creative Commons "
                        "Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    ("BSD-2-Clause", BSD2),
    ("BSD-3-Clause", BSD2 + "3. Neither the name of Foo Inc. nor the names of its contributors may be used to endorse or promote "
                            "products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Licensed under the 3-Clause BSD License."),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("proprietary", "Copyright (c) 2020 Foo, all rights reserved."), ("proprietary", "Copyright 2021 Bar Ltd. All Rights Reserved."),
]
OTHERS = ["The ship was covered by ice.", "Coffee is provided by MIT.", "It is not licensed under the MIT license.",
          "The driver was licensed in 1999.", "It is released under the MIT License in part.", "as is well known, no rights",
          "Ask about the GPL before you copy", "licensed under", "SPDX-License-Identifier:", "Copyright 1999 is over"]


def test_public_notices(spark):
    """Recall over public notices, and sentences that only look like one."""
    got = found(spark, [text for _, text in NOTICES] + OTHERS)
    missed = [(want, got.get(i, [None])[0], text) for i, (want, text) in enumerate(NOTICES) if got.get(i, [None])[0] != want]
    assert len(NOTICES) >= 60 and len(missed) <= 0.1 * len(NOTICES), missed
    assert missed == []
    assert [OTHERS[i - len(NOTICES)] for i in got if i >= len(NOTICES)] == []


def test_public_notices_equal_to_sql(spark):
    texts = [text for _, text in NOTICES] + OTHERS
    texts += ["\n".join(texts), "\r\n\r\n".join(texts), "\u4f60\u597d\n\u4f60\n" + MIT.replace("\n", "\r\n# ")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    assert difference(licences.recognise(docs), con, ORACLE_SQL["op5_licence_rules"]) == ""


def test_alternatives_are_all_named(spark):
    got = found(spark, ["SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause",
                        "Licensed under either the MIT license or the Apache License, Version 2.0."])
    assert got[0][2:] == ("MIT,Apache-2.0,BSD-3-Clause", "|mit-ref|apache2-ref|bsd3-clause-ref|")
    assert got[1][2] == "MIT,Apache-2.0"


def test_every_name_is_read_back(spark):
    """Each name in the table is left alone by the patterns that lead to it."""
    names = licences.references()
    got = found(spark, [f"licensed under {name}" for name in names])
    assert [got.get(i, [None] * 4)[3] for i in range(len(names))] == [f"|{n}|" for n in names.values()]

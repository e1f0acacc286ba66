"""Licence texts as they stand in files: hard-wrapped, with comment marks."""

import textwrap

import pytest

from millrace.llm import licenses as L

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment would be appreciated."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
EXPECTED = {
    "mit": (MIT, "MIT", ["mit-permission", "mit-notice", "as-is"]),
    "bsd": (BSD, "BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse"]),
    "gpl": (GPL, None, ["gpl-free", "gpl-no-warranty"]),
    "apache": (APACHE, "Apache-2.0", ["apache-line-the", "apache-comply", "apache-obtain", "apache-unless"]),
    "lgpl": (GPL.replace("This program is free", "This library is free").replace("GNU General", "GNU Lesser General").replace("version 3", "version 2.1"), "LGPL-2.1", ["lgpl21-free", "gpl-no-warranty"]),
    "agpl": (GPL.replace("GNU General", "GNU Affero General"), "AGPL-3.0", ["agpl-free", "gpl-no-warranty"]),
    "zlib": (ZLIB, "Zlib", ["zlib-as-is", "zlib-permission", "zlib-origin"]),
    "unlicense": (UNLICENSE, "Unlicense", ["unlicense-line", "unlicense-anyone"]),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "MPL-2.0", None),
}


def wrapped(text, mark, width=60):
    return "\n".join(mark + line for part in text.split("\n\n") for line in [*textwrap.wrap(part, width), ""])


def scan(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    return {r.i: r for r in L.license_scan(df).collect()}


@pytest.mark.parametrize("name", EXPECTED)
def test_hard_wrapped_texts(spark, name):
    text, licence, ids = EXPECTED[name]
    marks = ["", "# ", " * ", "// ", ";; "]
    got = scan(spark, [text, *[wrapped(text, m) for m in marks], wrapped(text, "").replace("\n", "\r\n")])
    for r in got.values():
        assert ids is None or r.sentence_ids == ids
        assert (r.license == licence) if licence else r.license.startswith("GPL-3.0")


def test_lines_and_paragraphs(spark):
    got = scan(
        spark,
        [
            "The MIT License\n" + wrapped(MIT, ""),
            "MIT License\nnext line",
            "it is not the\nMIT License\n",
            "released under\n\nthe MIT\n\nlicense",
            "so released under the MIT\nlicense",
            "Licensed under the Apache License, Version 2.0 (the\n\"License\"); more",
            "x. Licensed under the MIT License. MIT License",
        ],
    )
    ids = {i: r.sentence_ids for i, r in got.items()}
    assert ids == {0: ["mit-title", "mit-permission", "mit-notice", "as-is"], 1: ["mit-title-2"], 2: ["mit-title-2"], 3: [], 4: [], 5: ["apache-line-the"], 6: ["mit-licensed", "mit-title-2"]}

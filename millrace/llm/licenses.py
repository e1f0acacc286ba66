"""License scan by sentence rules (DataFrame functions only).

A text is normalised once, and known licence sentences are found in it, on one line or
wrapped over several, where they stand between ends: marks, line ends or the text's.  The identifiers found, in text order, form a
sequence; ordered rules over such sequences name the licences.  Everything
happens inside the row: no shuffle, no Python.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.carried import Carried

# Licence sentences as their publishers word them, normalised
# (lower case, runs of other characters than letters and digits as one blank).
SENTENCES = {
    "mit-grant-line": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-title": "the mit license",
    "mit-title-2": "mit license",
    "mit-permission": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache-line": "licensed under the apache license version 2.0",
    "apache-line-the": "licensed under the apache license version 2.0 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-obtain": "you may obtain a copy of the license at",
    "gpl3-line": "this work is licensed under the gnu general public license version 3",
    "gpl3-line-2": "licensed under the gnu general public license version 3",
    "gpl2-line": "this work is licensed under the gnu general public license version 2",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-no-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl-line": "this work is licensed under the gnu lesser general public license version 3",
    "agpl-line": "this work is licensed under the gnu affero general public license version 3",
    "mpl-line": "this source code form is subject to the terms of the mozilla public license v",
    "mpl-line-2": "licensed under the mozilla public license version 2.0",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd3-line": "licensed under the bsd 3 clause license",
    "bsd2-line": "licensed under the bsd 2 clause license",
    "isc-permission": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "cc0-line": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "cc0-line-2": "released under cc0 1.0",
    "cc-by-line": "licensed under cc by 4.0",
    "cc-by-sa-line": "licensed under cc by sa 4.0",
    "cc-by-nc-line": "licensed under cc by nc 4.0",
    "cc-by-nd-line": "licensed under cc by nd 4.0",
    "cc-by-nc-sa-line": "licensed under cc by nc sa 4.0",
    "cc-by-long": "this work is licensed under a creative commons attribution 4.0 international license",
    "cc-by-nc-long": "this work is licensed under a creative commons attribution noncommercial 4.0 international license",
    "unlicense-line": "this is free and unencumbered software released into the public domain",
    "rights-reserved": "all rights reserved",
    "spdx-mit": "spdx license identifier mit",
    "spdx-apache": "spdx license identifier apache 2.0",
    "spdx-gpl3": "spdx license identifier gpl 3.0 or later",
    "spdx-gpl3-only": "spdx license identifier gpl 3.0 only",
    "spdx-bsd3": "spdx license identifier bsd 3 clause",
    "spdx-bsd2": "spdx license identifier bsd 2 clause",
    "spdx-isc": "spdx license identifier isc",
    "spdx-mpl2": "spdx license identifier mpl 2.0",
    "spdx-gpl2": "spdx license identifier gpl 2.0 or later",
    "spdx-gpl2-only": "spdx license identifier gpl 2.0 only",
    "spdx-lgpl3": "spdx license identifier lgpl 3.0 or later",
    "spdx-lgpl21": "spdx license identifier lgpl 2.1 or later",
    "spdx-agpl3": "spdx license identifier agpl 3.0 or later",
    "spdx-cc0": "spdx license identifier cc0 1.0",
    "spdx-unlicense": "spdx license identifier unlicense",
    "spdx-bsl": "spdx license identifier bsl 1.0",
    "spdx-zlib": "spdx license identifier zlib",
    "spdx-epl2": "spdx license identifier epl 2.0",
    "apache-unless": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-title": "apache license",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "bsd-disclaimer": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-copy": "you should have received a copy of the gnu general public license along with this program",
    "lgpl3-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl21-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version",
    "agpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-free-by": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation version 3",
    "mpl-line-3": "this source code form is subject to the terms of the mozilla public license v 2.0",
    "mpl-line-4": "this source code form is subject to the terms of the mozilla public license v. 2.0",
    "boost-title": "boost software license version 1.0",
    "boost-line": "distributed under the boost software license version 1.0",
    "boost-permission": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-permission": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "zlib-origin": "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "wtfpl-title": "do what the fuck you want to public license",
    "epl-line": "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0",
    "epl-line-2": "this program and the accompanying materials are made available under the terms of the eclipse public license v 2.0",
    "artistic-line": "licensed under the artistic license 2.0",
    "cc-by-sa-long": "this work is licensed under a creative commons attribution sharealike 4.0 international license",
    "cc-by-nd-long": "this work is licensed under a creative commons attribution noderivatives 4.0 international license",
    "cc-by-nc-sa-long": "this work is licensed under a creative commons attribution noncommercial sharealike 4.0 international license",
    "cc-by-nc-nd-long": "this work is licensed under a creative commons attribution noncommercial noderivatives 4.0 international license",
    "cc-by-nc-nd-line": "licensed under cc by nc nd 4.0",
    "odbl-line": "this database is made available under the open database license",
}

# Fixed values: (licence, use, rule).  A rule is a sequence of alternatives;
# its identifiers must follow one another in the document's sequence.  The
# first rule that matches names the main licence; full texts stand before the
# lines that only mention them.
RULES = [
    ("MIT", "permissive", ["mit-permission", "mit-notice", "as-is"]),
    ("BSD-3-Clause", "permissive", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", "permissive", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    ("Apache-2.0", "permissive", ["apache-line|apache-line-the", "apache-comply", "apache-obtain"]),
    ("GPL-3.0", "copyleft", ["gpl-free", "gpl-no-warranty"]),
    ("AGPL-3.0", "copyleft", ["agpl-line"]),
    ("LGPL-3.0", "copyleft", ["lgpl-line"]),
    ("GPL-3.0", "copyleft", ["gpl3-line|gpl3-line-2|spdx-gpl3|spdx-gpl3-only|gpl-free"]),
    ("GPL-2.0", "copyleft", ["gpl2-line"]),
    ("MPL-2.0", "copyleft", ["mpl-line|mpl-line-2"]),
    ("CC-BY-NC-SA-4.0", "noncommercial", ["cc-by-nc-sa-line"]),
    ("CC-BY-NC-4.0", "noncommercial", ["cc-by-nc-line|cc-by-nc-long"]),
    ("CC-BY-ND-4.0", "restricted", ["cc-by-nd-line"]),
    ("CC-BY-SA-4.0", "copyleft", ["cc-by-sa-line"]),
    ("CC-BY-4.0", "permissive", ["cc-by-line|cc-by-long"]),
    ("CC0-1.0", "public-domain", ["cc0-line|cc0-line-2"]),
    ("Unlicense", "public-domain", ["unlicense-line"]),
    ("Apache-2.0", "permissive", ["apache-line|apache-line-the|spdx-apache"]),
    ("MIT", "permissive", ["mit-grant-line|mit-licensed|spdx-mit|mit-permission|mit-title|mit-title-2"]),
    ("ISC", "permissive", ["isc-permission"]),
    ("BSD-3-Clause", "permissive", ["bsd3-line|spdx-bsd3"]),
    ("BSD-2-Clause", "permissive", ["bsd2-line"]),
    ("AGPL-3.0", "copyleft", ["agpl-free|agpl-free-by|spdx-agpl3"]),
    ("LGPL-3.0", "copyleft", ["lgpl3-free|spdx-lgpl3"]),
    ("LGPL-2.1", "copyleft", ["lgpl21-free|spdx-lgpl21"]),
    ("GPL-2.0", "copyleft", ["gpl2-free|spdx-gpl2|spdx-gpl2-only"]),
    ("MPL-2.0", "copyleft", ["mpl-line-3|mpl-line-4|spdx-mpl2"]),
    ("EPL-2.0", "copyleft", ["epl-line|epl-line-2|spdx-epl2"]),
    ("Zlib", "permissive", ["zlib-as-is", "zlib-permission", "zlib-origin"]),
    ("Zlib", "permissive", ["zlib-permission|spdx-zlib"]),
    ("BSL-1.0", "permissive", ["boost-permission|boost-line|boost-title|spdx-bsl"]),
    ("BSD-2-Clause", "permissive", ["spdx-bsd2"]),
    ("ISC", "permissive", ["spdx-isc|isc-as-is"]),
    ("Artistic-2.0", "permissive", ["artistic-line"]),
    ("CC-BY-NC-ND-4.0", "noncommercial", ["cc-by-nc-nd-line|cc-by-nc-nd-long"]),
    ("CC-BY-NC-SA-4.0", "noncommercial", ["cc-by-nc-sa-long"]),
    ("CC-BY-ND-4.0", "restricted", ["cc-by-nd-long"]),
    ("CC-BY-SA-4.0", "copyleft", ["cc-by-sa-long"]),
    ("ODbL-1.0", "copyleft", ["odbl-line"]),
    ("CC0-1.0", "public-domain", ["spdx-cc0"]),
    ("Unlicense", "public-domain", ["unlicense-anyone|spdx-unlicense"]),
    ("WTFPL", "public-domain", ["wtfpl-title"]),
    ("Proprietary", "restricted", ["rights-reserved"]),
]

#: Characters that stay when a text is normalised: letters, digits and the ends of sentences.
DROPPED = r"[^\p{L}\p{N}.!?;:\n]+"
#: A sentence ends at a line's end or at one of these marks before a blank or the end.
SENTENCE_END = r"[.!?;:]+(?: |\n|$)|\n"


#: Between the words of a known sentence stands a blank or a single line end, maybe after
#: a mark; the next line may begin with the comment marks that normalisation leaves.
GAP = r" ?[;:]?(?: |\n(?:[;!]+ )?)"


def sentence_pattern() -> str:
    """Regular expression for a known sentence that fills the place between two ends: marks, line ends or the text's."""
    words = lambda s: GAP.join(w.replace(".", r"\.") for w in s.split(" "))
    longest_first = sorted(SENTENCES.values(), key=len, reverse=True)
    return r"(?:^|(?<=\n)|(?<=[.!?;:] ))(?:" + "|".join(words(s) for s in longest_first) + r")(?= ?(?:\n|$|[.!?;:]+(?: |\n|$)))"


def rule_pattern(parts: list[str]) -> str:
    """Regular expression over ``,id,id,`` for one rule."""
    return "," + ",".join(f"(?:{p})" for p in parts) + ","


RESULTS = ["sentence_ids", "licenses", "license", "license_use"]


def license_scan(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the licence findings of each text to ``df``.

    sentence_ids: array of known sentences in text order; licenses: distinct
    licences in rule order; license: the first of them or null; license_use:
    its class.

    Defined cases: a null or empty text has no sentences and no licence; texts
    are read whole; repeated rows each keep a row; an empty table gives no
    rows.  Input columns with the names of results are replaced, others pass
    through.
    """
    own = Carried(df, RESULTS)
    known = F.create_map(*[F.lit(x) for x in chain.from_iterable((s, i) for i, s in SENTENCES.items())])
    clean = F.regexp_replace(F.lower(F.coalesce(F.col(own.find(text)).cast("string"), F.lit(""))), DROPPED, " ")
    lines = F.trim(F.regexp_replace(clean, r" *\n *", "\n"))
    sentences = F.transform(F.regexp_extract_all(lines, F.lit(sentence_pattern()), F.lit(0)), lambda s: F.regexp_replace(s, GAP, " "))
    found = F.filter(F.transform(sentences, lambda s: F.try_element_at(known, s)), lambda i: i.isNotNull())
    ruled = _apply_rules(own.rows.select(*own.columns(), found.alias("sentence_ids")))
    return ruled.select(*own.restored(), *RESULTS)


def _apply_rules(df: DataFrame) -> DataFrame:
    """``df`` (with sentence_ids) and the licences that the rules find in it."""
    sequence = F.concat(F.lit(","), F.array_join("sentence_ids", ","), F.lit(","))
    hits: list[Column] = [F.when(sequence.rlike(rule_pattern(parts)), F.lit(name)) for name, _, parts in RULES]
    uses = F.create_map(*[F.lit(x) for x in chain.from_iterable({n: u for n, u, _ in RULES}.items())])
    none = F.size("sentence_ids") == 0
    return (
        df.withColumn("licenses", F.when(none, F.array().cast("array<string>")).otherwise(F.array_distinct(F.array_compact(F.array(*hits)))))
        .withColumn("license", F.get("licenses", F.lit(0)))
        .withColumn("license_use", F.when(F.col("license").isNotNull(), F.try_element_at(uses, F.col("license"))))
    )


def license_digest_sql() -> str:
    """DuckDB SQL for the query's rows: the same normalisation, look-up and rules."""
    known = "MAP {" + ", ".join(f"'{s}': '{i}'" for i, s in SENTENCES.items()) + "}"
    lengths = [len(s) for s in SENTENCES.values()]
    hits = ", ".join(f"CASE WHEN regexp_matches(seq, '{rule_pattern(parts)}') THEN {n} END" for n, (_, _, parts) in enumerate(RULES))
    names = "[" + ", ".join(f"'{n}'" for n, _, _ in RULES) + "]"
    uses = "MAP {" + ", ".join(f"'{n}': '{u}'" for n, u in {n: u for n, u, _ in RULES}.items()) + "}"
    return rf"""
WITH cut AS (
  SELECT doc_id, list_filter(
    list_transform(string_split_regex(regexp_replace(lower(coalesce(text, '')), '{DROPPED}', ' ', 'g'), '{SENTENCE_END}'), lambda s: trim(s, ' ')),
    lambda s: length(s) BETWEEN {min(lengths)} AND {max(lengths)}) AS sentences
  FROM documents
), looked AS (
  SELECT doc_id, list_filter(list_transform(sentences, lambda s: {known}[s]), lambda i: i IS NOT NULL) AS ids FROM cut
), seqs AS (
  SELECT doc_id, ids, ',' || array_to_string(ids, ',') || ',' AS seq FROM looked
), ruled AS (
  SELECT doc_id, ids, list_filter([{hits}], lambda n: n IS NOT NULL) AS hit FROM seqs
), named AS (
  SELECT doc_id, ids, list_transform(hit, lambda n: {names}[n + 1]) AS names FROM ruled
), first_of AS (
  SELECT doc_id, ids, list_filter(names, lambda x, i: list_position(names, x) = i) AS licenses FROM named
)
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_known, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
  coalesce(array_to_string(licenses, ','), '') AS licenses, licenses[1] AS license,
  {uses}[licenses[1]] AS license_use
FROM first_of
"""

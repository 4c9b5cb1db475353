"""License scans: sentences are normalised and looked up among known licence sentences, and
the identifiers found, in their order, are matched against ordered licence rules."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from ledgerfold.llm.common import ship

#: Sentences of public licences and the usual notices, by identifier.
SENTENCES: dict[str, tuple[str, ...]] = {
    "apache2-notice": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\").",
        "This file is licensed under the Apache License, Version 2.0.",
        "Released under the Apache License 2.0.",
    ),
    "apache2-compliance": ("You may not use this file except in compliance with the License.",),
    "apache2-copy": ("You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",),
    "apache2-warranty": (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "mit-notice": ("Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License."),
    "mit-title": ("The MIT License (MIT)", "MIT License"),
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions:",
    ),
    "mit-condition": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",),
    "bsd-grant": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",),
    "bsd-source": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",),
    "bsd-binary": (
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution.",
    ),
    "bsd-endorsement": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
        "from this software without specific prior written permission.",
    ),
    "bsd-notice": ("Released under the BSD License.", "Licensed under the BSD 3-Clause License."),
    "gpl3-notice": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
        "Released under the GNU General Public License v3.",
    ),
    "gpl-grant": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "gpl-hope": ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",),
    "cc-by-nc4-notice": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by4-notice": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-sa4-notice": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc0-notice": ("Released under CC0 1.0.", "This work is dedicated to the public domain under CC0 1.0."),
    "reserved": ("All rights reserved.",),
}

#: Licences by the sequence of sentences that names them. The first rule that
#: fits somewhere takes its sentences; those left go on to the next rules.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Apache-2.0", ("apache2-notice", "apache2-compliance", "apache2-copy", "apache2-warranty")),
    ("Apache-2.0", ("apache2-notice", "apache2-compliance")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorsement")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("MIT", ("mit-title", "mit-grant", "mit-condition")),
    ("MIT", ("mit-grant", "mit-condition")),
    ("GPL-3.0-or-later", ("gpl-grant", "gpl-hope")),
    ("GPL-3.0-or-later", ("gpl-grant",)),
    ("MIT", ("mit-grant",)),
    ("Apache-2.0", ("apache2-notice",)),
    ("MIT", ("mit-notice",)),
    ("BSD-3-Clause", ("bsd-notice",)),
    ("GPL-3.0-only", ("gpl3-notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc4-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa4-notice",)),
    ("CC-BY-4.0", ("cc-by4-notice",)),
    ("CC0-1.0", ("cc0-notice",)),
    ("LicenseRef-all-rights-reserved", ("reserved",)),
)

#: A piece ends at a line end, or after . ! ? ; : before a blank.
ENDS = re.compile(r"[ \t]*(?:\r\n|\r|\n)|(?<=[.!?;:])[ \t]+")
PARTS = re.compile(r"[a-z0-9]+")


def normalised(sentence: str) -> str:
    """Letters a-z and digits in lower case, everything else as one blank between them."""
    return " ".join(PARTS.findall(sentence.lower()))


KNOWN = {normalised(form): name for name, forms in SENTENCES.items() for form in forms}
FIRST = frozenset(s.split(" ")[0] for s in KNOWN)
#: What a known sentence can begin with, whole words each.
BEGUN = frozenset(" ".join(s.split(" ")[:i]) for s in KNOWN for i in range(1, s.count(" ") + 1))


def sentence_ids(text: str | None) -> list[str]:
    """Identifiers of the known sentences of a text, in their order. A sentence is a piece,
    or several that follow each other without a blank line: licences are wrapped."""
    pieces, found, i = ENDS.split(text or ""), [], 0
    while i < len(pieces):
        head = PARTS.search(pieces[i].lower())
        i += 1
        if not head or head.group() not in FIRST:
            continue
        sentence, name, j = normalised(pieces[i - 1]), None, i
        while True:
            if sentence in KNOWN:
                name, i = KNOWN[sentence], j
            if sentence not in BEGUN or j == len(pieces) or not (more := normalised(pieces[j])):
                break
            sentence, j = f"{sentence} {more}", j + 1
        if name:
            found.append(name)
    return found


def matched(ids: list[str]) -> list[str]:
    """The licences whose rules fit, sorted; no sentence counts for two rules."""
    left, found = [*ids], set()
    for licence, rule in RULES:
        i = 0
        while i + len(rule) <= len(left):
            if tuple(left[i:i + len(rule)]) == rule:
                found.add(licence)
                left[i:i + len(rule)] = [""]
            i += 1
    return sorted(found)


@arrow_udf(T.StructType([T.StructField("sentences", T.ArrayType(T.StringType())), T.StructField("licenses", T.ArrayType(T.StringType()))]))
def scanned(texts: pa.Array) -> pa.Array:
    ids = [sentence_ids(t) for t in texts.to_pylist()]
    kind = pa.list_(pa.string())
    return pa.StructArray.from_arrays([pa.array(ids, kind), pa.array([matched(i) for i in ids], kind)], names=["sentences", "licenses"])


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, ``n_sentences`` (known licence
    sentences, repeats included), ``sentence_ids`` in their order and ``licenses`` sorted,
    both joined by commas.

    Whole texts are read. Null and empty texts, and texts without a known sentence, have 0
    and empty strings. Repeated rows are scanned alike; ids may be null. No shuffle.
    """
    ship(docs.sparkSession)
    found = docs.select("doc_id", scanned("text").alias("s"))
    return found.select(
        "doc_id", F.size("s.sentences").cast("long").alias("n_sentences"),
        F.array_join("s.sentences", ",").alias("sentence_ids"), F.array_join("s.licenses", ",").alias("licenses"),
    )

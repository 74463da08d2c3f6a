"""License scan by sentence rules.

A text is cut into sentences, each normalised to lower-case letters and digits. Known licence
sentences get their identifiers, and the sequence of identifiers of a document is matched against
ordered rules: a rule that finds its identifiers side by side takes them away from later rules.
Text is read with a line end as the end of a sentence and with a line end as a space, so wrapped
paragraphs and one-line notices are both found. A text with web addresses is read a third time, line
ends as spaces and each address a sentence of its own: a notice that names one needs no line ends
around it. All of it is Spark functions on one row.

The identifiers given are those of the first reading, in that order, in which a rule fits; if none
does, of the reading by lines.

Null and empty texts and texts without a known sentence have no identifiers and no licences.
Repeated sentences are listed each time; repeated rows are scanned alike; an empty table gives an
empty result. A text is one row however long it is.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licences and usual notices.
SENTENCES = {
    "apache-ref": "Licensed under the Apache License, Version 2.0.",
    "apache-ref-long": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache-use": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-law": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "mit-ref": "Released under the MIT License.",
    "mit-ref-licensed": "Licensed under the MIT License.",
    "mit-title": "The MIT License (MIT)",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "gpl-ref-2": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-ref-3": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-later-2": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-later-3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "mpl-ref": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-ref": "Licensed under CC BY 4.0.",
    "cc-by-sa-ref": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-ref": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-nd-ref": "Licensed under CC BY-NC-ND 4.0.",
    "cc0-ref": "This work is released under the CC0 1.0 Universal license.",
}
#: Licence and the sentences it needs side by side; longer sequences first.
RULES = (
    ("Apache-2.0", ("apache-ref-long", "apache-use", "apache-copy")),
    ("Apache-2.0", ("apache-law", "apache-see")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-title", "mit-grant")),
    ("BSD-3-Clause", ("bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-source", "bsd-binary")),
    ("GPL-2.0-or-later", ("gpl-later-2", "gpl-hope")),
    ("GPL-3.0-or-later", ("gpl-later-3", "gpl-hope")),
    ("ISC", ("isc-grant",)),
    ("Apache-2.0", ("apache-ref",)),
    ("MIT", ("mit-ref",)),
    ("MIT", ("mit-ref-licensed",)),
    ("GPL-2.0-only", ("gpl-ref-2",)),
    ("GPL-3.0-only", ("gpl-ref-3",)),
    ("MPL-2.0", ("mpl-ref",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-ref",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-ref",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-ref",)),
    ("CC-BY-4.0", ("cc-by-ref",)),
    ("CC0-1.0", ("cc0-ref",)),
)
#: Every rule has a sentence with one of these, so texts without them are not cut into sentences.
HINTS = "licen[sc]|permission|permitted|warrant|redistribut|copyright"
ENDS = r"[.!?;:]+([ \t\r\f\x0B\n]+|$)"
ADDRESS = r"(https?://|www\.)[^ \t\r\f\x0B\n]+"
OTHER = r"[^\p{L}\p{N}\n]+"


def pieces_of(sentence: str) -> tuple[str, ...]:
    """A known sentence normalised the way texts are; inner stops cut it into several."""
    cut = re.sub(ENDS, "\n", sentence.lower())
    plain = re.sub(r"[^\w\n]+|_", " ", cut)
    return tuple(p.strip() for p in plain.split("\n") if p.strip())


#: Normalised sentence to identifier; the parts of a sentence with inner stops are numbered.
KNOWN = {
    part: name if i == 0 else f"{name}+{i}"
    for name, sentence in SENTENCES.items() for i, part in enumerate(pieces_of(sentence))
}


def sequence_of(names: tuple[str, ...]) -> str:
    """The identifiers of a rule as matched: ``,a,b,``, parts of sentences included."""
    ids = [KNOWN[part] for name in names for part in pieces_of(SENTENCES[name])]
    return "," + ",".join(ids) + ","


def sentence_ids(text: Column, lines_end: bool, addresses_end: bool = False) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    lower = F.lower(text)
    joined = lower if lines_end else F.regexp_replace(lower, "\n", " ")
    if addresses_end:
        joined = F.regexp_replace(joined, ADDRESS, "\n")
    plain = F.regexp_replace(F.regexp_replace(joined, ENDS, "\n"), OTHER, " ")
    known = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])
    bare = F.regexp_replace(F.regexp_replace(plain, " ?\n ?", "\n"), "^ | $", "")
    hits = F.filter(F.split(bare, "\n"), lambda s: s.isin(*KNOWN))
    return F.when(lower.rlike(HINTS), F.transform(hits, lambda s: F.element_at(known, s))).otherwise(
        F.array().cast("array<string>")
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(key, sentence_ids, licenses)``, two arrays in order: as read, as rules come."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    read = docs.select(
        F.col(id_col).alias("key"), sentence_ids(text, True).alias("by_line"),
        sentence_ids(text, False).alias("by_space"),
        F.when(F.lower(text).rlike(ADDRESS), sentence_ids(text, False, True)).otherwise(
            F.array().cast("array<string>")
        ).alias("by_address"),
    )
    found: dict[str, Column] = {}
    readings = ("by_line", "by_space", "by_address")
    rests = [F.concat(F.lit(","), F.array_join(c, ","), F.lit(",")) for c in readings]
    fits = [F.lit(False)] * len(readings)
    for licence, names in RULES:
        pattern = F.lit(sequence_of(names))
        hits = [r.contains(pattern) for r in rests]
        fits = [a | b for a, b in zip(fits, hits, strict=True)]
        hit = reduce(Column.__or__, hits)
        found[licence] = found[licence] | hit if licence in found else hit
        if len(names) > 1:  # only longer rules hold sentences that later ones ask for
            rests = [F.replace(r, pattern, F.lit(",")) for r in rests]
    licences = F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in found.items()]))
    used = F.coalesce(*[F.when(f, F.col(c)) for f, c in zip(fits, readings, strict=True)], F.col("by_line"))
    return read.select("key", used.alias("sentence_ids"), licences.alias("licenses"))

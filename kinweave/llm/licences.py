"""License scans: sentences to identifiers, identifier sequences to licences.

A text is cut into sentences, each is normalised (ASCII lower case, comment marks and punctuation dropped,
white space squeezed, spelling variants unified) and looked up among known licence sentences. The sequence
of identifiers, other sentences left out, is matched against ordered rules: at each place the first rule
of RULES whose identifiers stand there in a row names a licence and uses them up; identifiers that fit
no rule are left over.

Sentences end at a full stop or blank line. Their parts between semicolons and colons are looked up, too, and
parts in a row that are none by themselves together, so that a sentence with such marks in it is found whole.
A line that is a known sentence by itself counts even where the line before lacks its full stop; other
sentences may run over line ends.

Defined cases: a null or empty text has no sentences; repeated rows are scanned each; an empty table gives
an empty result; other columns of the input are ignored; texts of any length are scanned whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from kinweave.llm.shared import arrow_map, table, text_bytes

# Known sentences, normalised, as patterns over the whole sentence, with their identifiers.
SENTENCES = (
    (r"(?:this (?:work|software|file|program|code|project) is )?(?:licen[sc]ed|released|distributed|made available|available) under (?:the )?(?:terms of )?(?:the )?apache licen[sc]e(?: version)? 2 0(?: the licen[sc]e)?", "apache-2.0-grant"),
    (r"you may not use this file except in compliance with the licen[sc]e", "apache-compliance"),
    (r"you may obtain a copy of the licen[sc]e at(?: https?)?(?: www apache org licen[sc]es licen[sc]e 2 0)?", "apache-copy-at"),
    (r"unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis without warranties or conditions of any kind either express or implied", "apache-as-is"),
    (r"see the licen[sc]e for the specific language governing permissions and limitations under the licen[sc]e", "apache-see"),
    (r"(?:this (?:work|software|file|program|code|project) is )?(?:licen[sc]ed|released|distributed|made available|available) under (?:the )?(?:terms of )?(?:the )?mit licen[sc]e", "mit-grant"),
    (r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction .*", "mit-permission"),
    (r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit-notice"),
    (r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "mit-as-is"),
    (r"in no event shall the authors or copyright holders be liable for any claim damages or other liability .*", "mit-liability"),
    (r"(?:this (?:work|software|file|program|code|project) is )?(?:licen[sc]ed|released|distributed|made available|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:general public licen[sc]e|gpl)(?: version| v)? ?2(?: 0)?(?: only)?", "gpl-2-grant"),
    (r"(?:this (?:work|software|file|program|code|project) is )?(?:licen[sc]ed|released|distributed|made available|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:general public licen[sc]e|gpl)(?: version| v)? ?3(?: 0)?(?: only)?", "gpl-3-grant"),
    (r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e as published by the free software foundation either version 2 of the licen[sc]e or at your option any later version", "gpl-2-or-later"),
    (r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e or at your option any later version", "gpl-3-or-later"),
    (r"this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", "gpl-no-warranty"),
    (r"see the gnu general public licen[sc]e for more details", "gpl-see"),
    (r"you should have received a copy of the gnu general public licen[sc]e along with this program.*", "gpl-received"),
    (r"(?:this (?:work|software|file|program|code|project) is )?(?:licen[sc]ed|released|distributed|made available|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:lesser general public licen[sc]e|lgpl)(?: version| v)? ?(?:2 1|3|3 0)", "lgpl-grant"),
    (r"(?:this (?:work|software|file|program|code|project) is )?(?:licen[sc]ed|released|distributed|made available|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:affero general public licen[sc]e|agpl)(?: version| v)? ?3(?: 0)?", "agpl-3-grant"),
    (r"(?:this (?:work|software|file|program|code|project) is )?(?:licen[sc]ed|released|distributed|made available|available) under (?:a |the )?(?:terms of )?(?:the )?(?:cc|creative commons) (?:by nc|attribution non ?commercial) (?:4 0|3 0)(?: international)?(?: licen[sc]e)?", "cc-by-nc-grant"),
    (r"(?:this (?:work|software|file|program|code|project) is )?(?:licen[sc]ed|released|distributed|made available|available) under (?:a |the )?(?:terms of )?(?:the )?(?:cc|creative commons) (?:by nc sa|attribution non ?commercial share ?alike) (?:4 0|3 0)(?: international)?(?: licen[sc]e)?", "cc-by-nc-sa-grant"),
    (r"(?:this (?:work|software|file|program|code|project) is )?(?:licen[sc]ed|released|distributed|made available|available) under (?:a |the )?(?:terms of )?(?:the )?(?:cc|creative commons) (?:by sa|attribution share ?alike) (?:4 0|3 0)(?: international)?(?: licen[sc]e)?", "cc-by-sa-grant"),
    (r"(?:this (?:work|software|file|program|code|project) is )?(?:licen[sc]ed|released|distributed|made available|available) under (?:a |the )?(?:terms of )?(?:the )?(?:cc|creative commons) (?:by|attribution) (?:4 0|3 0)(?: international)?(?: licen[sc]e)?", "cc-by-grant"),
    (r"(?:this (?:work|software|file|program|code|project) is )?(?:released |dedicated |licen[sc]ed |made available |available )?(?:in|into|to|under) (?:the public domain|(?:cc|creative commons) ?0(?: 1 0)?(?: universal)?)", "public-domain"),
    (r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd-redistribution"),
    (r"(?:1 |)redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "bsd-source"),
    (r"(?:2 |)redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "bsd-binary"),
    (r"(?:3 |)neither the name of .* nor the names of (?:its|any) contributors may be used to endorse or promote products derived from this software without specific prior written permission", "bsd-endorse"),
    (r"(?:this (?:work|software|file|program|code|project) is )?(?:licen[sc]ed|released|distributed|made available|available) under (?:the )?(?:terms of )?(?:the )?(?:new |modified |revised |3 clause |2 clause )?bsd(?: 3 clause| 2 clause)? licen[sc]e", "bsd-grant"),
    (r"(?:this (?:work|software|file|program|code|project) is )?(?:licen[sc]ed|released|distributed|made available|available|subject) (?:under|to) (?:the )?(?:terms of )?(?:the )?mozilla public licen[sc]e(?: version| v)? ?2 0", "mpl-2-grant"),
    (r"(?:this (?:work|software|file|program|code|project) is )?(?:licen[sc]ed|released|distributed|made available|available) under (?:the )?(?:terms of )?(?:the )?isc licen[sc]e", "isc-grant"),
    (r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "isc-permission"),
    (r"the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", "isc-as-is"),
    (r"this is free and unencumbered software released into the public domain", "unlicense-free"),
    (r"anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "unlicense-anyone"),
    (r"this software is provided as is without any express or implied warranty", "zlib-as-is"),
    (r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", "zlib-permission"),
    (r"(?:this (?:work|software|file|program|code|project) is )?(?:licen[sc]ed|released|distributed|made available|available) under (?:the )?(?:terms of )?(?:the )?zlib licen[sc]e", "zlib-grant"),
    (r"(?:distributed |licen[sc]ed )?(?:under|subject to) the boost software licen[sc]e(?: version)? 1 0", "boost-grant"),
    (r"(?:this (?:work|software|file|program|code|project) is )?(?:licen[sc]ed|released|distributed|made available|available) under (?:the )?(?:terms of )?(?:the )?eclipse public licen[sc]e(?: version| v)? ?(?:1 0|2 0)", "epl-grant"),
    (r"(?:this (?:work|software|file|program|code|project) is )?(?:licen[sc]ed|released|distributed|made available|available) under (?:the )?(?:terms of )?(?:the )?artistic licen[sc]e(?: version)?(?: 2 0)?", "artistic-grant"),
    (r"(?:copyright )?(?:c |)(?:[0-9]{4} )?.{0,80}all rights reserved", "all-rights-reserved"),
)
# Rules in order; the first that fits at a place wins.
RULES = (
    ("Apache-2.0", ("apache-2.0-grant", "apache-compliance", "apache-copy-at", "apache-as-is", "apache-see")),
    ("Apache-2.0", ("apache-2.0-grant",)),
    ("MIT", ("mit-permission", "mit-notice", "mit-as-is", "mit-liability")),
    ("MIT", ("mit-permission", "mit-notice", "mit-as-is")),
    ("MIT", ("mit-grant",)),
    ("GPL-3.0-or-later", ("gpl-3-or-later", "gpl-no-warranty", "gpl-see", "gpl-received")),
    ("GPL-3.0-or-later", ("gpl-3-or-later",)),
    ("GPL-2.0-or-later", ("gpl-2-or-later", "gpl-no-warranty", "gpl-see", "gpl-received")),
    ("GPL-2.0-or-later", ("gpl-2-or-later",)),
    ("GPL-3.0", ("gpl-3-grant",)),
    ("GPL-2.0", ("gpl-2-grant",)),
    ("LGPL", ("lgpl-grant",)),
    ("AGPL-3.0", ("agpl-3-grant",)),
    ("CC-BY-NC-SA", ("cc-by-nc-sa-grant",)),
    ("CC-BY-NC", ("cc-by-nc-grant",)),
    ("CC-BY-SA", ("cc-by-sa-grant",)),
    ("CC-BY", ("cc-by-grant",)),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("BSD", ("bsd-grant",)),
    ("MPL-2.0", ("mpl-2-grant",)),
    ("ISC", ("isc-permission", "isc-as-is")),
    ("ISC", ("isc-permission",)),
    ("ISC", ("isc-grant",)),
    ("Unlicense", ("unlicense-free", "unlicense-anyone")),
    ("Unlicense", ("unlicense-free",)),
    ("Zlib", ("zlib-as-is", "zlib-permission")),
    ("Zlib", ("zlib-grant",)),
    ("BSL-1.0", ("boost-grant",)),
    ("EPL", ("epl-grant",)),
    ("Artistic-2.0", ("artistic-grant",)),
    ("Public-Domain", ("public-domain",)),
    ("Proprietary", ("all-rights-reserved",)),
)
_COMPILED = tuple((re.compile(pattern), name) for pattern, name in SENTENCES)
#: What any known sentence is at its start.
_ANY = re.compile("|".join(f"(?:{pattern})" for pattern, _ in SENTENCES))
_END = re.compile(r"[.!?](?=\s|$)|\n[ \t]*\n")
_PART = re.compile(r"[;:](?=\s|$)")
_MARKS = re.compile(r"^[ \t]*(?:/{2,}|/?\*+/?|#+|--|;;)[ \t]?", re.MULTILINE)
_NOT_WORD = re.compile(r"[^a-z0-9]+")


def normalised(sentence: str) -> str:
    return _NOT_WORD.sub(" ", sentence.lower()).strip()


def _lookup(plain: str, start: int, end: int) -> str | None:
    return next((name for pattern, name in _COMPILED if pattern.fullmatch(plain, start, end)), None)


def sentence_id(sentence: str) -> str | None:
    """The identifier of a sentence, None if it is not a known one."""
    plain = normalised(sentence)
    return _lookup(plain, 0, len(plain)) if _ANY.fullmatch(plain) else None


def _cut(text: str, ends: re.Pattern, start: int, end: int) -> list[tuple[int, int]]:
    cuts = sorted({start, end, *(m.end() for m in ends.finditer(text, start, end))})
    return list(zip(cuts, cuts[1:]))


def _sentence_parts(plain: str, parts: list[tuple[int, int]]) -> Iterator[tuple[str, int, int]]:
    """(identifier, start, end) of what is known in one sentence: a part, several unknown parts in a row, or a line."""
    words = [normalised(plain[start:end]) for start, end in parts]
    names = [_lookup(w, 0, len(w)) if _ANY.fullmatch(w) else None for w in words]
    joined, ends = " ".join(w for w in words if w), []
    for w in words:
        last = ends[-1] if ends else 0
        ends.append(last + len(w) + (last > 0) if w else last)
    at = 0
    while at < len(parts):
        start, end = parts[at]
        upto, name = at + 1, names[at]
        # A run of parts can be known only if a known sentence starts here.
        if not name and len(parts) > 1 and words[at] and _ANY.match(joined, ends[at] - len(words[at])):
            while not name and upto < len(parts) and not names[upto]:
                upto += 1
                name = _lookup(joined, ends[at] - len(words[at]), ends[upto - 1])
        if name:
            yield name, start, parts[upto - 1][1]
            at = upto
            continue
        piece = plain[start:end]
        if "\n" in piece.strip():
            for line in piece.split("\n"):
                if name := sentence_id(line):
                    yield name, start, start + len(line)
                start += len(line) + 1
        at += 1


def known_sentences(text: str) -> list[tuple[str, int, int]]:
    """(identifier, start, end) of the known sentences of a text, in order."""
    blank = lambda m: " " * len(m[0])
    plain = _MARKS.sub(blank, text)
    out = [known for start, end in _cut(plain, _END, 0, len(plain)) for known in _sentence_parts(plain, _cut(plain, _PART, start, end))]
    return [(name, start + len(plain[start:end]) - len(plain[start:end].lstrip()), start + len(plain[start:end].rstrip())) for name, start, end in out]


def match_rules(names: list[str]) -> list[tuple[str, int, int]]:
    """(licence, first, last + 1) over a sequence of identifiers."""
    out, at = [], 0
    while at < len(names):
        for licence, wanted in RULES:
            if tuple(names[at : at + len(wanted)]) == wanted:
                out.append((licence, at, at + len(wanted)))
                at += len(wanted)
                break
        else:
            at += 1
    return out


def scan_licences(documents: DataFrame) -> DataFrame:
    """Per document: licences in order of appearance, identifiers of the known sentences, and spans licence:start:end in code points."""

    def kernel(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        licences, names, spans = [], [], []
        for raw in text_bytes(batch.column("text")):
            known = known_sentences(raw.decode("utf-8", "replace"))
            matched = match_rules([name for name, _, _ in known])
            licences.append([licence for licence, _, _ in matched])
            names.append([name for name, _, _ in known])
            spans.append([f"{licence}:{known[first][1]}:{known[last - 1][2]}" for licence, first, last in matched])
        strings = pa.list_(pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, type=strings) for x in (licences, names, spans))], names=["doc_id", "licences", "sentences", "spans"])

    schema = "doc_id long, licences array<string>, sentences array<string>, spans array<string>"
    return arrow_map(documents.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), kernel, schema)


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licences(table(spark, sf_dir, "documents"))
    return found.selectExpr("doc_id", "cast(size(licences) as long) n_licences", "array_join(licences, ',') licences", "array_join(sentences, ',') sentences", "array_join(spans, ',') spans")

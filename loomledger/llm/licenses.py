"""Licence scan by sentence rules, in DataFrame functions only.

1. Texts are cut into sentences in three readings, from coarse to fine: at blank lines and end marks (full stops,
   question and exclamation marks, semicolons or colons before white space or a line end), so that wrapped lines are one
   sentence; at line ends too, except between two words in capitals; at every line end. A finer reading is taken only
   of what the coarser one doesn't know. In all of them a line that goes on with a small letter or a bracket continues
   its sentence. A sentence is normalised: lower-cased (ASCII), everything but letters, digits and dots inside numbers
   made one space, trimmed.
2. Normalised sentences are mapped to the identifiers of known licence sentences: by equality with fixed tables; by templates, which are
   sentences with a place for a holder's name or an address; by a grant ("is released under the terms of the ..."), an SPDX tag or
   a title, whose licence is looked up by name. A grant or a tag can name several licences, joined by "and" or "or". A grant that is
   denied, past or conditional is none.
3. A document's identifiers, in order, are matched against the ordered licence rules: a rule is a sequence of
   identifiers; at each place the first rule of the list that matches wins, so longer and more specific rules come first,
   and the identifiers it takes are used up.

A document's answer is its licences in order of appearance and the number of known sentences that no rule took. Texts
without any word that known sentences have aren't cut at all. There is no shuffle.

Null and empty texts have no licence. Rows are answered one by one, repeated rows alike. Empty table: no rows. Other
columns of the input are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known licence sentences, normalised, and their identifiers.
SENTENCES = {
    "licensed under the apache license version 2.0": "apache-2.0-notice",
    "licensed under the apache license version 2.0 the license": "apache-2.0-grant",
    "you may not use this file except in compliance with the license": "apache-compliance",
    "you may obtain a copy of the license at": "apache-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-as-is",
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-as-is",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice-kept",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "licensed under the bsd 3 clause license": "bsd-3-notice",
    "licensed under the bsd 2 clause license": "bsd-2-notice",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0-notice",
    "this work is licensed under the gnu general public license version 2": "gpl-2.0-notice",
    "this program is free software": "gpl-free",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-terms",
    "either version 3 of the license or at your option any later version": "gpl-3-or-later",
    "either version 2 of the license or at your option any later version": "gpl-2-or-later",
    "licensed under cc by 4.0": "cc-by-4.0-notice",
    "licensed under cc by sa 4.0": "cc-by-sa-4.0-notice",
    "licensed under cc by nc 4.0": "cc-by-nc-4.0-notice",
    "licensed under cc by nc sa 4.0": "cc-by-nc-sa-4.0-notice",
    "this work is licensed under a creative commons attribution 4.0 international license": "cc-by-4.0-notice",
    "this work is dedicated to the public domain": "cc0-notice",
    "all rights reserved": "reserved",
}

# Ordered licence rules, sequences of sentence identifiers. The first that matches at a place wins.
RULES = (
    ("Apache-2.0", ("apache-2.0-grant", "apache-compliance", "apache-copy", "apache-as-is")),
    ("Apache-2.0", ("apache-2.0-grant", "apache-compliance", "apache-copy")),
    ("Apache-2.0", ("apache-2.0-grant", "apache-compliance")),
    ("Apache-2.0", ("apache-2.0-grant",)),
    ("Apache-2.0", ("apache-2.0-notice", "apache-compliance")),
    ("Apache-2.0", ("apache-2.0-notice",)),
    ("MIT", ("mit-grant", "mit-notice-kept", "mit-as-is")),
    ("MIT", ("mit-grant", "mit-as-is")),
    ("MIT", ("mit-grant", "mit-notice-kept")),
    ("MIT", ("mit-grant",)),
    ("MIT", ("mit-notice",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd-3-notice",)),
    ("BSD-2-Clause", ("bsd-2-notice",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-terms", "gpl-3-or-later")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl-terms", "gpl-2-or-later")),
    ("GPL-3.0-only", ("gpl-3.0-notice",)),
    ("GPL-2.0-only", ("gpl-2.0-notice",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-4.0-notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4.0-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4.0-notice",)),
    ("CC-BY-4.0", ("cc-by-4.0-notice",)),
    ("CC0-1.0", ("cc0-notice",)),
)

# Further standard notices.
_FSF = "you can redistribute it and or modify it under the terms of the gnu {}general public license{} as published by the free software foundation{}"
_LATER = "either version {} of the license or at your option any later version"
NOTICES = {
    "you may obtain a copy of the license at http www.apache.org licenses license 2.0": "apache-copy",
    "you may obtain a copy of the license at https www.apache.org licenses license 2.0": "apache-copy",
    "this library is free software": "gpl-free",
    "this file is free software": "gpl-free",
    **{_FSF.format(kind, "", f" {_LATER.format(v)}"): f"{name}-{v}-joined" for name, kind, versions in (("gpl", "", "23"), ("lgpl", "lesser ", ("2.1", "3")), ("agpl", "affero ", "3")) for v in versions},
    **{_FSF.format(kind, f" version {v}", ""): f"{name}-{v}-only" for name, kind, versions in (("gpl", "", "23"), ("lgpl", "lesser ", ("2.1", "3")), ("agpl", "affero ", "3")) for v in versions},
    _FSF.format("lesser ", "", ""): "lgpl-terms",
    _FSF.format("affero ", "", ""): "agpl-terms",
    _LATER.format("2.1"): "gpl-2.1-or-later",
    "this source code form is subject to the terms of the mozilla public license v 2.0": "mpl-2.0-notice",
    "licensed under the isc license": "isc-notice",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-as-is",
    "this is free and unencumbered software released into the public domain": "unlicense-grant",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense-anyone",
}

NOTICE_RULES = (
    *((f"{name.upper()}-{version}-{kind}", ("gpl-free", f"{name}-{v}-{mark}")) for name, v, version in (("gpl", "2", "2.0"), ("gpl", "3", "3.0"), ("lgpl", "2.1", "2.1"), ("lgpl", "3", "3.0"), ("agpl", "3", "3.0")) for kind, mark in (("or-later", "joined"), ("only", "only"))),
    ("LGPL-2.1-or-later", ("gpl-free", "lgpl-terms", "gpl-2.1-or-later")),
    ("LGPL-3.0-or-later", ("gpl-free", "lgpl-terms", "gpl-3-or-later")),
    ("AGPL-3.0-or-later", ("gpl-free", "agpl-terms", "gpl-3-or-later")),
    ("MPL-2.0", ("mpl-2.0-notice",)),
    ("ISC", ("isc-grant", "isc-as-is")),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-notice",)),
    ("Unlicense", ("unlicense-grant", "unlicense-anyone")),
    ("Unlicense", ("unlicense-grant",)),
)

# More sentences of standard texts.
NOTICES |= {
    "this software is provided as is without any express or implied warranty": "zlib-as-is",
    "in no event will the authors be held liable for any damages arising from the use of this software": "zlib-liability",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "bsl-grant",
    "permission is hereby granted without written agreement and without license or royalty fees to use copy modify and distribute this software and its documentation for any purpose": "old-mit-grant",
    "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed": "wtfpl-grant",
    "you just do what the fuck you want to": "wtfpl-terms",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd-advertising",
    "the author disclaims copyright to this source code": "blessing-grant",
    "in place of a legal notice here is a blessing": "blessing-blessing",
}

# Sentences with places for names and addresses, as patterns of the whole normalised sentence.
TEMPLATES = (
    (r"neither the names? of .+ nor the names? of .*contributors may be used to endorse or promote products derived from (this|the) software without specific prior written permission( from .+)?", "bsd-names"),
    (r"neither the name of .+ nor .+ may be used to endorse or promote products derived from (this|the) software without specific prior written permission( from .+)?", "bsd-names"),
    (r"the names? of .+ (may not|must not) be used to endorse or promote products derived from (this|the) software without( specific)? prior written permission( from .+)?", "bsd-names"),
    (r"redistribution and use in source and binary forms with or without modification( of .+)? (are|is) permitted provided that the following conditions are met", "bsd-grant"),
    (r"([0-9]+ |[a-z] )?redistributions of source code must retain the( above)? copyright notices?( .*)? this list of conditions and the following disclaimer( .*)?", "bsd-source"),
    (r"([0-9]+ |[a-z] )?redistributions in binary form must reproduce the( above)? copyright notices?( .*)? this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "bsd-binary"),
    (r"this product includes software developed by .+", "bsd-product"),
    (r"you may obtain a copy of the (apache )?license at( https?)? (www.)?apache.org licenses( license 2.0.*)?", "apache-copy"),
    (r"(this|the) program and the accompanying materials are made available under the terms of the eclipse public license (version |v |v)?2.0( .+)?", "epl-2.0-grant"),
    (r"(this|the) program and the accompanying materials are made available under the terms of the eclipse public license (version |v |v)?1.0( .+)?", "epl-1.0-grant"),
    (r"this source code form is subject to the terms of the mozilla public license (version |v |v)?2.0", "mpl-2.0-notice"),
    (r"use modification and distribution (is|are) subject to the boost software license version 1.0( .+)?", "bsl-notice"),
    (r"distributed under the boost software license version 1.0 see .+", "bsl-notice"),
    (r"to the extent possible under law .+ waived all copyright and related or neighboring rights to .+", "cc0-waiver"),
    (r"(this work|.+) is licensed under a creative commons attribution 4.0 international license", "cc-by-4.0-notice"),
)

NOTICE_RULES += (
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-product", "bsd-names")),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-names")),
    ("BSL-1.0", ("bsl-grant",)),
    ("BSL-1.0", ("bsl-notice",)),
    ("Zlib", ("zlib-as-is", "zlib-liability", "zlib-grant")),
    ("Zlib", ("zlib-grant",)),
    ("WTFPL", ("wtfpl-grant", "wtfpl-terms")),
    ("WTFPL", ("wtfpl-grant",)),
    ("EPL-2.0", ("epl-2.0-grant",)),
    ("EPL-1.0", ("epl-1.0-grant",)),
    ("CC0-1.0", ("cc0-waiver",)),
    ("blessing", ("blessing-grant", "blessing-blessing")),
)

#: Names of licences as grants, tags and titles write them, without the words that _bare takes away.
NAMES = {
    "Apache-2.0": ("apache 2.0", "apache 2", "asl 2.0"),
    "MIT": ("mit", "mit mit", "expat", "mit expat", "expat mit", "mit x11"),
    "BSD-2-Clause": ("bsd 2 clause", "2 clause bsd", "two clause bsd", "simplified bsd", "freebsd"),
    "BSD-3-Clause": ("bsd 3 clause", "3 clause bsd", "three clause bsd", "new bsd", "modified bsd", "revised bsd", "bsd 3 clause new or revised"),
    "BSD-4-Clause": ("bsd 4 clause", "4 clause bsd", "original bsd"),
    "ISC": ("isc",),
    "Zlib": ("zlib", "zlib libpng"),
    "BSL-1.0": ("boost 1.0", "bsl 1.0", "boost"),
    "EPL-1.0": ("eclipse public 1.0", "epl 1.0"),
    "EPL-2.0": ("eclipse public 2.0", "epl 2.0"),
    "MPL-2.0": ("mozilla public 2.0", "mpl 2.0"),
    "MPL-1.1": ("mozilla public 1.1", "mpl 1.1"),
    "Artistic-2.0": ("artistic 2.0",),
    "WTFPL": ("wtfpl",),
    "Unlicense": ("unlicense",),
    "CC0-1.0": ("cc0", "cc0 1.0", "cc0 1.0 universal", "creative commons zero 1.0 universal"),
    **{f"CC-BY{k}-{v}": (f"cc by{k.lower().replace('-', ' ')} {v}", f"creative commons attribution{long} {v} international", f"creative commons attribution{long} {v}", f"creative commons attribution{long} {v} unported") for v in ("3.0", "4.0") for k, long in (("", ""), ("-SA", " sharealike"), ("-NC", " noncommercial"), ("-ND", " noderivatives"), ("-NC-SA", " noncommercial sharealike"), ("-NC-ND", " noncommercial noderivatives"))},
}
for _short, _long, _versions in (("gpl", "gnu general public", ("2", "3")), ("lgpl", "gnu lesser general public", ("2.1", "3")), ("agpl", "gnu affero general public", ("3",))):
    for _v in _versions:
        _full = _v if "." in _v else f"{_v}.0"
        for _kind, _ends in (("only", ("", " only")), ("or-later", (" or later", " or any later", " or at your option any later"))):
            NAMES[f"{_short.upper()}-{_full}-{_kind}"] = tuple(dict.fromkeys(f"{name} {number}{end}" for name in (_short, f"gnu {_short}", _long) for number in (_v, _full) for end in _ends))
#: "or" inside a name joins nothing.
_INNER = r" or (later|any later|at your|revised)"
_NAMED = {re.sub(_INNER, r" or_\1", name): spdx for spdx, names in NAMES.items() for name in names}
NOTICE_RULES += tuple((spdx, (f"{kind}:{spdx}",)) for spdx in NAMES for kind in ("grant", "tag"))
#: A line end inside a sentence, with the marks that comments begin lines with; the small letter or bracket is kept.
WRAP = r"\n[ \t#*/]*([a-z(])"
#: Between words in capitals a line end is white space in the second reading, and marked for the third; twice, since neighbours share a word.
CAPITALS = r"([A-Z]{2}[,\"]{0,2}[ \t]{0,4})\n+([ \t#*/]*\"?[A-Z]{2})"
#: Where sentences end in the three readings.
BREAKS = (
    r"\n(?:[^\p{L}\p{N}\n]*\n)+|[.!?;:]+(?:[ \t]+|[ \t]*\n)",
    r"\n+|[.!?;:]+[ \t]+",
    r"[\n\x0B]+|[.!?;:]+[ \t]+",
)
#: Before the cut: line ends are line feeds; a tag line is a sentence of its own; "v. 2.0", "Inc. " and "GPL+" end no sentence.
REWRITES = (
    (r"\r\n?", r"\n"),
    (r"(?i)(SPDX-License-Identifier):[ \t]*([^\n]*)", r"\n\n\1 \2\n\n"),
    (r"\b([Vv])\.[ \t]+([0-9])", r"\1 \2"),
    (r"\b(Inc|Ltd|Corp|Co|LLC|GmbH|Dr|Jr|al)\.([ \t,]|\n[ \t#*/]*[a-z])", r"\1\2"),
    (r"\b([A-Z])\.[ \t]+([A-Z])", r"\1 \2"),
    (r"\b([A-Z])\.[ \t]+([A-Z])", r"\1 \2"),
    (r"(?i)(GPL-?v?[0-9](?:\.[0-9])?)\+", r"\1-or-later"),
)
#: Every known sentence has one of these in it (checked on import), so others needn't be cut.
CLUES = ("licen", "permission", "redistribut", "copyright", "warranty", "software", "public", "rights", "endorse", "damages", "permitted", "you want to", "advertising", "blessing", "neither the name", "names of", "available under", "released under", "distributed under", "published under", "provided under", "offered under", "shared under", "subject to", "gpl")

assert all(any(clue in sentence for clue in CLUES) for sentence in SENTENCES | NOTICES)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A grant: up to fifteen words, then what is done, under which licence. Words that deny it.
_GRANT = r"^(?:[^ ]+ ){0,15}?(?:licen[sc]ed|released|distributed|redistributed|available|published|provided|offered|covered|governed|shared) (?:under|by|with|subject to) (?:the )?(?:terms (?:and conditions )?of )?(?:either (?:of )?)?(?:the |an |a )?(.+)$"
_DENIED = r"(?:^| )(?:not|never|no|previously|formerly|unless|if|cannot|neither|nor|was|were|originally|except)(?: |$)"
_EXCEPTION = r" with [^ ]+( [^ ]+)*?( or | and |$)"
_TAG = r"^(?:.* )?spdx license identifier (.+)$"


def normalised(sentence: Column) -> Column:
    """Lower-cased letters and digits (with the dots inside numbers), separated by single spaces."""
    plain = F.translate(sentence, _UPPER, _LOWER)
    spaced = F.regexp_replace(plain, r"[^a-z0-9.]+", " ")
    undotted = F.regexp_replace(spaced, r"\.+( |$)|(^| )\.+", " ")
    return F.trim(F.regexp_replace(undotted, r" +", " "))


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in sorted(pairs.items()) for x in pair))


#: Words of a licence's name that don't tell it apart, and the ways to write a version: pattern and replacement, one after the other.
_BARE = ((r" at your option$", ""), (r"(^| )(a?l?gpl)v?([0-9])", r"\1\2 \3"), (r"(^| )v(ersion)? ?([0-9])", r"\1\3"), (r"(^| )(the |an? )+", r"\1"), (r" licen[sc]es?( |$)", r"\1"), (r" software( |$)", r"\1"), (r" version( |$)", r"\1"), (r" +", " "))


def _bare(name: Column) -> Column:
    for pattern, by in _BARE:
        name = F.regexp_replace(name, pattern, by.replace("\\", "$"))
    return F.trim(name)


def _let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.get(F.transform(F.array(value), then), 0)


def _known(sentence: Column) -> Column:
    """The identifiers of a sentence, as an array; null if it isn't known."""
    lookup, names = _map(SENTENCES | NOTICES), _map(_NAMED)

    def licences(text: Column, kind: str) -> Column:
        """Names joined by and / or, without exceptions: their identifiers, null if one isn't known."""
        bare = F.regexp_replace(F.regexp_replace(text, _INNER, " or_$1"), _EXCEPTION, "$2")
        parts = F.split(bare, " (?:or|and) ")
        found = F.transform(parts, lambda p: F.try_element_at(names, _bare(p)))
        return _let(found, lambda x: F.when(F.forall(x, lambda y: y.isNotNull()) & (F.size(x) > 0), F.transform(x, lambda y: F.concat(F.lit(f"{kind}:"), y))))

    def of(s: Column) -> Column:
        template = F.lit(None).cast("string")
        for pattern, name in reversed(TEMPLATES):
            template = F.when(s.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(template)
        one = lambda x: _let(x, lambda y: F.when(y.isNotNull(), F.array(y)))
        granted = F.when(s.contains("under") | s.contains(" by ") | s.contains(" with ") | s.contains("subject to"), F.when(~s.rlike(_DENIED), _let(F.regexp_extract(s, _GRANT, 1), lambda x: F.when(x != "", licences(x, "grant")))))
        tagged = F.when(s.contains("spdx license identifier"), _let(F.regexp_extract(s, _TAG, 1), lambda x: F.when(x != "", licences(x, "tag"))))
        title = F.when(s.rlike("licen[sc]e|unlicense|wtfpl") & (F.length(s) < 80), _let(F.try_element_at(names, _bare(F.regexp_replace(s, _INNER, " or_$1"))), lambda y: F.when(y.isNotNull(), F.array(F.concat(F.lit("title:"), y)))))
        return F.coalesce(one(F.try_element_at(lookup, s)), tagged, one(template), granted, title)

    return _let(normalised(sentence), of)


def _read(text: Column, level: int = 0) -> Column:
    """The identifiers of a text cut at the level's breaks; what that doesn't know is cut at the next level's."""
    if level == 1:
        for _ in range(2):
            text = F.regexp_replace(text, CAPITALS, "$1\x0b$2")
    pieces = F.split(text, BREAKS[level])
    rest = (lambda s: _read(s, level + 1)) if level + 1 < len(BREAKS) else lambda s: F.array().cast("array<string>")
    return F.flatten(F.transform(pieces, lambda s: F.when(_hinted(s), F.coalesce(_known(s), rest(s))).otherwise(F.array().cast("array<string>"))))


def _hinted(text: Column) -> Column:
    """Whether a text has a clue. Words are searched for first; phrases, which may be wrapped, only where their first word is."""
    lower, out = F.lower(text), F.lit(False)
    for clue in CLUES:
        if " " not in clue:
            out = out | F.contains(lower, F.lit(clue))
    phrases = [clue for clue in CLUES if " " in clue]
    begins = F.lit(False)
    for word in dict.fromkeys(clue.split(" ")[1 if clue.endswith("under") else 0] for clue in phrases):
        begins = begins | F.contains(lower, F.lit(word))
    return out | (begins & lower.rlike("|".join(phrases).replace(" ", r"\s+")))


def _identifiers(text: Column) -> Column:
    """The identifiers of a text's known sentences in order, as one array."""
    for pattern, by in REWRITES:
        text = F.regexp_replace(text, pattern, by.replace("\\n", "\n").replace("\\", "$"))
    return _read(F.regexp_replace(text, WRAP, " $1"))


def _rules() -> list[tuple[str, str]]:
    """Every rule as the text of its identifiers and the licence that takes their place; titles last, those beside their licence before those alone."""
    plain = [("".join(f"|{s}|" for s in sequence), f"<{spdx}>") for spdx, sequence in NOTICE_RULES + RULES]
    # A title and a licence of the same name, side by side, are one.
    joined = [pair for spdx in NAMES for pair in ((f"|title:{spdx}|<{spdx}>", f"<{spdx}>"), (f"<{spdx}>|title:{spdx}|", f"<{spdx}>"), (f"|title:{spdx}|", f"<{spdx}>"))]
    return plain + joined


def _matched(names: Column) -> Column:
    """Licences and leftovers: the identifiers as one string, in which the ordered rules replace their sequences."""
    out = F.concat(F.lit("|"), F.array_join(names, "||"), F.lit("|"))
    for sequence, licence in _rules():
        out = F.replace(out, F.lit(sequence), F.lit(licence))
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, licenses (in order of appearance, joined by commas), n_licenses, n_sentences, n_unmatched of every document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    names = F.when(_hinted(text), _identifiers(text)).otherwise(F.array().cast("array<string>"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), names.alias("names"))
    rows = rows.withColumn("marks", F.when(F.size("names") > 0, _matched(F.col("names"))).otherwise(F.lit("")))
    licenses = F.regexp_extract_all("marks", F.lit("<([^>]+)>"), F.lit(1))
    left = F.regexp_extract_all("marks", F.lit(r"\|([^|<>]+)\|"), F.lit(1))
    return rows.select("doc_id", F.array_join(licenses, ",").alias("licenses"), F.size(licenses).alias("n_licenses"), F.size("names").alias("n_sentences"), F.size(left).alias("n_unmatched"))


def _known_sql(sentence: str) -> str:
    """_known for DuckDB."""
    pairs = lambda d: "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in sorted(d.items())) + "}"
    bare = lambda x: _chained("trim({})", x, ((p, b) for p, b in _BARE))
    inner = lambda x: f"regexp_replace({x}, '{_INNER}', ' or_\\1', 'g')"
    parts = lambda x: f"list_transform(string_split_regex(regexp_replace({inner(x)}, '{_EXCEPTION}', '\\2', 'g'), ' (?:or|and) '), lambda p: names[{bare('p')}])"
    named = lambda x, kind: f"(SELECT CASE WHEN len(list_filter(f, lambda y: y IS NULL)) = 0 THEN list_transform(f, lambda y: '{kind}:' || y) END FROM (SELECT {parts(x)} AS f))"
    templates = " ".join(f"WHEN regexp_matches(n, '^(?:{p})$') THEN ['{i}']" for p, i in TEMPLATES)
    plain = f"regexp_replace(translate({sentence}, '{_UPPER}', '{_LOWER}'), '[^a-z0-9.]+', ' ', 'g')"
    norm = f"trim(regexp_replace(regexp_replace({plain}, '\\.+( |$)|(^| )\\.+', ' ', 'g'), ' +', ' ', 'g'))"
    grant, tag = f"regexp_extract(n, '{_GRANT}', 1)", f"regexp_extract(n, '{_TAG}', 1)"
    return f"""(SELECT coalesce(CASE WHEN sentences[n] IS NOT NULL THEN [sentences[n]] END, CASE WHEN {tag} <> '' THEN {named(tag, 'tag')} END, CASE {templates} END,
      CASE WHEN NOT regexp_matches(n, '{_DENIED}') AND {grant} <> '' THEN {named(grant, 'grant')} END,
      CASE WHEN regexp_matches(n, 'licen[sc]e|unlicense|wtfpl') AND length(n) < 80 AND names[{bare(inner('n'))}] IS NOT NULL THEN ['title:' || names[{bare(inner('n'))}]] END)
      FROM (SELECT {norm} AS n, {pairs(SENTENCES | NOTICES)} AS sentences, {pairs(_NAMED)} AS names))"""


def _chained(outer: str, text: str, steps) -> str:
    for pattern, by in steps:
        text = f"regexp_replace({text}, '{pattern}', '{by}', 'g')"
    return outer.format(text)


def oracle_sql() -> str:
    """The scan for DuckDB, over the view documents: the same tables and readings, joined level by level."""
    hint = "|".join(CLUES).replace(" ", r"\s+")
    hinted = lambda x: f"regexp_matches(translate({x}, '{_UPPER}', '{_LOWER}'), '{hint}')"
    text = _chained("{}", "coalesce(text, '')", ((p, b.replace(r"\n", "\n")) for p, b in (*REWRITES, (WRAP, r" \1"))))
    capitals = _chained("{}", "s", ((CAPITALS, "\\1\x0b\\2"),) * 2)
    marks = "'|' || array_to_string(names, '||') || '|'"
    for sequence, licence in _rules():
        marks = f"replace({marks}, '{sequence}', '{licence}')"
    cut = lambda source, expr, level, keys: f"SELECT doc_id, {keys}, unnest(range(len(p))) AS i{level}, unnest(p) AS s FROM (SELECT doc_id, {keys}, string_split_regex({expr}, '{BREAKS[level]}') AS p FROM {source})"
    levels = []
    for level, (source, expr, keys) in enumerate((("(SELECT doc_id, 0 AS root, {} AS s FROM documents WHERE {})".format(text, hinted("coalesce(text, '')")), "s", "root"), ("r0 WHERE ids IS NULL", capitals, "root, i0"), ("r1 WHERE ids IS NULL", "s", "root, i0, i1"))):
        levels.append(f"c{level} AS ({cut(source, expr, level, keys)}), r{level} AS MATERIALIZED (SELECT *, {_known_sql('s')} AS ids FROM c{level} WHERE {hinted('s')})")
    return f"""
WITH {", ".join(levels)}, found AS (
  SELECT doc_id, i0, -1 AS i1, -1 AS i2, ids FROM r0 WHERE ids IS NOT NULL
  UNION ALL SELECT doc_id, i0, i1, -1, ids FROM r1 WHERE ids IS NOT NULL
  UNION ALL SELECT doc_id, i0, i1, i2, ids FROM r2 WHERE ids IS NOT NULL
), named AS (
  SELECT d.doc_id, coalesce(flatten(list(f.ids ORDER BY f.i0, f.i1, f.i2) FILTER (f.ids IS NOT NULL)), []) AS names FROM documents d LEFT JOIN found f ON f.doc_id = d.doc_id GROUP BY d.doc_id
), marked AS (
  SELECT doc_id, len(names) AS n, CASE WHEN len(names) > 0 THEN {marks} ELSE '' END AS marks FROM named
)
SELECT doc_id, array_to_string(regexp_extract_all(marks, '<([^>]+)>', 1), ',') AS licenses,
       CAST(len(regexp_extract_all(marks, '<([^>]+)>', 1)) AS INTEGER) AS n_licenses,
       CAST(n AS INTEGER) AS n_sentences,
       CAST(len(regexp_extract_all(marks, '\\|([^|<>]+)\\|', 1)) AS INTEGER) AS n_unmatched
FROM marked"""

"""Licence scans by sentence rules.

Sentences are normalised to lower-case words and mapped to identifiers of known
licence sentences; the identifiers of a text, in order, are matched against
ordered licence rules, other known sentences in between allowed.  A known
sentence begins and ends at the end of a sentence or line, a semicolon or a
colon, and may go on over all of these but the first.  A notice (that something
is licensed under a licence) begins there too, may have its subject in front,
and ends with the licence's name, whatever follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import lower_ascii

#: Names of licences, as lower-case words.
NAMES = {
    "AGPL-3.0": ("gnu affero general public license version 3", "gnu affero general public license v3", "gnu agpl v3", "agpl v3", "agplv3", "agpl 3 0"),
    "Apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache license v2 0", "apache 2 0 license", "apache 2 0"),
    "BSD-2-Clause": ("bsd 2 clause license", "2 clause bsd license", "simplified bsd license"),
    "BSD-3-Clause": ("bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license", "revised bsd license"),
    "BSL-1.0": ("boost software license version 1 0", "boost software license 1 0"),
    "CC-BY-4.0": ("cc by 4 0", "creative commons attribution 4 0 international license", "creative commons attribution 4 0 license"),
    "CC-BY-NC-4.0": ("cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"),
    "CC-BY-NC-SA-4.0": ("cc by nc sa 4 0", "creative commons attribution noncommercial sharealike 4 0 international license"),
    "CC-BY-ND-4.0": ("cc by nd 4 0", "creative commons attribution noderivatives 4 0 international license"),
    "CC-BY-SA-4.0": ("cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"),
    "CC0-1.0": ("cc0 1 0 universal", "cc0 1 0", "creative commons zero v1 0 universal"),
    "EPL-2.0": ("eclipse public license version 2 0", "eclipse public license v2 0", "eclipse public license 2 0", "epl 2 0"),
    "GPL-2.0": ("gnu general public license version 2", "gnu general public license v2", "gnu gpl version 2", "gpl version 2", "gpl v2", "gplv2"),
    "GPL-3.0": ("gnu general public license version 3", "gnu general public license v3", "gnu gpl version 3", "gpl version 3", "gpl v3", "gplv3"),
    "ISC": ("isc license",),
    "LGPL-2.1": ("gnu lesser general public license version 2 1", "gnu lesser general public license v2 1", "lgpl version 2 1", "lgpl v2 1", "lgplv2 1"),
    "LGPL-3.0": ("gnu lesser general public license version 3", "gnu lesser general public license v3", "lgpl version 3", "lgpl v3", "lgplv3"),
    "MIT": ("mit license", "expat license"),
    "MPL-2.0": ("mozilla public license version 2 0", "mozilla public license v2 0", "mozilla public license 2 0", "mpl 2 0"),
    "Unlicense": ("unlicense",),
    "WTFPL": ("do what the fuck you want to public license", "wtfpl"),
    "Zlib": ("zlib license", "zlib libpng license"),
}
_FREE = "this {0} is free software you can redistribute it and or modify it under the terms of the gnu {1}general public license as published by the free software foundation either version {2} of the license or at your option any later version"
_HOPE = "this {0} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"
#: Known sentences, as lower-case words.
SENTENCES = {
    "agpl-3-free": _FREE.format("program", "affero ", "3"),
    "apache-2-use": "you may not use this file except in compliance with the license",
    "apache-2-grant": "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form",
    "apache-2-terms": "terms and conditions for use reproduction and distribution",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-name": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsl-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "gpl-2-free": _FREE.format("program", "", "2"),
    "gpl-3-free": _FREE.format("program", "", "3"),
    "gpl-warranty": _HOPE.format("program"),
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "lgpl-2-free": _FREE.format("library", "lesser ", "2 1"),
    "lgpl-3-free": _FREE.format("library", "lesser ", "3"),
    "lgpl-warranty": _HOPE.format("library"),
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-condition": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mpl-2-subject": "this source code form is subject to the terms of the mozilla public license v",
    "mpl-2-copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "mpl-2-copy-old": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "reserved": "all rights reserved",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "wtfpl-do": "you just do what the fuck you want to",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "zlib-origin": "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
}


def _by_rule() -> dict[str, str]:
    """Titles and SPDX lines of each licence, by sentence."""
    out = {}
    for licence, names in NAMES.items():
        for n in names:
            if "license" in n:
                out[n] = out[f"the {n}"] = f"{licence}:title"
        words = licence.lower().replace("-", " ").replace(".", " ")
        for tail in ("", " only", " or later"):
            out[f"spdx license identifier {words}{tail}"] = f"{licence}:spdx"
    out["mit license mit"] = out["the mit license mit"] = "MIT:title"
    return out


#: Identifier of each known sentence; notices have theirs by the licence's name.
KNOWN = {s: k for k, s in SENTENCES.items()} | _by_rule()
#: The licence's name of each notice, longer names first.
NOTICES = dict(sorted(((n, f"{licence}:notice") for licence, names in NAMES.items() for n in names), key=lambda x: (-len(x[0]), x[0])))
#: Ordered sentences of each licence rule, and a sentence that must not follow before the first comes again.
LICENCE_RULES = tuple((licence, (f"{licence}:{kind}",), None) for licence in NAMES for kind in ("notice", "spdx", "title")) + (
    ("AGPL-3.0", ("agpl-3-free", "gpl-warranty"), None),
    ("Apache-2.0", ("Apache-2.0:notice", "apache-2-use"), None),
    ("Apache-2.0", ("apache-2-terms", "apache-2-grant"), None),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary"), "bsd-name"),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-name"), None),
    ("BSL-1.0", ("bsl-grant",), None),
    ("GPL-2.0", ("gpl-2-free", "gpl-warranty"), None),
    ("GPL-3.0", ("gpl-3-free", "gpl-warranty"), None),
    ("ISC", ("isc-grant",), None),
    ("LGPL-2.1", ("lgpl-2-free", "lgpl-warranty"), None),
    ("LGPL-3.0", ("lgpl-3-free", "lgpl-warranty"), None),
    ("MIT", ("mit-grant", "mit-condition"), None),
    ("MPL-2.0", ("mpl-2-subject", "mpl-2-copy"), None),
    ("MPL-2.0", ("mpl-2-subject", "mpl-2-copy-old"), None),
    ("Proprietary", ("reserved",), None),
    ("Unlicense", ("unlicense-free",), None),
    ("WTFPL", ("wtfpl-do",), None),
    ("Zlib", ("zlib-grant", "zlib-origin"), None),
)
#: Each known sentence has one of these, so a text without any of them has no known sentence.
ANCHORS = ("licen", "permission", "redistribut", "rights", "under", "unencumbered", "copyright", "terms and", "mpl", "free software", "origin", "do what", "hope that")

#: Marks of a sentence's end, and of a line's end or a semicolon or colon, at which a known sentence may begin, go on or end.
_FULL, _PART = "\x01", "\x02"
#: How a notice begins; in front may be what is licensed.
_SUBJECT = "(?:(?:this|the|all|our)(?: [^ \x01\x02]+){1,6}? (?:is|are) (?:made )?)?"
_UNDER = "(?:dual )?(?:licensed|released|distributed|available|published|provided|covered|redistributable) under (?:an? |the )?(?:terms (?:and conditions )?of )?(?:an? |the )?"


def known_pattern(space: str) -> tuple[str, str]:
    """Patterns of a known sentence and of a notice; between their words is ``space``.  The shorter of two sentences goes first, so that none hides another."""
    sentences = "|".join(s.replace(" ", space) for s in sorted(KNOWN, key=lambda s: (len(s), s)))
    notice = f"{_SUBJECT}{_UNDER}(?:{'|'.join(NOTICES)})\\b".replace(" ", space).replace(f"[^{space}", "[^ ")
    return sentences, notice


def _sequence(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    marked = F.translate(lower_ascii(text), _FULL + _PART, "--")
    marked = F.regexp_replace(marked, r"(?<=[.!?])\s+", _FULL)
    marked = F.regexp_replace(marked, r"\n+|(?<=[:;])\s+", _PART)
    marked = F.concat(F.lit(_FULL), F.regexp_replace(marked, r"[\x00\x03-\x2F\x3A-\x60\x7B-\x7F]+", " "), F.lit(_FULL))
    marked = F.regexp_replace(marked, f" ?{_PART}[ {_PART}]*", _PART)
    marked = F.regexp_replace(marked, f"[ {_PART}]?{_FULL}[ {_FULL}{_PART}]*", _FULL)
    sentences, notice = known_pattern(f"[ {_PART}]")
    both = f"(?<=[{_FULL}{_PART}])(?:(?:{sentences})(?=[{_FULL}{_PART}])|{notice})"
    known = F.map_from_arrays(F.array(*[F.lit(s) for s in KNOWN]), F.array(*[F.lit(n) for n in KNOWN.values()]))
    named = F.map_from_arrays(F.array(*[F.lit(s) for s in NOTICES]), F.array(*[F.lit(n) for n in NOTICES.values()]))
    tail = F.lit(f"({'|'.join(NOTICES)})$")
    identify = lambda s: F.coalesce(F.element_at(known, s), F.element_at(named, F.regexp_substr(s, tail)))
    return F.transform(F.regexp_extract_all(marked, F.lit(both), F.lit(0)), lambda s: identify(F.translate(s, _PART, " ")))


def scan_licences(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with sentences (identifiers in order) and licences (sorted names).

    A null or empty text has none.  Texts of any length are read whole.  Each
    row is judged by itself, repeated ones alike; an empty table gives an empty
    one.  Columns of these names are replaced, others pass through.
    """
    text = F.col(text_col)
    anchored = text.rlike("(?i)" + "|".join(ANCHORS))
    none = F.array().cast("array<string>")
    out = docs.withColumn("sentences", F.when(anchored, _sequence(text)).otherwise(none))
    line = F.concat(F.lit(","), F.array_join("sentences", ","), F.lit(","))
    named = []
    for licence, ids, but in LICENCE_RULES:
        rest = "^,(?:[^,]+,)*?" + "(?:[^,]+,)*?".join(f"{k}," for k in ids[1:])
        # The parts of the sequence from one of the first sentence to the next.
        parts = F.slice(F.split(line, f"(?<=,){ids[0]}(?=,)"), 2, F.size("sentences") + 1)
        fits = F.exists(parts, lambda p: p.rlike(rest) & (~p.contains(f",{but},") if but else F.lit(True))) if len(ids) > 1 else line.contains(f",{ids[0]},")
        named.append(F.when(fits, F.lit(licence)))
    licences = F.array_sort(F.array_distinct(F.array_compact(F.array(*named))))
    return out.withColumn("licences", F.when(F.size("sentences") > 0, licences).otherwise(none))

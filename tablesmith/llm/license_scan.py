"""License scan by sentence rules, with DataFrame functions only.

Comment marks at line starts are taken off, then a text is cut into sentences twice: by paragraphs, whose wrapped lines are joined, and
by lines, for notices that stand on a line of their own without a full stop. A sentence is normalised to lower-case ASCII words; a
lead-in ("this project is ...") and the verb of a notice ("licensed under the ...") are reduced. Known sentences have
identifiers; the text becomes the sequence of these, a run of other sentences being one gap. Rules are patterns over that sequence;
a rule that matches either sequence gives its licence. BSD-2-Clause is moot where BSD-3-Clause is found, and "all rights
reserved" where any licence is. Sentences without a word that every known sentence has one of are gaps without further work.

Edge cases: null, empty and unlicensed texts have no licence (empty string) and verdict ``none``; licences are listed in the order of
the rules, each once, however often and in whatever order the text has them; repeated rows and rows without an id are judged one by one;
texts of any length are read whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Identifiers and normalised sentences of public licence texts.
SENTENCES = {
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit_notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit_as_is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd_grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_name": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "apache_copy": "you may obtain a copy of the license at",
    "apache_unless": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache_title": "apache license version 2 0 january 2004 http www apache org licenses",
    "gpl3_title": "gnu general public license version 3 29 june 2007",
    "gpl2_title": "gnu general public license version 2 june 1991",
    "lgpl3_title": "gnu lesser general public license version 3 29 june 2007",
    "lgpl21_title": "gnu lesser general public license version 2 1 february 1999",
    "agpl3_title": "gnu affero general public license version 3 19 november 2007",
    "mpl2_form": "this source code form is subject to the terms of the mozilla public license v",
    "mpl2_title": "mozilla public license version 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "zlib_grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "reserved": "all rights reserved",
}
FREE = "this {} is free software you can redistribute it and or modify it under the terms of the gnu {}general public license as published by the free software foundation either version {} of the license or at your option any later version"
SENTENCES |= {
    f"{kind}{version.replace(' ', '')}_free_{subject}": FREE.format(subject, word, version)
    for kind, word in (("gpl", ""), ("lgpl", "lesser "), ("agpl", "affero "))
    for version in ("2", "2 1", "3")
    for subject in ("program", "library")
}
GNU = {"GPL": "general public license", "LGPL": "lesser general public license", "AGPL": "affero general public license"}
CREATIVE = {
    "BY": "attribution",
    "BY-SA": "attribution sharealike",
    "BY-ND": "attribution noderivatives",
    "BY-NC": "attribution noncommercial",
    "BY-NC-SA": "attribution noncommercial sharealike",
    "BY-NC-ND": "attribution noncommercial noderivatives",
}
#: How notices name a licence, normalised.
NAMES = {
    "MIT": ["mit license", "mit", "expat license"],
    "Apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache 2 0", "apache license v2 0", "apache license version 2 0 the license", "apache license version 2 0 the license you may not use this file except in compliance with the license"],
    "BSD-3-Clause": ["bsd 3 clause license", "3 clause bsd license", "bsd 3 clause", "new bsd license", "modified bsd license"],
    "BSD-2-Clause": ["bsd 2 clause license", "2 clause bsd license", "bsd 2 clause", "simplified bsd license", "bsd license"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license 2 0", "mpl 2 0"],
    "EPL-2.0": ["eclipse public license version 2 0", "eclipse public license 2 0", "epl 2 0"],
    "BSL-1.0": ["boost software license version 1 0", "boost software license 1 0"],
    "ISC": ["isc license"],
    "Zlib": ["zlib license"],
    "CC0-1.0": ["cc0 1 0", "cc0", "cc0 1 0 universal"],
    "Unlicense": ["unlicense"],
}


def _gnu_names(short: str, version: str) -> list[str]:
    forms = [version.replace(".", " "), *([version[0]] if version.endswith(".0") else [])]
    long = [f"gnu {GNU[short]} {word}{v}" for word in ("version ", "v", "") for v in forms]
    return long + [f"{gnu}{short.lower()}{word}{v}" for gnu in ("gnu ", "") for word in (" version ", " v", "v", " ") for v in forms]


def _creative_names(code: str) -> list[str]:
    plain = f"cc {code.lower().replace('-', ' ')} 4 0"
    return [plain, f"{plain} license", f"creative commons {CREATIVE[code]} 4 0 international license", f"creative commons {CREATIVE[code]} 4 0 license"]


NAMES |= {f"{s}-{v}": _gnu_names(s, v) for s, v in (("GPL", "2.0"), ("GPL", "3.0"), ("LGPL", "2.1"), ("LGPL", "3.0"), ("AGPL", "3.0"))}
NAMES |= {f"CC-{code}-4.0": _creative_names(code) for code in CREATIVE}
#: In order: licence, class, pattern over the identifiers (each followed by a space; a gap is "- "). A notice's identifier is "@" and the licence.
RULES = [
    ("AGPL-3.0-or-later", "copyleft", "agpl3_free_(program|library) "),
    ("AGPL-3.0", "copyleft", "(@AGPL-3.0|agpl3_title) "),
    ("LGPL-3.0-or-later", "copyleft", "lgpl3_free_(program|library) "),
    ("LGPL-2.1-or-later", "copyleft", "lgpl21_free_(program|library) "),
    ("LGPL-3.0", "copyleft", "(@LGPL-3.0|lgpl3_title) "),
    ("LGPL-2.1", "copyleft", "(@LGPL-2.1|lgpl21_title) "),
    ("GPL-3.0-or-later", "copyleft", "gpl3_free_(program|library) "),
    ("GPL-2.0-or-later", "copyleft", "gpl2_free_(program|library) "),
    ("GPL-3.0", "copyleft", "(@GPL-3.0|gpl3_title) "),
    ("GPL-2.0", "copyleft", "(@GPL-2.0|gpl2_title) "),
    ("Apache-2.0", "permissive", "(@Apache-2.0|apache_title|apache_copy (- )?apache_unless) "),
    ("MIT", "permissive", "(@MIT|mit_grant (- )?(mit_notice|mit_as_is)) "),
    ("ISC", "permissive", "(@ISC|isc_grant) "),
    ("BSD-3-Clause", "permissive", "(@BSD-3-Clause|bsd_grant (- )?(bsd_source (- )?)?(bsd_binary (- )?)?bsd_name) "),
    ("BSD-2-Clause", "permissive", "(@BSD-2-Clause|bsd_grant) "),
    ("MPL-2.0", "copyleft", "(@MPL-2.0|mpl2_form|mpl2_title) "),
    ("EPL-2.0", "copyleft", "@EPL-2.0 "),
    ("BSL-1.0", "permissive", "@BSL-1.0 "),
    ("Zlib", "permissive", "(@Zlib|zlib_grant) "),
    *[(f"CC-{code}-4.0", "noncommercial" if "NC" in code else "restricted" if "ND" in code else "copyleft" if "SA" in code else "permissive", f"@CC-{code}-4.0 ") for code in CREATIVE],
    ("CC0-1.0", "permissive", "@CC0-1.0 "),
    ("Unlicense", "permissive", "(@Unlicense|unlicense) "),
    ("Proprietary", "restricted", "reserved "),
]
#: A rule that is moot where another is found.
MOOT = {"BSD-2-Clause": ["BSD-3-Clause"], "Proprietary": [r[0] for r in RULES if r[0] != "Proprietary"]}
CLASSES = ("restricted", "noncommercial", "copyleft", "permissive")
COMMENT = r"(?m)^[ \t]*(?://+|/\*+|\*+/?|#+|--+|;+|%+)[ \t]*"
LINE_END = r"\n|[.!?][ \t\f\r]+"
PARAGRAPH_END = r"[.!?][\"')]*[ \t\f\r\n]+|:[ \t\r]*\n|\n[ \t\r]*\n|\n[ \t]*(?:[0-9]{1,2}|[a-z])[.)][ \t]+"
#: Every known sentence and notice holds one of these.
MARK = r"(?i)licen|permi|rights|redistrib|unencumbered|warrant|under[ \t\r\n]"
OTHER = "[^A-Za-z0-9]+"
LEAD_IN = "^(?:this|the|our|all|it)(?: [a-z0-9]+){0,4} (?:is|are) (?:dual )?(licensed|released|distributed|available|provided|made available) under "
NOTICE = "^(?:licensed|released|distributed|available|provided|made available) under (?:the |a |an )?"
SPDX = "^spdx license identifier "


def known_sentences() -> dict[str, str]:
    """Normalised and reduced sentences with their identifiers: the texts, the notices, and SPDX lines."""
    found = {sentence: name for name, sentence in SENTENCES.items()}
    for name, forms in NAMES.items():
        found |= {f"under {form}": f"@{name}" for form in forms}
        found |= {f"spdx {name.lower().replace('-', ' ').replace('.', ' ')}{end}": f"@{name}" for end in ("", " only", " or later")}
    return found


def _sequence(parts: Column, known: dict[str, str]) -> Column:
    """The identifiers of sentences, those of other sentences being ``-``."""
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])

    def identify(s: Column) -> Column:
        plain = F.trim(F.lower(F.regexp_replace(s, OTHER, " ")))
        reduced = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, LEAD_IN, "$1 under "), NOTICE, "under "), SPDX, "spdx ")
        return F.when(s.rlike(MARK), F.when(reduced.isin(*known), F.element_at(table, reduced))).otherwise(F.lit(None).cast("string"))

    return F.transform(parts, lambda s: F.coalesce(identify(s), F.lit("-")))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_sentences`` (known ones), ``licenses`` (in the order of the rules, comma-joined), ``verdict`` (the strictest class)."""
    text, known = F.coalesce(F.col(text_col).cast("string"), F.lit("")), known_sentences()
    plain = F.when(text.rlike(MARK), F.regexp_replace(text, COMMENT, "")).otherwise(F.lit(""))
    found = df.select(F.col(id_col), plain.alias("plain")).select(id_col, *[_sequence(F.split("plain", end), known).alias(c) for c, end in (("lines", LINE_END), ("paragraphs", PARAGRAPH_END))])
    count = F.greatest(*[F.size(F.filter(c, lambda s: s != "-")) for c in ("lines", "paragraphs")])
    joined = [F.regexp_replace(F.concat(F.array_join(c, " "), F.lit(" ")), "(- )+", "- ").alias(c) for c in ("lines", "paragraphs")]
    found = found.select(id_col, count.cast("long").alias("n_sentences"), *joined)
    hit = {name: F.col("lines").rlike(p) | F.col("paragraphs").rlike(p) for name, _, pattern in RULES for p in ["(^| )" + pattern.replace(".", r"\.")]}
    chosen = [F.when(hit[name] & ~reduce(lambda x, y: x | y, [hit[m] for m in MOOT.get(name, [])], F.lit(False)), F.lit(name)) for name, _, _ in RULES]
    found = found.select(id_col, "n_sentences", F.array_compact(F.array(*chosen)).alias("found"))
    verdict = F.lit("none")
    for k in reversed(CLASSES):
        verdict = F.when(F.arrays_overlap("found", F.array(*[F.lit(n) for n, c, _ in RULES if c == k])), F.lit(k)).otherwise(verdict)
    return found.select(id_col, "n_sentences", F.array_join("found", ",").alias("licenses"), verdict.alias("verdict"))

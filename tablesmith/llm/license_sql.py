"""The SQL that the licence scan must agree with, written out apart from the scan's own tables."""

#: A reduced notice's licence, by pattern.
NOTICES = [
    ("MIT", "mit( license)?|expat license"),
    ("Apache-2.0", "apache license (version 2 0( the license( you may not use this file except in compliance with the license)?)?|2 0|v2 0)|apache 2 0( license)?"),
    ("BSD-3-Clause", "(bsd 3 clause|3 clause bsd|new bsd|modified bsd) license|bsd 3 clause"),
    ("BSD-2-Clause", "(bsd 2 clause|2 clause bsd|simplified bsd|bsd) license|bsd 2 clause"),
    ("MPL-2.0", "mozilla public license (version )?2 0|mpl 2 0"),
    ("EPL-2.0", "eclipse public license (version )?2 0|epl 2 0"),
    ("BSL-1.0", "boost software license (version )?1 0"),
    ("ISC", "isc license"),
    ("Zlib", "zlib license"),
    ("CC0-1.0", "cc0( 1 0( universal)?)?"),
    ("Unlicense", "unlicense"),
    ("GPL-2.0", "gnu general public license (version |v)?2( 0)?|(gnu )?gpl( version |v| v| )2( 0)?"),
    ("GPL-3.0", "gnu general public license (version |v)?3( 0)?|(gnu )?gpl( version |v| v| )3( 0)?"),
    ("LGPL-2.1", "gnu lesser general public license (version |v)?2 1|(gnu )?lgpl( version |v| v| )2 1"),
    ("LGPL-3.0", "gnu lesser general public license (version |v)?3( 0)?|(gnu )?lgpl( version |v| v| )3( 0)?"),
    ("AGPL-3.0", "gnu affero general public license (version |v)?3( 0)?|(gnu )?agpl( version |v| v| )3( 0)?"),
    ("CC-BY-4.0", "cc by 4 0( license)?|creative commons attribution 4 0( international)? license"),
    ("CC-BY-SA-4.0", "cc by sa 4 0( license)?|creative commons attribution sharealike 4 0( international)? license"),
    ("CC-BY-ND-4.0", "cc by nd 4 0( license)?|creative commons attribution noderivatives 4 0( international)? license"),
    ("CC-BY-NC-4.0", "cc by nc 4 0( license)?|creative commons attribution noncommercial 4 0( international)? license"),
    ("CC-BY-NC-SA-4.0", "cc by nc sa 4 0( license)?|creative commons attribution noncommercial sharealike 4 0( international)? license"),
    ("CC-BY-NC-ND-4.0", "cc by nc nd 4 0( license)?|creative commons attribution noncommercial noderivatives 4 0( international)? license"),
]
#: A whole sentence's identifier, by pattern.
TEXTS = [
    ("mg", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mn", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("ma", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bg", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bs", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bb", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bn", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("ac", "you may obtain a copy of the license at"),
    ("au", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("at", "apache license version 2 0 january 2004 http www apache org licenses"),
    ("f\\1\\2\\3", "this (program|library) is free software you can redistribute it and or modify it under the terms of the gnu (|lesser |affero )general public license as published by the free software foundation either version (2|3|2 1) of the license or at your option any later version"),
    ("t3", "gnu general public license version 3 29 june 2007"),
    ("t2", "gnu general public license version 2 june 1991"),
    ("tl3", "gnu lesser general public license version 3 29 june 2007"),
    ("tl21", "gnu lesser general public license version 2 1 february 1999"),
    ("ta3", "gnu affero general public license version 3 19 november 2007"),
    ("mf", "this source code form is subject to the terms of the mozilla public license v"),
    ("mt", "mozilla public license version 2 0"),
    ("ul", "this is free and unencumbered software released into the public domain"),
    ("zg", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("rr", "all rights reserved"),
]
#: Licence, class, pattern over a text's identifiers (each before a space, gaps as "-").
FOUND = [
    ("AGPL-3.0-or-later", "copyleft", "f(program|library)affero_3"), ("AGPL-3.0", "copyleft", "@AGPL-3[.]0|ta3"), ("LGPL-3.0-or-later", "copyleft", "f(program|library)lesser_3"), ("LGPL-2.1-or-later", "copyleft", "f(program|library)lesser_2_1"),
    ("LGPL-3.0", "copyleft", "@LGPL-3[.]0|tl3"), ("LGPL-2.1", "copyleft", "@LGPL-2[.]1|tl21"), ("GPL-3.0-or-later", "copyleft", "f(program|library)3"), ("GPL-2.0-or-later", "copyleft", "f(program|library)2"),
    ("GPL-3.0", "copyleft", "@GPL-3[.]0|t3"), ("GPL-2.0", "copyleft", "@GPL-2[.]0|t2"), ("Apache-2.0", "permissive", "@Apache-2[.]0|at|ac (- )?au"), ("MIT", "permissive", "@MIT|mg (- )?m[na]"), ("ISC", "permissive", "@ISC|isc"),
    ("BSD-3-Clause", "permissive", "@BSD-3-Clause|bg (- )?(bs (- )?)?(bb (- )?)?bn"), ("BSD-2-Clause", "permissive", "@BSD-2-Clause|bg"), ("MPL-2.0", "copyleft", "@MPL-2[.]0|mf|mt"), ("EPL-2.0", "copyleft", "@EPL-2[.]0"),
    ("BSL-1.0", "permissive", "@BSL-1[.]0"), ("Zlib", "permissive", "@Zlib|zg"), ("CC-BY-4.0", "permissive", "@CC-BY-4[.]0"), ("CC-BY-SA-4.0", "copyleft", "@CC-BY-SA-4[.]0"), ("CC-BY-ND-4.0", "restricted", "@CC-BY-ND-4[.]0"),
    ("CC-BY-NC-4.0", "noncommercial", "@CC-BY-NC-4[.]0"), ("CC-BY-NC-SA-4.0", "noncommercial", "@CC-BY-NC-SA-4[.]0"), ("CC-BY-NC-ND-4.0", "noncommercial", "@CC-BY-NC-ND-4[.]0"), ("CC0-1.0", "permissive", "@CC0-1[.]0"), ("Unlicense", "permissive", "@Unlicense|ul"),
]
IDENTIFY = "CASE " + " ".join(f"WHEN regexp_full_match(x, '{p}') THEN replace(regexp_replace(x, '^(?:{p})$', '{name}'), ' ', '_')" for name, p in TEXTS) + " " + " ".join(f"WHEN regexp_full_match(x, 'under ({p})') OR regexp_full_match(x, 'spdx {name.lower().replace('-', ' ').replace('.', ' ')}( only| or later)?') THEN '@{name}'" for name, p in NOTICES) + " ELSE '-' END"
REDUCE = "regexp_replace(regexp_replace(regexp_replace(trim(lower(regexp_replace(p, '[^A-Za-z0-9]+', ' ', 'g'))), '^(?:this|the|our|all|it)(?: [a-z0-9]+){0,4} (?:is|are) (?:dual )?(licensed|released|distributed|available|provided|made available) under ', '\\1 under '), '^(?:licensed|released|distributed|available|provided|made available) under (?:the |a |an )?', 'under '), '^spdx license identifier ', 'spdx ')"


def sql(table: str = "documents") -> str:
    hits = ", ".join(f"regexp_matches(a, '(^| )({p}) ') OR regexp_matches(b, '(^| )({p}) ') AS h{i}" for i, (_, _, p) in enumerate(FOUND))
    three = next(i for i, f in enumerate(FOUND) if f[0] == "BSD-3-Clause")
    some = " OR ".join(f"h{i}" for i in range(len(FOUND)))
    chosen = ", ".join(f"CASE WHEN h{i}{f' AND NOT h{three}' if name == 'BSD-2-Clause' else ''} THEN '{name}' END" for i, (name, _, _) in enumerate(FOUND))
    classes = {k: ", ".join(f"'{n}'" for n, c, _ in FOUND if c == k) + (", 'Proprietary'" if k == "restricted" else "") for k in ("restricted", "noncommercial", "copyleft", "permissive")}
    verdict = "CASE " + " ".join(f"WHEN list_has_any(found, [{names}]) THEN '{k}'" for k, names in classes.items()) + " ELSE 'none' END"
    return f"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '(?m)^[ \\t]*(?://+|/\\*+|\\*+/?|#+|--+|;+|%+)[ \\t]*', '', 'g') AS text FROM {table}),
s AS (SELECT doc_id, string_split_regex(text, '\\n|[.!?][ \\t\\f\\r]+') AS a, string_split_regex(text, '[.!?]["'')]*[ \\t\\f\\r\\n]+|:[ \\t\\r]*\\n|\\n[ \\t\\r]*\\n|\\n[ \\t]*(?:[0-9]{{1,2}}|[a-z])[.)][ \\t]+') AS b FROM t),
i AS (SELECT doc_id, [{IDENTIFY} FOR x IN [{REDUCE} FOR p IN a]] AS a, [{IDENTIFY} FOR x IN [{REDUCE} FOR p IN b]] AS b FROM s),
q AS (SELECT doc_id, greatest(len([x FOR x IN a IF x <> '-']), len([x FOR x IN b IF x <> '-'])) AS n_sentences, regexp_replace(array_to_string(a, ' ') || ' ', '(- )+', '- ', 'g') AS a, regexp_replace(array_to_string(b, ' ') || ' ', '(- )+', '- ', 'g') AS b FROM i),
h AS (SELECT doc_id, n_sentences, {hits}, regexp_matches(a, '(^| )rr ') OR regexp_matches(b, '(^| )rr ') AS rr FROM q),
f AS (SELECT doc_id, n_sentences, [x FOR x IN [{chosen}, CASE WHEN rr AND NOT ({some}) THEN 'Proprietary' END] IF x IS NOT NULL] AS found FROM h)
SELECT doc_id, CAST(n_sentences AS BIGINT) AS n_sentences, array_to_string(found, ',') AS licenses, {verdict} AS verdict FROM f"""

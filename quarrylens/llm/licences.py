"""Licence recognition: normalised sentences become identifiers, and ordered rules match their sequences.

All in one projection over each row: no shuffle, and nothing that a hot group or a long text could overload.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known licence sentences by identifier, in their normal form (fixed values: the licences' own words).
SENTENCES = {
    "mit-notice": "released under the mit license",
    "mit-title": "mit license",
    "mit-title-the": "the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-condition": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is-short": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-disclaimer": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-header": "licensed under the apache license version 2 0 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-details": "see the gnu general public license for more details",
    "ccbync-notice": "licensed under cc by nc 4 0",
    "ccby-notice": "licensed under cc by 4 0",
    "ccbysa-notice": "licensed under cc by sa 4 0",
    "cc0-notice": "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide",
    "unlicense-first": "this is free and unencumbered software released into the public domain",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "lgpl3-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl21-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl-details": "see the gnu lesser general public license for more details",
    "agpl3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-details": "see the gnu affero general public license for more details",
    "epl-notice": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "boost-notice": "distributed under the boost software license version 1 0",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "bsd-style": "use of this source code is governed by a bsd style license that can be found in the license file",
    "bsd-disclaimer": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "unlicense-use": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "mit0-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "bsd-advertising": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-names-university": "neither the name of the university nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "apache-unless": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "apache-title": "apache license version 2 0 january 2004 http www apache org licenses",
    "apache-version": "version 2 0 january 2004",
    "apache-terms": "terms and conditions for use reproduction and distribution",
    "apache-copyright-grant": "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form",
    "gnu-verbatim": "everyone is permitted to copy and distribute verbatim copies",
    "gpl3-title": "gnu general public license version 3 29 june 2007",
    "gpl2-title": "gnu general public license version 2 june 1991",
    "lgpl3-title": "gnu lesser general public license version 3 29 june 2007",
    "lgpl21-title": "gnu lesser general public license version 2 1 february 1999",
    "agpl3-title": "gnu affero general public license version 3 19 november 2007",
    "mpl-title": "mozilla public license version 2 0",
    "epl-title": "eclipse public license v 2 0",
    "eupl-title": "european union public licence v 1 2",
    "cddl-title": "common development and distribution license cddl version 1 0",
    "artistic-title": "the artistic license 2 0",
    "boost-title": "boost software license version 1 0 august 17th 2003",
    "boost-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "postgresql-grant": "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
    "cc0-title": "cc0 1 0 universal",
}
#: Licences that a line ``SPDX-License-Identifier: name`` may name (fixed values).
NAMED = ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "EPL-2.0", "BSL-1.0", "Zlib", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0")
#: Licences of the Creative Commons family by the words of their names, and licences by the names that notices give them (fixed values).
COMMONS = {
    "CC-BY-4.0": "attribution",
    "CC-BY-SA-4.0": "attribution sharealike",
    "CC-BY-NC-4.0": "attribution noncommercial",
    "CC-BY-ND-4.0": "attribution noderivatives",
    "CC-BY-NC-SA-4.0": "attribution noncommercial sharealike",
    "CC-BY-NC-ND-4.0": "attribution noncommercial noderivatives",
}
CALLED = {
    "mit license": "MIT",
    "isc license": "ISC",
    "bsd 2 clause license": "BSD-2-Clause",
    "bsd 3 clause license": "BSD-3-Clause",
    "apache license 2 0": "Apache-2.0",
    "apache 2 0 license": "Apache-2.0",
    "mozilla public license 2 0": "MPL-2.0",
    "eclipse public license 2 0": "EPL-2.0",
    "boost software license 1 0": "BSL-1.0",
    "zlib license": "Zlib",
    "unlicense": "Unlicense",
}
#: How a notice begins that calls a licence by its name.
OPENINGS = ("licensed under the", "this project is licensed under the", "this software is released under the", "this software is distributed under the")
COMMONS_FORMS = {"work": "this work is licensed under a creative commons {} 4 0 international license", "text": "creative commons {} 4 0 international public license"}
SENTENCES |= {f"spdx-{n}": "spdx license identifier " + n.lower().replace("-", " ").replace(".", " ") for n in NAMED}
SENTENCES |= {f"{form}-{n}": words.format(kind) for n, kind in COMMONS.items() for form, words in COMMONS_FORMS.items()}
SENTENCES |= {f"called-{k}-{name}": f"{opening} {name}" for k, opening in enumerate(OPENINGS) for name in CALLED}
#: Licences and sequences of identifiers, tried in order: a match takes its sentences from later rules.
RULES = (
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names-university")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("MIT", ("mit-title", "mit-grant", "mit-condition", "as-is-short")),
    ("MIT", ("mit-title-the", "mit-grant", "mit-condition", "as-is-short")),
    ("MIT", ("mit-grant", "mit-condition", "as-is-short")),
    ("MIT", ("mit-grant", "mit-condition")),
    ("ISC", ("isc-grant", "isc-disclaimer")),
    ("0BSD", ("0bsd-grant", "isc-disclaimer")),
    ("MIT-0", ("mit0-grant", "as-is-short")),
    ("MIT-0", ("mit0-grant",)),
    ("Apache-2.0", ("apache-header", "apache-comply", "apache-copy", "apache-unless", "apache-see")),
    ("Apache-2.0", ("apache-header", "apache-comply", "apache-copy")),
    ("Apache-2.0", ("apache-header",)),
    ("Apache-2.0", ("apache-notice",)),
    ("Apache-2.0", ("apache-title", "apache-terms", "apache-copyright-grant")),
    ("Apache-2.0", ("apache-version", "apache-terms", "apache-copyright-grant")),
    ("GPL-3.0", ("gpl3-title", "gnu-verbatim", "gpl-free", "gpl-hope", "gpl-details")),
    ("GPL-2.0", ("gpl2-title", "gnu-verbatim", "gpl2-free", "gpl-hope", "gpl-details")),
    ("LGPL-2.1", ("lgpl21-title", "gnu-verbatim", "lgpl21-free", "lgpl-hope", "lgpl-details")),
    ("AGPL-3.0", ("agpl3-title", "gnu-verbatim", "agpl3-free", "gpl-hope", "agpl-details")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-details")),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope", "gpl-details")),
    ("GPL-2.0-or-later", ("gpl2-free",)),
    ("GPL-3.0-only", ("gpl3-notice",)),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-title",)),
    ("MIT", ("mit-title-the",)),
    ("ISC", ("isc-grant",)),
    ("CC-BY-NC-4.0", ("ccbync-notice",)),
    ("CC-BY-4.0", ("ccby-notice",)),
    ("CC-BY-SA-4.0", ("ccbysa-notice",)),
    ("CC0-1.0", ("cc0-notice",)),
    ("Unlicense", ("unlicense-first",)),
    ("MPL-2.0", ("mpl-notice",)),
    ("LGPL-3.0-or-later", ("lgpl3-free", "lgpl-hope", "lgpl-details")),
    ("LGPL-3.0-or-later", ("lgpl3-free",)),
    ("LGPL-2.1-or-later", ("lgpl21-free", "lgpl-hope", "lgpl-details")),
    ("LGPL-2.1-or-later", ("lgpl21-free",)),
    ("AGPL-3.0-or-later", ("agpl3-free", "gpl-hope", "agpl-details")),
    ("AGPL-3.0-or-later", ("agpl3-free",)),
    ("EPL-2.0", ("epl-notice",)),
    ("BSL-1.0", ("boost-notice",)),
    ("Zlib", ("zlib-as-is", "zlib-grant")),
    ("Zlib", ("zlib-grant",)),
    ("BSD-3-Clause", ("bsd-style",)),
    ("Apache-2.0", ("apache-title",)),
    ("Apache-2.0", ("apache-version",)),
    ("GPL-3.0", ("gpl3-title",)),
    ("GPL-2.0", ("gpl2-title",)),
    ("LGPL-3.0", ("lgpl3-title",)),
    ("LGPL-2.1", ("lgpl21-title",)),
    ("AGPL-3.0", ("agpl3-title",)),
    ("MPL-2.0", ("mpl-title",)),
    ("EPL-2.0", ("epl-title",)),
    ("EUPL-1.2", ("eupl-title",)),
    ("CDDL-1.0", ("cddl-title",)),
    ("Artistic-2.0", ("artistic-title",)),
    ("BSL-1.0", ("boost-title", "boost-grant")),
    ("BSL-1.0", ("boost-grant",)),
    ("BSL-1.0", ("boost-title",)),
    ("PostgreSQL", ("postgresql-grant",)),
    ("0BSD", ("0bsd-grant",)),
    ("CC0-1.0", ("cc0-title",)),
    *((n, (f"spdx-{n}",)) for n in NAMED),
    *((n, (f"{form}-{n}",)) for n in COMMONS for form in COMMONS_FORMS),
    *((n, (f"called-{k}-{name}",)) for k in range(len(OPENINGS)) for name, n in CALLED.items()),
)
#: Where a sentence ends: before white space, after a stop, or at the end of a line that is followed by an empty one.
ENDS = r"[.!?:;]+(?:\s+|$)|\n\s*\n"
#: Marks that end no sentence: in known sentences, between these words, the licences' own text has one.
INNER = (("free software", "you can redistribute"), ("software foundation", "either version"), ("without any warranty", "without even the implied"), ("public license v", "2 0"), ("public licence v", "1 2"), ("spdx license identifier", r"[\p{L}\p{N}]++"))
#: What separates words, and what stands between the words of ``INNER``.
GAP = r"[^\p{L}\p{N}]++"
MARKS = "(?i)(?<![\\p{L}\\p{N}])(" + "|".join(f"{a}(?={GAP}{b}(?![\\p{{L}}\\p{{N}}]))".replace(" ", GAP) for a, b in INNER) + f"){GAP}"
#: Lines without a letter or digit, as between the paragraphs of a notice in a comment, are empty lines.
RULED = r"\n[^\p{L}\p{N}\n]++(?=\n)"


def identifiers(text: Column) -> Column:
    """The identifiers of the known sentences of a text, in order.

    A sentence is also looked for line by line, where lines are sentences of their own. Marks inside known sentences
    (``INNER``) end none.
    """
    known = F.create_map(*[F.lit(x) for k, s in SENTENCES.items() for x in (s, k)])
    normal = lambda s: F.trim(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]+", " "))
    named = lambda s: F.when(normal(s).isin(*SENTENCES.values()), known[normal(s)])  # noqa: E731  a set is hashed, a map is gone through
    by_line = lambda s: F.array_compact(F.transform(F.split(s, r"\n"), named))
    whole = F.regexp_replace(F.regexp_replace(text, RULED, "\n"), MARKS, "$1 ")
    ids = F.transform(F.split(whole, ENDS), lambda s: F.when(normal(s).isin(*SENTENCES.values()), F.array(named(s))).when(F.contains(s, F.lit("\n")), by_line(s)))
    ids = F.array_compact(ids)
    return F.flatten(ids)


def matched(ids: Column) -> Column:
    """Licences of a sequence of identifiers, in the order of the rules. Marks stand between identifiers.

    Rules of several sentences take theirs first, one after another; rules of one sentence are looked up in what is left.
    (No rule of one sentence stands before a longer one with that sentence, so this is the order of the rules.)
    """
    place = lambda k: F.struct(F.lit(k).alias("place"), F.lit(RULES[k][0]).alias("licence"))
    found, rest = [], F.concat(F.lit("||"), F.array_join(ids, "||"), F.lit("||"))
    for k in (k for k, (_, sequence) in enumerate(RULES) if len(sequence) > 1):
        pattern = "|" + "||".join(RULES[k][1]) + "|"
        found.append(F.when(rest.contains(pattern), place(k)))
        rest = F.replace(rest, F.lit(pattern), F.lit("|#|"))
    alone = F.create_map(*[x for k, (_, sequence) in enumerate(RULES) if len(sequence) == 1 for x in (F.lit(sequence[0]), place(k))])
    every = F.concat(F.array_compact(F.array(*found)), F.array_compact(F.transform(F.split(rest, r"\|+"), lambda i: alone[i])))
    return F.array_distinct(F.transform(F.array_sort(every), lambda x: x["licence"]))


def scan_licences(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows whose text has a licence sentence: the identifiers in order, and the licences that rules find in them.

    Sentences that no rule takes give an empty list of licences. Null and empty texts have no sentences, so no row;
    repeated rows repeat; a null id stays null.
    """
    once = F.explode(F.array(identifiers(F.coalesce(F.col(text_col), F.lit("")))))  # a generator, so that no filter repeats the work
    with_ids = docs.select(F.col(id_col), once.alias("sentence_ids")).where(F.size("sentence_ids") > 0)
    return with_ids.select(id_col, "sentence_ids", matched(F.col("sentence_ids")).alias("licences"))

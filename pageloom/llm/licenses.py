"""Licence scan by sentence rules (DataFrame functions only).

A text is normalised (A-Z lower-cased, other runs than letters and digits become one space, so marks of comments vanish)
and searched for the sentences of a catalogue: titles, notices by name, headers and sentences of whole texts.  Links are read as their text; each
operand of an SPDX expression, and each licence of a notice's choice, is a sentence of its own.  A sentence starts and ends at a line end or
after . ! ? ; : with white space, and may be wrapped over lines; empty lines (and lines of a
comment's frame only) end it.  Where several start, the longest is taken.  n_sentences counts
pieces as cut at line ends too.  The identifiers a text holds, in order, are matched against
rules: ordered identifier sequences, with nothing known in between.  The longest rules win
over rules whose sequence is part of theirs, place by place, so a text may hold both.

Null texts have no sentence; very long texts are read whole; a null doc_id is kept.  Rows are judged one by one (repeated rows give repeated
results); an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.quality_rules import once


def normal(text: str) -> str:
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip()


#: Sentences of licence texts and headers, as they are written there.
TEXTS = {
    "apache2.the_license": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache2.compliance": "you may not use this file except in compliance with the License",
    "apache2.obtain": "You may obtain a copy of the License at",
    "apache2.as_is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "mit.grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "mit.whole_grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    "mit.keep": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit.as_is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED',
    "mit.whole_as_is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "isc.grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd.grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "isc.as_is": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS',
    "bsd.redistribute": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd.source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd.binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd.endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd.advertise": "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    "gpl.program": "This program is free software",
    "gpl.library": "This library is free software",
    "gpl2.only": "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "gpl2.later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl3.later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl.published": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "lgpl.published": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "later2": "either version 2 of the License, or (at your option) any later version",
    "later2.1": "either version 2.1 of the License, or (at your option) any later version",
    "later3": "either version 3 of the License, or (at your option) any later version",
    "lgpl2.later": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version",
    "lgpl3.later": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl3.later": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "mpl2.terms": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "mpl2.joined": "This Source Code Form is subject to the terms of the Mozilla Public License, v.2.0",
    "mpl2.copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "mpl2.old_copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "epl2.terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "epl1.terms": "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "zlib.as_is": "This software is provided 'as-is', without any express or implied warranty",
    "zlib.liable": "In no event will the authors be held liable for any damages arising from the use of this software",
    "zlib.grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "unlicense.free": "This is free and unencumbered software released into the public domain",
    "unlicense.anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "boost.grant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following',
    "wtfpl.verbatim": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed",
    "cc0.dedicated": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "ofl.font": "This Font Software is licensed under the SIL Open Font License, Version 1.1",
    "reserved": "All rights reserved",
    "spdx": "SPDX-License-Identifier",
}
#: Titles at the start of a text.  A title says what the text is only if no other rule does.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"],
    "ISC": ["ISC License", "The ISC License"],
    "Apache-2.0": ["Apache License Version 2.0, January 2004", "Apache License 2.0", "Apache License, Version 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", 'BSD 2-Clause "Simplified" License'],
    "BSD-3-Clause": ["BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License'],
    "GPL-2.0": ["GNU General Public License Version 2, June 1991"],
    "GPL-3.0": ["GNU General Public License Version 3, 29 June 2007"],
    "LGPL-2.1": ["GNU Lesser General Public License Version 2.1, February 1999"],
    "LGPL-3.0": ["GNU Lesser General Public License Version 3, 29 June 2007"],
    "AGPL-3.0": ["GNU Affero General Public License Version 3, 19 November 2007"],
    "MPL-2.0": ["Mozilla Public License Version 2.0", "Mozilla Public License 2.0"],
    "EPL-2.0": ["Eclipse Public License - v 2.0"],
    "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003"],
    "CC0-1.0": ["CC0 1.0 Universal", "Creative Commons Legal Code CC0 1.0 Universal"],
    "WTFPL": ["DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2, December 2004"],
}

#: Licences by identifier, with the names that notices give them.
NAMES = {
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0", "Apache 2.0", "the Apache 2.0 License"],
    "MIT": ["the MIT License", "MIT", "the MIT license (MIT)"],
    "ISC": ["the ISC License"],
    "0BSD": ["the Zero-Clause BSD License"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "the Simplified BSD License"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "the New BSD License", "the 3-Clause BSD License"],
    "GPL-2.0": ["the GNU General Public License version 2", "the GNU General Public License v2.0", "the GPLv2", "GPL-2.0"],
    "GPL-3.0": ["the GNU General Public License version 3", "the GNU General Public License v3.0", "the GPLv3", "GPL-3.0"],
    "LGPL-2.1": ["the GNU Lesser General Public License version 2.1", "the LGPLv2.1"],
    "LGPL-3.0": ["the GNU Lesser General Public License version 3", "the LGPLv3"],
    "AGPL-3.0": ["the GNU Affero General Public License version 3", "the AGPLv3"],
    "MPL-2.0": ["the Mozilla Public License 2.0", "the Mozilla Public License, version 2.0", "MPL 2.0"],
    "EPL-2.0": ["the Eclipse Public License 2.0"],
    "BSL-1.0": ["the Boost Software License, Version 1.0"],
    "Zlib": ["the zlib License"],
    "Unlicense": ["the Unlicense"],
    "WTFPL": ["the WTFPL"],
    "Artistic-2.0": ["the Artistic License 2.0"],
    "PostgreSQL": ["the PostgreSQL License"],
    "OFL-1.1": ["the SIL Open Font License, Version 1.1", "the SIL Open Font License 1.1"],
    "CDDL-1.0": ["the Common Development and Distribution License 1.0"],
    "EUPL-1.2": ["the European Union Public License 1.2", "the EUPL v1.2"],
    "CC0-1.0": ["CC0 1.0", "CC0", "the CC0 1.0 Universal Public Domain Dedication"],
    "CC-BY-4.0": ["CC BY 4.0", "a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0", "a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
    "CC-BY-3.0": ["CC BY 3.0", "a Creative Commons Attribution 3.0 Unported License"],
    "CC-BY-SA-3.0": ["CC BY-SA 3.0", "a Creative Commons Attribution-ShareAlike 3.0 Unported License"],
}
FORMS = ["licensed under {}", "released under {}", "distributed under {}", "available under {}", "this work is licensed under {}", "this project is licensed under {}", "this software is licensed under {}", "this file is licensed under {}"]
#: Identifiers that stand in tags only.
TAGS = ["GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "BSD-4-Clause", "EPL-1.0", "Python-2.0", "MS-PL", "X11"]

#: normalised sentence -> identifier.
SENTENCES: dict[str, str] = {
    **{normal(n): f"tag.{n}" for n in [*NAMES, *TAGS]},
    **{normal(t): f"title.{k}" for k, titles in TITLES.items() for t in titles},
    **{normal(f.format(k)): f"notice.{k}" for k in NAMES if k != "Unlicense" for f in FORMS},
    **{normal(f.format(n)): f"notice.{k}" for k, names in NAMES.items() for n in names for f in FORMS},
    **{normal(t): k for k, t in TEXTS.items()},
}

#: Ordered rules: (rule, licence, identifiers in a row).
RULES: list[tuple[str, str, list[str]]] = [
    ("apache2-header", "Apache-2.0", ["apache2.the_license", "apache2.compliance", "apache2.obtain", "apache2.as_is"]),
    ("apache2-short", "Apache-2.0", ["apache2.the_license", "apache2.compliance"]),
    ("mit-text", "MIT", ["mit.grant", "mit.keep", "mit.as_is"]),
    ("mit-whole-text", "MIT", ["mit.whole_grant", "mit.keep", "mit.whole_as_is"]),
    ("isc-text", "ISC", ["isc.grant", "isc.as_is"]),
    ("0bsd-text", "0BSD", ["0bsd.grant", "isc.as_is"]),
    ("bsd2-text", "BSD-2-Clause", ["bsd.redistribute", "bsd.source", "bsd.binary"]),
    ("bsd3-text", "BSD-3-Clause", ["bsd.redistribute", "bsd.source", "bsd.binary", "bsd.endorse"]),
    ("bsd4-text", "BSD-4-Clause", ["bsd.redistribute", "bsd.source", "bsd.binary", "bsd.advertise", "bsd.endorse"]),
    ("gpl2-header", "GPL-2.0", ["gpl.program", "gpl2.only"]),
    ("gpl2-later", "GPL-2.0-or-later", ["gpl.program", "gpl.published", "later2"]),
    ("gpl3-later", "GPL-3.0-or-later", ["gpl.program", "gpl.published", "later3"]),
    ("gpl3-header", "GPL-3.0-or-later", ["gpl.program", "gpl3.later"]),
    ("lgpl2-later", "LGPL-2.1-or-later", ["gpl.library", "lgpl.published", "later2.1"]),
    ("lgpl2-header", "LGPL-2.1-or-later", ["gpl.library", "lgpl2.later"]),
    ("lgpl3-header", "LGPL-3.0-or-later", ["gpl.library", "lgpl3.later"]),
    ("lgpl3-program", "LGPL-3.0-or-later", ["gpl.program", "lgpl3.later"]),
    ("agpl3-header", "AGPL-3.0-or-later", ["gpl.program", "agpl3.later"]),
    ("mpl2-header", "MPL-2.0", ["mpl2.terms", "mpl2.copy"]),
    ("mpl2-old-header", "MPL-2.0", ["mpl2.terms", "mpl2.old_copy"]),
    ("mpl2-terms", "MPL-2.0", ["mpl2.joined"]),
    ("epl2-header", "EPL-2.0", ["epl2.terms"]),
    ("epl1-header", "EPL-1.0", ["epl1.terms"]),
    ("zlib-text", "Zlib", ["zlib.as_is", "zlib.liable", "zlib.grant"]),
    ("unlicense-text", "Unlicense", ["unlicense.free", "unlicense.anyone"]),
    ("unlicense-notice", "Unlicense", ["unlicense.free"]),
    ("boost-text", "BSL-1.0", ["boost.grant"]),
    ("wtfpl-text", "WTFPL", ["wtfpl.verbatim"]),
    ("cc0-text", "CC0-1.0", ["cc0.dedicated"]),
    ("ofl-text", "OFL-1.1", ["ofl.font"]),
    *((f"{k}-notice", k, [f"notice.{k}"]) for k in NAMES),
    *((f"{k}-title", k, [f"title.{k}"]) for k in TITLES),
    *((f"{k}-tag", k, ["spdx", f"tag.{k}"]) for k in [*NAMES, *TAGS]),
]


def cut(text: Column) -> Column:
    """Pieces in order: cut at line ends too."""
    return F.split(F.regexp_replace(text, r"([.!?;:])[\x20\x09-\x0D]+", "$1\n"), "\n")


#: In a flattened text, what stands for a sentence's end (a mark or an empty line) and for a line end within one.
END, WRAP = "|", "~"


#: Rewritings before sentences are cut (as RE2 and Java read them): a Markdown link is its text; "- see the LICENSE" begins a sentence.
LINK, SEE = r"\[([^\[\]\n]*)\]\([^()\n]*\)", r"[ \t]*[-–—,(][ \t]*([Ss]ee the )"
#: In a line with a tag each operand of an expression has the tag; in a notice each licence of a choice has one of its own.
TAG, OPERAND, ANEW = "spdx-license-identifier:", r"[ \t]+(?:OR|AND|WITH|or|and|with)[ \t]+", ". SPDX-License-Identifier: "
NOTICE, CHOICE, AGAIN = r"(?:licensed|released|distributed|available) under ", r"[ \t]+(?:or|OR)[ \t]+(the |MIT|Apache|GPL|LGPL|AGPL|BSD|MPL|ISC|CC)", ". Licensed under "


def spelt_out(text: Column) -> Column:
    """The text with links, expressions of tags and choices of notices as sentences of their own."""
    t = F.when(F.contains(text, F.lit("](")), F.regexp_replace(text, LINK, "$1")).otherwise(text)
    t = F.when(F.contains(t, F.lit("ee the ")), F.regexp_replace(t, SEE, ". $1")).otherwise(t)
    line = lambda x: F.when(F.contains(F.lower(x), F.lit(TAG)), F.regexp_replace(x, OPERAND, ANEW)).when(F.regexp_like(F.lower(x), F.lit(NOTICE)), F.regexp_replace(x, CHOICE, f"{AGAIN}$1")).otherwise(x)
    few = F.contains(F.lower(t), F.lit(TAG)) | F.contains(F.lower(t), F.lit("d under ")) | F.contains(F.lower(t), F.lit("available under "))
    return F.when(few, F.array_join(F.transform(F.split(t, "\n"), line), "\n")).otherwise(t)


def flat(text: Column) -> Column:
    """The text in one line: words between single blanks, line ends as WRAP, sentence ends as END."""
    t = F.regexp_replace(F.regexp_replace(F.lower(spelt_out(text)), r"[|~]", " "), r"([.!?;:])[\x20\x09-\x0D]+", f" {END} ")
    t = F.regexp_replace(F.regexp_replace(t, "\n", f" {WRAP} "), f"[^a-z0-9{END}{WRAP}]+", " ")
    # Lines without letters or digits (empty, or a comment's frame) end a sentence.
    return F.concat(F.lit(f"{END} "), F.trim(F.regexp_replace(t, rf"{WRAP} ?(?:{WRAP} ?)+", f"{END} ")), F.lit(f" {END}"))


def _pattern(sentences: dict[str, str]) -> str:
    """Any of the sentences, wrapped or not, the longest first; it starts and ends where a line or a sentence does.

    Those with the same first word share it, so that few are tried at a place.
    """
    gap = f" (?:{WRAP} )?"
    after = rf"(?= [{END}{WRAP}])"

    def any_of(xs: list[str]) -> str:
        by: dict[str, list[list[str]]] = {}
        for x in sorted(xs, key=lambda x: -len(x)):
            by.setdefault(x.split()[0], []).append(x.split()[1:])
        return "(?:" + "|".join(first + "(?:" + "|".join("".join(gap + w for w in rest) + after for rest in rests) + ")" for first, rests in by.items()) + ")"

    titles = [x for x, k in sentences.items() if k.startswith("title.")]
    others = any_of([x for x in sentences if x not in titles])
    start = rf"(?<=^\{END} |^\{END} {WRAP} )" + any_of(titles) + "|" if titles else ""
    return rf"{start}(?<=[{END}{WRAP}] ){others}"


def known_sentences(docs: DataFrame, sentences: dict[str, str] = SENTENCES) -> DataFrame:
    """doc_id, n_sentences, known array<string>: identifiers in the text's order, for each row of docs."""
    text = F.coalesce("text", F.lit(""))
    n = F.size(F.filter(cut(text), lambda x: F.regexp_like(F.lower(x), F.lit("[a-z0-9]")))).cast("long")
    found = F.regexp_extract_all(flat(text), F.lit(_pattern(sentences)), F.lit(0))
    ids = F.create_map(*[F.lit(x) for pair in sentences.items() for x in pair])
    return docs.select("doc_id", n.alias("n_sentences"), F.transform(found, lambda x: F.element_at(ids, F.replace(x, F.lit(f"{WRAP} "), F.lit("")))).alias("known"))


def _inside(a: list[str], b: list[str]) -> bool:
    return len(a) < len(b) and any(b[i : i + len(a)] == a for i in range(len(b)))


def line(ids: list[str]) -> str:
    """Identifiers in a row, each between marks of its own."""
    return "".join(f"[{x}]" for x in ids)


def scan_licenses(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, str, list[str]]] = RULES) -> DataFrame:
    """doc_id, n_sentences, known, rules, licenses: rules that match, in the order of the rules; licences sorted, each once."""
    d = known_sentences(docs, sentences)
    d = once(d, said=F.array_join(F.transform("known", lambda x: F.concat(F.lit("["), x, F.lit("]"))), ""))

    def matches(i: int) -> Column:
        """A rule matches where it is found outside matches of the longer rules that hold it."""
        rest = F.col("said")
        for longer in sorted((r[2] for r in rules if _inside(rules[i][2], r[2])), key=len, reverse=True):
            rest = F.replace(rest, F.lit(line(longer)), F.lit("."))
        return F.contains(rest, F.lit(line(rules[i][2])))

    named = F.array_compact(F.array(*[F.when(matches(i), F.struct(F.lit(r[0]).alias("rule"), F.lit(r[1]).alias("license"))) for i, r in enumerate(rules)]))
    d = once(d, named=F.when(F.size("known") > 0, named).otherwise(F.array().cast("array<struct<rule: string, license: string>>")))
    more = F.filter("named", lambda x: ~F.endswith(x["rule"], F.lit("-title")))
    d = d.withColumn("named", F.when(F.size(more) > 0, more).otherwise(F.col("named")))
    return d.select("doc_id", "n_sentences", "known", F.transform("named", lambda x: x["rule"]).alias("rules"), F.array_sort(F.array_distinct(F.transform("named", lambda x: x["license"]))).alias("licenses"))

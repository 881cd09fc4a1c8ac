"""Licence scans by sentence rules, in DataFrame functions only.

A text is cut into sentences, each normalised to its letters and digits. Known
normalised sentences have identifiers; the sequence of identifiers in a text, unknown
sentences left out, is matched against ordered licence rules. A rule that matches
takes its identifiers out of the sequence, so that a later, weaker rule doesn't see
them. Sentences are known also where lines wrap within them, with or without comment
prefixes, and whatever name stands in their slots; names of licences are known within
any sentence that puts something under them, unless it denies that, and tags of SPDX
with their expressions. Everything is one map over the rows; the tables are literals.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import chain, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Identifier -> sentence as licences and notices print it.
SENTENCES = {
    "ApacheShort": ("Licensed under the Apache License, Version 2.0",),
    "ApacheCompliance": ("you may not use this file except in compliance with the License",),
    "ApacheObtain": ("You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",),
    "ApacheAsIs": ("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",),
    "ApacheSee": ("See the License for the specific language governing permissions and limitations under the License",),
    "MITShort": ("Released under the MIT License", "Licensed under the MIT License", "The MIT License", "MIT License", "The MIT License (MIT)"),
    "MITPermission": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",),
    "MITAsIs": ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",),
    "GPL2Short": ("This work is licensed under the GNU General Public License, version 2", "Licensed under the GNU General Public License, version 2"),
    "GPL3Short": ("This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3"),
    "GPLFree": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",),
    "GPLNoWarranty": ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",),
    "GPLSee": ("See the GNU General Public License for more details",),
    "BSDRedistribution": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "BSDSource": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",),
    "BSDBinary": ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",),
    "BSDEndorse": ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",),
    "BSDShort": ("Released under the BSD License", "Licensed under the BSD License"),
    "MPLShort": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License, Version 2.0"),
    "CCBYShort": ("Licensed under CC BY 4.0", "This work is licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "CCBYSAShort": ("Licensed under CC BY-SA 4.0", "This work is licensed under CC BY-SA 4.0"),
    "CCBYNCShort": ("Licensed under CC BY-NC 4.0", "This work is licensed under CC BY-NC 4.0"),
    "CC0Short": ("Licensed under CC0 1.0", "This work is dedicated to the public domain"),
    "AllRights": ("All rights reserved",),
}

#: Licence rules in the order of their use: licence, then identifiers that follow each other.
RULES = (
    ("Apache-2.0", ("ApacheShort", "ApacheCompliance", "ApacheObtain", "ApacheAsIs", "ApacheSee")),
    ("MIT", ("MITShort", "MITPermission", "MITAsIs")),
    ("MIT", ("MITPermission", "MITAsIs")),
    ("GPL-3.0-or-later", ("GPLFree", "GPLNoWarranty", "GPLSee")),
    ("BSD-3-Clause", ("BSDRedistribution", "BSDSource", "BSDBinary", "BSDEndorse")),
    ("BSD-2-Clause", ("BSDRedistribution", "BSDSource", "BSDBinary")),
    ("Apache-2.0", ("ApacheShort",)),
    ("MIT", ("MITShort",)),
    ("GPL-2.0-only", ("GPL2Short",)),
    ("GPL-3.0-only", ("GPL3Short",)),
    ("BSD", ("BSDShort",)),
    ("MPL-2.0", ("MPLShort",)),
    ("CC-BY-4.0", ("CCBYShort",)),
    ("CC-BY-SA-4.0", ("CCBYSAShort",)),
    ("CC-BY-NC-4.0", ("CCBYNCShort",)),
    ("CC0-1.0", ("CC0Short",)),
    ("proprietary", ("AllRights",)),
)

#: Forms that only files carry, and rules for them. They are apart from the tables of the SQL, which knows no wrapped lines.
FILE_SENTENCES = {
    "ApacheShort": ("Licensed under the Apache License, Version 2.0 (the \"License\")", "Licensed to the Apache Software Foundation (ASF) under the Apache License, Version 2.0 (the \"License\")"),
    "ApacheObtain": ("You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0",),
    "ApacheTitle": ("Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", "Apache License Version 2.0, January 2004 https://www.apache.org/licenses/", "Apache License Version 2.0, January 2004"),
    "GPLTerms": ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",),
    "GPL2Later": ("either version 2 of the License, or (at your option) any later version",),
    "GPL2Title": ("GNU GENERAL PUBLIC LICENSE Version 2, June 1991",),
    "GPL3Title": ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",),
    "BSDEndorse": (
        "Neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "Neither the name of * nor the names of other contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "Neither the name of * may be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    "MPLShort": ("Mozilla Public License Version 2.0",),
    "CCBYShort": ("This work is licensed under the Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0 International Public License"),
    "CCBYSAShort": ("This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    "CCBYNCShort": ("This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    "CC0Short": ("CC0 1.0 Universal",),
    "GPL3Later": ("either version 3 of the License, or (at your option) any later version",),
    "LGPLTerms": ("you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",),
    "LGPL21Later": ("either version 2.1 of the License, or (at your option) any later version",),
    "LGPL3Free": ("you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",),
    "LGPLSee": ("See the GNU Lesser General Public License for more details",),
    "LGPL21Title": ("GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",),
    "LGPL3Title": ("GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",),
    "AGPL3Free": ("you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",),
    "AGPLSee": ("See the GNU Affero General Public License for more details",),
    "AGPL3Title": ("GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",),
    "GPLHope": ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"),
    "BSDDisclaimer": ("THIS SOFTWARE IS PROVIDED BY * \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",),
    "ISCPermission": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    "ISCAsIs": ("THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS",),
    "EPL2Available": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    "UnlicenseFree": ("This is free and unencumbered software released into the public domain",),
    "ZlibAsIs": ("This software is provided 'as-is', without any express or implied warranty",),
    "ZlibPermission": ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",),
    "BoostShort": ("Distributed under the Boost Software License, Version 1.0",),
}
#: Rules with members that may be missing: licence, the identifiers that must follow each other, and those that may then, in this order.
OPEN_RULES = (
    ("Apache-2.0", ("ApacheShort",), ("ApacheCompliance", "ApacheObtain", "ApacheAsIs", "ApacheSee")),
    ("MIT", ("MITShort", "MITPermission"), ("MITAsIs",)),
)
#: Rules that come before RULES, as they take more sentences.
LONG_RULES = (
    ("BSD-3-Clause", ("BSDRedistribution", "BSDSource", "BSDBinary", "BSDEndorse", "BSDDisclaimer")),
    ("BSD-2-Clause", ("BSDRedistribution", "BSDSource", "BSDBinary", "BSDDisclaimer")),
    ("LGPL-2.1-or-later", ("LGPLTerms", "LGPL21Later", "GPLHope", "GPLNoWarranty", "LGPLSee")),
    ("LGPL-2.1-or-later", ("LGPLTerms", "LGPL21Later", "GPLHope", "LGPLSee")),
    ("LGPL-2.1-or-later", ("LGPLTerms", "LGPL21Later", "GPLNoWarranty", "LGPLSee")),
    ("LGPL-3.0-or-later", ("LGPL3Free", "GPLHope", "GPLNoWarranty", "LGPLSee")),
    ("LGPL-3.0-or-later", ("LGPL3Free", "GPLHope", "LGPLSee")),
    ("LGPL-3.0-or-later", ("LGPL3Free", "GPLNoWarranty", "LGPLSee")),
    ("AGPL-3.0-or-later", ("AGPL3Free", "GPLHope", "GPLNoWarranty", "AGPLSee")),
    ("AGPL-3.0-or-later", ("AGPL3Free", "GPLHope", "AGPLSee")),
    ("AGPL-3.0-or-later", ("AGPL3Free", "GPLNoWarranty", "AGPLSee")),
    ("GPL-2.0-or-later", ("GPLTerms", "GPL2Later", "GPLHope", "GPLNoWarranty", "GPLSee")),
    ("GPL-2.0-or-later", ("GPLTerms", "GPL2Later", "GPLHope", "GPLSee")),
    ("GPL-3.0-or-later", ("GPLTerms", "GPL3Later", "GPLHope", "GPLNoWarranty", "GPLSee")),
    ("GPL-3.0-or-later", ("GPLTerms", "GPL3Later", "GPLHope", "GPLSee")),
    ("GPL-3.0-or-later", ("GPLFree", "GPLHope", "GPLNoWarranty", "GPLSee")),
    ("GPL-3.0-or-later", ("GPLFree", "GPLHope", "GPLSee")),
    ("ISC", ("ISCPermission", "ISCAsIs")),
    ("Zlib", ("ZlibAsIs", "ZlibPermission")),
)
FILE_RULES = (
    ("LGPL-2.1-or-later", ("LGPLTerms", "LGPL21Later")),
    ("LGPL-3.0-or-later", ("LGPL3Free",)),
    ("AGPL-3.0-or-later", ("AGPL3Free",)),
    ("LGPL-2.1-only", ("LGPL21Title",)),
    ("LGPL-3.0-only", ("LGPL3Title",)),
    ("AGPL-3.0-only", ("AGPL3Title",)),
    ("ISC", ("ISCPermission",)),
    ("Zlib", ("ZlibPermission",)),
    ("EPL-2.0", ("EPL2Available",)),
    ("Unlicense", ("UnlicenseFree",)),
    ("BSL-1.0", ("BoostShort",)),
    ("GPL-2.0-or-later", ("GPLTerms", "GPL2Later", "GPLNoWarranty", "GPLSee")),
    ("GPL-2.0-or-later", ("GPLTerms", "GPL2Later")),
    ("Apache-2.0", ("ApacheTitle",)),
    ("MIT", ("MITPermission",)),
    ("GPL-2.0-only", ("GPL2Title",)),
    ("GPL-3.0-only", ("GPL3Title",)),
)

#: Licence -> its names, as texts put things under them, in normal form.
NAMES = {
    "MIT": ("mit license", "mit licence"),
    "Apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache software license version 2 0"),
    "BSD-3-Clause": ("bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license"),
    "BSD-2-Clause": ("bsd 2 clause license", "2 clause bsd license", "simplified bsd license"),
    "BSD": ("bsd license", "bsd style license"),
    "GPL-2.0-only": ("gnu general public license version 2", "gnu general public license v2", "gpl version 2", "gpl v2", "gplv2"),
    "GPL-3.0-only": ("gnu general public license version 3", "gnu general public license v3", "gpl version 3", "gpl v3", "gplv3"),
    "LGPL-2.1-only": ("gnu lesser general public license version 2 1", "gnu lesser general public license v2 1", "lgpl version 2 1", "lgpl v2 1", "lgplv2 1"),
    "LGPL-3.0-only": ("gnu lesser general public license version 3", "gnu lesser general public license v3", "lgpl version 3", "lgpl v3", "lgplv3"),
    "AGPL-3.0-only": ("gnu affero general public license version 3", "gnu affero general public license v3", "agpl version 3", "agpl v3", "agplv3"),
    "MPL-2.0": ("mozilla public license version 2 0", "mozilla public license 2 0", "mpl 2 0"),
    "EPL-2.0": ("eclipse public license version 2 0", "eclipse public license v2 0", "eclipse public license 2 0"),
    "EPL-1.0": ("eclipse public license version 1 0", "eclipse public license v1 0", "eclipse public license 1 0"),
    "ISC": ("isc license",),
    "Zlib": ("zlib license",),
    "Unlicense": ("unlicense",),
    "BSL-1.0": ("boost software license version 1 0",),
    "Artistic-2.0": ("artistic license 2 0", "artistic license version 2 0", "artistic 2 0 license"),
    "WTFPL": ("wtfpl", "do what the fuck you want to public license"),
}
#: Kinds and versions of Creative Commons licences, and their titles.
CC_KINDS = {"by": "attribution", "by-sa": "attribution sharealike", "by-nc": "attribution noncommercial", "by-nd": "attribution noderivs", "by-nc-sa": "attribution noncommercial sharealike", "by-nc-nd": "attribution noncommercial noderivs"}
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
for _kind, _title in CC_KINDS.items():
    for _version in CC_VERSIONS:
        _dots = _version.replace(".", " ")
        NAMES[f"CC-{_kind.upper()}-{_version}"] = (f"cc {_kind.replace('-', ' ')} {_dots}", f"creative commons {_title} {_dots}")
#: Identifiers of SPDX.
SPDX = ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "0BSD", "ISC", "Zlib", "Unlicense", "WTFPL", "BSL-1.0", "MPL-1.1", "MPL-2.0", "EPL-1.0", "EPL-2.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "Artistic-2.0", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later")
TAG = "spdx license identifier"
UNDER = "under (?:either (?:of )?)?(?:the |an? )?(?:terms of (?:either )?(?:the |an? )?)?"
#: What denies a sentence that goes on to name a licence, up to six words before; Java wants the words of a look-behind spelled out.
_FEW = ""
for _ in range(6):
    _FEW = rf"(?:[ \n][a-z0-9]{{1,20}}{_FEW})?"
DENIED = rf"(?<![ \n\u0001](?:not|never|nothing|none|no|neither|nor|cannot|isn t|aren t|wasn t){_FEW}[ \n])"
#: A name in the slot of a sentence: some words, among them ends of sentences as in "Inc.".
SLOT = r"(?:[ \n\u0001]+[a-z0-9]+){1,12}?"
#: Words between the names of a choice, which ends with the words after it.
BETWEEN, CHOICE = r"(?:[ \n]++[a-z0-9]++){0,14}?[ \n]++", r"(?=(?:[ \n]++[a-z0-9]++){0,14}?[ \n]++at[ \n]++(?:your|the)[ \n]++option)"

#: Marks that end a sentence; those that start a line are comment prefixes.
MARKS = r"[.!?:;]+(?<!\n[ \t]{0,8}[.!?:;]{1,4})(?:\s+|$)"
#: Prefixes that are words, over lines that hold nothing else too.
PREFIX = r"(?:(?:dnl|rem) [ \n]*+)*+"


def marked(text: Column) -> Column:
    """Lower case, ASCII letters and digits, single spaces between; \u0001 where a sentence ends by a mark, \n where lines do."""
    cut = F.regexp_replace(F.lower(F.concat(F.lit("\n"), text, F.lit("\n"))), MARKS, "\u0001")
    return F.regexp_replace(F.concat(cut, F.lit("\n")), "[^a-z0-9\u0001\n]+", " ")


def _plain(sentence: str) -> str:
    """One sentence in the same form, for the tables; a slot is a word of its own."""
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in sentence.lower().replace("*", "slot")).split())


def _gap(pattern: str) -> str:
    """The pattern with each space as a gap that a line may end in, and a name for each slot."""
    gap = rf"[ \n]++{PREFIX}"
    return rf"{SLOT}[ \n\u0001]++{PREFIX}".join(part.replace(" ", gap) for part in pattern.split(" slot "))


def _any_of(forms: Iterable[str]) -> str:
    return "(?:" + "|".join(_gap(s) for s in sorted(forms, key=len, reverse=True)) + ")"


def _known_pattern(sentences: Iterable[str]) -> str:
    """Finds each known sentence between two ends of sentences or lines; lines may end within it. Longer ones come first.

    Finds names of licences within sentences too, and tags with each identifier of their expression.
    """
    whole = rf"[\u0001\n] ?{PREFIX}{_any_of(sentences)}(?= ?[\u0001\n])"
    names = _any_of(n for names in NAMES.values() for n in names)
    named = rf"(?<![a-z0-9])(?=under){DENIED}{_gap(UNDER)}{names}(?![a-z0-9])|\G{BETWEEN}{names}(?![a-z0-9]){CHOICE}"
    tags = _any_of(_plain(x) for x in SPDX)
    return rf"{whole}|{named}|{TAG} ?\u0001? ?{tags}(?![a-z0-9])|\G (?:or|and) {tags}(?![a-z0-9])"


def _named() -> tuple[dict[str, str], list[tuple[str, tuple[str]]]]:
    """What _known_pattern finds beside whole sentences -> identifier, and a rule for each."""
    table = {f"under {n}": f"Under{licence}" for licence, names in NAMES.items() for n in names}
    table |= {f"{lead} {_plain(x)}": f"Spdx{x}" for lead in (TAG, "or", "and") for x in SPDX}
    only = {x: f"{x}-only" if f"{x}-only" in SPDX else x for x in SPDX}  # names without an ending are old ones
    return table, [(x, (f"Under{x}",)) for x in NAMES] + [(only[x], (f"Spdx{x}",)) for x in SPDX]


def _names_at_end() -> str:
    """Finds a licence's name at the end of normalised words."""
    return "(" + "|".join(sorted((n for names in NAMES.values() for n in names), key=len, reverse=True)) + ")$"


def ordered_rules() -> list[tuple[str, tuple[str, ...]]]:
    """All rules in the order of their use; those with open members in all their forms, longer ones first."""
    forms = []
    for licence, must, may in OPEN_RULES:
        chosen = sorted(product((True, False), repeat=len(may)), key=lambda c: -sum(c))
        forms += [(licence, must + tuple(name for name, keep in zip(may, c) if keep)) for c in chosen if any(c) or len(must) > 1]
    return [*forms, *LONG_RULES, *RULES, *FILE_RULES, *_named()[1]]


def known_sentences(table: dict[str, tuple[str, ...]] = SENTENCES) -> dict[str, str]:
    """Normalised sentence -> identifier. A printed sentence that holds breaks of its own counts by its last part's start."""
    import re

    out = {}
    for name, forms in table.items():
        for form in forms:
            parts = [_plain(p) for p in re.split(r"[.!?:;]+(?:\s+|$)|\n+", form)]
            out[max(parts, key=len)] = name
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: the id, n_sentences, sentence_ids, licences and unexplained.

    n_sentences counts sentences that have a letter or digit; sentence_ids are the
    identifiers in order, licences the distinct licences in the order of their rules,
    unexplained the identifiers that no rule took (all comma-joined, empty if none).
    Wrapped sentences count by their lines in n_sentences, and once in sentence_ids.
    A null or empty text has none of them; a null id stays null; repeated rows each get
    their row; an empty table gives an empty result; other columns are ignored.
    """
    known = known_sentences(FILE_SENTENCES) | known_sentences()
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable((known | _named()[0]).items())])
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    found = docs.select(F.col(f"`{id_col}`").alias("id"), marked(text).alias("marked"))
    sentences = F.filter(F.split("marked", "[\u0001\n]"), lambda s: F.trim(s) != "")
    hits = F.regexp_extract_all("marked", F.lit(_known_pattern(known)), F.lit(0))

    def identifier(hit: Column) -> Column:
        plain = F.trim(F.regexp_replace(hit, rf"[ \u0001\n]+{PREFIX}", " "))
        for form in (k for k in known if " slot " in k):
            before, after = form.split(" slot ")
            plain = F.when(plain.startswith(f"{before} ") & plain.endswith(f" {after}"), form).otherwise(plain)
        own = F.try_element_at(table, F.regexp_replace(plain, f"^{UNDER}", "under "))
        return F.coalesce(own, F.element_at(table, F.concat(F.lit("under "), F.regexp_extract(plain, _names_at_end(), 1))))

    found = found.select("id", F.size(sentences).cast("long").alias("n_sentences"), F.transform(hits, identifier).alias("ids"))
    rules = F.array(*[F.struct(F.lit(licence).alias("licence"), F.lit("," + ",,".join(names) + ",").alias("ids")) for licence, names in ordered_rules()])

    def use(state: Column, rule: Column) -> Column:
        rest = F.replace(state["rest"], rule["ids"], F.lit(""))
        taken = F.when(rest != state["rest"], F.array_append(state["licences"], rule["licence"])).otherwise(state["licences"])
        return F.struct(rest.alias("rest"), taken.alias("licences"))

    start = F.struct(F.concat(F.lit(","), F.array_join("ids", ",,"), F.lit(",")).alias("rest"), F.array().cast("array<string>").alias("licences"))
    found = found.withColumn("matched", F.when(F.size("ids") > 0, F.aggregate(rules, start, use)).otherwise(start))
    return found.select(
        F.col("id").alias(id_col),
        "n_sentences",
        F.array_join("ids", ",").alias("sentence_ids"),
        F.array_join(F.array_distinct("matched.licences"), ",").alias("licences"),
        F.array_join(F.filter(F.split("matched.rest", ","), lambda x: x != ""), ",").alias("unexplained"),
    )


def sql() -> str:
    """DuckDB SQL of op4 over the table documents, from the same two tables."""
    pairs = ", ".join(f"('{s}', '{i}')" for s, i in known_sentences().items())
    steps, last = [], "l0"
    for k, (_, names) in enumerate(RULES):
        steps.append(f"l{k + 1} AS (SELECT *, replace(x{k}, ',{',,'.join(names)},', '') AS x{k + 1} FROM l{k})")
        last = f"l{k + 1}"
    licences = ", ".join(f"CASE WHEN x{k} <> x{k + 1} THEN '{licence}' END" for k, (licence, _) in enumerate(RULES))
    order = ", ".join(f"('{x}', {i})" for i, x in enumerate(dict.fromkeys(x for x, _ in RULES)))
    return rf"""
WITH known(s, name) AS (VALUES {pairs}), ord(licence, o) AS (VALUES {order}),
d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[.!?:;]+(\s+|$)|\n+', chr(1), 'g'), '[^a-z0-9\x01]+', ' ', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS ss FROM documents),
e AS (SELECT rid, i, ss[i] AS s FROM (SELECT rid, ss, unnest(range(1, len(ss) + 1)) AS i FROM d)),
ids AS (SELECT rid, list(name ORDER BY i) AS ids FROM e JOIN known USING (s) GROUP BY rid),
l0 AS (SELECT d.rid, doc_id, len(ss)::BIGINT AS n_sentences, coalesce(ids, []) AS ids, ',' || array_to_string(coalesce(ids, []), ',,') || ',' AS x0 FROM d LEFT JOIN ids USING (rid)),
{", ".join(steps)},
f AS (SELECT rid, unnest([{licences}]) AS licence FROM {last}),
g AS (SELECT rid, string_agg(licence, ',' ORDER BY o) AS licences FROM (SELECT DISTINCT rid, licence FROM f WHERE licence IS NOT NULL) JOIN ord USING (licence) GROUP BY rid)
SELECT doc_id, n_sentences, array_to_string(ids, ',') AS sentence_ids, coalesce(licences, '') AS licences,
  array_to_string(list_filter(string_split(x{len(RULES)}, ','), lambda x: x <> ''), ',') AS unexplained
FROM {last} LEFT JOIN g USING (rid)
"""

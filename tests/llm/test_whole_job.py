"""Cases in which a stage once did less than its whole job."""

import random
import re

from pyspark.sql import functions as F

from framelytics.llm import decontam, langid, licenses, quality, simhash


def test_signs_between_words_are_rejected(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    rows = [(1, " | ".join(words)), (2, " ".join(words)), (3, "# " + " ".join(words))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in quality.keep_good(docs).collect()} == {2, 3}


UNLEARNED = {
    "fi": "Vanha kirjasto suljettiin syksyllä, ja kaupungin asukkaat kokoontuivat torille keskustelemaan siitä, mitä rakennukselle pitäisi tehdä seuraavana vuonna.",
    "pl": "Stara biblioteka została zamknięta jesienią, a mieszkańcy miasta zebrali się na rynku, żeby porozmawiać o tym, co zrobić z budynkiem w przyszłym roku.",
    "tr": "Eski kütüphane sonbaharda kapatıldı ve şehir sakinleri gelecek yıl bina ile ne yapılması gerektiğini konuşmak için meydanda toplandı.",
    "ru": "Старая библиотека была закрыта осенью, и жители города собрались на площади, чтобы обсудить, что делать со зданием в следующем году.",
    "zh": "旧图书馆在秋天关闭了,城里的居民聚集在广场上,讨论明年应该如何处理这座建筑。",
    "noise": " ".join("".join(random.Random(k).choices("abcdefghijklmnopqrstuvwxyz", k=2 + k % 8)) for k in range(40)),
}


def test_unlearned_languages_are_not_recognised(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").cast("string"), "text", "lang")
    docs = docs.where("length(text) >= 60")
    strange = spark.createDataFrame([(k, t, None) for k, t in UNLEARNED.items()], docs.schema)
    kept = {r["doc_id"] for r in langid.keep_recognised(docs.union(strange)).select("doc_id").collect()}
    assert not kept & set(UNLEARNED)
    assert len(kept) >= 0.995 * docs.count()


def prose(k):
    return " ".join(f"w{random.Random(k * 100 + j).randrange(10**6)}" for j in range(40))


def test_near_copies_are_told_apart_by_row(spark):
    same = prose(1)
    rows = [(1, same)] * 5 + [(None, same)] * 5 + [(7, same), (7, prose(2)), (None, prose(3)), (None, prose(4)), (None, prose(4))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((tuple(r) for r in simhash.keep_first(docs).collect()), key=str)
    assert kept == sorted([(1, same), (7, prose(2)), (None, prose(3)), (None, prose(4))], key=str)


def test_contaminated_rows_leave_alone(spark):
    items = spark.createDataFrame([(1, prose(1))], "item_id long, text string")
    rows = [(None, prose(1)), (None, prose(2)), (3, "see " + prose(1)), (3, prose(3)), (4, prose(4))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {tuple(r) for r in decontam.clean_only(docs, items).collect()}
    assert kept == {(None, prose(2)), (3, prose(3)), (4, prose(4))}


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MIT = """Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
GPL2 = GPL3.replace("software: you", "software; you").replace("Foundation, either version 3", "Foundation; either version 2")
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
BSD3 = BSD2 + """

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
FILES = {"Apache-2.0": APACHE, "MIT": MIT, "GPL-3.0-or-later": GPL3, "GPL-2.0-or-later": GPL2, "BSD-2-Clause": BSD2, "BSD-3-Clause": BSD3, "MPL-2.0": MPL}


def test_wrapped_licences_are_recognised(spark):
    prefixes = {"": "", "hash": "# ", "slash": "// ", "star": " * ", "lisp": ";; ", "dnl": "dnl "}
    rows = [(f"{name}/{kind}", "import x\n" + re.sub("^", p, text, flags=re.M) + "\nreturn 1") for name, text in FILES.items() for kind, p in prefixes.items()]
    # A notice of one line stays known between lines that end without a mark.
    rows += [("MIT/line", "some words\nLicensed under the MIT License\nmore words"), ("/none", "the licence\nof this\nwork")]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {r["doc_id"]: r["licences"] for r in found} == {k: k.split("/")[0] for k, _ in rows}
    assert {r["doc_id"] for r in found if r["unexplained"]} == set()


LGPL = GPL2.replace("This program", "This library").replace("General Public", "Lesser General Public").replace("version 2 of", "version 2.1 of")
PROBES = {
    "apache": (APACHE, "Apache-2.0"),
    "apache commented": (re.sub("^", "# ", APACHE, flags=re.M), "Apache-2.0"),
    "mit with title": ("MIT License\n\n" + MIT, "MIT"),
    "mit without title": (MIT, "MIT"),
    "lgpl": (LGPL, "LGPL-2.1-or-later"),
    "gpl 2 or later": (GPL2, "GPL-2.0-or-later"),
    "spdx": ("// SPDX-License-Identifier: MIT\nint x;", "MIT"),
    "embedded": ("The code is licensed under the MIT License and provided as is.", "MIT"),
    "spdx expression": ("# SPDX-License-Identifier: (Apache-2.0 OR MIT)\n", "MIT,Apache-2.0"),
    "spdx old name": ("SPDX-License-Identifier: GPL-3.0", "GPL-3.0-only"),
    "embedded wrapped": ("This tool is released under the terms of the\n * GNU Affero General Public License version 3, see\n * the file", "AGPL-3.0-only"),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.", "ISC"),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "Unlicense"),
    "bsd with disclaimer": (BSD3 + '\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"\nAND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE\nIMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE\nDISCLAIMED.', "BSD-3-Clause"),
    "not a licence": ("The bridge under the MIT campus and the public license of a driver.", ""),
}


def test_notices_of_files(spark):
    found = licenses.scan(spark.createDataFrame([(k, t) for k, (t, _) in PROBES.items()], "doc_id string, text string")).collect()
    assert {r["doc_id"]: r["licences"] for r in found} == {k: x for k, (_, x) in PROBES.items()}
    assert {r["doc_id"]: r["unexplained"] for r in found if r["unexplained"]} == {}

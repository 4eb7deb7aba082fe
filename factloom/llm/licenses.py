"""Licence scans by a trained paragraph classifier.

A multinomial logistic regression over sparse word n-grams, trained here on the texts below, on sentences
that name a licence, on damaged copies of both and on sentences that only sound alike, tells the licence
family of a paragraph; its probabilities are calibrated by a temperature fitted on sentences of another
wording than those it was trained on, and a class of its own stands for everything unknown. A prediction
holds if a template of its family confirms it: the wanted share of a text's five-word shingles, or one of
the family's names. Scoring is a join with the n-grams' weights, whose number the texts bound; only
DataFrame functions run over the corpus. Training is some thousand short rows in the driver.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

UNKNOWN = "unknown"
WORDS = 5
LEAST = 0.8
SURE = 0.5
GRAMS = (1, 2, 3)
CHUNK = 1000

# Names that a family goes by in a sentence.
NAMES = {
    "MIT": ("MIT License", "MIT", "Expat License", "X11/MIT License"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache 2.0", "Apache-2.0", "Apache License 2.0", "Apache License v2", "Apache 2 License", "ASL 2.0"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GPLv3", "GPL-3.0", "GPL v3", "GPL version 3", "GNU GPL 3", "GPL-3.0-or-later", "GPL-3.0-only"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GPLv2", "GPL-2.0", "GPL v2", "GPL version 2", "GNU GPL 2", "GPL-2.0-or-later", "GPL-2.0-only"),
    "GPL": ("GNU General Public License", "GNU GPL", "GPL"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPLv3", "LGPL-3.0", "LGPL v3", "LGPL-3.0-or-later", "LGPL-3.0-only"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "LGPLv2.1", "LGPL-2.1", "LGPL v2.1", "LGPL-2.1-or-later", "LGPL-2.1-only"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPLv3", "AGPL-3.0", "AGPL v3", "Affero GPL", "AGPL-3.0-or-later", "AGPL-3.0-only"),
    "BSD": ("BSD 3-Clause License", "BSD 2-Clause License", "BSD 3-Clause", "BSD 2-Clause", "BSD-3-Clause", "BSD-2-Clause", "New BSD License", "Simplified BSD License", "three-clause BSD license", "two-clause BSD license", "BSD License"),
    "MPL-2.0": ("Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0", "Mozilla Public License"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License v2.0", "EPL 2.0", "EPL-2.0", "Eclipse Public License"),
    "ISC": ("ISC License", "ISC"),
    "Zlib": ("zlib License", "zlib/libpng License", "Zlib"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License", "BSL-1.0"),
    "Unlicense": ("Unlicense", "The Unlicense"),
    "WTFPL": ("WTFPL", "Do What The F*** You Want To Public License"),
    "CC0-1.0": ("CC0 1.0", "CC0-1.0", "CC0", "CC0 1.0 Universal", "Creative Commons Zero"),
    "CC-BY-4.0": ("CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0", "Creative Commons Attribution License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike 4.0"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial 4.0"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
}
#: Sentences that name a licence: the first ones train the classifier, the others fit its temperature.
MENTIONS = (
    "Licensed under the {}.", "Released under the {}.", "Released under {}.", "Distributed under the {}.", "This project is licensed under the terms of the {}.", "This work is licensed under a {}.",
    "Available under the {}.", "{}", "License: {}", "SPDX-License-Identifier: {}", "This software is released under the {}, see the file LICENSE.", "The code is published under {} terms.", "Covered by the {}.", "Use of this source code is governed by the {}.",
)
HEAT_MENTIONS = ("Provided under the {}.", "The source code is made available under {}.", "licensed {}", "All files are subject to the {}.")

# Paragraphs as the licences and their notices give them.
NOTICES = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("Apache-2.0", "See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."),
    ("Apache-2.0", "This License does not grant permission to use the trade names, trademarks, service marks, or product names of the Licensor, except as required for reasonable and customary use in describing the origin of the Work and reproducing the content of the NOTICE file."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("GPL-3.0", "All rights granted under this License are granted for the term of copyright on the Program, and are irrevocable provided the stated conditions are met. This License explicitly affirms your unlimited permission to run the unmodified Program."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 only, as published by the Free Software Foundation."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users."),
    ("GPL-2.0", "You are not required to accept this License, since you have not signed it. However, nothing else grants you permission to modify or distribute the Program or its derivative works. These actions are prohibited by law if you do not accept this License."),
    ("GPL", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL", "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", "You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("BSD", "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "This Source Code Form is \"Incompatible With Secondary Licenses\", as defined by the Mozilla Public License, v. 2.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EPL-2.0", "THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("Zlib", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required."),
    ("Zlib", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Unlicense", "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain."),
    ("WTFPL", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide under CC0 1.0."),
    ("CC0-1.0", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
)
#: Sentences that share words with notices or hold a licence's name and grant nothing; every fourth fits the temperature.
OTHERS = (
    "A driving license is required for this job and a copy of it must be sent in.", "The restaurant has lost its license to sell wine for this year.", "Please ask for permission before you use a photograph of the building.",
    "The software is sold without restriction to any person who asks for a copy.", "Copyright of the letters is with the family of the author, who died in spring.", "The public domain was discussed in the second version of the report.",
    "Terms and conditions apply and all rights are reserved by the company.", "The general public was invited to the foundation of the library.", "He published the source of the river and the form of the delta.",
    "You can obtain the documentation free of charge in the office.", "The work is distributed in all countries either by post or by train.", "This library is free for any purpose and open at any later hour.",
    "Licensed doctors may work under the terms of the new law.", "The license is not yet known and will be chosen at a later time.", "She studied physics at MIT and moved to the coast.", "Researchers at MIT have built a small robot.",
    "The Apache helicopter landed at 2.0 miles from the village.", "The Apache web server was updated to version 2 on Monday.", "Copyright 2019 by the authors. All rights reserved.", "Copyright (c) 2021 Example Corp.",
    "The GNU compiler was released in version 3 last year.", "An eclipse of the sun was seen from the public square.", "Mozilla has released a new version of its browser.", "Her permission was hereby granted by the court, with or without fee.",
    "The zoo lost its licence after the inspection.", "A fishing licence can be bought at the shop by the lake.", "The warranty covers all parts for two years from the date of sale.", "No warranty is given for goods that were sold at a reduced price.",
    "Without permission of the owner nobody may enter the garden.", "The band gave its label a licence for the new record.", "Every licence plate in the list was checked by the police.", "The creative commons room of the school is open to all.",
    "The BSD conference takes place in autumn.", "He boosted the sales of the software by a third.", "The ISC is a committee of the league.", "We compared zlib with other ways to compress a file.",
    "A pilot must renew the license every two years.", "Permission denied: the file could not be opened.", "You do not have permission to view this page.", "They were granted permission to build two houses.",
    "Redistribution of wealth was the subject of the debate.", "The party wants to redistribute land to farmers.", "All copyright questions must be sent to the publisher.", "The copyright of this photograph has expired.",
    "The painting has been in the public domain since 1950.", "The agency lost the license in version 2 of the contract.", "Your license key was sent by mail and is valid for one year.", "Enter the license key to activate the program.",
    "Read the license agreement before you install the product.", "Our license fees will rise next year.", "The taxi driver showed his licence to the officer.", "This license expires in June.",
)
#: Names that are common words or name other things too.
SHORT = ("MIT", "ISC", "BSD", "Apache", "Eclipse", "Mozilla", "Boost", "Zlib", "GNU", "CC")
#: Frames in which a short name is something else.
FRAMES = ("He went to {}.", "She studied at {} for a year.", "The {} team won the prize.", "We met people from {} in spring.", "{} has a new building with a license to sell beer.", "The licence of {} in the city was renewed.", "My {} degree.", "{} is near the river.")
#: A paragraph without any of these confirms no template: enough of each one's shingles hold one (tested).
CUE = (
    r"(?<![A-Za-z0-9])(?:(?i:l(?:icen[cs]|gpl|iable|esser general)|c(?:opyright|c0|c[ -]by|reative commons|ompile(?:, sell|d binary)|ommercial or non|onsequential)|p(?:ermission|ermitted|ublic domain|lainly marked)|re(?:licen[cs]|distribut)"
    r"|w(?:arrant|tfpl|ithout any express)|s(?:pdx|oftware|ublicen[cs]|hall the (?:authors?|copyright))|g(?:nu\b|pl)|a(?:pache|sl\b|gpl|ffero)|m(?:ozilla|pl\b|isrepresented)|e(?:clipse|pl\b)|b(?:sd\b|sl\b|oost software)|zlib|free (?:to copy|of charge)"
    r"|held liable|un(?:licen[cs]|encumbered)|negligence|you want to public|damages)|(?:MIT|ISC|Expat)\b)"
)
#: A paragraph ends at a line end after a sentence or at an empty line; other line ends only wrap.
BREAK = r"(?<=[.!?:;])[\x20\t\r]*\n|\n[\x20\t\r]*\n"
TOKEN = re.compile(r"[^\W_]+(?:[.+-][^\W_]+)*")
JVM_TOKEN = r"[\p{L}\p{N}]++(?:[.+-][\p{L}\p{N}]++)*+"


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def grams(words: list[str], n: int) -> set[str]:
    return {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}


def shingles(words: list[str]) -> set[str]:
    """Five-word shingles; a notice of fewer words is one."""
    return grams(words, min(WORDS, len(words)))


@lru_cache
def templates() -> tuple[tuple[str, str], ...]:
    """(family, text) of every notice, then of every name."""
    return (*NOTICES, *((f, n) for f, names in NAMES.items() for n in names))


def damaged(words: list[str]) -> list[list[str]]:
    """Copies with words gone, words between, and cut ends."""
    noise = ["lorem", "ipsum", "dolor"]
    out = [words, noise + words + noise]
    for k in range(2):
        out += [[w for i, w in enumerate(words) if i % 7 != k], [x for i, w in enumerate(words) for x in ((w, "amet") if i % 9 == k else (w,))]]
    return [*out, words[1:], words[:-1]]


@lru_cache
def model() -> tuple[list[str], dict[str, list[float]], list[float]]:
    """Classes (the unknown one last), weights by n-gram, biases; divided by the temperature already."""
    classes = [*NAMES, UNKNOWN]
    said = lambda forms: [(classes.index(f), tokens(m.format(n))) for f, names in NAMES.items() for n in names for m in forms if m != "{}" or len(tokens(n)) > 1 or any(c in n for c in "0123456789-")]
    rows = [(classes.index(f), w) for f, t in NOTICES for w in damaged(tokens(t))] + said(MENTIONS)
    rows += [(len(classes) - 1, tokens(t)) for k, t in enumerate(OTHERS) if k % 4 != 3 for _ in range(3)]
    rows += [(len(classes) - 1, tokens(m.format(n))) for m in FRAMES[:-2] for n in SHORT]
    # Fragments: what is common to several families says nothing of either.
    names = {" ".join(tokens(n)) for all in NAMES.values() for n in all}
    rows += [(len(classes) - 1, tokens(m.format("new one"))) for m in MENTIONS] + [(len(classes) - 1, tokens(t)[: max(1, len(tokens(t)) // 4)]) for _, t in NOTICES if len(tokens(t)) > 12]
    rows += [(len(classes) - 1, [w]) for w in sorted({w for _, t in NOTICES for w in tokens(t)} - names)]
    heat = said(HEAT_MENTIONS) + [(len(classes) - 1, tokens(t)) for k, t in enumerate(OTHERS) if k % 4 == 3 for _ in range(8)]
    heat += [(len(classes) - 1, tokens(m.format(n))) for m in FRAMES[-2:] for n in SHORT]
    vocabulary = {g: k for k, g in enumerate(sorted({g for c, w in rows if c < len(classes) - 1 and "lorem" not in w and "amet" not in w for n in GRAMS for g in grams(w, n)}))}

    def matrix(rows: list) -> np.ndarray:
        x = np.zeros((len(rows), len(vocabulary)), np.float32)
        for r, (_, w) in enumerate(rows):
            x[r, [vocabulary[g] for n in GRAMS for g in grams(w, n) if g in vocabulary]] = 1
        return x / np.sqrt(np.maximum(1, x.sum(axis=1, keepdims=True)))

    def soft(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    x, y = matrix(rows), np.eye(len(classes), dtype=np.float32)[[c for c, _ in rows]]
    w, b = np.zeros((len(vocabulary), len(classes)), np.float32), np.zeros(len(classes), np.float32)
    v, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(150):
        rest = y - soft(x @ w + b)
        v = 0.9 * v + (x.T @ rest - 0.02 * w)
        vb = 0.9 * vb + rest.sum(axis=0) * 0.1
        w += 0.03 * v
        b += 0.03 * vb
    z, t = matrix(heat) @ w + b, np.eye(len(classes))[[c for c, _ in heat]]
    heats = np.linspace(0.3, 4, 75)
    best = heats[int(np.argmin([-np.log(np.maximum((soft(z / h) * t).sum(axis=1), 1e-12)).sum() for h in heats]))]
    return classes, {g: (w[k] / best).astype(float).tolist() for g, k in vocabulary.items()}, (b / best).astype(float).tolist()


def gram_table(spark: SparkSession) -> DataFrame:
    """(gram, weights by class or null, templates with this shingle): some ten thousand rows, as the templates have n-grams. The empty gram is in every paragraph."""
    _, weights, bias = model()
    held: dict[str, list] = {"": [[0.0] * len(bias), []], **{g: [w, []] for g, w in weights.items()}}
    for k, (_, t) in enumerate(templates()):
        for s in shingles(tokens(t)):
            held.setdefault(s, [None, []])[1].append(k)
    return spark.createDataFrame([(g, w, n) for g, (w, n) in held.items()], "gram string, weights array<double>, templates array<int>")


def paragraph_grams(words: Column) -> Column:
    """All n-grams that the table may hold and that begin in the first CHUNK words, each once."""
    sizes = sorted({*GRAMS, WORDS, *(min(WORDS, len(tokens(t))) for _, t in templates())})
    each = [F.when(F.size(words) >= n, _runs(words, n)).otherwise(F.array().cast("array<string>")) for n in sizes]
    return F.array_distinct(F.concat(F.array(F.lit("")), *each))


def _runs(words: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.least(F.size(words) - n + 1, F.lit(CHUNK))), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))


def _chunks(words: Column) -> Column:
    """Pieces of CHUNK words, each with the WORDS - 1 words after it."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(words) - 1, F.lit(0)) / CHUNK).cast("int")), lambda k: F.slice(words, k * CHUNK + 1, F.lit(CHUNK + WORDS - 1)))


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text", least: float = LEAST, sure: float = SURE) -> DataFrame:
    """A row for each paragraph with a licence word: id, paragraph (from 0), license, probability, similarity, notice.

    ``license`` is the family if the classifier is sure and a template of it confirms, else ``unknown``;
    ``similarity`` is the largest share of a template of the predicted family in the paragraph, ``notice``
    that template's number. A paragraph without any licence word (``CUE``) holds too little of every template
    to be confirmed, so it has no row and loses nothing. Null and empty texts have no paragraphs; repeated rows
    are scanned alike; an empty table gives no rows; other columns are ignored. Whole texts are read, long
    paragraphs in pieces that overlap.
    """
    spark = docs.sparkSession
    classes, _, bias = model()
    t = docs.select(F.col(id).alias("_id"), text_of(text).alias("_t")).where(F.col("_t").rlike(CUE)).withColumn("_row", F.monotonically_increasing_id())
    p = t.select("_id", "_row", F.posexplode(F.split("_t", BREAK, -1)).alias("paragraph", "_p")).where(F.col("_p").rlike(CUE))
    p = p.select("_id", "_row", "paragraph", F.explode(_chunks(F.regexp_extract_all(F.lower("_p"), F.lit(JVM_TOKEN), F.lit(0)))).alias("_w"))
    g = p.select("_id", "_row", "paragraph", F.explode(paragraph_grams(F.col("_w"))).alias("gram"))
    key = ["_id", "_row", "paragraph"]
    # The table has as many rows as the templates have n-grams.
    held = g.join(F.broadcast(gram_table(spark)), "gram").groupBy(*key, "gram").agg(F.first("weights").alias("weights"), F.first("templates").alias("templates"))
    sums = [F.sum(F.col("weights")[k]) for k in range(len(classes))]
    scored = held.groupBy(*key).agg(F.count("weights").alias("n"), F.array(*sums).alias("z"), F.flatten(F.collect_list("templates")).alias("hits"))
    # Rows are set against the root of their known n-grams, as in training; the empty one is none.
    scored = scored.withColumn("z", F.zip_with("z", F.array(*map(F.lit, bias)), lambda z, b: z / F.sqrt(F.greatest(F.lit(1), F.col("n") - 1)) + b))
    top = F.array_max("z")
    scored = scored.select("_id", "paragraph", "hits", F.element_at(F.array(*map(F.lit, classes)), F.array_position("z", top).cast("int")).alias("guess"), (1 / F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x - top))).alias("probability"))
    # By family the templates' numbers and shingles; the share of each is counted in the hits, which the table bounds.
    of = F.create_map(*[x for f in NAMES for x in (F.lit(f), F.array(*[F.struct(F.lit(k).alias("k"), F.lit(len(shingles(tokens(t)))).alias("n")) for k, (g, t) in enumerate(templates()) if g == f]))])
    share = lambda t: F.struct((F.size(F.filter("hits", lambda h: h == t["k"])) / t["n"]).alias("share"), (-t["k"]).alias("k"))
    best = F.array_max(F.transform(F.element_at(of, F.col("guess")), share))
    scored = scored.withColumn("best", F.when(F.col("guess") != UNKNOWN, best)).withColumn("similarity", F.coalesce("best.share", F.lit(0.0)))
    found = (F.col("guess") != UNKNOWN) & (F.col("probability") >= sure) & (F.col("similarity") >= least)
    return scored.select(F.col("_id").alias(id), "paragraph", F.when(found, F.col("guess")).otherwise(UNKNOWN).alias("license"), "probability", "similarity", F.when(found, -F.col("best.k")).alias("notice"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op7_licenses": op7_licenses}
ORACLE: dict[str, str] = {}

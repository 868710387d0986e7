"""License scan (operator 6).

Texts are normalised to lower-case words, and all their windows of words (lines,
sentences and paragraphs are some of them) compared
with licence templates by the Dice coefficient of their sets of word bigrams,
2 |A and B| / (|A| + |B|) >= 0.8.  The best windows start and end with bigrams of
the template that are not again inside.  Candidates are pruned by size bounds: a
template with b bigrams fits units with b * t / (2 - t) to b * (2 - t) / t of
them only.  A text is looked at in full when it has one of the bigrams that a
match can't do without: of a template's bigrams, the rarest ones of which a
unit at the threshold must have one at least.

Results: one row for each document row, with the best template (highest
coefficient, then the longest, then by name) and the names of all that match.
Null and empty texts, and texts without a match, have a null licence and
coefficient 0.  Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_schema, id_text, rows_batch, slices, strings_of, table, tidied
from .ragged import words_of

THRESHOLD = 0.8
WORD = re.compile(r"[^\W_]+")

_AS_IS = 'the software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. in no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.'
_BSD_TAIL = 'this software is provided by the copyright holders and contributors "as is" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. in no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage.'
_BSD_HEAD = "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_GNU = "this program is free software: you can redistribute it and/or modify it under the terms of the gnu {0} as published by the free software foundation, either version {1} of the license, or (at your option) any later version. this program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. see the gnu {0} for more details."

#: Public licence texts, the notices by which they are applied, and short statements.
TEMPLATES = [
    ("MIT", "released under the mit license"),
    ("MIT", "licensed under the mit license"),
    ("MIT", "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions: the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software. " + _AS_IS),
    ("Apache-2.0", "licensed under the apache license, version 2.0"),
    ("Apache-2.0", 'licensed under the apache license, version 2.0 (the "license"); you may not use this file except in compliance with the license. you may obtain a copy of the license at http://www.apache.org/licenses/license-2.0 unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an "as is" basis, without warranties or conditions of any kind, either express or implied. see the license for the specific language governing permissions and limitations under the license.'),
    ("GPL-2.0", "this work is licensed under the gnu general public license, version 2"),
    ("GPL-2.0", _GNU.format("general public license", "2")),
    ("GPL-3.0", "this work is licensed under the gnu general public license, version 3"),
    ("GPL-3.0", _GNU.format("general public license", "3")),
    ("LGPL-3.0", "this work is licensed under the gnu lesser general public license, version 3"),
    ("LGPL-3.0", _GNU.format("lesser general public license", "3")),
    ("AGPL-3.0", "this work is licensed under the gnu affero general public license, version 3"),
    ("AGPL-3.0", _GNU.format("affero general public license", "3")),
    ("BSD-2-Clause", _BSD_HEAD + " " + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + " neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_TAIL),
    ("BSD-3-Clause", "use of this source code is governed by a bsd-style license that can be found in the license file"),
    ("ISC", 'permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. the software is provided "as is" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. in no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software.'),
    ("MPL-2.0", "this source code form is subject to the terms of the mozilla public license, v. 2.0. if a copy of the mpl was not distributed with this file, you can obtain one at http://mozilla.org/mpl/2.0/."),
    ("Unlicense", "this is free and unencumbered software released into the public domain. anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    *((f"CC-{k.upper().replace(' ', '-')}-4.0", f"{lead} cc {k} 4.0") for k in ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd") for lead in ("licensed under", "this work is licensed under")),
    ("CC-BY-4.0", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("CC-BY-SA-4.0", "this work is licensed under a creative commons attribution-sharealike 4.0 international license"),
    ("CC-BY-NC-4.0", "this work is licensed under a creative commons attribution-noncommercial 4.0 international license"),
    ("CC0-1.0", "to the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("Zlib", "this software is provided 'as-is', without any express or implied warranty. in no event will the authors be held liable for any damages arising from the use of this software. permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("BSL-1.0", "distributed under the boost software license, version 1.0. (see accompanying file license_1_0.txt or copy at https://www.boost.org/license_1_0.txt)"),
    ("EPL-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("OFL-1.1", "this font software is licensed under the sil open font license, version 1.1"),
    ("WTFPL", "do what the fuck you want to public license"),
    ("LGPL-2.1", _GNU.format("lesser general public license", "2.1")),
    # Identifiers of one word are left out: three bigrams differ by one, and without it two of them reach the threshold for all.
    *((name, f"spdx-license-identifier: {name.lower()}") for name in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "CC0-1.0", "BSL-1.0", "EPL-2.0", "OFL-1.1")),
]


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def bigrams(ws: list[str]) -> set[tuple[str, str]]:
    return set(zip(ws, ws[1:], strict=False))


class Templates:
    """Templates by size, and the bigrams one of which a text must have."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float = THRESHOLD):
        self.threshold = threshold
        self.all = sorted(((len(g), name, g) for name, text in templates if (g := bigrams(words(text)))), key=lambda t: (-t[0], t[1]))
        often = Counter(g for _, _, grams in self.all for g in grams)
        need: set[tuple[str, str]] = set()
        self.having: dict[tuple[str, str], list[int]] = {}
        self.common: list[int] = []
        for nth, (n, _, grams) in enumerate(self.all):
            for g in grams:
                self.having.setdefault(g, []).append(nth)
            # With k common ones, 2k / (n + |unit|) >= t and |unit| >= k give k >= t n / (2 - t).
            k = math.ceil(threshold * n / (2 - threshold) - 1e-9)
            self.common.append(k)
            need |= set(sorted(grams, key=lambda g: (often[g], g))[: n - k + 1])
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for g in need for w in g}))}
        self.need = np.zeros((len(self.vocabulary) + 1,) * 2, bool)
        for a, b in need:
            self.need[self.vocabulary[a], self.vocabulary[b]] = True
        self.bounds = [(n * threshold / (2 - threshold) - 1e-9, n * (2 - threshold) / threshold + 1e-9) for n, _, _ in self.all]
        self.least, self.most = min(b[0] for b in self.bounds), max(b[1] for b in self.bounds)

    def suspects(self, texts: pa.StringArray) -> np.ndarray:
        """Rows that have a needed bigram, words of different lines included."""
        plain = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{N}]+", " "), " ")
        codes, distinct, offsets = words_of(plain, " ")
        ids = np.fromiter((self.vocabulary.get(w, -1) for w in distinct), np.int64, len(distinct))[codes]
        hit = np.flatnonzero(self.need[ids[:-1], ids[1:]])
        row = np.searchsorted(offsets, hit, "right") - 1
        return np.unique(row[hit + 1 < offsets[row + 1]])

    def matches(self, unit: list[str]) -> dict[str, float]:
        grams = bigrams(unit)
        n, out = len(grams), {}
        if self.least <= n <= self.most:
            for (low, high), (b, name, own) in zip(self.bounds, self.all, strict=True):
                if low <= n <= high and (k := len(grams & own)) and (dice := 2 * k / (n + b)) >= self.threshold:
                    out[name] = max(out.get(name, 0.0), dice)
        return out

    def scan(self, text: str) -> dict[str, float]:
        """Best coefficient by name, over the text's windows."""
        ws = words(text)
        pairs = list(zip(ws, ws[1:], strict=False))
        places: dict[int, list[int]] = {}
        for i, g in enumerate(pairs):
            for nth in self.having.get(g, ()):
                places.setdefault(nth, []).append(i)
        out: dict[str, float] = {}
        for nth, at in places.items():
            (n, name, own), high, k = self.all[nth], self.bounds[nth][1], self.common[nth]
            if len({pairs[i] for i in at}) < k:
                continue
            again: dict[tuple[str, str], int] = {}  # the next place of each bigram, from behind
            for x in range(len(at) - 1, -1, -1):
                start = at[x]
                end = again.get(pairs[start], len(pairs))
                again[pairs[start]] = start
                if x + k > len(at) or at[x + k - 1] >= end:
                    continue
                seen: set[tuple[str, str]] = set()
                found = 0
                for j in range(start, end):
                    g = pairs[j]
                    if g in seen:
                        continue
                    seen.add(g)
                    if len(seen) > high:
                        break
                    if g in own:
                        found += 1
                        if found >= k and (dice := 2 * found / (n + len(seen))) >= self.threshold:
                            out[name] = max(out.get(name, 0.0), dice)
                        if found == n:
                            break
        return out


OUT = "doc_id long, license string, dice double, n_licenses long, licenses string"


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    schema = arrow_schema(OUT)

    @tidied()
    def run(batches):
        known = Templates(templates, threshold)
        rank = {}
        for n, name, _ in known.all:
            rank[name] = max(rank.get(name, 0), n)
        for b in slices(batches, most_bytes=8 << 20):
            texts = strings_of(b)
            out = [[None] * b.num_rows, [0.0] * b.num_rows, [0] * b.num_rows, [""] * b.num_rows]
            for r in known.suspects(texts).tolist():
                if found := known.scan(texts[r].as_py()):
                    best = min(found, key=lambda x: (-found[x], -rank[x], x))
                    out[0][r], out[1][r], out[2][r], out[3][r] = best, found[best], len(found), ",".join(sorted(found))
            yield rows_batch(schema, [b.column(0), *out])

    return id_text(docs).mapInArrow(run, OUT)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))

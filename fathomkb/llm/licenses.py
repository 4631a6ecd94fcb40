"""License scans: sparse TF-IDF cosine of line windows and whole files to templates, then inheritance from the nearest ancestor directory."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, slices

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
    to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
    copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
    The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
_MIT_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
    FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
    WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright
    notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
    INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
    DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING
    OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
    1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
    2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
    and/or other materials provided with the distribution."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
    without specific prior written permission."""
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
    THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
    FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
    LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
    NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of
    the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is
    distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
    permissions and limitations under the License."""
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either
    version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
    without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."""
_GNU_TITLE = """GNU {name} Version {version}, {date} Copyright (C) {year} Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of
    this license document, but changing it is not allowed."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain
    one at https://mozilla.org/MPL/2.0/."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this
    software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""

Template = tuple[str, str, str]
#: Licences with their statements, notices and texts. A "title" is how a long licence's file begins.
TEMPLATES: list[Template] = [
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "notice", "Licensed under the MIT License."),
    ("MIT", "text", f"{_MIT_GRANT} {_MIT_DISCLAIMER}"),
    ("MIT", "notice", _MIT_GRANT),
    ("ISC", "text", _ISC),
    ("BSD-2-Clause", "text", f"{_BSD_2} {_BSD_DISCLAIMER}"),
    ("BSD-3-Clause", "text", f"{_BSD_2} {_BSD_3} {_BSD_DISCLAIMER}"),
    ("BSD-3-Clause", "notice", "Redistribution and use in source and binary forms, with or without modification, are permitted. BSD 3-Clause License."),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "notice", _APACHE),
    ("Apache-2.0", "title", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "notice", _GNU.format(name="General Public License", version=3)),
    ("GPL-3.0", "title", _GNU_TITLE.format(name="GENERAL PUBLIC LICENSE", version=3, date="29 June 2007", year=2007)),
    ("GPL-2.0", "notice", "This program is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "notice", _GNU.format(name="General Public License", version=2)),
    ("GPL-2.0", "title", _GNU_TITLE.format(name="GENERAL PUBLIC LICENSE", version=2, date="June 1991", year="1989, 1991")),
    ("LGPL-3.0", "notice", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "notice", _GNU.format(name="Lesser General Public License", version=3)),
    ("LGPL-3.0", "title", _GNU_TITLE.format(name="LESSER GENERAL PUBLIC LICENSE", version=3, date="29 June 2007", year=2007)),
    ("AGPL-3.0", "notice", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "notice", _GNU.format(name="Affero General Public License", version=3)),
    ("AGPL-3.0", "title", _GNU_TITLE.format(name="AFFERO GENERAL PUBLIC LICENSE", version=3, date="19 November 2007", year=2007)),
    ("MPL-2.0", "notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "notice", _MPL),
    ("MPL-2.0", "title", "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."),
    ("Unlicense", "text", _UNLICENSE),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "notice", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "notice", "Dedicated to the public domain under CC0 1.0 Universal."),
    *((lic, "notice", f"SPDX-License-Identifier: {lic}") for lic in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "Unlicense", "CC0-1.0")),
]
TOKEN = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
#: Segments end at line ends and sentence ends, and have at most this many tokens; a title is looked for in the first few that aren't of copyright.
SEGMENT, TITLE_SEGMENTS = 32, 8
#: Words so frequent in ordinary text that they make poor keys.
COMMON = frozenset(
    "a an and any are as at be but by can do for from has have in into is it its may more must name no not of on one or other see so such than that the "
    "this to used was way were which will with you your der die das den mit und von le la les de des du en et un une que el los las con para por es".split()
)
BREAK = re.compile(r"[\r\n]+|(?<=[.;!?])\s+")
THRESHOLD = 0.75


def damped(n: float) -> float:
    return 1 + math.log(n)


class Index:
    """Unit TF-IDF vectors of the templates: 1 + log tf, smooth idf over the templates, other words as in none of them."""

    def __init__(self, templates: list[Template], threshold: float):
        bags = [Counter(TOKEN.findall(text.lower())) for _, _, text in templates]
        df = Counter(t for bag in bags for t in bag)
        self.templates, self.threshold = templates, threshold
        self.other = math.log(1 + len(bags)) + 1
        self.idf = {t: math.log((1 + len(bags)) / (1 + n)) + 1 for t, n in df.items()}
        self.weights = {t: np.zeros(len(bags)) for t in df}  # token -> its weight in each template
        self.keys: set[str] = set()
        for i, bag in enumerate(bags):
            raw = {t: damped(n) * self.idf[t] for t, n in bag.items()}
            size = math.sqrt(sum(w * w for w in raw.values()))
            for t, w in raw.items():
                self.weights[t][i] = w / size
            # a cosine is at most the root of the squared weights of the words shared, so a window without any of
            # these cannot reach the threshold: the rarest words until the rest is too light
            rest = 1.0
            for t in sorted(raw, key=lambda t: (t in COMMON, df[t], -len(t), t)):
                if rest < threshold**2 - 1e-9:
                    break
                self.keys.add(t)
                rest -= (raw[t] / size) ** 2
        self.squared = {t: w * w for t, w in self.weights.items()}

    def against(self, tokens: list[str]) -> tuple[np.ndarray, float]:
        """The products of a bag of tokens with each template, and the bag's norm."""
        dot, norm = np.zeros(len(self.templates)), 0.0
        for t, n in Counter(tokens).items():
            w = damped(n) * self.idf.get(t, self.other)
            norm += w * w
            if t in self.weights:
                dot += w * self.weights[t]
        return dot, math.sqrt(norm)

    def within_reach(self, words: set[str]) -> np.ndarray:
        """The templates whose squared weights over these words could give the threshold."""
        mass = sum((self.squared[t] for t in words if t in self.squared), np.zeros(len(self.templates)))
        return mass >= self.threshold**2 - 1e-9

    def windows(self, segments: list[list[str]], among: np.ndarray, most: float) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first, last, cosines) of the windows of consecutive segments that hold a key word, as long as their norm is at most `most`.

        No window's product with a template is larger than the whole text's, and norms grow with windows: beyond the
        largest product by the threshold no window can reach it.
        """
        hot = [any(t in self.keys for t in s) for s in segments]
        following, ahead = [len(segments)] * len(segments), len(segments)
        for i in range(len(segments) - 1, -1, -1):
            ahead = following[i] = i if hot[i] else ahead
        weights = [[(t, self.idf.get(t, self.other), self.weights.get(t)) for t in s] for s in segments]
        for i in range(len(segments)):
            if following[i] == len(segments):
                return
            count: Counter[str] = Counter()
            dot, norm = np.zeros(len(self.templates)), 0.0
            for j in range(i, len(segments)):
                for t, idf, own in weights[j]:
                    n = count[t]
                    old, new = (damped(n) * idf if n else 0.0), damped(n + 1) * idf
                    count[t] = n + 1
                    norm += new * new - old * old
                    if own is not None:
                        dot += (new - old) * own
                if norm > most * most:
                    break
                if j >= following[i] and norm:
                    yield i, j, np.where(among, dot, 0) / math.sqrt(norm)

    def judge(self, text: str | None) -> tuple[str | None, str | None, float | None]:
        """(licence, how, score) of a text: file, header or nothing."""
        low = (text or "").lower()
        tokens = TOKEN.findall(low)
        if self.keys.isdisjoint(tokens):
            return None, None, None
        among = self.within_reach(set(tokens))
        if not among.any():
            return None, None, None
        dot, norm = self.against(tokens)
        whole = np.round(dot / norm, 9)
        if whole.max() >= self.threshold:
            return self.templates[int(whole.argmax())][0], "file", float(whole.max())
        segments = segments_of(low)
        title, header = (0.0, None), (0.0, None)
        titles = np.array([kind == "title" for _, kind, _ in self.templates])
        before = np.cumsum([0, *("copyright" not in s for s in segments)])  # segments of something else than copyright
        for i, _, cosine in self.windows(segments, among, float(dot[among].max()) / self.threshold + 1e-6):
            cosine = np.round(cosine, 9)
            if before[i] < TITLE_SEGMENTS and (best := np.where(titles, cosine, 0)).max() > title[0]:
                title = float(best.max()), int(best.argmax())
            if cosine.max() > header[0]:
                header = float(cosine.max()), int(cosine.argmax())
        if title[0] >= self.threshold:
            return self.templates[title[1]][0], "file", title[0]
        if header[0] >= self.threshold:
            return self.templates[header[1]][0], "header", header[0]
        return None, None, None


def segments_of(low: str) -> list[list[str]]:
    """The tokens of a lower-cased text by line and sentence, in segments of at most SEGMENT tokens."""
    out = []
    for part in BREAK.split(low):
        tokens = TOKEN.findall(part)
        out += [tokens[k : k + SEGMENT] for k in range(0, len(tokens), SEGMENT)]
    return out


def ancestors(directory: Column) -> Column:
    """A directory and all above it, down to the root "" ("a/b" -> a/b, a, "")."""
    parts = F.split(directory, "/")
    return F.when(directory == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))


def _judge(templates: list[Template], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, threshold)
        for batch in batches:
            column = batch.column(2)
            for a, b in slices(pa.compute.binary_length(column).fill_null(0).to_pylist(), 1 << 22):
                got = [index.judge(t) for t in column.slice(a, b - a).to_pylist()]
                columns = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.string(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *columns], ["doc_id", "path", "license", "how", "score"])

    return run


def scan(docs: DataFrame, path: str = "concat_ws('/', source, lang, doc_id)", threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", templates: list[Template] = TEMPLATES) -> DataFrame:
    """One row per input row: doc_id, path, license, how (file, header, inherited or null), score.

    A licence file is a text whose TF-IDF cosine to a template as a whole reaches the threshold, or that has the
    title of a long licence in its first segments, lines of copyright not counted. A header is a window of consecutive lines or sentences that reaches it to any template;
    the best window counts, of equal ones the first, of equal templates the first. With neither a text takes the
    licence of the nearest ancestor directory that has a licence file (of several there, the most frequent, then the
    first by name). Windows that hold none of the words without which the threshold is out of reach, or whose norm is too
    large for it, are skipped, which loses nothing. A text without line or sentence ends is cut every SEGMENT words.

    Null or empty texts have no licence of their own and may inherit; a null path counts as the root; null ids and
    repeated rows stay; an empty table gives no rows; other columns are ignored.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.expr(path), F.lit("")).alias("path"), F.col(text_col).cast("string").alias("text"))
    own = d.mapInArrow(_judge(templates, threshold), "doc_id long, path string, license string, how string, score double")
    own = cut(own.withColumn("dir", F.regexp_replace("path", "/?[^/]*$", "")), "own")
    files = own.filter("how = 'file'").groupBy("dir", "license").agg(F.count("*").alias("n"))
    places = files.groupBy("dir").agg(F.min(F.struct((-F.col("n")).alias("n"), "license")).alias("b")).select(F.col("dir").alias("above"), F.col("b.license").alias("found"))
    up = own.select("dir").distinct().select("dir", F.explode(ancestors(F.col("dir"))).alias("above"))
    inherited = cut(up.join(places, "above").groupBy("dir").agg(F.max_by("found", F.length("above")).alias("found")), "inherited")
    if inherited.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        out = own.join(F.broadcast(inherited), "dir", "left")
    else:  # one directory may hold most of the files: deal its rows over parts
        parts = 32
        many = inherited.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        out = own.withColumn("part", F.pmod(F.xxhash64("path", "doc_id"), F.lit(parts)).cast("int")).join(many, ["dir", "part"], "left")
    how = F.coalesce("how", F.when(F.col("found").isNotNull(), "inherited"))
    return out.select("doc_id", "path", F.coalesce("license", "found").alias("license"), how.alias("how"), "score")

"""License scan by diagonal voting.

Every rolling k-gram of words of every text is hashed and joined, in Spark, to the positions of the same k-grams in
license templates (notices and whole texts). A hit at word p of a text and word q of a template votes for the diagonal
p - q; votes are summed per (row, template, diagonal), diagonals at most GAP apart are merged (words put in or left out
shift the rest; a chain that spreads over more than a quarter of the template is looked at in overlapping stretches of
that width), and each merged span is verified against the words themselves: it counts if at least COVER of the template's
words stand there in order (their longest common subsequence). Of spans that overlap, one that another explains with as
many words or more, and as large a share or larger, is left out: a text under one license is not put under its neighbours
too. Beside the method's labels, four short phrases are found at every place (the base).

Defined results: null and empty texts have no words, no labels and score 0. Rows are told apart by doc_id and text, so
rows that share an id, or have none, never share spans; rows alike in both have the same. Extra columns are not looked at.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checked_broadcast, written
from .wordhash import LOWER, SIGNS, of_words, rolling, words, words_at

GRAM = 3
GAP = 3
COVER = 0.8
#: Grams that must agree before a span is verified, as a share of the template's grams.
VOTES = 0.4
#: Rows with candidate spans that may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000

# Phrases and labels of the base.
BASE = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND'
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either
version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details. You should have received a copy of the GNU {0} along with this
program. If not, see <https://www.gnu.org/licenses/>."""
_GNU_NAMES = [("gpl", "General Public License", "3"), ("lgpl", "Lesser General Public License", "3"), ("agpl", "Affero General Public License", "3")]
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of
source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. {}THIS SOFTWARE IS PROVIDED BY THE
COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY
OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""
_NO_NAME = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "

# Labels, and notices and whole texts of public licenses.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in
the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in
all copies or substantial portions of the Software. {_AS_IS} NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the
License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under
the License."""),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    *((label, f"under the terms of the GNU {name} as published by the Free Software Foundation") for label, name, _ in _GNU_NAMES),
    *((label, _GNU.format(name, version)) for label, name, version in _GNU_NAMES),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", _BSD.format("")),
    ("bsd", _BSD.format(_NO_NAME)),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one
at https://mozilla.org/MPL/2.0/."""),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice
and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER
RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE
OF THIS SOFTWARE."""),
    ("boost", f"""Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this
license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit
third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above
license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software,
unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. {_AS_IS[:-3]}TITLE AND
NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of
this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to
the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a
product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software. This notice may not be removed or altered from any source distribution."""),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this
software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("all-rights-reserved", "All rights reserved"),
]


def _grams(docs: DataFrame) -> DataFrame:
    """row and the hashes of all rolling grams of the text; `docs` has row and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, hashes, bounds in words(batch.column(1).cast(pa.binary()).to_pylist(), SIGNS, lower=True):
                grams = np.append(rolling(hashes, GRAM), np.zeros(min(len(hashes), GRAM - 1), np.uint64)).view(np.int64)
                end = np.maximum(bounds[1:] - GRAM + 1, bounds[:-1])
                inside = np.zeros(len(grams) + 1, np.int32)
                np.add.at(inside, bounds[:-1], 1)
                np.add.at(inside, end, -1)
                offsets = np.concatenate(([0], np.cumsum(end - bounds[:-1]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(grams[np.cumsum(inside)[:-1] > 0]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(lists)), lists], names=["row", "grams"])

    return docs.mapInArrow(run, "row long, grams array<long>")


def _holds_gram(templates: list[tuple[str, str]]):
    """Whether a text holds a gram of any template."""
    known = np.array(sorted({g for g, _, _ in template_positions(templates)}), np.int64)

    @F.pandas_udf("boolean")
    def holds(texts: pd.Series) -> pd.Series:
        out = np.zeros(len(texts), bool)
        for first, hashes, bounds in words([None if t is None else t.encode() for t in texts], SIGNS, lower=True):
            at = np.flatnonzero(np.isin(rolling(hashes, GRAM).view(np.int64), known))
            of = np.searchsorted(bounds, at, "right") - 1
            whole = at + GRAM <= bounds[of + 1]
            out[first + of[whole]] = True
        return pd.Series(out)

    return holds


def template_positions(templates: list[tuple[str, str]]) -> list[tuple[int, int, int]]:
    """(gram hash, template, position): at most one row per template word."""
    return [(int(g), t, q) for t, (_, text) in enumerate(templates) for q, g in enumerate(rolling(of_words(text, SIGNS), GRAM).view(np.int64))]


def candidate_spans(docs: DataFrame, templates: list[tuple[str, str]]) -> DataFrame:
    """Merged diagonals with enough votes: row, template, and the words of the text (first, behind the last) that the template then covers."""
    spark = docs.sparkSession
    positions = spark.createDataFrame(template_positions(templates), "gram long, template int, q int")
    lengths = [(t, len(of_words(x, SIGNS))) for t, (_, x) in enumerate(templates)]
    # widest spread of diagonals in one span, and votes for it
    sizes = spark.createDataFrame([(t, n, max(GAP, n // 4), max(1, int(VOTES * (n - GRAM + 1)))) for t, n in lengths], "template int, size int, spread int, enough int")
    hits = (
        _grams(docs)
        .select("row", F.posexplode("grams").alias("p", "gram"))
        .join(F.broadcast(positions), "gram")
        .select("row", "template", "p", "q")
        .distinct()  # rows alike in id and text vote once
    )
    voted = hits.groupBy("row", "template", (F.col("p") - F.col("q")).alias("diagonal")).agg(F.count(F.lit(1)).alias("votes"))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    new = (F.col("diagonal") - F.lag("diagonal").over(order) > GAP).cast("int")
    run = Window.partitionBy("row", "template", "run")
    chained = voted.withColumn("run", F.sum(F.coalesce(new, F.lit(1))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    chained = chained.withColumns({"low": F.min("diagonal").over(run), "high": F.max("diagonal").over(run)}).join(F.broadcast(sizes), "template")
    # stretch j of a wide chain holds the diagonals from low + j * spread to low + (j + 2) * spread
    j = F.floor((F.col("diagonal") - F.col("low")) / F.col("spread")).cast("int")
    wide = F.col("high") - F.col("low") > F.col("spread")
    stretches = chained.withColumn("stretch", F.explode(F.when(wide, F.array_distinct(F.array(F.greatest(j - 1, F.lit(0)), j))).otherwise(F.array(F.lit(0)))))
    merged = stretches.groupBy("row", "template", "run", "stretch").agg(
        F.sum("votes").alias("votes"), F.min("diagonal").alias("from"), F.max("diagonal").alias("to"), F.first("size").alias("size"), F.first("enough").alias("enough")
    )
    return merged.where("votes >= enough").select(
        "row", "template", F.greatest(F.col("from"), F.lit(0)).cast("long").alias("first"), (F.col("to") + F.col("size")).cast("long").alias("last")
    )


def words_of(text: str) -> list[bytes]:
    return re.findall(b"[^" + re.escape(SIGNS) + b"]+", text.encode().translate(LOWER))


def in_order(template: list[bytes], found: list[bytes]) -> int:
    """Words of the template that stand in `found` in order: the length of their longest common subsequence (a bit for each template word)."""
    places: dict[bytes, int] = {}
    for i, w in enumerate(template):
        places[w] = places.get(w, 0) | 1 << i
    whole = (1 << len(template)) - 1
    free = whole
    for w in found:
        if hit := places.get(w, 0) & free:
            free = ((free + hit) | (free - hit)) & whole
    return len(template) - free.bit_count()


def best_spans(spans: list[dict]) -> list[dict]:
    """The spans left when, from the one with most words in order on, each takes out those that overlap it and are covered no better."""
    widest = max((x["last"] - x["first"] for x in spans), default=0)
    kept: list[tuple[int, int, float, int]] = []
    for i, x in sorted(enumerate(spans), key=lambda x: (-x[1]["words"], -x[1]["cover"], x[1]["first"], x[1]["label"])):
        near = range(bisect.bisect_left(kept, (x["first"] - widest,)), bisect.bisect_left(kept, (x["last"],)))
        if not any(kept[k][1] > x["first"] and kept[k][2] >= x["cover"] for k in near):
            bisect.insort(kept, (x["first"], x["last"], x["cover"], i))
    return [spans[i] for *_, i in kept]


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, base: list[tuple[str, str]] = BASE) -> DataFrame:
    """Per row: n_words, base places and labels, all labels, score, and the verified spans."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("row"))
    spans = candidate_spans(rows.select("row", "text"), templates).groupBy("row").agg(F.collect_set(F.struct("template", "first", "last")).alias("spans"))
    spans = written(spans, "license-spans")
    small = checked_broadcast(spans, BROADCAST_ROWS)
    if small is spans:
        # too many to be broadcast: only texts that hold a template's gram are shuffled
        marked = rows.withColumn("some", _holds_gram(templates)(F.col("text")))
        joined = marked.where("some").join(spans, "row", "left").select("doc_id", "text", "spans")
        joined = joined.unionByName(marked.where("not some").select("doc_id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans")))
    else:
        joined = rows.join(small, "row", "left").select("doc_id", "text", "spans")
    split = [(label, words_of(x)) for label, x in templates]
    phrases = [(label, of_words(x, SIGNS)) for x, label in base]
    kind = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("words", pa.int64()), ("cover", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(2).to_pylist()
            for first, hashes, bounds, buf, start, end in words_at(batch.column(1).cast(pa.binary()).to_pylist(), SIGNS, lower=True):
                n = len(bounds) - 1
                text_of = np.repeat(np.arange(n), np.diff(bounds))
                places, labels_at = [], []
                for k, (_, phrase) in enumerate(phrases):
                    m = len(phrase)
                    if len(hashes) >= m:
                        same = text_of[: len(hashes) - m + 1] == text_of[m - 1 :]
                        for j in range(m):
                            same &= hashes[j : len(hashes) - m + 1 + j] == phrase[j]
                        at = np.flatnonzero(same)
                        places.append(at)
                        labels_at.append(np.full(len(at), k))
                at = np.concatenate(places) if places else np.zeros(0, np.int64)
                which = np.concatenate(labels_at) if places else np.zeros(0, np.int64)
                of = text_of[at] if len(at) else at
                low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                np.minimum.at(low, of, at - bounds[:-1][of])
                np.maximum.at(high, of, at - bounds[:-1][of])
                base_labels: list[set[str]] = [set() for _ in range(n)]
                for t, k in set(zip(of.tolist(), which.tolist(), strict=True)):
                    base_labels[t].add(phrases[k][0])
                score = [1.0 if x else 0.0 for x in base_labels]
                labels = [set(x) for x in base_labels]
                verified: list[list[dict]] = [[] for _ in range(n)]
                for t in range(n):
                    for span in found[first + t] or ():
                        label, template = split[span["template"]]
                        a, b = bounds[t] + span["first"], min(bounds[t] + span["last"], bounds[t + 1])
                        n_same = in_order(template, [buf[x:y] for x, y in zip(start[a:b], end[a:b], strict=True)])
                        if n_same >= COVER * len(template):
                            verified[t].append({"label": label, "first": span["first"], "last": int(b - bounds[t]), "words": n_same, "cover": n_same / len(template)})
                    verified[t] = best_spans(verified[t])
                    labels[t].update(x["label"] for x in verified[t])
                    score[t] = max([score[t], *(x["cover"] for x in verified[t])])
                none = high < 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, n), pa.array(np.diff(bounds).astype(np.int64)), pa.array(np.bincount(of, minlength=n).astype(np.int64)),
                        pa.array(low, mask=none), pa.array(high, mask=none), pa.array([",".join(sorted(x)) for x in base_labels], pa.string()),
                        pa.array([",".join(sorted(x)) for x in labels], pa.string()), pa.array(score, pa.float64()), pa.array(verified, pa.list_(kind)),
                    ],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
                )

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,last:long,words:long,cover:double>>"
    return joined.mapInArrow(run, schema)

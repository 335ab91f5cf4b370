"""License scans, in DataFrame functions only.

Overlapping text windows, of a size for each length class of templates, get MinHash signatures; one
equal band (of one row) retrieves a template, and exact containment of the template's word shingles
verifies it. With 64 bands, a window that holds a template to 0.8 is retrieved with a probability
above 0.9999 in every class: its Jaccard similarity to the template is 1/6 or more there.

Only windows with at least one shingle of some template are signed (the others' similarity is zero),
and only texts with a word pair of a hitting set of all template shingles are split into words (the
others hold no template shingle). Templates are sent to all workers, MOST_TEMPLATES at once; more are
scanned for in further passes. Nothing is shuffled but the retrieved candidates. A text is one row with
its words and shingles at once, so a very long one takes memory by its length.

Null and empty texts have no license; empty tables give no rows. Equal rows count as one document, as do
rows of one doc_id. Null ids stay null. Templates that tie are all reported. Other columns are ignored.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# License notices as commonly written.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]
# End of fixed values.
#: Templates that are sent to the workers at once.
MOST_TEMPLATES = 2000
BANDS = 64
_WORD = "[a-z0-9]+"


def _words(text: str) -> list[str]:
    return re.findall(_WORD, text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))


def _shingles(words: list[str], k: int) -> list[str]:
    return [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)] * bool(words)


def hitting_pairs(templates: list[tuple[str, str]], k: int) -> list[tuple[str, ...]]:
    """Pairs of neighbouring words of which every template shingle has one (its one word, where it has no more).

    Greedy: the pair of most letters, which is the rarest in most texts, then the one in most shingles.
    """
    left = {tuple(s.split()) for _, t in templates for s in _shingles(_words(t), k)}
    pairs = lambda s: {s[i : i + 2] for i in range(max(1, len(s) - 1))}
    chosen = []
    while left:
        count = Counter(p for s in left for p in pairs(s))
        best = max(count, key=lambda p: (min(sum(map(len, p)), 12), count[p], p))
        chosen.append(best)
        left = {s for s in left if best not in pairs(s)}
    return sorted(chosen)


def _branches(words: dict[str, str]) -> str:
    """A pattern of words, each with what follows it, that parts by first letters, so few branches are tried at a place."""
    by_letter: dict[str, dict[str, str]] = {}
    for word, rest in words.items():
        if word:
            by_letter.setdefault(word[0], {})[word[1:]] = rest
    parts = [letter + _branches(more) for letter, more in sorted(by_letter.items())] + ([words[""]] if "" in words else [])
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def hitting_pattern(templates: list[tuple[str, str]], k: int) -> str:
    """A pattern that every text with a template shingle matches."""
    by_first: dict[str, list[str]] = {}
    for first, *second in hitting_pairs(templates, k):
        by_first.setdefault(first, []).extend(second or [""])
    rest = {first: "" if "" in seconds else f"[^a-z0-9]+{_branches(dict.fromkeys(seconds, ''))}" for first, seconds in by_first.items()}
    return f"(?i)(?<![a-z0-9]){_branches(rest)}(?![a-z0-9])" if rest else "$^"


def window_class(words: int) -> int:
    """The length class of a template: 8, 16, 32, ... words."""
    return max(8, 1 << (words - 1).bit_length())


def _signature(shingles: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda seed: F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, seed))))


def _hashed(words: Column, k: int) -> Column:
    """Hashes of the word shingles of an array of words, in order."""
    n = F.size(words)
    shingle = lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(words, i + j) for j in range(k)]))  # noqa: E731  places beyond the end are null and left out
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), shingle))


def license_hits(docs: DataFrame, templates: list[tuple[str, str]] | None = None, k: int = 5, least: float = 0.8) -> DataFrame:
    """(doc_id, license, template_id, containment) of each document and template it contains to ``least`` or more.

    ``containment`` is the best window's share of the template's distinct shingles.
    """
    kinds = TEMPLATES if templates is None else templates
    kinds = [(i, name, text) for i, (name, text) in enumerate(kinds) if _words(text)]
    return reduce(DataFrame.unionByName, [_hits(docs, kinds[a : a + MOST_TEMPLATES], k, least) for a in range(0, max(1, len(kinds)), MOST_TEMPLATES)])


def templates_of(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """(license, text) of the files in a folder of whole license texts, named after their licenses, for ``license_hits(templates=TEMPLATES + ...)``.

    Any folder that Spark can read; its files are templates, so they go to all workers and pass the driver.
    """
    files = spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), "([^/]*)$", 1).alias("name"), "value")
    return sorted((unquote(r["name"]), r["value"]) for r in files.collect() if r["value"])


def _hits(docs: DataFrame, kinds: list[tuple[int, str, str]], k: int, least: float) -> DataFrame:
    spark = docs.sparkSession
    rows = [(i, name, _words(text), window_class(len(_words(text)))) for i, name, text in kinds]
    table = spark.createDataFrame(rows, "template_id int, license string, words array<string>, class int").withColumn("wanted", F.array_distinct(_hashed(F.col("words"), k)))
    bands = table.withColumn("all", _signature(F.col("wanted"))).select("template_id", "license", "class", "wanted", "all", F.posexplode("all").alias("band", "value"))
    known = table.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("wanted")))).alias("known"))

    folded = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    likely = docs.where(F.col("text").rlike(hitting_pattern([(name, text) for _, name, text in kinds], k))).select(F.col("doc_id").cast("long").alias("doc_id"), F.regexp_extract_all(folded, F.lit(_WORD), F.lit(0)).alias("words"))
    hashed = likely.where(F.size("words") > 0).select("doc_id", _hashed(F.col("words"), k).alias("shingles"))
    # The one row of known shingles goes to all workers: at most MOST_TEMPLATES templates. A text is met with them by one hash set (bound as an array of one, so once); then only its own hits are looked for.
    met = F.transform(F.array(F.array_intersect("shingles", "known")), lambda m: F.filter(F.transform("shingles", lambda s, i: F.when(F.array_contains(m, s), i)), lambda i: i.isNotNull()))[0]
    placed = hashed.join(F.broadcast(known), F.lit(True)).select("doc_id", "shingles", met.alias("places")).where(F.size("places") > 0)

    def windows(size: int) -> Column:
        step, length = size // 4, size + size // 4 - k + 1
        n = F.size("shingles")
        last = F.greatest(F.lit(0), F.ceil((n - length) / step).cast("int"))
        # windows j that hold a place p: j * step <= p < j * step + length
        near = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(F.least(last, F.greatest(F.lit(0), F.floor((p - length) / step).cast("int") + 1)), F.least(last, F.floor(p / step).cast("int"))))))
        return F.transform(near, lambda j: F.struct(F.lit(size).alias("class"), (j * step).alias("start"), F.array_distinct(F.transform(F.sequence(j * step, F.least(j * step + length, n) - 1), lambda x: F.get("shingles", x))).alias("held")))

    classes = sorted({r[3] for r in rows}) or [8]
    cut = placed.select("doc_id", F.inline(reduce(F.concat, [windows(c) for c in classes])))
    signed = cut.withColumn("own", _signature(F.col("held"))).select("doc_id", "class", "start", "held", "own", F.posexplode("own").alias("band", "value"))
    # A window and template may agree in many bands: the first one stands for all, so each pair is verified once.
    candidates = signed.join(F.broadcast(bands), ["class", "band", "value"]).where(F.array_position(F.zip_with("own", "all", lambda x, y: x == y), True) == F.col("band") + 1)
    found = candidates.select("doc_id", "license", "template_id", (F.size(F.array_intersect("held", "wanted")) / F.size("wanted")).alias("containment"))
    return found.where(F.col("containment") >= least).groupBy("doc_id", "license", "template_id").agg(F.max("containment").alias("containment"))

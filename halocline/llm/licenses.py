"""License scans: Dice coefficient over word bigrams against licence templates. DataFrame functions only."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

THRESHOLD = 0.8
#: ASCII other than letters and digits; the same without the end of a line.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NO_WORD_OR_END = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"

# The wording of licence notices and of whole licences (-text), as their stewards publish them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-2-Clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-3-Clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-4.0-short": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-SA-4.0-short": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "ISC-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MIT-short": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "all-rights-reserved": "All rights reserved.",
}


def normalised_words(text: str) -> list[str]:
    return re.sub(NO_WORD, " ", re.sub("[A-Z]", lambda m: m[0].lower(), text)).strip(" ").split(" ")


def template_bigrams(templates: dict[str, str] | None = None) -> dict[str, list[str]]:
    found = {}
    for name, text in sorted((TEMPLATES if templates is None else templates).items()):
        w = normalised_words(text)
        found[name] = sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})
    return found


def _spaced(col: Column, other: str) -> Column:
    """Lower-cased text with runs of the given characters as one space each."""
    return F.regexp_replace(ascii_lower(col), other, " ")


def _bigrams(words: Column) -> Column:
    return F.array_distinct(F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b)))


def _named(**fields: Column) -> Column:
    """A struct; aliases would get lost within nested lambdas."""
    return F.named_struct(*[x for k, v in fields.items() for x in (F.lit(k), v)])


def _bound(value: Column, use) -> Column:
    """use(value), where the value is worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, line, last_line, license_id, dice): where a template is found, as lines from 1; line 0 stands for the whole text.

    Text and templates are normalised alike (A-Z lower-cased, ASCII other than letters and digits to a space) and
    compared as sets of word bigrams: 2 |A and B| / (|A| + |B|). Compared are
    * each line, and each text of several lines as a whole: the best template that reaches the threshold t, ties to the first name;
    * wrapped notices: as many words as a template has, from the start of each line that is shorter. Findings are taken by
      coefficient; such a span stays if it overlaps none that stayed before. Ties go to single lines, then to the first line and name.
    A template whose size is out of [t/(2-t), (2-t)/t] times the other's can't reach t, and is not compared; nor is one of which the
    whole text lacks so many bigrams that t is out of reach. That settles nearly all texts with one intersection, and what
    is left is judged in its row: nothing is shuffled. The templates are a fixed, small table held in the plan.

    Null and empty texts, and texts of one word, have no bigrams and no finding; templates of one word are never found,
    and no templates give no rows. Long texts are scanned whole, in a few times their own size. Repeated rows are found each. An
    empty table gives no rows. Other columns are not read, whatever their names.
    """
    t = threshold
    grams = {k: v for k, v in template_bigrams(templates).items() if v}
    n_words = {k: len(normalised_words(v)) for k, v in (TEMPLATES if templates is None else templates).items()}
    need = {k: max(1, math.ceil(len(v) * t / (2 - t) - 1e-6)) for k, v in grams.items()}
    schema = "doc_id: bigint, line: int, last_line: int, license_id: string, dice: double"
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text")
    if not grams:
        return rows.where("false").select(*[F.lit(None).cast(c.split(": ")[1]).alias(c.split(": ")[0]) for c in schema.split(", ")])
    table = F.array(*[F.struct(F.lit(k).alias("id"), F.array(*map(F.lit, v)).alias("grams"), F.lit(len(v)).alias("n"), F.lit(n_words[k]).alias("words"), F.lit(need[k]).alias("need")) for k, v in grams.items()])
    every = F.array(*map(F.lit, sorted(set().union(*grams.values()))))
    # generators keep what they work out from being worked out again wherever it is used
    once = lambda column, name: F.explode(F.array(column)).alias(name)
    words = rows.select("doc_id", "text", once(F.split(F.trim(_spaced(F.col("text"), NO_WORD)), " "), "w")).where(F.size("w") > 1)
    held = words.select("doc_id", "text", once(F.array_intersect(_bigrams(F.col("w")), every), "held")).where(F.size("held") >= min(need.values()))
    near = held.select("doc_id", "text", once(F.filter(table, lambda x: F.size(F.array_intersect("held", x["grams"])) >= x["need"]), "near")).where(F.size("near") > 0)

    # words and line ends of the few texts that are left
    marked = F.filter(F.split(F.regexp_replace(_spaced(F.col("text"), NO_WORD_OR_END), "\n", " \n "), " "), lambda x: x != "")
    tokens = near.select("doc_id", "near", once(marked, "tokens"))
    ends = F.filter(F.transform("tokens", lambda x, i: F.when(x == "\n", i)), lambda i: i.isNotNull())
    placed = tokens.select("doc_id", "near", once(F.filter("tokens", lambda x: x != "\n"), "w"), once(F.transform(ends, lambda p, i: p - i), "ends"))
    lines = F.zip_with(F.concat(F.array(F.lit(0)), "ends"), F.concat("ends", F.array(F.size("w"))), lambda a, b: F.struct(a.alias("begin"), b.alias("end")))
    lined = placed.select("doc_id", "near", "w", once(lines, "lines"))

    def scored(begin: Column, end: Column, line: Column, wrapped: bool, near: Column) -> Column:
        """The best of the templates for the words from begin to end, as a struct, or null."""

        def best(a: Column) -> Column:
            # a hair wider, so that rounding prunes no template that reaches t exactly
            low, high = F.size(a) * (t / (2 - t)) - 1e-6, F.size(a) * ((2 - t) / t) + 1e-6
            dice = lambda x: F.lit(-2.0) * F.size(F.array_intersect(a, x["grams"])) / (F.size(a) + x["n"])
            return F.array_min(F.transform(F.filter(near, lambda x: (x["n"] >= low) & (x["n"] <= high)), lambda x: _named(minus=dice(x), wrapped=F.lit(wrapped), line=line.cast("int"), id=x["id"], begin=begin.cast("int"), end=end.cast("int"))))

        return F.when(end - begin > 1, _bound(_bigrams(F.slice("w", begin + 1, end - begin)), best))

    least = F.array_min(F.transform("near", lambda x: x["n"])) * (t / (2 - t)) - 1e-6
    single = F.transform("lines", lambda x, i: F.when(x["end"] - x["begin"] > least, scored(x["begin"], x["end"], i + 1, False, F.col("near"))))
    whole = F.array(F.when(F.size("lines") > 1, scored(F.lit(0), F.size("w"), F.lit(0), False, F.col("near"))))

    def spans(x: Column, i: Column) -> Column:
        longer = F.filter("near", lambda y: (x["end"] > x["begin"]) & (x["end"] - x["begin"] < y["words"]) & (x["end"] < F.size("w")))
        return F.transform(longer, lambda y: scored(x["begin"], F.least(F.size("w"), x["begin"] + y["words"]), i + 1, True, F.array(y)))

    reach = lambda c: F.filter(c, lambda x: x["minus"] <= -t)
    found = lined.select("doc_id", "lines", once(reach(F.concat(single, F.flatten(F.transform("lines", spans)))), "found"), once(reach(whole), "whole"))
    # structs compare by coefficient, then single lines first, then line and name: the best come first, and give way to nothing
    meets = lambda y, x: (y["begin"] < x["end"]) & (x["begin"] < y["end"])
    none = F.filter("found", lambda x: F.lit(False))
    kept = F.aggregate(F.array_sort("found"), none, lambda so_far, x: F.when(~x["wrapped"] | ~F.exists(so_far, lambda y: meets(y, x)), F.concat(so_far, F.array(x))).otherwise(so_far))
    last = lambda x: F.when(x["line"] == 0, F.size("lines")).when(x["wrapped"], F.size(F.filter("lines", lambda l: l["begin"] < x["end"]) )).otherwise(x["line"])
    out = F.transform(F.concat("whole", kept), lambda x: _named(line=x["line"], last_line=last(x).cast("int"), license_id=x["id"], dice=-x["minus"]))
    return found.select("doc_id", F.inline(out))

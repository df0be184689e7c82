"""License scans by conditional compression.

A native filter picks the lines of a text that speak of licences, rights or permission; each starts a candidate block. A
block is as long as the longest template may be with all its permitted differences, blank lines included, so no notice
ends beyond it. Blocks start also on the lines above a trigger, as far as a template that begins there could reach it,
if words of a template begin there; they count if they are confirmed and reach the trigger. Text of the same lines before
and after a confirmed notice is scanned for others. Every block is compressed by zstandard alone and with each template as
a raw dictionary; the relative reduction in size ranks the templates. In that order they are confirmed word by word: the
template's words have to stand in the block in order, up to `max_differences` of them. Only templates of which too few
words stand in the block at all are left out. The differing words are returned, so an exact notice is told from an altered
one, and blocks that no template explains are reported as unknown.

Null and empty texts have no blocks. Templates are a small fixed set, held in the code or given by the caller, of any
length; repeated rows and extra columns pass through, a column named findings is replaced. Ties go to the template whose
words agree best, then to the smaller id.
"""

from __future__ import annotations

import difflib
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryloom.sources.tables import table

TRIGGER = r"(?i)licen[sc]|copyright|rights reserved|permission is hereby|redistribution and use|public domain|warrant"
_TRIGGER = re.compile(TRIGGER)
MAX_DIFFERENCES = 0.1
_WORD = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*")
#: Wordings of common notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-3.0-header": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:""",
    "MIT-full": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>""",
    "Unlicense-notice": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "proprietary": "All rights reserved.",
}
_FINDINGS = "array<struct<line:long,license:string,reduction:double,exact:boolean,missing:array<string>,extra:array<string>>>"


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


class Scanner:
    def __init__(self, templates: dict[str, str]):
        import zstandard

        self.templates = {k: words(v) for k, v in sorted(templates.items())}
        self.plain = zstandard.ZstdCompressor(level=3)
        made = {k: zstandard.ZstdCompressionDict(v.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT) for k, v in sorted(templates.items())}
        self.given = {k: zstandard.ZstdCompressor(level=3, dict_data=d) for k, d in made.items()}
        self.bags = {k: Counter(v) for k, v in self.templates.items()}
        #: No notice has more words than this.
        self.reach = int(max(map(len, self.templates.values())) * (1 + MAX_DIFFERENCES)) + 1

    def block(self, lines: list[str]) -> str:
        """As many lines as a notice that begins in the first of them may fill."""
        taken, size, room = [], 0, self.reach
        for line in lines:
            if size > room:
                break
            taken.append(line)
            n = len(words(line))
            size += n
            if len(taken) == 1:
                room += n
        return "\n".join(taken)

    def begun(self, line: str) -> list[str]:
        """Templates of which two neighbouring words, or the first word at its end, stand in a line."""
        own = words(line)
        pairs = set(zip(own, own[1:], strict=False))
        return [k for k, t in self.templates.items() if own and (own[-1] == t[0] or not pairs.isdisjoint(zip(t, t[1:], strict=False)))]

    def within(self, text: str, line: int) -> list[dict]:
        """Confirmed notices in a part of a line, in order."""
        found, parts = [], [(0, text)]
        while parts:
            at, part = parts.pop()
            if not _TRIGGER.search(part):
                continue
            one, _, low, high, rank = self.scan(part)
            if rank is not None:
                found.append((at + low, {"line": line, **one}))
                parts += [(at, part[:low]), (at + high, part[high:])]
        return [f for _, f in sorted(found, key=lambda x: x[0])]

    def notices(self, lines: list[str], k: int, explained: int) -> tuple[list[dict], int]:
        """Findings for the trigger line k, and the first line after those that they explain."""
        starts, size, s = [], 0, k - 1
        while s >= explained and s >= 0 and size <= self.reach:
            if lines[s].strip():
                starts.append(s)
                size += len(words(lines[s]))
            s -= 1
        best = unknown = None
        for s in [k, *starts]:
            only = None if s == k else self.begun(lines[s])
            if only == []:
                continue
            block = self.block(lines[s:])
            one, n, low, high, rank = self.scan(block, only)
            if rank is None:
                unknown = unknown or one
            elif s + n > k and (best is None or rank > best[0]):
                best = (rank, s, block, one, n, low, high)
        if best is None:
            return [{"line": k, **unknown}], k + 1
        _, s, block, one, n, low, high = best
        found = [*self.within(block[:low], s), {"line": s, **one}]
        at = s + n - 1
        while _TRIGGER.search(rest := block[high:].split("\n", 1)[0]):
            block = self.block([rest, *lines[at + 1 :]])
            one, n, low, high, rank = self.scan(block)
            if rank is None:
                break
            found += [*self.within(block[:low], at), {"line": at, **one}]
            at += n - 1
        return found, at + 1

    def scan(self, block: str, only: list[str] | None = None) -> tuple[dict, int, int, int, tuple | None]:
        """The finding for a block, how many of its lines it explains, the place of its words and its rank; none if unknown."""
        first = block.split("\n", 1)[0]
        ranked = []
        for k, template in self.templates.items():
            if only is not None and k not in only:
                continue
            # A block is measured over as much of it as the template could fill.
            part = block[: max(len(first), 2 * (sum(map(len, template)) + len(template)))].encode()
            plain, given = len(self.plain.compress(part)), len(self.given[k].compress(part))
            ranked.append((1 - given / plain, k))
        best, own = None, words(block)
        bag = Counter(own)
        for reduction, k in sorted(ranked, key=lambda x: (-x[0], x[1])):
            template = self.templates[k]
            # Words that the block lacks are missing whatever the order; too many of them settle it.
            if sum((self.bags[k] - bag).values()) > MAX_DIFFERENCES * len(template):
                continue
            match = difflib.SequenceMatcher(None, template, own[: 2 * len(template) + len(words(first))], autojunk=False)
            same = [b for b in match.get_matching_blocks() if b.size]
            if not same:
                continue
            agreed = sum(b.size for b in same)
            hit = set()
            for b in same:
                hit.update(range(b.a, b.a + b.size))
            low, high = same[0].b, same[-1].b + same[-1].size
            if low >= len(words(first)):
                continue  # it begins on a later line, which starts a block of its own
            inside = {j for b in same for j in range(b.b, b.b + b.size)}
            missing = [w for i, w in enumerate(template) if i not in hit]
            extra = [own[j] for j in range(low, high) if j not in inside]
            if len(missing) + len(extra) > max(MAX_DIFFERENCES * len(template), 0):
                continue
            rank = (agreed, -len(missing) - len(extra), reduction)
            if best is None or rank > best[0]:
                best = (rank, {"license": k, "reduction": round(reduction, 6), "exact": not missing and not extra, "missing": missing, "extra": extra}, low, high)
        if best is None:
            top = max(ranked, key=lambda x: (x[0], x[1]))
            return {"license": None, "reduction": round(top[0], 6), "exact": False, "missing": [], "extra": []}, 1, 0, 0, None
        places = [m.span() for m in _WORD.finditer(block)]
        low, high = places[best[2]][0], places[best[3] - 1][1]
        return best[1], block.count("\n", 0, high) + 1, low, high, best[0]


def scan(docs: DataFrame, *, text: str = "text", templates: dict[str, str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Adds findings: line, license (null if unknown), reduction, exact, missing and extra words of every block."""
    templates = templates or TEMPLATES
    names = [c for c in (docs.columns if keep is None else keep) if c != "findings"]
    fields = {c: f"_c{i}" for i, c in enumerate(names)}
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    hits = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(TRIGGER), i)), lambda i: i.isNotNull())
    base = docs.select(F.when(F.col(text).rlike(TRIGGER), F.struct(lines.alias("lines"), hits.alias("at"))).alias("candidates"), *(F.col(c).alias(n) for c, n in fields.items()))
    kind = T.StructType.fromDDL(f"findings {_FINDINGS}")
    arrow = pa.list_(pa.struct([("line", pa.int64()), ("license", pa.string()), ("reduction", pa.float64()), ("exact", pa.bool_()), ("missing", pa.list_(pa.string())), ("extra", pa.list_(pa.string()))]))

    def run(batches):
        scanner = Scanner(templates)
        for b in batches:
            out = []
            for c in b.column("candidates").to_pylist():
                found, explained = [], 0
                for k in c["at"] if c else ():
                    if k < explained:
                        continue
                    more, explained = scanner.notices(c["lines"], k, explained)
                    found += more
                out.append(found)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in fields.values()), pa.array(out, arrow)], [*fields.values(), "findings"])

    schema = T.StructType([T.StructField(n, docs.schema[c].dataType) for c, n in fields.items()] + kind.fields)
    return base.mapInArrow(run, schema).select(*(F.col(n).alias(c) for c, n in fields.items()), "findings")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document: how many candidate blocks, confirmed and exact ones, and their names."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = F.filter("findings", lambda f: f["license"].isNotNull())
    return scan(docs, keep=["doc_id"]).select(
        "doc_id", F.size("findings").cast("long").alias("n_blocks"), F.size(found).cast("long").alias("n_licenses"), F.size(F.filter("findings", lambda f: f["exact"])).cast("long").alias("n_exact"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda f: f["license"]))), ",").alias("licenses"),
    )

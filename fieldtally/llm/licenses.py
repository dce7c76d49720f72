"""License scans by conditional compression.

A block of text that repeats the wording of a template costs next to nothing
when it is compressed with the template as dictionary. Candidate blocks are
compressed with every template, templates are ranked by the bytes they save,
and confirmed or refused by their wording differences, going down the ranks until one fits.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import combinations, pairwise

import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtally.llm.tables import map_texts, table

# Wording of common notices. <...> stands for words that differ from project to project.
TEMPLATES = {
    "AGPL-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more
details.""",
    "Apache-1.1": "The Apache Software License, Version 1.1",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list
of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "BSD-3-Clause": """Neither the name of <holder> nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.""",
    "BSD-4-Clause": """All advertising materials mentioning features or use of this software must display the following
acknowledgement: This product includes software developed by <holder>.""",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-ND-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": """To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to
this software to the public domain worldwide. This software is distributed without any warranty.""",
    "EPL-2.0": """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/""",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-notice": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "LGPL-2.1-notice": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser
General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any
later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more
details.""",
    "LGPL-3.0-notice": """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more
details.""",
    "MIT": "Released under the MIT License.",
    "MIT-notice": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom
the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
shall be included in all copies or substantial portions of the Software.""",
    "MPL-1.1": """The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this
file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions""",
    "reserved": "All rights reserved.",
}
# Identifiers that a line "SPDX-License-Identifier: ..." names.
SPDX = [
    "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0",
    "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only",
    "LGPL-3.0-or-later", "MIT", "MPL-1.1", "MPL-2.0", "Unlicense", "Zlib",
]
TEMPLATES |= {f"SPDX:{name}": f"SPDX-License-Identifier: {name}" for name in SPDX}
# Words that make another license of the same wording. They and numbers may not differ at all.
TELLING = frozenset(
    """affero derivatives general lesser library nc nd nocommercial noderivatives noderivs noncommercial only sa sharealike
    commercial advertising endorse public later""".split()
)

# A line can be part of a candidate block if it has one of these stems, or the longest word of a template that has none of them ...
STEMS = re.compile(r"licen[cs]|copyright|warrant|permi(?:ssion|tted)|redistribut|public domain|rights reserved|endorse|spdx", re.IGNORECASE)
# ... or this share of words that templates have, next to a line that is part.
SHARE = 0.6
# A template is a candidate for a block if it saves this share of the bytes of its own wording; the best few are confirmed, and if none
# of them fits, the others down to the first that does.
MIN_SAVED, RANKED = 0.35, 4
# Wording differences allowed: this share of a template's words, counted as words missing and words put in.
MAX_DIFFERENT = 0.1
LEVEL = 3
# Longer blocks are read in overlapping parts of this many words.
PART_WORDS = 600

# Templates that differ in no more different words than this are told apart by each of them.
MAX_APART = 12
_NUMBER = re.compile(r"v?[0-9]+(?:\.[0-9]+)*")
# A small whole number may number a clause, unless it follows a word that versions follow.
_MARKER = re.compile(r"[0-9]{1,2}")
_VERSIONED = frozenset("version v license licence gpl lgpl agpl mpl epl apache cc by sa nc nd bsd international unported".split())
_FOLLOWING = frozenset("only clause clear with".split())
_WORD = re.compile(r"[^\W_]+(?:[.][0-9]+)*|<[a-z]+>")


def worded(text: str) -> list[tuple[str, int, int]]:
    """Lower-cased words of a text with their places, marks left out."""
    return [(m[0].lower(), *m.span()) for m in _WORD.finditer(text)]


class Templates:
    """Templates ready to compress with."""

    def __init__(self, templates: dict[str, str] = TEMPLATES):
        self.words = {name: [w for w, _, _ in worded(text)] for name, text in templates.items()}
        self.known = {w for words in self.words.values() for w in words}
        # Every template must be able to make a block.
        bare = [max((w for w in self.words[name] if not w.startswith("<")), key=lambda w: (len(w), w), default="") for name, text in templates.items() if not STEMS.search(text)]
        self.stems = re.compile("|".join([STEMS.pattern, *(rf"\b{re.escape(w)}\b" for w in sorted(set(bare)) if w)]), re.IGNORECASE)
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False)
        self.given = {}
        self.worth = {}
        for name, words in self.words.items():
            raw = " ".join(words).encode()
            # A dictionary needs eight bytes at least.
            content = zstandard.ZstdCompressionDict(raw.rjust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.given[name] = zstandard.ZstdCompressor(
                level=LEVEL, dict_data=content, write_checksum=False, write_content_size=False, write_dict_id=False
            )
            # What the template saves on its own wording.
            self.worth[name] = max(1, len(self.plain.compress(raw)) - len(self.given[name].compress(raw)))
        self.telling = self._telling()
        # Words that the longest place of a template can take, so that parts of a block overlap by a whole one.
        self.longest = max((int((1 + MAX_DIFFERENT) * len(w)) + 4 * sum(x.startswith("<") for x in w) for w in self.words.values()), default=0)

    def _telling(self) -> dict[str, set[str]]:
        """Words that may not differ, by template: numbers, TELLING, and those by which two alike templates differ."""
        told = {name: {w for w in words if _NUMBER.fullmatch(w)} | TELLING for name, words in self.words.items()}
        for a, b in combinations(self.words, 2):
            one, two = self.words[a], self.words[b]
            if 2 * len(set(one) & set(two)) < len(set(one) | set(two)):
                continue
            apart = Counter(one)
            apart.subtract(Counter(two))
            apart = {w for w, n in apart.items() if n and not w.startswith("<")}
            if len(apart) <= MAX_APART:
                told[a] |= apart
                told[b] |= apart
        return told

    def _tells_apart(self, name: str, words: list[str], first: int, last: int) -> bool:
        """Whether what differs between a template and a place has a word that may not."""
        wanted, told = self.words[name], self.telling[name]
        place = words[first : last + 1]
        # Words next to the place belong to it where the template's own end is missing.
        for tag, a1, a2, b1, b2 in SequenceMatcher(None, place, wanted, autojunk=False).get_opcodes():
            if tag == "equal":
                continue
            if any(w in told for w in wanted[b1:b2]) or any(w in told for w in place[a1:a2]):
                return True
            open_place = any(w.startswith("<") for w in wanted[b1:b2])
            for i in range(a1, a2):
                if _NUMBER.fullmatch(place[i]) and not open_place and not (_MARKER.fullmatch(place[i]) and (i == 0 or place[i - 1] not in _VERSIONED)):
                    return True
        # An identifier that goes on is another one.
        after = words[last + 1 : last + 3]
        return name.startswith("SPDX:") and bool(after) and (after[0] in _FOLLOWING or after == ["or", "later"] or _NUMBER.fullmatch(after[0]) is not None)

    def ranked(self, words: list[str]) -> list[tuple[str, float]]:
        """Templates by the bytes they save on a block, as a share of what they save on themselves; ties by name."""
        raw = " ".join(words).encode()
        alone = len(self.plain.compress(raw))
        saved = [(name, (alone - len(with_it.compress(raw))) / self.worth[name]) for name, with_it in self.given.items()]
        return sorted((s for s in saved if s[1] >= MIN_SAVED), key=lambda s: (-s[1], s[0]))

    def difference(self, name: str, words: list[str]) -> tuple[int, int, int] | None:
        """(first word, last word, words different) of a template in a block, or None if too much differs."""
        wanted = self.words[name]
        allowed = MAX_DIFFERENT * len(wanted)
        open_words = sum(w.startswith("<") for w in wanted)
        # So many words of a place that fits follow one another at least.
        least = (len(wanted) - open_words - allowed) / (allowed + open_words + 1)
        parts = [(0, len(words))]
        while parts:
            low, high = parts.pop()
            blocks = SequenceMatcher(None, words[low:high], wanted, autojunk=False).get_matching_blocks()[:-1]
            # Words that match far from the rest belong to something else: keep the runs nearest the longest one.
            center = max(blocks, key=lambda b: b.size, default=None)
            if center is None or center.size < least:
                continue
            near = [b for b in blocks if abs((b.a - center.a) - (b.b - center.b)) <= allowed + 3]
            first, last = low + near[0].a, low + near[-1].a + near[-1].size - 1
            matched = sum(b.size for b in near)
            missing = len(wanted) - matched - open_words
            extra = last - first + 1 - matched - 4 * open_words
            different = max(0, missing) + max(0, extra)
            if different <= allowed and not self._tells_apart(name, words, first, last):
                return first, last, different
            # A copy that differs too much may hide another one on either side.
            parts += [(low + center.a + center.size, high), (low, low + center.a)]
        return None

    def blocks(self, text: str) -> Iterator[list[tuple[str, int, int]]]:
        """Candidate blocks: lines with a stem and lines of license wording next to them, as words with places.

        Lines without words (empty ones, or only comment marks) stand between paragraphs of a notice and part nothing.
        """
        lines, at = [], 0
        for line in text.split("\n"):
            if _WORD.search(line):
                lines.append((at, at + len(line), bool(self.stems.search(line))))
            at += len(line) + 1
        part = [stem for _, _, stem in lines]

        def like(i: int) -> bool:
            a, b, _ = lines[i]
            words = worded(text[a:b])
            return sum(w in self.known for w, _, _ in words) >= SHARE * len(words)

        for order in (range(len(lines)), range(len(lines) - 1, -1, -1)):
            before = False
            for i in order:
                part[i] = part[i] or (before and like(i))
                before = part[i]
        i = 0
        while i < len(lines):
            if not part[i]:
                i += 1
                continue
            j = i
            while j + 1 < len(lines) and part[j + 1]:
                j += 1
            start = lines[i][0]
            words = [(w, a + start, b + start) for w, a, b in worded(text[start : lines[j][1]])]
            size = max(PART_WORDS, 2 * self.longest)
            step = size - self.longest
            for k in range(0, max(1, len(words) - size + step), step):
                yield words[k : k + size]
            i = j + 1

    def found(self, text: str | None) -> tuple[int, list[tuple[str, int, int, int]]]:
        """Number of candidate blocks, and (template, start, end, words different) in them, each place with its best template."""
        if not text or not self.stems.search(text):
            return 0, []
        n, out = 0, []
        for block in self.blocks(text):
            n += 1
            rest = [block]
            while rest:
                words = rest.pop()
                plain = [w for w, _, _ in words]
                hits = []
                for i, (name, saved) in enumerate(self.ranked(plain)):
                    # The best few are compared; behind them the first that fits is taken.
                    if i >= RANKED and hits:
                        break
                    if hit := self.difference(name, plain):
                        first, last, different = hit
                        hits.append((last - first - different, saved, name, first, last, different))
                if hits:
                    _, _, name, first, last, different = max(hits, key=lambda h: (h[0], h[1], h[2]))
                    out.append((last - first - different, name, words[first][1], words[last][2], different))
                    # Other notices may stand before or behind this one.
                    rest += [r for r in (words[:first], words[last + 1 :]) if r]
                else:
                    # What a short notice saves is lost among many paragraphs.
                    cuts = [k for k in range(1, len(words)) if text.count("\n", words[k - 1][2], words[k][1]) > 1]
                    rest += [words[a:b] for a, b in pairwise([0, *cuts, len(words)])] if cuts else []
        # Overlapping parts can show a place twice, once cut off.
        kept: list = []
        for hit in sorted(set(out), key=lambda h: (-h[0], h[2], h[1])):
            at = bisect(kept, hit[2], key=lambda s: s[1])
            if (at == 0 or kept[at - 1][2] <= hit[2]) and (at == len(kept) or kept[at][1] >= hit[3]):
                kept.insert(at, hit[1:])
        return n, kept


_FOUND = T.StructType(
    [
        T.StructField("license", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("different", T.IntegerType()),
    ]
)


def scan(
    docs: DataFrame, text: str = "text", keep: list[str] | None = None, templates: dict[str, str] | None = None
) -> DataFrame:
    """Columns ``keep`` (all) with n_blocks and licenses: template, place in code points and number of words that differ.

    Null and empty texts have no blocks. Of templates that fit the same place
    the one with more words in common wins, then the one that saves more, then
    the later name. Version numbers, the words of TELLING and those by which
    two templates alike differ may not differ at all. Long blocks are read in
    overlapping parts, so nothing is left unread, however long a text is. No
    row meets another, so copies and order do not matter, and an empty table
    gives no rows. Columns called n_blocks or licenses are replaced, others may
    have any name.
    """
    given = TEMPLATES if templates is None else templates

    def begin():
        ready = Templates(given)

        def work(texts: list, _) -> dict:
            rows = [ready.found(t) for t in texts]
            return {"n_blocks": [r[0] for r in rows], "licenses": [r[1] for r in rows]}

        return work

    added = T.StructType([T.StructField("n_blocks", T.LongType()), T.StructField("licenses", T.ArrayType(_FOUND))])
    return map_texts(docs, text, begin, added, docs.columns if keep is None else keep)


def op1_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """License wording in every document."""
    found = scan(table(spark, folder, "documents").select("doc_id", "text"), keep=["doc_id"])
    one = F.transform(
        "licenses",
        lambda s: F.concat_ws(":", s["license"], s["start"].cast("string"), s["end"].cast("string"), s["different"].cast("string")),
    )
    return found.select(
        "doc_id",
        "n_blocks",
        F.size("licenses").cast("long").alias("n_licenses"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("licenses", lambda s: s["license"]))), ",").alias("licenses"),
        F.array_join(one, ",").alias("spans"),
    )

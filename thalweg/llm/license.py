"""License scan with a positional index: a file's rarest licence words name the places where a template may begin."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from thalweg.llm.common import alnum_words, map_arrow, text_rows

#: Fixed values of the contract: phrase and label.
BASE_PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: Short public notices: label, template, phrases of which all must stand in the file.
TEMPLATES = (
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2", ("gnu general public license version 2",)),
    ("lgpl", "this library is free software under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("mit", "released under the mit license permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", ("permission is hereby granted free of charge", "without restriction")),
    ("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license", ("apache license version 2",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial license cc by nc 4 0", ("cc by nc",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    ("all-rights-reserved", "all rights reserved", ("all rights reserved",)),
)


#: Standard notices and whole texts of common licences, as they are published: label, text, phrases of which all must
#: stand in the file.
_AS_IS = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GNU_END = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the"


def _gnu(name: str, version: str) -> str:
    return f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. {_GNU_END} GNU {name} for more details."


WHOLE_TEXTS = (
    ("mit", f"Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}", ("permission is hereby granted free of charge", "to deal in the software without restriction")),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.", ("with or without fee is hereby granted",)),
    ("bsd-2", f"{_BSD_START} {_BSD_END}", ("redistributions of source code must retain the above copyright notice",)),
    ("bsd-3", f"{_BSD_START} {_BSD_THIRD} {_BSD_END}", ("redistributions of source code must retain the above copyright notice", "may be used to endorse or promote products")),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", ("apache license version 2",)),
    ("gpl-2", _gnu("General Public License", "2"), ("gnu general public license", "either version 2 of the license")),
    ("gpl-3", _gnu("General Public License", "3"), ("gnu general public license", "either version 3 of the license")),
    ("lgpl", _gnu("Lesser General Public License", "3"), ("gnu lesser general public license",)),
    ("agpl-3", _gnu("Affero General Public License", "3"), ("gnu affero general public license",)),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", ("mozilla public license",)),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.", ("the origin of this software must not be misrepresented",)),
    ("boost", f"Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.", ("any person or organization obtaining a copy",)),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", ("free and unencumbered software",)),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", ("waived all copyright and related or neighboring rights",)),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ("creative commons attribution sharealike",)),
)


class Index:
    """word -> places in the templates, with each word's inverse template frequency.

    A template place counts at a begin ``b`` if its word stands within ``slack``
    words of ``b`` + place, so a few words put in or left out do no harm.
    """

    def __init__(self, templates=TEMPLATES + WHOLE_TEXTS, slack: int = 6):
        self.templates = [(label, alnum_words(t), [alnum_words(p) for p in must]) for label, t, must in templates]
        self.slack = slack
        seen = Counter(w for _, t, _ in self.templates for w in set(t))
        n = len(self.templates)
        self.idf = {w: math.log((n + 1) / (k + 0.5)) for w, k in seen.items()}
        self.postings: list[dict[bytes, list[int]]] = []
        for _, t, _ in self.templates:
            at: dict[bytes, list[int]] = {}
            for place, w in enumerate(t):
                at.setdefault(w, []).append(place)
            self.postings.append(at)
        self.weight = [sum(self.idf[w] for w in t) for _, t, _ in self.templates]
        self.needs = [{w for p in must for w in p} for _, _, must in self.templates]

    def rarest(self, k: int, present: set[bytes], share: float) -> list[bytes]:
        """The file's highest-IDF words of a template, as many as any match needs one of: the others weigh too little."""
        words = sorted(present & self.postings[k].keys(), key=lambda w: (-self.idf[w], w))
        left, out = sum(self.idf[w] * len(self.postings[k][w]) for w in words), []
        for w in words:
            if left < share * self.weight[k]:
                break
            out.append(w)
            left -= self.idf[w] * len(self.postings[k][w])
        return out if left < share * self.weight[k] else []

    def best(self, k: int, words: list[bytes], share: float) -> float:
        """The largest share of the template's weight that stands at its places, over all begins; 0 below ``share``.

        The places of the file's rarest licence words name the begins; only
        there the postings of the template's other words are intersected.
        """
        at, slack = self.postings[k], self.slack
        rare = self.rarest(k, set(words), share)
        if not rare:
            return 0.0
        found: dict[bytes, list[int]] = {w: [] for w in at}
        for place, w in enumerate(words):
            if w in found:
                found[w].append(place)
        begins = np.concatenate([np.array(found[w], np.int64)[:, None] - np.array(at[w], np.int64) for w in rare], axis=None)
        shift = len(self.templates[k][1]) + slack
        size = len(words) + 2 * shift + 2
        named = np.zeros(size, np.int64)
        np.add.at(named, begins - slack + shift, 1)
        np.add.at(named, begins + slack + 1 + shift, -1)
        score = np.zeros(size)
        for w, places in at.items():
            here = np.array(found[w], np.int64)
            if not len(here):
                continue
            # each place of the word reaches ``slack`` to both sides, but no begin counts it twice
            ends = here + slack + 1
            starts = np.maximum(here - slack, np.concatenate([[-shift], ends[:-1]]))
            for place in places:
                np.add.at(score, starts - place + shift, self.idf[w])
                np.add.at(score, ends - place + shift, -self.idf[w])
        score, named = np.cumsum(score), np.cumsum(named) > 0
        top = float(score[named].max()) / self.weight[k]
        return min(1.0, top) if top >= share - 1e-9 else 0.0

    def match(self, words: list[bytes], share: float = 0.6) -> tuple[set[str], float]:
        """Labels of the templates of which at least ``share`` of the weight and all key phrases stand in the words, and the best share."""
        seen, labels, top = set(words), set(), 0.0
        for k, (label, _, must) in enumerate(self.templates):
            if self.needs[k] <= seen and all(_places(words, p) for p in must) and (score := self.best(k, words, share)):
                labels.add(label)
                top = max(top, score)
        return labels, top


def _places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Where the phrase's words stand consecutively."""
    n, first, out, at = len(phrase), phrase[0], [], -1
    while True:
        try:
            at = words.index(first, at + 1)
        except ValueError:
            return out
        if words[at : at + n] == phrase:
            out.append(at)


_INDEX: list[Index] = []


def scan_licenses(docs: DataFrame, share: float = 0.6) -> DataFrame:
    """Licence phrases and notices in every whole text, one row for each input row, without a shuffle.

    Returns doc_id, n_words, n_base (places of the base phrases), first_word
    and last_word (their smallest and largest start), base_labels, labels (with
    those of templates found by position), score (1 where a base phrase stands,
    else the best template's share, else 0). Null and empty texts have no
    words, no labels and score 0; repeated rows get equal results, an empty
    table gives no rows, and only doc_id and text are read. Labels of all
    templates that reach ``share`` are given, so ties need no rule.
    """

    def look(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not _INDEX:
            _INDEX.append(Index())
        index = _INDEX[0]
        phrases = [(p.encode().split(), label) for p, label in BASE_PHRASES]
        rows = []
        for text in batch.column("text").to_pylist():
            words = alnum_words(text)
            seen = set(words)
            places, base = [], set()
            for p, label in phrases:
                if seen.issuperset(p) and (found := _places(words, p)):
                    places += found
                    base.add(label)
            labels, score = index.match(words, share)
            rows.append((len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if base else score))
        columns = list(zip(*rows, strict=True))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        return pa.record_batch([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return map_arrow(text_rows(docs), look, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")

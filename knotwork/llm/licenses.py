"""License scans by conditional compression: candidate blocks (lines, and runs of lines without their comment marks) are compressed with each template as raw zstandard dictionary, licenses rank by the size saved, and the best are confirmed by exact wording differences."""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A block must hold one of these to be a candidate; what stands between words may be a line break with a comment mark.
CUE = r"(?i)licen[sc]e|copyright|permission is hereby|permission to use|permission is granted|public domain|redistribution and use|all rights reserved".replace(" ", r"[\s#*/;%<>!-]+")
#: Words of a piece of a long line, and their overlap; the same for runs of lines, where the overlap holds the longest template and what stands in between.
PIECE, OVERLAP = 300, 150
RUN, RUN_OVERLAP = 1200, 600
#: Least saving; share of the template's words that must occur in order.
SAVED, WORDING = 0.25, 0.8
#: Licenses that are looked at in a round, the best by bytes saved; while one of them is confirmed, the next are looked at on the rest of the block.
LOOKED = 6
#: Names with what must occur word by word, and the sentences they stand in (fixed values).
NAMES = {
    "MIT": "MIT License", "Apache-2.0": "Apache License, Version 2.0", "GPL-2.0": "GNU General Public License, version 2", "GPL-3.0": "GNU General Public License, version 3",
    "LGPL-2.1": "GNU Lesser General Public License, version 2.1", "LGPL-3.0": "GNU Lesser General Public License, version 3", "AGPL-3.0": "GNU Affero General Public License, version 3",
    "MPL-2.0": "Mozilla Public License, version 2.0", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License", "ISC": "ISC License", "EPL-2.0": "Eclipse Public License, version 2.0",
    "CC0-1.0": "CC0 1.0 Universal", "CC-BY-4.0": "CC BY 4.0", "CC-BY-SA-4.0": "CC BY-SA 4.0", "CC-BY-NC-4.0": "CC BY-NC 4.0", "CC-BY-ND-4.0": "CC BY-ND 4.0", "Unlicense": "The Unlicense", "Zlib": "zlib License",
}
FORMS = ("Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "This work is licensed under the {}.", "This file is distributed under the terms of the {}.")
#: Well-known notices (fixed values).
NOTICES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Full texts, standard headers and openings of long texts, with the phrases that must occur word by word (fixed values).
_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD = NOTICES["BSD-2-Clause"] + ": 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
_GNU_MORE = " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details."
_KINDS = (("GPL-2.0", "General Public License", "2"), ("GPL-3.0", "General Public License", "3"), ("LGPL-2.1", "Lesser General Public License", "2.1"), ("LGPL-3.0", "Lesser General Public License", "3"), ("AGPL-3.0", "Affero General Public License", "3"))
_DATES = {"GPL-2.0": "June 1991", "GPL-3.0": "29 June 2007", "LGPL-2.1": "February 1999", "LGPL-3.0": "29 June 2007", "AGPL-3.0": "19 November 2007"}
TEXTS = [
    ("MIT", NOTICES["MIT"] + ", and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.", ("permission is hereby granted",)),
    ("ISC", NOTICES["ISC"] + " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.", ("permission to use",)),
    ("BSD-2-Clause", _BSD + _WARRANTY, ("redistribution and use",)),
    ("BSD-3-Clause", _BSD + _THIRD + _WARRANTY, ("redistribution and use", "neither the name")),
    ("BSD-3-Clause", _BSD + _THIRD, ("redistribution and use", "neither the name")),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.", ("permission is granted to anyone",)),
    ("Unlicense", NOTICES["Unlicense"] + " Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", ("public domain",)),
    ("Apache-2.0", NOTICES["Apache-2.0"] + " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", ("apache license version 2.0",)),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION", ("apache license version 2.0",)),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", ("mozilla public license v 2.0",)),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions", ("mozilla public license version 2.0",)),
    *((k, (_GNU + more).format(n, v), (f"gnu {n.lower()}", f"version {v} of the license")) for k, n, v in _KINDS for more in ("", _GNU_MORE)),
    *((k, f"GNU {n} Version {v}, {_DATES[k]} Copyright (C) Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.", (f"gnu {n.lower()} version {v} {_DATES[k].lower()}",)) for k, n, v in _KINDS),
]
#: Short names, which count in these forms only, word by word (fixed values).
SHORT = {
    "MIT": ("MIT",), "Apache-2.0": ("Apache-2.0", "Apache 2.0", "Apache License 2.0", "Apache License, Version 2.0"), "GPL-2.0": ("GPLv2", "GPL v2", "GPL-2.0", "GNU GPL v2", "GNU GPLv2"), "GPL-3.0": ("GPLv3", "GPL v3", "GPL-3.0", "GNU GPL v3", "GNU GPLv3"),
    "LGPL-2.1": ("LGPLv2.1", "LGPL v2.1", "LGPL-2.1"), "LGPL-3.0": ("LGPLv3", "LGPL v3", "LGPL-3.0"), "AGPL-3.0": ("AGPLv3", "AGPL v3", "AGPL-3.0"), "MPL-2.0": ("MPL 2.0", "MPL-2.0", "Mozilla Public License 2.0"), "BSD-2-Clause": ("BSD-2-Clause", "BSD 2-Clause"), "BSD-3-Clause": ("BSD-3-Clause", "BSD 3-Clause"),
    "ISC": ("ISC",), "EPL-2.0": ("EPL-2.0", "EPL 2.0"), "CC0-1.0": ("CC0", "CC0-1.0", "CC0 1.0"), "CC-BY-4.0": ("CC-BY-4.0",), "CC-BY-SA-4.0": ("CC-BY-SA-4.0",), "CC-BY-NC-4.0": ("CC-BY-NC-4.0",), "CC-BY-ND-4.0": ("CC-BY-ND-4.0",), "Zlib": ("Zlib",),
}
SHORT_FORMS = ("Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}", "Distributed under the {}", "Available under the {}", "License: {}")
SPDX = re.compile(r"(?i)spdx-license-identifier:[ \t]*([^\n]*)")
SPDX_WORD = re.compile(r"[A-Za-z0-9.+-]*[A-Za-z0-9+]")
WORD = re.compile(r"[\w.+-]*\w")
#: What stands around the text of a line of a comment.
MARKS = re.compile(r"^[\s#*/;%<>!|-]+|[\s*/<>!-]+$")


def _compressor(text: str) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=19, dict_data=d, write_content_size=False, write_checksum=False)


@functools.cache
def templates() -> list[tuple[str, list[str], Counter, tuple[str, ...], bool, zstandard.ZstdCompressor]]:
    """(license, words, their counts, phrases that must occur, whether nearly the whole wording can stand for them, compressor)."""
    name = lambda k: (NAMES[k],)
    texts = [(k, f.format(n), name(k), False) for k, n in NAMES.items() for f in FORMS] + [(k, t, name(k), True) for k, t in NOTICES.items()] + [(k, t, m, False) for k, t, m in TEXTS]
    texts += [(k, t, (t,), False) for k, own in SHORT.items() for n in own for f in SHORT_FORMS for t in (f.format(n),)]
    made = []
    for k, t, must, free in texts:
        w = WORD.findall(t.lower())
        made.append((k, w, Counter(w), tuple(f" {' '.join(WORD.findall(m.lower()))} " for m in must), free and len(w) > 12, _compressor(t)))
    return made


@functools.cache
def _plain() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=19, write_content_size=False, write_checksum=False)


def _saved(text: str, c: zstandard.ZstdCompressor) -> float:
    data = text.encode("utf-8", "replace")
    alone = len(_plain().compress(data))
    return (alone - len(c.compress(data))) / max(1, alone)


@functools.cache
def dictionaries(level: int) -> list[tuple[str, zstandard.ZstdCompressor]]:
    """(license, compressor with a raw dictionary): one for each notice and text, one for all sentences and short forms of a license together."""
    said: dict[str, list[str]] = {}
    for k, n in NAMES.items():
        said.setdefault(k, []).extend(f.format(n) for f in FORMS)
    for k, own in SHORT.items():
        said.setdefault(k, []).extend(f.format(n) for n in own for f in SHORT_FORMS)
    texts = [(k, " ".join(t)) for k, t in said.items()] + list(NOTICES.items()) + [(k, t) for k, t, _ in TEXTS]
    made = []
    for k, t in texts:
        d = zstandard.ZstdCompressionDict(" ".join(WORD.findall(t.lower())).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        made.append((k, zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False)))
    return made


@functools.cache
def _alone(level: int) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False)


def savings(words: list[str]) -> dict[str, int]:
    """Bytes that a license's best dictionary saves on words; where they are few, each byte tells, and the highest level is used."""
    data = " ".join(words).encode("utf-8", "replace")
    level = 19 if len(data) <= SHORT_BLOCK else 3
    alone, out = len(_alone(level).compress(data)), {}
    for k, c in dictionaries(level):
        out[k] = max(out.get(k, 0), alone - len(c.compress(data)))
    return out


def scan(block: str, run: bool = False) -> tuple[tuple[str, float, float, tuple[str, ...], tuple[str, ...], int, int], ...]:
    """(license, share of size saved, share of wording, words missing, words more within the match, first and last word) of every license of the block, each in its best template; ties to the earlier one.

    Licenses rank by the bytes that their dictionaries save. The LOOKED best are looked at for their wording; while that confirms one, what
    it matched is taken away and those that rank best on the rest come next. What is said within the words of another, longer license (the
    two clauses within three) does not count. In a run of lines the saving is that of the match, which is at most twice as long as the
    template, and a license is looked for again beyond its match.
    """
    return (_long if len(block) > SHORT_BLOCK else _short)(block, run)


#: Characters of a block of which many are remembered.
SHORT_BLOCK = 400


@functools.lru_cache(20_000)
def _short(block: str, run: bool) -> tuple:
    return _looked(block, run)


@functools.lru_cache(1_000)
def _long(block: str, run: bool) -> tuple:
    return _looked(block, run)


def _looked(block: str, run: bool) -> tuple:
    words = WORD.findall(block.lower())
    rest, seen, found = list(words), set(), []
    while rest:
        rank = sorted(((-v, k) for k, v in savings(rest).items() if v > 0 and k not in seen))[:LOOKED]
        if not rank:
            break
        seen |= {k for _, k in rank}
        more = _confirmed(block, run, {k for _, k in rank})
        if not more:
            break
        found += more
        hit = frozenset().union(*(f[6] for f in found))
        rest = [w for k, w in enumerate(words) if k not in hit]
    best: list[tuple] = []
    for f in sorted(found, key=lambda f: (len(f[6]) if run else 0, f[:3]), reverse=True):
        if not any((f[6] <= g[6] and (f[3] == g[3] or len(f[6]) < len(g[6]))) or (f[3] == g[3] and (not run or f[6] & g[6])) for g in best):
            best.append(f)
    best = [f for f in best if not any(f[3] != g[3] and f[6] < g[6] for g in best)]
    return tuple((name, saved, share, missing, more, min(hit), max(hit)) for share, saved, _, name, missing, more, hit in best)


def _confirmed(block: str, run: bool, licenses: set[str]) -> list[tuple]:
    """Of the licenses those whose wording the block has: (share, saved, order, license, missing, more, places of the words). A template of which the block lacks too many words at all is not compared in order."""
    low = block.lower()
    words = WORD.findall(low)
    text, counts = f" {' '.join(words)} ", Counter(words)
    found = []
    for n, (name, own, own_counts, must, free, c) in enumerate(templates()):
        if name not in licenses:
            continue
        named = all(m in text for m in must)
        held_most = sum(min(v, counts[w]) for w, v in own_counts.items()) / len(own)
        if held_most < WORDING or not (named or (free and held_most >= 0.9)):
            continue
        left = list(words)
        while True:
            if named and len(own) < 40 and run:
                # Around the phrase, so that the same words elsewhere in a long run don't draw the match apart.
                said = must[0].split()
                k = next((k for k in range(len(left)) if left[k : k + len(said)] == said), None)
                if k is None:
                    break
                lo, hi = max(0, k - 2 * len(own)), min(len(left), k + 2 * len(own))
            else:
                lo, hi = 0, len(left)
            runs = [m for m in SequenceMatcher(None, own, left[lo:hi], autojunk=False).get_matching_blocks() if m.size]
            held = {k for m in runs for k in range(m.a, m.a + m.size)}
            hit = {lo + k for m in runs for k in range(m.b, m.b + m.size)}
            share = len(held) / len(own)
            first, last = min(hit, default=0), max(hit, default=0)
            good = share >= WORDING and (named or share >= 0.9) and not (run and last - first >= 2 * len(own))
            saved = (_saved(" ".join(words[first : last + 1]), c) if run else _saved(low, c)) if good else 0.0
            if good and (saved >= SAVED or (not run and len(words) > 2 * len(own))):
                found.append((share, saved, -n, name, tuple(w for k, w in enumerate(own) if k not in held), tuple(words[k] for k in range(first, last + 1) if k not in hit), frozenset(hit)))
            elif not (run and lo + hi and named and len(own) < 40):
                break
            else:
                hit = set(range(k, k + len(said)))
            if not run or not hit:
                break
            for k in hit:
                left[k] = ""
    return found


def spdx(line: str) -> list[tuple]:
    """As scan, for every license of the expression behind an SPDX identifier."""
    out = []
    for m in SPDX.finditer(line):
        w = SPDX_WORD.findall(m[1].split("*/")[0].split("-->")[0])
        for k, x in enumerate(w):
            if x.upper() in ("AND", "OR", "WITH") or (k and w[k - 1].upper() == "WITH"):
                continue
            base = re.sub(r"(?i)(-only|-or-later|\+)$", "", x)
            name = next((n for n in NAMES if n.lower() == base.lower()), base)
            out.append((name, _saved(m[0].lower(), _compressor(f"SPDX-License-Identifier: {x}")), 1.0, (), ()))
            if k + 1 < len(w) and w[k + 1].upper() not in ("AND", "OR", "WITH"):
                break
    return out


def runs(text: str) -> Iterator[tuple]:
    """(first and last line, license, ...) of the licenses that stand on several lines. Comment marks go; blank lines part nothing, as notices have paragraphs."""
    w, at = [], []
    for k, line in enumerate(text.split("\n")):
        own = WORD.findall(MARKS.sub("", line).lower())
        w += own
        at += [k] * len(own)
    cue, seen = re.compile(CUE), set()
    for lo in range(0, max(1, len(w) - RUN_OVERLAP), RUN - RUN_OVERLAP):
        piece = " ".join(w[lo : lo + RUN])
        if cue.search(piece):
            for *r, first, last in scan(piece, True):
                if at[lo + first] != at[lo + last] and (r[0], lo + first) not in seen:
                    seen.add((r[0], lo + first))
                    yield at[lo + first], at[lo + last], *r


def pieces(line: str) -> list[str]:
    w = line.split()
    return [line] if len(w) <= PIECE else [" ".join(w[k : k + PIECE]) for k in range(0, len(w) - OVERLAP, PIECE - OVERLAP)]


FOUND = "doc_id long, block long, license string, saved double, wording double, missing array<string>, more array<string>"


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cue = re.compile(CUE)
    for b in batches:
        rows: list[tuple] = []
        for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            own: list[tuple] = []
            for k, line in enumerate(text.split("\n")):
                if cue.search(line):
                    stated = [r[:5] for p in pieces(line) if cue.search(p) for r in scan(p)]
                    own += dict.fromkeys((k, *r) for r in stated + [r for r in spdx(line) if r[0] not in {x[0] for x in stated}])
            # Of a line and a run over it that state the same license, the nearer to the wording stays.
            wide = list(runs(text)) if "\n" in text else []
            over = lambda w, r: w[0] <= r[0] <= w[1] and w[2] == r[1]
            wide = [w for w in wide if not any(over(w, r) and r[3] > w[4] for r in own)]
            rows += [(i, *r) for r in own if not any(over(w, r) for w in wide)] + [(i, first, *r) for first, _, *r in wide]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array([list(r[k]) if k > 4 else r[k] for r in rows], t) for k, t in enumerate(kinds)], [c.split()[0] for c in FOUND.split(", ")])


def find(docs: DataFrame) -> DataFrame:
    """One row for each license that a block states; the block is the line it is on, or begins on. Texts without a cue, null and empty ones give none; the JVM leaves them out before Python."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").rlike(CUE)).mapInArrow(_scan, FOUND)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))

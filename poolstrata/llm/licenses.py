"""License scans: MinHash bands over overlapping text windows retrieve templates; exact shingle containment verifies them.

Texts and templates are lower-cased words (letters, digits, non-ASCII), in shingles of five. For a template of n shingles,
windows are 2n shingles wide, n apart, so any n shingles in a row lie within one. A window that holds 0.8 of the template
has a Jaccard similarity of at least J = i / (3n - i), i = ceil(0.8 n), with it. Bands of one row collide with probability
J each; their number is the least for which all of them miss with probability ``MISS`` or less. What collides is verified:
the share of the template's different shingles in the window, 0.8 or more. Verified windows that overlap are joined, and what
they hold is told apart into places, each at most 2n shingles wide: so every copy of a template has a row of its own.
``closest`` is false where a place of another template overlaps it and holds a larger share (a notice of a kindred license).

The templates are a fixed list of the caller's, broadcast (of at most ``MOST_TEMPLATE_CHARS`` characters, which is checked);
every text is scanned whole where it lies. No shuffle. ``TEMPLATES`` holds notices and single paragraphs (grants, clauses,
disclaimers, liability), so a whole license is found by the paragraphs that it has; licenses without one of these aren't.

Defined cases: null and short texts hold no template; templates of fewer than five words are one shingle of all their
words, found in texts as shingles of that many words; repeated rows each give their rows; copies that touch are two places, as a
place ends where a shingle comes oftener than in the template. Only id and text are read.
"""

from __future__ import annotations

import math
from collections import Counter, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .words import ALNUM, gather, hashes, mix, words

SHINGLE = 5
LEAST = 0.8
MISS = 1e-4
#: Bound of what is broadcast.
MOST_TEMPLATE_CHARS = 8_000_000

# fixed values: license notices, as their publishers word them
TEMPLATES = {
    "agpl-3-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "apache-2.0-grant": "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    "apache-2.0-limits": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "boost-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "bsd-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-liability": "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "gnu-verbatim": "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "gpl-2-preamble": "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.",
    "gpl-3-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3-preamble": "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "lgpl-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "mit-disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "mit-inclusion": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mit-line": "Released under the MIT License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
}


def shingle_hashes(h: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    out = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - size + 1 + k]
    return mix(out)


class Templates:
    """Templates by their number of shingles, with the bands' values."""

    def __init__(self, texts: dict[str, str], shingle: int = SHINGLE, least: float = LEAST, miss: float = MISS):
        self.least = least
        self.classes: dict[tuple[int, int], dict] = {}
        for name, text in sorted(texts.items()):
            for _, _, buffer, _ in gather([text]):
                h = hashes(buffer, *words(buffer, ALNUM))
                size = min(shingle, len(h))
                s = shingle_hashes(h, size)
                if size:
                    self.classes.setdefault((size, len(s)), {"templates": []})["templates"].append((name, dict(zip(*(x.tolist() for x in np.unique(s, return_counts=True))))))
        for (_, n), c in self.classes.items():
            i = max(1, math.ceil(least * n))
            j = i / (3 * n - i)
            c["bands"] = math.ceil(math.log(miss) / math.log(1 - j))
        self.seeds = mix(np.arange(1, 1 + max((c["bands"] for c in self.classes.values()), default=0), dtype=np.uint64))
        for c in self.classes.values():
            c["values"] = [np.array([int(self.permuted(np.array(list(s), np.uint64), b).min()) for _, s in c["templates"]], np.uint64) for b in range(c["bands"])]
            c["orders"] = [np.argsort(v) for v in c["values"]]

    def permuted(self, s: np.ndarray, band: int) -> np.ndarray:
        x = (s ^ self.seeds[band]) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ x >> np.uint64(32)

    def scan(self, texts: list[str | None]) -> list[tuple[int, str, float, int, int, bool]]:
        """(number of the text, template, containment, start and end in code points, closest), one for each place of a template."""
        out: list[tuple[int, str, float, int, int, bool]] = []
        for first, _, buffer, text_starts in gather(texts):
            w_start, w_end = words(buffer, ALNUM)
            h = hashes(buffer, w_start, w_end)
            bounds = np.concatenate((np.searchsorted(w_start, text_starts), [len(h)]))
            found: dict[int, list[tuple[int, int, float, str]]] = {}
            for size in sorted({s for s, _ in self.classes}):
                s = shingle_hashes(h, size)
                text_of = np.repeat(np.arange(len(text_starts)), np.diff(bounds))
                whole = text_of[: len(s)] == text_of[size - 1 : size - 1 + len(s)]  # shingles that don't cross texts
                s, place = s[whole], np.flatnonzero(whole)
                if not len(s):
                    continue
                owner = text_of[place]
                classes = {n: c for (z, n), c in self.classes.items() if z == size}
                verified: dict[tuple[int, int], list[tuple[int, int]]] = {}
                for n, number, (lo, hi) in self.colliding(s, owner, classes):
                    shingles = classes[n]["templates"][number][1]
                    if len(set(s[lo:hi].tolist()) & shingles.keys()) >= self.least * len(shingles):
                        verified.setdefault((n, number), []).append((lo, hi))
                for (n, number), windows in verified.items():
                    name, shingles = classes[n]["templates"][number]
                    for lo, hi in joined(windows, owner):
                        for a, b, share in places(s[lo:hi].tolist(), shingles, 2 * n, self.least):
                            start, end = int(w_start[place[lo + a]]), int(w_end[place[lo + b] + size - 1])
                            found.setdefault(int(owner[lo]), []).append((start, end, share, name))
            for t, spots in found.items():
                spots.sort()
                closest = nearest(spots)
                points = code_points(buffer, int(text_starts[t]), [x for spot in spots for x in spot[:2]])
                for k, (_, _, share, name) in enumerate(spots):
                    out.append((first + t, name, share, points[2 * k], points[2 * k + 1], closest[k]))
        return sorted(out, key=lambda r: (r[0], r[1], r[3]))

    def colliding(self, s: np.ndarray, owner: np.ndarray, classes: dict[int, dict]):
        """(n, number of the template in its class, window in s) where a band of a window and of a template are equal."""
        layout = {}
        text_start = np.concatenate(([0], np.flatnonzero(owner[1:] != owner[:-1]) + 1))
        nth = np.arange(len(s)) - np.repeat(text_start, np.diff(np.concatenate((text_start, [len(s)]))))
        for n in classes:
            blocks = np.flatnonzero(nth % n == 0)
            layout[n] = blocks, np.concatenate((owner[blocks][1:] == owner[blocks][:-1], [False])), np.concatenate((blocks[1:], [len(s)]))
        seen = set()
        for band in range(max((c["bands"] for c in classes.values()), default=0)):
            x = self.permuted(s, band)
            for n, c in classes.items():
                if band >= c["bands"]:
                    continue
                blocks, joined, ends = layout[n]
                low = np.minimum.reduceat(x, blocks) if n > 1 else x
                pair = np.where(joined, np.minimum(low, np.concatenate((low[1:], low[-1:]))), low)
                order = c["orders"][band]
                values = c["values"][band][order]
                spot = np.minimum(np.searchsorted(values, pair), len(values) - 1)
                for k in np.flatnonzero(values[spot] == pair).tolist():
                    end = int(ends[k + 1]) if joined[k] else int(ends[k])
                    for m in np.flatnonzero(values == pair[k]).tolist():
                        key = (n, int(order[m]), (int(blocks[k]), end))
                        if key not in seen:
                            seen.add(key)
                            yield key


def joined(windows: list[tuple[int, int]], owner: np.ndarray) -> list[tuple[int, int]]:
    """Windows of the same text that overlap, as one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(windows):
        if out and lo < out[-1][1] and owner[lo] == owner[out[-1][0]]:
            out[-1] = out[-1][0], max(out[-1][1], hi)
        else:
            out.append((lo, hi))
    return out


def places(s: list[int], shingles: dict[int, int], width: int, least: float) -> list[tuple[int, int, float]]:
    """First and last shingle and share of each place of a template (its shingles and how often it has each). A place begins when
    enough different shingles lie within the width, and goes on until one comes oftener than the template has it."""
    out: list[tuple[int, int, float]] = []
    held: deque[int] = deque()
    counts: Counter[int] = Counter()

    def left() -> None:
        x = s[held.popleft()]
        counts[x] -= 1
        if not counts[x]:
            del counts[x]

    def close() -> None:
        if len(counts) >= least * len(shingles):
            while counts[s[held[0]]] > shingles[s[held[0]]]:
                left()
            out.append((held[0], held[-1], len(counts) / len(shingles)))
            held.clear()
            counts.clear()

    for at, x in enumerate(s):
        if x not in shingles:
            continue
        if held and (at - held[0] >= width or counts[x] >= shingles[x]):
            close()
        while held and at - held[0] >= width:
            left()
        held.append(at)
        counts[x] += 1
    if held:
        close()
    return out


def code_points(buffer: np.ndarray, start: int, at: list[int]) -> list[int]:
    """Byte places as code points after ``start``: bytes that continue a character don't count."""
    order = sorted(set(at))
    begins = (buffer[start : order[-1]] & 0xC0) != 0x80
    counted = np.concatenate(([0], np.cumsum(begins)))
    return [int(counted[x - start]) for x in at]


def nearest(spots: list[tuple[int, int, float, str]]) -> list[bool]:
    """Of places by start: whether none of another template overlaps each and holds a larger share of its template."""
    out, open_ = [True] * len(spots), []
    for k, (start, _, share, name) in enumerate(spots):
        open_ = [o for o in open_ if spots[o][1] > start]
        for o in open_:
            if spots[o][3] != name and spots[o][2] != share:
                out[k if spots[o][2] > share else o] = False
        open_.append(k)
    return out


def scan(df: DataFrame, templates: dict[str, str] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, license, containment, start, end, closest: every place of a template in a text (none for an empty list of templates)."""
    if sum(map(len, (templates or {}).values())) > MOST_TEMPLATE_CHARS:
        raise ValueError(f"templates of more than {MOST_TEMPLATE_CHARS} characters: scan with a part of them at a time")
    sent = df.sparkSession.sparkContext.broadcast(Templates(TEMPLATES if templates is None else templates))
    schema = T.StructType([df.schema[key], T.StructField("license", T.StringType()), T.StructField("containment", T.DoubleType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("closest", T.BooleanType())])
    types = (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.bool_())

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                rows = sent.value.scan(part.column(1).to_pylist())
                at, *values = [pa.array([r[n] for r in rows], t) for n, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), *values], names=schema.names)

    return df.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))

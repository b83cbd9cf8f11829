"""License scans by conditional compression: places that hold a template's wording, ranked by the bytes that its dictionary saves there."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Templates by license (fixed public wordings, shortened to what identifies them). A name may have several.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD", "Licensed under the BSD License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("proprietary", "All rights reserved."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "This project is MIT licensed."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD", "Licensed under the BSD 3-Clause License."),
    ("BSD", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-3.0", "License: GPLv3"),
    ("GPL-3.0", "Licensed under the GNU GPL v3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-4.0", "Licensed under CC-BY-4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC-BY-SA-4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
)
#: Phrases that decide between licenses and versions: a place must have those that its template has, word for word.
DECIDING = (
    "mit license", "apache license version 2.0", "gnu general public license", "gnu lesser general public license", "gnu affero general public license",
    "version 2", "version 3", "mozilla public license v 2.0", "bsd license", "public domain", "cc0 1.0", "cc by 4.0", "cc by-sa 4.0", "cc by-nc 4.0", "cc by-nd 4.0",
    "creative commons attribution 4.0 international", "all rights reserved", "mit licensed", "identifier mit", "spdx-license-identifier mit", "apache license 2.0",
    "spdx-license-identifier apache-2.0", "bsd 3-clause license", "spdx-license-identifier bsd-3-clause", "license gplv3", "gnu gpl v3",
    "spdx-license-identifier gpl-3.0-only", "cc-by-4.0", "cc-by-sa-4.0", "creative commons attribution-sharealike 4.0 international",
)
#: Words of which every notice has one; only around these are blocks compressed (fixed values).
CUES = frozenset((
    "license licensed licence licenced licenses license-2.0 mit apache apache-2.0 gpl gplv2 gplv3 gpl-3.0-only gnu mozilla mpl bsd bsd-3-clause isc spdx-license-identifier "
    "permission permitted granted redistribution redistribute unencumbered domain reserved cc cc0 cc-by-4.0 cc-by-sa-4.0 by-sa by-nc by-nd 4.0 creative commons sublicense copyright software"
).split())
#: Words that deny a notice, inside it or among the NEAR words before it in its sentence; those of MORE_DENIALS inside a notice of
#: SENTENCE words at most, as longer ones have them in their own wording.
DENIALS, NEAR = frozenset("not never neither nor cannot isn aren wasn weren".split()), 3
MORE_DENIALS, SENTENCE = DENIALS | {"no", "without"}, 16
#: Least share of the bytes saved in a block, of those that a template's dictionary saves in its own wording; most of the template's
#: words that may differ.
SAVED, DIFFERENT = 0.35, 0.25
#: Added words that weigh as much as a missing one where a place is chosen; words of a block, which begin every half of that.
ADDED, BLOCK_WORDS = 4, 128
LEVEL = 3

FOUND = "doc_id long, block long, license string, saved double, n_words int, n_missing int, n_added int, differences string"
_WORD = regex.compile(r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Scanner:
    """Templates as words to be found and as raw zstandard dictionaries."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, saved: float = SAVED, different: float = DIFFERENT):
        self.saved = saved
        self.templates = [(name, w) for name, text in templates if (w := words(text))]
        self.most = [int(different * len(w)) for _, w in self.templates]
        self.deciding = [[f" {x} " for x in DECIDING if f" {x} " in f" {' '.join(w)} "] for _, w in self.templates]
        ids = {w: k for k, w in enumerate(sorted({x for _, w in self.templates for x in w}))}
        self.ids, self.wanted = ids, [[ids[x] for x in w] for _, w in self.templates]
        self.cues = CUES.union(*(w for _, w in self.templates if CUES.isdisjoint(w)))
        # a place has at most ADDED added words for each of the template's
        self.reach = (1 + ADDED) * max((len(w) for _, w in self.templates), default=0)
        plain = dict(write_content_size=False, write_checksum=False, write_dict_id=False)
        self.plain = zstandard.ZstdCompressor(level=LEVEL, **plain)
        self.primed = []
        for _, w in self.templates:
            # a raw dictionary is plain text that matches may point into; short ones are padded, as zstandard wants 8 bytes
            held = zstandard.ZstdCompressionDict(" ".join(w).encode().ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            self.primed.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, **plain))
        self.full = [max(1, self.savings(w, [k])[0]) for k, (_, w) in enumerate(self.templates)]

    def savings(self, own: list[str], some: list[int]) -> list[int]:
        """Bytes by which each of some templates shortens a block as its dictionary."""
        raw = " ".join(own).encode()
        alone = len(self.plain.compress(raw))
        return [alone - len(self.primed[k].compress(raw)) for k in some]

    def notices(self, text: str) -> list[tuple]:
        """(line, license, saved, words, missing, added, differences) of every notice, in order of place.

        Blocks of BLOCK_WORDS words, each half over the next, that hold a cue are compressed with every template. The template that
        saves most is sought in the block and the words around it, and confirmed by its wording: few differences, none in a deciding
        phrase, and no denial. A confirmed place is a notice; its words are taken out and the block is compressed anew. A template
        that is not confirmed gives way to the next one, down to those that save less than SAVED of what they save in their own
        wording. Of places that overlap the one found first stays, by bytes saved, then fewer differences, more words, the earlier
        template.
        """
        low = text.lower()
        spans = [m.span() for m in _WORD.finditer(low)]
        own = [low[a:b] for a, b in spans]
        half = BLOCK_WORDS // 2
        blocks = sorted({b for i, w in enumerate(own) if w in self.cues for b in (i // half, max(0, i // half - 1))})
        ids = np.array([self.ids.get(w, -1) for w in own], np.int64) if blocks else None
        taken = np.zeros(len(own), bool)
        kept: list[tuple] = []
        for block in blocks:
            first, end = block * half, min(len(own), block * half + BLOCK_WORDS)
            around = max(0, first - self.reach), min(len(own), end + self.reach)
            open_ = list(range(len(self.templates)))
            while open_:
                left = [own[i] for i in range(first, end) if not taken[i]]
                if self.cues.isdisjoint(left):
                    break
                ranked = sorted((-saving, k) for saving, k in zip(self.savings(left, open_), open_, strict=True) if saving >= self.saved * self.full[k])
                best = None
                for most, group in itertools.groupby(ranked, key=lambda x: x[0]):
                    # equal savings: the place with fewer differences, then the longer one, then the earlier template
                    found = [(len(m) + len(x), a - b, k, a, b, m, x) for _, k in group for a, b, m, x in self._places(k, own, ids, taken, *around) if a < end and b > first and self._confirmed(k, own[a:b], x) and not _denied(low, spans, a)]
                    if found:
                        best = -most, min(found, key=lambda x: x[:4])
                        break
                if best is None:
                    break
                saving, (_, _, k, a, b, missing, added) = best
                taken[a:b] = True
                kept.append((a, saving / self.full[k], k, len(missing), len(added), " ".join([*("-" + w for w in missing), *("+" + w for w in added)])))
        out, line, before = [], 0, 0
        for a, share, k, missing, added, differences in sorted(kept):
            line, before = line + low.count("\n", before, spans[a][0]), spans[a][0]
            out.append((line, self.templates[k][0], share, len(self.templates[k][1]), missing, added, differences))
        return out

    def _confirmed(self, k: int, own: list[str], added: list[str]) -> bool:
        place = f" {' '.join(own)} "
        return all(x in place for x in self.deciding[k]) and (MORE_DENIALS if len(self.wanted[k]) <= SENTENCE else DENIALS).isdisjoint(added)

    def _places(self, k: int, own: list[str], ids: np.ndarray, taken: np.ndarray, low: int, high: int) -> Iterator[tuple[int, int, list[str], list[str]]]:
        """(first word, end word, missing, added) of separate places in low..high, without words that are taken, where template k stands
        with enough of its words."""
        edges = [low, *(low + np.flatnonzero(np.diff(taken[low:high].astype(np.int8))) + 1).tolist(), high]
        rest = [(a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a and not taken[a]]
        need = np.bincount(self.wanted[k], minlength=len(self.ids))
        while rest:
            a, b = rest.pop()
            here = ids[a:b]
            have = np.bincount(here[here >= 0], minlength=len(self.ids))
            if np.maximum(need - have, 0).sum() > self.most[k]:
                continue
            if place := _aligned(self.wanted[k], here, self.most[k]):
                first, end, missing, added = place
                yield a + first, a + end, [self.templates[k][1][i] for i in missing], [own[a + j] for j in added]
                rest += [(a, a + first), (a + end, b)]


def _denied(low: str, spans: list[tuple[int, int]], first: int) -> bool:
    """Whether one of the NEAR words before word `first`, in the same sentence, denies what follows."""
    for i in range(first - 1, max(-1, first - 1 - NEAR), -1):
        if any(c in ".!?;:" for c in low[spans[i][1] : spans[i + 1][0]]):
            return False
        if low[spans[i][0] : spans[i][1]] in MORE_DENIALS:
            return True
    return False


def _aligned(want: list[int], own: np.ndarray, most: int) -> tuple[int, int, list[int], list[int]] | None:
    """(first, end, missing positions of want, added positions of own) of the stretch of own that want fits best, in order, with
    at most `most` words missing; None if there is no such stretch.

    cost[i, j] is that of the first i words of want against the best stretch that ends before own[j]; its low half counts missing
    words.
    """
    one, lack = 1 << 32, (ADDED << 32) + 1
    run = np.arange(len(own) + 1, dtype=np.int64) * one
    cost = np.zeros((len(want) + 1, len(own) + 1), np.int64)
    for i, w in enumerate(want):
        row = cost[i] + lack
        row[1:] = np.minimum(row[1:], np.where(own == w, cost[i, :-1], row[1:]))
        cost[i + 1] = np.minimum.accumulate(row - run) + run
    good = np.flatnonzero((cost[-1] & (one - 1)) <= most)
    if not len(good):
        return None
    i, j = len(want), int(good[np.argmin(cost[-1, good])])
    end, missing, added = j, [], []
    while i:
        if j and own[j - 1] == want[i - 1] and cost[i, j] == cost[i - 1, j - 1]:
            i, j = i - 1, j - 1
        elif cost[i, j] == cost[i - 1, j] + lack:
            i -= 1
            missing.append(i)
        else:
            j -= 1
            added.append(j)
    return j, end, missing[::-1], added[::-1]


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """One row per license notice: (doc_id, block, license, saved, n_words, n_missing, n_added, differences).

    Blocks around words that any notice has are compressed with every template as a raw zstandard dictionary; templates are ranked by
    the bytes they save, and the winners confirmed by their wording (Scanner.notices). A notice is a place where a template's words
    stand in order, over any line breaks, with at most DIFFERENT of them missing. saved is the share of the bytes saved in the block,
    of those that the template saves in its own wording, and is SAVED at least. differences has the exact ones in wording (`-`
    missing, `+` added). block is the number of the line on which the notice starts; n_words counts the template's words. Names and
    versions (DECIDING) must stand word for word, so that another version is not taken for a template's; a notice that is denied
    ("not licensed under ...", "no longer ...") gives no row.

    Null and empty texts give no rows; repeated rows give repeated rows; null ids are kept; an empty table gives no rows; other
    columns are ignored. All of a text is read, and all separate places are returned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                out += [(doc_id, *notice) for notice in scanner.notices(text or "")]
            if out:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in FOUND.split(", ")])

    return bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, FOUND)

"""License scan: winnowed template fingerprints pick candidates, banded alignment measures them.

Words are runs of letters and digits, A-Z lower-cased. Of each template the smallest word grams of every few in turn are
posted in an inverted index. A document's grams are looked up there; postings on nearly the same diagonal are one
candidate, and the template is aligned with the document's words around that diagonal. All candidates of a template are
aligned together, one cell of the band at a time. Postings that no such match explains are chained over all diagonals, and
the template is aligned with the words between the chain's postings, so words put in or left out do not end a match.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from colloquy.llm._scratch import small_batches
from colloquy.llm._text import Words, chunks, minimizers, mix, string_parts

#: The templates and their index go to every executor; more than this is refused.
MOST_TEMPLATE_BYTES = 16 << 20
GRAM, WINDOW, BAND = 3, 4, 6
#: Cells of the band that are kept at a time.
CELLS = 8_000_000

#: Notices in common use, and the bodies of short licenses.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "All-Rights-Reserved": "Copyright. All rights reserved. No part of this work may be reproduced without permission.",
}

_PLAIN = np.array([b if b >= 128 or chr(b).isalnum() else 0x20 for b in range(256)], np.uint8)


def words_of(raw: np.ndarray, offsets: np.ndarray) -> Words:
    return Words(_PLAIN[raw], offsets, fold=True)


def grams_of(codes: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(max(len(codes) - size + 1, 0), np.uint64)
    for i in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + len(out)]
    return mix(out, size)


class Index:
    """Postings (template, place) of winnowed grams, sorted by gram, and the templates' words."""

    def __init__(self, templates: dict[str, str], gram: int = GRAM, window: int = WINDOW):
        if sum(len(t.encode()) for t in templates.values()) > MOST_TEMPLATE_BYTES:
            raise ValueError(f"templates of more than {MOST_TEMPLATE_BYTES} bytes")
        self.names, self.codes, self.gram = sorted(templates), [], gram
        keys, template, place = [], [], []
        for number, name in enumerate(self.names):
            raw = np.frombuffer(templates[name].encode(), np.uint8)
            codes = words_of(raw, np.array([0, len(raw)], np.int64)).hash
            self.codes.append(codes)
            size = min(gram, len(codes))
            if not size:
                continue
            # a template with fewer words than a gram is found by its first word, at the price of more candidates
            found = grams_of(codes, gram) if size == gram else codes[:1]
            # short templates keep every gram, so that one changed word does not hide them
            at = np.unique(minimizers(found, min(window, 1 + len(codes) // 20, len(found))))
            keys.append(found[at])
            template.append(np.full(len(at), number))
            place.append(at)
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(self.keys, kind="stable")
        self.keys = self.keys[order]
        self.template = np.concatenate(template)[order] if keys else np.zeros(0, np.int64)
        self.place = np.concatenate(place)[order] if keys else np.zeros(0, np.int64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.keys >> np.uint64(44)] = True

    def look_up(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in grams, posting) of all hits."""
        at = np.flatnonzero(self.maybe[grams >> np.uint64(44)])
        low, high = np.searchsorted(self.keys, grams[at], "left"), np.searchsorted(self.keys, grams[at], "right")
        at, low, many = at[high > low], low[high > low], (high - low)[high > low]
        posting = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return np.repeat(at, many), posting

    def hits(self, words: Words) -> np.ndarray:
        """(document, template, document word, template word) rows of all postings found, in this order."""
        hits = []
        for grams, size in ((grams_of(words.hash, self.gram), self.gram), (words.hash, 1)):
            at, posting = self.look_up(grams)
            short = np.array([len(c) < self.gram for c in self.codes], bool)[self.template[posting]]
            at, posting = at[short == (size == 1)], posting[short == (size == 1)]
            document = np.searchsorted(words.first, at, "right") - 1
            inside = at + size <= words.first[document + 1]
            hits.append(np.stack([document, self.template[posting], at, self.place[posting]], 1)[inside])
        return np.unique(np.concatenate(hits), axis=0)

    def candidates(self, hits: np.ndarray) -> np.ndarray:
        """(document, template, diagonal) rows: the diagonal is the document word on which the template's first falls."""
        found = np.unique(np.stack([hits[:, 0], hits[:, 1], hits[:, 2] - hits[:, 3]], 1), axis=0)
        if not len(found):
            return found
        # hits whose diagonal is within half a band of the first one of their group are one candidate
        keep, last = [], None
        for i, row in enumerate(found.tolist()):
            if last is None or row[:2] != last[:2] or row[2] - last[2] > BAND // 2:
                keep.append(i)
                last = row
        return found[keep]


def align(template: np.ndarray, codes: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray, band: int = BAND) -> list[np.ndarray]:
    """For each candidate the (template word, document word) pairs of a longest common subsequence within the band.

    ``start`` is the diagonal; document words outside [low, high) match nothing. Of equally long ones, one that
    ends first, with its words as near its end as can be.
    """
    many, n, width = len(start), len(template), 2 * band + 1
    row = np.zeros((width + 1, many), np.int32)
    step = np.zeros((n, width, many), np.uint8)
    for i in range(n):
        before = row.copy()
        left = np.zeros(many, np.int32)
        for j in range(width):
            at = start + i + j - band
            ok = (at >= low) & (at < high)
            same = ok & (codes[np.where(ok, at, 0)] == template[i])
            # on a diagonal (i, j) follows (i - 1, j); the template's word is skipped from (i - 1, j + 1)
            up = before[j + 1]
            best = np.maximum(np.where(same, before[j] + 1, 0), np.maximum(up, left))
            step[i, j] = np.where(same & (before[j] + 1 == best), 2, np.where(up == best, 1, 0))
            row[j] = left = best
    out = []
    for c, end in enumerate(row[:width].argmax(0).tolist()):
        i, j, found = n - 1, end, []
        while i >= 0 and 0 <= j < width:
            move = step[i, j, c]
            if move == 2:
                found.append((i, int(start[c]) + i + j - band))
                i -= 1
            elif move == 1:
                i, j = i - 1, j + 1
            else:
                j -= 1
        out.append(np.array(found[::-1], np.int64).reshape(-1, 2))
    return out


def subsequence(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Places of a longest common subsequence."""
    if not len(x) or not len(y):
        return []
    table = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    for i, word in enumerate(x):
        np.maximum.accumulate(np.where(y == word, table[i, :-1] + 1, table[i, 1:]), out=table[i + 1, 1:])
    out, i, j = [], len(x), len(y)
    while table[i, j]:
        if table[i, j] == table[i - 1, j]:
            i -= 1
        elif table[i, j] == table[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def chain(at: np.ndarray, place: np.ndarray, gram: int, slack: int, most: int) -> list[int]:
    """The postings, in turn, of a chain that covers most template words; of equal ones, that of the fewest words between.

    At most ``most`` words in a row are put in. Where they are more than ``slack``, at most as many template words, beyond a window
    of grams, stand between the two postings: a gap that leaves out more has no coverage left.
    """
    best = np.full(int(place.max()) + 1, -1.0)
    last = np.full(len(best), -1)
    back = []
    for k, (a, p) in enumerate(zip(at.tolist(), place.tolist())):
        score, before = float(gram), -1
        step = p - np.arange(p)
        put_in = a - at[last[:p]] - step
        # postings that overlap must be on one diagonal
        ok = (last[:p] >= 0) & (put_in <= most) & ((step >= gram) & (a - at[last[:p]] >= gram) | (put_in == 0)) & ((put_in <= slack) | (step <= slack + gram + WINDOW))
        if ok.any():
            scores = np.where(ok, best[:p] + np.minimum(step, gram) - np.abs(put_in) * 1e-7, -1.0)
            j = int(scores.argmax())
            if scores[j] > score:
                score, before = float(scores[j]), int(last[j])
        back.append(before)
        if score >= best[p]:
            best[p], last[p] = score, k
    out, k = [], int(last[best.argmax()])
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def align_chain(template: np.ndarray, codes: np.ndarray, at: np.ndarray, place: np.ndarray, low: int, high: int, gram: int, slack: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(Document words matched, stretches of the document that the match holds) of a chain of postings.

    Between two postings every word may match, but of more than the missing template words and the slack, only those
    next to the postings: chance words in the middle of what was put in are no part of the license.
    """
    pairs: list[int] = []
    held: list[tuple[int, int]] = []
    done_t, done_d, first = 0, None, True
    for a, p in [*zip(at.tolist(), place.tolist()), (None, len(template))]:
        gap = max(p - done_t, 0)
        near = gap + slack
        if first:
            between = np.arange(max(low, a - near), a)
        elif a is None:
            between = np.arange(done_d, min(high, done_d + near))
        else:
            between = np.arange(done_d, max(a, done_d))
            if len(between) > 2 * near:
                between = np.concatenate([between[:near], between[-near:]])
        if first:  # as near to the first posting as can be
            between = between[::-1]
            pairs += sorted(int(between[j]) for _, j in subsequence(template[:p][::-1], codes[between]))
        else:
            pairs += [int(between[j]) for _, j in subsequence(template[done_t:p], codes[between])]
        if a is not None:
            pairs += range(a if first else max(a, done_d), a + gram)
            done_t, done_d = p + gram, a + gram
        first = False
    found = np.array(pairs, np.int64)
    cut = np.flatnonzero(np.append(True, np.diff(found) > len(template) + 2 * slack))
    for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(found)]):
        held.append((int(found[i]), int(found[j - 1]) + 1))
    return found, held


def matches(index: Index, words: Words, least: float) -> list[tuple]:
    """(document, template, number of words matched, document words matched), places held by one match each.

    Where matches overlap, the one of most words stays, then that of greater coverage, the earlier, the smaller name.
    """
    found: dict[int, list] = {}
    hits = index.hits(words)
    rows = index.candidates(hits)
    for number in np.unique(rows[:, 1]).tolist():
        own = rows[rows[:, 1] == number]
        template = index.codes[number]
        together = max(1, CELLS // (len(template) * (2 * BAND + 1)))
        for a in range(0, len(own), together):
            part = own[a : a + together]
            low, high = words.first[part[:, 0]], words.first[part[:, 0] + 1]
            for document, pairs in zip(part[:, 0].tolist(), align(template, words.hash, part[:, 2], low, high)):
                if len(pairs) and len(pairs) >= least * len(template):
                    held = [(int(pairs[0, 1]), int(pairs[-1, 1]) + 1)]
                    found.setdefault(document, []).append((len(pairs), len(pairs) / len(template), number, pairs[:, 1], held))
    edge = np.flatnonzero(np.append(True, (np.diff(hits[:, :2], axis=0) != 0).any(1))).tolist() if len(hits) else []
    for a, b in zip(edge, [*edge[1:], len(hits)]):
        document, number = hits[a, :2].tolist()
        template = index.codes[number]
        low, high = int(words.first[document]), int(words.first[document + 1])
        if len(template) < index.gram or np.isin(template, words.hash[low:high]).sum() < least * len(template):
            continue
        slack = max(BAND, int(np.ceil((1 - least) * len(template))))
        at, place = hits[a:b, 2], hits[a:b, 3]
        for *_, other, _, held in found.get(document, []):
            if other == number:
                keep = ~((at >= held[0][0]) & (at < held[-1][1]))
                at, place = at[keep], place[keep]
        # copies that stand close first, so that parts of two copies are not taken for one; at last, any words between
        most, parts, all_at, all_place = slack, [], at, place
        while len(at):
            some = chain(at, place, index.gram, slack, most)
            pairs, held = align_chain(template, words.hash, at[some], place[some], low, high, index.gram, slack)
            if len(pairs) < least * len(template):
                if most > at[-1] - at[0]:
                    break
                most *= 4
                continue
            parts.append((pairs, held, at[some]))
            keep = np.ones(len(at), bool)
            for i, j in held:
                keep &= ~((at >= i) & (at < j))
            at, place = at[keep], place[keep]
        for k, (pairs, held, own) in enumerate(parts):
            # what no other copy holds, further off, belongs to the match if its own postings stay in
            if len(pairs) < len(template):
                keep = np.ones(len(all_at), bool)
                for i, j in (h for m, (_, other, _) in enumerate(parts) if m != k for h in other):
                    keep &= ~((all_at >= i) & (all_at < j))
                at, place = all_at[keep], all_place[keep]
                some = chain(at, place, index.gram, slack, high - low)
                longer = align_chain(template, words.hash, at[some], place[some], low, high, index.gram, slack)
                if len(longer[0]) > len(pairs) and all(any(i <= x < j for i, j in longer[1]) for x in own.tolist()):
                    pairs, held = longer
            found.setdefault(document, []).append((len(pairs), len(pairs) / len(template), number, pairs, held))
    out = []
    for document, options in found.items():
        first = int(words.first[document])
        taken = np.zeros(int(words.first[document + 1]) - first, bool)
        for size, _, number, at, held in sorted(options, key=lambda o: (-o[0], -o[1], int(o[3][0]), o[2])):
            if not any(taken[i - first : j - first].any() for i, j in held):
                for i, j in held:
                    taken[i - first : j - first] = True
                out.append((document, number, size, at))
    return sorted(out, key=lambda m: (m[0], int(m[3][0])))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each license found in a document: doc_id, license_id, n_matched (words), coverage (share of the
    template's words, ``least`` or more), start, end, and spans of the words matched in turn.

    ``start``, ``end`` and the spans count characters: ``text[start:end]`` is the match. A license that stands in a document
    several times has several rows; equal texts have equal rows. Null, empty and wordless texts have none, nor does
    a template without words. A null id stays null. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(Index(templates))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    place = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        index = shared.value
        for batch in batches:
            raw, offsets = string_parts(batch.column("text"))
            for a, b in chunks(offsets):
                words = words_of(raw, offsets[a : b + 1])
                begin = offsets[a : b + 1] - offsets[a]
                rows, values = [], []
                for document, number, size, at in matches(index, words, least):
                    cut = np.flatnonzero(np.append(True, np.diff(at) != 1))
                    edges = np.stack([words.start[at[cut]], words.end[at[np.append(cut[1:], len(at)) - 1]]], 1)
                    # bytes that begin a character, counted from the document's first byte
                    text = raw[offsets[a] + begin[document] : offsets[a] + int(edges[-1, 1])]
                    chars = np.append(0, np.cumsum((text & 0xC0) != 0x80))[edges - begin[document]]
                    rows.append(a + document)
                    values.append((index.names[number], size, size / len(index.codes[number]), int(chars[0, 0]), int(chars[-1, 1]), [{"start": s, "end": e} for s, e in chars.tolist()]))
                if rows:
                    kinds = [pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.list_(place)]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows)), *(pa.array(v, k) for v, k in zip(zip(*values), kinds))], ["doc_id", "license_id", "n_matched", "coverage", "start", "end", "spans"])

    return rows.mapInArrow(run, f"doc_id {id_type}, license_id string, n_matched bigint, coverage double, start bigint, end bigint, spans array<struct<start: bigint, end: bigint>>")

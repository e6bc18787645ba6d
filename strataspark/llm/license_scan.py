"""License scans: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

The word trigrams of every template are winnowed (of each two neighbours the smaller hash is kept) and put into an
inverted index from fingerprint to template and place. A document's own fingerprints are looked up in it; hits of one
template that lie near one diagonal are one candidate; for templates of over 64 words they have to be (4 * threshold - 3) / 4 of its words at
least, half of what any stretch has that reaches the threshold without inserted words. A candidate's template is aligned with the words around the
diagonal in a band, and is reported where the matched share of its words reaches the threshold.

Words are runs of letters, digits and non-ASCII characters, A-Z in lower case. Null and empty texts have no matches.
Equal texts have equal matches. Spans are code points, ends exclusive. Only the id and text columns are read."""
from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import license_data
from .common import documents, map_documents
from .decontaminate import word_hashes
from .hashing import mix

GRAM, WINDOW, MAX_TEMPLATE_WORDS, LONG = 3, 2, 1 << 20, 64
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Notices of public licenses; ``license_data`` has whole texts, more notices and SPDX identifiers.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "mit": "Released under the MIT License",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
}


@dataclass
class Index:
    """Fingerprints in order with their template and place, and the words of every template."""
    names: list[str]
    prints: np.ndarray
    template: np.ndarray
    place: np.ndarray
    words: list[np.ndarray]
    exact: np.ndarray


def fingerprints(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, place) of the winnowed trigrams of each text; a text of fewer words is one gram."""
    starts = np.cumsum(counts) - counts
    n = np.where(counts >= GRAM, counts - GRAM + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(counts)), n)
    place = np.arange(len(owner)) - (np.cumsum(n) - n)[owner]
    first, value = starts[owner] + place, np.zeros(len(owner), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(GRAM):
            has = counts[owner] > k if k else np.ones(len(owner), bool)
            value[has] = value[has] * np.uint64(0x9E3779B97F4A7C15) + words[first[has] + k] + np.uint64(k + 1)
    mix(value)
    last = np.r_[owner[1:] != owner[:-1], True] if len(owner) else np.zeros(0, bool)
    alone = last & (place == 0)
    # of the pair (i, i + 1) the smaller is kept, the right one where they tie
    right = ~last & (np.r_[value[1:], 0][:len(value)] <= value)
    keep = alone | (~last & ~right)
    keep[1:] |= right[:-1]
    return value[keep], owner[keep], place[keep]


def build_index(templates: dict[str, str], exact: dict[str, list[str]] | None = None) -> Index:
    """``exact`` has phrases by name, of which every word has to match."""
    entries = [(n, templates[n], False) for n in sorted(templates)] + [(n, t, True) for n, ts in sorted((exact or {}).items()) for t in ts]
    names = [n for n, _, _ in entries]
    words, counts = word_hashes([t for _, t, _ in entries])
    if len(words) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates of more than {MAX_TEMPLATE_WORDS} words: scan them in several sets")
    value, owner, place = fingerprints(words, counts)
    order = np.argsort(value, kind="stable")
    return Index(names, value[order], owner[order], place[order], np.split(words, np.cumsum(counts)[:-1]), np.array([e for _, _, e in entries], bool))


def align(template: np.ndarray, text: np.ndarray, diagonal: int, band: int) -> tuple[int, int, int]:
    """(matched words, first, end) of the best alignment of the whole template with a stretch of the text near a diagonal.

    Matches count 2, gaps and mismatches cost 1; free ends in the text. Rows are template words, columns the band."""
    width = 2 * band + 1
    score, match = np.zeros(width, np.int64), np.zeros(width, np.int64)
    place = np.arange(width)
    start = diagonal - band + place
    for i, word in enumerate(template):
        at = diagonal - band + i + np.arange(width)
        inside = (at >= 0) & (at < len(text))
        same = inside & (text[np.clip(at, 0, len(text) - 1)] == word)
        new, new_match, new_start = score + np.where(same, 2, -1), match + same, start.copy()
        new[~inside] = np.iinfo(np.int32).min
        skip = np.r_[score[1:], np.iinfo(np.int32).min] - 1  # the template word has no partner
        better = skip > new
        new, new_match, new_start = np.where(better, skip, new), np.where(better, np.r_[match[1:], 0], new_match), np.where(better, np.r_[start[1:], 0], new_start)
        reach = new + place  # a text word has no partner
        source = np.maximum.accumulate(np.where(reach == np.maximum.accumulate(reach), place, 0))
        new, new_match, new_start = new[source] - (place - source), new_match[source], new_start[source]
        score, match, start = new, new_match, new_start
    best = int(np.argmax(score))
    return int(match[best]), max(0, int(start[best])), min(len(text), max(0, diagonal - band + len(template) + best))


def long_matches(model: np.ndarray, own: np.ndarray, diagonal: np.ndarray, place: np.ndarray, likely: np.ndarray, enough: int, threshold: float) -> list[tuple[float, int, int, int]]:
    """(coverage, first, end, matched words) of a long template in one text, from the diagonal with the most hits on."""
    band = max(2, len(model) // 10)
    alive, out = likely.copy(), []
    names, need = np.unique(model, return_counts=True)
    while alive.any():
        at, n = np.unique(diagonal[alive], return_counts=True)
        d = int(at[n.argmax()])
        done = band
        if len(np.unique(place[np.abs(diagonal - d) <= 2 * band])) >= enough:
            low, high = max(0, d - 2 * band), max(0, min(len(own), d + len(model) + 2 * band))
            if np.array_equal(own[max(0, d):max(0, d) + len(model)], model) and d >= 0:
                out.append((1.0, d, d + len(model), len(model)))
                done = 2 * band
            else:
                # no alignment matches more than the words that both have
                have = np.searchsorted(np.sort(own[low:high]), names, "right") - np.searchsorted(np.sort(own[low:high]), names, "left")
                if np.minimum(have, need).sum() >= threshold * len(model):
                    matched, a, b = align(model, own, d, 2 * band)
                    inside = np.flatnonzero(np.isin(own[a:b], model))
                    if matched >= threshold * len(model) and len(inside):
                        out.append((matched / len(model), a + int(inside[0]), a + int(inside[-1]) + 1, matched))
                        done = 2 * band
        alive &= np.abs(diagonal - d) > done
    return out


def distinct(found: list[tuple]) -> list[tuple]:
    """Matches (name, coverage, first, end, matched words) that tell something of their own.

    A notice with wrong words goes where a complete match has more than half of its stretch; then, from the most matched
    words on, each match goes that has more than half of its stretch within one that stays."""
    inside = lambda x, y: 2 * (min(x[3], y[3]) - max(x[2], y[2])) > x[3] - x[2]
    whole = [x for x in found if x[1] == 1]
    found = [x for x in found if x[1] == 1 or x[4] > LONG or not any(inside(x, y) for y in whole)]
    kept: list[tuple] = []
    for x in sorted(set(found), key=lambda x: (-x[4], -x[1], x[3] - x[2], x[0], x[2])):
        if not any(inside(x, y) for y in kept):
            kept.append(x)
    return kept


def scan_block(texts: list, index: Index, threshold: float) -> list[list[tuple[str, float, int, int]]]:
    """(name, coverage, start, end) of the matches of each text, in order of start and name."""
    words, counts = word_hashes(texts)
    out: list[list[tuple[str, float, int, int]]] = [[] for _ in texts]
    value, owner, place = fingerprints(words, counts)
    low, high = np.searchsorted(index.prints, value, "left"), np.searchsorted(index.prints, value, "right")
    n = high - low
    hit = np.repeat(np.arange(len(n)), n)
    entry = low[hit] + np.arange(len(hit)) - (np.cumsum(n) - n)[hit]
    text, template, diagonal = owner[hit], index.template[entry], place[hit] - index.place[entry]
    order = np.lexsort((diagonal, template, text))
    starts = np.cumsum(counts) - counts
    last: tuple | None = None
    text, template, diagonal, place = text[order], template[order], diagonal[order], index.place[entry][order]
    sizes = np.array([len(w) for w in index.words], np.int64)
    # long templates: what can reach the threshold has that many hits near its diagonal
    enough = np.where(sizes > LONG, np.maximum(1, (sizes * (4 * threshold - 3) / 4).astype(np.int64)), 1) if len(sizes) else sizes
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (template[1:] != template[:-1])
    group, reach = np.cumsum(new) - 1, np.maximum(2, sizes // 10) * 2
    line = group * (1 << 40) + diagonal + (1 << 39)
    near = np.searchsorted(line, line + reach[template], "right") - np.searchsorted(line, line - reach[template], "left")
    likely = near >= enough[template]
    for i in np.flatnonzero(new & (sizes[template] > LONG) & ~index.exact[template]).tolist() if len(text) else []:
        t, k = int(text[i]), int(template[i])
        span = slice(i, i + int(np.searchsorted(group[i:], group[i], "right")))
        own = words[starts[t]:starts[t] + counts[t]]
        out[t] += [(index.names[k], *x) for x in long_matches(index.words[k], own, diagonal[span], place[span], likely[span], int(enough[k]), threshold)]
    likely &= (sizes[template] <= LONG) | index.exact[template]
    for t, k, d in zip(text[likely].tolist(), template[likely].tolist(), diagonal[likely].tolist()):
        model = index.words[k]
        if index.exact[k]:
            if d >= 0 and d + len(model) <= counts[t] and np.array_equal(words[starts[t] + d:starts[t] + d + len(model)], model):
                out[t].append((index.names[k], 1.0, d, d + len(model), len(model)))
            continue
        band = max(2, len(model) // 10)
        if last and last[:2] == (t, k) and d - last[2] <= band:
            continue
        last = (t, k, d)
        own = words[starts[t]:starts[t] + counts[t]]
        matched, a, b = align(model, own, d, 2 * band)
        while a < b and own[a] not in model:
            a += 1
        while b > a and own[b - 1] not in model:
            b -= 1
        if matched >= threshold * len(model) and b > a:
            out[t].append((index.names[k], matched / len(model), a, b, matched))
    for t, found in enumerate(out):
        if found:
            spans = [m.span() for m in WORD.finditer(texts[t])]
            best: dict = {}
            for name, coverage, a, b, _ in distinct(found):
                key = (spans[a][0], spans[b - 1][1], name)
                best[key] = max(coverage, best.get(key, 0.0))
            out[t] = [(name, c, a, b) for (a, b, name), c in sorted(best.items())]
    return out


def licenses(docs: DataFrame, templates: dict[str, str] | None = None, *, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """Rows (doc_id, n_licenses, matches) for the given templates, or for all of ``license_data`` and TEMPLATES: matches are ``name:coverage:start:end``, comma-joined in order of start."""
    own = templates is None
    index = build_index({**license_data.texts(), **license_data.notices(), **TEMPLATES}, license_data.exact()) if own else build_index(templates)
    ids = license_data.known() if own else {}
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(block: pa.RecordBatch) -> dict:
        found = scan_block(block.column(1).to_pylist(), index, threshold) if index.names else [[] for _ in range(block.num_rows)]
        if own:
            found = [sorted(f + license_data.spdx(t, ids), key=lambda x: (x[2], x[3], x[0])) for f, t in zip(found, block.column(1).to_pylist())]
        return {doc_id: block.column(0), "n_licenses": [len({x[0] for x in f}) for f in found], "matches": [",".join(f"{n}:{c:.4f}:{a}:{b}" for n, c, a, b in f) for f in found]}
    return map_documents(documents(docs, doc_id, text), text, f"`{doc_id}` {kind}, n_licenses long, matches string", run)

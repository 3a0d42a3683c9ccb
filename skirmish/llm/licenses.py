"""Fuzzy search for short license notices.

A notice that occurs with at most k edits holds one of its k + 1 parts unchanged (pigeonhole). The parts are the seeds:
they are found as plain substrings, and around each the regex library's bounded-error matching checks the whole notice.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .common import id_text, map_texts

#: Phrases whose exact places count as base, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further short notices (normalised words: names, headers and first lines), with their labels.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "mit no attribution": "mit-0",
    "licensed under the apache license version 2 0": "apache",
    "apache software license": "apache",
    "gnu general public license as published by the free software foundation": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "bsd 2 clause license": "bsd",
    "bsd 3 clause license": "bsd",
    "bsd 4 clause license": "bsd",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "eclipse distribution license": "edl",
    "common public license": "cpl",
    "common development and distribution license": "cddl",
    "european union public licence": "eupl",
    "microsoft public license": "ms-pl",
    "microsoft reciprocal license": "ms-rl",
    "creative commons attribution": "cc",
    "creative commons zero": "cc0",
    "cc0 1 0 universal": "cc0",
    "licensed under cc by": "cc",
    "open data commons": "odc",
    "open database license": "odbl",
    "boost software license": "boost",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "isc license": "isc",
    "zlib libpng license": "zlib",
    "this software is provided as is without any express or implied warranty": "zlib",
    "python software foundation license": "psf",
    "sil open font license": "ofl",
    "the artistic license": "artistic",
    "academic free license": "afl",
    "open software license": "osl",
    "server side public license": "sspl",
    "business source license": "busl",
    "elastic license 2 0": "elastic",
    "blue oak model license": "blueoak",
    "universal permissive license": "upl",
    "university of illinois ncsa open source license": "ncsa",
    "postgresql license": "postgresql",
    "the beerware license": "beerware",
    "mulan permissive software license": "mulan",
    "cecill free software license agreement": "cecill",
    "ibm public license": "ipl",
    "sun public license": "spl",
    "q public license": "qpl",
    "w3c software notice and license": "w3c",
    "x11 license": "x11",
}

_LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))
_WORD = bytes(b if 0x30 <= b < 0x3A or 0x61 <= b < 0x7B or b >= 0x80 else 0x20 for b in range(256))
_state: dict = {}


def edits(phrase: str) -> int:
    """How many edits a notice may have: one in twelve characters, one at least."""
    return max(1, len(phrase) // 12)


def pattern(phrase: str) -> str:
    """The phrase with bounded errors between word bounds. In a notice of less than 24 characters an edit in a short word
    makes another word of it (mit, omit), so words of up to four characters stand unchanged there."""
    k, fixed = edits(phrase), []
    words = phrase.split(" ")
    if len(phrase) < 24:
        while words and len(words[0]) <= 4:
            fixed.append(words.pop(0))
    lead = "".join(f"{w} " for w in fixed)
    return rf"(?e)(?<= ){lead}(?:{' '.join(words)}){{e<={k}}}(?= )" if words else rf"(?<= ){lead.strip()}(?= )"


def normal(text: str) -> str:
    """The words of a text, lower-cased in A-Z only, parted and framed by single spaces."""
    words = text.encode().translate(_LOWER).translate(_WORD).split()
    return (b" " + b" ".join(words) + b" ").decode() if words else ""


@dataclass
class Notice:
    phrase: str
    label: str
    base: bool

    def __post_init__(self):
        import regex

        k, n = edits(self.phrase), len(self.phrase)
        at = [n * i // (k + 1) for i in range(k + 2)]
        self.k = k
        self.seeds = [(self.phrase[a:b], a) for a, b in zip(at, at[1:], strict=False)]
        # words at both ends must begin and end where the match does; of a match the best form near its place is taken
        self.fuzzy = regex.compile(pattern(self.phrase))


def notices(extra: dict[str, str] | None = None) -> list[Notice]:
    return [Notice(p, v, True) for p, v in BASE.items()] + [Notice(p, v, False) for p, v in (NOTICES | (extra or {})).items()]


def places(text: str, seed: str) -> list[int]:
    out, at = [], text.find(seed)
    while at >= 0:
        out.append(at)
        at = text.find(seed, at + 1)
    return out


def occurrences(x: Notice, text: str, a: int, b: int) -> list[tuple[Notice, int, int, int]]:
    """(notice, start, end, edits) of a notice within text[a:b]: every exact place, also where matches touch, and in the
    gaps between those, from left to right, the matches with edits."""
    exact = [a + p + 1 for p in places(text[a:b], f" {x.phrase} ")]
    found = [(x, p, p + len(x.phrase), 0) for p in exact]
    # a gap begins and ends with the space that frames its words
    for lo, hi in zip([a, *(p + len(x.phrase) for p in exact)], [*exact, b], strict=True):
        for m in x.fuzzy.finditer(text, lo, hi):
            if m.start() < m.end():
                found.append((x, m.start(), m.end(), sum(m.fuzzy_counts)))
    return found


def search(text: str, known: list[Notice]) -> list[tuple[Notice, int, int, int]]:
    """(notice, start, end, edits) of all notices in a normalised text, in order. Only windows around seeds are searched,
    overlapping ones as one: a match holds a seed, so it lies in a window."""
    if not text:
        return []
    found = []
    seeds: dict[str, list[int]] = {}
    for x in known:
        windows = []
        for seed, offset in x.seeds:
            if seed not in seeds:
                seeds[seed] = places(text, seed)
            windows += [(max(0, p - offset - x.k - 1), min(len(text), p - offset + len(x.phrase) + x.k + 1)) for p in seeds[seed]]
        if not windows:
            continue
        done: list[tuple[int, int]] = []
        for a, b in sorted(windows):
            if done and a <= done[-1][1]:
                done[-1] = (done[-1][0], max(b, done[-1][1]))
            else:
                done.append((a, b))
        for a, b in done:
            found += occurrences(x, text, a, b)
    return sorted(found, key=lambda f: (f[1], f[2], f[0].phrase))


def license_scan(docs: DataFrame, extra: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its words, labels and spans of license notices.

    Columns: doc_id, n_words, n_base (exact places of the base phrases), first_word and last_word (their smallest and
    largest first word, null without any), base_labels and labels (distinct, sorted, joined by commas; empty without
    any), score (1 for an exact place, less by the share of edited characters, 0 without any) and spans (label, start
    and end word, edits). Null and empty texts have no words; texts of any length are searched whole; of notices at the same place all
    are reported, by place, then phrase; repeated rows and null ids are all returned; other columns of ``docs`` are not read;
    an empty table gives no rows.
    """

    def run(cols: dict) -> dict:
        key = tuple(sorted((extra or {}).items()))
        known = _state.get(key) or _state.setdefault(key, notices(extra))
        out: dict[str, list] = defaultdict(list)
        for doc, raw in zip(cols["doc_id"], cols["text"], strict=True):
            text = normal(raw)
            hits = search(text, known)
            spans, at, words = [], 0, 0
            for x, start, end, e in hits:
                words += text.count(" ", at, start)  # the word that starts here has as many before it
                at = start
                spans.append({"label": x.label, "first_word": words - 1, "last_word": words - 1 + text.count(" ", start, end), "edits": e})
            exact = [s["first_word"] for s, h in zip(spans, hits, strict=True) if h[0].base and h[3] == 0]
            row = {
                "doc_id": doc,
                "n_words": max(0, text.count(" ") - 1),
                "n_base": len(exact),
                "first_word": min(exact, default=None),
                "last_word": max(exact, default=None),
                "base_labels": ",".join(sorted({h[0].label for h in hits if h[0].base and h[3] == 0})),
                "labels": ",".join(sorted({h[0].label for h in hits})),
                "score": max((1 - h[3] / len(h[0].phrase) for h in hits), default=0.0),
                "spans": spans,
            }
            for k, v in row.items():
                out[k].append(v)
        return out

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,last_word:long,edits:int>>"
    return map_texts(id_text(docs, id_col, text_col), run, schema)

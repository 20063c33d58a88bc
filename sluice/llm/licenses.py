"""Fuzzy search for short licence notices.

Texts are lower-cased (A-Z) and cut into words; the base labels are phrases whose
words stand consecutively. The method then looks for whole notices with up to ``k``
edits: a notice is split into k + 1 pieces, of which at least one must occur
unchanged (pigeonhole). One pass over the normalised text (words joined by one space)
finds the pieces of all notices; each occurrence gives a window, and the regex
library's bounded-error matching decides on the window and reports span and edits.
Occurrences without edits come first and need no matching; windows are taken from left
to right, and matches of one notice don't overlap. A notice that names its licence
counts only if the name stands in its place, with as few edits as that name allows, and
isn't a word that names another licence.

Edits count bytes of UTF-8. Null and empty texts have no words, no labels and
score 0. Whole texts are searched, whatever their length; no shuffle happens. Matches
at one place by several notices (ties) are all reported. Repeated rows get equal
results, other columns are left out, and an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.shared import small_batches, text_bounds

#: Base phrases: words and label.
PHRASES = (((b"mit", b"license"), "mit"), ((b"apache", b"license"), "apache"), ((b"general", b"public", b"license"), "gpl"))

#: Notices that are searched with edits: label, words, most edits, and the words that name the licence with their own most edits.
NOTICES = (
    ("mit", "released under the mit license", 3, "mit", 1),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", 6),
    ("apache", "licensed under the apache license", 3, "apache", 1),
    ("apache-2.0", "licensed under the apache license version 2 0", 3, "apache license version 2 0", 0),
    ("apache-1.1", "licensed under the apache license version 1 1", 3, "apache license version 1 1", 0),
    ("gpl", "licensed under the gnu general public license", 4, "general", 1),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation", 6, "general", 1),
    ("lgpl", "the gnu lesser general public license", 3, "lesser", 1),
    ("agpl", "the gnu affero general public license", 3, "affero", 1),
    ("cc-by", "licensed under cc by 4 0", 1, "by", 0),
    ("cc-by-sa", "licensed under cc by sa 4 0", 2, "sa", 0),
    ("cc-by-nc", "licensed under cc by nc 4 0", 2, "nc", 0),
    ("cc-by-nd", "licensed under cc by nd 4 0", 2, "nd", 0),
    ("cc0", "dedicated to the public domain under cc0", 4, "cc0", 0),
    ("bsd", "released under the bsd license", 3, "bsd", 0),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 6),
    ("isc", "released under the isc license", 3, "isc", 0),
    ("mpl", "subject to the terms of the mozilla public license", 4, "mozilla", 1),
    ("epl", "under the terms of the eclipse public license", 4, "eclipse", 1),
    ("unlicense", "this is free and unencumbered software released into the public domain", 5),
    ("mit", "spdx license identifier mit", 2, "mit", 0),
    ("apache-2.0", "spdx license identifier apache 2 0", 2, "apache 2 0", 0),
    ("gpl", "spdx license identifier gpl", 2, "gpl", 0),
    ("lgpl", "spdx license identifier lgpl", 2, "lgpl", 0),
    ("agpl", "spdx license identifier agpl", 2, "agpl", 0),
    ("bsd", "spdx license identifier bsd", 2, "bsd", 0),
    ("isc", "spdx license identifier isc", 2, "isc", 0),
    ("mpl", "spdx license identifier mpl", 2, "mpl", 0),
    ("epl", "spdx license identifier epl", 2, "epl", 0),
    ("cc0", "spdx license identifier cc0", 2, "cc0", 0),
    ("unlicense", "spdx license identifier unlicense", 2, "unlicense", 0),
)

#: Words that name a licence, what sets one apart from its kin, and plain words that are one edit from a short name; none of them is a name misspelt.
NAMES = frozenset(b"mit mit0 bsd isc gpl lgpl agpl mpl epl eupl cddl cpl apl apsl afl osl ofl wtfpl zlib x11 ncsa nc nd sa by cc0 apache apple artistic boost eclipse mozilla general lesser affero library unlicense bit kit fit sit hit pit wit lit git nit mix mid min mat met emit omit".split())

#: Each byte of a word with A-Z mapped to a-z, every other byte a space.
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

MATCHES = "array<struct<label:string, notice:int, first_word:bigint, last_word:bigint, edits:int>>"


@dataclass(frozen=True)
class Notice:
    label: str
    text: bytes
    edits: int
    pieces: tuple[tuple[int, bytes], ...]
    pattern: regex.Pattern
    name: bytes
    name_edits: int

    @staticmethod
    def of(label: str, words: str, edits: int, name: str = "", name_edits: int = 0) -> Notice:
        text = words.encode()
        cuts = [round(k * len(text) / (edits + 1)) for k in range(edits + 2)]
        pieces = tuple((a, text[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True))
        return Notice(label, text, edits, pieces, regex.compile(rb"(?e)(?:" + regex.escape(text, special_only=True) + rb"){e<=%d}" % edits), name.encode(), name_edits)


class Finder:
    """The notices and one automaton of all their pieces."""

    def __init__(self, notices: tuple[tuple, ...]) -> None:
        self.notices = tuple(Notice.of(*x) for x in notices)
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, notice in enumerate(self.notices):
            for offset, piece in notice.pieces:
                # where the window begins, seen from the piece's last byte
                seeds.setdefault(piece.decode("latin-1"), []).append((k, offset + len(piece) - 1 + notice.edits))
        self.automaton = ahocorasick.Automaton()
        for piece, of in seeds.items():
            self.automaton.add_word(piece, of)
        self.automaton.make_automaton()
        self.known: dict[tuple[int, bytes], tuple[tuple[int, int, int], ...]] = {}

    def windows(self, text: bytes) -> dict[int, list[int]]:
        """Of each notice with a piece in the text: where its windows begin, ascending."""
        out: dict[int, set[int]] = {}
        for end, of in self.automaton.iter(text.decode("latin-1")):
            for k, back in of:
                out.setdefault(k, set()).add(end - back)
        return {k: sorted(x) for k, x in out.items()}

    def spans(self, text: bytes, k: int, starts: list[int]) -> Iterator[tuple[int, int, int]]:
        """start, end and edits of the matches of a notice, left to right."""
        notice = self.notices[k]
        size, exact, at = len(notice.text), [], text.find(notice.text)
        while at >= 0:
            exact.append(at)
            at = text.find(notice.text, at + size)
        done, i = 0, 0
        for a in [*starts, len(text)]:
            while i < len(exact) and exact[i] <= max(a + 2 * notice.edits, done):
                if exact[i] >= done:
                    yield exact[i], exact[i] + size, 0
                    done = exact[i] + size
                i += 1
            low, high = max(a, done), min(a + size + 2 * notice.edits, exact[i] if i < len(exact) else len(text))
            if high - low < size - notice.edits:
                continue
            # a name is judged by the whole words at both ends
            left, right = text.rfind(b" ", 0, low) + 1, text.find(b" ", high)
            for x, y, edits in self._matched(k, text[left : right if right >= 0 else len(text)], low - left, high - left):
                yield x + left, y + left, edits
                done = y + left

    def _matched(self, k: int, part: bytes, a: int, b: int) -> tuple[tuple[int, int, int], ...]:
        """Matches in part[a:b]; texts repeat their notices, so the last answers are kept."""
        key = (k, b"%d,%d," % (a, b) + part)
        if key not in self.known:
            if len(self.known) >= 10_000:
                self.known.clear()
            self.known[key] = tuple((m.start(), m.end(), sum(m.fuzzy_counts)) for m in _found(part, a, b, self.notices[k]))
        return self.known[key]

    def matches(self, text: bytes) -> list[dict]:
        """Where the notices stand in normalised text: words (from 0) of the span, and edits."""
        windows = self.windows(text)
        if not windows:
            return []
        spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
        out = []
        for k in sorted(windows):
            for a, b, edits in self.spans(text, k, windows[k]):
                first, last = np.searchsorted(spaces, [a + (text[a] == 32), max(a + 1, b - 1)]).tolist()
                out.append({"label": self.notices[k].label, "notice": k, "first_word": first, "last_word": max(first, last), "edits": edits})
        return out


def _edits_upto(pattern: bytes, text: bytes) -> list[int]:
    """The edits between the pattern and text[:j], for each j."""
    row = list(range(len(text) + 1))
    for i, x in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row


def is_named(text: bytes, start: int, end: int, notice: Notice) -> bool:
    """Whether the name of the notice's licence stands in its place in text[start:end]."""
    if not notice.name or text[start:end] == notice.text:
        return True
    span, at = text[start:end], (b" " + notice.text + b" ").index(b" " + notice.name + b" ")
    before = _edits_upto(notice.text[:at], span)
    after = _edits_upto(notice.text[at + len(notice.name) :][::-1], span[::-1])[::-1]
    for i in range(len(span)):
        for j in range(i + max(1, len(notice.name) - notice.name_edits), min(len(span), i + len(notice.name) + notice.name_edits) + 1):
            if before[i] + after[j] <= notice.edits:
                own = _edits_upto(notice.name, span[i:j])[-1]
                if own <= notice.name_edits and before[i] + own + after[j] <= notice.edits:
                    words = text[text.rfind(b" ", 0, start + i + 1) + 1 : (text + b" ").index(b" ", start + j - 1)].split()
                    own_words = notice.name.split()
                    # a name that allows no edit must be whole words
                    if not any(w in NAMES and w not in own_words for w in words) and (notice.name_edits or words == own_words):
                        return True
    return False


def _found(text: bytes, a: int, b: int, notice: Notice) -> Iterator[regex.Match]:
    while m := notice.pattern.search(text, a, b):
        named = is_named(text, m.start(), m.end(), notice)
        if named:
            yield m
        a = m.end() if named else m.start() + 1


def _scan(notices: tuple[tuple, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(notices)
        for batch in small_batches(batches, "text"):
            data, bounds = text_bounds(batch.column(batch.schema.get_field_index("text")))
            raw = data.tobytes().translate(_TO_WORDS)
            out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches")}
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                words = raw[a:b].split()
                text = b" ".join(words)
                starts, base = [], set()
                if b"license" in text:
                    for i, w in enumerate(words):
                        if w == b"license":
                            for phrase, label in PHRASES:
                                if i + 1 >= len(phrase) and tuple(words[i + 1 - len(phrase) : i + 1]) == phrase:
                                    starts.append(i + 1 - len(phrase))
                                    base.add(label)
                found = finder.matches(text)
                best = max((1 - m["edits"] / len(finder.notices[m["notice"]].text) for m in found), default=0.0)
                for k, v in (
                    ("n_words", len(words)), ("n_base", len(starts)), ("first_word", min(starts, default=None)), ("last_word", max(starts, default=None)),
                    ("base_labels", ",".join(sorted(base))), ("labels", ",".join(sorted(base | {m["label"] for m in found}))), ("score", 1.0 if base else best), ("matches", found),
                ):
                    out[k].append(v)
            kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "matches": pa.list_(pa.struct([("label", pa.string()), ("notice", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32())]))}
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), *(pa.array(out[k], t) for k, t in kinds.items())], names=["doc_id", *kinds])

    return run


def scan_licenses(docs: DataFrame, notices: tuple[tuple, ...] = NOTICES) -> DataFrame:
    """For each row of ``docs`` (doc_id, text) its base and fuzzy licence labels with spans."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches {MATCHES}"
    return docs.mapInArrow(_scan(notices), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))

import hashlib
import io
import json
import re
import struct
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from samples import COLUMNS, documents, frame

from sluice.llm import embeddings_classifier, features, learn, licenses, packing, quality_rules, warc

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


# --- archives


def pages(n=60):
    rows = [(i, f"http://h/{i} x" if i % 7 else None, f"<html><body><p>Common header of the page</p>{'body ' * (i % 9)}{i}</body></html>") for i in range(n)]
    rows += [(n + i, "u", "<p>" + "same " * 40) for i in range(5)] + [(n + 10, "u", "short"), (n + 11, "u", "short"), (n + 12, "u", ""), (n + 13, None, None)]
    rows += [(None, "u", "<p>" + "same " * 40), (n, "u", "<p>" + "same " * 40), (n + 14, "u", "é" * 300_000), (n + 15, "u", "\r\n\r\nWARC/1.1\r\n" * 30)]
    return rows


def test_archives_round_trip(spark, tmp_path):
    rows = pages()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, first int").repartition(3)
    archives = warc.write_archives(df)
    got = sorted((tuple(r) for r in warc.read_archives(archives, payloads=False).drop("url", "payload").collect()), key=str)
    want = []
    for page, _, html in rows:
        raw = (html or "").encode()
        same = [p for p, _, h in rows if h == html and p is not None]
        revisit = len(raw) >= 100 and same and page != min(same)
        want.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", min(same) if revisit else None))
    assert got == sorted(want, key=str)
    full = {r["page_id"]: r for r in warc.read_archives(archives).where("record_type = 'response'").collect()}
    files = {r["name"]: r["bytes"] for r in warc.export_archives(archives, f"file://{tmp_path}/out").collect()}
    assert files == {p.name: p.stat().st_size for p in (tmp_path / "out").iterdir()} and files
    assert sum(len(list(warc.unpack_archive(p.read_bytes()))) for p in (tmp_path / "out").iterdir()) == len(rows)
    assert full[1]["payload"] == rows[1][2].encode() and full[1]["url"] == "http://h/1%20x" and full[0]["url"] is None


def test_archive_is_a_dictionary_frame_and_a_frame_per_record():
    records = [b"WARC/1.1\r\nX: %d\r\nContent-Length: 40\r\n\r\n" % i + (b"some payload that repeats %08d....." % i).ljust(40)[:40] + b"\r\n\r\n" for i in range(400)]
    data = warc.pack_archive(records)
    magic, size = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D
    dictionary, at, found = zstandard.ZstdCompressionDict(data[8 : 8 + size]), 8 + size, []
    while at < len(data):
        d = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        found.append(d.decompress(data[at:]))
        at = len(data) - len(d.unused_data)
    assert found == records and dictionary.dict_id()
    with pytest.raises(ValueError):
        list(warc.unpack_archive(zstandard.compress(b"nothing of the kind\r\n")))
    assert list(warc.unpack_archive(warc.pack_archive([]))) == []
    assert io.BytesIO(data).read(4) == struct.pack("<I", magic)


@pytest.mark.parametrize("size", [0, 10, 2_000, 100_000, 3_000_000])
@pytest.mark.parametrize("n", [1, 2, 15, 16, 200])
def test_every_archive_has_a_dictionary(n, size):
    if n * size > 40_000_000:
        n = 13
    draw = np.random.default_rng(n + size)
    words = [bytes(draw.integers(97, 123, 6, dtype=np.uint8)) for _ in range(500)]
    payloads = [b" ".join(words[j] for j in draw.integers(0, 500, size // 7)) for _ in range(n)]
    records = [warc._record(i, "http://h/", p, hashlib.sha256(p).hexdigest(), None, "2020-01-01T00:00:00Z") for i, p in enumerate(payloads)]
    data = warc.pack_archive(records)
    magic, length = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D and 200 < length <= max(256, min(48 << 10, sum(map(len, records)) // 16))
    assert [(int(http["Content-Length"]), p) for _, http, p in warc.unpack_archive(data)] == [(len(p), p) for p in payloads]
    # the frames need the dictionary
    with pytest.raises(zstandard.ZstdError):
        found = zstandard.ZstdDecompressor().decompressobj().decompress(data[8 + length :])
        if found != records[0]:
            raise zstandard.ZstdError("other bytes")


def test_no_pages(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(df)).count() == 0


# --- licences


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def substring_edits(pattern, text):
    """The fewest edits with which the pattern stands in the text, up to each place."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(pattern, 1):
        last, row = row, [row[0] + 1, *row[1:]]
        for j, y in enumerate(text, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row


def stands(notice, text):
    """Whether the notice stands in the text with its edits, and its name in its place with its own."""
    if not notice.name or min(substring_edits(notice.text, text)) > notice.edits:
        return min(substring_edits(notice.text, text)) <= notice.edits
    at = (b" " + notice.text + b" ").index(b" " + notice.name + b" ")
    before, after = notice.text[:at], notice.text[at + len(notice.name) :]
    row, named = substring_edits(before, text), [99] * (len(text) + 1)
    own = set(notice.name.split())
    for i in range(len(text)):
        for j in range(i + max(1, len(notice.name) - notice.name_edits), min(len(text), i + len(notice.name) + notice.name_edits) + 1):
            e = edits(notice.name, text[i:j]) if row[i] <= notice.edits else 99
            a, b = i, j
            while a > 0 and text[a - 1] != 32 and text[a : a + 1] != b" ":
                a -= 1
            while b < len(text) and text[b] != 32 and text[b - 1 : b] != b" ":
                b += 1
            words = text[a:b].split()
            if e <= notice.name_edits and not any(w in licenses.NAMES and w not in own for w in words) and (notice.name_edits or words == notice.name.split()):
                named[j] = min(named[j], row[i] + e)
    for x in after:
        last, named = named, [named[0] + 1, *named[1:]]
        for j, y in enumerate(text, 1):
            named[j] = min(last[j] + 1, named[j - 1] + 1, last[j - 1] + (x != y))
    return min(named) <= notice.edits


def test_licences(spark):
    rows = documents()
    extra = [
        "Released under the MIT License.", "released undr the mlt license", "MIT-license and APACHE_LICENSE mit  License", "This is the GNU General Public License, version 3",
        "licensed under cc by-nc 4.0", "licensed by us under cc", "permission is hereby granted, free of charge, to any person obtaining a copy of this sofware", "license", "the general\npublic\tlicense mitt license",
    ]
    rows += [(1000 + i, t, "en", "s", len(t)) for i, t in enumerate(extra)]
    compiled = [licenses.Notice.of(*x) for x in licenses.NOTICES]
    got = {(r["doc_id"], r["n_words"]): r for r in licenses.scan_licenses(frame(spark, rows, clashes=True)).collect()}
    for doc, text, *_ in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        base, starts = set(), []
        for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
            p = phrase.split()
            at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            starts += at
            base |= {label} if at else set()
        r = got[doc, len(w)]
        assert (r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)))
        if len(w) < 60:  # the fuzzy labels, by a full distance table
            norm = " ".join(w).encode()
            fuzzy = {n.label for n in compiled if stands(n, norm)}
            assert set(filter(None, r["labels"].split(","))) == base | fuzzy
            for m in r["matches"]:
                span = " ".join(w[m["first_word"] : m["last_word"] + 1]).encode()
                assert min(substring_edits(compiled[m["notice"]].text, span)) <= m["edits"] <= compiled[m["notice"]].edits
        assert 0 <= r["score"] <= 1
    assert got[1001, 5]["labels"] == "mit" and got[1001, 5]["base_labels"] == ""
    assert licenses.scan_licenses(spark.createDataFrame([], COLUMNS)).count() == 0


def labels_of(spark, texts):
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(frame(spark, rows)).collect()}
    assert all((got[i]["score"] > 0) == bool(got[i]["labels"]) and bool(got[i]["matches"] or got[i]["base_labels"]) == bool(got[i]["labels"]) for i in got)
    return {t: got[i]["labels"] for i, t in enumerate(texts)}


def test_notices_of_other_licences_get_no_label(spark):
    texts = {f"Released under the {x} license.": "" for x in ("GPL", "new", "MPL", "X11", "zlib", "bit", "kit", "Boost")}
    texts |= {"licensed under the apple license, version 2.0": "", "subject to the terms of the motorola public license": "", "under the terms of the common public license": "", "SPDX-License-Identifier: WTFPL": ""}
    assert labels_of(spark, texts) == texts


def test_near_notices_are_told_apart(spark):
    texts = {
        "Licensed under CC BY-SA 4.0": "cc-by-sa", "Licensed under CC BY-ND 4.0": "cc-by-nd", "licensed under cc by-nc 4.0": "cc-by-nc", "licensed undr cc by-nc 4.0": "cc-by-nc", "licensed under cc by 4.0": "cc-by",
        "released under the bsd license": "bsd", "released under the isc license": "isc", "released under the mit license": "mit", "releasd under the mlt license": "mit", "released under themit license": "mit", "released under the m1t licence": "mit",
        "licensed under the apache license, version 2.0": "apache,apache-2.0", "licensed under the apache license, version 1.1": "apache,apache-1.1", "licenced under the apachee license version 2.0": "apache", "licensd under the apache license version 2.0": "apache,apache-2.0", "licensed under the apache license version 1.0": "apache",
        "licensed under the gnu genral public licence": "gpl", "licensed under the gnu lesser general public licence": "lgpl", "licensed under the gnu affero general public licence": "agpl",
        "subject to the terms of the mozila public licence": "mpl", "under the terms of the eclipse public license": "epl", "SPDX-License-Identifier: MIT": "mit", "SPDX-License-Identifier: Apache-2.0": "apache-2.0", "SPDX-License-Identifier: CC0-1.0": "cc0",
        "SPDX-License-Identifier: LGPL-2.1": "lgpl", "released under the bsd license released under the mlt license": "bsd,mit", "licensed under cc by sa 4.0 licensed under cc by nc 4 0": "cc-by-nc,cc-by-sa",
    }
    assert labels_of(spark, texts) == texts


def test_long_texts_of_notices_take_linear_time():
    finder = licenses.Finder(licenses.NOTICES)
    for notice in (b"released under the mit license ", b"relesed under the mlt license ", b"released under the bit license or another one "):
        took = []
        for n in (10_000, 160_000):
            began = time.process_time()
            found = finder.matches((notice * n).rstrip())
            took.append(time.process_time() - began)
            assert len(found) == (0 if b"bit" in notice else n) and all(m["edits"] == (2 if b"mlt" in notice else 0) for m in found)
            words = len(notice.split())
            assert [m["first_word"] for m in found[:3]] == [0, words, 2 * words][: len(found[:3])]
        assert took[1] < 30 * took[0] + 2 and took[1] < 40


# --- packing


def path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_ids_are_the_tokenizers_own():
    from tokenizers import Tokenizer

    own, encoder = Tokenizer.from_file(path()), packing.Encoder(path())
    odd = ["a  b", " lead", "trail ", "x \n y", "a\x1cb c", "tab\tx", "a <|endoftext|> b", "nb sp x", "don't we'll", "é́ 12,5 3.14", "\r\n foo", "日本語 ﬁ", "🙂🙂", "퟿", "'S", "x" * 3000]
    for text in [t or "" for _, t, *_ in documents()] + odd:
        assert encoder.encode(text).tolist() == own.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("blank", [" ", "\n"])
def test_long_white_space_is_encoded_and_packed(spark, blank):
    from tokenizers import Tokenizer

    own, n = Tokenizer.from_file(path()), 5_000_000
    rows = [(1, blank * n + "a", None, None, 0), (2, "b" + blank * n, None, None, 0), (3, "a" + blank * 99_999 + "b", None, None, 0), (4, "a" + blank * 100_000 + "b", None, None, 0)]
    got = packing.pack(frame(spark, rows).select("doc_id", "text"), path()).toPandas()
    for doc, text, *_ in rows:
        ids = np.array([*own.encode(text, add_special_tokens=False).ids, 0], "<u4")
        pieces = got[got.doc_id == doc].sort_values("start")
        assert pieces.length.sum() == len(ids) == pieces.doc_tokens.iloc[0]
        assert all(x.ids_crc32 == zlib.crc32(ids[x.start : x.start + x.length].tobytes()) for x in pieces.itertuples())


@pytest.mark.parametrize("change", ["prefix", "merges", "normalizer", "none"])
def test_other_tokenizer_files_give_their_own_ids(tmp_path, change):
    from tokenizers import Tokenizer

    with open(path(), encoding="utf-8") as f:
        file = json.load(f)
    if change == "prefix":
        file["pre_tokenizer"]["add_prefix_space"] = True
    elif change == "merges":
        file["model"]["merges"][:400] = file["model"]["merges"][399::-1]
    elif change == "normalizer":
        file["normalizer"] = {"type": "Lowercase"}
    other = str(tmp_path / "other.json")
    with open(other, "w", encoding="utf-8") as f:
        json.dump(file, f)
    own, encoder = Tokenizer.from_file(other), packing.Encoder(other)
    assert (encoder.fast is None) == (change != "none")
    for text in ["The cat and the hat, in 1999", " lead", "é 日本"]:
        assert list(encoder.encode(text)) == own.encode(text, add_special_tokens=False).ids


def test_pieces_hold_every_id_once(spark):
    from tokenizers import Tokenizer

    own, rows = Tokenizer.from_file(path()), documents()
    got = packing.pack(frame(spark, rows, clashes=True), path()).toPandas()
    ids = {}
    for d, t, *_ in rows:
        ids.setdefault(d, np.array([*own.encode(t or "", add_special_tokens=False).ids, 0], "<u4"))
    copies = Counter(d for d, *_ in rows)
    for x in got.itertuples():
        doc = None if x.doc_id != x.doc_id else int(x.doc_id)
        assert x.doc_tokens == len(ids[doc]) and x.ids_crc32 == zlib.crc32(ids[doc][x.start : x.start + x.length].tobytes()) and x.length > 0
    spans = got.groupby(got.doc_id.fillna(-1)).length.sum()
    assert {int(k): v for k, v in spans.items()} == {-1 if d is None else d: len(ids[d]) * copies[d] for d in ids}
    for _, s in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 1024
    assert packing.pack(spark.createDataFrame([], COLUMNS), path()).count() == 0


def cost_of(ends, penalty, size, powers):
    """Cost of windows that end at these places."""
    total, at = 0.0, 0
    for e in ends:
        n = e - at
        total += penalty[e] + packing.WINDOW_COST + (0 if n == size or n in powers else size - n)
        at = e
    return total


def test_windows_cost_least():
    draw = np.random.default_rng(2)
    for _ in range(40):
        size, powers = 16, (8, 4)
        ends = np.unique(draw.integers(1, 120, 6))
        sentences = np.unique(draw.integers(1, 120, 9))
        places, cost = packing.cuts_of(ends, sentences, size)
        penalty = dict(zip(places.tolist(), cost.tolist(), strict=True))
        best = {0: 0.0}
        for j in places.tolist()[1:]:  # the recurrence over all earlier cuts
            best[j] = min(best[i] + penalty[j] + packing.WINDOW_COST + (0 if j - i == size or j - i in powers else size - (j - i)) for i in best if j - i <= size)
        got = packing.best_windows(places, cost, size, powers)
        assert got[-1] == ends[-1] and cost_of(got.tolist(), penalty, size, powers) == pytest.approx(best[int(ends[-1])])


# --- quality


def labelled(n=600):
    """Prose of label 1, shouted or symbol-laden prose of label 0."""
    rows = documents(4, n)[:n]
    out = []
    for i, (d, t, *_) in enumerate(rows):
        bad = i % 4 == 0
        text = " ".join(w.upper() + "!!" if i % 8 else w + "***" for w in t.split(" ")) if bad else t
        out.append((d, text, "en", "s", len(text), 0 if bad else 1))
    return out


def label_frame(spark, rows):
    return spark.createDataFrame([(r[0], r[5], 0) for r in rows] + [(rows[0][0], None, 0), (None, 1, 0), (10**9, 1, 0)], "doc_id long, quality int, toxic int")


def test_base_counts(spark):
    rows = documents()
    label = label_frame(spark, labelled(120))
    got = {}
    for r in quality_rules.judged(frame(spark, rows, clashes=True), label).collect():
        got[r["doc_id"], r["n_chars"]] = r
        assert r["g"] == "g"
    for doc, text, _, _, n_chars in rows:
        t = text or ""
        w, seen, dup = re.findall(r"[^\x20\x09-\x0D]+", t), set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        many, covered = Counter(windows), set()
        for i, x in enumerate(windows):
            covered |= set(range(i, i + 5)) if many[x] > 1 else set()
        r = got[doc, n_chars]
        assert tuple(r[k] for k in quality_rules.COUNTS) == (len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t), dup, len(covered))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r["base_failed"] and r["kept"])


def test_quality_rules_keep_good_and_reject_bad(spark):
    rows = labelled()
    docs = frame(spark, [r[:5] for r in rows])
    quality = {r[0]: r[5] for r in rows}
    found = [r for r in quality_rules.judged(docs, label_frame(spark, rows)).collect() if not r["base_failed"]]
    assert sum(r["kept"] == quality[r["doc_id"]] for r in found) >= 0.98 * len(found)
    # without labels, and without documents
    assert all(r["kept"] for r in quality_rules.judged(docs, label_frame(spark, rows).limit(0)).collect() if not r["base_failed"])
    assert quality_rules.judged(docs.limit(0), label_frame(spark, rows)).count() == 0


def test_classifier_on_held_out_rows(spark):
    rows = labelled() + [(9001, None, None, None, None, 1), (9002, "", None, None, 0, 1)]
    got = embeddings_classifier.quality_scores(frame(spark, [r[:5] for r in rows], clashes=True), label_frame(spark, rows)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    quality = {r[0]: r[5] for r in rows if r[0] < 9000}
    apart = [r for r in got if r["held_out"] and r["doc_id"] in quality]
    assert len(apart) > 100 and sum(r["predicted"] == quality[r["doc_id"]] for r in apart) >= 0.95 * len(apart)


def test_held_out_labels_are_never_learned(spark):
    rows = labelled(200)
    docs = frame(spark, [r[:5] for r in rows])
    turned = [(*r[:5], 1 - r[5]) if zlib.crc32(str(r[0]).encode()) % 3 == 1 else r for r in rows]
    scores = [sorted((r["doc_id"], r["score"]) for r in embeddings_classifier.quality_scores(docs, label_frame(spark, x)).collect()) for x in (rows, turned)]
    assert scores[0] == scores[1]


FULL = 2**64


def mixed(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 % FULL
    x ^= x >> 27
    x = x * 0x94D049BB133111EB % FULL
    return x ^ x >> 31


def hashed(raw, salt=0):
    value, power = 0, 1
    for b in raw:
        value, power = (value + (b + 1 + salt) * power) % FULL, power * 0x9E3779B97F4A7C15 % FULL
    return mixed((value + len(raw) * 0xA24BAED4963EE407) % FULL)


def plain_features(text):
    """Indices of the features of a text, one by one."""
    words = [hashed(w.encode()) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    out = words + [0 if a == b else mixed((3 * a + b) % FULL) for a, b in zip(words[:-1], words[1:], strict=True)]
    for n in (3, 4):
        out += [hashed(text[i : i + n].encode(), n) for i in range(len(text) - n + 1)]
    return [h >> 46 for h in out]


TEXTS = ["", "a", "ab", "abc", "日本語の文", "é é é naïve", "one two  two two\nthree", "x" * 40, "🙂🙂🙂🙂🙂", " \t\n"]


def test_features_are_the_plain_ones():
    raw = [t.encode() for t in TEXTS]
    data, bounds = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    table = np.random.default_rng(1).normal(size=1 << features.BITS)
    means, bags = features.table_means(data, bounds, table), list(features.feature_bags(data, bounds))
    for text, mean, (index, share) in zip(TEXTS, means, bags, strict=True):
        want = plain_features(text)
        assert mean == pytest.approx(sum(table[i] for i in want) / max(1, len(want)), abs=1e-9)
        count = Counter(want)
        assert index.tolist() == sorted(count) and share.tolist() == pytest.approx([count[i] / len(want) for i in sorted(count)])


def test_scores_are_the_models(spark, monkeypatch):
    table = np.random.default_rng(2).normal(size=1 << features.BITS).astype(np.float32)
    model = spark.sparkContext.broadcast((table, 1.5, -0.1))
    docs = frame(spark, [(i, t, None, None, None) for i, t in enumerate([*TEXTS, None])])
    want = {}
    for i, t in enumerate([*TEXTS, None]):
        f = plain_features(t or "")
        want[i] = 1 / (1 + np.exp(-(1.5 * float(sum(table[j] for j in f)) / max(1, len(f)) - 0.1)))
    monkeypatch.setattr(embeddings_classifier, "fitted", lambda *a: model)
    monkeypatch.setattr(quality_rules, "fitted", lambda *a: model)
    labels = label_frame(spark, labelled(20))
    assert {r["doc_id"]: r["score"] for r in embeddings_classifier.quality_scores(docs, labels).collect()} == pytest.approx(want, abs=1e-6)
    assert {r["doc_id"]: r["probability"] for r in quality_rules.judged(docs, labels).collect()} == pytest.approx(want, abs=1e-6)


def test_training_is_the_plain_descent(monkeypatch):
    """The weights that training gives, against the same steps with a whole matrix of vectors and no shortcuts."""
    monkeypatch.setattr(embeddings_classifier, "RATE", 0.2)
    bags = [(np.array([1, 5]), np.array([0.5, 0.5], np.float32)), (np.array([2, 5, 9]), np.array([0.2, 0.3, 0.5], np.float32)), (np.array([], np.int32), np.array([], np.float32))]
    labels = np.array([1.0, 0.0, 1.0])
    weights, factor, bias = embeddings_classifier.train(bags, labels)
    draw = np.random.default_rng(7)
    vectors, layer, shift = draw.normal(0, 0.5, (1 << features.BITS, 8)), np.zeros((2, 8)), np.zeros(2)
    start, steps = vectors.copy(), 0
    for _ in range(embeddings_classifier.EPOCHS):
        for i in draw.permutation(3).tolist():
            rate = embeddings_classifier.RATE * (1 - steps / (3 * embeddings_classifier.EPOCHS))
            steps += 1
            mean = sum((s * vectors[f] for f, s in zip(*bags[i], strict=True)), np.zeros(8))
            e = np.exp(layer @ mean + shift)
            wrong = e / e.sum() - np.array([labels[i] == 0, labels[i] == 1])
            back = wrong @ layer
            layer -= rate * np.outer(wrong, mean)
            shift -= 0.05 * rate * wrong
            for f, s in zip(*bags[i], strict=True):
                vectors[f] -= rate / max(1e-6, float((bags[i][1] ** 2).sum())) ** 0.5 * s * back
    want = vectors @ (layer[1] - layer[0])
    assert np.allclose(weights, want, atol=1e-3) and (factor, bias) == (1.0, pytest.approx(shift[1] - shift[0], abs=1e-4))
    assert (np.flatnonzero((vectors != start).any(axis=1)) == [1, 2, 5, 9]).all()


def test_classifier_without_rows_or_labels(spark):
    rows = labelled(30)
    docs, labels = frame(spark, [r[:5] for r in rows]), label_frame(spark, rows)
    assert embeddings_classifier.quality_scores(docs.limit(0), labels).count() == 0
    got = embeddings_classifier.quality_scores(docs, labels.limit(0)).collect()
    assert len(got) == 30 and all(r["predicted"] == 1 for r in got)


def test_a_repeated_document_is_one_of_the_sample(spark, monkeypatch):
    seen = []

    def fit(bags, labels):
        return np.full(1 << features.BITS, len(bags), np.float32), float(labels.sum()), 0.0

    monkeypatch.setattr(learn, "SAMPLE_ROWS", 5)
    docs = spark.range(3000).selectExpr("if(id < 2900, 7L, id) as doc_id", "if(id < 2900, 'same text', concat('text ', id)) as text")
    labels = spark.createDataFrame([(7, 1), (7, 0), (2950, 1), (2951, 0), (2952, 1), (2953, 1), (2954, 1)], "doc_id long, quality int")
    weights, ones, _ = learn.fitted(docs, labels, fit).value
    assert weights[0] == 5 and 1 <= ones <= 5 and not seen
    monkeypatch.setattr(learn, "SAMPLE_BYTES", 30)  # three texts of nine bytes
    assert learn.fitted(docs, labels, fit).value[0][0] == 3


def test_one_long_text_leaves_room_for_the_others(spark, monkeypatch):
    monkeypatch.setattr(learn, "SAMPLE_BYTES", 400_000)
    monkeypatch.setattr(learn, "MOST_BYTES", 4_000)
    draw = np.random.default_rng(8)
    words = {0: ["bad", "spam", "buy", "now"], 1: ["good", "prose", "reads", "well"]}
    text = lambda q, n: " ".join(draw.choice([*words[q], "the", "of", "and"], n))
    rows = [(i, text(i % 2, 30), i % 2) for i in range(600)]
    first = spark.range(600).orderBy(F.xxhash64("id")).first()["id"]
    rows[first] = (first, text(first % 2, 200_000), first % 2)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    right = {r[0]: r[2] for r in rows}
    apart = [r for r in embeddings_classifier.quality_scores(docs, labels).collect() if r["held_out"]]
    assert len(apart) > 150 and np.mean([r["predicted"] == right[r["doc_id"]] for r in apart]) > 0.95
    kept = quality_rules.judged(docs, labels).collect()
    assert np.mean([(r["probability"] >= 0.5) == right[r["doc_id"]] for r in kept]) > 0.95
    monkeypatch.setattr(learn, "SAMPLE_BYTES", 100)
    with pytest.raises(ValueError, match="no labelled text"):
        quality_rules.judged(docs, labels)


def test_quality_rules_carry_columns_of_any_kind(spark):
    docs = spark.sql("select 1L as doc_id, 'a b' as text, named_struct('a-b', 1, 'c d', array(1)) as `x.y`, map('k', 1) as score")
    row = quality_rules.judged(docs, spark.createDataFrame([], "doc_id long, quality int")).first()
    assert row["x.y"].asDict() == {"a-b": 1, "c d": [1]} and row["score"] == {"k": 1} and row["base_failed"]


def test_calibration_and_sample_bound():
    draw = np.random.default_rng(1)
    truth = draw.random(4000)
    labels = (draw.random(4000) < truth).astype(float)
    a, b = quality_rules.calibrated(3 * np.log(truth / (1 - truth)) + 1, labels, 0.0)
    assert a == pytest.approx(1 / 3, rel=0.2) and b == pytest.approx(-1 / 3, abs=0.2)
    assert quality_rules.calibrated(np.zeros(0), np.zeros(0), 0.7) == (1.0, 0.7)
    assert learn.SAMPLE_ROWS == 4000

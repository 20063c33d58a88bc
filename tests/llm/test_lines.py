import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from samples import COLUMNS, documents, frame, prose

from sluice.llm import lines
from sluice.llm.lines import dedup_lines

# --- the whole method once more, in plain Python over plain numbers

FULL = 2**64
BASE, ROLL, SIZE = 0x9E3779B97F4A7C15, 0x9E3779B97F4A7C15, 0xA24BAED4963EE407


def mixed(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 % FULL
    x ^= x >> 27
    x = x * 0x94D049BB133111EB % FULL
    return x ^ x >> 31


def hashed(raw):
    value, power = 0, 1
    for b in raw:
        value, power = (value + (b + 1) * power) % FULL, power * BASE % FULL
    return mixed((value + len(raw) * SIZE) % FULL)


def plain_units(raw):
    """(start, end, weight) of each unit."""
    out, at = [], 0
    for line in raw.split(b"\n"):
        words = [(at + m.start(), at + m.end()) for m in re.finditer(rb"[^ \t-\r]+", line)]
        pieces, now = [], []
        for a, b in words:
            now.append((a, b))
            if len(words) > 6 and raw[b - 1 : b] in (b".", b"!", b"?", b",", b";", b":"):
                pieces.append(now)
                now = []
        pieces += [now] if now else []
        for piece in pieces:
            now, parts = [], []
            for a, b in piece:
                now.append((a, b))
                if len(piece) > 6 and hashed(raw[a:b]) % 4 == 0:
                    parts.append(now)
                    now = []
            for part in [*parts, *([now] if now else [])]:
                weight = sum(max(1, (b - a) // 12) for a, b in part)
                out.append((part[0][0], part[-1][1], weight if len(words) > 6 else max(4, weight)))
        at += len(line) + 1
    return out


def plain_chunks(raw, least=8):
    """(start, end, left, right) of each chunk of weight enough; the last two: how far a match may go."""
    units = plain_units(raw)
    hashes = [hashed(raw[a:b]) for a, b, _ in units]
    rolled = [mixed((h * ROLL + (hashes[i - 1] if i else 0)) % FULL) for i, h in enumerate(hashes)]
    upto = [sum(w for *_, w in units[: i + 1]) for i in range(len(units))]
    value = {i: r for i, r in enumerate(rolled) if upto[i] >= least and upto[-1] - upto[i] >= least}
    ends = set()
    for _ in range(2):
        low = [i for i in value if all(value[i] < value[j] if j < i else value[i] <= value[j] for j in value if j != i and abs(upto[i] - upto[j]) < least)]
        ends |= set(low)
        value = {i: r for i, r in value.items() if all(abs(upto[i] - upto[j]) >= least for j in low)}
    last = sorted(ends | ({len(units) - 1} if units else set()))
    spans = list(zip([0, *(x + 1 for x in last[:-1])], last, strict=True)) if last else []
    before = [0, *upto]
    out = []
    for n, (a, b) in enumerate(spans):
        x, y = spans[max(n - 1, 0)][0] if n else a, spans[min(n + 1, len(spans) - 1)][1] + 1
        left = max(max(i for i in range(len(before)) if before[i] <= before[x] - 4 * least) - 2 if before[x] >= 4 * least else 0, 0)
        right = min(min([i for i in range(len(before)) if before[i] >= before[y] + 4 * least], default=len(units)) + 2, len(units)) - 1
        out.append((units[a][0], units[b][1], units[left][0], units[right][1], before[b + 1] - before[a] >= least))
    return [c[:4] for c in out if c[4]]


def plain_weight(raw, a, b):
    total, at = 0, 0
    for line in raw.split(b"\n"):
        words = [(at + m.start(), at + m.end()) for m in re.finditer(rb"[^ \t-\r]+", line)]
        mine = [(x, y) for x, y in words if a <= x and y <= b]
        weight = sum(max(1, (y - x) // 12) for x, y in mine)
        total += max(4, weight) if mine and mine == words else weight
        at += len(line) + 1
    return total


def brute(rows, least=20):
    """(doc_id, text) -> text after removal."""
    texts = {x: (x[1] or "").encode() for x in sorted(set(rows), key=lambda x: (x[0] is None, x[0] or 0))}
    chunks, where = {x: plain_chunks(raw) for x, raw in texts.items()}, {}
    for x, raw in texts.items():
        for i, (a, b, *_) in enumerate(chunks[x]):
            where.setdefault(raw[a:b], []).append((x, i))
    out = {}
    for x, raw in texts.items():
        own, gone = chunks[x], np.zeros(len(raw) + 1, dtype=bool)
        n = [len(where[raw[a:b]]) for a, b, *_ in own]
        repeat = [n[i] > 1 and where[raw[own[i][0] : own[i][1]]][0] != (x, i) for i in range(len(own))]
        # beside a first place that is also the first in its own text, others aren't repeats
        for i in np.flatnonzero(repeat).tolist():
            a, b, left, right = own[i]
            y, j = where[raw[a:b]][0]
            fa, fb, f_left, f_right = chunks[y][j]
            f_raw, f_n = texts[y], [len(where[texts[y][c[0] : c[1]]]) for c in chunks[y]]
            if not (i and repeat[i - 1]) and not (j and f_n[j - 1] >= f_n[j]):
                k = a
                while k > left and fa - (a - k) > f_left and raw[k - 1] == f_raw[fa - (a - k) - 1] and not (y == x and k <= fb):
                    k -= 1
                a = k
            if not (i + 1 < len(own) and repeat[i + 1]) and not (j + 1 < len(f_n) and f_n[j + 1] >= f_n[j]):
                k = b
                while k < right and fb + (k - b) < f_right and raw[k] == f_raw[fb + (k - b)]:
                    k += 1
                b = k
            gone[a:b] = True
        kept, at, stretch = [], 0, []
        for m in re.finditer(rb"[^ \t-\r]+", raw):  # whole words only
            if gone[m.start() : m.end()].all():
                if stretch:
                    stretch[-1].append(m) if stretch[-1] and stretch[-1][-1].end() == at else stretch.append([m])
                else:
                    stretch.append([m])
            at = m.end()
        at = 0
        for s in stretch:
            a, b = s[0].start(), s[-1].end()
            if plain_weight(raw, a, b) >= least:
                kept.append(raw[at:a])
                at = b + len(raw[b:]) - len(raw[b:].lstrip())
        out[x] = b"".join([*kept, raw[at:]]).decode() if kept else x[1]
    return out


def test_equals_the_plain_method(spark):
    rows = documents()
    want = brute([(r[0], r[1]) for r in rows])
    names = ("_key", "_spans", "k", "id", "spans", "doc", "first", "h", "wanted")
    got = dedup_lines(frame(spark, rows, clashes=True).withColumns({c: F.lit(c) for c in names}))
    found = got.collect()
    assert all(r[c] == c for r in found for c in names) and all(r["g"] == "g" and r["n_chars"] == (None if r["n_chars"] is None else r["n_chars"]) for r in found)
    left = sorted(((r["doc_id"], r["text"]) for r in found), key=str)
    assert left == sorted(((r[0], want[r[0], r[1]]) for r in rows), key=str)
    # copies are gone, their first stays whole
    assert want[3, rows[3][1]] == rows[3][1] and len(want[80, rows[3][1]]) < 0.1 * len(rows[3][1])


@pytest.mark.parametrize("head", [True, False])
def test_a_menu_of_six_lines_goes(spark, head):
    draw, hit = random.Random(2), 0
    for _ in range(6):
        menu = "\n".join("".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(6))
        rows = []
        for i in range(12):
            own = f"{prose(draw, 40)} {i}"
            rows.append((i, f"{menu}\n{own}" if head else f"{own}\n{menu}\n{prose(draw, 40)}", "en", "s", 0))
        got = {r["doc_id"]: r["text"] for r in dedup_lines(frame(spark, rows)).collect()}
        assert got[0] == rows[0][1]
        hit += sum(menu not in got[i] and len(got[i].split()) >= 40 for i in range(1, 12))
    assert hit >= 0.75 * 66


def test_bounds_are_parameters(spark):
    draw = random.Random(4)
    line = "a line of sixteen words that stands here four times, which by default is too short to go"
    rows = [(i, f"{prose(draw, 30)}\n{line}\n{prose(draw, 30)}", "en", "s", 0) for i in range(4)]
    assert all(r["text"] == rows[r["doc_id"]][1] for r in dedup_lines(frame(spark, rows)).collect())
    got = {r["doc_id"]: r["text"] for r in dedup_lines(frame(spark, rows), chunk_words=3, passage_words=1).collect()}
    assert got[0] == rows[0][1] and all(line not in got[i] for i in range(1, 4))


@pytest.mark.parametrize("place", ["own line", "inside a line", "several lines"])
def test_planted_passages_go_and_clean_texts_stay(spark, place):
    draw = random.Random(11)
    passages = [prose(draw, 70).replace("\n", " ") for _ in range(8)]
    if place == "several lines":
        passages = [p.replace(". ", ".\n") for p in passages]
    rows, planted = [], {}
    for i in range(120):
        text = " ".join(f"{w}{i}" if draw.random() < 0.3 else w for w in prose(draw, draw.randint(20, 150)).split(" "))
        if i % 3 == 0:
            p = passages[draw.randrange(8)]
            cut = text.find(". ", len(text) // 3) + 2 or len(text)
            joint = " " if place == "inside a line" else "\n"
            planted[i] = (p, text[:cut].rstrip() + joint, joint + text[cut:])
            text = planted[i][1] + p + planted[i][2]
        rows.append((i, text, "en", "s", len(text)))
    got = {r["doc_id"]: r["text"] for r in dedup_lines(frame(spark, rows)).collect()}
    seen, left, total = set(), 0, 0
    for i, (p, before, after) in planted.items():
        if p in seen:
            total += len(p.split())
            kept = got[i][len(before.rstrip()) :]
            left += max(0, len(kept.split()) - len(after.split()))
            assert p not in got[i]
        else:
            seen.add(p)
            assert got[i] == rows[i][1]
    assert left < 0.15 * total
    assert all(got[i] == rows[i][1] for i in range(120) if i not in planted)


def chunks(texts):
    raw = [(t or "").encode() for t in texts]
    c = lines.chunks_of(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    starts = np.cumsum([0, *map(len, raw)])
    out = [[] for _ in texts]
    for d, *x in zip(c.doc.tolist(), c.start.tolist(), c.end.tolist(), c.left.tolist(), c.right.tolist(), strict=True):
        out[d].append(tuple(v - int(starts[d]) for v in x))
    return out


def test_chunks_are_the_plain_ones_whatever_the_block():
    draw = random.Random(3)
    texts = [t or "" for _, t, *_ in documents() if len(t or "") < 5000] + ["", "\n", "a. b", "a.b", "..", "x " * 300, "end.\n\n\nnext. ", " . ? !", "".join(draw.choice("ab .\n!?\t") for _ in range(3000))]
    want = [plain_chunks(t.encode()) for t in texts]
    assert chunks(texts) == want
    assert [chunks([t])[0] for t in texts] == want


def test_chunks_cover_every_word():
    for t in [t or "" for _, t, *_ in documents()]:
        raw, found = t.encode(), chunks([t])[0]
        if len(t.split()) >= 8:
            assert b" ".join(raw[a:b] for a, b, *_ in found).split() == raw.split()


def test_boundaries_do_not_depend_on_what_stands_before():
    draw = random.Random(9)
    passage = prose(draw, 400)
    found = []
    for before in ("x", "quite another beginning, of more words. And lines\n", ""):
        text = before + "\n" + passage
        found.append({text.encode()[a:b] for a, b, *_ in chunks([text])[0]})
    inside = {c for c in found[0] if c in passage.encode()}
    assert len(inside) > 20 and all(len(inside - f) <= 2 for f in found)


def test_short_repeats_stay():
    text = b"one two three four five six seven eight nine ten\nmore words stand here"
    assert lines.passages(text, [(0, 48)], 10) == [(0, 48)] and lines.passages(text, [(0, 48)], 11) == []
    # drawn back to whole words, joined over white space, and a short whole line counts as four words
    assert lines.passages(text, [(1, 30), (28, 47)], 1) == [(4, 44)]
    assert lines.passages(b"a\nb\nc", [(0, 1), (2, 3)], 8) == [(0, 3)] and lines.passages(b"a b\nc", [(0, 1)], 4) == []


def test_no_rows(spark):
    assert dedup_lines(spark.createDataFrame([], COLUMNS)).count() == 0
    assert [tuple(r) for r in dedup_lines(spark.createDataFrame([(None, None, None, None, None)], COLUMNS)).select("text", "n_passages", "n_removed").collect()] == [(None, 0, 0)]


def listed(draw, kind, n=60):
    """A passage of n words in short units, and other text of the kind."""
    def word():
        if kind == "unspaced":
            return "".join(chr(draw.randint(0x4E00, 0x9FA5)) for _ in range(draw.randint(4, 12)))
        return "".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(3, 9)))

    joint = {"menu": "\n", "commas": ", ", "unspaced": "\n", "pairs": "\n"}[kind]
    return joint.join(word() + (" " + word() if kind == "pairs" else "") for _ in range(n // 2 if kind == "pairs" else n))


@pytest.mark.parametrize("kind", ["menu", "commas", "pairs", "unspaced"])
@pytest.mark.parametrize("size", [52, 80])
def test_passages_of_short_units_go(spark, kind, size):
    draw = random.Random(5)
    passages, rows, planted = [listed(draw, kind, size) for _ in range(10)], [], {}
    for i in range(60):
        before, after = listed(draw, kind, draw.randint(10, 60)), listed(draw, kind, draw.randint(10, 60))
        if i % 2:
            planted[i] = (before, after)
        p = passages[i // 2 % 10]
        rows.append((i, f"{before}\n{p}\n{after}" if i % 2 else f"{before}\n{after}", "en", "s", 0))
    got = {r["doc_id"]: r["text"] for r in dedup_lines(frame(spark, rows)).collect()}
    gone = [i for i, (before, after) in planted.items() if got[i].split() == (before + "\n" + after).split()]
    firsts = [i for i in planted if i < 20]
    assert all(got[i] == rows[i][1] for i in range(60) if i not in planted or i in firsts)
    assert len(gone) >= 0.95 * (len(planted) - len(firsts))


def test_matches_go_on_until_the_texts_differ(spark):
    draw = random.Random(8)
    for n in range(30, 60, 3):  # few chunks, and many units beside them
        p = listed(draw, "menu", n)
        rows = [(i, f"start{i}\n{p}\nend{i}", "en", "s", 0) for i in range(4)]
        got = {r["doc_id"]: r["text"] for r in dedup_lines(frame(spark, rows)).collect()}
        assert got[0] == rows[0][1] and all(got[i] in (f"start{i}\nend{i}", rows[i][1]) for i in range(1, 4))


def test_equal_ends():
    draw = random.Random(4)
    for _ in range(300):
        a, b = (bytes(draw.choice(b"ab") for _ in range(draw.randrange(12))) for _ in range(2))
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert lines.equal_start(a, b) == n == lines.equal_end(a[::-1], b[::-1])


def test_texts_of_one_doc_id_have_one_first_place(spark):
    p = listed(random.Random(6), "menu", 80)
    for doc in (7, None):
        rows = [(doc, f"start{i}\n{p}\nend{i}", "en", "s", 0) for i in range(3)]
        got = [r["text"] for r in dedup_lines(frame(spark, rows)).collect()]
        assert sorted(map(len, got))[:2] == [len("start0\nend0")] * 2 and sum(p in t for t in got) == 1

"""Removal of repeated passages by content-defined chunks of lines.

Units are lines. A line of more than ``LONG_WORDS`` words is folded: it is cut after words that
end in punctuation and, where a piece is still long, after words that their own hash
names. A unit weighs as many words as it has (a word of many bytes, as scripts without
spaces have them, counts as several) and a whole line ``LINE_WORDS`` at least, so that menus
and lists of short lines count as prose does.

A rolling hash over the hashes of the last units decides where a chunk ends: where it
is lower than at all units closer than ``CHUNK_WORDS``, and once more among the units that
no such place is near. So chunks weigh ``CHUNK_WORDS`` or more, and every word of a text that
weighs as much lies in one. As an end depends on what stands around it alone, texts that
share a passage fall into step inside it, whatever stands before.

Chunks count globally by a 64-bit hash of their bytes. One that stands in several places
is compared byte by byte with its first place (smallest doc_id, then hash of the text,
then place in it). If equal it is marked, and the match goes on over the chunks beside
it, byte by byte too, until the texts differ. A side where the chunk beside repeats
as well needs none of that, as that chunk is marked by itself; nor does one where the
chunk beside the first place has as many places as this one. Were the texts equal beyond
the chunk beside and ``REACH_WORDS`` more, the chunk beside would end at the same place in both,
and repeat; so no more travels.

Marked stretches, drawn back to whole words, are removed if they weigh ``PASSAGE_WORDS`` or
more; a shorter repeat is common speech. Both bounds are parameters. The first place
always stays, and texts without repeats come out unchanged.

Null and empty texts have no units and stay as they are. Rows equal in doc_id and
text count as one text (all keep or lose the same passages); a null doc_id counts as
larger than any other. Other columns are carried along, whatever their names; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sluice.llm.shared import WHITE, blocks, discard, mix, small_batches, span_hashes, split_words, text_bounds, written

#: Weight of a chunk, and of a passage that is removed, at least.
CHUNK_WORDS, PASSAGE_WORDS = 8, 20
#: What a whole line weighs at least; bytes of a word that count as one.
LINE_WORDS, WORD_BYTES = 4, 12
#: Units whose hashes the rolling hash covers.
ROLLED = 2
#: A line of more words is folded; a piece of as many further, after one word in so many.
LONG_WORDS, CUT_WORDS = 6, 4
#: Times that chunk ends are chosen; an end depends on less than this to either side, in chunks.
ROUNDS, REACH_CHUNKS = 2, 4

_U = np.uint64
_ROLL = _U(0x9E3779B97F4A7C15)
_NEVER = _U(2**64 - 1)
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".!?,;:")] = True
_WHITE = bytes(np.flatnonzero(WHITE).tolist())


@dataclass
class Chunks:
    """Chunks of a block of texts: document, hash and bytes, and how far a match may go beyond."""

    doc: np.ndarray
    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    left: np.ndarray
    right: np.ndarray


def chunk_ends(rolled: np.ndarray, total: np.ndarray, first: np.ndarray, after: np.ndarray, least: int = CHUNK_WORDS) -> np.ndarray:
    """Flags of the units that end a chunk inside their text.

    total: weight up to each unit's end; first, after: weight before each unit's text and up to its end.
    """
    value, ends = rolled.copy(), np.zeros(len(rolled), dtype=bool)
    value[(total - first < least) | (after - total < least)] = _NEVER
    # units of other texts are too far away or can't be chosen
    close = [c for k in range(1, min(least, len(rolled))) if (c := total[k:] - total[:-k] < least).any()]
    for _ in range(ROUNDS):
        low = value < _NEVER
        for k, c in enumerate(close, 1):
            low[k:] &= ~c | (value[k:] < value[:-k])
            low[:-k] &= ~c | (value[:-k] <= value[k:])
        near = low.copy()
        for k, c in enumerate(close, 1):
            near[k:] |= c & low[:-k]
            near[:-k] |= c & low[k:]
        ends |= low
        value[near] = _NEVER
    return ends


def chunks_of(data: np.ndarray, bounds: np.ndarray, least: int = CHUNK_WORDS) -> Chunks:
    """The chunks of ``least`` or more of each text."""
    words = split_words(data, bounds)
    if not len(words.start):
        none = np.zeros(0, np.int64)
        return Chunks(none, none, none, none, none, none)
    doc = np.repeat(np.arange(len(bounds) - 1), words.counts)
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    stop = np.ones(len(doc), dtype=bool)
    stop[:-1] = (lines[words.start[1:]] > lines[words.end[:-1]]) | (doc[1:] != doc[:-1])

    def sizes() -> np.ndarray:
        """Words of the unit that each word is in."""
        size = np.diff(np.concatenate([[0], np.flatnonzero(stop) + 1]))
        return np.repeat(size, size)

    long = sizes() > LONG_WORDS
    stop |= long & _STOP[data[words.end - 1]]
    stop |= (sizes() > LONG_WORDS) & (words.hashes % _U(CUT_WORDS) == 0)
    last = np.flatnonzero(stop)
    first = np.concatenate([[0], last[:-1] + 1])
    start, end, of = words.start[first], words.end[last], doc[first]
    run = np.concatenate([[0], np.cumsum(np.maximum(1, (words.end - words.start) // WORD_BYTES))])
    weight = run[last + 1] - run[first]
    weight = np.where(long[first], weight, np.maximum(weight, LINE_WORDS))
    h = span_hashes(data, start, end)
    rolled = h.copy()
    for k in range(1, ROLLED):
        earlier = np.concatenate([np.zeros(min(k, len(h)), dtype=_U), np.where(of[k:] == of[:-k], h[:-k], _U(0))])
        rolled = rolled * _ROLL + earlier
    rolled = mix(rolled)
    unit_bounds = np.searchsorted(of, np.arange(len(bounds)))
    total = np.concatenate([[0], np.cumsum(weight)])
    ends = chunk_ends(rolled, total[1:], total[unit_bounds[of]], total[unit_bounds[of + 1]], least)
    ends[:-1] |= of[1:] != of[:-1]
    ends[-1] = True
    c_last = np.flatnonzero(ends)
    c_first = np.concatenate([[0], c_last[:-1] + 1])
    good = total[c_last + 1] - total[c_first] >= least
    # how far the chunk beside and what its end depends on reach
    base, top = unit_bounds[of[c_first]], unit_bounds[of[c_first] + 1]
    left = np.where(c_first > base, np.concatenate([[0], c_first[:-1]]), base)
    left = np.maximum(np.searchsorted(total, total[left] - REACH_CHUNKS * least, "right") - 1 - ROLLED, base)
    right = np.where(c_last + 1 < top, np.concatenate([c_last[1:], [0]]) + 1, top)
    right = np.minimum(np.searchsorted(total, total[right] + REACH_CHUNKS * least) + ROLLED, top) - 1
    c_first, c_last, left, right = (x[good] for x in (c_first, c_last, left, right))
    return Chunks(of[c_first], span_hashes(data, start[c_first], end[c_last]).view(np.int64), start[c_first], end[c_last], start[left], end[right])


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return _column(batch, name).to_numpy(zero_copy_only=False)


def _places(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 4 << 20):
            doc, k = _numbers(batch, "doc"), _numbers(batch, "k")
            data, bounds = text_bounds(_column(batch, "text"))
            for first, _, part, at in blocks(data, bounds):
                c = chunks_of(part, at, least)
                yield pa.RecordBatch.from_pydict({"doc": doc[first + c.doc], "k": k[first + c.doc], "h": c.hashes})

    return run


def equal_start(a: bytes, b: bytes) -> int:
    """How many bytes from the start on are equal."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def equal_end(a: bytes, b: bytes) -> int:
    """How many bytes up to the end are equal."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[len(a) - middle : len(a) - low] == b[len(b) - middle : len(b) - low]:
            low = middle
        else:
            high = middle - 1
    return low


#: kind: what other places are compared with, a place to compare, or a stretch that is marked already.
FIRST, AGAIN, MARKED = 0, 1, 2
REPEATS = "kind tinyint, several boolean, doc long, k long, at int, end int, h long, chunk binary, before binary, after binary"


def _repeats(least: int):
    """Of each text with its repeated chunks: first places and others, with their bytes and what stands beside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 4 << 20):
            wanted, several = _column(batch, "wanted"), _numbers(batch, "several").astype(bool)
            flat, n = wanted.flatten(), wanted.value_lengths().to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(batch.num_rows), n)
            w_h, w_n, w_mine = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("h", "n", "mine"))
            key = lambda h, row: mix(h.view(_U) + mix(row.astype(_U)))
            w_key = key(np.ascontiguousarray(w_h), of)
            order = np.argsort(w_key)
            w_key, w_n, w_mine = w_key[order], w_n[order], w_mine[order].astype(bool)
            data, bounds = text_bounds(_column(batch, "text"))
            doc, k = _numbers(batch, "doc"), _numbers(batch, "k")
            for first, _, part, at in blocks(data, bounds):
                c = chunks_of(part, at, least)
                if not len(c.doc):
                    continue
                row = first + c.doc
                keys = key(c.hashes, row)
                place = np.minimum(np.searchsorted(w_key, keys), len(w_key) - 1)
                found = w_key[place] == keys
                count, mine = np.where(found, w_n[place], 0), found & w_mine[place]
                # the first place in its text, if the text may hold the first of all
                head = np.zeros(len(keys), dtype=bool)
                mine_at = np.flatnonzero(mine)
                _, lead = np.unique(keys[mine_at], return_index=True)
                head[mine_at[lead]] = True
                other = found & ~head
                beside = c.doc[1:] == c.doc[:-1]
                goes_left, goes_right = np.concatenate([[False], beside & other[:-1]]), np.concatenate([beside & other[1:], [False]])
                less_left = np.concatenate([[True], ~beside | (count[:-1] < count[1:])])
                less_right = np.concatenate([~beside | (count[1:] < count[:-1]), [True]])
                whole = several[row]
                ask_left = np.where(head, less_left, ~goes_left)
                ask_right = np.where(head, less_right, ~goes_right)
                kind = np.where(head, FIRST, AGAIN)
                # a place in the text of its first one needs no other task
                inside = other & mine & ~whole
                raw, begin, stop = part.tobytes(), c.start.copy(), c.end.copy()
                if inside.any():
                    head_of = dict(zip(keys[head].tolist(), np.flatnonzero(head).tolist(), strict=True))
                    kind[inside] = MARKED
                    for i in np.flatnonzero(inside).tolist():
                        f = head_of[int(keys[i])]
                        a, b, fa, fb = int(c.start[i]), int(c.end[i]), int(c.start[f]), int(c.end[f])
                        if raw[a:b] != raw[fa:fb]:
                            kind[i] = -1
                            continue
                        if ask_left[i] and less_left[f]:
                            begin[i] = max(a - equal_end(raw[c.left[i] : a], raw[c.left[f] : fa]), fb)
                        if ask_right[i] and less_right[f]:
                            stop[i] = b + equal_start(raw[b : c.right[i]], raw[fb : c.right[f]])
                send = np.flatnonzero(found & (kind >= 0))
                base = at[c.doc[send]]
                bare = (kind[send] == MARKED).tolist()
                spans = [x[send].tolist() for x in (c.start, c.end, c.left, c.right)]
                lefts, rights = (ask_left[send] & ~inside[send]).tolist(), (ask_right[send] & ~inside[send]).tolist()
                chunk = [None if m else raw[a:b] for a, b, m in zip(spans[0], spans[1], bare, strict=True)]
                before = [raw[x:a] if ask else None for a, x, ask in zip(spans[0], spans[2], lefts, strict=True)]
                after = [raw[b:x] if ask else None for b, x, ask in zip(spans[1], spans[3], rights, strict=True)]
                # of several texts of one doc_id any may hold the first place: all are compared
                twice = np.flatnonzero(whole[send] & head[send])
                columns = {
                    "kind": kind[send].astype(np.int8), "several": whole[send], "doc": doc[row[send]], "k": k[row[send]],
                    "at": (begin[send] - base).astype(np.int32), "end": (stop[send] - base).astype(np.int32), "h": c.hashes[send],
                    "chunk": pa.array(chunk, pa.binary()), "before": pa.array(before, pa.binary()), "after": pa.array(after, pa.binary()),
                }
                out = pa.RecordBatch.from_pydict({name: pa.array(x) for name, x in columns.items()})
                yield out
                if len(twice):
                    again = out.take(pa.array(twice))
                    yield again.set_column(0, "kind", pa.array(np.full(len(twice), AGAIN, np.int8)))

    return run


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes that go with each chunk that equals its first place."""
    for batch in batches:
        at, end, floor = (_numbers(batch, c).copy() for c in ("at", "end", "floor"))
        for name, other, move in (("before", "f_before", True), ("after", "f_after", False)):
            mine, theirs = _column(batch, name), _column(batch, other)
            for i in np.flatnonzero(mine.is_valid().to_numpy(zero_copy_only=False) & theirs.is_valid().to_numpy(zero_copy_only=False)).tolist():
                if move:
                    at[i] = max(at[i] - equal_end(mine[i].as_py(), theirs[i].as_py()), min(at[i], floor[i]))
                else:
                    end[i] += equal_start(mine[i].as_py(), theirs[i].as_py())
        yield pa.RecordBatch.from_pydict({"doc": _column(batch, "doc"), "k": _column(batch, "k"), "first": pa.array(at, pa.int32()), "last": pa.array(end, pa.int32())})


def _line_begins(text: bytes, a: int) -> bool:
    """Whether nothing but white space stands between the last line end and ``a``."""
    while a and text[a - 1] in _WHITE:
        if text[a - 1] == 10:
            return True
        a -= 1
    return not a


def _line_ends(text: bytes, b: int) -> bool:
    while b < len(text) and text[b] in _WHITE:
        if text[b] == 10:
            return True
        b += 1
    return b == len(text)


def weight_of(text: bytes, a: int, b: int) -> int:
    """What text[a:b] weighs: its words, and a whole line ``LINE_WORDS`` at least."""
    total = 0
    lines = text[a:b].split(b"\n")
    for i, line in enumerate(lines):
        words = sum(max(1, len(w) // WORD_BYTES) for w in line.split())
        whole = (i > 0 or _line_begins(text, a)) and (i < len(lines) - 1 or _line_ends(text, b))
        total += max(words, LINE_WORDS) if words and whole else words
    return total


def passages(text: bytes, spans: list[tuple[int, int]], least: int = PASSAGE_WORDS) -> list[tuple[int, int]]:
    """Stretches to remove: spans joined where they touch but for white space, drawn back to whole words, of weight enough."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        while 0 < a < b and text[a] not in _WHITE and text[a - 1] not in _WHITE:
            a += 1
        while a < b < len(text) and text[b] not in _WHITE and text[b - 1] not in _WHITE:
            b -= 1
        while a < b and text[a] in _WHITE:
            a += 1
        while a < b and text[b - 1] in _WHITE:
            b -= 1
        if a >= b:
            continue
        if out and (a <= out[-1][1] or not text[out[-1][1] : a].strip(_WHITE)):
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out if weight_of(text, a, b) >= least]


def _cut(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 4 << 20):
            spans, text = _column(batch, "spans"), _column(batch, "text")
            changed, n, removed = {}, np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i in np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False)).tolist():
                raw = text[i].as_py().encode()
                gone = passages(raw, [(s["first"], s["last"]) for s in spans[i].as_py()], least)
                if gone:
                    keep, at = [], 0
                    for a, b in gone:
                        keep.append(raw[at:a])
                        while b < len(raw) and raw[b] in _WHITE:  # a passage goes with the white space after it
                            b += 1
                        at = b
                    changed[i] = b"".join([*keep, raw[at:]]).decode()
                    n[i], removed[i] = len(gone), sum(len(raw[a:b].split()) for a, b in gone)
            if changed:
                values = text.to_pylist()
                for i, x in changed.items():
                    values[i] = x
                text = pa.array(values, pa.string())
            yield pa.RecordBatch.from_pydict({"doc": _column(batch, "doc"), "text": text, "n_passages": n, "n_removed": removed})

    return run


def dedup_lines(docs: DataFrame, chunk_words: int = CHUNK_WORDS, passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text``, and n_passages and n_removed (words).

    Columns of these two names are replaced. Passages of less than ``passage_words`` stay;
    those of less than about twice ``chunk_words`` may hold no whole chunk and are not seen.
    """
    docs = docs.drop("n_passages", "n_removed").withColumn("text", F.col("text").cast("string"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    rows = rows.select("doc", F.coalesce(F.col("doc.doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id"), "doc.text")
    rows = rows.withColumn("k", F.xxhash64("id", "text"))
    texts = rows.select(F.col("id").alias("doc"), "k", "text")
    places = written(texts.mapInArrow(_places(chunk_words), "doc long, k long, h long"), "places")
    # chunks in several places, and the smallest doc_id of these
    firsts = places.groupBy("h").agg(F.min("doc").alias("first_doc"), F.count("*").alias("n")).where("n > 1")
    firsts = written(firsts.select("h", "first_doc", F.least("n", F.lit((1 << 31) - 1)).cast("int").alias("n")), "firsts")
    # doc_ids of several texts: all of these may hold a first place, and the smallest hash decides
    several = places.groupBy("doc").agg(F.min("k").alias("least"), F.max("k").alias("most")).where("least <> most")
    several = written(several.select(F.col("doc").alias("shared_doc")), "several")
    wanted = places.join(firsts, "h").groupBy("doc", "k").agg(F.collect_set(F.struct("h", "n", (F.col("doc") == F.col("first_doc")).alias("mine"))).alias("wanted"))
    wanted = wanted.join(several, F.col("doc") == F.col("shared_doc"), "left").select("doc", "k", "wanted", F.col("shared_doc").isNotNull().alias("several"))
    repeats = written(texts.join(wanted, ["doc", "k"]).mapInArrow(_repeats(chunk_words), REPEATS), "repeats")
    discard(places, firsts, several)
    columns = ("k", "end", "chunk", "before", "after")
    heads = repeats.where(F.col("kind") == FIRST)
    least = heads.where("several").groupBy("h").agg(F.min(F.struct("k", "at", "end", "chunk", "before", "after")).alias("f"))
    heads = heads.where("not several").select("h", "at", *columns).unionByName(least.select("h", "f.at", *(f"f.{c}" for c in columns)))
    heads = heads.select("h", *(F.col(c).alias(f"f_{c}") for c in ("at", *columns)))
    # byte by byte; what stands beside travels to Python only where both sides have it
    pairs = repeats.where(F.col("kind") == AGAIN).join(heads, "h").where("chunk = f_chunk and (k <> f_k or at <> f_at)")
    near = [F.when(F.col(c).isNotNull() & F.col(f"f_{c}").isNotNull(), F.col(x)).alias(x) for c in ("before", "after") for x in (c, f"f_{c}")]
    floor = F.when(F.col("k") == F.col("f_k"), F.col("f_end")).otherwise(0).alias("floor")
    found = pairs.select("doc", "k", "at", "end", floor, *near).mapInArrow(_extend, "doc long, k long, first int, last int")
    marked = repeats.where(F.col("kind") == MARKED).select("doc", "k", F.col("at").alias("first"), F.col("end").alias("last"))
    spans = written(found.unionByName(marked).groupBy(F.col("doc").alias("id"), "k").agg(F.collect_set(F.struct("first", "last")).alias("spans")), "spans")
    discard(repeats)
    kinds = StructType([StructField("doc", rows.schema["doc"].dataType), StructField("text", StringType()), StructField("n_passages", LongType()), StructField("n_removed", LongType())])
    cut = rows.join(spans, ["id", "k"], "left").select("doc", "text", "spans").mapInArrow(_cut(passage_words), kinds)
    return cut.select(*(F.col("text") if c.lower() == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns), "n_passages", "n_removed")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

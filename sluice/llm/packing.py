"""Packing token streams into sequences by order-preserving dynamic programming.

Documents are taken in the order in which Spark reads them. Each is its token ids
and a closing id 0; the stream is cut into windows of at most 1024 ids, one per
sequence. Cuts may stand after a document (free), after a sentence (a small
penalty) and, where a sentence is longer than a window, inside it (a larger one).
The chosen cuts minimise padding plus penalties: with ``f(j)`` the least cost up to
cut j,

    f(j) = penalty(j) + min over cuts i with c_j - c_i <= 1024 of f(i) + waste(c_j - c_i)

where waste is 1024 less the length, and 0 at a power of two. As the first kind of
waste is linear, the minimum over the sliding span of i is the head of a monotone
queue on ``f(i) + c_i``; the powers of two are looked up one by one.

A task packs blocks of about half a million ids, each on its own, so memory is
bounded and no row moves between tasks; a block leaves at most one sequence
that is padded for want of documents.

Null text is empty: its document is the id 0 alone. Repeated rows are packed again, and
rows that nothing tells apart in any order. Other columns are left out; an empty table
gives no rows. A text of any length is encoded as a whole and then cut, a run of white space of any length too.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.shared import small_batches

SEQUENCE = 1024
END_ID = 0
BLOCK_IDS = 1 << 19
#: Costs in ids of padding: of a sequence at all, of a cut after a sentence, of a cut elsewhere.
WINDOW_COST, SENTENCE_COST, HARD_COST = 4.0, 6.0, 64.0
#: Window lengths besides the whole one that need no padding; shorter ones are never worth a sequence.
POWERS = (512, 256, 128)

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: The pre-tokenization of the byte-level vocabularies; a fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

#: Runs of white space that are too long for a search that looks behind them.
MOST_BLANKS = 100_000
LONG_BLANKS = re.compile(r"\s{%d}" % MOST_BLANKS)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary, to the byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def merges_by_rank(file: dict) -> bool:
    """Whether a tokenizer file splits texts by ``PATTERN`` and merges bytes in the order of its ids, and does nothing else."""
    split, model = file.get("pre_tokenizer") or {}, file.get("model") or {}
    if file.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return False
    if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return False
    vocabulary, merges = model["vocab"], model["merges"]
    made = [vocabulary.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in merges]
    single = [i for token, i in vocabulary.items() if len(token) == 1]
    return len(single) >= 256 and all(a < b for a, b in zip(made[:-1], made[1:], strict=True)) and (not made or made[0] > max(vocabulary[c] for c in byte_letters() if c in vocabulary))


class Encoder:
    """Ids of texts by a byte-level tokenizer file, as its own library gives them.

    Ranks are read from the file's vocabulary and merged by tiktoken, which takes about
    a quarter of the time; texts that hold a special token's string go to the file's
    own tokenizer, and so do all texts where the file splits or merges in another way, and those with
    more white space in a row than tiktoken's pattern search takes.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        letters, vocabulary = byte_letters(), self.tokenizer.get_vocab()
        plain = merges_by_rank(json.loads(self.tokenizer.to_str()))
        ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if token not in self.specials and letters.keys() >= set(token)}
        self.fast = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if plain else None
        #: Tokens that end a sentence if the next one begins with white space; those that do; line ends.
        self.ends, self.opens, self.lines = (np.zeros(max(vocabulary.values()) + 1, dtype=bool) for _ in range(3))
        for raw, i in ranks.items():
            self.ends[i], self.opens[i], self.lines[i] = raw.endswith((b".", b"!", b"?")), raw.startswith((b" ", b"\n")), raw.endswith(b"\n")

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.specials) or (len(text) > MOST_BLANKS and LONG_BLANKS.search(text)):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text)

    def sentences(self, ids: np.ndarray) -> np.ndarray:
        """Where sentences and lines end among the ids."""
        stop = self.ends[ids]
        stop[:-1] &= self.opens[ids[1:]]
        return np.flatnonzero(stop | self.lines[ids]) + 1


_ENCODERS: dict[str, Encoder] = {}


def cuts_of(ends: np.ndarray, sentences: np.ndarray, size: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window may end, ascending from 0, and the penalty of each.

    ``ends``: where documents end; ``sentences``: where sentences end.
    """
    places = np.unique(np.concatenate([[0], ends, sentences[sentences < ends[-1]]]))
    gap = np.diff(places)
    wide = np.flatnonzero(gap > size)
    hard = np.concatenate([np.zeros(0, np.int64), *(np.arange(places[i] + size, places[i + 1], size) for i in wide.tolist())])
    every = np.unique(np.concatenate([places, hard]))
    cost = np.full(len(every), HARD_COST)
    cost[np.searchsorted(every, sentences[sentences < ends[-1]])] = SENTENCE_COST
    cost[np.searchsorted(every, ends)] = 0.0
    cost[0] = 0.0
    return every, cost


def best_windows(places: np.ndarray, cost: np.ndarray, size: int = SEQUENCE, powers: tuple[int, ...] = POWERS) -> np.ndarray:
    """The ends of the windows that cost least in all."""
    at, penalty = places.tolist(), (cost + WINDOW_COST).tolist()
    index = dict(zip(at, range(len(at)), strict=True)) if powers else {}
    best, back = [0.0] * len(at), [0] * len(at)
    queue: deque[int] = deque([0])
    key = [0.0] * len(at)
    for j in range(1, len(at)):
        c = at[j]
        while at[queue[0]] < c - size:
            queue.popleft()
        i = queue[0]
        low = key[i] + (size - c)
        for p in powers:
            k = index.get(c - p)
            if k is not None and best[k] < low:
                i, low = k, best[k]
        best[j] = low = low + penalty[j]
        back[j] = i
        key[j] = low = low + c
        while queue and key[queue[-1]] >= low:
            queue.pop()
        queue.append(j)
    out, j = [], len(at) - 1
    while j:
        out.append(at[j])
        j = back[j]
    return np.array(out[::-1], np.int64)


def _pieces(doc_ids: list, ids: bytes, ends: np.ndarray, windows: np.ndarray, first: int) -> pa.RecordBatch:
    """A row for each piece of a document in a window."""
    starts, begins = np.concatenate([[0], ends[:-1]]), np.concatenate([[0], windows[:-1]])
    left = np.union1d(starts, begins)
    right = np.concatenate([left[1:], ends[-1:]])
    doc, window = np.searchsorted(starts, left, "right") - 1, np.searchsorted(begins, left, "right") - 1
    crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(left.tolist(), right.tolist(), strict=True)]
    columns = [
        pa.array([doc_ids[i] for i in doc.tolist()], pa.int64()), left - starts[doc], right - left, pa.array(crc, pa.int64()),
        (ends - starts)[doc], first + window, left - begins[window],
    ]
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in columns], names=[x.split()[0] for x in SCHEMA.split(", ")])


def _pack(tokenizer_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(tokenizer_path) or _ENCODERS.setdefault(tokenizer_path, Encoder(tokenizer_path))
        sequence = TaskContext.get().partitionId() << 40
        close = np.array([END_ID], np.uint32).tobytes()
        docs, parts, lengths, sentences, total = [], [], [], [], 0

        def packed() -> tuple[pa.RecordBatch, int]:
            ends = np.cumsum(lengths)
            windows = best_windows(*cuts_of(ends, np.concatenate([np.zeros(0, np.int64), *sentences])))
            return _pieces(docs, b"".join(parts), ends, windows, sequence), len(windows)

        for batch in small_batches(batches, "text", 2 << 20):
            columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "text"))
            for doc, text in zip(*columns, strict=True):
                ids = encoder.encode(text or "")
                docs.append(doc)
                parts += (ids.tobytes(), close)
                lengths.append(len(ids) + 1)
                sentences.append(encoder.sentences(ids) + total)
                total += lengths[-1]
                if total >= BLOCK_IDS:
                    rows, n = packed()
                    yield rows
                    sequence += n
                    docs, parts, lengths, sentences, total = [], [], [], [], 0
        if docs:
            yield packed()[0]

    return run


def pack(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Pieces of the rows of ``docs`` (doc_id, text) in sequences of at most 1024 ids."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_pack(tokenizer_path), SCHEMA)


def query(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path)

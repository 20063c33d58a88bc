"""Language-model scores of whole texts by context-tree weighting, beside a unigram base.

The model reads a lower-cased text as bytes that end in a byte no text has. Each byte is
eight binary choices, and each of the 255 choices has a context tree of its own over the
``DEPTH`` bytes before. Every node of a tree keeps how often 0 and 1 followed its context in
the learning texts; its Krichevsky-Trofimov estimate of that sequence is

    K(a, b) = G(a + 1/2) G(b + 1/2) / (pi G(a + b + 1))

and its weighted probability is W = K at the deepest level and W = (K + product of the
children's W) / 2 above it. A choice is then predicted by the mixture that these weights
give, over all depths: p = w k + (1 - w) p(child), with k = (b + 1/2) / (a + b + 1) and
w = K / (K + product of the children's W). A context that was never seen has a = b = 0.

How it runs. Texts are read once and written as blocks of ``TEXT_BYTES``, each with its
distinct grams (context and byte, one 64-bit key) and words and how often the learning texts have
them; what a block holds of both grows far slower than the block. These narrow rows are
summed by key over all blocks. Trees are weighted per context of ``TOP`` bytes (at most 256 to
the power of the other bytes of a gram, whatever the input); the nodes above them, 255 for each
of 257 contexts at most, are gathered and broadcast. Each gram so gets its code length once,
and the values go back to the blocks that asked for them, where each position of each text is
added up; words and their counts went the same way before. Nothing that grows with the corpus passes through the driver, and blocks are cut by
bytes, so neither a repeated document nor a frequent word makes a large one.

Null text is empty: its end alone is scored. A null doc_id has no remainder: such rows are neither
held out nor learned from. Repeated rows are learned from and scored one by one. Without
learning rows every choice has probability 1/2. Other columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.shared import LOWER, blocks, bucketed, discard, give_back, small_batches, split_words, text_bounds, written
from sluice.storage import settings

#: Bytes of context, and how many of them the trees are grouped by.
DEPTH, TOP = 4, 2
#: Bytes that no UTF-8 text has: what stands before a text, and its end.
START, END = 0xFE, 0xFF
#: Bytes of text in a block.
TEXT_BYTES = 4 << 20
#: Documents to a bucket of blocks.
BUCKET_ROWS = 4096
#: Bytes of text that a task looks at together, and rows that Spark hands over together.
PART_BYTES, PART_ROWS = 2 << 20, 1000
HELD_OUT_OF = 10

BLOCK_SCHEMA = (
    "block long, docs binary, data binary, bounds binary, learn_tokens long, learn_docs long, grams binary, gram_counts binary, words binary, word_counts binary"
)
#: By block and place in it: what the words of a document come to, and what its bytes do.
WORD_SCHEMA = "block long, place long, n_tokens long, n_known long, log_sum double"
SCORE_SCHEMA = "block long, place long, doc_id long, held_out boolean, score double, n_bytes long"
#: A document of a block.
DOC = np.dtype([("doc_id", np.int64), ("no_id", np.bool_), ("held_out", np.bool_), ("learn", np.bool_)])

Counted = tuple[np.ndarray, np.ndarray]


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % HELD_OUT_OF == 0


def gram_keys(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key for each byte of each text and for its end, and their n + 1 bounds by text.

    The byte is the lowest part of its key, the byte just before it the highest.
    """
    n = len(bounds) - 1
    wide = np.arange(n + 1) * (DEPTH + 1)
    padded = np.full(len(data) + n * (DEPTH + 1), START, np.uint8)
    padded[np.arange(len(data)) + np.repeat(wide[:-1], np.diff(bounds)) + DEPTH] = data
    ends = bounds[1:] + wide[1:] - 1
    padded[ends] = END
    keys = padded[DEPTH:].astype(np.int64)
    for i in range(1, DEPTH + 1):
        keys |= padded[DEPTH - i : len(padded) - i].astype(np.int64) << (8 * (DEPTH - i + 1))
    own = np.ones(len(keys), dtype=bool)
    own[(ends[:-1, None] - DEPTH + 1 + np.arange(DEPTH)).ravel()] = False
    return keys[own], bounds + np.arange(n + 1)


def distinct(keys: np.ndarray, learn: np.ndarray) -> Counted:
    """The distinct keys and how many of each are marked in ``learn``."""
    coded = pa.array(keys).dictionary_encode()
    return np.asarray(coded.dictionary), np.bincount(coded.indices.to_numpy()[learn], minlength=len(coded.dictionary))


def merged(parts: list[Counted]) -> Counted:
    """One ascending list of keys with summed counts."""
    keys, n = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (list(zip(*parts, strict=True)) or [(), ()]))
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], (np.add.reduceat(n, first) if len(first) else n)


def _to_blocks(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 32
        docs, texts, lengths, grams, words, tokens, size = [], [], [], [], [], 0, 0

        def block() -> pa.RecordBatch:
            known, (g, gn), (w, wn) = np.concatenate(docs), merged(grams), merged(words)
            bounds = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
            row = [place, known.tobytes(), b"".join(texts), bounds.tobytes(), tokens, int(known["learn"].sum()), g.tobytes(), gn.tobytes(), w.tobytes(), wn.tobytes()]
            kinds = [pa.int64() if isinstance(x, int) else pa.binary() for x in row]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in BLOCK_SCHEMA.split(", ")])

        for batch in batches:
            for part in small_batches([batch], "text", PART_BYTES):
                column = lambda c: part.column(part.schema.get_field_index(c))  # noqa: B023, E731
                known = np.zeros(part.num_rows, DOC)
                known["doc_id"] = column("doc_id").fill_null(0).to_numpy()
                known["no_id"] = column("doc_id").is_null().to_numpy(zero_copy_only=False)
                for c in ("held_out", "learn"):
                    known[c] = column(c).to_numpy(zero_copy_only=False)
                raw, at = text_bounds(column("text"))
                raw = LOWER[raw]
                for a, b, data, bounds in blocks(raw, at):
                    learn = known["learn"][a:b]
                    keys, ends = gram_keys(data, bounds)
                    grams.append(distinct(keys, np.repeat(learn, np.diff(ends))))
                    found = split_words(data, bounds)
                    words.append(distinct(found.hashes.view(np.int64), np.repeat(learn, found.counts)))
                    tokens += int((found.counts + 1)[learn].sum())
                # one list of each before more are made
                grams, words = [merged(grams)], [merged(words)]
                docs.append(known)
                texts.append(raw.tobytes())
                lengths.append(np.diff(at))
                size += len(raw)
                if size >= most:
                    yield block()
                    give_back()
                    place, docs, texts, lengths, grams, words, tokens, size = place + 1, [], [], [], [], [], 0, 0
        if docs:
            yield block()
        give_back()

    return run


def text_blocks(docs: DataFrame, most: int = TEXT_BYTES) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) as blocks; see ``BLOCK_SCHEMA``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    apart = held_out(F.col("doc_id"))
    docs = docs.select("doc_id", "text", F.coalesce(apart, F.lit(False)).alias("held_out"), F.coalesce(~apart, F.lit(False)).alias("learn"))
    return docs.mapInArrow(_to_blocks(most), BLOCK_SCHEMA)


def _rows(keys: str, counts: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, key, n = (batch.column(batch.schema.get_field_index(c))[i] for c in ("block", keys, counts))
                key, n = np.frombuffer(key.as_buffer(), np.int64), np.frombuffer(n.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), block.as_py())), pa.array(key), pa.array(n)], names=["block", "key", "n"])

    return run


def counted(texts: DataFrame, keys: str, counts: str) -> DataFrame:
    """block, key, n: a row for each distinct gram or word of a block."""
    return texts.select("block", keys, counts).mapInArrow(_rows(keys, counts), "block long, key long, n long")


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural logarithm of the gamma function, for x > 0: Stirling's series eight steps further on."""
    y = x + 8
    steps = sum(np.log(x + k) for k in range(8))
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - steps


def log_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov estimate of a sequence with so many zeros and ones."""
    out = log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)
    return np.where(zeros + ones == 0, 0.0, out)


def weight_of(estimate: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weight of a node's own estimate, and the logarithm of its weighted probability.

    estimate and below: logarithms of K and of the product of the children's W.
    """
    return 1 / (1 + np.exp(np.clip(below - estimate, -700, 700))), np.logaddexp(estimate, below) - math.log(2)


class Trees:
    """Context trees over grams of complete contexts, from depth ``DEPTH`` up to ``top``.

    ids: context and choice of each node of the uppermost level; zeros, ones, log_w: of these.
    """

    def __init__(self, keys: np.ndarray, n: np.ndarray, top: int = TOP) -> None:
        byte = keys & 255
        ids = np.concatenate([(keys >> 8 << 8) | (1 << i) | (byte >> (8 - i)) for i in range(8)])
        self.bit = np.concatenate([(byte >> (7 - i)) & 1 for i in range(8)])
        ids, at = np.unique(ids, return_inverse=True)
        weights = np.tile(n.astype(np.float64), 8)
        ones = np.bincount(at, weights * self.bit, len(ids))
        zeros = np.bincount(at, weights, len(ids)) - ones
        log_w = log_estimate(zeros, ones)
        # of each level: which node of it a choice of a gram, or a node of the level below, stands at
        self.levels = [(at, zeros, ones, None)]
        for _ in range(DEPTH - top):
            ids, at = np.unique((ids >> 16 << 8) | (ids & 255), return_inverse=True)
            zeros, ones, below = (np.bincount(at, x, len(ids)) for x in (zeros, ones, log_w))
            own, log_w = weight_of(log_estimate(zeros, ones), below)
            self.levels.append((at, zeros, ones, own))
        self.ids, self.zeros, self.ones, self.log_w = ids, zeros, ones, log_w

    def predicted(self) -> tuple[np.ndarray, np.ndarray]:
        """For each of the eight choices of each gram: its node of the uppermost level, and its probability below and at that level."""
        at, zeros, ones, _ = self.levels[0]
        p = probability(zeros[at], ones[at], self.bit)
        for up, zeros, ones, own in self.levels[1:]:
            at = up[at]
            w = own[at]
            p = w * probability(zeros[at], ones[at], self.bit) + (1 - w) * p
        return at, p


def probability(zeros: np.ndarray, ones: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """What a node's own counts say of the next choice."""
    return (np.where(bit == 1, ones, zeros) + 0.5) / (zeros + ones + 1)


def _by_contexts(grams: DataFrame, of: Callable[[np.ndarray, np.ndarray], pa.RecordBatch], schema: str, most: int = 1 << 18) -> DataFrame:
    """``of`` applied to runs of grams (key, n), each with all grams of its contexts of ``TOP`` bytes.

    A run ends at the first new context after ``most`` grams, so it has no more than these and one context's.
    """
    context = 8 * (DEPTH - TOP + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            keys, n = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("key", "n"))
            if size >= most:
                own = int(np.searchsorted(keys >> context, held[-1][0][-1] >> context, "right"))
                held.append((keys[:own], n[:own]))
                keys, n = keys[own:], n[own:]
                if not len(keys):
                    continue
                yield of(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, size = [], 0
            if len(keys):
                held.append((keys, n))
                size += len(keys)
        if held:
            yield of(*(np.concatenate(x) for x in zip(*held, strict=True)))
        give_back()

    dealt = grams.withColumn("c", F.shiftright("key", context)).repartition("c").sortWithinPartitions("key").select("key", "n")
    return dealt.mapInArrow(run, schema)


def _tops(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    trees = Trees(keys, n)
    return pa.RecordBatch.from_pydict({"context": trees.ids >> 8, "choice": trees.ids & 255, "zeros": trees.zeros, "ones": trees.ones, "log_w": trees.log_w})


def upper_nodes(grams: DataFrame) -> list[np.ndarray]:
    """Weight, zeros and ones of the nodes above the grouped contexts, each as [context, choice], level by level to the root.

    grams: key, n. The levels have at most 256 and 1 contexts, so what is gathered has a fixed bound.
    """
    nodes = written(_by_contexts(grams, _tops, "context long, choice long, zeros double, ones double, log_w double"), "top-nodes")
    up = nodes.groupBy(F.shiftright("context", 8).alias("context"), "choice").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "log_w")))
    found = up.orderBy("context", "choice").collect()
    discard(nodes)
    out, below = [], np.zeros((3, 256, 256))
    for row in found:
        below[:, row["context"], row["choice"]] = row["zeros"], row["ones"], row["log_w"]
    for _ in range(TOP):
        zeros, ones, log_w = below
        own, log_w = weight_of(log_estimate(zeros, ones), log_w)
        out.append(np.stack([own, zeros, ones]))
        below = np.stack([zeros, ones, log_w]).sum(axis=1, keepdims=True)
    return out


def _lengths(upper: Broadcast):
    def run(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        trees = Trees(keys, n)
        at, p = trees.predicted()
        context, choice = trees.ids[at] >> 16, trees.ids[at] & 255
        for nodes in upper.value:
            own, zeros, ones = nodes[:, context, choice]
            p = own * probability(zeros, ones, trees.bit) + (1 - own) * p
            context = np.zeros_like(context)
        return pa.RecordBatch.from_pydict({"key": keys, "value": np.log10(p).reshape(8, -1).sum(axis=0)})

    return run


def gram_values(grams: DataFrame) -> DataFrame:
    """key, value: log10 probability of the byte of each gram after its context."""
    upper = grams.sparkSession.sparkContext.broadcast(upper_nodes(grams))
    return _by_contexts(grams, _lengths(upper), "key long, value double")


def _look_up(keys: np.ndarray, known: np.ndarray, values: np.ndarray) -> np.ndarray:
    coded = pa.array(keys).dictionary_encode()
    return values[np.searchsorted(known, np.asarray(coded.dictionary))][coded.indices.to_numpy()]


def _asked(asked: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The keys that a block asked for, ascending, and their values."""
    key, value = (asked.column(c).to_numpy() for c in ("key", "value"))
    order = np.argsort(key)
    return key[order], value[order]


def _table(out: dict[str, list]) -> pa.Table:
    give_back()
    return pa.table({c: pa.chunked_array(x) for c, x in out.items()})


def _buffers(texts: pa.Table, row: int, **kinds) -> list[np.ndarray]:
    return [np.frombuffer(texts.column(c)[row].as_buffer(), kind) for c, kind in kinds.items()]


def _word_sums(end_count: int):
    def run(texts: pa.Table, asked: pa.Table) -> pa.Table:
        words, counts = _asked(asked)
        out: dict[str, list] = {x.split()[0]: [] for x in WORD_SCHEMA.split(", ")}
        for i in range(texts.num_rows):
            raw, bounds = _buffers(texts, i, data=np.uint8, bounds=np.int64)
            for first, last, data, at in blocks(raw, bounds):
                found, n = split_words(data, at), last - first
                doc = np.repeat(np.arange(n), found.counts)
                c = _look_up(found.hashes.view(np.int64), words, counts)
                out["block"].append(pa.array(np.full(n, texts.column("block")[i].as_py())))
                out["place"].append(pa.array(np.arange(first, last)))
                out["n_tokens"].append(pa.array(found.counts + 1))
                out["n_known"].append(pa.array(np.bincount(doc[c > 0], minlength=n) + (end_count > 0)))
                out["log_sum"].append(pa.array(np.bincount(doc, np.log10(c + 0.1), n) + math.log10(end_count + 0.1)))
        return _table(out)

    return run


def _scores(texts: pa.Table, asked: pa.Table) -> pa.Table:
    grams, lengths = _asked(asked)
    out: dict[str, list] = {x.split()[0]: [] for x in SCORE_SCHEMA.split(", ")}
    for i in range(texts.num_rows):
        docs, raw, bounds = _buffers(texts, i, docs=DOC, data=np.uint8, bounds=np.int64)
        out["block"].append(pa.array(np.full(len(docs), texts.column("block")[i].as_py())))
        out["place"].append(pa.array(np.arange(len(docs))))
        out["doc_id"].append(pa.array(docs["doc_id"], mask=docs["no_id"]))
        out["held_out"].append(pa.array(docs["held_out"].copy()))
        out["n_bytes"].append(pa.array(np.diff(bounds)))
        for _, _, data, at in blocks(raw, bounds):
            keys, ends = gram_keys(data, at)
            out["score"].append(pa.array(np.add.reduceat(_look_up(keys, grams, lengths), ends[:-1])))
    return _table(out)


def scored(docs: DataFrame, text_bytes: int = TEXT_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and n_bytes of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    # texts are written in buckets of blocks, so that they stay where they are when the values come to them
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.count() // BUCKET_ROWS)
    with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(PART_ROWS)}):
        texts = bucketed(text_blocks(docs, text_bytes), "block", buckets)
    facts = texts.agg(F.sum("learn_tokens"), F.sum("learn_docs")).first()
    tokens, end_count = facts[0] or 0, facts[1] or 0
    def summed(rows: DataFrame, name: str) -> DataFrame:
        return written(rows.groupBy("key").agg(F.sum("n").alias("n")), name)

    def asked(rows: DataFrame, values: DataFrame, columns: list[str], of: Callable[[pa.Table, pa.Table], pa.Table], schema: str, name: str) -> DataFrame:
        """``of`` applied to each block and the values (key, value) of its keys."""
        sides = texts.select("block", *columns).groupBy("block"), rows.join(values, "key").select("block", "key", "value").groupBy("block")
        return written(sides[0].cogroup(sides[1]).applyInArrow(of, schema), name)

    # first the words and then the grams, so that only one of the two is between tasks at a time
    of_words = counted(texts, "words", "word_counts")
    words = summed(of_words, "words")
    distinct_tokens = words.where("n > 0").count() + (end_count > 0)
    counts = words.select("key", F.col("n").cast("double").alias("value"))
    sums = asked(of_words, counts, ["data", "bounds"], _word_sums(end_count), WORD_SCHEMA, "word-sums")
    discard(words)
    of_grams = counted(texts, "grams", "gram_counts")
    grams = summed(of_grams, "grams")
    values = written(gram_values(grams), "gram-values")
    scores = asked(of_grams, values, ["docs", "data", "bounds"], _scores, SCORE_SCHEMA, "scores")
    discard(texts, grams, values)
    found = written(scores.join(sums, ["block", "place"]), "found")
    discard(scores, sums)
    base = F.col("log_sum") - F.col("n_tokens") * math.log10(tokens + 0.1 * (distinct_tokens + 1))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score", "n_bytes")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, and the bits that the model takes for a byte (the end counts as one)."""
    out = scored(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumn("bits_per_byte", -F.col("score") / math.log10(2) / (F.col("n_bytes") + 1))

"""Language-model scoring by cross-entropy difference.

Two bigram models, of the target documents and of all documents, share one vocabulary (all words of the corpus), one order and
one smoothing. A token's loss under a model is the negative logarithm of its probability after the token before it; a document's
score is the mean over its tokens of the target loss less the background loss: the lower, the more like the target.

Every word and every pair of neighbours has its own count, whatever the corpus; both are known by 63-bit fingerprints, so n
different ones are told apart but for about n * n / 2 ** 64 expected clashes (0.3 among 2.4 thousand million). The smoothing allows
for the words of the corpus and one more, unseen one. A target document is scored by a model that holds its own counts, as it is
part of both corpora. Texts are turned into blocks of at most ``BLOCK`` tokens, which are written; a longer text is cut, and each
further piece knows the word before it. A block sends each of its words and pairs once, with its counts, to the
bucket of the fingerprint; the bucket adds up all blocks' counts and answers each block in the order asked; the block then scores
its texts. So a word that occurs everywhere costs each block one number, and no task or driver holds a whole model.

Defined results: NULL and empty texts, and texts without a word, have no token and score 0; rows without a target label, and
NULL ids, are background only; labels of one document that disagree count by majority, 1 on a tie; repeated rows are counted
and scored each; without target documents the target model is uniform; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparcel.llm.common import document_text, free, fresh, one_label, written
from sparcel.session import ship

#: Added counts: of a word in all, and of the word model in each context.
FLOOR, WEIGHT = 0.1, 4.0
#: The context of a document's first token; its place among a block's words.
BEGIN = 0
#: Tokens of a block at most; buckets at least, and the tokens of the corpus for which there is one.
BLOCK, BUCKETS, BUCKET = 1 << 18, 256, 1 << 21

COUNTS = "block bigint, bucket int, n_words bigint, t binary, b binary"


def tokens(text: str = "text") -> Column:
    """Hashes of a text's lower-case words."""
    words = F.split(F.lower(document_text(text)), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def pack(numbers: np.ndarray) -> bytes:
    """Numbers byte by byte of their places, low ones first; places in which all are zero are left out, and their number goes ahead."""
    planes = np.ascontiguousarray(numbers).view(np.uint8).reshape(len(numbers), numbers.itemsize).T
    used = int(np.flatnonzero(np.append(True, planes[1:].any(axis=1)))[-1]) + 1
    return bytes([used]) + planes[:used].tobytes()


def unpack(data: bytes, kind: type) -> np.ndarray:
    used = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    planes = np.zeros((used.shape[1], np.dtype(kind).itemsize), np.uint8)
    planes[:, : len(used)] = used.T
    return planes.view(kind).ravel()


def pair_keys(context: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Odd fingerprints of pairs of words; those of words are even."""
    mixed = context * np.uint64(0x9E3779B97F4A7C15) + words
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed ^ (mixed >> np.uint64(32))) | np.uint64(1)


def contexts(codes: np.ndarray, lengths: np.ndarray, leads: np.ndarray) -> np.ndarray:
    """The word before each word of pieces of these lengths; ``leads`` stand before the pieces."""
    context = np.concatenate((leads[:1], codes[:-1]))[: len(codes)]
    starts = np.cumsum(lengths) - lengths
    context[starts[lengths > 0]] = leads[lengths > 0]
    return context


def edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's part of sorted ``keys`` begins."""
    of = (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    return np.searchsorted(of, np.arange(buckets + 1, dtype=np.uint64))


class _Block:
    """Pieces of texts up to ``BLOCK`` tokens."""

    def __init__(self):
        self.size, self.docs, self.digests = 0, [], []
        self.rows, self.lengths, self.flat, self.leads = ([np.zeros(0, t)] for t in (np.int64, np.int64, np.uint64, np.uint64))

    def add(self, docs: pa.Array, digests: pa.Array, rows: np.ndarray, lengths: np.ndarray, flat: np.ndarray, leads: np.ndarray) -> None:
        for to, part in zip((self.docs, self.digests, self.rows, self.lengths, self.flat, self.leads), (docs, digests, rows, lengths, flat, leads)):
            to.append(part)
        self.size += len(flat)

    def batch(self, number: int) -> pa.RecordBatch:
        rows, lengths, flat, leads = (np.concatenate(x) for x in (self.rows, self.lengths, self.flat, self.leads))
        words, codes = np.unique(np.concatenate((np.zeros(1, np.uint64), flat, leads)), return_inverse=True)
        docs, digests = pa.concat_arrays(self.docs), pa.concat_arrays(self.digests)
        whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        out = {
            "block": pa.array([number], pa.int64()), "n_tokens": pa.array([len(flat)], pa.int64()), "digests": whole(digests),
            "rows": whole(pa.array(rows)), "lengths": whole(pa.array(lengths.astype(np.int32))), "words": pa.array([pack(words)], pa.binary()),
            "codes": pa.array([pack(codes[1 : len(flat) + 1].astype(np.uint32))], pa.binary()),
            "leads": pa.array([pack(codes[len(flat) + 1 :].astype(np.uint32))], pa.binary()), "doc_ids": whole(docs),
        }
        return pa.RecordBatch.from_pydict(out)


def block_texts(documents: DataFrame) -> DataFrame:
    """The texts in blocks: ids, text digests and row numbers of their pieces, lengths, sorted distinct words (``BEGIN`` first), each
    token's place in them, and the place of the word before each piece."""
    rows = documents.select("doc_id", F.unhex(F.sha2(document_text().cast("binary"), 256)).alias("digest"), tokens().alias("words"))
    kind = T.ArrayType(documents.schema["doc_id"].dataType)
    schema = T.StructType.fromDDL("block bigint, n_tokens bigint, digests array<binary>, rows array<bigint>, lengths array<int>, words binary, codes binary, leads binary").add("doc_ids", kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        row, held = TaskContext.get().partitionId() << 40, _Block()
        for batch in batches:
            column, docs, digests = batch.column(2), batch.column(0), batch.column(1)
            lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(lengths)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64) & np.uint64(2**64 - 2)
            at = 0
            while at < len(lengths):
                begin = int(ends[at] - lengths[at])
                stop = int(np.searchsorted(ends, begin + BLOCK - held.size, "right"))
                if stop > at:  # whole texts
                    held.add(docs.slice(at, stop - at), digests.slice(at, stop - at), row + np.arange(at, stop), lengths[at:stop], flat[begin : ends[stop - 1]], np.zeros(stop - at, np.uint64))
                    at = stop
                elif lengths[at] <= BLOCK or held.size >= BLOCK:
                    yield held.batch(number)
                    number, held = number + 1, _Block()
                else:  # a text longer than a block, piece by piece
                    done = 0
                    while done < lengths[at]:
                        size = min(BLOCK - held.size, int(lengths[at]) - done)
                        lead = flat[begin + done - 1 : begin + done] if done else np.zeros(1, np.uint64)
                        held.add(docs.slice(at, 1), digests.slice(at, 1), np.array([row + at]), np.array([size]), flat[begin + done : begin + done + size], lead)
                        done += size
                        if held.size >= BLOCK:
                            yield held.batch(number)
                            number, held = number + 1, _Block()
                    at += 1
            row += len(lengths)
        if held.docs:
            yield held.batch(number)

    return rows.mapInArrow(run, schema)


def _pairs(row: dict) -> tuple[np.ndarray, ...]:
    """Of a block: lengths, leads, words, and each token's place, context, distinct pairs and place among these."""
    lengths = np.array(row["lengths"], np.int64)
    words, codes, leads = unpack(row["words"], np.uint64), *(unpack(row[k], np.uint32).astype(np.int64) for k in ("codes", "leads"))
    context = contexts(codes, lengths, leads)
    pairs, places = np.unique(pair_keys(words[context], words[codes]), return_inverse=True)
    return lengths, leads, words, codes, context, pairs, places


def count_blocks(blocks: DataFrame, target: DataFrame) -> DataFrame:
    """Answers to the blocks: for each bucket the counts of a block's words, then of its pairs, in the order of their fingerprints.

    ``t`` counts the documents whose ``doc_id`` is in ``target`` (distinct ids), ``b`` all. A row without a block has the number
    of a bucket's words, and the sums of their counts.
    """
    buckets = max(BUCKETS, (blocks.agg(F.sum("n_tokens")).first()[0] or 0) // BUCKET)
    ids = target.select(F.col("doc_id").alias("_target"))
    marked = blocks.select("block", F.posexplode("doc_ids").alias("place", "doc_id")).join(ids, F.col("doc_id") == F.col("_target"))
    marked = marked.groupBy(F.col("block").alias("_of")).agg(F.collect_list("place").alias("marked"))
    # written, so that its true size decides how it is joined
    rows = blocks.select("block", "lengths", "words", "codes", "leads").join(written(marked, "marked"), F.col("block") == F.col("_of"), "left").drop("_of")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist()):
            lengths, leads, words, codes, _, pairs, places = _pairs(row)
            is_target = np.zeros(len(lengths), bool)
            is_target[row["marked"] or []] = True
            of_target = np.repeat(is_target, lengths)
            counts = []
            for chosen, texts in ((of_target, is_target), (slice(None), slice(None))):
                of_words = np.bincount(codes[chosen], minlength=len(words))
                # the beginning counts as a context once for each text that has a word
                of_words[BEGIN] += np.count_nonzero((lengths > 0)[texts] & (leads == BEGIN)[texts])
                counts.append((of_words, np.bincount(places[chosen], minlength=len(pairs))))
            of_words, of_pairs = edges(words, buckets), edges(pairs, buckets)
            out = []
            for k in range(buckets):
                w, p = slice(*of_words[k : k + 2]), slice(*of_pairs[k : k + 2])
                if w.stop > w.start or p.stop > p.start:
                    t, b = (pack(np.concatenate((x[w], y[p]))) for x, y in counts)
                    out.append((row["block"], k, w.stop - w.start, t, b, pack(np.diff(np.concatenate((words[w], pairs[p])), prepend=np.uint64(0)))))
            names = ["block", "bucket", "n_words", "t", "b", "keys"]
            yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in out], schema=asked)

    asked = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("n_words", pa.int64()), ("t", pa.binary()), ("b", pa.binary()), ("keys", pa.binary())])
    answered = pa.schema([*list(asked)[:5], ("sum_t", pa.int64()), ("sum_b", pa.int64())])

    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        # keys are sent as steps from the key before, which are small
        parts = [np.cumsum(unpack(x, np.uint64), dtype=np.uint64) for x in rows.pop("keys")]
        ends = np.cumsum([len(x) for x in parts])
        keys, places = np.unique(np.concatenate(parts), return_inverse=True)
        is_word = keys & np.uint64(1) == 0
        out = {"block": [*rows["block"], None], "bucket": [*rows["bucket"], rows["bucket"][0]], "n_words": [*rows["n_words"], int((is_word & (keys > 0)).sum())]}
        for name in "tb":
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, places, np.concatenate([unpack(x, np.int64) for x in rows.pop(name)]))
            out[name] = [*(pack(x) for x in np.split(sums[places], ends[:-1])), None]
            out[f"sum_{name}"] = [None] * len(ends) + [int(sums[is_word].sum())]
        return pa.table(out, schema=answered)

    return rows.mapInArrow(ask, f"{COUNTS}, keys binary").groupBy("bucket").applyInArrow(answer, f"{COUNTS}, sum_t bigint, sum_b bigint")


def score_blocks(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """``doc_id``, ``digest``, ``n_tokens``, mean losses and score of each text of ``blocks``, by the written answers to them."""
    sums = counts.where("block IS NULL").agg(F.sum("n_words"), F.sum("sum_t"), F.sum("sum_b")).first()
    size, totals = (sums[0] or 0) + 1, [float(x or 0) for x in sums[1:]]
    kind = "row bigint, digest binary, n_tokens bigint, target_loss double, background_loss double"
    schema = T.StructType([T.StructField("doc_id", blocks.schema["doc_ids"].dataType.elementType), *T.StructType.fromDDL(kind)])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.slice(0, 1).to_pylist()[0]
        lengths, _, words, codes, context, pairs, places = _pairs(row)
        answers = sorted(right.select(["bucket", "n_words", "t", "b"]).to_pylist(), key=lambda x: x["bucket"])
        owner = np.repeat(np.arange(len(lengths)), lengths)
        out = {"doc_id": left["doc_ids"].chunk(0).slice(0, 1).flatten(), "row": row["rows"], "digest": left["digests"].chunk(0).slice(0, 1).flatten(), "n_tokens": lengths}
        for key, name, total in zip(("target_loss", "background_loss"), "tb", totals):
            both = [np.split(unpack(x[name], np.int64), [x["n_words"]]) for x in answers]
            of_words, of_pairs = (np.concatenate(x) for x in zip(*both))
            share = (of_words + FLOOR) / (total + FLOOR * size)
            loss = -np.log((of_pairs[places] + WEIGHT * share[codes]) / (of_words[context] + WEIGHT))
            out[key] = np.bincount(owner, loss, len(lengths)).astype(np.float64)
        return pa.table(out)

    pieces = blocks.groupBy("block").cogroup(counts.where("block IS NOT NULL").groupBy("block")).applyInArrow(score, schema)
    texts = pieces.groupBy("doc_id", "digest", "row").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "target_loss", "background_loss")])
    mean = [(F.col(c) / F.greatest("n_tokens", F.lit(1))).alias(c) for c in ("target_loss", "background_loss")]
    return texts.select("doc_id", "digest", "n_tokens", *mean).withColumn("score", F.col("target_loss") - F.col("background_loss"))


def cross_entropy_difference(documents: DataFrame, labels: DataFrame, name: str = "lm") -> DataFrame:
    """``documents`` with a struct ``name``: ``n_tokens``, mean ``target_loss`` and ``background_loss``, and ``score``, their difference.

    The target are the documents that ``labels`` marks with ``quality`` 1. Losses go back to the rows by id and text, as rows of
    equal id and text have equal losses. A table that has a column ``name`` already is an error.
    """
    free(documents, name)
    ship(documents.sparkSession)
    target = one_label(labels, "quality").where("label = 1")
    blocks = written(block_texts(documents), "blocks")
    scores = score_blocks(blocks, written(count_blocks(blocks, target), "counts"))
    key, of, held = (fresh(documents, x) for x in ("lm_digest", "lm_doc", "lm_score"))
    fields = ["n_tokens", "target_loss", "background_loss", "score"]
    scores = scores.groupBy(F.col("doc_id").alias(of), F.col("digest").alias(f"{key}_of")).agg(F.first(F.struct(*fields)).alias(held))
    rows = documents.withColumn(key, F.unhex(F.sha2(document_text().cast("binary"), 256)))
    same = F.col("doc_id").eqNullSafe(F.col(of)) & (F.col(key) == F.col(f"{key}_of"))
    return rows.join(scores, same, "left").withColumn(name, F.col(held)).drop(key, f"{key}_of", of, held)

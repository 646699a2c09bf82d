"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

1. A bounded sample of labelled rows (``per_class`` of each label, by a hash of the id, and ``max_bytes`` of text) gives the
   examples.  Their words, all of them, are the vocabulary.
2. A word's weight is its idf over all documents times its relevance: ``floor`` to 1, by how significantly its share of
   toxic contexts is high (G squared, one-sided).  A document has one context for each of its words: the word with a
   word before it (of several, that of the smallest hash).  Equal contexts count once, so neither copies of a passage nor
   repeats in one document add up.  No word is left out: those that say nothing of the label weigh a tenth.
3. The index: examples in blocks; for each word and block the largest value.  Words that many examples have are rows
   of a matrix, others are lists.  A document's nearest examples are found exactly: blocks come by falling bound,
   and a block is read unless its bound is below the k-th best.  Documents are searched many at a time.
4. Votes weighted by nearness, with a prior, calibrated on the examples themselves, each left out of its own vote
   (pool-adjacent-violators).

The index is broadcast: its size is bounded by ``per_class`` and ``max_bytes``, not by the data.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm import _common as c
from gridloom.llm.substring_dedup import words_of

_U64 = np.uint64
#: Letters of ASCII in lower case, other ASCII characters as blanks, other bytes as they are.
_FOLD = np.array([ord(chr(b).lower()) if chr(b).isalpha() and b < 128 else 32 if b < 128 else b for b in range(256)], np.uint8)
BLOCK = 64
#: Documents that are searched together, entries of lists that are added at once, and bytes of text that are split in words at once.
BATCH, POSTINGS, WORD_BYTES = 64, 1 << 18, 4 << 20


def term_hashes(ids: np.ndarray, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the folded words of all the texts in order, the number of words of each)."""
    tags = np.zeros(len(ids), np.uint32)
    return words_of(c.Texts(ids, offsets, _FOLD[data], tags))


def _flushed(batches):
    """(ids column, offsets, bytes) of batches of (id, body, ...), cut to bounded sizes, with the batch itself."""
    for batch in batches:
        sizes = np.diff(c.binary_parts(batch.column(1))[0])
        at = 0
        while at < len(batch):
            n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), WORD_BYTES, side="right")))
            part = batch.slice(at, n)
            yield part, *c.binary_parts(part.column(1))
            at += n


def example_words(examples: DataFrame) -> list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_id, label, distinct word hashes, times, contexts) of each example (doc_id, body, label); bounded, so collected."""

    def run(batches):
        for part, offsets, data in _flushed(batches):
            h, counts = term_hashes(np.arange(len(part)), offsets, data)
            before = np.r_[_U64(0), h[:-1]]
            starts = np.cumsum(counts) - counts
            before[starts[counts > 0]] = 0
            ctx = c.mix(before ^ (h * _U64(0x9E3779B97F4A7C15)))
            doc = np.repeat(np.arange(len(part)), counts)
            order = np.lexsort((ctx, h, doc))
            head = np.flatnonzero(np.r_[True, (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])]) if len(order) else order
            times = np.diff(np.r_[head, len(order)]).astype(np.uint32)
            first = order[head]
            cut = np.searchsorted(doc[first], np.arange(len(part) + 1))
            packed = [c.pack(h[first[a:b]], times[a:b], ctx[first[a:b]]) for a, b in zip(cut, cut[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(packed, pa.binary())], names=["doc_id", "label", "words"])

    got = examples.mapInArrow(c.tidy(run), "doc_id long, label int, words binary").collect()
    return [(r.doc_id, r.label, *c.unpack(bytes(r.words))) for r in sorted(got, key=lambda r: (r.doc_id, r.label))]


def relevance(word: np.ndarray, ctx: np.ndarray, label: np.ndarray, size: int, floor: float, significance: float) -> np.ndarray:
    """For each of ``size`` words, floor to 1: by the G squared of its contexts (word, context, label) for label 1, of which ``significance`` gives the middle."""
    order = np.lexsort((label, ctx, word))
    word, ctx, label = word[order], ctx[order], label[order]
    once = np.r_[True, (word[1:] != word[:-1]) | (ctx[1:] != ctx[:-1])] if len(word) else np.zeros(0, bool)
    n = np.bincount(word[once], minlength=size).astype(float)
    k = np.bincount(word[once], weights=label[once].astype(float), minlength=size)
    total, ones = n.sum(), k.sum()
    if not 0 < ones < total:
        return np.ones(size)

    def part(x, expected):
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-300) / expected), 0.0)

    p = ones / total
    g = 2 * (part(k, n * p) + part(n - k, n * (1 - p)) + part(ones - k, (total - n) * p) + part(total - ones - (n - k), (total - n) * (1 - p)))
    g = np.where((n >= 2) & (k > n * p), g, 0.0)
    return floor + (1 - floor) * g**4 / (g**4 + significance**4)


def document_frequencies(rows: DataFrame, words: np.ndarray) -> tuple[int, np.ndarray]:
    """(documents, documents with each of the sorted word hashes) over all rows (doc_id, body)."""
    shared = rows.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        words = shared.value
        total, df = 0, np.zeros(len(words), np.int64)
        for part, offsets, data in _flushed(batches):
            h, counts = term_hashes(np.arange(len(part)), offsets, data)
            at, known = _found(words, h)
            key = np.unique(np.repeat(np.arange(len(part)), counts)[known] * len(words) + at[known]) if len(words) else np.zeros(0, np.int64)
            df += np.bincount(key % max(1, len(words)), minlength=len(words))
            total += len(part)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, some]), pa.array(np.r_[total, df[some]])], names=["word", "n"])

    df, total = np.zeros(len(words), np.int64), 0
    for batch in rows.mapInArrow(c.tidy(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow().to_batches():
        word, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        df[word[word >= 0]] = n[word >= 0]
        total += int(n[word < 0].sum())
    shared.destroy()
    return total, df


def _found(words: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the place of each hash among the sorted words, whether it is there)."""
    if not len(words):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(words, h), len(words) - 1)
    return at, words[at] == h


class Vectors:
    """Unit TF-IDF vectors of some documents: places in the vocabulary and values, row by row; words that aren't in it only lengthen a vector."""

    def __init__(self, n: int, doc: np.ndarray, word: np.ndarray, value: np.ndarray, rest: np.ndarray):
        size = np.sqrt(np.bincount(doc, weights=value * value, minlength=n) + rest)
        self.n, self.doc, self.word = n, doc, word
        self.value = value / size[doc]

    def take(self, rows: np.ndarray) -> Vectors:
        """Some rows, in rising order, numbered anew."""
        new = np.full(self.n, -1)
        new[rows] = np.arange(len(rows))
        at = np.flatnonzero(new[self.doc] >= 0)
        out = Vectors.__new__(Vectors)
        out.n, out.doc, out.word, out.value = len(rows), new[self.doc[at]], self.word[at], self.value[at]
        return out


class ExampleIndex:
    """Unit TF-IDF vectors of labelled examples, as inverted lists cut in blocks of examples."""

    def __init__(self, examples: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]], words: np.ndarray, weight: np.ndarray, unknown: float, class_weight: tuple[float, float], k: int, prior_weight: float):
        self.words, self.by_word, self.unknown, self.k, self.prior_weight = words, weight, unknown, k, prior_weight
        labels = np.array([e[1] for e in examples], int)
        share = np.array([class_weight[y] for y in labels.tolist()])
        empty = np.array([not len(e[2]) for e in examples], bool)
        self.prior = float((share * labels).sum() / share.sum()) if len(labels) else 0.0
        #: the score of a document that shares no word with an example: the share among examples without words
        self.none = float((share * labels)[empty].sum() + self.prior) / float(share[empty].sum() + 1)
        full = np.flatnonzero(~empty)
        doc = np.repeat(np.arange(len(full)), [len(examples[i][2]) for i in full]) if len(full) else np.zeros(0, int)
        word = np.searchsorted(words, np.concatenate([examples[i][2] for i in full])) if len(full) else doc
        times = np.concatenate([examples[i][3] for i in full]) if len(full) else doc
        own = self.vectors(len(full), doc, word, times, np.zeros(len(full)))
        # examples that are alike stand in one block: by the heaviest word that says something of the label, then by the commonest word
        held = np.bincount(word, minlength=len(words))
        by = np.lexsort((-own.value, doc))
        heavy = own.word[by[np.searchsorted(doc, np.arange(len(full)))]] if len(full) else doc
        by = np.lexsort((-held[word], doc))
        common = word[by[np.searchsorted(doc, np.arange(len(full)))]] if len(full) else doc
        order = np.lexsort((np.arange(len(full)), heavy, common, labels[full]))
        place = np.empty(len(full), int)
        place[order] = np.arange(len(full))
        full = full[order]
        self.labels, self.ids, self.weight = labels[full].astype(float), np.array([examples[i][0] for i in full], np.int64), share[full]
        self.blocks = -(-len(full) // BLOCK)
        self.width = self.blocks * BLOCK
        self.dense = np.flatnonzero(held > max(BLOCK, len(full) // 20))
        row = np.full(len(words), -1, np.int32)
        row[self.dense] = np.arange(len(self.dense))
        self.row = row
        thick = row[word] >= 0
        self.matrix = np.zeros((len(self.dense), self.width))
        self.matrix[row[word[thick]], place[doc[thick]]] = own.value[thick]
        self.top = self.matrix.reshape(len(self.dense), self.blocks, BLOCK).max(axis=2) if self.blocks else np.zeros((len(self.dense), 0))
        thin = np.flatnonzero(~thick)
        thin = thin[np.lexsort((place[doc[thin]], word[thin]))]
        self.at, self.value = place[doc[thin]].astype(np.int32), own.value[thin]
        self.begin = np.searchsorted(word[thin], np.arange(len(words) + 1))
        raw = np.zeros(len(full))
        mine = own.take(np.arange(len(full)))
        for a in range(0, len(full), BATCH):
            rows = np.arange(a, min(a + BATCH, len(full)))
            found, score = self.nearest(mine.take(rows), leave=place[rows])
            raw[place[rows]] = self.vote(found, score)
        self.steps = monotone(raw, self.labels, self.weight)

    def vectors(self, n: int, doc: np.ndarray, word: np.ndarray, times: np.ndarray, rest: np.ndarray) -> Vectors:
        return Vectors(n, doc, word, (1 + np.log(times)) * self.by_word[word], rest)

    def documents(self, h: np.ndarray, counts: np.ndarray) -> Vectors:
        """The vectors of documents with these word hashes, row by row."""
        at, known = _found(self.words, h)
        doc = np.repeat(np.arange(len(counts)), counts)
        key, times = np.unique(doc[known] * max(1, len(self.words)) + at[known], return_counts=True)
        other = ~known
        order = np.lexsort((h[other], doc[other]))
        x, y = doc[other][order], h[other][order]
        head = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) if len(x) else np.zeros(0, int)
        many = np.diff(np.r_[head, len(x)])
        rest = np.bincount(x[head], weights=((1 + np.log(many)) * self.unknown) ** 2, minlength=len(counts)) if len(x) else np.zeros(len(counts))
        return self.vectors(len(counts), key // max(1, len(self.words)), key % max(1, len(self.words)), times, rest)

    def nearest(self, own: Vectors, leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines), each documents by k: the nearest, nearest first, ties by number; exact.  -1 where there are fewer."""
        n, nb = own.n, self.blocks
        if not nb:
            return np.full((n, self.k), -1), np.zeros((n, self.k))
        row = self.row[own.word]
        query = np.zeros((n, len(self.dense)))
        query[own.doc[row >= 0], row[row >= 0]] = own.value[row >= 0]
        thin = row < 0
        size = (self.begin[own.word[thin] + 1] - self.begin[own.word[thin]]).astype(np.int64)
        first, doc, value = self.begin[own.word[thin]], own.doc[thin], own.value[thin]
        sums, cuts = np.zeros(n * self.width), np.searchsorted(np.cumsum(size), np.arange(0, int(size.sum()) + POSTINGS, POSTINGS))
        for a, b in zip(cuts, [*cuts[1:], len(size)], strict=True):  # long texts have many
            if b > a:
                at = c.ranges(first[a:b], size[a:b])
                sums += np.bincount(np.repeat(doc[a:b], size[a:b]) * self.width + self.at[at], weights=self.value[at] * np.repeat(value[a:b], size[a:b]), minlength=n * self.width)
        sums = sums.reshape(n, nb, BLOCK)
        bound = query @ self.top + sums.max(axis=2)
        rank = np.argsort(np.argsort(-bound, axis=1, kind="stable"), axis=1)
        read, score = np.zeros((n, nb), bool), np.full((n, nb, BLOCK), -1.0)
        least = np.zeros(n)
        for step in (4, 12, nb):
            need = ~read & (bound > 0) & (bound >= least[:, None] - 1e-9) & (rank < step)
            for b in np.flatnonzero(need.any(axis=0)).tolist():
                docs = np.flatnonzero(need[:, b])
                score[docs, b] = sums[docs, b] + query[docs] @ self.matrix[:, b * BLOCK : (b + 1) * BLOCK]
            read |= need
            flat = np.round(score.reshape(n, -1), 12)
            if leave is not None:
                flat[np.arange(n), leave] = -1.0
            flat[flat == 0] = -1.0
            if self.k < flat.shape[1]:
                least = -np.partition(-flat, self.k - 1, axis=1)[:, self.k - 1]
        order = np.argsort(-flat, axis=1, kind="stable")[:, : self.k]
        best = np.take_along_axis(flat, order, axis=1)
        found = np.where(best > 0, order, -1)
        if found.shape[1] < self.k:
            pad = ((0, 0), (0, self.k - found.shape[1]))
            found, best = np.pad(found, pad, constant_values=-1), np.pad(best, pad)
        return found, np.maximum(best, 0.0)

    def vote(self, found: np.ndarray, score: np.ndarray) -> np.ndarray:
        w = score * np.where(found >= 0, self.weight[found], 0.0) if len(self.weight) else score
        ones = (w * self.labels[found]).sum(axis=1) if len(self.labels) else np.zeros(len(w))
        return (ones + self.prior_weight * self.prior) / (w.sum(axis=1) + self.prior_weight)

    def score(self, own: Vectors) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(calibrated scores, examples, cosines) of some documents."""
        found, near = self.nearest(own)
        x, y = self.steps
        scores = np.interp(self.vote(found, near), x, y) if len(x) else np.full(own.n, self.none)
        return np.where((found >= 0).any(axis=1), scores, self.none), found, near


def monotone(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: means of x and of y (with one pseudo-count of 0 and of 1 each) for each pool, by rising x."""
    pools: list[list[float]] = []
    for i in np.argsort(x, kind="stable").tolist():
        pools.append([w[i] * x[i], w[i] * y[i], w[i]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([(p[1] + 0.5) / (p[2] + 1) for p in pools])


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 1500, max_bytes: int = 32 << 20, significance: float = 16.0, floor: float = 0.1, k: int = 15, prior_weight: float = 0.3, evidence: int = 3, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", with_row: bool = False) -> DataFrame:
    """Scores every row of ``docs``: doc_id, score (0 to 1), evidence (the nearest examples: doc_id, similarity, label), and the row itself as a struct if ``with_row``.

    ``labels`` (doc_id, label 0 or 1) names the rows of ``docs`` to learn from; at most ``per_class`` of each label are
    used, chosen by a hash of doc_id, and of these as many as have ``max_bytes`` of text together.  Rows whose label or
    doc_id is null teach nothing; of repeated labels the larger counts, of rows that share a doc_id the text that sorts first.
    Null texts count as empty; texts that share no word with an example get the share of label 1 among examples without
    words.  Without examples of both labels all scores are equal.  Long texts count whole, repeated rows are kept, an empty
    table gives an empty result, and other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    sizes = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    ranked = [known.filter(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    sample = c.checkpoint(ranked[0].union(ranked[1]))
    rows = c.text_rows(docs, text, doc_id)
    examples = rows.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("body").alias("body"))  # at most 2 x per_class rows
    so_far = F.sum(F.octet_length("body")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    examples = c.checkpoint(examples.withColumn("so_far", so_far).filter(F.col("so_far") <= max_bytes).select("doc_id", "body", "label"))
    got = example_words(examples)
    words, place = np.unique(np.concatenate([e[2] for e in got]) if got else np.zeros(0, _U64), return_inverse=True)
    own = np.array([e[1] for e in got], int)
    each = np.repeat(own, [len(e[2]) for e in got]) if got else own
    relevant = relevance(place, np.concatenate([e[4] for e in got]) if got else words, each, len(words), floor, significance)
    total, df = document_frequencies(rows, words)
    weights = tuple(sizes.get(y, 0) / max(1, int((own == y).sum())) for y in (0, 1))
    scale = sum(w * int((own == y).sum()) for y, w in enumerate(weights)) / max(1, len(own))
    both = 0 < int(own.sum()) < len(own)
    index = ExampleIndex(got if both else [], words, relevant * (np.log((1 + total) / (1 + df)) + 1), floor * (np.log(1 + total) + 1), tuple(w / scale if scale else 1.0 for w in weights), k, prior_weight)
    shared = spark.sparkContext.broadcast(index)
    del index, got, words, place, each, relevant, df
    c.released()

    def run(batches):
        index = shared.value
        for batch, offsets, data in _flushed(batches):
            h, counts = term_hashes(np.arange(len(batch)), offsets, data)
            cuts = np.r_[0, np.cumsum(counts)]
            for a in range(0, len(batch), BATCH):
                part = batch.slice(a, BATCH)
                b = a + len(part)
                score, found, near = index.score(index.documents(h[cuts[a] : cuts[b]], counts[a:b]))
                lists = [[{"doc_id": int(index.ids[j]), "similarity": float(x), "label": int(index.labels[j])} for j, x in zip(f, s, strict=True) if j >= 0] for f, s in zip(found[:, :evidence].tolist(), near[:, :evidence].tolist(), strict=True)]
                lists = pa.array(lists, pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("label", pa.int32())])))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score, pa.float64()), lists, *(part.column(i) for i in range(2, part.num_columns))], names=["doc_id", "score", "evidence", *part.schema.names[2:]])

    row, field = c.whole_row(docs)
    source, more = (c.text_rows(docs, text, doc_id, row), [field]) if with_row else (rows, [])
    return source.mapInArrow(c.tidy(run), c.schema_of("doc_id long, score double, evidence array<struct<doc_id:long,similarity:double,label:int>>", *more))


def teaching(labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The labels that may be learned from: crc32 of the id's digits, mod 4, isn't 2."""
    return labels.filter(~held_out(doc_id))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))

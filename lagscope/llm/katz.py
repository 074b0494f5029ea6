"""A Katz back-off language model of words, and the score of every text under it.

Tokens are lower-cased (A-Z) words ``[^\\x20\\x09-\\x0D]+`` and one end after each text; the first token
follows an end. Counts come from the training documents (crc32(doc_id as text) mod 7 is not 2).

    p(w)     = d1(c(w)) c(w) / N,             all unseen words together have what the discounts free
    p(w | u) = d2(c(u,w)) c(u,w) / c(u)       if c(u,w) > 0
             = a(u) p(w)                      if c(u) > 0
             = p(w)                           else

d1 and d2 are Good-Turing discounts of counts up to ``LARGEST`` (Katz's form, with the largest range
for which all lie in (0, 1]; absolute discounts of 0.5 where there is none). a(u) is what the discounts
free after u, over 1 - the sum of p(w) of all w seen after u, from the counts of counts after u: so the
probabilities after every u add up to 1. Where nothing is freed, one count is added to the total.

Tables. Texts are packed into chunks as numbers into their own word list. Each chunk sends its words and
training counts to buckets of the word; the answers, the table of unigrams, give each word its total and
a number. Then it sends its pairs, with the words' totals, to buckets of the first word; the answers, the
table of bigrams, give each pair its total and each first word its counts of counts. Both tables are
partitioned by bucket and chunk, and each chunk evaluates its tokens with its own parts.

A word that stands before more than ``HOT`` tokens, and more than a share of 1 / ``HOT_SHARES``, has its
pairs dealt over many buckets by the second word; its counts of counts are summed up from them, a list of
at most 2 * ``HOT_SHARES`` entries.

Null text: the empty text, one end token. Null doc_id: scored, held_out is null, not learnt from. Repeated
rows count and are scored each. Without training documents every token has probability 1 (of "unseen").
Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagscope.llm.arrays import LOWER, find_words, mix, pack, pack_sorted, small_batches, text_bytes, unpack, unpack_sorted, word_array, word_ids
from lagscope.llm.exchange import NOTE, Reply, answer, ask, bring, write_chunks
from lagscope.session import store

FOLDS = 7
HELD = 2
LARGEST = 7
CHUNK = 8 << 20
BUCKET_WORDS = 1 << 21
HOT = 500_000
HOT_SHARES = 50_000
END = xxhash.xxh64_intdigest(b" end")  # holds a space, so it is no word

SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def discounts(n: list[int]) -> np.ndarray:
    """Discount of each count from 0 to LARGEST + 1 (the last for all above), from how many types have counts 1, 2, ..."""
    out = np.ones(LARGEST + 2)
    for k in range(LARGEST, 0, -1):
        if all(n[: k + 1]):
            cut = (k + 1) * n[k] / n[0]
            r = np.arange(1, k + 1)
            d = (((r + 1) * np.array(n[1 : k + 1]) / (r * np.array(n[:k]))) - cut) / (1 - cut) if cut != 1 else np.zeros(k)
            if ((d > 0) & (d <= 1)).all() and d[0] < 1:
                out[1 : k + 1] = d
                return out
    out[1:] = 1 - 0.5 / np.arange(1, LARGEST + 2)
    out[-1] = 1.0
    return out


def freed(d: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Counts that the discounts take away: ``n`` has types with counts 1 to LARGEST in its columns."""
    return n @ ((1 - d[1:-1]) * np.arange(1, LARGEST + 1))


class Unigrams:
    """Probabilities of words by their counts."""

    def __init__(self, total: int, types: int, n: list[int]):
        self.total, self.types = total, types
        self.d = discounts(n)
        gone = float(freed(self.d, np.array([n[:LARGEST]]))[0])
        self.scale = total if gone > 0 else total + 1  # one count more where nothing is freed
        self.unseen = (gone if gone > 0 else 1.0) / self.scale

    def chance(self, count: np.ndarray) -> np.ndarray:
        known = self.d[np.minimum(count, LARGEST + 1)] * count / max(self.scale, 1)
        return np.where(count > 0, known, self.unseen)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1) / (self.total + self.types + 1))


class Contexts:
    """Counts of counts after first words: total, types by their pair's count, types by the second word's count, and the sum of larger ones."""

    def __init__(self, total: np.ndarray, by_pair: np.ndarray, by_word: np.ndarray, larger: np.ndarray):
        self.total, self.by_pair, self.by_word, self.larger = total, by_pair, by_word, larger

    def columns(self) -> list[np.ndarray]:
        return [self.total.astype(np.uint64), *self.by_pair.T.astype(np.uint32), *self.by_word.T.astype(np.uint32), self.larger.astype(np.uint64)]

    @classmethod
    def of_columns(cls, columns: list[np.ndarray]) -> Contexts:
        total, *rest, larger = (c.astype(np.int64) for c in columns)
        return cls(total, np.stack(rest[:LARGEST], axis=1), np.stack(rest[LARGEST:], axis=1), larger)

    def take(self, at: np.ndarray) -> Contexts:
        return Contexts(self.total[at], self.by_pair[at], self.by_word[at], self.larger[at])

    def backoff(self, uni: Unigrams, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Divisor of discounted counts, and the weight of the lower order, of each first word."""
        gone = freed(d, self.by_pair)
        divisor = np.where(gone > 0, self.total, self.total + 1).astype(float)
        gone = np.where(gone > 0, gone, 1.0)
        seen = (self.larger + self.by_word @ (uni.d[1:-1] * np.arange(1, LARGEST + 1))) / max(uni.scale, 1)
        return divisor, gone / divisor / (1 - seen)


def count_words(payloads: list[bytes]) -> Reply:
    """Totals of words over all chunks, and each word's number: its rank by count within the bucket."""
    words, counts = zip(*((unpack_sorted(a), b) for a, b in map(unpack, payloads)), strict=True)
    distinct, at = np.unique(np.concatenate(words), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)
    rank = np.empty(len(distinct), np.int64)
    rank[np.argsort(-total, kind="stable")] = np.arange(len(distinct))
    out, begin = [], 0
    for w in words:
        own = at[begin : begin + len(w)]
        out.append(pack(total[own].astype(np.uint64), rank[own].astype(np.uint32)))
        begin += len(w)
    few = np.bincount(total[(total > 0) & (total <= LARGEST + 1)], minlength=LARGEST + 2)[1:]
    return Reply(out, [int((total > 0).sum()), *map(int, few)])


def count_pairs(payloads: list[bytes]) -> Reply:
    """Totals of pairs over all chunks, and the counts of counts after each first word. The note has those of the whole bucket."""
    parts = [unpack(p) for p in payloads]
    firsts = [unpack_sorted(p[0]) for p in parts]
    runs = [p[1].astype(np.int64) for p in parts]
    left = np.concatenate([np.repeat(f, r) for f, r in zip(firsts, runs, strict=True)])
    right, word_count, count = (np.concatenate([p[i] for p in parts]).astype(np.uint64 if i == 2 else np.int64) for i in (2, 3, 4))
    key, index, at = np.unique(left << np.uint64(32) | right, return_index=True, return_inverse=True)
    total = np.bincount(at, weights=count, minlength=len(key)).astype(np.int64)
    known = np.unique(np.concatenate(firsts))
    seen = np.flatnonzero(total > 0)
    first, t, w = np.searchsorted(known, left[index[seen]]), total[seen], word_count[index[seen]]
    spread = lambda value: np.bincount(first[value <= LARGEST] * LARGEST + value[value <= LARGEST] - 1, minlength=len(known) * LARGEST).reshape(-1, LARGEST)
    contexts = Contexts(
        np.bincount(first, weights=t, minlength=len(known)).astype(np.int64), spread(t), spread(w),
        np.bincount(first[w > LARGEST], weights=w[w > LARGEST], minlength=len(known)).astype(np.int64),
    )
    few = np.bincount(t[t <= LARGEST + 1], minlength=LARGEST + 2)[1:]
    out, begin = [], 0
    for f, r in zip(firsts, runs, strict=True):
        n = int(r.sum())
        out.append(pack(total[at[begin : begin + n]].astype(np.uint32), *contexts.take(np.searchsorted(known, f)).columns()))
        begin += n
    return Reply(out, list(map(int, few)), pack(known, *contexts.columns()))


class Chunk:
    """A packed chunk: documents, their tokens as numbers into the word list, and what the tables say of both."""

    def __init__(self, packed: bytes, buckets: int):
        self.sizes, self.train, steps, self.counts, stream = unpack(packed)
        self.sizes = self.sizes.astype(np.int64)
        self.words = unpack_sorted(steps)
        self.stream = stream.astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.buckets = buckets

    def words_by_bucket(self) -> Iterator[tuple[int, np.ndarray]]:
        bucket = (mix(self.words) % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            if len(part):
                yield int(bucket[part[0]]), part

    def know(self, answers: list) -> Chunk:
        """Take totals and numbers of the words."""
        self.total = np.zeros(len(self.words), np.int64)
        self.number = np.zeros(len(self.words), np.uint64)
        got = {r["bucket"]: r["payload"] for r in answers or []}
        for bucket, part in self.words_by_bucket():
            total, rank = unpack(got[bucket])
            self.total[part] = total
            self.number[part] = rank.astype(np.uint64) * np.uint64(self.buckets) + np.uint64(bucket)
        if len(self.number) and int(self.number.max()) >> 32:
            raise ValueError("more than 2 ** 32 words")
        # Pairs: the word before each token, an end before the first of a text.
        ends = np.cumsum(self.sizes) - 1
        before = np.empty(len(self.stream), np.int64)
        before[1:] = self.stream[:-1]
        heads = np.append(0, ends[:-1] + 1)[: len(ends)]
        before[heads] = self.stream[ends]
        pair, self.pair_of = np.unique(before * len(self.words) + self.stream, return_inverse=True)
        self.first, self.second = pair // max(len(self.words), 1), pair % max(len(self.words), 1)
        self.pair_count = np.bincount(self.pair_of, weights=self.train[self.doc], minlength=len(pair)).astype(np.uint32)
        return self

    def pairs_by_bucket(self, hot: int, want_hot: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each bucket: its first words and the pairs after them, by number. Hot first words are dealt by the second word."""
        is_hot = self.total > hot
        own = (self.total > 0) & (is_hot == want_hot)
        which = np.flatnonzero(own[self.first] & (self.total[self.second] > 0))
        a, b = self.number[self.first[which]], self.number[self.second[which]]
        dealt = mix(b) % (self.total[self.first[which]] // (hot + 1) + 1).astype(np.uint64)
        n = np.uint64(self.buckets)
        bucket = ((mix(a) + dealt) % n).astype(np.int64)
        order = np.lexsort((b, a, bucket))
        which, bucket = which[order], bucket[order]
        alone = np.flatnonzero(own) if not want_hot else np.zeros(0, np.int64)  # first words, also those with no known word after them
        home = (mix(self.number[alone]) % n).astype(np.int64)
        order = np.lexsort((self.number[alone], home))
        alone, home = alone[order], home[order]
        for k in np.unique(np.concatenate((bucket, home))).tolist():
            pairs = which[slice(*np.searchsorted(bucket, [k, k + 1]))]
            if want_hot:
                heads = np.flatnonzero(np.diff(self.first[pairs], prepend=-1))
                yield k, self.first[pairs[heads]], pairs
            else:
                yield k, alone[slice(*np.searchsorted(home, [k, k + 1]))], pairs

    def ask_pairs(self, hot: int, want_hot: bool) -> Iterator[tuple[int, bytes]]:
        for bucket, firsts, pairs in self.pairs_by_bucket(hot, want_hot):
            numbers = self.number[firsts]
            runs = np.bincount(np.searchsorted(numbers, self.number[self.first[pairs]]), minlength=len(firsts))
            yield bucket, pack(pack_sorted(numbers), runs.astype(np.uint32), self.number[self.second[pairs]].astype(np.uint32), self.total[self.second[pairs]].astype(np.uint64), self.pair_count[pairs])

    def score(self, uni: Unigrams, d: np.ndarray, hot: int, cold_answers: list, hot_answers: list, hot_numbers: np.ndarray, hot_contexts: Contexts | None) -> list[np.ndarray]:
        """Of each document: tokens, known tokens, base and model log10 probability."""
        count = np.zeros(len(self.first), np.int64)
        divisor, weight = np.ones(len(self.words)), np.ones(len(self.words))
        for want_hot, answers in ((False, cold_answers), (True, hot_answers)):
            got = {r["bucket"]: r["payload"] for r in answers or []}
            for bucket, firsts, pairs in self.pairs_by_bucket(hot, want_hot):
                totals, *columns = unpack(got[bucket])
                count[pairs] = totals
                if not want_hot:
                    own = Contexts.of_columns(columns)
                    some = own.total > 0
                    divisor[firsts[some]], weight[firsts[some]] = own.take(some).backoff(uni, d)
        if hot_contexts is not None:
            firsts = np.flatnonzero(self.total > hot)
            divisor[firsts], weight[firsts] = hot_contexts.take(np.searchsorted(hot_numbers, self.number[firsts])).backoff(uni, d)
        lower = uni.chance(self.total[self.second])
        seen = count > 0
        chance = np.where(seen, d[np.minimum(count, LARGEST + 1)] * count / divisor[self.first], weight[self.first] * lower)
        per_doc = lambda value: np.bincount(self.doc, weights=value, minlength=len(self.sizes))
        return [self.sizes, per_doc(self.total[self.stream] > 0).astype(np.int64), per_doc(uni.base(self.total)[self.stream]), per_doc(np.log10(chance)[self.pair_of])]


def _pack_documents(batches: Iterable[pa.RecordBatch], chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows of (chunk, packed documents, ids, held-out marks, training tokens, all tokens)."""
    part, seq, size = TaskContext.get().partitionId(), 0, 0
    held: list[pa.RecordBatch] = []

    def flush() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        data, offsets = text_bytes(table.column("text").combine_chunks())
        data = LOWER[data]
        start, end, doc, inside = find_words(data, offsets)
        ids, distinct = word_ids(word_array(data, inside, start, end))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, distinct.to_pylist()), np.uint64, len(distinct))
        words, number = np.unique(np.append(hashes, np.uint64(END)), return_inverse=True)
        sizes = np.bincount(doc, minlength=table.num_rows)
        stream = np.insert(number[:-1][ids], np.cumsum(sizes), number[-1])
        sizes = sizes + 1
        train = np.array([h is False for h in table.column("held_out").to_pylist()], np.uint8)
        counts = np.bincount(stream, weights=np.repeat(train, sizes), minlength=len(words)).astype(np.uint32)
        packed = pack(sizes.astype(np.uint32), train, pack_sorted(words), counts, stream.astype(np.uint32))
        asked = pack(pack_sorted(words), counts)
        row = {
            "chunk": pa.array([part << 32 | seq], pa.int64()), "docs": pa.array([packed], pa.binary()), "words": pa.array([asked], pa.binary()),
            "ids": pa.array([table.column("doc_id").to_pylist()], pa.list_(pa.int64())), "held": pa.array([table.column("held_out").to_pylist()], pa.list_(pa.bool_())),
            "train_tokens": pa.array([int(counts.sum())], pa.int64()), "tokens": pa.array([len(stream)], pa.int64()),
        }
        return pa.RecordBatch.from_pydict(row)

    for batch in small_batches(batches, 1 << 20):
        held.append(batch)
        size += batch.column(2).nbytes
        if size >= chunk_bytes:
            yield flush()
            held, size, seq = [], 0, seq + 1
    if held:
        yield flush()


def katz_scores(docs: DataFrame, chunk_bytes: int = CHUNK, hot: int = HOT, hot_shares: int = HOT_SHARES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % FOLDS == HELD).alias("held_out"),
        "text",
    )
    packed = "chunk long, docs binary, words binary, ids array<long>, held array<boolean>, train_tokens long, tokens long"
    chunks = write_chunks(rows.mapInArrow(lambda batches: _pack_documents(batches, chunk_bytes), packed), "katz-chunks")
    total, tokens = chunks.agg(F.coalesce(F.sum("train_tokens"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    buckets = max(1, -(-tokens // BUCKET_WORDS))
    least = max(hot, total // hot_shares)

    def ask_words(words: bytes) -> Iterator[tuple[int, bytes]]:
        steps, counts = unpack(words)
        hashes = unpack_sorted(steps)
        bucket = (mix(hashes) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            yield int(bucket[part[0]]), pack(pack_sorted(hashes[part]), counts[part])

    def summed(answers: DataFrame, n: int) -> list[int]:
        return [v or 0 for v in answers.agg(*(F.sum(F.col("stats")[i]) for i in range(n))).first()]

    words = store(answer(ask(chunks, ask_words, "words"), count_words), "katz-words")
    types, *few = summed(words, LARGEST + 2)
    uni = Unigrams(total, types, few)
    known = bring(chunks.select("chunk", "docs"), words, "words")
    asked = [ask(known, lambda docs, words, h=h: Chunk(docs, buckets).know(words).ask_pairs(least, h), "docs", "words") for h in (False, True)]
    cold, warm = (store(answer(a, lambda p, h=h: count_pairs(p) if h else count_pairs(p)._replace(note=None)), "katz-pairs") for a, h in zip(asked, (False, True), strict=True))
    d = discounts([a + b for a, b in zip(summed(cold, LARGEST + 1), summed(warm, LARGEST + 1), strict=True)])

    # What follows hot words: at most 2 * HOT_SHARES rows, of which there is one for each word in the end.
    sums: dict[int, np.ndarray] = {}
    for (note,) in warm.where(F.col("chunk") == NOTE).select("payload").toLocalIterator():
        numbers, *columns = unpack(note)
        for number, row in zip(numbers.tolist(), np.stack([c.astype(np.int64) for c in columns], axis=1), strict=True):
            sums[number] = sums.get(number, 0) + row
    hot_numbers = np.array(sorted(sums), np.uint64)
    hot_contexts = Contexts.of_columns(list(np.stack([sums[k] for k in sorted(sums)]).T)) if sums else None

    whole = bring(bring(bring(chunks.select("chunk", "docs", "ids", "held"), words, "words"), cold, "cold"), warm, "warm")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # One chunk at a time: its payloads become Python bytes only while it is scored.
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                chunk = Chunk(row.pop("docs"), buckets).know(row.pop("words"))
                n, seen, base, score = chunk.score(uni, d, least, row.pop("cold"), row.pop("warm"), hot_numbers, hot_contexts)
                del chunk
                arrays = [pa.array(row["ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(n), pa.array(seen), pa.array(np.full(len(n), total)), pa.array(base), pa.array(score)]
                del row
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
            del batch

    return whole.select("docs", "ids", "held", "words", "cold", "warm").mapInArrow(run, SCORES)

"""Benchmark decontamination by latent semantic retrieval.

Documents are searched in windows of words, for items of a benchmark.

1. One pass counts in how many blocks of the corpus each word of the items
   occurs: the inverse document frequencies.  Words of too many blocks say
   nothing and take no part in the search.
2. A randomised singular value decomposition of the corpus' TF-IDF block matrix
   A, stacked with the items, each row of unit length: every partition returns
   its part of A'A G for one random matrix G; the parts are added up level by
   level, and the Nystroem formula turns the sum into singular vectors.  Items
   weigh as much as all the corpus together, so the latent space has room for
   each of them and, beyond, for the strongest directions of the corpus.
3. Every window is folded into that space and held against all items by cosine.
   Besides, any stretch of an item's rarer words that together with all the words
   left out could hold the share that verification asks for is a candidate, so
   neither cosine nor copies that make an item's words common lose a match
   within twice the item's length and one window.
4. Windows that pass are verified: the longest common subsequence of the item's
   words and the text around the window, weighted by idf, must hold a share of
   the item, so that inserted, dropped and changed words are forgiven, but words
   in another order aren't.  If items have answers, a smaller share will do
   where the answer's words stand nearby as well.

Document frequencies are counted once for all items.  The search itself takes
BATCH pieces of items at a time, of at most LONGEST_ITEM words each, so that what
goes to the executors is a matrix of bounded size: at most BATCH * LONGEST_ITEM
words by BATCH + EXTRA + SPARE dimensions.  As the stretches of step 3 don't
depend on the matrix, nor does what is found within an item's reach.
"""

from __future__ import annotations

import contextlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm import words as W
from ferrule.llm.common import materialise

#: Words in a block; a search window is two blocks.  Items searched for at a time.  Latent dimensions beyond one an item, and further columns of the random matrix.
BLOCK, BATCH, EXTRA, SPARE = 16, 256, 32, 8
#: A word of more than this share of the blocks takes no part in the search, but each item's RAREST do; words that a window must have at least.
COMMON, RAREST, FEWEST = 0.0005, 8, 3
#: Cosine from which a window is verified; share of an item's idf that the common subsequence must hold, and with an answer nearby.
COSINE, SHARE, SHARE_WITH_ANSWER = 0.5, 0.6, 0.4
#: Items longer than this are cut into even pieces of at most so many words, each searched for by itself.
LONGEST_ITEM = 64
SEED = 5

#: ASCII other than letters and digits parts words.
_BREAK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


class Vocabulary:
    """Distinct words, by their hashes in ascending order."""

    def __init__(self, hashes: np.ndarray):
        self.vocabulary = np.unique(hashes)
        bits = 20
        self.mask = np.uint64((1 << bits) - 1)
        self.maybe = np.zeros(1 << bits, bool)
        self.maybe[(self.vocabulary & self.mask).astype(np.int64)] = True

    def number(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the words are the items', and their numbers."""
        at = np.flatnonzero(self.maybe[(hashes & self.mask).astype(np.int64)])
        found = np.minimum(np.searchsorted(self.vocabulary, hashes[at]), len(self.vocabulary) - 1)
        real = self.vocabulary[found] == hashes[at]
        return at[real], found[real]


class Items(Vocabulary):
    """A batch of items: their words' numbers, and what is known of each word."""

    def __init__(self, ids: list, texts: list, answers: list, powers: W.Powers):
        h, _, _, rows = _item_words(texts, powers)
        super().__init__(h)
        word = np.searchsorted(self.vocabulary, h)
        answer_hashes = _item_words(answers, powers)
        full = [i for i in range(len(ids)) if rows[i] < rows[i + 1]]
        self.ids = [ids[i] for i in full]
        self.words = [word[rows[i] : rows[i + 1]] for i in full]
        self.answers = [answer_hashes[0][answer_hashes[3][i] : answer_hashes[3][i + 1]] for i in full]
        #: What the common subsequence must hold, of an item's idf; words in the longest stretch that is searched as one.
        self.share = np.array([SHARE_WITH_ANSWER if len(a) else SHARE for a in self.answers])
        self.span = np.array([2 * len(w) + 2 * BLOCK for w in self.words], np.int64)
        self.basis = self.latent = np.zeros((0, 0), np.float32)

    def rarest(self, known: Vocabulary, counts: np.ndarray) -> tuple[np.ndarray, int]:
        """Which words (numbers in `known`) are among the RAREST of an item, and the fewest distinct words that an item has."""
        at = np.searchsorted(known.vocabulary, self.vocabulary)
        found, fewest = [np.zeros(0, np.int64)], FEWEST
        for word in self.words:
            distinct = np.unique(at[word])
            found.append(distinct[np.argsort(counts[distinct], kind="stable")[:RAREST]])
            fewest = min(fewest, len(distinct))
        return np.unique(np.concatenate(found)), fewest

    def weigh(self, known: Vocabulary, every: np.ndarray, blocks: int, useful: np.ndarray, fewest: int) -> None:
        """Weights from counts in `blocks` blocks of the words of all items, `known`; nothing depends on who else is in the batch."""
        at = np.searchsorted(known.vocabulary, self.vocabulary)
        counts, useful, self.fewest = every[at], useful[at], fewest
        self.idf = np.log((blocks + 1) / (counts + 0.5)).clip(1e-3).astype(np.float32)
        self.weight = np.where(useful, self.idf, 0).astype(np.float32)
        # an item's rarest words, until those left out hold at most half of what verification asks for
        self.need = np.zeros(len(self.words))
        word, item = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, words in enumerate(self.words):
            distinct, times = np.unique(words, return_counts=True)
            by = np.argsort(counts[distinct], kind="stable")
            mass = (self.idf[distinct] * times)[by].astype(np.float64)
            least = self.share[i] * mass.sum()
            left = mass.sum() - np.cumsum(mass)
            n = int(np.argmax(left <= least / 2)) + 1
            self.need[i] = least - left[n - 1] - 1e-5 * mass.sum()
            word.append(distinct[by[:n]])
            item.append(np.full(n, i))
        word, item = np.concatenate(word), np.concatenate(item)
        self.owner = item[np.argsort(word, kind="stable")]
        self.first = np.r_[0, np.cumsum(np.bincount(word, minlength=len(self.vocabulary)))]

    def stretches(self, place: np.ndarray, number: np.ndarray, row: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, begin, end) of stretches that could hold an item's share.

        A common subsequence weighs at most as much as the item's words left out and all places of the others in
        its stretch, so every one that holds enough has its first such place among the begins."""
        times = self.first[number + 1] - self.first[number]
        at = np.repeat(np.arange(len(number)), times)
        item = self.owner[np.repeat(self.first[number] - np.cumsum(times) + times, times) + np.arange(len(at))]
        order = np.argsort(item, kind="stable")
        at, item = at[order], item[order]
        begin = place[at]
        end = np.minimum(begin + self.span[item], rows[row[at] + 1])
        held = np.r_[0.0, np.cumsum(self.idf[number[at]], dtype=np.float64)]
        width = int(rows[-1]) + 1
        last = np.searchsorted(item * width + begin, item * width + end)
        good = held[last] - held[:-1] >= self.need[item]
        return row[at[good]], item[good], begin[good], end[good]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Items as unit rows: row, word, weight."""
        row = np.repeat(np.arange(len(self.words)), [len(w) for w in self.words])
        word = np.concatenate(self.words) if self.words else np.zeros(0, np.int64)
        return _unit(row, word, self.weight, len(self.vocabulary))[:3]


def _unit(row: np.ndarray, word: np.ndarray, weight: np.ndarray, n_words: int):
    """Occurrences as rows of unit length: (row, word, value) by row, and each row's number of words; rows are those that occur."""
    useful = weight[word] > 0
    key, times = np.unique(row[useful] * n_words + word[useful], return_counts=True)
    row, word = key // max(n_words, 1), key % max(n_words, 1)
    value = weight[word] * (1 + np.log(times)).astype(np.float32)
    begins = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    size = np.diff(np.r_[begins, len(row)])
    norm = np.sqrt(np.add.reduceat(value * value, begins)) if len(begins) else np.zeros(0, np.float32)
    return row, word, value / np.repeat(norm, size), begins, size


def _item_words(texts: list, powers: W.Powers):
    return W.words(*W.text_bytes(W.lowered(pa.array(texts, pa.large_string()))), powers, breaks=_BREAK)


def pieces(text: str, powers: W.Powers) -> list[str]:
    """An item's text, cut into even pieces of at most LONGEST_ITEM words; nothing of a text without words."""
    raw, at = W.text_bytes(W.lowered(pa.array([text], pa.large_string())))
    _, start, end, _ = W.words(raw, at, powers, breaks=_BREAK)
    parts = np.array_split(np.arange(len(start)), max(1, -(-len(start) // LONGEST_ITEM)))
    return [raw[start[p[0]] : end[p[-1]]].tobytes().decode("utf-8", "replace") for p in parts if len(p)]


def _occurrences(column: pa.Array, items: Vocabulary, powers: W.Powers):
    """The items' words in some texts: word's place, its number, its block, and the words' layout.  A row's blocks begin with its first word."""
    raw, at = W.text_bytes(W.lowered(column))
    h, start, end, rows = W.words(raw, at, powers, breaks=_BREAK)
    place, number = items.number(h)
    per_row = -(-np.diff(rows) // BLOCK)
    first_block = np.r_[0, np.cumsum(per_row)]
    row = np.searchsorted(rows, place, "right") - 1
    block = first_block[row] + (place - rows[row]) // BLOCK
    return place, number, block, row, (raw, at, h, start, end, rows, first_block)


@contextlib.contextmanager
def shared_value(spark, value):
    """A broadcast variable that is gone from the executors when it is no longer needed."""
    shared = spark.sparkContext.broadcast(value)
    try:
        yield shared
    finally:
        shared.unpersist()


def _slices(batches, column: int):
    for whole in batches:
        for a, b in W.slices(whole.column(column)):
            yield whole.slice(a, b - a)


def _count(texts: DataFrame, shared) -> tuple[np.ndarray, int]:
    """In how many blocks each word of the items occurs, and how many blocks there are."""

    def run(batches):
        items, powers = shared.value, W.Powers()
        counts, blocks = np.zeros(len(items.vocabulary), np.int64), 0
        for part in _slices(batches, 0):
            _, number, block, _, layout = _occurrences(part.column(0), items, powers)
            once = np.unique(block * len(counts) + number)
            counts += np.bincount(once % len(counts), minlength=len(counts))
            blocks += int(layout[-1][-1])
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, some], pa.int32()), pa.array(np.r_[blocks, counts[some]], pa.int64())], names=["w", "n"])

    got = texts.mapInArrow(run, "w int, n bigint").groupBy("w").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(len(shared.value.vocabulary), np.int64)
    blocks = 0
    for r in got:
        if r.w < 0:
            blocks = r.n
        else:
            counts[r.w] = r.n
    return counts, blocks


def _sum_matrices(parts: DataFrame, n: int, shape: tuple[int, int]) -> np.ndarray:
    """The sum of matrices that rows hold as bytes, added up in levels of a square root's width; at most 8 come to the driver."""

    def add(batches):
        total = np.zeros(shape, np.float64)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_buffer(), np.float32).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["m"])

    while n > 8:
        n = max(8, int(n**0.5)) if n > 64 else 8
        parts = parts.repartition(n).mapInArrow(add, "m binary")
    total = np.zeros(shape, np.float64)
    for r in parts.toLocalIterator():
        total += np.frombuffer(r.m, np.float32).reshape(shape)
    return total


def _decompose(texts: DataFrame, shared, items: Items) -> None:
    """Singular vectors of corpus and items together, by one random projection."""
    words = len(items.vocabulary)
    rank = min(words, len(items.words) + EXTRA)
    wide = min(words, rank + SPARE)
    shape = (words, wide)

    def gauss():
        return np.random.Generator(np.random.PCG64(SEED)).standard_normal(shape).astype(np.float32)

    def product(row, word, value, begins, size, g):
        """A'(A g) for unit rows."""
        y = np.add.reduceat(g[word] * value[:, None], begins, axis=0)
        order = np.argsort(word, kind="stable")
        back = np.repeat(y, size, axis=0)[order] * value[order][:, None]
        first = np.flatnonzero(np.r_[True, np.diff(word[order]) != 0])
        out = np.zeros(shape, np.float64)
        out[word[order][first]] = np.add.reduceat(back, first, axis=0)
        return out

    def run(batches):
        mine, powers, g = shared.value, W.Powers(), gauss()
        total = np.zeros(shape, np.float64)
        for part in _slices(batches, 0):
            _, number, block, _, _ = _occurrences(part.column(0), mine, powers)
            row, word, value, begins, size = _unit(block, number, mine.weight, words)
            for a in range(0, len(begins), 20_000):
                b = min(a + 20_000, len(begins))
                s = slice(begins[a], begins[b] if b < len(begins) else len(row))
                if s.start < s.stop:
                    total += product(row[s], word[s], value[s], begins[a:b] - begins[a], size[a:b], g)
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["m"])

    n = texts.rdd.getNumPartitions()
    z = _sum_matrices(texts.mapInArrow(run, "m binary"), n, shape)
    g = gauss().astype(np.float64)
    row, word, value, begins, size = _unit(np.repeat(np.arange(len(items.words)), [len(w) for w in items.words]), np.concatenate(items.words), items.weight, words)
    if len(begins):
        # the trace of the corpus' part, estimated from the same projection: rows have unit length, so it is their number
        rows = max(1.0, float(np.einsum("ij,ij->", g, z)) / wide)
        z = z + rows / len(begins) * product(row, word, value, begins, size, g.astype(np.float32))
    nu = 1e-7 * max(1e-30, float(np.linalg.norm(z)))
    core = g.T @ (z + nu * g)
    spectrum, turn = np.linalg.eigh((core + core.T) / 2)
    good = spectrum > spectrum.max(initial=0) * 1e-10
    left, _, _ = np.linalg.svd((z + nu * g) @ (turn[:, good] / np.sqrt(spectrum[good])), full_matrices=False)
    items.basis = left[:, :rank].astype(np.float32)
    latent = np.zeros((len(items.words), items.basis.shape[1]), np.float32)
    np.add.at(latent, row, items.basis[word] * value[:, None])
    norm = np.linalg.norm(latent, axis=1, keepdims=True)
    items.latent = np.where(norm > 1e-6, latent / np.maximum(norm, 1e-6), 0)


def common_subsequence(item: np.ndarray, text: np.ndarray, weight: np.ndarray) -> tuple[float, int, int]:
    """The greatest weight of a common subsequence, and where in `text` it begins and ends (exclusive; the first such end)."""
    n = len(text)
    best = np.zeros(n + 1)  # of text[:j]
    begin = np.zeros(n + 1, np.int64)  # where that subsequence begins
    spots, places = np.arange(n), np.arange(n + 1)
    for w, v in zip(item, weight, strict=True):
        match = text == w
        if not match.any():
            continue
        took = np.where(match, best[:-1] + v, -1.0)
        where = np.where(best[:-1] > 0, begin[:-1], spots)
        better = took > best[1:]
        new, new_begin = best.copy(), begin.copy()
        new[1:][better], new_begin[1:][better] = took[better], where[better]
        best = np.maximum.accumulate(new)
        begin = new_begin[np.maximum.accumulate(np.where(new >= best, places, 0))]
    end = int(np.searchsorted(best, best[-1]))
    return float(best[-1]), int(begin[end]), end


def _search(docs: DataFrame, shared, id_type: str) -> DataFrame:
    """(id, item_id, cosine, share, begin, end) of every verified pair of document and item."""

    def run(batches):
        items, powers = shared.value, W.Powers()
        words = len(items.vocabulary)
        listed = [list(zip(items.vocabulary[w].tolist(), items.idf[w].tolist(), strict=True)) for w in items.words]
        for part in _slices(batches, 1):
            out = []
            place, number, block, row, (raw, at, h, start, end, rows, first_block) = _occurrences(part.column(1), items, powers)
            # a window is a block and the next one of its document
            again = block > first_block[row]
            window, word, value, begins, size = _unit(np.r_[block, block[again] - 1], np.r_[number, number[again]], items.weight, words)
            enough = np.flatnonzero(size >= items.fewest)
            n_items = len(items.words)
            # windows of stretches that could hold an item's share, as window * n_items + item
            in_row, i, first, last = items.stretches(place, number, row, rows)
            b0 = first_block[in_row] + (first - rows[in_row]) // BLOCK
            n = first_block[in_row] + (last - 1 - rows[in_row]) // BLOCK - b0 + 1
            wins = np.repeat(b0 - np.cumsum(n) + n, n) + np.arange(n.sum())
            bound = np.unique(wins * n_items + np.repeat(i, n))
            known = window[begins]
            hits = [(bound // n_items, bound % n_items, np.zeros(len(bound), np.float32))]
            for a in range(0, len(enough), 4096):
                some = enough[a : a + 4096]
                n = size[some]
                at_ = np.repeat(begins[some] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                latent = np.add.reduceat(items.basis[word[at_]] * value[at_][:, None], np.r_[0, np.cumsum(n)[:-1]], axis=0)
                norm = np.linalg.norm(latent, axis=1)
                cosine = (latent @ items.latent.T) / np.maximum(norm, 1e-6)[:, None]
                near = cosine >= COSINE
                # their cosines too, whatever they are
                lo_, hi_ = np.searchsorted(bound, [known[some[0]] * n_items, (known[some[-1]] + 1) * n_items])
                mine = bound[lo_:hi_]
                w = np.searchsorted(known[some], mine // n_items)
                real = known[some][w] == mine // n_items
                near[w[real], mine[real] % n_items] = True
                w, i = np.nonzero(near)
                hits.append((known[some[w]], i, cosine[w, i]))
            wins, which, cosine = (np.concatenate(x) for x in zip(*hits, strict=True))
            best: dict[tuple[int, object], tuple] = {}
            if len(wins):
                where = np.searchsorted(first_block, wins, "right") - 1
                order = np.lexsort((wins, which, where))
                points = None
                k = 0
                while k < len(order):
                    j, c = order[k], cosine[order[k]]
                    e = k
                    # windows side by side are one stretch
                    while e + 1 < len(order) and where[order[e + 1]] == where[j] and which[order[e + 1]] == which[j] and wins[order[e + 1]] <= wins[order[e]] + 2:
                        e += 1
                        c = max(c, cosine[order[e]])
                    r, i = int(where[j]), int(which[j])
                    item = items.words[i]
                    base = rows[r]
                    lo = max(base, base + (wins[j] - first_block[r]) * BLOCK - len(item))
                    hi = min(rows[r + 1], base + (wins[order[e]] - first_block[r] + 2) * BLOCK + len(item))
                    weight, answer = items.idf[item], items.answers[i]
                    k, least = e + 1, (SHARE_WITH_ANSWER if len(answer) else SHARE) * float(items.idf[item].sum())
                    there = set(h[lo:hi].tolist())
                    if sum(v for w, v in listed[i] if w in there) < least:
                        continue  # not even in any order
                    got, b, f = common_subsequence(items.vocabulary[item], h[lo:hi], weight)
                    share = got / float(weight.sum())
                    if share >= SHARE or (share >= SHARE_WITH_ANSWER and len(answer) and np.isin(answer, h[lo:hi]).all()):
                        key = (r, items.ids[i])
                        if key not in best or share > best[key][1]:
                            best[key] = (float(c), share, lo + b, lo + f - 1)
                if best:
                    points = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
                for (r, ident), (c, share, b, f) in best.items():
                    out.append((part.column(0)[r].as_py(), ident, c, share, int(points[start[b]] - points[at[r]]), int(points[end[f]] - points[at[r]])))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            types = (part.column(0).type, pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["id", "item_id", "cosine", "share", "begin", "end"])

    return docs.mapInArrow(run, f"id {id_type}, item_id bigint, cosine double, share double, begin bigint, end bigint")


def find(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None, scratch: list[str] | None = None) -> DataFrame:
    """(doc_id, item_id, cosine, share, begin, end): which documents hold which items.

    begin and end are the place in the text, in code points, end exclusive; share
    is how much of the item's idf the common subsequence there holds.  The best
    place of each pair of row and item is returned (of an item of more than BATCH pieces, one for each BATCH of them).  Null or empty texts hold
    nothing and null or empty items are held by nothing; case is ignored; null item ids are left
    out; repeated rows are each searched.  Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = [] if scratch is None else scratch
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    answer = F.col(answer_col).cast("string") if answer_col else F.lit("")
    wanted = benchmark.select(F.col(item_col).cast("bigint").alias("i"), F.col(item_text_col).cast("string").alias("t"), F.coalesce(answer, F.lit("")).alias("a")).where("i is not null and t is not null")
    # the items themselves are the stated query set; only batches of them are in memory, and of all of them the distinct words' hashes
    wanted = materialise(wanted, keep=scratch)
    powers = W.Powers()

    def batches():
        batch: list[tuple] = []
        for r in wanted.orderBy("i", "t", "a").toLocalIterator():
            mine = [(r.i, t, r.a) for t in pieces(r.t, powers)]
            if len(batch) + len(mine) > BATCH and batch:  # an item's pieces stay together, unless it fills more than a batch
                yield Items(*map(list, zip(*batch, strict=True)), powers)
                batch = []
            for a in range(0, len(mine), BATCH):
                batch += mine[a : a + BATCH]
                if len(batch) == BATCH:
                    yield Items(*map(list, zip(*batch, strict=True)), powers)
                    batch = []
        if batch:
            yield Items(*map(list, zip(*batch, strict=True)), powers)

    texts = rows.select("text")
    known = Vocabulary(np.zeros(0, np.uint64))
    for items in batches():
        known = Vocabulary(np.concatenate([known.vocabulary, items.vocabulary]))
    found = []
    if len(known.vocabulary):
        with shared_value(spark, known) as shared:
            counts, blocks = _count(texts, shared)
        useful, fewest = counts <= max(COMMON * blocks, 8), FEWEST
        for items in batches():
            some, least = items.rarest(known, counts)
            useful[some] = True
            fewest = min(fewest, least)
        for items in batches():
            if not items.words:
                continue
            items.weigh(known, counts, blocks, useful, fewest)
            with shared_value(spark, items) as shared:
                _decompose(texts, shared, items)
            with shared_value(spark, items) as shared:
                found.append(materialise(_search(rows, shared, id_type), keep=scratch))
    out = found[0] if found else spark.createDataFrame([], f"id {id_type}, item_id bigint, cosine double, share double, begin bigint, end bigint")
    for x in found[1:]:
        out = out.unionByName(x)
    return out.withColumnRenamed("id", id_col)

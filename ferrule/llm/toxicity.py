"""Toxicity: averaged subword-bag embeddings under a linear softmax.

A word is a bag of character n-grams, each with an embedding in a hashed table; a
word's embedding is the mean of its n-grams', a document's the mean of those of
its bag of words.  Embeddings and the softmax layer are trained jointly in numpy,
so that a misspelling nobody has seen shares most of its vectors with the word.

One insult in a long text vanishes in an average over all of it, so a document's
bag are the BAG words that the model puts highest, if they speak against it; training chooses them anew,
round by round, at first by smoothed log-odds of the n-grams' document counts.
Held out on sf0.1, bags of three words beat single ones, and windows of words
side by side.  A logistic fit turns the bag's logit into a probability.

All of this is linear behind the embeddings, so what scoring needs is one number
an n-gram and two for the logistic: a table of fixed size that goes to the
executors, whatever the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm import words as W

#: Rows of the embedding table and its width; lengths of n-grams in bytes, word ends included; words in a document's bag.
BUCKETS, WIDTH, GRAMS, BAG = 1 << 18, 8, (3, 4, 5, 6), 3
#: The classifier is fitted on at most so many labelled documents of each class, one text of each id, none longer than LONGEST
#: characters: 120 million characters at most.
TOXIC_SAMPLE, CLEAN_SAMPLE, LONGEST = 2000, 4000, 20_000
#: N-grams of fewer training documents have no vector; documents that smooth the log-odds.
LEAST, SMOOTH = 4, 5.0
#: Rounds of choosing bags, passes over them in each, step size, and further bags of each clean document.
ROUNDS, PASSES, RATE, OTHERS = 4, 4, 3.0, 4
SEED = 11

#: Bytes that part words: ASCII other than letters, digits and signs that stand for letters (@ $).
_BREAK = np.array([b < 128 and not chr(b).isalnum() and chr(b) not in "@$" for b in range(256)])


def bags(raw: np.ndarray, start: np.ndarray, end: np.ndarray, powers: W.Powers) -> tuple[np.ndarray, np.ndarray]:
    """N-gram buckets of words, end to end, and where each word's begin.  Words stand between < and >."""
    size = end - start + 2
    at = np.r_[0, np.cumsum(size)]
    body = np.zeros(at[-1], np.uint8)
    of = np.repeat(np.arange(len(start)), size)
    offset = np.arange(at[-1]) - at[:-1][of]
    inner = (offset > 0) & (offset < size[of] - 1)
    body[inner] = W._LOWER[raw[(start[of] + offset - 1)[inner]]]
    body[at[:-1]] = ord("<")
    body[at[1:] - 1] = ord(">")
    up, down = powers.get(len(body) + 1)
    total = np.r_[np.uint64(0), np.cumsum(W._BYTE[body] * up[: len(body)], dtype=np.uint64)]
    grams, owners = [], []
    left = size[of] - offset  # bytes from here to the word's end
    for n in GRAMS:
        here = np.flatnonzero(left >= n)
        grams.append((W.mix((total[here + n] - total[here]) * down[here] + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int32))
        owners.append(of[here])
    grams, owners = np.concatenate(grams), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return grams[order], np.searchsorted(owners[order], np.arange(len(start) + 1))


class Vocabulary:
    """The distinct words of some rows, and each row's words as numbers of distinct words.

    Works through the text in slices, so that what it holds is a number a word and
    the n-grams of distinct words."""

    def __init__(self, column: pa.Array, powers: W.Powers):
        hashes, known, text, size, rows = [], [], [], [], [np.zeros(1, np.int64)]
        for a, b in W.slices(column):
            raw, at = W.text_bytes(W.lowered(column.slice(a, b - a)))
            h, start, end, where = W.words(raw, at, powers, breaks=_BREAK)
            new, first = np.unique(h, return_index=True)
            n = (end - start)[first]
            inside = np.repeat(start[first] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else n
            hashes.append(h)
            known.append(new)
            text.append(raw[inside])
            size.append(n)
            rows.append(where[1:] + rows[-1][-1])
        none = np.zeros(0, np.uint64)
        hashes, known = (np.concatenate([none, *x]) for x in (hashes, known))
        self.rows = np.concatenate(rows)
        distinct, first = np.unique(known, return_index=True)
        self.word = np.searchsorted(distinct, hashes).astype(np.int32)
        raw, end = np.concatenate([np.zeros(0, np.uint8), *text]), np.cumsum(np.concatenate([np.zeros(0, np.int64), *size]))
        start = np.r_[0, end][:-1]
        grams, at = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        for a in range(0, len(first), 20_000):
            some = first[a : a + 20_000]
            got, where = bags(raw, start[some], end[some], powers)
            grams.append(got)
            at.append(where[1:] + at[-1][-1])
        self.grams, self.gram_at = np.concatenate(grams), np.concatenate(at)


def word_values(v: Vocabulary, table: np.ndarray) -> np.ndarray:
    """The mean of the table over each distinct word's n-grams."""
    out = np.zeros(len(v.gram_at) - 1)
    for a in range(0, len(out), 20_000):
        at = v.gram_at[a : a + 20_001]
        total = np.r_[0.0, np.cumsum(table[v.grams[at[0] : at[-1]]], dtype=np.float64)]
        out[a : a + 20_000] = (total[at[1:] - at[0]] - total[at[:-1] - at[0]]) / np.diff(at)
    return out


def bag_means(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of each row, the mean of its bag, and the bag's words: the BAG highest, those below 0 being no more than an empty place.

    A bag has BAG places whatever a row's length, so that what few other words a short text has don't matter; a row
    without a word above 0 has the highest word in its bag, and no words give 0."""
    means, bag = np.zeros(len(rows) - 1), []
    for r, (a, b) in enumerate(zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)):
        words = a + np.argpartition(-values[a:b], BAG - 1)[:BAG] if b - a > BAG else np.arange(a, b)
        if len(words):
            above = words[values[words] > 0]
            words = above if len(above) else words[[values[words].argmax()]]
            means[r] = values[words].sum() / BAG
        bag.append(words)
    return means, bag


@dataclass
class Model:
    table: np.ndarray
    slope: float
    shift: float

    def scores(self, column: pa.Array, powers: W.Powers) -> np.ndarray:
        v = Vocabulary(column, powers)
        values = word_values(v, self.table)[v.word] if len(v.word) else np.zeros(0)
        best, _ = bag_means(values, v.rows)
        return 1 / (1 + np.exp(-np.clip(self.slope * best + self.shift, -50, 50)))


def _fit(emb, soft, bias, memory, examples, y, rng):
    """Softmax regression and its embeddings together, by gradient steps that shrink with the gradients' norm so far.

    An example is (n-grams, weights).  One norm a parameter table, not one an entry: else rare n-grams,
    which get few gradients, would take long steps and learn single documents by heart."""
    order = np.arange(len(y))
    for _ in range(PASSES):
        rng.shuffle(order)
        for a in range(0, len(order), 256):
            batch = order[a : a + 256]
            grams = np.concatenate([examples[i][0] for i in batch])
            weight = np.concatenate([examples[i][1] for i in batch]).astype(np.float32)
            size = np.array([len(examples[i][0]) for i in batch])
            owner = np.repeat(np.arange(len(batch)), size)
            rows, inverse = np.unique(grams, return_inverse=True)
            hidden = np.add.reduceat(emb[grams] * weight[:, None], np.r_[0, np.cumsum(size)[:-1]], axis=0)
            logits = hidden @ soft + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(batch)), y[batch]] -= 1
            p /= len(batch)
            back = (p @ soft.T)[owner] * weight[:, None]
            d_emb = np.stack([np.bincount(inverse, back[:, k], len(rows)) for k in range(WIDTH)], 1).astype(np.float32)
            for name, value, where, d in (("emb", emb, rows, d_emb), ("soft", soft, slice(None), hidden.T @ p), ("bias", bias, slice(None), p.sum(0))):
                memory[name] = memory.get(name, 1e-12) + float((d * d).sum())
                value[where] -= RATE * d / np.sqrt(memory[name])


def _example(v: Vocabulary, words: np.ndarray):
    """The n-grams of some words with weights that make the words' means share a bag's BAG places."""
    word, times = np.unique(v.word[words], return_counts=True)
    size = v.gram_at[word + 1] - v.gram_at[word]
    at = np.repeat(v.gram_at[word] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
    return v.grams[at], np.repeat(times / size / BAG, size)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit, by Newton's method with a small ridge; classes weigh the same."""
    scale = max(float(np.abs(x).max()), 1e-9)
    z = np.stack([x / scale, np.ones_like(x)], 1)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        grad = z.T @ (weight * (p - y)) + 1e-4 * beta * [1, 0]
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag([1e-4, 1e-9])
        step = np.linalg.solve(hess, grad)
        beta -= step * min(1, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0] / scale), float(beta[1])


def train(texts: list[str], labels: list[int]) -> Model:
    """A model of the labelled texts.  Without texts of both classes, one that gives every text the share of toxic ones."""
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(np.zeros(BUCKETS, np.float32), 0.0, float(np.log(share / (1 - share))))
    powers, rng = W.Powers(), np.random.Generator(np.random.PCG64(SEED))
    emb = (rng.random((BUCKETS, WIDTH), np.float32) - np.float32(0.5)) / WIDTH
    soft = (rng.random((WIDTH, 2)).astype(np.float32) - np.float32(0.5)) * 2
    bias = np.zeros(2, np.float32)
    v = Vocabulary(pa.array(texts, pa.large_string()), powers)
    full = [i for i in range(len(texts)) if v.rows[i] < v.rows[i + 1]]
    seen = np.zeros((2, BUCKETS))
    for i in full:
        seen[y[i], np.unique(_example(v, np.arange(v.rows[i], v.rows[i + 1]))[0])] += 1
    common = seen.sum(0) >= LEAST
    n = np.bincount(y, minlength=2)
    share = SMOOTH * n / n.sum()
    odds = np.log((seen + share[:, None]) / (n + share)[:, None])
    table = np.where(common, odds[1] - odds[0], 0)
    memory: dict[str, float] = {}
    for _ in range(ROUNDS):
        _, bag = bag_means(word_values(v, table)[v.word], v.rows)
        examples, target = [], []
        for i in full:
            some = [bag[i]]
            if y[i] == 0:  # and bags that aren't its highest
                some += [rng.integers(v.rows[i], v.rows[i + 1], BAG) for _ in range(OTHERS)]
            examples += [_example(v, words) for words in some]
            target += [y[i]] * len(some)
        _fit(emb, soft, bias, memory, examples, np.array(target), rng)
        table = np.where(common, emb @ (soft[:, 1] - soft[:, 0]), 0)
    table = table.astype(np.float32)
    best, _ = bag_means(word_values(v, table)[v.word], v.rows)
    return Model(table, *_logistic(best, y.astype(float)))


def sample(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """At most TOXIC_SAMPLE and CLEAN_SAMPLE labelled documents, in the order of a hash of the id; held-out ids are never among them."""
    marked = labels.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    marked = marked.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).where(F.length("text").between(1, LONGEST))
    # ids first, so that only the chosen texts are sorted and sent
    known = marked.join(texts.select("id").distinct(), "id")
    by = F.xxhash64("id", F.lit(SEED))
    chosen = known.where("y = 1").orderBy(by, "id").limit(TOXIC_SAMPLE).union(known.where("y = 0").orderBy(by, "id").limit(CLEAN_SAMPLE))
    # one text of each id, so that the number of rows is bounded, too
    return texts.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text")).select("id", "text", "y")


def fit(rows: DataFrame) -> Model:
    """A model of the bounded sample (id, text, y), trained in one task; only the model's table comes to the driver."""

    def run(batches):
        held = sorted({r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)})
        model = train([r[1] for r in held], [r[2] for r in held])
        yield pa.RecordBatch.from_arrays([pa.array([model.table.tobytes()], pa.binary()), pa.array([model.slope]), pa.array([model.shift])], names=["table", "slope", "shift"])

    got = rows.repartition(1).mapInArrow(run, "table binary, slope double, shift double").first()
    if got is None:  # no partition, and so no task
        return train([], [])
    return Model(np.frombuffer(got.table, np.float32), got.slope, got.shift)


def held_out(ident):
    """Whether the crc32 of the id as text is 1 modulo 3."""
    return F.crc32(ident.cast("string").cast("binary")) % 3 == 1


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.7, keep: bool = False) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; with `keep`, all columns of `docs` and these but the id.

    score, from 0 to 1, is the chance that label_col is 1; predicted is 1 from
    `threshold` on.  A null, empty or wordless text gets the score of a text
    without any sign of toxicity.  held_out is null for a null id.  Labels other
    than 0 and 1 are ignored; of several for one document, the highest counts.
    Of rows that share an id, the least text of those short enough is learned from.
    Columns of `docs` with the names of results are replaced.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(sample(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col)))
    results = ["held_out", "score", "predicted"]
    base = docs.drop(*results) if keep else docs.select(id_col, text_col)
    names = base.columns
    at = names.index(text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields) + ", score double"

    def run(batches):
        powers = W.Powers()
        for whole in batches:
            for a, b in W.slices(whole.column(at).cast(pa.large_string())):
                part = whole.slice(a, b - a)
                score = model.value.scores(part.column(at), powers)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], names=[*names, "score"])

    out = base.mapInArrow(run, schema)
    out = out.withColumns({"held_out": held_out(F.col(id_col)), "predicted": (F.col("score") >= threshold).cast("int")})
    return out.select(*(names if keep else [id_col]), *results)

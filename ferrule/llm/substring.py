"""Substring dedup by unit hashing: units that occurred before are removed, in runs of enough words.

Units are lines, and pieces of longer lines: whole lines alone miss passages that
begin and end within them, so lines are also cut at places that their words
choose, behind a word pair whose hash is less than those of the NEAR pairs on
either side in its line.  Such places are the same wherever a line or passage
stands.  A line of one word goes with the next one, and a unit of 2 * MOST words
or more is cut every MOST words.  A unit is compared by the 128-bit digest of its
words, case of A-Z and spacing aside.

1. Rows are numbered and written once; ranks are by (id, row number, place).
2. Digests are grouped globally, pre-aggregated before the shuffle, for each
   one's first occurrence in rank.  Units side by side whose first occurrences
   are side by side are one match with that place.
3. Where they aren't, the pair is grouped by its own digest, and matches the
   pair's first occurrence.
4. A passage need not begin with a unit.  The words beside a match are compared
   with those beside the place that it matches, across units, until they differ;
   words that agree extend it.
5. Matches of a document, those of the highest ranking places first, cover its
   words, three side by side at a time; a match counts only where those before
   it don't cover.  What is covered for at least `min_words` words on end goes.
6. But what a match counts for is kept where it stands, in the other place.

So a shorter repetition, such as a common sentence or a licence line, stays
where it is, and whatever is removed is left in another place: every three words
side by side within a removed stretch stand side by side in some output.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.llm import words as W
from ferrule.llm.common import drop, materialise, split_join

_RNG = np.random.Generator(np.random.PCG64(77))
_P1, _P2 = (int(x) | 3 for x in _RNG.integers(1, 2**62, 2))
_PAIR = np.uint64(int(_RNG.integers(1, 2**62)) | 1)
#: Word pairs on either side that a cut's hash is less than.
NEAR = 3
#: Words in the pieces of an overlong unit, so that every unit has less than twice as many.
MOST = 16
#: Words that are compared beside a run: more than any unit has.  Where more of them agree, whole units do, and are in a run themselves.
SIDE = 2 * MOST
#: Agreeing words beside a run that may lie beyond its neighbouring unit without that unit being the same: those that decide on a cut.
SLACK = NEAR + 2
#: Words between two runs of one source that are taken together, as where lines are wrapped anew.
GAP = 64
#: In place of an id that is null or no whole number: such rows rank last.
LAST = (1 << 63) - 1


class Units:
    """The units of some rows: unit j has words first[j] to last[j] - 1 and row row[j]."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, powers: W.Powers):
        self.hash, self.start, self.end, rows = W.words(raw, at, powers)
        n = len(self.start)
        new = np.zeros(n, bool)
        if n:
            new[0] = True
            row_of_word = np.repeat(np.arange(len(at) - 1), np.diff(rows))
            lines = np.r_[0, np.cumsum(raw == 10)]
            other = row_of_word[1:] != row_of_word[:-1]
            new[1:] = other | (lines[self.start[1:]] != lines[self.end[:-1]])
            # a line of one word goes with the next line of its text
            alone = new[:-1] & new[1:] & ~other
            new[1:] &= ~alone
            segment = np.cumsum(new)
            cut = self._cuts(segment)
            # none before a line's last word, so that no unit within a text is a single word
            cut[:-2] &= segment[2:] == segment[:-2]
            cut[-2:] = False
            new[1:] |= cut[:-1]
            first = np.flatnonzero(new)
            pieces = np.diff(np.r_[first, n]) // MOST
            long = np.flatnonzero(pieces > 1)
            for j in long:
                new[first[j] + MOST * np.arange(1, pieces[j])] = True
        self.first = np.flatnonzero(new)
        self.last = np.r_[self.first[1:], n].astype(np.int64) if n else self.first
        self.row = row_of_word[self.first] if n else self.first
        self.words_at = rows
        self.count = self.last - self.first

    def _cuts(self, segment: np.ndarray) -> np.ndarray:
        """Whether there is a cut behind each word."""
        most = np.uint64(2**64 - 1)
        pair = np.full(len(segment), most)
        pair[1:] = np.where(segment[1:] == segment[:-1], W.mix(self.hash[:-1] * _PAIR + self.hash[1:]), most)
        least = np.full(len(segment), most)
        for k in range(1, NEAR + 1):
            same = segment[k:] == segment[:-k]
            least[k:] = np.minimum(least[k:], np.where(same, pair[:-k], most))
            least[:-k] = np.minimum(least[:-k], np.where(same, pair[k:], most))
        return pair < least

    def digests(self) -> list[np.ndarray]:
        """Two hashes of each unit's words in order."""
        out = []
        n = len(self.hash)
        for p in (_P1, _P2):
            up = np.cumprod(np.r_[np.uint64(1), np.full(n, p, np.uint64)], dtype=np.uint64)
            down = np.cumprod(np.r_[np.uint64(1), np.full(n, pow(p, -1, 1 << 64), np.uint64)], dtype=np.uint64)
            total = np.r_[np.uint64(0), np.cumsum(W.mix(self.hash + np.uint64(p)) * up[:n], dtype=np.uint64)]
            out.append(W.mix((total[self.last] - total[self.first]) * down[self.first] + self.count.astype(np.uint64)).view(np.int64))
        return out


def _slices(batches, column: int):
    for whole in batches:
        for a, b in W.slices(whole.column(column)):
            yield whole.slice(a, b - a)


#: A unit's first word, and the words in it and in the units beside it, in one number: FIELD bits for each of the latter.
FIELD = 6


def _units(docs: DataFrame) -> DataFrame:
    """(row, id, at, h1, h2) of every unit: its place and size, see FIELD, and its digest."""

    def run(batches):
        powers = W.Powers()
        for part in _slices(batches, 2):
            units = Units(*W.text_bytes(part.column(2)), powers)
            rows, ids = (part.column(i).to_numpy(zero_copy_only=False)[units.row] for i in (0, 1))
            same = units.row[1:] == units.row[:-1]
            beside = np.zeros((2, len(rows)), np.int64)
            beside[0, 1:][same] = units.count[:-1][same]
            beside[1, :-1][same] = units.count[1:][same]
            at = (((units.first - units.words_at[units.row] << FIELD | units.count) << FIELD) | beside[0]) << FIELD | beside[1]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (rows, ids, at, *units.digests())], names=["row", "id", "at", "h1", "h2"])

    return docs.mapInArrow(run, "row bigint, id bigint, at bigint, h1 bigint, h2 bigint")


#: An occurrence of a unit that stands in several places: its first occurrence is (fid, frow), from word fs on; d is its digest.
_OCCURRENCE = ["at", "fid", "frow", "fs", "d"]


class Occurrences:
    """A document's units that stand in several places, and which of them are in runs that may become long enough.

    Runs are of units side by side of which none is the first occurrence."""

    def __init__(self, row: int, us, min_words: int):
        at, self.fid, self.frow, self.fs, self.d = (x.to_numpy(zero_copy_only=False) for x in us.values.flatten())
        low = (1 << FIELD) - 1
        lw, rw, self.w, self.s = at >> FIELD & low, at & low, at >> 2 * FIELD & low, at >> 3 * FIELD
        s = self.s
        self.e = s + self.w
        self.next = s[1:] == self.e[:-1]  # whether the one behind is the document's next unit
        self.same = self.next & (self.frow[1:] == self.frow[:-1]) & (self.fs[1:] == self.fs[:-1] + self.w[:-1])
        at = np.flatnonzero((self.frow != row) | (self.fs != s))
        self.inside = np.zeros(len(s), bool)
        if not len(at):
            return
        begins = np.flatnonzero(np.r_[True, s[at[1:]] != self.e[at[:-1]]])
        first, last = at[begins], at[np.r_[begins[1:], len(at)] - 1]
        size, lw, rw = self.e[last] - s[first], lw[first], rw[last]
        ok = size + np.where(lw > 0, lw + SLACK, 0) + np.where(rw > 0, rw + SLACK, 0) >= min_words
        # runs that go on at the same source, a few words on
        far = self.fs[first[1:]] - (self.fs[last[:-1]] + self.w[last[:-1]])
        near = (s[first[1:]] - self.e[last[:-1]] <= GAP) & (self.frow[first[1:]] == self.frow[last[:-1]]) & (far > 0) & (far <= GAP)
        chain = np.cumsum(np.r_[False, ~near])
        ok |= (np.bincount(chain) > 1)[chain] & (2 * np.bincount(chain, size)[chain] >= min_words)
        turns = np.zeros(len(s) + 1, np.int64)
        turns[first[ok]] += 1
        turns[last[ok] + 1] -= 1
        self.inside = np.cumsum(turns)[:-1] > 0


def _table(names: dict[str, pa.DataType], out: list[tuple]) -> pa.RecordBatch:
    cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0)] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c.astype(t.to_pandas_dtype()), t) for c, t in zip(cols, names.values(), strict=True)], names=list(names))


def _schema(names: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{n} {'int' if t == pa.int32() else 'boolean' if t == pa.bool_() else 'bigint'}" for n, t in names.items())


_JOIN = {"p": pa.int64(), "id": pa.int64(), "row": pa.int64(), "s": pa.int32(), "e": pa.int32(), "wanted": pa.bool_()}
#: Words s to e - 1 of a document stand in row srow as well, from word ss on; that row's rank is sid.
_MATCH = {"row": pa.int64(), "s": pa.int32(), "e": pa.int32(), "sid": pa.int64(), "srow": pa.int64(), "ss": pa.int32()}


def _joins(grouped: DataFrame, min_words: int) -> DataFrame:
    """Two units side by side whose first occurrences aren't: the pair's digest p, its words, and whether a run that may be long enough has it."""

    def run(batches):
        for batch in batches:
            out = []
            for row, ident, us in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                x = Occurrences(row, us, min_words)
                at = np.flatnonzero(x.next & ~x.same)
                d = x.d.view(np.uint64)
                p = W.mix(d[at] * _PAIR + d[at + 1]).view(np.int64)
                out.append((p, np.full(len(at), ident), np.full(len(at), row), x.s[at], x.e[at + 1], x.inside[at] & x.inside[at + 1]))
            yield _table(_JOIN, out)

    return grouped.mapInArrow(run, _schema(_JOIN))


def _matches(grouped: DataFrame, min_words: int) -> DataFrame:
    """Of runs that may be long enough, the stretches whose first occurrences stand side by side."""

    def run(batches):
        for batch in batches:
            out = []
            for row, us in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                x = Occurrences(row, us, min_words)
                at = np.flatnonzero(x.inside)
                if not len(at):
                    continue
                begins = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | ~x.same[at[1:] - 1]])
                a, b = at[begins], at[np.r_[begins[1:], len(at)] - 1]
                out.append((np.full(len(a), row), x.s[a], x.e[b], x.fid[a], x.frow[a], x.fs[a]))
            yield _table(_MATCH, out)

    return grouped.mapInArrow(run, _schema(_MATCH))


def _beside(requests: DataFrame) -> DataFrame:
    """Of rows with requests (array of (at, side)): 32 bits of each word's hash, nearest first, before word `at` (side -1) or from it on (1)."""

    def run(batches):
        powers = W.Powers()
        for part in _slices(batches, 1):
            hashes, _, _, rows = W.words(*W.text_bytes(part.column(1)), powers)
            short = (hashes >> np.uint64(32)).astype(np.uint32).view(np.int32)
            out: list[tuple] = []
            for r, (row, asked) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True)):
                lo, hi = rows[r], rows[r + 1]
                for x in asked:
                    at = lo + x["at"]
                    out.append((row, x["at"], x["side"], short[max(lo, at - SIDE) : at][::-1] if x["side"] < 0 else short[at : min(hi, at + SIDE)]))
            row, place, side, got = (list(x) for x in zip(*out, strict=True)) if out else ([], [], [], [])
            offsets = np.r_[0, np.cumsum([len(x) for x in got])].astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.int32), *got])
            near = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(place, pa.int32()), pa.array(side, pa.int32()), near], names=["row", "at", "side", "near"])

    return requests.mapInArrow(run, "row bigint, at int, side int, near array<int>")


def cover(matches: list[tuple], min_words: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
    """Stretches of words that go, and the stretches (row, begin, end) that are left in their stead.

    A match is (rank, srow, ss, s, e): words s to e - 1 stand in row srow as well, from its word ss on."""
    lo, hi = min(m[3] for m in matches), max(m[4] for m in matches)
    covered = np.zeros(hi - lo + 2, bool)  # whether three words from here on are
    used = []
    for _, srow, ss, s, e in sorted(matches):
        part = covered[s - lo : e - lo - 2]
        turns = np.flatnonzero(np.diff(np.r_[False, ~part, False]))
        used += [(s + x, s + y + 2, srow, ss + x) for x, y in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True)]
        part[:] = True
    turns = np.flatnonzero(np.diff(np.r_[False, covered, False])) + lo
    spans, left, end = [], [], -1
    for s, e in zip(turns[::2].tolist(), (turns[1::2] + 2).tolist(), strict=True):
        # a word is left between stretches that hardly overlap: what spans both is nowhere else
        s = s if s > end else end + 1
        if e - s >= min_words:
            spans.append((s, e))
            left += [(srow, ss, ss + y - x) for x, y, srow, ss in used if s < y and x < e]
            end = e
    return spans, left


def _covers(grouped: DataFrame, min_words: int) -> DataFrame:
    """(row, spans, left) of rows with matches; see cover()."""

    def run(batches):
        for batch in batches:
            out = []
            for row, ms in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                longer: dict[tuple, list[int]] = {}
                for *match, side, n in zip(*(x.to_pylist() for x in ms.values.flatten()), strict=True):
                    longer.setdefault(tuple(match), [0, 0])[side > 0] = n
                spans, left = cover([((i, r, u), r, u - a, s - a, e + b) for (i, r, u, s, e), (a, b) in longer.items()], min_words)
                if spans:
                    out.append((row, [{"s": s, "e": e} for s, e in spans], [{"row": r, "s": s, "e": e} for r, s, e in left]))
            cols = list(zip(*out, strict=True)) or [[]] * 3
            span = pa.struct([("s", pa.int32()), ("e", pa.int32())])
            place = pa.struct([("row", pa.int64()), ("s", pa.int32()), ("e", pa.int32())])
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.list_(span)), pa.array(cols[2], pa.list_(place))], names=["row", "spans", "left"])

    return grouped.mapInArrow(run, "row bigint, spans array<struct<s int, e int>>, left array<struct<row bigint, s int, e int>>")


def edges(start: np.ndarray, spans: list[dict], left: list[dict]) -> list[tuple[int, int | None]]:
    """Begin and end, in bytes, of what goes from a text whose words begin at `start`: stretches of words, but for those that are left.

    A stretch ends where the next kept word begins, so that the white space before it stays; None: where the text ends."""
    gone = np.zeros(len(start), bool)
    for x in spans:
        gone[x["s"] : x["e"]] = True
    for x in left:
        gone[x["s"] : x["e"]] = False
    turns = np.flatnonzero(np.diff(np.r_[False, gone, False])).tolist()
    return [(int(start[s]), int(start[e]) if e < len(start) else None) for s, e in zip(turns[::2], turns[1::2], strict=True)]


def remove(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, row_col: str | None = None, scratch: list[str] | None = None) -> DataFrame:
    """`docs` with text_col cut, and `removed`: array<struct<start bigint, end bigint>>, the spans
    that were cut, in code points of the original text (end exclusive).

    A stretch goes from its first word to the first word behind it, or to the end
    of the text.  One row comes back for each row.  A null text stays null, an
    empty one empty, and a table without rows empty.  Rows rank by id, rows of
    one id in the order of the table; rows whose id is null, or no whole number,
    rank behind all others.  A row that repeats another is held against it like
    any other, so its text goes if it is long enough.  All other columns are kept;
    an input column named `removed` is replaced.  min_words is 3 at least.
    `row_col` may name a column of `docs` that numbers rows in their order, in a table that gives the same
    numbers whenever it is read; it doesn't come back, and the table isn't written anew.
    """
    spark = docs.sparkSession
    scratch = [] if scratch is None else scratch
    row = "__row"
    numbered = docs.drop("removed")
    numbered = numbered.withColumnRenamed(row_col, row) if row_col else materialise(numbered.withColumn(row, F.monotonically_increasing_id()), keep=scratch)
    ident = F.coalesce(F.col(id_col).try_cast("bigint"), F.lit(LAST)).alias("id")
    narrow = numbered.select(F.col(row).alias("row"), ident, F.col(text_col).cast("string").alias("text"))
    work: list[str] = []
    units = _units(narrow)
    firsts = units.groupBy("h1", "h2").agg(F.min(F.struct("id", "row", "at")).alias("f"), F.count("*").alias("n")).where("n > 1")
    # written, so that the join below has an exchange of its own on either side, and a frequent unit's can be split
    firsts = materialise(firsts.selectExpr("h1", "h2", "f.id as fid", "f.row as frow", f"shiftright(f.at, {3 * FIELD}) as fs"), keep=work)
    again = units.select("row", "at", "h1", "h2").join(firsts, ["h1", "h2"]).withColumn("d", F.xxhash64("h1", "h2"))
    grouped = again.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(*_OCCURRENCE))).alias("us"))
    grouped = materialise(grouped.join(narrow.select("row", "id"), "row").select("row", "id", "us"), keep=work)

    joins = materialise(_joins(grouped, min_words), keep=work)
    pairs = joins.groupBy("p").agg(F.min(F.struct("id", "row", "s")).alias("f"), F.max("wanted").alias("wanted"), F.count("*").alias("n")).where("wanted and n > 1").select("p", "f", "n")
    of_pairs = split_join(joins.where("wanted"), pairs, ["p"], "n").where("row <> f.row or s <> f.s").selectExpr("row", "s", "e", "f.id as sid", "f.row as srow", "f.s as ss")
    matches = materialise(_matches(grouped, min_words).unionByName(of_pairs), keep=scratch)
    drop(spark, work)

    # either side of a match: the word before which, or from which on, the words beside it stand, here and there
    side = F.explode(F.array(*[F.struct(F.lit(x).alias("side"), F.expr(here).alias("at"), F.expr(there).alias("sat")) for x, here, there in ((-1, "s", "ss"), (1, "e", "ss + e - s"))]))
    sides = matches.select("*", side.alias("x")).select(*matches.columns, "x.*")
    asked = sides.select("row", "at", "side").union(sides.select("srow", "sat", "side")).distinct().groupBy("row").agg(F.collect_list(F.struct("at", "side")).alias("asked"))
    near = materialise(_beside(narrow.select("row", "text").join(asked, "row").select("row", "text", "asked")), keep=work)
    theirs = near.select(F.col("row").alias("srow"), F.col("at").alias("sat"), "side", F.col("near").alias("theirs"))
    differ = F.array_position(F.zip_with("near", "theirs", lambda x, y: F.coalesce(x == y, F.lit(False))), F.lit(False))
    agreed = sides.join(theirs, ["srow", "sat", "side"]).join(near, ["row", "at", "side"])
    agreed = agreed.withColumn("n", F.when(differ > 0, differ - 1).otherwise(F.size("near")).cast("int"))
    covers = materialise(_covers(agreed.groupBy("row").agg(F.collect_list(F.struct("sid", "srow", "ss", "s", "e", "side", "n")).alias("ms")), min_words), keep=scratch)
    drop(spark, work)
    left = covers.select(F.explode("left").alias("x")).select("x.*").groupBy("row", "s").agg(F.max("e").alias("e"))
    left = left.groupBy("row").agg(F.collect_list(F.struct("s", "e")).alias("left"))
    per_row = covers.select("row", "spans").join(left, "row", "left").select(F.col("row").alias(row), F.struct("spans", "left").alias("__cut"))

    names = [c for c in numbered.columns if c != row]
    whole = numbered.join(per_row, row, "left").select(*names, "__cut")
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in numbered.schema.fields if f.name != row), T.StructField("removed", T.ArrayType(span))])
    at_text = names.index(text_col)

    def run(batches):
        powers = W.Powers()
        for batch in batches:
            cuts = batch.column(len(names))
            texts = batch.column(at_text).to_pylist()
            removed: list = [[] for _ in texts]
            for r in np.flatnonzero(cuts.is_valid().to_numpy(zero_copy_only=False)).tolist():
                raw, at = W.text_bytes(pa.array([texts[r]], pa.large_string()))
                cut = cuts[r].as_py()
                found = edges(W.words(raw, at, powers)[1], cut["spans"], cut["left"] or [])
                if found:
                    texts[r], removed[r] = _without(raw, found)
            cols = [batch.column(i) for i in range(len(names))]
            cols[at_text] = pa.array(texts, cols[at_text].type)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*cols, pa.array(removed, kind)], names=[*names, "removed"])

    return whole.mapInArrow(run, schema)


def _without(raw: np.ndarray, stretches: list[tuple[int, int | None]]) -> tuple[str, list[dict]]:
    """The text without stretches of its bytes, and the stretches in code points."""
    points = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
    keep, at, spans = [], 0, []
    for s, e in stretches:
        e = len(raw) if e is None else e
        keep.append(raw[at:s].tobytes())
        spans.append({"start": int(points[s]), "end": int(points[e])})
        at = e
    keep.append(raw[at:].tobytes())
    return b"".join(keep).decode("utf-8", "surrogatepass"), spans

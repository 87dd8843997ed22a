"""Periodic runs of words, found on a run-length grammar, and texts with them collapsed.

A run is a longest stretch of words in which words ``period`` apart are equal, for its
smallest period, of at least ``min_words`` words and ``min_exponent`` periods.

Recompression. The words of a group of documents, with a separator of its own after
each document, form the lowest string. Block compression replaces each block of equal
symbols by one symbol for (symbol, length); pair compression deals symbols into left and
right ones and replaces each left one with the right one after it. The two alternate,
so equal stretches are replaced alike but for a few symbols at their ends, and the
string shrinks by a constant factor. Symbols get numbers in the order of their names, so
two symbols of one string are equal just if their texts are. Separators are never joined.

Common extensions (LCE). Two places climb together: where their symbols agree, they step
over what is needed to stand at borders of the string above (the rest of a block, or one
right symbol); where they differ they go down again, one step a string at most. No
suffix array is made, and strings are built only as high as some question climbs.

Candidates. A run of period q has at least (min_exponent - 1) * q neighbouring places
whose word comes again q further on. So for each q only places on a grid of that width
are looked at; where the words agree, the exact extensions to both sides give the run.
Stretches found under several periods keep the smallest.

Nulls, empty texts and texts without words have no run and collapse to the empty text.
Repeated rows are each told; very long texts are taken whole (their strings take some
fifty bytes a word); an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shipping import ship
from .text import mixed

#: Words of documents that are compressed together; a longer document stands alone.
GROUP_WORDS = 1 << 18
BLOCK_STEP, PAIR_STEP = 0, 1


class _Level:
    """A string of the grammar and how it becomes the one above."""

    def __init__(self, symbols: np.ndarray, kind: int):
        self.symbols, self.kind = symbols, kind
        #: Of each symbol the place above that holds it; of each place above its first symbol here, and the end.
        self.parent = self.first = self.right = None


class Grammar:
    """Run-length grammar over a string whose first ``separators`` symbols occur once each and stay single."""

    def __init__(self, symbols: np.ndarray, separators: int):
        self._separators, self._next = separators, int(symbols.max(initial=0)) + 1
        self._levels = [_Level(symbols.astype(np.int32), BLOCK_STEP)]

    def level(self, k: int) -> _Level:
        """String k; those above the words are made on demand."""
        while len(self._levels) <= k:
            top = self._levels[-1]
            self._link(top, len(self._levels) - 1)
            above = self._blocks(top) if top.kind == BLOCK_STEP else self._pairs(top)
            self._levels.append(_Level(above, PAIR_STEP if top.kind == BLOCK_STEP else BLOCK_STEP))
        if self._levels[k].parent is None:
            self._link(self._levels[k], k)
        return self._levels[k]

    def _link(self, at: _Level, k: int) -> None:
        if at.parent is not None:
            return
        s = at.symbols
        starts = np.ones(len(s), bool)
        if at.kind == BLOCK_STEP:
            np.not_equal(s[1:], s[:-1], out=starts[1:])
        else:
            coin = mixed(s.astype(np.uint64) | np.uint64(k << 32)) >> np.uint64(63)
            at.right = coin.astype(bool)
            free = s >= self._separators
            starts[1:] = ~(at.right[1:] & free[1:] & ~at.right[:-1] & free[:-1])
        at.parent = (np.cumsum(starts) - 1).astype(np.int32)
        at.first = np.append(np.flatnonzero(starts), len(s)).astype(np.int32)

    def _named(self, above: np.ndarray, joined: np.ndarray, names: np.ndarray) -> np.ndarray:
        """Give the places ``joined`` a new symbol for each name."""
        found, number = np.unique(names, return_inverse=True)
        above[joined] = self._next + number
        self._next += len(found)
        return above

    def _blocks(self, at: _Level) -> np.ndarray:
        above, count = at.symbols[at.first[:-1]], np.diff(at.first)
        joined = np.flatnonzero(count > 1)
        return self._named(above, joined, (above[joined].astype(np.int64) << 32) | count[joined])

    def _pairs(self, at: _Level) -> np.ndarray:
        first = at.first[:-1]
        above = at.symbols[first]
        joined = np.flatnonzero(np.diff(at.first) > 1)
        return self._named(above, joined, (above[joined].astype(np.int64) << 32) | at.symbols[first[joined] + 1])

    def _over(self, at: _Level, x: np.ndarray, forward: np.ndarray) -> np.ndarray:
        """Symbols from x to the end of its block, x included, in its direction."""
        block = at.parent[x]
        return np.where(forward, at.first[block + 1] - x, x - at.first[block] + 1)

    def extensions(self, x: np.ndarray, y: np.ndarray, way: np.ndarray) -> np.ndarray:
        """Words that agree from places x and y on, forwards (way 1) or backwards (-1).

        x and y differ and lie in one document, so a separator ends each question.
        """
        x, y, begin = x.copy(), y.copy(), x.copy()
        forward = way > 0
        active, stopped, k = np.arange(len(x)), [], 0
        while len(active):
            at = self.level(k)
            same = at.symbols[x[active]] == at.symbols[y[active]]
            ended, active = active[~same], active[same]
            a, b, ahead = x[active], y[active], forward[active]
            if at.kind == BLOCK_STEP:
                left, right = self._over(at, a, ahead), self._over(at, b, ahead)
                step, uneven = np.minimum(left, right), left != right
            else:
                step, uneven = (at.right[a] == ahead).astype(np.int32), np.zeros(len(active), bool)
            step = step * way[active]
            x[active], y[active] = a + step, b + step
            stopped.append(np.concatenate([ended, active[uneven]]))
            active = active[~uneven]
            x[active], y[active] = at.parent[x[active]], at.parent[y[active]]
            k += 1
        down = np.empty(0, np.int64)
        for k in range(len(stopped) - 1, 0, -1):
            down = np.concatenate([down, stopped[k]])
            at, ahead = self.level(k - 1), forward[down]
            a = np.where(ahead, at.first[x[down]], at.first[x[down] + 1] - 1)
            b = np.where(ahead, at.first[y[down]], at.first[y[down] + 1] - 1)
            step = (at.symbols[a] == at.symbols[b]).astype(np.int32)
            if at.kind == BLOCK_STEP:
                step = step * np.minimum(self._over(at, a, ahead), self._over(at, b, ahead))
            x[down], y[down] = a + step * way[down], b + step * way[down]
        return (x - begin) * way


def _candidates(symbols: np.ndarray, owner: np.ndarray, longest: int, min_exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """Grid places and periods where the word comes again a period further on, in one document."""
    places, periods = [], []
    for q in range(1, longest // min_exponent + 1):
        width = (min_exponent - 1) * q
        hit = np.flatnonzero(symbols[: len(symbols) - q : width] == symbols[q::width]) * width
        hit = hit[owner[hit] == owner[hit + q]]
        if len(hit):
            places.append(hit)
            periods.append(np.full(len(hit), q))
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(places), np.concatenate(periods)


def find_runs(texts: list[list], min_words: int = 6, min_exponent: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All runs of lists of words: list number, start, length, period, in that order."""
    if min_exponent < 2:
        raise ValueError("a run has at least two periods")
    sizes = np.array([len(t) for t in texts], np.int64)
    separators, names = len(texts) + 1, {}
    symbols = np.empty(int(sizes.sum()) + separators, np.int64)
    owner = np.repeat(np.arange(-1, len(texts)), np.concatenate([[0], sizes]) + 1)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]) + 1 if len(texts) else sizes
    symbols[0] = 0
    for i, (text, begin) in enumerate(zip(texts, begins.tolist())):
        symbols[begin : begin + len(text)] = [names.setdefault(w, len(names)) for w in text]
        symbols[begin : begin + len(text)] += separators
        symbols[begin + len(text)] = i + 1
    place, period = _candidates(symbols, owner, int(sizes.max(initial=0)), min_exponent)
    grammar, ways = Grammar(symbols, separators), np.repeat(np.array([1, -1]), len(place))
    before, after = np.concatenate([place, place - 1]), np.concatenate([place + period, place + period - 1])
    reach = grammar.extensions(before, after, ways)
    ahead, back = reach[: len(place)], reach[len(place) :]
    length = ahead + back + period
    long = length >= np.maximum(min_words, min_exponent * period)
    doc, start, length, period = owner[place][long], (place - back)[long], length[long], period[long]
    order = np.lexsort((period, length, start))
    doc, start, length, period = (v[order] for v in (doc, start, length, period))
    # One stretch under several periods: the smallest comes first.
    keep = np.ones(len(doc), bool)
    keep[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    doc, start, length, period = (v[keep] for v in (doc, start - begins[doc] if len(doc) else start, length, period))
    order = np.lexsort((length, period, start, doc))
    return doc[order], start[order], length[order], period[order]


def collapsed(text: list, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> list:
    """The words that no run holds beyond its first period."""
    kept = np.ones(len(text), bool)
    for s, n, q in zip(start.tolist(), length.tolist(), period.tolist()):
        kept[s + q : s + n] = False
    return [text[i] for i in np.flatnonzero(kept).tolist()]


RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def collapse_runs(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", min_words: int = 6, min_exponent: int = 4) -> DataFrame:
    """``keep`` columns, n_words, runs (by start, then period) and the collapsed text of each row.

    The collapsed text keeps of every run only its first period, and has one space
    between words. Other columns of ``docs`` are not read.
    """
    ship(docs.sparkSession)
    kinds = ", ".join(f"_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))

    def told(group: list[list[bytes]]) -> list[pa.Array]:
        doc, start, length, period = find_runs(group, min_words, min_exponent)
        ends = np.searchsorted(doc, np.arange(len(group) + 1))
        out = []
        for found, a, b in zip(group, ends, ends[1:]):
            out.append(b" ".join(found if a == b else collapsed(found, start[a:b], length[a:b], period[a:b])))
        runs = pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in (start, length, period)], ["start", "length", "period"])
        return [
            pa.array([len(t) for t in group], pa.int64()),
            pa.ListArray.from_arrays(pa.array(ends, pa.int32()), runs),
            pa.array(out, pa.binary()),
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            group, begin, weight = [], 0, 0
            for i, body in enumerate(b.column(b.num_columns - 1)):
                found = (body.as_py() or b"").split()
                if group and weight + len(found) > GROUP_WORDS:
                    yield pa.record_batch([*b.slice(begin, len(group)).columns[:-1], *told(group)], names)
                    group, begin, weight = [], i, 0
                group.append(found)
                weight += len(found)
            if group:
                yield pa.record_batch([*b.slice(begin, len(group)).columns[:-1], *told(group)], names)

    names = [*[f"_{i}" for i in range(len(keep))], "n_words", "runs", "collapsed"]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").cast("binary").alias("_text"))
    found = rows.mapInArrow(run, ", ".join(x for x in (kinds, f"n_words bigint, runs {RUNS}, collapsed binary") if x))
    return found.select(
        *[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed")
    )


def strongest(runs: str = "runs") -> Column:
    """The run with the greatest exact length / period; ties: smallest start, then period; null without runs."""
    none = "cast(null as struct<start: bigint, length: bigint, period: bigint>)"
    return F.expr(f"aggregate({runs}, {none}, (b, r) -> if(b is null or r.length * b.period > b.length * r.period, r, b))")


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text, where one document in ten repeats itself from a place of its own to its end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"))
    rows = rows.withColumn("w", F.when(F.col("h") % 10 == 0, F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')")))
    rows = rows.withColumns({"n": F.size("w"), "a": F.expr("if(size(w) > 0, cast(g % size(w) as int), 0)")})
    rows = rows.withColumn("p", F.expr("cast(1 + floor((n - a) / (3 + g % 8)) as int)"))
    repeated = "concat_ws(' ', slice(w, 1, a), slice(flatten(array_repeat(slice(w, a + 1, p), cast(ceil((n - a) / p) as int))), 1, n - a))"
    return rows.select("doc_id", F.when(F.col("n") > 0, F.expr(repeated)).otherwise(F.col("text")).alias("text"))


def periodic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collapse_runs(with_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))).withColumn("top", strongest())
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "top.start",
        "top.length",
        "top.period",
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.expr(r"sha2(concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n'))), 256)").alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERY = ("op13_periodic_runs", periodic_documents)

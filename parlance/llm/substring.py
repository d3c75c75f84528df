"""Removal of repeated passages across a corpus by recompression.

Every window of `window` consecutive words that also starts earlier (in a smaller doc_id, or earlier in the same
document) is a repeat; each word that a repeat covers is removed. Windows are judged on the input.

Words become symbols, and levels of pair compression follow. A level splits the symbols into left and right ones by a
bit of a hash and makes one symbol of each left-right pair. A Spark round over the whole corpus names the pairs: it
counts each one's places and gives a number of its own to each pair that has two or more; this number is the symbol on
the next level, so equal passages have equal symbols in all documents. A pair with one place gets no name: no repeat can
hold it, so it pairs no further. What becomes of a symbol depends on its neighbours only: after two levels the symbol
borders of words 3 to 17 of a window of 20 are the same wherever the window stands. The next symbol is a phrase: the
fewest symbols from a border on that hold five words, all of them named. A third round names the phrases that have two
places. Each window has one phrase of its own, the one with the least hash among those that start at words 3 to 9, and
equal windows have the same one.

(Runs of one symbol are not made one symbol: a window that cuts a run off would see another symbol than the whole run,
as far into the window as the run reaches, and repeats of 20 words would be lost. The members of a run fall on the same
side, so they never pair, and a run that is cut off still agrees with a longer one. More levels would make symbols that
reach further than a window of 20 words surely holds.)

Windows whose phrase is named are verified: their content hashes (64 and 32 bits, from independent hashes of the words)
are counted in a last round, and each block gets back, for each hash that is shared, who has it first. Then each
document drops the words that windows with another, earlier owner cover.

Names are counted once for each batch of documents (with a mark if there were more), so a passage that a third of the
corpus shares costs one entry for each batch. A block is a range of rows of a stored file, so what a round answers is a
table by block in the shared folder, and texts are never shuffled. Windows of other sizes than 20 change only the range
of phrase starts; below 18 words no phrase is certain, which is refused.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.blocks import Answers, answer, buckets_of, by_bucket, is_in, pack, sent_rows, stored, stretches, unpack
from parlance.llm.common import Words, mix, new_folder, powers

_U = np.uint64
#: Bytes of text that a scan works on at once.
CHUNK = 2_000_000
PHRASE = 5
_NONE = np.iinfo(_U).max
#: Odd multipliers of the two content hashes.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class Content:
    """Hashes of any range of a row of symbols, from prefix sums."""

    def __init__(self, symbols: np.ndarray, base: int):
        n = len(symbols) + 1
        self.base, self.sums = base, np.zeros(n, _U)
        np.cumsum(symbols * powers(base, n)[:-1], dtype=_U, out=self.sums[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * powers(self.base, len(self.sums), True)[a] + (b - a).astype(_U))


#: Levels of pair compression; each has a naming round.
LEVELS = 2


class Level:
    """The symbols of a row of words on one level: where each starts, and which pair with nothing (separators, and pairs
    that the corpus has once)."""

    def __init__(self, symbols: np.ndarray, at: np.ndarray, stop: np.ndarray, number: int = 0):
        self.symbols, self.at, self.stop, self.number = symbols, at, stop, number

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(place of the left symbol, content of the pair) for each pair that this level makes."""
        side = mix(self.symbols + _U(self.number + 1)) >> _U(63)
        first = np.flatnonzero((side[:-1] == 0) & (side[1:] == 1) & ~self.stop[:-1] & ~self.stop[1:])
        return first, mix(self.symbols[first] * _U(_BASES[0]) + self.symbols[first + 1])

    def next(self, named: list[np.ndarray] | None) -> Level:
        """The next level, by the names that the corpus has given: sorted contents and the number of each."""
        first, content = self.pairs()
        symbols, stop = self.symbols.copy(), self.stop.copy()
        if named is None:
            symbols[first], stop[first] = content, True
        else:
            at = np.minimum(np.searchsorted(named[0], content), len(named[0]) - 1)
            has = named[0][at] == content
            symbols[first], stop[first] = np.where(has, mix(named[1][at] + _U(self.number + 1 << 60)), content), ~has
        keep = np.ones(len(symbols), bool)
        keep[first + 1] = False
        return Level(symbols[keep], self.at[keep], stop[keep], self.number + 1)


class Chunk:
    """Some documents' words in a row, with a separator behind each document."""

    def __init__(self, words: Words, window: int):
        self.words, self.window = words, window
        self.sizes = words.sizes
        self.first = words.first + np.arange(len(words.first))
        self.place = np.arange(len(words)) + np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.symbols = self._laid(0)
        self.stop = np.zeros(len(self.symbols), bool)
        self.stop[self.first[1:] - 1] = True
        # Where windows start, and the document of each.
        counts = np.maximum(0, self.sizes - window + 1)
        self.doc = np.repeat(np.arange(len(self.sizes)), counts)
        skipped = np.repeat(self.first[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
        self.starts = np.arange(len(self.doc)) + skipped
        self.content = Content(self.symbols, _BASES[0])

    def _laid(self, which: int) -> np.ndarray:
        out = np.zeros(int(self.first[-1]), _U)
        out[self.place] = self.words.hashes(which)
        return out

    def level(self, named: list[list[np.ndarray] | None]) -> Level:
        """The level above those that have been named."""
        out = Level(self.symbols, np.arange(len(self.symbols)), self.stop)
        for names in named:
            out = out.next(names)
        return out

    def phrases(self, named: list[list[np.ndarray] | None]) -> tuple[np.ndarray, np.ndarray]:
        """The content of each window's own phrase (the greatest number: it has none), and the contents of these phrases,
        once for each place where one stands."""
        n = len(self.symbols)
        level = self.level(named)
        at = level.at
        last = np.minimum(np.searchsorted(at, at + PHRASE), len(at))
        alone = np.append(0, np.cumsum(level.stop))
        whole = alone[last] == alone[:-1]  # all its symbols have names
        end = np.append(at, n)[last]
        names = np.full(n + self.window, _NONE, _U)
        names[at[whole]] = self.content.of(at[whole], end[whole])
        span = self.window - 13  # starts at words 3 to window - 11
        acc = names[3 : 3 + n].copy()
        for k in range(1, span):
            np.minimum(acc, names[3 + k : 3 + k + n], out=acc)
        own = acc[self.starts]
        chosen = np.zeros(len(names), bool)
        for k in range(3, 3 + span):
            at = self.starts + k
            chosen[at[names[at] == own]] = True
        chosen &= names != _NONE
        return own, names[chosen]

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The content hashes (64 and 32 bits) of the windows with these numbers, from independent hashes of the words."""
        a = self.starts[which]
        second = Content(self._laid(1), _BASES[1])
        return self.content.of(a, a + self.window), (second.of(a, a + self.window) >> _U(32)).astype(np.uint32)


_NAMES = ("u8", "u8")  # contents, numbers
_ENTRY = ("u8", "u4", "i8", "u8", "u4", "u1")  # both hashes, doc_id, row's own number, start, seen more than once
_OWNER = ("u8", "u4", "i8", "u8", "u4")


def _chunks(batch: pa.RecordBatch, window: int) -> Iterator[tuple[int, slice, Chunk]]:
    """(block, rows of the batch, chunk) for stretches of one block."""
    for block, part, words in stretches(batch, CHUNK):
        yield block, part, Chunk(words, window)


def _own(batch: pa.RecordBatch) -> np.ndarray:
    """A number for each row, which tells rows of one doc_id apart."""
    return mix(batch.column("block").to_numpy().view(_U) + batch.column("row").to_numpy().astype(_U))


def remove_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_removed and text, the kept words joined by single blanks.

    Null and empty texts have no words and keep an empty text. Rows of one doc_id, null ones included, count as
    different documents, ordered by a hash of where they are stored; null comes first. Texts of any length are handled
    whole; other columns are not read; an empty table gives an empty result.
    """
    if window < 18:
        raise ValueError("a window needs 18 words or more")
    spark = docs.sparkSession
    rows = stored(docs)
    buckets = buckets_of(rows)
    base = new_folder(spark, "repeats")

    kind = "bucket int, block long, data binary"
    levels: list[str] = []  # what the rounds have named so far, pairs by level and then phrases

    def contents(batches, levels: list[str]):
        """The pairs of the next level, or the phrases above the last one."""
        known = [Answers(x, _NAMES) for x in levels]
        for batch in batches:
            for block, _, chunk in _chunks(batch, window):
                named = [x.of(block) for x in known]
                found = chunk.level(named).pairs()[1] if len(named) < LEVELS else chunk.phrases(named)[1]
                names, counts = np.unique(found, return_counts=True)
                yield sent_rows([(k, block, pack(names[at], (counts[at] > 1).astype("u1"))) for k, at in by_bucket(names, buckets)])

    def name(t: pa.Table) -> pa.Table:
        """Numbers for the contents of a bucket that have two places or more; each block gets those that it has."""
        parts = [unpack(x.as_py(), "u8", "u1") for x in t["data"]]
        names = np.concatenate([p[0] for p in parts])
        # A content from one chunk counts once, or twice if the chunk had more of it.
        weight = np.concatenate([p[1] for p in parts]).astype(np.int64) + 1
        owner = np.repeat(t["block"].to_numpy(), [len(p[0]) for p in parts])
        uniq, inverse = np.unique(names, return_inverse=True)
        shared = np.bincount(inverse, weight, len(uniq)) > 1
        number = np.cumsum(shared).astype(_U) * _U(buckets) + _U(t["bucket"][0].as_py())
        keep = shared[inverse]
        inverse, owner = inverse[keep], owner[keep]
        order = np.argsort(owner, kind="stable")
        bs, cuts = np.unique(owner[order], return_index=True)
        data = []
        for a, b in zip(cuts, [*cuts[1:], len(order)]):
            at = np.unique(inverse[order[a:b]])
            data.append(pack(uniq[at], number[at]))
        return pa.table({"block": pa.array(bs, pa.int64()), "data": pa.array(data, pa.binary())})

    for k in range(LEVELS + 1):
        sent = rows.mapInArrow(functools.partial(contents, levels=list(levels)), kind)
        levels.append(answer(sent, name, f"{base}/names-{k}"))

    class Named:
        """For the block at hand, the windows of a chunk whose phrase has a name."""

        def __init__(self):
            self.known = [Answers(x, _NAMES) for x in levels]

        def of(self, block: int, chunk: Chunk) -> np.ndarray:
            *named, phrases = [x.of(block) for x in self.known]
            return np.flatnonzero(is_in(chunk.phrases(named)[0], phrases[0])) if phrases is not None else np.zeros(0, np.int64)

    def name_windows(batches):
        named = Named()
        for batch in batches:
            ids, own = batch.column("doc_id").to_numpy(), _own(batch)
            for block, part, chunk in _chunks(batch, window):
                which = named.of(block, chunk)
                if not len(which):
                    continue
                h, g = chunk.windows(which)
                doc = chunk.doc[which]
                start = (chunk.starts[which] - chunk.first[doc]).astype(np.uint32)
                doc_id, mine = ids[part][doc], own[part][doc]
                # The first of each hash in this chunk, and whether there are more.
                order = np.lexsort((start, mine, doc_id, g, h))
                h, g, doc_id, mine, start = (x[order] for x in (h, g, doc_id, mine, start))
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
                more = np.diff(np.append(np.flatnonzero(new), len(h))) > 1
                h, g, doc_id, mine, start = (x[new] for x in (h, g, doc_id, mine, start))
                back = np.lexsort((start, mine, doc_id))  # in order of place the entries compress better
                h, g, doc_id, mine, start, more = (x[back] for x in (h, g, doc_id, mine, start, more.astype("u1")))
                yield sent_rows([(k, block, pack(h[at], g[at], doc_id[at], mine[at], start[at], more[at])) for k, at in by_bucket(h, buckets)])

    def share_windows(t: pa.Table) -> pa.Table:
        blocks = t["block"].to_numpy()
        parts = [unpack(x, *_ENTRY) for x in t["data"].to_pylist()]
        block = np.repeat(blocks, [len(p[0]) for p in parts])
        h, g, doc_id, own, start, more = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((start, own, doc_id, g, h))
        h, g, doc_id, own, start, more, block = (x[order] for x in (h, g, doc_id, own, start, more, block))
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        head = np.flatnonzero(new)
        first = np.repeat(head, np.diff(np.append(head, len(h))))
        # A block needs no answer for a hash of which it has just the first occurrence.
        need = (first != np.arange(len(h))) | (more > 0)
        cols = (h[need], g[need], doc_id[first[need]], own[first[need]], start[first[need]])
        block = block[need]
        order = np.argsort(block, kind="stable")
        bs, cuts = np.unique(block[order], return_index=True)
        data = [pack(*(x[order[a:b]] for x in cols)) for a, b in zip(cuts, [*cuts[1:], len(order)])]
        return pa.table({"block": pa.array(bs, pa.int64()), "data": pa.array(data, pa.binary())})

    windows = answer(rows.mapInArrow(name_windows, kind), share_windows, f"{base}/windows")

    def drop(batches):
        named, owners = Named(), Answers(windows, _OWNER)
        for batch in batches:
            ids, own = batch.column("doc_id").to_numpy(), _own(batch)
            n_words, n_removed, kept = [], [], []
            for block, part, chunk in _chunks(batch, window):
                gone = np.zeros(len(chunk.symbols) + 1, np.int64)
                owner = owners.of(block)
                if owner is not None and len(which := named.of(block, chunk)):
                    h, g = chunk.windows(which)
                    doc = chunk.doc[which]
                    start = (chunk.starts[which] - chunk.first[doc]).astype(np.uint32)
                    at = _places(owner, h, g)
                    o = np.maximum(at, 0)
                    repeat = (at >= 0) & ((owner[2][o] != ids[part][doc]) | (owner[3][o] != own[part][doc]) | (owner[4][o] != start))
                    a = chunk.starts[which[repeat]]
                    gone[a] += 1
                    np.subtract.at(gone, a + window, 1)
                covered = np.cumsum(gone)[:-1] > 0
                lost = np.diff(np.append(0, np.cumsum(covered))[chunk.first])
                n_words.append(chunk.sizes)
                n_removed.append(lost)
                for text, a, n, some in zip(batch.column("text").slice(part.start, part.stop - part.start).cast(pa.binary()).to_pylist(), chunk.first, chunk.sizes, lost):
                    ws = (text or b"").split()
                    kept.append(b" ".join(ws if not some else itertools.compress(ws, (~covered[a : a + n]).tolist())))
            if not kept:
                continue
            yield pa.record_batch(
                [pc.if_else(batch.column("no_id"), pa.scalar(None, pa.int64()), batch.column("doc_id")), pa.array(np.concatenate(n_words)), pa.array(np.concatenate(n_removed)), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "text"],
            )

    return rows.mapInArrow(drop, "doc_id long, n_words long, n_removed long, text string")


def _places(owner: list[np.ndarray], h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Where each (h, g) stands in the owners, which are sorted by the first hash; -1: nowhere."""
    at = np.searchsorted(owner[0], h)
    out = np.full(len(h), -1, np.int64)
    todo = np.arange(len(h))
    while len(todo):  # more than one step only where the first hashes of different windows agree
        todo = todo[at[todo] < len(owner[0])]
        todo = todo[owner[0][at[todo]] == h[todo]]
        hit = owner[1][at[todo]] == g[todo]
        out[todo[hit]] = at[todo[hit]]
        todo = todo[~hit]
        at[todo] += 1
    return out


def digest(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))

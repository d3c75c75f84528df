"""Language-model scoring: a causal self-attention model trained in numpy on subword ids, and a unigram base score.

Base. Tokens are the words in lower case (A-Z only) and one end for each document. Counts over all training documents
are summed by word hash (64 bits) in buckets; each block of documents gets back the counts of its own words.

Model. A second scan gives each document its base score and cuts it into the tokenizer's subwords, whose ids are kept in
the shared folder; unigram and bigram counts of ids cover all training documents. An id is predicted in two steps, its
class given all that precedes it in the window, and the id given its class and the id before:

    p(id | before) = softmax(T[previous id] + U (x + attention(x)))[class] * p(id | class, previous id)

Classes group ids that follow the same ids (k-means on left-neighbour distributions). T and the last factor are smoothed
bigram counts (Witten-Bell); the embeddings x, one causal self-attention layer and U are trained by Adam on every window
of the training documents, once. The windows are dealt to `ROUNDS` rounds; in each, tasks train on their own windows from
common parameters and the parameters are averaged. Probabilities sum to 1 over all ids and the end.

Scoring. Windows of `WINDOW` ids overlap by `OVERLAP`; the first scores all its ids, later ones those behind the
overlap, so each id and the end are scored once, in batches with a causal mask.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.blocks import Answers, answer, buckets_of, by_bucket, distinct, is_in, pack, sent_rows, stored, stretches, unpack
from parlance.llm.common import Words, cut, new_folder, release
from parlance.llm.tokens import Encoder

#: Documents with this remainder of crc32(doc_id) are held out.
FOLDS, HELD_OUT = 7, 2
#: Model sizes: window, overlap, width, classes, ids with parameters of their own (the most frequent ones).
WINDOW, OVERLAP, WIDTH, CLASSES, OWN_IDS = 32, 4, 16, 64, 2047
#: Rounds of averaging; windows of a step; step size.
ROUNDS, STEP, RATE = 2, 128, 0.01
#: Windows that are scored at once, and training windows that are laid out at once.
SCORED, TRAINED = 128, 64 * STEP
#: Windows of a step that go through the layers at once.
PART = 64
#: Bytes of text that a scan works on at once.
CHUNK = 2_000_000
#: Words that the scan's lexicon holds (about 50 bytes each), and pieces of words that its encoder remembers.
LEXICON, PIECES = 1_500_000, 200_000
#: Bytes of an Arrow batch: a stored row holds hundreds of documents.
BATCH_BYTES = str(8 << 20)
_U = np.uint64
_FAR = np.float32(-1e9)


@functools.lru_cache(64)
def _mask(w: int) -> np.ndarray:
    """Nothing sees what comes after it."""
    return np.triu(np.full((w, w), _FAR, np.float32), 1)


def _in_range(sums: np.ndarray) -> bool:
    return bool(np.isfinite(sums).all() and (sums > 1e-30).all())


def sums_by(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows, which have an even number of columns, by their number in `at`, which lies below n."""
    pairs = np.complex64 if rows.dtype == np.float32 else np.complex128  # two columns are added at once
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    half = rows.shape[1] // 2
    np.add.at(out.view(pairs).reshape(-1), np.take(np.arange(n * half).reshape(n, half), at, axis=0).reshape(-1), rows.view(pairs).reshape(-1))
    return out


# -- the model --------------------------------------------------------------------------------------------------------
class Model:
    """Tables (slot and class of each id, log p(id | slot), log p(slot | class, slot before), T) and trained parameters."""

    def __init__(self, slot, klass, inside, within, bigram, params):
        self.slot, self.klass, self.inside, self.within, self.bigram, self.params = slot, klass, inside, within, bigram, params
        self._ready = None

    def tables(self) -> tuple:
        """For scoring, products of parameters: queries of slots and of places, keys and values of both side by side (one row is
        taken for a place), what slots, places and values add to the classes."""
        if self._ready is None:
            p = self.params
            d = p["E"].shape[1]
            each = lambda x: [np.ascontiguousarray(t) for t in np.split(x @ self.scaled(), [d], axis=1)]
            self._ready = (each(p["E"]), each(p["P"]), p["E"] @ p["U"] + self.bigram, p["P"] @ p["U"], p["O"] @ p["U"])
        return self._ready

    def scaled(self) -> np.ndarray:
        """A, with the scale of the products of queries and keys in its queries."""
        a = self.params["A"].copy()
        a[:, : len(a)] *= a.dtype.type(len(a) ** -0.5)
        return a

    def logits(self, slots: np.ndarray, clip: bool = False, skip: int = 0) -> np.ndarray:
        """(windows, places from `skip` on, classes): of the class that follows each place's id, the log probability up to a
        constant. clip: takes off the greatest first; callers ask for it where sums of exp leave single precision."""
        of_slot, of_place, by_slot, by_place, by_value = self.tables()
        b, w = slots.shape
        flat, asked = slots.reshape(-1), slots[:, skip:].reshape(-1)
        q, kv = (np.take(t, at, axis=0).reshape(b, -1, t.shape[1]) for t, at in zip(of_slot, (asked, flat)))
        q += of_place[0][skip:w]
        kv += of_place[1][:w]
        k, v = kv[:, :, : q.shape[2]], kv[:, :, q.shape[2] :]
        s = np.matmul(q, k.transpose(0, 2, 1))
        s += _mask(w)[skip:]
        if clip:
            s -= s.max(axis=2, keepdims=True)
        np.exp(s, out=s)
        o = np.matmul(s, v)
        o = o.reshape(len(asked), -1)
        o *= (1 / (s.reshape(-1, w) @ np.ones(w, s.dtype)))[:, None]
        z = o @ by_value
        z += np.take(by_slot, asked, axis=0)
        z = z.reshape(b, w - skip, -1)
        z += by_place[skip:w]
        return z - z.max(axis=2, keepdims=True) if clip else z

    def gradients(self, slots: np.ndarray, wanted: np.ndarray, weight: np.ndarray, clip: bool = False) -> tuple[float, dict]:
        """Loss and gradients; wanted: the class that follows each place, weight: 0 where nothing follows. Windows go through
        by `PART`, which the caches hold. Scales of rows are put on arrays of the model's width, not on those of windows or classes."""
        p, a = self.params, self.scaled()
        (b, w), (d, n_classes) = slots.shape, p["U"].shape
        kind = p["E"].dtype
        total = max(1.0, float(weight.sum()))
        g = {k: np.zeros_like(p[k]) for k in "AOPU"}
        dx, loss = np.empty((b, w, d), kind), 0.0
        for start in range(0, b, PART):
            part = slice(start, min(b, start + PART))
            flat, want, r = slots[part].reshape(-1), wanted[part].reshape(-1), weight[part].reshape(-1).astype(kind)
            n = len(flat)
            x = np.take(p["E"], flat, axis=0).reshape(-1, w, d)
            x += p["P"][:w]
            x = x.reshape(n, d)
            qkv = (x @ a).reshape(-1, w, 3 * d)
            q, k, v = (qkv[:, :, i * d : (i + 1) * d] for i in range(3))
            s = np.matmul(q, k.transpose(0, 2, 1))
            s += _mask(w)
            if clip:
                s -= s.max(axis=2, keepdims=True)
            np.exp(s, out=s)
            by_row = (1 / (s.reshape(n, w) @ np.ones(w, kind)))[:, None]
            o = np.matmul(s, v).reshape(n, d)
            o *= by_row
            h = o @ p["O"]
            h += x
            z = h @ p["U"]
            z += np.take(self.bigram, flat, axis=0)
            if clip:
                z -= z.max(axis=1, keepdims=True)
            at = np.arange(0, n * n_classes, n_classes) + want
            got = z.reshape(-1)[at]
            np.exp(z, out=z)
            sums = z @ np.ones(n_classes, kind)
            if not clip and not _in_range(sums):
                return self.gradients(slots, wanted, weight, clip=True)
            got -= np.log(sums)
            loss -= float(got @ r) / total
            r /= kind.type(total) * sums
            z.reshape(-1)[at] -= sums
            dh = np.matmul(z, p["U"].T, out=dx[part].reshape(n, d))
            dh *= r[:, None]
            h *= r[:, None]
            g["U"] += h.T @ z
            g["O"] += o.T @ dh
            do = dh @ p["O"].T
            do *= by_row
            rest = np.einsum("ij,ij->i", do, o).reshape(-1, w, 1)  # what softmax's gradient takes off each row
            do = do.reshape(-1, w, d)
            dqkv = np.empty((len(s), w, 3 * d), kind)
            np.matmul(s.transpose(0, 2, 1), do, out=dqkv[:, :, 2 * d :])
            ds = np.matmul(do, v.transpose(0, 2, 1))
            ds -= rest
            ds *= s
            np.matmul(ds, k, out=dqkv[:, :, :d])
            np.matmul(ds.transpose(0, 2, 1), q, out=dqkv[:, :, d : 2 * d])
            dqkv = dqkv.reshape(n, 3 * d)
            g["A"] += x.T @ dqkv
            dh += dqkv @ a.T
        g["A"][:, :d] *= kind.type(d**-0.5)
        g["P"][:w] = dx.sum(axis=0)
        g["E"] = sums_by(slots.reshape(-1), dx.reshape(-1, d), len(p["E"]))
        return loss, g

    def train(self, slots: np.ndarray, wanted: np.ndarray, weight: np.ndarray, state: dict | None = None) -> float:
        """One pass of Adam over windows; returns the mean loss. state: Adam's moments, which later calls go on with."""
        state = {} if state is None else state
        n = sum(x.size for x in self.params.values())
        m, u = (state.setdefault(x, np.zeros(n, np.float32)) for x in ("m", "u"))
        losses = []
        for a in range(0, len(slots), STEP):
            t = state["t"] = state.get("t", 0) + 1
            loss, by_name = self.gradients(slots[a : a + STEP], wanted[a : a + STEP], weight[a : a + STEP])
            losses.append(loss)
            rate, often = np.float32(RATE / (1 - 0.9**t)), np.float32(1 / (1 - 0.99**t))
            g = np.concatenate([by_name[k].reshape(-1) for k in self.params])  # all parameters in a row
            m += np.float32(0.1) * (g - m)
            np.square(g, out=g)
            g -= u
            g *= np.float32(0.01)
            u += g
            np.multiply(u, often, out=g)
            np.sqrt(g, out=g)
            g += np.float32(1e-6)
            np.divide(m, g, out=g)
            g *= rate
            at = 0
            for x in self.params.values():
                x -= g[at : at + x.size].reshape(x.shape)
                at += x.size
        self._ready = None
        return float(np.mean(losses)) if losses else 0.0

    def before(self, flat: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The slot of the id before each place of rows of ids that begin at `first`."""
        out = np.empty(len(flat), np.int64)
        out[1:] = self.slot[flat[:-1]]
        out[first] = len(self.bigram) - 1  # the beginning
        return out

    def score(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """log10 probability of each text, the end included; ids holds those of all texts in a row."""
        if not len(sizes):
            return np.zeros(0)
        flat, first = with_ends(ids, sizes, self.end)
        lengths = sizes + 1
        wanted = self.klass[flat]
        before = self.before(flat, first[:-1])
        step = WINDOW - OVERLAP
        out = self.inside[flat] + self.within[before, self.slot[flat]]
        # Windows behind the first of their document, of which only what lies behind the overlap is asked for, and first ones;
        # of each those of full length, then those that the document's end cuts short.
        count = np.maximum(0, -(-(lengths - WINDOW) // step)) + 1
        doc = np.repeat(np.arange(len(sizes)), count)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        start = first[doc] + nth * step
        size = np.minimum(WINDOW, first[doc + 1] - start)
        at = np.arange(WINDOW)
        for skip, some in ((OVERLAP, np.flatnonzero(nth > 0)), (0, np.flatnonzero(nth == 0))):
            order = some[np.argsort(-size[some], kind="stable")]
            for a in range(0, len(order), SCORED):
                pick = order[a : a + SCORED]
                w = int(size[pick[0]])
                places = start[pick, None] + at[:w]
                cut_short = size[pick[-1]] < w
                if cut_short:
                    places = np.minimum(places, len(flat) - 1)
                slots, asked = np.take(before, places), places[:, skip:].reshape(-1)
                for clip in (False, True):
                    z = self.logits(slots, clip, skip).reshape(len(asked), -1)
                    got = z.reshape(-1)[np.arange(0, z.size, z.shape[1]) + np.take(wanted, asked)]
                    np.exp(z, out=z)
                    sums = z @ np.ones(z.shape[1], z.dtype)
                    if _in_range(sums):
                        break
                got -= np.log(sums)
                if cut_short:
                    real = (at[skip:w] < size[pick, None]).reshape(-1)
                    asked, got = asked[real], got[real]
                out[asked] += got
        return np.add.reduceat(out.astype(np.float64), first[:-1]) / np.log(10)

    @property
    def end(self) -> int:
        return len(self.klass) - 1

    def dump(self) -> dict[str, np.ndarray]:
        return {"slot": self.slot, "klass": self.klass, "inside": self.inside, "within": self.within, "bigram": self.bigram, **{f"p_{k}": v for k, v in self.params.items()}}


def with_ends(ids: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts' ids in a row with an end behind each text, and where the texts begin."""
    first = np.concatenate([[0], np.cumsum(sizes + 1)])
    flat = np.full(int(first[-1]), end, np.int64)
    inside = np.ones(len(flat), bool)
    inside[first[1:] - 1] = False
    flat[inside] = ids
    return flat, first


def classes(bigrams: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Groups the ids (columns) by what precedes them (rows): k-means on square roots of the distributions."""
    seen = bigrams.sum(axis=0)
    x = np.sqrt((bigrams / np.maximum(1, seen)).T.astype(np.float32))
    order = np.argsort(-seen, kind="stable")
    centre = x[order[:k]].copy()
    for _ in range(rounds):
        to = np.argmax(x @ centre.T - 0.5 * (centre**2).sum(axis=1), axis=1)
        for c in range(k):
            w = seen[to == c]
            if w.sum():
                centre[c] = (x[to == c] * w[:, None]).sum(axis=0) / w.sum()
    return to


def build(unigrams: np.ndarray, own: np.ndarray, bigrams: np.ndarray, seed: int = 11) -> Model:
    """The model before training. unigrams: counts of all ids and, last, the end; own: the ids with slots of their own;
    bigrams: counts by slot before (own ids, other, beginning) and slot (own ids, other)."""
    n_ids, n_own = len(unigrams), len(own)
    slot = np.full(n_ids, n_own, np.int64)
    slot[own] = np.arange(n_own)
    k = max(1, min(CLASSES - 1, n_own))
    group = classes(bigrams[:, :n_own].astype(np.float64), k) if n_own else np.zeros(0, np.int64)
    klass = np.full(n_ids, k, np.int64)  # ids without a slot are a class of their own
    klass[own] = group
    counts = unigrams + 1.0
    by_slot = np.bincount(slot, counts, n_own + 1)
    inside = (np.log(counts) - np.log(by_slot)[slot]).astype(np.float32)
    of_slot = np.append(group, k)
    kinds = (bigrams > 0).sum(axis=1, keepdims=True) + 1.0  # Witten-Bell: as many unseen as there are kinds of followers
    p = (bigrams + kinds * (by_slot / by_slot.sum())) / (bigrams.sum(axis=1, keepdims=True) + kinds)
    by_class = np.zeros((n_own + 2, k + 1))
    for c in range(k + 1):
        by_class[:, c] = p[:, of_slot == c].sum(axis=1)
    bigram = np.log(np.maximum(by_class, 1e-30)).astype(np.float32)
    within = (np.log(p) - bigram[:, of_slot]).astype(np.float32)
    rng = np.random.default_rng(seed)
    normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    d = WIDTH
    params = {"E": normal(n_own + 2, d, scale=0.3), "P": normal(WINDOW, d, scale=0.1), "A": normal(d, 3 * d, scale=d**-0.5), "O": normal(d, d, scale=d**-0.5), "U": normal(d, k + 1, scale=0.02)}
    return Model(slot, klass, inside, within, bigram, params)


# -- rounds over the corpus -------------------------------------------------------------------------------------------
class Lexicon:
    """The ids of words by word hash (64 bits), in sorted arrays; emptied when it holds `most` words."""

    def __init__(self, path: str, most: int = LEXICON):
        self.encoder, self.most = Encoder(path, PIECES), most
        self.empty()

    def empty(self) -> None:
        self.names, self.sizes, self.at = np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, self.encoder.kind)

    def encode(self, texts: pa.Array, words: Words, names: np.ndarray, first: np.ndarray, of_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, how many each has). names: the sorted distinct hashes of the words in lower case,
        first: a word with each, of_word: each word's place among them."""
        if not self.encoder.by_piece:  # white space counts
            packed = list(self.encoder.encode(texts.to_pylist()))
            return np.frombuffer(b"".join(packed), self.encoder.kind), np.array([len(x) // self.encoder.width for x in packed], np.int64)
        if len(self.names) > self.most:
            self.empty()
        known = is_in(names, self.names) if len(self.names) else np.zeros(len(names), bool)
        if not known.all():
            new = np.flatnonzero(~known)
            data = words.data.tobytes()
            ids, sizes = self.encoder.encode_words([data[a:b] for a, b in zip(words.begin[first[new]].tolist(), words.end[first[new]].tolist())])
            at = len(self.ids) + np.cumsum(sizes) - sizes
            self.ids = np.append(self.ids, ids)
            joined = np.concatenate([self.names, names[new]])
            order = np.argsort(joined, kind="stable")
            self.names, self.sizes, self.at = joined[order], np.concatenate([self.sizes, sizes])[order], np.concatenate([self.at, at])[order]
        place = np.searchsorted(self.names, names)
        sizes = self.sizes[place][of_word]
        ends = np.append(0, np.cumsum(sizes))
        flat = self.ids[np.repeat(self.at[place][of_word] - ends[:-1], sizes) + np.arange(ends[-1])]
        return flat, np.diff(ends[words.first])


_lexicons: dict[str, Lexicon] = {}


def lexicon(path: str) -> Lexicon:
    """One lexicon for each worker process."""
    if path not in _lexicons:
        _lexicons[path] = Lexicon(path)
    return _lexicons[path]


def forget() -> None:
    """A worker that has scanned keeps no words for the rounds after."""
    if _lexicons:
        _lexicons.clear()
        release()


_HEAD = ("i8", "u1", "u1", "u4", "u4", "f8", "u4", "u8")  # doc_id, no id, held out, tokens, known ones, base, ids, row


def _kept(head: tuple, ids: np.ndarray) -> bytes:
    parts = [pack(*(np.asarray(x, k) for x, k in zip(head, _HEAD))), pack(ids)]
    return b"".join([ids.dtype.itemsize.to_bytes(8, "little"), len(parts[0]).to_bytes(8, "little"), *parts])


class Kept:
    """Some documents of one block as the scan has kept them."""

    def __init__(self, data: bytes):
        wide, size = (int.from_bytes(data[a : a + 8], "little") for a in (0, 8))
        self.doc_id, self.no_id, self.held, self.n_tokens, self.n_known, self.base, sizes, self.row = unpack(data[16 : 16 + size], *_HEAD)
        self.ids, self.sizes = unpack(data[16 + size :], f"<u{wide}")[0], sizes.astype(np.int64)

    def training(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, sizes, rows) of the training documents."""
        trains = self.held == 0
        return self.ids[np.repeat(trains, self.sizes)], self.sizes[trains], self.row[trains]


def _kept_rows(batches):
    forget()
    for batch in batches:
        for data in batch.column("data"):
            yield Kept(data.as_py())


def score_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    A null or empty text has the end as its one token. A null doc_id counts as the text "" for the fold. Repeated rows
    and rows of one doc_id are documents of their own. Without training documents all counts are 0 and the model knows
    nothing but the number of ids. Only doc_id and text are read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))
    rows = stored(docs, held_out=fold == HELD_OUT)
    buckets, base = buckets_of(rows), new_folder(spark, "lm")
    end_hash = _U(xxhash.xxh3_64_intdigest(b""))

    def count(batches):
        for batch in batches:
            held = batch.column("held_out").to_numpy(zero_copy_only=False)
            for block, part, words in stretches(batch, CHUNK):
                trains = ~held[part]
                names, _, at = distinct(words.hashes(lower=True))
                n = np.bincount(at[np.repeat(trains, words.sizes)], minlength=len(names)).astype("u4")
                names, n = np.append(names, end_hash), np.append(n, np.uint32(trains.sum()))
                yield sent_rows([(k, block, pack(names[at], n[at])) for k, at in by_bucket(names, buckets)])

    # Counts of words, answered by block, with each bucket's share of N and V.
    def share(t: pa.Table) -> pa.Table:
        parts = [unpack(x.as_py(), "u8", "u4") for x in t["data"]]
        names, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        ends = np.cumsum([len(p[0]) for p in parts])
        uniq, inverse = np.unique(names, return_inverse=True)
        total = np.bincount(inverse, counts.astype(np.float64), len(uniq)).astype("u8")
        blocks = t["block"].to_numpy()
        order = np.argsort(blocks, kind="stable")
        bs, cuts = np.unique(blocks[order], return_index=True)
        data = []
        for a, b in zip(cuts, [*cuts[1:], len(order)]):
            at = np.unique(np.concatenate([inverse[ends[i] - len(parts[i][0]) : ends[i]] for i in order[a:b]]))
            data.append(pack(uniq[at], total[at]))
        rest = [0] * (len(bs) - 1)
        return pa.table({"block": pa.array(bs, pa.int64()), "data": pa.array(data, pa.binary()), "n": pa.array([int(total.sum()), *rest], pa.int64()), "v": pa.array([int((total > 0).sum()), *rest], pa.int64())})

    folder = answer(rows.mapInArrow(count, "bucket int, block long, data binary"), share, f"{base}/words", ", n long, v long")
    n_train, n_distinct = spark.read.schema("n long, v long").parquet(folder).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    low = np.log10(1.0 / (n_train + n_distinct + 1))

    def scan(batches):
        lex, answers = lexicon(tokenizer), Answers(folder, ("u8", "u8"))
        unigrams = np.zeros(lex.encoder.full.get_vocab_size() + 1, np.int64)
        row_of = lambda block, data, counts: pa.record_batch([pa.array([block], pa.int64()), pa.array([data], pa.binary()), pa.array([counts], pa.binary())], names=["block", "data", "counts"])
        for batch in batches:
            held = batch.column("held_out").to_numpy(zero_copy_only=False)
            ids, null, row = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "no_id", "row"))
            for block, part, words in stretches(batch, CHUNK):
                names, counts = answers.of(block)
                h, some, at = distinct(words.hashes(lower=True))
                c = counts[np.searchsorted(names, h)]
                of_end = counts[np.searchsorted(names, end_hash)]
                logs = np.append(0, np.cumsum((np.log10(c + 1.0) + low)[at]))
                known = np.append(0, np.cumsum((c > 0)[at]))
                sums = [np.diff(x[words.first]) for x in (logs, known)]
                flat, sizes = lex.encode(batch.column("text").slice(part.start, part.stop - part.start), words, h, some, at)
                head = (ids[part], null[part], held[part], words.sizes + 1, sums[1] + int(of_end > 0), sums[0] + np.log10(of_end + 1.0) + low, sizes, row[part])
                yield row_of(block, _kept(head, flat), None)
                trains = ~held[part]
                unigrams += np.bincount(flat[np.repeat(trains, sizes)], minlength=len(unigrams))
                unigrams[-1] += int(trains.sum())
        seen = np.flatnonzero(unigrams)
        yield row_of(None, None, pack(seen.astype("u4"), unigrams[seen].astype("u8")))

    kind = "block long, data binary, counts binary"
    rows.mapInArrow(scan, kind).write.option("parquet.block.size", 16 << 20).parquet(f"{base}/scan")
    scanned = spark.read.schema(kind).parquet(f"{base}/scan")
    model = fit(scanned, tokenizer, base)

    def scores(batches):
        scorer = load(model)
        for kept in _kept_rows(batches):
            yield pa.record_batch(
                [
                    pa.array(kept.doc_id, mask=kept.no_id.astype(bool)), pa.array(kept.held.astype(bool)), pa.array(kept.n_tokens.astype(np.int64)), pa.array(kept.n_known.astype(np.int64)),
                    pa.array(np.full(len(kept.sizes), n_train, np.int64)), pa.array(kept.base), pa.array(scorer.score(kept.ids, kept.sizes), pa.float64()),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return scanned.where("data is not null").select("data").mapInArrow(scores, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


_loaded: dict[str, Model] = {}


def save(model: Model, uri: str) -> str:
    """Stores a model (some MB, whatever the corpus) in the shared folder; its largest table, which only scoring reads, in
    a file of its own."""
    import io

    from parlance.llm.common import uri_fs

    buffer = io.BytesIO()
    np.savez(buffer, **{k: v for k, v in model.dump().items() if k != "within"})
    fs, path = uri_fs(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path) as f:
        f.write(buffer.getvalue())
    with fs.open_output_stream(f"{path}.within") as f:
        f.write(np.ascontiguousarray(model.within, "<f4").data)
    return uri


def load(uri: str, scoring: bool = True) -> Model:
    if uri not in _loaded or scoring and _loaded[uri].within is None:
        import io

        from parlance.llm.common import uri_fs

        fs, path = uri_fs(uri)
        with fs.open_input_file(path) as f:
            x = dict(np.load(io.BytesIO(f.read())))
        within = None
        if scoring:
            with fs.open_input_file(f"{path}.within") as f:
                within = np.frombuffer(f.read_buffer(), "<f4").reshape(len(x["bigram"]), -1)
        _loaded.clear()
        _loaded[uri] = Model(x["slot"], x["klass"], x["inside"], within, x["bigram"], {k[2:]: v for k, v in x.items() if k.startswith("p_")})
    m = _loaded[uri]
    return Model(m.slot, m.klass, m.inside, m.within, m.bigram, {k: v.copy() for k, v in m.params.items()})


def fit(scanned: DataFrame, tokenizer: str, base: str) -> str:
    """Counts ids, sets the model up and trains it; returns where it is stored."""
    ids = scanned.where("data is not null").select("data")

    def spread(batches):
        for batch in batches:
            for data in batch.column("counts"):
                k, n = unpack(data.as_py(), "u4", "u8")
                yield pa.record_batch([pa.array(k.astype(np.int64)), pa.array(n.astype(np.int64))], names=["id", "n"])

    from tokenizers import Tokenizer

    n_ids = Tokenizer.from_file(tokenizer).get_vocab_size() + 1
    unigrams = np.zeros(n_ids, np.int64)
    counted = scanned.where("counts is not null").select("counts").mapInArrow(spread, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    for r in counted.collect():  # one row for each id of the tokenizer at most
        unigrams[r.id] = r.n
    order = np.argsort(-unigrams, kind="stable")[:OWN_IDS]
    own = np.sort(order[unigrams[order] > 0])
    slot = np.full(n_ids, len(own), np.int64)
    slot[own] = np.arange(len(own))
    width = len(own) + 2

    def pairs(batches):
        total = np.zeros(width * width, np.uint32)  # of one task
        for kept in _kept_rows(batches):
            texts, sizes, _ = kept.training()
            if len(sizes):
                flat, first = with_ends(texts, sizes, n_ids - 1)
                s = slot[flat]
                last = np.append(width - 1, s[:-1])
                last[first[:-1]] = width - 1  # the beginning
                np.add.at(total, last * width + s, np.uint32(1))
        known = np.flatnonzero(total)
        yield pa.record_batch([pa.array(known), pa.array(total[known].astype(np.int64))], names=["pair", "n"])

    bigrams = np.zeros(width * width, np.int64)
    got = ids.mapInArrow(pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # bounded by OWN_IDS squared
    bigrams[got["pair"].to_numpy()] = got["n"].to_numpy()
    bigrams = bigrams.reshape(width, width)[:, : width - 1]
    model = build(unigrams, own, bigrams)
    where = save(model, f"{base}/model-0.npz")
    names = sorted(model.params)

    def learn(batches, where: str, turn: int):
        m = load(where, scoring=False)
        n, state = 0, {}
        for kept in _kept_rows(batches):
            for slots, wanted, weight in training_windows(m, *kept.training(), turn):
                m.train(slots, wanted, weight, state)
                n += len(slots)
        if n:
            flat = np.concatenate([m.params[k].reshape(-1) for k in names])
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([n], pa.int64()), pa.array([flat.astype("f8").tobytes()], pa.binary())], names=["part", "n", "data"])

    def average(t: pa.Table) -> pa.Table:
        n = t["n"].to_numpy()
        x = sum(np.frombuffer(d, "f8") * w for d, w in zip(t["data"].to_pylist(), n))
        return pa.table({"part": pa.array([0], pa.int64()), "n": pa.array([int(n.sum())], pa.int64()), "data": pa.array([(x / n.sum()).tobytes()], pa.binary())})

    trained = False
    for turn in range(1, ROUNDS + 1):
        grown = cut(ids.mapInArrow(functools.partial(learn, where=where, turn=turn - 1), "part long, n long, data binary"))
        many = max(1, int(grown.count() ** 0.5))
        rows = grown.groupBy(F.pmod("part", F.lit(many)).alias("g")).applyInArrow(average, "part long, n long, data binary").collect()  # root of the tasks' number
        if not rows:  # no window was dealt to this round
            continue
        trained = True
        flat = sum(np.frombuffer(r.data, "f8") * r.n for r in rows) / sum(r.n for r in rows)
        at = 0
        for k in names:
            size = model.params[k].size
            model.params[k] = flat[at : at + size].reshape(model.params[k].shape).astype(np.float32)
            at += size
        where = save(model, f"{base}/model-{turn}.npz")
    if not trained:  # no training document: the counts alone, no random weights
        model.params["U"][:] = 0
        where = save(model, f"{base}/model-{ROUNDS + 1}.npz")
    return where


def training_windows(model: Model, ids: np.ndarray, sizes: np.ndarray, rows: np.ndarray, turn: int):
    """(slots, wanted, weight) of the windows that are dealt to a round; over all rounds each window comes once."""
    if not len(sizes):
        return
    flat, first = with_ends(ids, sizes, model.end)
    before = model.before(flat, first[:-1])
    wanted = model.klass[flat]
    count = -(-(sizes + 1) // WINDOW)
    doc = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    mine = np.flatnonzero((rows.astype(np.int64)[doc] + nth) % ROUNDS == turn)
    start = first[doc[mine]] + nth[mine] * WINDOW
    size = np.minimum(WINDOW, first[doc[mine] + 1] - start)
    at = np.arange(WINDOW)
    for a in range(0, len(mine), TRAINED):
        places = np.minimum(start[a : a + TRAINED, None] + at, len(flat) - 1)
        yield before[places], wanted[places], (at < size[a : a + TRAINED, None]).astype(np.float32)


def digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    return score_documents(docs, tokenizer)

"""Token-ID output: independent zstandard frames, a document index and a trailing seek table.

A file is a row of zstandard frames, each holding the ids of whole documents as little-endian integers of `width`
bytes; then a skippable frame with the document index; then the skippable seek table of the public zstd seekable
format (sizes and a checksum for each frame, the low 32 bits of XXH64). Any zstd reader can decompress the file as a
whole; `TokenFile` reads the tail and then only the frames that hold the requested documents.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import cut, new_folder, parts_of, release, uri_fs, words_of

# Fixed values of the zstd seekable format.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80


class Encoder:
    """Ids of a text, equal to `Tokenizer.encode(text, add_special_tokens=False).ids`.

    For tokenizers that lower-case a text and cut it by a pattern, a text whose code points lie below U+0250 is cut by
    the same pattern in one call, and the ids of each piece, which the tokenizer itself has given once, are looked up.
    Pieces are remembered in two generations, so that those in use outlive a full memory. In other texts each word goes
    that way on its own if it can, since the pattern never joins characters across white space; words that can't, texts
    with the strings of special tokens and other kinds of tokenizers go through the tokenizer whole.
    """

    def __init__(self, path: str, most_pieces: int = 650_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.full = Tokenizer.from_str(json.dumps(spec))
        self.pieces: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.most_pieces = most_pieces
        self.width = 2 if self.full.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", ())]
        splits = (spec["pre_tokenizer"] or {}).get("pretokenizers", ())
        self.by_piece = steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in splits] == ["Split", "ByteLevel"]
        if self.by_piece:
            pattern = splits[0]["pattern"]["Regex"]
            for kind in (r"\p{L}", r"\p{N}", r"\s"):
                pattern = pattern.replace(kind, _below(kind))
            self.cut, self.cut_lines = re.compile(pattern).findall, re.compile(f"{pattern}|\n").findall
            mark = spec["model"].get("end_of_word_suffix") or "\0"
            self.ends = np.zeros(self.full.get_vocab_size(), bool)
            self.ends[[i for t, i in self.full.get_vocab().items() if t.endswith(mark)]] = True
            self.special = [t["content"] for t in spec["added_tokens"]]
            self.bare = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": None, "added_tokens": []}))
            # The printable stand-ins of byte-level vocabularies: a byte that prints is itself, others follow from 256.
            plain = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 256 and b != 173]
            self.shown = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}

    def _whole(self, text: str) -> bytes:
        return np.array(self.full.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _found(self, text: str) -> list[str] | None:
        """The pieces of a text, or None where the pattern's short form does not hold."""
        low = text.lower()
        if not low.isascii() and _FAR.search(low) or any(t in text for t in self.special):
            return None
        return self.cut(low)

    def _learn(self, found: Iterator[list[str]]) -> None:
        """Has the ids of all these pieces in `pieces`."""
        if len(self.pieces) > self.most_pieces:
            self.old, self.pieces = self.pieces, {}
        pieces, old, todo = self.pieces, self.old, []
        for p in set().union(*found).difference(pieces):
            if (known := old.get(p)) is None:
                todo.append(p)
            else:
                pieces[p] = known
        for a in range(0, len(todo), 4096):
            part = todo[a : a + 4096]
            # As one text that is cut already; a piece ends with the id of a token that ends a word.
            shown = [p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(self.shown) for p in part]
            (e,) = self.bare.encode_batch_fast([shown], is_pretokenized=True, add_special_tokens=False)
            ids = np.array(e.ids, self.kind)
            ends = ((np.flatnonzero(self.ends[ids]) + 1) * self.width).tolist()
            if len(ends) != len(part):
                pieces.update((p, np.array(e.ids, self.kind).tobytes()) for p, e in zip(part, self.bare.encode_batch_fast(shown, add_special_tokens=False)))
                continue
            raw, start = ids.tobytes(), 0
            for p, end in zip(part, ends):
                pieces[p] = raw[start:end]
                start = end

    def _one_by_one(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        packed = list(self.encode([w.decode("utf-8", "replace") for w in words]))
        return np.frombuffer(b"".join(packed), self.kind), np.array([len(x) // self.width for x in packed], np.int64)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, how many each has), for words without white space; all are cut in one call."""
        if not words:
            return np.zeros(0, self.kind), np.zeros(0, np.int64)
        low = b"\n".join(words).decode("utf-8", "replace").lower()
        odd = lambda text: not text.isascii() and _FAR.search(text) is not None or any(t in text for t in self.special)
        if not self.by_piece:
            return self._one_by_one(words)
        if odd(low):  # the others are cut in one call all the same
            apart = np.fromiter((odd(w) for w in low.split("\n")), bool, len(words))
            if apart.all():
                return self._one_by_one(words)
            sizes = np.empty(len(words), np.int64)
            plain, sizes[~apart] = self.encode_words([w for w, a in zip(words, apart.tolist()) if not a])
            others, sizes[apart] = self._one_by_one([w for w, a in zip(words, apart.tolist()) if a])
            of_others = np.repeat(apart, sizes)
            ids = np.empty(len(of_others), self.kind)
            ids[~of_others], ids[of_others] = plain, others
            return ids, sizes
        found = self.cut_lines(low)
        self._learn([found])
        mark = b"\xff" * self.width  # no id
        self.pieces["\n"] = mark
        flat = np.frombuffer(b"".join(map(self.pieces.__getitem__, found)), self.kind)
        at = np.flatnonzero(flat == np.frombuffer(mark, self.kind)[0])
        return np.delete(flat, at), np.diff(np.concatenate([[-1], at, [len(flat)]])) - 1

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text, as packed integers of `width` bytes."""
        if not self.by_piece:
            for t in texts:
                yield self._whole(t or "")
            return
        # Some million characters at a time, so that their new pieces are learnt together.
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size < 1_000_000):
                size += len(texts[end] or "")
                end += 1
            # Of each text the parts that are cut into pieces (one as a rule); a part that can't be is a str.
            cuts: list[list[list[str] | str]] = []
            for t in texts[at:end]:
                if not t:
                    cuts.append([])
                elif (found := self._found(t)) is not None:
                    cuts.append([found])
                elif any(x in t for x in self.special):
                    cuts.append([t])
                else:
                    words = [w.decode("utf-8", "replace") for w in words_of(t)]
                    cuts.append([w if (ps := self._found(w)) is None else ps for w in words])
            self._learn(x for parts in cuts for x in parts if not isinstance(x, str))
            known = self.pieces.__getitem__
            for parts in cuts:
                yield b"".join([self._whole(x) if isinstance(x, str) else b"".join(map(known, x)) for x in parts])
            at = end


#: No text with such a character is cut by the short form of a tokenizer's pattern.
_FAR = re.compile(r"[^\x00-\u024f]")


def _below(kind: str) -> str:
    """The characters of a class of a tokenizer's pattern below U+0250, as the inside of brackets."""
    is_of = regex.compile(kind).fullmatch
    return "".join(re.escape(c) for c in map(chr, range(0x250)) if is_of(c) and not (kind == r"\s" and 0x1C <= ord(c) < 0x20))


#: Pieces of a generation that an encoder remembers, about 150 bytes each; SMALL is for workers that other operators have
#: used before.
LARGE, SMALL = 500_000, 250_000
_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, memory: int = LARGE) -> Encoder:
    """One encoder for each worker process; it outlives the task."""
    if (path, memory) not in _encoders:
        _encoders[path, memory] = Encoder(path, memory)
    return _encoders[path, memory]


def _skippable(magic: int, body: bytes) -> bytes:
    return struct.pack("<II", magic, len(body)) + body


class FrameWriter:
    """Writes documents' ids to a binary stream in the format above; holds one frame at a time."""

    def __init__(self, out, width: int, frame_bytes: int = 1 << 19, level: int = 3):
        self.out, self.width, self.frame_bytes = out, width, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.seek: list[tuple[int, int, int]] = []
        self.ids: list[int] = []
        self.nulls: list[int] = []
        self.sizes: list[int] = []
        self.in_frame: list[int] = []
        self.held: list[bytes] = []
        self.held_bytes = 0

    def add(self, doc_id: int | None, packed: bytes) -> None:
        self.ids.append(0 if doc_id is None else doc_id)
        self.nulls.append(doc_id is None)
        self.sizes.append(len(packed) // self.width)
        self.held.append(packed)
        self.held_bytes += len(packed)
        if self.held_bytes >= self.frame_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            raw = b"".join(self.held)
            frame = self.zstd.compress(raw)
            self.out.write(frame)
            self.seek.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.in_frame.append(len(self.held))
            self.held, self.held_bytes = [], 0

    def close(self) -> None:
        self._flush()
        body = struct.pack("<BIQ", self.width, len(self.seek), len(self.ids)) + np.array(self.in_frame, "<u4").tobytes() + np.array(self.ids, "<i8").tobytes() + np.array(self.nulls, "u1").tobytes() + np.array(self.sizes, "<u4").tobytes()
        index = _skippable(SKIPPABLE_INDEX, self.zstd.compress(body))
        table = b"".join(struct.pack("<III", *x) for x in self.seek)
        table += struct.pack("<IBI", len(self.seek), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(index)
        self.out.write(_skippable(SKIPPABLE_SEEK, table))


class TokenFile:
    """Random access to a token file: `docs` lists (doc_id, n_tokens), `read(i)` gives the ids of the i-th document."""

    def __init__(self, f, size: int):
        self.f = f
        f.seek(size - 9)
        n, flag, magic = struct.unpack("<IBI", f.read(9))
        if magic != SEEKABLE_MAGIC or not flag & CHECKSUM_FLAG:
            raise ValueError("not a token file: its seek table is missing")
        f.seek(size - 9 - 12 * n - 8)
        head, length = struct.unpack("<II", f.read(8))
        if head != SKIPPABLE_SEEK or length != 12 * n + 9:
            raise ValueError("the seek table is damaged")
        self.seek = np.frombuffer(f.read(12 * n), "<u4").reshape(n, 3)
        self.at = np.concatenate([[0], np.cumsum(self.seek[:, 0], dtype=np.int64)])
        f.seek(int(self.at[-1]))
        head, length = struct.unpack("<II", f.read(8))
        if head != SKIPPABLE_INDEX:
            raise ValueError("the document index is missing")
        body = zstandard.ZstdDecompressor().decompress(f.read(length))
        self.width, frames, docs = struct.unpack_from("<BIQ", body)
        at = 13
        self.in_frame = np.frombuffer(body, "<u4", frames, at)
        at += 4 * frames
        self.doc_ids = np.frombuffer(body, "<i8", docs, at)
        at += 8 * docs
        self.nulls = np.frombuffer(body, "u1", docs, at)
        at += docs
        self.sizes = np.frombuffer(body, "<u4", docs, at)
        self.first = np.concatenate([[0], np.cumsum(self.in_frame, dtype=np.int64)])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes, dtype=np.int64)])

    def frame(self, k: int) -> bytes:
        self.f.seek(int(self.at[k]))
        raw = zstandard.ZstdDecompressor().decompress(self.f.read(int(self.seek[k, 0])))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != int(self.seek[k, 2]) or len(raw) != int(self.seek[k, 1]):
            raise ValueError(f"the checksum of frame {k} differs")
        return raw

    def read(self, i: int) -> np.ndarray:
        k = int(np.searchsorted(self.first, i, "right")) - 1
        base = int(self.starts[self.first[k]])
        a, b = int(self.starts[i]) - base, int(self.starts[i + 1]) - base
        return np.frombuffer(self.frame(k), f"<u{self.width}")[a:b]

    def all(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start within the file, ids) of each document in order; each frame is decompressed once."""
        for k in range(len(self.seek)):
            ids = np.frombuffer(self.frame(k), f"<u{self.width}")
            base = int(self.starts[self.first[k]])
            for i in range(int(self.first[k]), int(self.first[k + 1])):
                a, b = int(self.starts[i]), int(self.starts[i + 1])
                yield None if self.nulls[i] else int(self.doc_ids[i]), a, ids[a - base : b - base]


def write_token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 1, memory: int = LARGE) -> DataFrame:
    """Writes the ids of all documents, in ascending doc_id order (null first), as one file for each range of ids.

    Rows of one doc_id are ordered by a hash of their text, so that ties and repeated rows have one order and a doc_id
    that many rows share is split over tasks. A null or empty text is the end id alone. Columns other than doc_id and
    text are not read. Returns the manifest (part, path, n_docs, n_tokens, start), `start` being the number of ids in
    all earlier files; an empty table gives an empty manifest. A task that runs again writes the same bytes under
    another temporary name and renames it over the first.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")

    def write(batches):
        enc = encoder(tokenizer, memory)
        end = np.array([end_id], enc.kind).tobytes()
        part = TaskContext.get().partitionId()
        fs, top = uri_fs(folder)
        path = f"{top}/part-{part:06d}.ids.zst"
        temp = f"{path}.{TaskContext.get().taskAttemptId()}"
        writer = out = None
        for pdf in batches:
            if not len(pdf):
                continue
            if writer is None:
                fs.create_dir(top, recursive=True)
                out = fs.open_output_stream(temp)
                writer = FrameWriter(out, enc.width)
            texts = [t if isinstance(t, str) else None for t in pdf["text"]]
            for i, null, packed in zip(pdf["doc_id"].to_numpy(), pdf["no_id"].to_numpy(), enc.encode(texts)):
                writer.add(None if null else int(i), packed + end)
        if writer is not None:
            writer.close()
            out.close()
            fs.move(temp, path)
            yield pd.DataFrame({"part": [part], "name": [f"part-{part:06d}.ids.zst"], "n_docs": [len(writer.ids)], "n_tokens": [sum(writer.sizes)]})

    slim = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("no_id").desc(), F.col("doc_id"), F.xxhash64("text")]
    made = cut(slim.repartitionByRange(parts_of(spark), *order).sortWithinPartitions(*order).mapInPandas(write, "part int, name string, n_docs long, n_tokens long"))
    rows, start = [], 0
    for r in sorted(made.collect()):  # one row for each file
        rows.append((r.part, f"{folder}/{r.name}", r.n_docs, r.n_tokens, start))
        start += r.n_tokens
    return spark.createDataFrame(rows, "part int, path string, n_docs long, n_tokens long, start long")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Reads token files back: doc_id, start, n_tokens, ids_crc32 (of the ids as unsigned 32-bit integers) for each document."""

    def read(batches):
        if _encoders:  # a worker that has written keeps no pieces
            _encoders.clear()
            release()
        for pdf in batches:
            for path, start in zip(pdf["path"], pdf["start"]):
                fs, p = uri_fs(path)
                with fs.open_input_file(p) as f:
                    out = [(i, start + a, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for i, a, ids in TokenFile(f, f.size()).all()]
                    yield pd.DataFrame({"doc_id": pd.array([x[0] for x in out], "Int64"), "start": [x[1] for x in out], "n_tokens": [x[2] for x in out], "ids_crc32": [x[3] for x in out]})

    n = max(1, manifest.count())
    return manifest.repartitionByRange(n, "part").select("path", "start").mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")

"""Packing by concatenate and cut.

Pass 1 tokenizes every document once, writes its ids to the shared folder and
keeps a running count inside each partition.  The partition totals are summed
up to give every partition its place in the one long stream.  Pass 2 cuts the
stream at multiples of the sequence length; a document that crosses a cut
leaves one boundary record per sequence it touches.  Nothing is shuffled: the
only thing that travels is one total per partition.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import settle

#: Texts of these characters are split here; all others go through the tokenizer whole.
PLAIN = r"[\t\n\r\x20-\x7e¡-ɏ]*"
#: The split of the tokenizer file (fixed value).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Chunks and pieces that a worker remembers in one generation, and the letters they have together.
REMEMBERED, LETTERS = 200_000, 4_000_000


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """Little-endian ids of texts by a tokenizer file, remembering what it has met.

    The tokenizer lower-cases, drops white space and then treats every piece
    of its split on its own, and no piece crosses white space; so the ids of a
    chunk between white space can be kept, and those of its pieces.  A full
    generation of them becomes the older one, from which what comes again is
    taken over, so frequent chunks stay.  Only texts whose characters leave no
    doubt about normalisation are split here.
    """

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path("word_bpe_49k.json"))
        self.model = self.tokenizer.model
        self.split = regex.compile(PIECES).findall if path is None else None
        self.plain = regex.compile(PLAIN).fullmatch
        self.letters = _byte_letters()
        self.wide = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65_536 else "<u4")
        self.spelled = [np.array(i, self.wide).tobytes() for i in range(self.tokenizer.get_vocab_size())]
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def _whole(self, piece: str) -> bytes:
        # Printable ASCII stands for itself.
        letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return b"".join([self.spelled[t.id] for t in self.model.tokenize(letters)])

    def _piece(self, piece: str) -> bytes:
        found = self.chunks.get(piece)
        if found is None:
            found = self.older.get(piece)
            self.chunks[piece] = found = self._whole(piece) if found is None else found
            self.held += len(piece)
        return found

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isalpha():
            return self._whole(chunk)
        # Letters and one other character are two pieces.
        pieces = (chunk[:-1], chunk[-1]) if chunk[:-1].isalpha() else self.split(chunk)
        return b"".join(map(self._piece, pieces))

    def _learn(self, chunks: list[str]) -> None:
        new = set(chunks).difference(self.chunks)
        if new and (len(self.chunks) >= REMEMBERED or self.held >= LETTERS):
            self.older, self.chunks, self.held = self.chunks, {}, 0
            new = set(chunks)
        for c in new:
            found = self.older.get(c)
            self.chunks[c] = self._chunk(c) if found is None else found
        self.held += sum(map(len, new))

    def __call__(self, text: str | None) -> bytes:
        text = text or ""
        if self.split is None or "<|" in text or not self.plain(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.wide).tobytes()
        chunks = text.lower().split()
        self._learn(chunks)
        return b"".join(map(self.chunks.__getitem__, chunks))


_ENCODERS: dict[str | None, Encoder] = {}


def encoder(path: str | None) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _tokenize(path: str | None, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        encode, part, start = encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                end = encode.wide.type(end_id).tobytes()
                ids = [encode(t.as_py()) + end for t in b.column(1)]
                n = np.fromiter(map(len, ids), np.int64, len(ids)) // encode.wide.itemsize
                begins = start + np.cumsum(n) - n
                start += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0),
                        pa.array(ids, pa.binary()),
                        pa.array(n),
                        pa.array(np.full(len(ids), part, np.int32)),
                        pa.array(begins),
                    ],
                    names=["_id", "_ids", "_n", "_part", "_begin"],
                )

    return run


def _cut(length: int, width: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                cols: list[list] = [[] for _ in range(8)]
                for doc, raw, n, begin in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    ids = np.frombuffer(raw, f"<u{width}").astype("<u4")
                    done = 0
                    while done < n:
                        place = begin + done
                        take = min(n - done, length - place % length)
                        piece = ids[done : done + take].tobytes()
                        for c, v in zip(
                            cols,
                            (doc, done, take, zlib.crc32(piece), n, place // length, place % length, piece if keep_ids else None),
                            strict=True,
                        ):
                            c.append(v)
                        done += take
                kinds = [batch.schema.field(0).type, *[pa.int64()] * 6, pa.binary()]
                names = ["_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names
                )

    return run


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 2048,
    tokenizer: str | None = None,
    end_id: int = 1,
    keep_ids: bool = False,
) -> DataFrame:
    """Cut the tokens of all documents into sequences of ``length``.

    Returns one row per piece: ``(<id_col>, start, length, ids_crc32,
    doc_tokens, sequence_id, offset)`` and, with ``keep_ids``, ``ids``
    (little-endian unsigned 32-bit).  Every document ends with ``end_id``.
    Only the last sequence can be short.  ``tokenizer`` is a path; by default
    the public 49k word vocabulary.

    Defined cases: null and empty texts are just ``end_id``; null ids and
    repeated rows are packed like any other; an empty table gives an empty
    result; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    tokens = settle(
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(
            _tokenize(tokenizer, end_id), f"_id {kind}, _ids binary, _n long, _part int, _begin long"
        ),
        "pack",
    )
    totals = tokens.groupBy("_part").agg(F.sum("_n").alias("_total"))
    places = settle(
        totals.select(
            "_part", (F.sum("_total").over(Window.orderBy("_part")) - F.col("_total")).alias("_place")
        ),
        "pack-places",
    )
    width = encoder(tokenizer).wide.itemsize
    out = (
        tokens.join(F.broadcast(places), "_part")
        .select("_id", "_ids", "_n", (F.col("_begin") + F.col("_place")).alias("_begin"))
        .mapInArrow(
            _cut(length, width, keep_ids),
            f"_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary",
        )
        .withColumnRenamed("_id", id_col)
    )
    return out if keep_ids else out.drop("ids")

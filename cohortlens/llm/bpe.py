"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches."""

from __future__ import annotations

import base64
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import chunks_of, frugal, ship

#: Entries that a worker remembers of words it has encoded; only speed depends on it.
REMEMBERED = 100_000


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte: itself where printable, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class Bytes:
    """The way back: the bytes of each id, by the byte table reversed over the vocabulary's pieces."""

    def __init__(self, json_path: str, ranks_path: str):
        with open(json_path, "rb") as f:
            vocab = json.load(f)["model"]["vocab"]
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        back = {c: b for b, c in byte_characters().items()}
        #: id -> bytes; the ranks and the library's vocabulary name the same ids
        self.token_bytes = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            raw = bytes(back[c] for c in piece) if all(c in back for c in piece) else piece.encode()
            if raw in ranks and ranks[raw] != i:
                raise ValueError(f"rank file and vocabulary disagree on {piece!r}")
            self.token_bytes[i] = raw

    def decode(self, ids: bytes) -> bytes:
        """The bytes of the ids; characters split over tokens come together again."""
        table = self.token_bytes
        try:
            return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])
        except IndexError:
            raise ValueError("an id is outside the vocabulary") from None


class ByteBPE(Bytes):
    """One vocabulary both ways: the library's byte-level splitter and merges besides."""

    def __init__(self, json_path: str, ranks_path: str):
        from tokenizers import Tokenizer

        super().__init__(json_path, ranks_path)
        tok = Tokenizer.from_file(json_path)
        tok.encode_special_tokens = True
        self.tok, self.split, self.model = tok, tok.pre_tokenizer.pre_tokenize_str, tok.model.tokenize
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        """Ids of a stretch that starts and ends where the splitter always cuts."""
        out = []
        for piece, _ in self.split(word):
            ids = self.pieces.get(piece)
            if ids is None:
                ids = np.array([t.id for t in self.model(piece)], "<u4").tobytes()
                if len(self.pieces) >= REMEMBERED:
                    self.pieces.clear()
                self.pieces[piece] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.

        The splitter always cuts before a single space between two characters that aren't white space, and
        looks no further back than that, so such stretches are encoded one by one and remembered.
        """
        words, out = self.words, []
        parts = text.split(" ")
        begin, last = 0, len(parts) - 1
        for i, p in enumerate(parts):
            if i < last:
                n = parts[i + 1]
                if not p or not n or p[-1].isspace() or n[0].isspace():
                    continue
            w = parts[i] if begin == i else " ".join(parts[begin : i + 1])
            if begin:
                w = " " + w
            ids = words.get(w)
            if ids is None:
                ids = self._word(w)
                if len(words) >= REMEMBERED:
                    words.clear()
                words[w] = ids
            out.append(ids)
            begin = i + 1
        return b"".join(out)

    def offsets(self, ids: bytes, text: str) -> tuple[list[int], list[int]]:
        """First byte of each token, and the character that this byte belongs to."""
        sizes = np.array([len(self.token_bytes[i]) for i in np.frombuffer(ids, "<u4").tolist()], np.int64)
        at = np.concatenate([[0], np.cumsum(sizes)])[:-1].astype(np.int64)
        raw = np.frombuffer(text.encode(), np.uint8)
        of = np.cumsum((raw & 0xC0) != 0x80) - 1
        return at.tolist(), of[at].tolist() if len(at) else []


@lru_cache(maxsize=4)
def load(json_path: str, ranks_path: str) -> ByteBPE:
    return ByteBPE(json_path, ranks_path)


@lru_cache(maxsize=4)
def load_bytes(json_path: str, ranks_path: str) -> Bytes:
    return Bytes(json_path, ranks_path)


def vocabulary_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def _mapped(df: DataFrame, columns: list[str], added: list[tuple[str, T.DataType]], work, drop: list[str] = ()) -> DataFrame:
    """``work(*columns)`` over slices of each Arrow batch; its lists become the added columns, ``drop`` goes."""
    keep = [c for c in df.columns if c not in {n for n, _ in added} and c not in drop]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(n, t) for n, t in added])
    arrow = {T.BinaryType(): pa.binary(), T.LongType(): pa.int64(), T.ArrayType(T.LongType()): pa.list_(pa.int64())}
    kinds = [(n, arrow[t]) for n, t in added]

    def run(batches):
        for b in batches:
            held = [b.column(c).to_pylist() for c in columns]
            for i, j in chunks_of(held[0]):
                made = work(*[x[i:j] for x in held])
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in keep] + [pa.array(v, k) for v, (_, k) in zip(made, kinds, strict=True)],
                    names=[*keep, *[n for n, _ in kinds]],
                )

    ship(df.sparkSession)
    return df.mapInArrow(frugal(run), schema)


def encode(df: DataFrame, text_col: str = "text", ids_col: str = "ids", offsets: bool = False, paths: tuple[str, str] | None = None) -> DataFrame:
    """``df`` with ``ids_col`` (binary, little-endian unsigned 32-bit ids) for each text.

    With ``offsets`` also ``byte_at`` and ``char_at``, the first byte and its character for each token. A null
    text is an empty one. Columns of the added names are replaced. Texts that look like special tokens are
    ordinary text. Whole texts are encoded; work is done in slices of a few MB.
    """
    paths = paths or vocabulary_paths()

    def work(texts):
        bpe = load(*paths)
        ids = [bpe.encode(t or "") for t in texts]
        if not offsets:
            return [ids]
        both = [bpe.offsets(i, t or "") for i, t in zip(ids, texts, strict=True)]
        return [ids, [x for x, _ in both], [y for _, y in both]]

    longs = T.ArrayType(T.LongType())
    added = [(ids_col, T.BinaryType())] + ([("byte_at", longs), ("char_at", longs)] if offsets else [])
    return _mapped(df, [text_col], added, work)


def decode(df: DataFrame, ids_col: str = "ids", out_col: str = "decoded", paths: tuple[str, str] | None = None) -> DataFrame:
    """``df`` with ``out_col`` (binary), the bytes of ``ids_col``; null ids give no bytes, unknown ids an error."""
    paths = paths or vocabulary_paths()
    return _mapped(df, [ids_col], [(out_col, T.BinaryType())], lambda ids: [[load_bytes(*paths).decode(i or b"") for i in ids]])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 and decoded_sha256 of the round trip, and with keep_ids the ids.

    Ids are decoded where they are made: ``decode(encode(df))`` gives the same with twice the Python workers.
    """
    paths = vocabulary_paths()

    def work(texts):
        bpe = load(*paths)
        ids = [bpe.encode(t or "") for t in texts]
        return [ids, [bpe.decode(i) for i in ids]]

    both = _mapped(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), ["text"], [("ids", T.BinaryType()), ("decoded", T.BinaryType())], work, drop=["text"])
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *(["ids"] if keep_ids else []),
    )

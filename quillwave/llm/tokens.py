"""Encoding a corpus with a public byte-level BPE vocabulary.

A sentencepiece BPE model is serialised straight from the vocabulary: every
token's bytes are mapped to printable characters, its piece is scored by its
negative rank, and the normaliser is the identity.  Merging the best-scored
neighbours then is merging by rank, so that the model gives the vocabulary's
own ids.  Texts are cut into pre-tokens, which no merge crosses; decoding maps
the pieces back to bytes.

Tasks keep the ids of pre-tokens they have met in a bounded cache; the model
has the fixed size of the vocabulary and is broadcast.
"""

from __future__ import annotations

import base64
import re
import struct
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabularies are; a parameter of everything below.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokens a task's cache holds before it starts anew.
CACHE_PRETOKENS = 200_000
#: Texts encoded at a time.
PART_ROWS = 500

#: The characters that Unicode calls white space.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _pattern(letter: str, number: str, either: str) -> str:
    """Contractions, then letters, digits, or other marks with a blank before, then blanks."""
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?[^{_SPACE}{either}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


@lru_cache
def splitter() -> Callable[[str], list[str]]:
    """Cuts a text into pre-tokens.

    The standard library's ``re`` is several times as fast as ``regex`` but has
    no Unicode classes: ASCII texts and texts without letters or digits that
    the two see differently go through it, the others through ``regex``.
    """
    import regex

    plain = re.compile(_pattern("[A-Za-z]", "[0-9]", "A-Za-z0-9")).findall
    letters = re.compile(_pattern(r"[^\W\d_]", r"\d", r"\w").replace(rf"[^{_SPACE}\w]+", rf"(?:[^{_SPACE}\w]|_)+")).findall
    full = regex.compile(_pattern(r"\p{L}", r"\p{N}", r"\p{L}\p{N}")).findall
    word, digit = re.compile(r"[^\W\d_]"), re.compile(r"\d")
    differs = []
    for i in range(0x80, 0x110000):
        c = chr(i)
        kind = unicodedata.category(c)
        if bool(word.match(c)) != (kind[0] == "L") or bool(digit.match(c)) != (kind[0] == "N"):
            differs.append(i)
    ranges, start = [], None
    for i, code in enumerate(differs):
        start = code if start is None else start
        if i + 1 == len(differs) or differs[i + 1] != code + 1:
            ranges.append(f"{re.escape(chr(start))}-{re.escape(chr(code))}")
            start = None
    odd = re.compile(f"[{''.join(ranges)}]").search

    def split(text: str) -> list[str]:
        if text.isascii():
            return plain(text)
        return full(text) if odd(text) else letters(text)

    return split


@lru_cache
def byte_characters() -> dict[int, str]:
    """A printable character for each byte: itself where it is one, else the next free from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Token bytes to id of a vocabulary file with one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protocol buffer field: bytes with their length, integers as varints, floats as 4 bytes."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def build_model(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece BPE model of a vocabulary whose ids are 0 to n - 1; id n is unknown."""
    order = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in order] != list(range(len(order))):
        raise ValueError("the vocabulary's ranks have gaps")
    chars, n = byte_characters(), len(order)
    normal_piece, unknown_piece, bpe = 1, 2, 2
    pieces = [_field(1, _field(1, "".join(map(chars.__getitem__, t)).encode()) + _field(2, -float(r)) + _field(3, normal_piece)) for t, r in order]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown_piece)))
    none = -1  # no begin, end or padding piece
    trainer = _field(3, bpe) + _field(4, n + 1) + _field(40, n) + _field(41, none) + _field(42, none) + _field(43, none)
    # identity: no dummy prefix, blanks neither removed nor escaped
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class Encoder(dict):
    """Pre-token to its ids as little-endian int32 bytes; computed when missing."""

    def __init__(self, model: bytes, limit: int = CACHE_PRETOKENS):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.unknown, self.limit, self.split = self.model.unk_id(), limit, splitter()
        self.chars = str.maketrans(byte_characters())

    def __missing__(self, pretoken: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        ids = np.asarray(self.model.encode(pretoken.encode().decode("latin-1").translate(self.chars), out_type=int), "<i4")
        if self.unknown in ids:
            raise ValueError("the vocabulary lacks a byte")
        found = self[pretoken] = ids.tobytes()
        return found

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.split(text)))


@lru_cache(maxsize=2)
def _encoder(model: bytes) -> Encoder:
    return Encoder(model)


def encode_texts(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, ids: str = "ids") -> DataFrame:
    """(key, ids): each text's token ids, whole.

    NULL and empty texts give the empty list.  Strings of special tokens are
    ordinary text.  Repeated rows and NULL keys come out as they went in; an
    empty table gives an empty result; further columns are ignored.
    """
    return _encoded(df, key, text, vocabulary, ids, False)


def count_tokens(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, name: str = "n_tokens") -> DataFrame:
    """(key, n_tokens) with the length of what ``encode_texts`` gives."""
    return _encoded(df, key, text, vocabulary, name, True)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows, so that long texts don't add up in memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, PART_ROWS):
            yield batch.slice(at, PART_ROWS)


def _encoded(df: DataFrame, key: str, text: str, vocabulary: str, name: str, lengths: bool) -> DataFrame:
    model = df.sparkSession.sparkContext.broadcast(build_model(load_ranks(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(model.value).encode
        for batch in _parts(batches):
            coded = [encode(t) if t else b"" for t in batch.column(1).to_pylist()]
            sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
            if lengths:
                out = pa.array(sizes)
            else:
                flat = pa.Array.from_buffers(pa.int32(), int(sizes.sum()), [None, pa.py_buffer(b"".join(coded))])
                out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), out], [key, name])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, `{name}` {'long' if lengths else 'array<int>'}")


def decode_ids(df: DataFrame, key: str, ids: str = "ids", vocabulary: str = VOCABULARY, text: str = "text") -> DataFrame:
    """(key, text): the inverse of ``encode_texts``; a NULL list gives NULL, the empty list the empty text."""
    model = df.sparkSession.sparkContext.broadcast(build_model(load_ranks(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _encoder(model.value).model
        bytes_of = {ord(c): b for b, c in byte_characters().items()}
        for batch in _parts(batches):
            texts = [None if x is None else bytes(bytes_of[ord(c)] for c in "".join(pieces.id_to_piece(x))).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, text])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(ids)).mapInArrow(run, f"`{key}` {kind}, `{text}` string")

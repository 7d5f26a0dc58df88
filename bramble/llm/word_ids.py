"""Token ids of whole texts by a public tokenizer whose tokens never cross white space.

A batch of texts is cut at ASCII white space, and, for a tokenizer of a known form, into the pieces that its merges work on;
this is done with numpy over the bytes. Distinct pieces are found by Arrow, encoded by the tokenizers library, with a bounded
cache in the Python worker, and the ids of the texts are gathered with numpy. Normalisation, pre-tokenisation and merges of
such a tokenizer do not look across white space, so the result equals encoding each whole text.
"""

from __future__ import annotations

import ctypes
import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from bramble.llm.common import worker_cache

#: Pieces that a worker keeps in each of two generations, of at most LONGEST characters: some 50 MB in all.
KEPT, LONGEST = 120_000, 48
#: Bytes of text that are handled at a time inside a task, and rows of an Arrow batch.
SLICE_BYTES, BATCH_ROWS = 3_000_000, 1_000
# Fixed values of the format of a tokenizer whose words can be handed to its merges directly.
PLAIN_NORMALIZER = ["NFC", "Replace", "Lowercase"]
PLAIN_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
# Characters on which Python and the library agree about case, letters and composition.
_plain_word = re.compile("[!-~¡-¬®-±´-¸º»¿-įı-ſ]*")
_pieces = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|[^\W_]|(?:[^\w\s]|_)+")
# What a byte of UTF-8 is: white space, part of a letter, a digit, another sign; ODD bytes leave their word uncut. Letters are
# those of ASCII and of Latin-1, whose first byte is 0xC3; 0x97 and 0xB7 are its two signs that are no letters.
SPACE, LETTER, DIGIT, SIGN, ODD = range(5)


def _byte_kinds() -> tuple[np.ndarray, np.ndarray]:
    """The kind of each byte, and each byte in lower case (in words without ODD bytes)."""
    kind, lower = np.full(256, ODD, dtype=np.uint8), np.arange(256, dtype=np.uint8)
    kind[33:127] = SIGN
    kind[[32, *range(9, 14)]] = SPACE
    kind[48:58] = DIGIT
    kind[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3]] = LETTER
    kind[[ord("'"), ord("<"), 0x97, 0xB7]] = ODD
    lower[65:91] += 32
    lower[0x80:0x9F] += 32
    return kind, lower


_KIND, _LOWER = _byte_kinds()


def _byte_symbols() -> dict[int, str]:
    """The symbol of each byte in byte-level vocabularies: printable bytes stand for themselves, others follow from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """A tokenizer of the library with a cache of pieces. Plain pieces go straight to the merges, others through encode."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps, splits = (spec.get("normalizer") or {}).get("normalizers", []), (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.plain = (
            [n["type"] for n in steps] == PLAIN_NORMALIZER
            and [p["type"] for p in splits] == ["Split", "ByteLevel"]
            and splits[0]["pattern"] == {"Regex": PLAIN_PATTERN}
            and not splits[1]["use_regex"]
            and not splits[1]["add_prefix_space"]
            and spec["model"]["type"] == "BPE"
            and not spec["model"]["dropout"]
        )
        self.merge = self.tokenizer.model.tokenize
        self.symbols = _byte_symbols()
        # pieces met since the last change of generation, and those of the generation before
        self.now: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        symbols = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.symbols)
        return array("I", [t.id for t in self.merge(symbols)]).tobytes()

    def _word(self, word: str) -> bytes:
        if self.plain and "<|" not in word and _plain_word.fullmatch(word):
            return b"".join([self._piece(p) for p in _pieces.findall(word.lower())])
        return np.asarray(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, pieces: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each piece: a plain one (a run of letters, a digit, a run of signs) or a whole word."""
        out = [*map(self.now.get, pieces)]
        for i, found in enumerate(out):
            if found is None:
                piece = pieces[i]
                found = self.before.get(piece)
                if found is None:
                    found = self._piece(piece) if self.plain and piece.isalpha() and piece.islower() and _plain_word.fullmatch(piece) else self._word(piece)
                out[i] = found
                if len(piece) <= LONGEST:
                    if len(self.now) >= KEPT:
                        self.before, self.now = self.now, {}
                    self.now[piece] = found
        return out


def encoder_of(path: str) -> Encoder:
    kept = worker_cache("word_ids")
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def pieces_in(texts: pa.Array, cut: bool) -> tuple[pa.Array, np.ndarray]:
    """(pieces of all texts, pieces of each text): the words between white space; if cut, each word of LETTER, DIGIT and SIGN
    bytes as its lower-case runs of letters, digits and runs of signs, and other words as they stand."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
    offsets = offsets - offsets[0]
    kind = _KIND[raw]
    held = kind != SPACE
    begins = held.copy()
    begins[1:] &= ~held[:-1]
    inner = offsets[:-1][offsets[:-1] < len(raw)]
    begins[inner] |= held[inner]
    if cut and len(raw):
        starts = np.flatnonzero(begins)
        whole = np.unique(np.searchsorted(starts, np.flatnonzero(kind == ODD), side="right") - 1)
        edge = np.zeros(len(raw) + 1, dtype=np.int8)
        edge[starts[whole]] += 1
        edge[np.append(starts, len(raw))[whole + 1]] -= 1
        free = np.cumsum(edge[:-1], dtype=np.int8) == 0
        raw = np.where(free, _LOWER[raw], raw)
        parts = kind == DIGIT
        parts[1:] |= kind[1:] != kind[:-1]
        begins |= parts & free & held
    at = np.flatnonzero(begins)
    packed = raw[held]
    ends = np.append(np.flatnonzero(begins[held]), len(packed)).astype(np.int64)
    pieces = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(packed)])
    return pieces, np.diff(np.searchsorted(at, offsets))


def small_batches(spark) -> None:
    """Arrow batches of few rows: whole texts are long, and a worker holds one batch at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def trim() -> None:
    """Hand freed memory of a worker back to the system: workers are kept between tasks, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def gather(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each range, one range after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(total, dtype=np.int64)


def encode_texts(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n_ids of each text, all ids as '<u4'); a null text is empty."""
    encoder = encoder_of(path)
    pieces, n = pieces_in(pc.fill_null(texts.cast(pa.large_string()), ""), encoder.plain)
    coded = pieces.dictionary_encode()
    blobs = encoder.encode(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
    sizes = np.fromiter(map(len, blobs), dtype=np.int64, count=len(blobs)) // 4
    pool = np.frombuffer(b"".join(blobs), dtype="<u4")
    starts = np.cumsum(sizes) - sizes
    index = coded.indices.to_numpy(zero_copy_only=False)
    per_piece = sizes[index] if len(index) else np.zeros(0, dtype=np.int64)
    ids = pool[gather(starts[index] if len(index) else per_piece, per_piece)]
    ends = np.concatenate([[0], np.cumsum(per_piece)])
    upto = np.concatenate([[0], np.cumsum(n)])
    return np.diff(ends[upto]), ids


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES):
    """The batch in runs of rows that hold about `most` bytes of text each (one long text may exceed it)."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        done = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, done + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def encode_batches(path: str, batches, text: str = "text", end_id: int | None = None):
    """(batch slice, n_ids of each row, ids with end_id after each text) of an iterator of Arrow batches."""
    for batch in batches:
        for part in slices(batch, text):
            n, ids = encode_texts(path, part.column(text))
            if end_id is not None:
                ids = np.insert(ids, np.cumsum(n), np.uint32(end_id)).astype("<u4", copy=False)
                n = n + 1
            yield part, n, ids
    trim()

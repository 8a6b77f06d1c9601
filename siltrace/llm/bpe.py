"""Byte-pair encoding by a priority queue of merge ranks over a doubly linked symbol list, and decoding.

Vocabulary files are those of the ``tokenizers`` library (model BPE with an end-of-word suffix, split pattern and byte-level
symbols); their path is a parameter and every executor must have the file there.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from unicodedata import is_normalized, normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltrace.llm.kernels import CHUNK, chunks, text_bytes, tidied

REMEMBERED_BYTES = 64 << 20  # of stretches of text whose ids a Python worker remembers in each of two generations, and as much for pieces that are no words
LONGEST_REMEMBERED = 48  # characters; longer ones are encoded anew each time
PLACE_BITS = 13  # of a queue's entries: with the ranks of usual files they stay below 2**30, whose arithmetic is quickest

# The settings of a vocabulary file under which this encoder equals the library.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = {"behavior": "Removed", "invert": True}
BYTE_LEVEL = {"add_prefix_space": False, "use_regex": False}
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
ADDED = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}


def _byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte: itself where printable in Latin-1, else 256, 257, ..."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in plain else next(rest)) for b in range(256)}


def _refuse_other_settings(spec: dict) -> None:
    """ValueError unless the file's normaliser, pieces, model and added tokens are of the kind that is encoded here."""

    def has(found, wanted: dict, what: str) -> None:
        for key, value in wanted.items():
            if (found or {}).get(key) != value:
                raise ValueError(f"vocabulary file with another {what}: {key} is {(found or {}).get(key)!r}, not {value!r}")

    has(spec.get("normalizer"), {"type": "Sequence", "normalizers": NORMALIZER}, "normaliser")
    has(spec.get("pre_tokenizer"), {"type": "Sequence"}, "split")
    kinds = spec["pre_tokenizer"]["pretokenizers"]
    if [k["type"] for k in kinds] != ["Split", "ByteLevel"] or "Regex" not in kinds[0]["pattern"]:
        raise ValueError("vocabulary file with another split than one pattern and byte-level symbols")
    has(kinds[0], SPLIT, "split")
    has(kinds[1], BYTE_LEVEL, "byte level")
    has(spec["model"], MODEL, "model")
    has(spec, {"decoder": None}, "decoder")
    for token in spec["added_tokens"]:
        has(token, ADDED, "added token")


class Bpe:
    """Encoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _refuse_other_settings(spec)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        pairs = [m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]]
        v = self.vocab
        # A symbol is its id as little-endian int32: one object for each, so that lookups compare by identity.
        code = {i: i.to_bytes(4, "little") for i in v.values()}
        self.merges = [(code[v[a]], code[v[b]]) for a, b in pairs]
        self.made = [code[v[a + b]] for a, b in pairs]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        longest = sorted(self.added, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, longest))) if longest else None
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.space = regex.compile(r"\s+")
        symbols = _byte_symbols()
        self.first = [code[v[symbols[b]]] for b in range(256)]
        self.last = [code[v[symbols[b] + self.suffix]] for b in range(256)]
        self.odd_space = regex.compile(r"[\x1c-\x1f]")  # white space to str.split() alone
        self.short, self.long = _Ranks(self, PLACE_BITS), None
        self.words, self.stretches = _Remembered(self.merged), _Remembered(self.stretch)

    @staticmethod
    def normalized(text: str) -> str:
        """Composed and lowered; the white space that the vocabulary's rules collapse has been split away before."""
        if text.isascii():
            return text.lower()
        if not is_normalized("NFC", text):
            text = normalize("NFC", text)
        # Letters are lowered one by one: the sigma that ends a word is no exception.
        return text.replace("Σ", "σ").lower()

    def merged(self, piece: str) -> bytes:
        """Ids of one piece: the lowest-ranked pair merges first, the leftmost among equals."""
        data = piece.encode("utf-8")
        n = len(data)
        if n == 1:
            return self.last[data[0]]
        ranks = self.short
        if n >> PLACE_BITS:
            ranks = self.long = self.long or _Ranks(self, 40)
        shift, none, made, follow, first, starts = ranks.shift, ranks.none, self.made, ranks.follow, self.first, ranks.starts
        ids = [first[b] for b in data]
        ids[-1] = self.last[data[-1]]
        after = [starts[b] for b in data]
        # An entry is a rank above the place of the left symbol; pair[i] is the entry of the symbol at i with its right one.
        pair = [a.get(b, none) | i for i, (a, b) in enumerate(zip(after, ids[1:]))]  # noqa: B905
        queue = [entry for entry in pair if entry < none]
        heapify(queue)
        ids.append(b"")  # follows no symbol
        pair += (none, none)
        left, right, last = list(range(-1, n)), list(range(1, n + 1)), (1 << shift) - 1
        while queue:
            entry = heappop(queue)
            i = entry & last
            if pair[i] != entry:
                continue  # stale: one of the two symbols has merged since
            j, rank = right[i], entry >> shift
            ids[i], after[i] = now, pairs = made[rank], follow[rank]
            ids[j], pair[j] = b"", none
            right[i] = k = right[j]
            left[k] = i
            pair[i] = entry = pairs.get(ids[k], none) | i
            if entry < none:
                heappush(queue, entry)
            h = left[i]
            if h >= 0:
                pair[h] = entry = after[h].get(now, none) | h
                if entry < none:
                    heappush(queue, entry)
        return b"".join(ids)

    def piece(self, text: str) -> bytes:
        """Ids of one piece of normalised text: letters that normalising leaves as they are are remembered as a stretch."""
        if text.isalpha() and (text.isascii() or self.normalized(text) == text):
            return self.stretches[text]
        return self.words[text]

    def stretch(self, text: str) -> bytes:
        plain = self.normalized(text)
        if plain.isalpha():  # letters alone are one piece
            return self.merged(plain) if plain == text else self.piece(plain)
        return b"".join(map(self.piece, self.split.findall(plain)))

    def encode_plain(self, text: str) -> bytes:
        """Ids, as little-endian int32, of a text without special tokens.

        Pieces never cross white space, and neither normalisation nor lower-casing does, so each stretch between white
        space is encoded by itself and remembered.
        """
        between = self.space.split(text) if self.odd_space.search(text) else text.split()
        return b"".join(map(self.stretches.__getitem__, between))

    def encode(self, text: str) -> bytes:
        if not self.special or "<" not in text:
            return self.encode_plain(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [self.encode_plain(text[at : m.start()]), np.int32(self.added[m[0]]).tobytes()]
            at = m.end()
        return b"".join([*out, self.encode_plain(text[at:])])


class _Ranks:
    """Entries of the queue, but for their place of ``shift`` bits, by left and right symbol; ``none`` is above all of them.

    starts: of the symbol of each byte, follow: of what each merge makes, the entries by right symbol.
    """

    def __init__(self, bpe: Bpe, shift: int):
        by_left: dict[bytes, dict[bytes, int]] = {}
        for rank, (a, b) in enumerate(bpe.merges):
            by_left.setdefault(a, {})[b] = rank << shift
        self.shift, self.none, nothing = shift, len(bpe.merges) << shift, {}
        self.starts = [by_left.get(a, nothing) for a in bpe.first]
        self.follow = [by_left.get(a, nothing) for a in bpe.made]


class _Remembered(dict):
    """Results of a function by its argument, in two generations of ``REMEMBERED_BYTES``: when the younger is full it becomes
    the older, from which what is still in use comes back.  Forgetting costs time only."""

    def __init__(self, function):
        super().__init__()
        self.function, self.older, self.held = function, {}, 0

    def __missing__(self, key):
        ids = self.older.get(key)
        if ids is None:
            ids = self.function(key)
        if len(key) <= LONGEST_REMEMBERED:
            self.held += 240 + len(ids)
            if self.held > REMEMBERED_BYTES:
                self.older, self.held = dict(self), 240 + len(ids)
                self.clear()
            self[key] = ids
        return ids


class Decoder:
    """Vocabulary strings by id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        names = {i: s for s, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.strings = pa.array([names.get(i) for i in range(max(names) + 1)], pa.string())

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Vocabulary strings one after another, with a space between as the file names no decoder."""
        flat = pc.take(self.strings, ids.flatten())
        offsets = pc.subtract(ids.offsets, ids.offsets[0])
        return pc.binary_join(pa.ListArray.from_arrays(offsets, flat), " ")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(path)


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def bpe_encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every text, one row for each input row.

    Null and empty texts have no ids; strings of special tokens become those tokens, as in the library's default.  Texts of
    any length are encoded whole.  Repeated rows are encoded one by one; other columns are not read.  A vocabulary file whose settings differ from those encoded here is refused (ValueError).
    """

    load(path)  # another kind of file is refused before any task starts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for lo, hi in chunks(text_bytes(batch.column(1))[1]):
                part = batch.slice(lo, hi - lo)
                blobs = [bpe.encode(t) if t else b"" for t in part.column(1).to_pylist()]
                offsets = np.cumsum([0, *map(len, blobs)]) // 4
                flat = np.frombuffer(b"".join(blobs), np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["doc_id", "ids"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(tidied(run), "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded string) from (doc_id, ids); null ids decode to the empty string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = decoder(path)
        for batch in batches:
            for lo, hi in chunks(np.cumsum([0, *pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy()]), CHUNK):
                part = batch.slice(lo, hi - lo)
                ids = pc.fill_null(part.column(1), pa.scalar([], pa.list_(pa.int32())))
                texts = bpe.decode(ids)
                yield pa.RecordBatch.from_arrays([*part.columns, texts], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(tidied(run), "doc_id long, ids array<int>, decoded string")


def bpe_digests(decoded: DataFrame) -> DataFrame:
    """The digest columns of the query from ids and decoded texts."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

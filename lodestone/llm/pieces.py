"""SentencePiece encoding and decoding with merge-type vocabularies.

Adjacent symbols that join to a piece wait in an agenda ordered by score, then
by place; the best pair is joined and its new neighbours enter the agenda. A
text is first cut where no piece of the vocabulary can cross (before a run of
spaces, around line ends), and each distinct unit is worked out once, by an
agenda of its own. The distinct units of every Arrow batch are then encoded by
the sentencepiece library too, and any difference stops the job.

Rows: a null text is an empty one and has no ids; texts of any length are taken
whole; repeated rows give repeated results; an empty table gives an empty
result; other columns of the input don't matter.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from heapq import heappop as pop, heappush as push
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import give_back, only_model, ship, tokenizer_bytes

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Units that are checked in one text.
GROUP = 256
#: Distinct units and their characters that a worker remembers; characters encoded at a time.
CACHE_UNITS, CACHE_CHARS, CHUNK_CHARS = 300_000, 8_000_000, 500_000


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        elif tag & 7 == 2:
            size = varint()
            at += size
            yield tag >> 3, data[at - size : at]
        else:
            size = 4 if tag & 7 == 5 else 8
            at += size
            yield tag >> 3, data[at - size : at]


class Numbers(dict):
    """Numbers for units; those that are asked for the first time gather in ``fresh``."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, unit: str) -> int:
        self.fresh.append(unit)
        n = self[unit] = len(self)
        return n


class Pieces:
    """A merge-type vocabulary: encodes and decodes without the library."""

    def __init__(self, data: bytes, check: bool = True, cache: int = CACHE_UNITS):
        """``cache``: distinct units after which it starts to remember them anew."""
        self.cache = cache
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict = {}
        normal: dict = {}
        for n, value in fields(data):
            if n == 1:
                p = dict(fields(value))
                self.pieces.append((p[1].decode(), struct.unpack("<f", p.get(2, b"\0\0\0\0"))[0], p.get(3, NORMAL)))
            elif n == 2:
                trainer = dict(fields(value))
            elif n == 3:
                normal = dict(fields(value))
        if trainer.get(3, 1) != 2 or normal.get(2) or normal.get(4, 1) or not normal.get(5, 1) or trainer.get(24, 0):
            raise ValueError("only merge-type vocabularies without normalisation rules are supported")
        if any(kind in (USER_DEFINED, UNUSED) for _, _, kind in self.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.prefix = SPACE if normal.get(3, 1) else ""
        self.known = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind == NORMAL}
        self.rank = {p: -self.pieces[i][1] for p, i in self.known.items()}
        self.unknown = next(i for i, (_, _, kind) in enumerate(self.pieces) if kind == UNKNOWN)
        byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self.byte = [byte[b] for b in range(256)] if len(byte) == 256 else None
        self.value = {i: b for b, i in byte.items()}
        inside = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.known)
        line = any("\n" in p and len(p) > 1 for p in self.known)
        self.unit = None if inside else re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+" if line else f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
        self.names = [str(i) for i in range(len(self.pieces))]
        # A byte below 128 is a character, whatever stands around it.
        self.text = [chr(self.value[i]) if self.value.get(i, 128) < 128 else p for i, (p, _, _) in enumerate(self.pieces)]
        self.special = frozenset(i for i, (_, _, kind) in enumerate(self.pieces) if kind != NORMAL and self.value.get(i, 128) >= 128)
        self.odd = np.zeros(len(self.pieces), bool)
        self.odd[list(self.special)] = True
        self.forget()
        self.library = None
        self.checked: set[int] = set()
        if check:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_proto=data)

    def forget(self) -> None:
        """Starts to remember units anew: their numbers, and by number where their ids begin and how many they are. What was known so far is kept until the next time."""
        self.old = (self.number, self.flat, self.start, self.size) if hasattr(self, "number") else (Numbers(), *[np.zeros(0, np.int64)] * 3)
        self.number = Numbers()
        self.flat, self.start, self.size = (np.zeros(0, t) for t in (np.int32, np.int64, np.int64))
        self.chars = 0

    def spell(self, symbol: str) -> list[int]:
        """The ids of a symbol that is no piece: its bytes, or the unknown piece."""
        return [self.unknown] if self.byte is None else [self.byte[b] for b in symbol.encode()]

    def merge(self, text: str) -> list[str]:
        """The symbols of a text when no pair is left to join.

        A symbol stands where its first character does, and what it has taken in leaves empty places behind it.
        """
        rank, n = self.rank.get, len(text)
        symbols = [*text, ""]
        # (rank of the score, place, joined symbol): the best score first, of equals the leftmost pair.
        agenda = []
        for i in range(n - 1):
            pair = text[i : i + 2]
            r = rank(pair)
            if r is not None:
                agenda.append((r, i, pair))
        heapq.heapify(agenda)
        while agenda:
            _, left, joined = pop(agenda)
            own = symbols[left]
            right = left + len(own)
            # An entry is stale if its first symbol is gone, or either symbol has grown since.
            if own + symbols[right] != joined:
                continue
            symbols[left], symbols[right] = joined, ""
            beyond = symbols[left + len(joined)]
            if beyond:
                r = rank(joined + beyond)
                if r is not None:
                    push(agenda, (r, left, joined + beyond))
            near = left - 1
            while near >= 0 and not symbols[near]:  # no further than the longest piece
                near -= 1
            if near >= 0:
                pair = symbols[near] + joined
                r = rank(pair)
                if r is not None:
                    push(agenda, (r, near, pair))
        return list(filter(None, symbols))

    def unit_ids(self, unit: str) -> list[int]:
        known = self.known
        if unit in known:
            return [known[unit]]
        ids: list[int] = []
        for s in self.merge(unit):
            if s in known:
                ids.append(known[s])
            else:
                ids += self.spell(s)
        return ids

    def decode_unit(self, ids: list[int]) -> str:
        """Pieces with the space mark still in; runs of byte pieces become their characters."""
        out, run = [], bytearray()
        for i in ids:
            if i in self.value:
                run.append(self.value[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            piece, _, kind = self.pieces[i]
            out.append(" ⁇ " if kind == UNKNOWN else "" if kind == CONTROL else piece)
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self.decode_unit(ids)
        if self.prefix and text.startswith(SPACE):
            text = text[1:]
        return text.replace(SPACE, " ")

    def units(self, text: str) -> list[str]:
        if not text:
            return []
        text = self.prefix + text.replace(" ", SPACE)
        return [text] if self.unit is None else self.unit.findall(text)

    def encode(self, text: str) -> list[int]:
        return [i for u in self.units(text) for i in self.unit_ids(u)]

    def learn(self, units: list[str]) -> None:
        """Works out and remembers new units, numbered as they come."""
        number, ids, begin, many = self.old
        found, new = [], []
        for u in units:
            if u in number:  # it was held against the library before
                k = number[u]
                found.append(ids[begin[k] : begin[k] + many[k]].tolist())
            else:
                new.append(len(found))
                found.append(self.unit_ids(u))
        flat = np.fromiter(chain.from_iterable(found), np.int64)
        size = np.fromiter(map(len, found), np.int64, len(found))
        own = np.fromiter(chain.from_iterable(found[k] for k in new), np.int64)
        self.compare([units[k] for k in new], own, size[new])
        start = self.flat.size + np.cumsum(size) - size
        self.flat = np.concatenate([self.flat, flat.astype(np.int32)])
        self.start, self.size = np.concatenate([self.start, start]), np.concatenate([self.size, size])
        self.chars += sum(map(len, units))

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.number) > self.cache or self.chars > CACHE_CHARS:
            self.forget()
        self.number.fresh = []
        get = self.number.__getitem__
        cut = [np.fromiter(map(get, u), np.int64, len(u)) for u in map(self.units, texts)]
        if self.number.fresh:
            self.learn(self.number.fresh)
        units = np.concatenate(cut) if cut else np.zeros(0, np.int64)
        size = self.size[units]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.start[units] - ends + size, size) + np.arange(int(size.sum()))]
        last = np.cumsum([len(c) for c in cut])
        return np.split(ids, np.r_[0, ends][last][:-1])

    def joined(self, ids: np.ndarray) -> str:
        """Decimal ids with commas between."""
        return ",".join(map(self.names.__getitem__, ids.tolist()))

    def back(self, ids: np.ndarray) -> str:
        """The text that ids decode to."""
        if self.odd[ids].any():
            return self.decode(ids.tolist())
        text = "".join(map(self.text.__getitem__, ids.tolist()))
        return (text[1:] if self.prefix and text.startswith(SPACE) else text).replace(SPACE, " ")

    def compare(self, units: list[str], flat: np.ndarray, size: np.ndarray) -> None:
        """Holds the ids of a batch's units, and what they decode to, against the library's, in one call a batch."""
        if self.library is None or not units:
            return
        ends = np.cumsum(size)
        if self.unit is None:
            texts = [u[len(self.prefix) :] for u in units]
            if self.library.encode(texts, num_threads=1) != [x.tolist() for x in np.split(flat, ends[:-1])]:
                raise AssertionError("ids differ from the library's")
            return
        first, line = np.array(self.unit_ids(self.prefix + "a")), np.array(self.unit_ids("\n"))
        # Some units to a line of text: long texts take the library much longer.
        before = np.full(len(units), line.size)
        before[::GROUP] += first.size
        begins = np.cumsum(before + size) - before - size
        ours = np.empty(int((before + size).sum()), np.int64)
        starts = (begins[::GROUP, None] + np.arange(first.size)).ravel()
        lines = ((begins + before - line.size)[:, None] + np.arange(line.size)).ravel()
        own = np.ones(ours.size, bool)
        own[starts] = own[lines] = False
        ours[starts], ours[lines], ours[own] = np.tile(first, -(-len(units) // GROUP)), np.tile(line, len(units)), flat
        texts = ["\n".join(["a", *units[i : i + GROUP]]) for i in range(0, len(units), GROUP)]
        theirs = np.concatenate(self.library.encode(texts, num_threads=1, return_type="numpy"))
        if not np.array_equal(ours, theirs):
            raise AssertionError("ids differ from the library's")
        # Decoding plain pieces is joining them: each is held against the library once, units with other pieces as they are.
        plain = [i for i in np.unique(flat).tolist() if i not in self.special and i not in self.checked]
        parts = [([i], self.text[i].replace(SPACE, " ")) for i in plain]
        special = np.unique(np.searchsorted(ends, np.flatnonzero(self.odd[flat]), side="right"))
        parts += [(x, self.decode_unit(x).replace(SPACE, " ")) for x in (flat[ends[k] - size[k] : ends[k]].tolist() for k in special.tolist())]
        joined = [*first.tolist(), *(i for got, _ in parts for i in (*line.tolist(), *got))]
        if self.library.decode(joined) != "\n".join(["a", *(t for _, t in parts)]):
            raise AssertionError("the decoded text differs from the library's")
        self.checked.update(plain)


def held(data: bytes, check: bool = True, cache: int = CACHE_UNITS) -> Pieces:
    """A vocabulary with what it has worked out so far."""
    return only_model(f"pieces {check} {cache}", data, lambda: Pieces(data, check, cache))


def batches_of(batch: pa.Array, most: int = CHUNK_CHARS) -> Iterator[list[str]]:
    texts, size = [], 0
    for x in batch:
        t = x.as_py() or ""
        texts.append(t)
        size += len(t)
        if size >= most:
            yield texts
            texts, size = [], 0
    if texts:
        yield texts


def encoded(text: Column, spark, tokenizer_path: str | None = None, check: bool = True, ids: bool = True, decoded: bool = True, cache: int = CACHE_UNITS) -> Column:
    """A struct for each text: n_tokens, ids_sha256 and decoded_sha256, made where the ids are; and the ids and decoded text where wanted."""
    data = ship(spark).sparkContext.broadcast(tokenizer_bytes("piece_bpe_32k.model", tokenizer_path))
    fields = {"n_tokens": ("bigint", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}
    if ids:
        fields["ids"] = "array<int>", pa.list_(pa.int32())
    if decoded:
        fields["decoded"] = "string", pa.string()

    @F.arrow_udf(f"struct<{','.join(f'{n}:{t}' for n, (t, _) in fields.items())}>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = held(data.value, check, cache)
        sha = hashlib.sha256
        for batch in batches:
            got: dict[str, list] = {n: [] for n in fields}
            for part in batches_of(batch):
                for own in pieces.encode_batch(part):
                    back = pieces.back(own)
                    got["n_tokens"].append(own.size)
                    got["ids_sha256"].append(sha(pieces.joined(own).encode()).hexdigest())
                    got["decoded_sha256"].append(sha(back.encode()).hexdigest())
                    if ids:
                        got["ids"].append(own)
                    if decoded:
                        got["decoded"].append(back)
            out = pa.StructArray.from_arrays([pa.array(got[n], t) for n, (_, t) in fields.items()], list(fields))
            del got
            give_back()  # what a batch took would else stay beside the next one's
            yield out
        give_back()

    return encode(text)


def encode_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, ids, decoded: one row for each row of ``docs``."""
    e = docs.select(F.col(id_col).alias("doc_id"), encoded(F.col(text_col), docs.sparkSession, tokenizer_path).alias("e"))
    return e.select("doc_id", "e.ids", "e.decoded")


def encode_with_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, cache: int = CACHE_UNITS) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256, decoded_sha256: one row for each row of ``docs``."""
    e = docs.select(F.col(id_col).alias("doc_id"), encoded(F.col(text_col), docs.sparkSession, tokenizer_path, decoded=False, cache=cache).alias("e"))
    return e.select("doc_id", "e.n_tokens", "e.ids", "e.ids_sha256", "e.decoded_sha256")


def piece_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: one row for each row of ``docs``."""
    e = docs.select(F.col(id_col).alias("doc_id"), encoded(F.col(text_col), docs.sparkSession, tokenizer_path, ids=False, decoded=False).alias("e"))
    return e.select("doc_id", "e.*")

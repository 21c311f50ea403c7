"""Token counts by rank-synchronous merging over ragged numpy arrays.

The distinct pre-tokens of a batch lie one after another in flat arrays. Each
round looks up the rank of every adjacent pair, takes the lowest rank of each
sequence, and joins that pair everywhere in its sequence at once. A pair that
a join makes always ranks after it, so this gives what merging one pair at a
time gives. What is left of a sequence is its token count. A sequence of over
``LONG`` bytes goes through the same rounds alone, with its pairs filed by
rank, so that a round only looks at what it joins and its neighbours.

Rows: null and empty texts count 0 tokens and 0 bytes; texts of any length are
taken whole; repeated rows give repeated results; an empty table gives an
empty result; other columns of the input don't matter.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import give_back, only_model, ship, tokenizer_bytes
from lodestone.llm.merging import NONE, PairTable

#: How byte-level tokenizers cut text before merging.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_TOKENS, CACHE_CHARS, CHUNK_CHARS = 400_000, 48, 2_000_000
#: Rounds over all of a sequence take time by its length squared.
LONG = 1024
#: Characters that PLAIN classes as the pattern above does, and the same pattern for them in the faster re module.
BEYOND = re.compile("[^\0-\u024f\u200b-\u2027\u2030-\u205e\u20a0-\u20bf]")
_SPACE, _LETTER, _NUMBER = " \t-\r\x85\xa0", "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe"
PLAIN = re.compile(f" ?[{_LETTER}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
STRUCT = "struct<n_bytes:bigint,n_tokens:bigint>"


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {b: chr(b) for b in plain}
    for b in range(256):
        shown.setdefault(b, chr(256 + len(shown) - len(plain)))
    return shown


class Merger:
    """A byte-level BPE vocabulary as sorted arrays."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.first = np.array([vocab[c] for _, c in sorted(byte_letters().items())], dtype=np.int64)
        self.base = np.int64(max(vocab.values()) + 1)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocab[a] * int(self.base) + vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.table = PairTable(int(self.base), keys, np.arange(keys.size), made)
        self.specials = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.split_special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        self.pattern = regex.compile(PRETOKEN)
        self.alike: dict[str, bool] = {}
        self.library = None
        self.cache: dict[str, int] = {}

    def count_long(self, word: bytes) -> int:
        """How many tokens one long byte string merges to."""
        ids = self.first[np.frombuffer(word, dtype=np.uint8)]
        n = ids.size
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        alive, rank, made = np.ones(n, bool), np.full(n, NONE), np.zeros(n, np.int64)
        filed: dict[int, list[np.ndarray]] = {}
        agenda: list[int] = []

        def look(at: np.ndarray) -> None:
            """Ranks the pairs that begin at these places, and files them."""
            at = at[after[at] < n]
            slot = self.table.find(ids[at], ids[after[at]])
            rank[at], made[at] = self.table.rank[slot], self.table.made[slot]
            at = at[rank[at] < NONE]
            order = at[np.argsort(rank[at], kind="stable")]
            own = rank[order]
            cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if own.size else np.zeros(0, np.int64)
            for r, part in zip(own[cuts].tolist(), np.split(order, cuts[1:]), strict=False):
                if r not in filed:
                    filed[r] = []
                    heapq.heappush(agenda, r)
                filed[r].append(part)

        look(np.arange(n))
        while agenda:
            r = heapq.heappop(agenda)
            at = np.unique(np.concatenate(filed.pop(r)))
            at = at[alive[at] & (rank[at] == r)]
            if not at.size:
                continue
            # Of pairs that overlap, as in "aaa", every other one from the left.
            begin = np.flatnonzero(np.r_[True, after[at[:-1]] != at[1:]])
            run = np.repeat(begin, np.diff(np.r_[begin, at.size]))
            at = at[(np.arange(at.size) - run) % 2 == 0]
            gone = after[at]
            ids[at] = made[at]
            alive[gone], rank[gone], rank[at] = False, NONE, NONE
            after[at] = after[gone]
            inner = at[after[at] < n]
            before[after[inner]] = inner
            left = before[at]
            left = left[left >= 0]
            rank[left] = NONE
            look(np.unique(np.r_[left, at]))
        return int(alive.sum())

    def counts(self, words: list[bytes]) -> np.ndarray:
        """How many tokens each byte string merges to."""
        out = np.zeros(len(words), dtype=np.int64)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        for i in np.flatnonzero(sizes > LONG).tolist():
            out[i] = self.count_long(words[i])
        short = np.flatnonzero(sizes <= LONG)
        ids = self.first[np.frombuffer(b"".join(words[i] for i in short.tolist()), dtype=np.uint8)]
        who = np.repeat(short, sizes[short])
        while ids.size:
            at = self.table.find(ids[:-1], ids[1:])
            rank = np.where(who[:-1] == who[1:], self.table.rank[at], NONE)
            rank = np.append(rank, NONE)  # the last symbol starts no pair
            starts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
            lengths = np.diff(np.r_[starts, who.size])
            least = np.minimum.reduceat(rank, starts)
            ended = least == NONE
            out[who[starts[ended]]] = lengths[ended]
            hit = np.flatnonzero((rank == np.repeat(least, lengths)) & (rank < NONE))
            if not hit.size:
                break
            # Of pairs that overlap, as in "aaa", every other one from the left.
            run = np.cumsum(np.r_[True, np.diff(hit) != 1]) - 1
            begin = np.flatnonzero(np.r_[True, np.diff(hit) != 1])
            hit = hit[(np.arange(hit.size) - begin[run]) % 2 == 0]
            ids[hit] = self.table.made[at[hit]]
            keep = np.repeat(~ended, lengths)
            keep[hit + 1] = False
            ids, who = ids[keep], who[keep]
        return out

    def pretokens(self, text: str) -> list[str]:
        """The library's own cut: by the pattern, or by the library itself where
        the text holds characters that its Unicode version classes otherwise."""
        if BEYOND.search(text) is None:
            return PLAIN.findall(text)
        if all(map(self._same, set(text))):
            return self.pattern.findall(text)
        return [text[a:b] for _, (a, b) in self._pre().pre_tokenize_str(text)]

    def _pre(self):
        if self.library is None:
            from tokenizers.pre_tokenizers import ByteLevel

            self.library = ByteLevel(add_prefix_space=False, use_regex=True)
        return self.library

    def _same(self, c: str) -> bool:
        if c not in self.alike:
            self.alike[c] = all([x for _, x in self._pre().pre_tokenize_str(s)] == [m.span() for m in self.pattern.finditer(s)] for s in (f"a{c}1", f" {c}{c}a"))
        return self.alike[c]

    def count_texts(self, texts: list[str]) -> list[int]:
        fixed, lists = [], []
        for text in texts:
            special, parts = 0, [text]
            if self.split_special is not None and any(s in text for s in self.specials):
                parts = self.split_special.split(text)
                special = len(parts) - 1
            tokens = self.pretokens(parts[0]) if len(parts) == 1 else [t for p in parts for t in self.pretokens(p)]
            fixed.append(special)
            lists.append(tokens)
        known = self.cache
        new = list(set().union(*lists).difference(known)) if lists else []
        if new:
            known.update(zip(new, self.counts([w.encode() for w in new]).tolist(), strict=True))
        found = [n + sum(map(known.__getitem__, tokens)) for n, tokens in zip(fixed, lists, strict=True)]
        for w in new:
            if len(w) > CACHE_CHARS:
                del known[w]
        if len(known) > CACHE_TOKENS:
            known.clear()
        return found


def chunks(texts: Iterator[str], most: int = CHUNK_CHARS) -> Iterator[list[str]]:
    """Consecutive texts, some millions of characters at a time; one text at least."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def token_counts(text: Column, spark, tokenizer_path: str | None = None) -> Column:
    """A struct (n_bytes, n_tokens) for each text."""
    data = ship(spark).sparkContext.broadcast(tokenizer_bytes("byte_bpe_50k.json", tokenizer_path))

    @F.arrow_udf(STRUCT)
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        merger = only_model("tokens", data.value, lambda: Merger(data.value))
        for batch in batches:
            texts = (x.as_py() or "" for x in batch)
            n = [v for part in chunks(texts) for v in merger.count_texts(part)]
            size = pc.fill_null(pc.binary_length(batch), 0).cast(pa.int64())
            yield pa.StructArray.from_arrays([size, pa.array(n, pa.int64())], ["n_bytes", "n_tokens"])
        give_back()

    return count(text)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row for each row of ``docs``."""
    counted = docs.select(F.col(id_col).alias("doc_id"), token_counts(F.col(text_col), docs.sparkSession, tokenizer_path).alias("c"))
    return counted.select("doc_id", "c.n_bytes", "c.n_tokens", (F.col("c.n_tokens") > limit).alias("over_limit"))

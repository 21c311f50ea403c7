"""Chat formatting at the level of tokens.

Every turn becomes an opening reserved id, the ids of its text and a closing
reserved id; the ids also tell the role. Texts are encoded on their own, by a
byte-level vocabulary that knows no special tokens, so that no text can yield
a reserved id. The loss mask is a prefix sum over +1 where an assistant's text
begins and -1 where it ends. When ids are shown as text, reserved ids show as
control strings; control strings that a text holds itself get a backslash
after their first character (one more where backslashes stand there already),
which is undone when the text is read back.

A conversation is never gathered: formatting works row by row, and what is
read back passes one sorted stream that holds one turn at a time. A digest of
a whole conversation depends on its turns in order, so the turns of one
conversation pass one task, whatever their number, without being held there.

Rows: a null text or role counts as an empty one; rows without a conv_id are
one conversation, whose id stays null; rows without a turn come first; rows of
equal turn go by role, then text; repeated rows are turns of their own; an
empty table gives the added conversations only; texts are taken whole; other
columns don't matter.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import only_model, ship, tokenizer_bytes

#: Opening and closing control strings by role; any other role is spelt out between the first two of OTHER.
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER = ("[ROLE]", "[SAYS]", "[/ROLE]")
CONTROL = [*(m for pair in MARKS.values() for m in pair), *OTHER]
_ANY = "|".join(f"{re.escape(c[0])}\\\\*{re.escape(c[1:])}" for c in CONTROL)
_ESCAPED = "|".join(f"{re.escape(c[0])}\\\\+{re.escape(c[1:])}" for c in CONTROL)
ANY, ESCAPED = re.compile(_ANY), re.compile(_ESCAPED)
#: Longer texts are encoded in parts of about so many characters, cut where the vocabulary's pattern cuts whatever stands around.
PART_CHARS = 1_000_000
#: Between a letter or digit and a space that one letter follows, the pattern always cuts.
SAFE_CUT = re.compile(r"(?<=[A-Za-z0-9])(?= [A-Za-z])")
FORMATTED = "ids array<int>, mask array<int>"


def escape(text: str) -> str:
    return ANY.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


class Template:
    """Turns to ids and masks, and back."""

    def __init__(self, ranks: bytes, loss_roles: tuple[str, ...] = ("assistant",)):
        import public_tokenizers
        import tiktoken

        vocab = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.codec = tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab, special_tokens={})
        self.first = max(vocab.values()) + 1
        self.id = {c: self.first + i for i, c in enumerate(CONTROL)}
        self.opens = {self.id[a]: (role, self.id[b]) for role, (a, b) in MARKS.items()}
        self.loss_roles = frozenset(loss_roles)

    def segment(self, text: str) -> list[int]:
        """The ids of an escaped text, which are those of the text as a whole; none is reserved."""
        ids: list[int] = []
        begin = 0
        while len(text) - begin > PART_CHARS:
            cut = SAFE_CUT.search(text, begin + PART_CHARS)
            if cut is None:
                break
            ids += self.codec.encode_ordinary(text[begin : cut.start()])
            begin = cut.start()
        return ids + self.codec.encode_ordinary(text[begin:]) if ids else self.codec.encode_ordinary(text)

    def format(self, roles: list[str], texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The ids and the loss mask of every turn of a batch."""
        parts: list[list[int]] = []
        ends: list[int] = []  # parts up to the end of each turn
        weigh: list[int] = []  # of each part, whether it is under the loss
        for role, text in zip(roles, texts, strict=True):
            body, loss = self.segment(escape(text)), int(role in self.loss_roles)
            if role in MARKS:
                a, b = MARKS[role]
                parts += [[self.id[a]], body, [self.id[b]]]
                weigh += [0, loss, 0]
            else:
                a, b, c = OTHER
                parts += [[self.id[a]], self.segment(escape(role)), [self.id[b]], body, [self.id[c]]]
                weigh += [0, 0, 0, loss, 0]
            ends.append(len(parts))
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        at = np.r_[0, np.cumsum(sizes)]
        flat = np.fromiter(chain.from_iterable(parts), np.int32, int(at[-1]))
        step = np.zeros(flat.size + 1, np.int32)
        own = np.flatnonzero(weigh)
        np.add.at(step, at[own], 1)
        np.add.at(step, at[own + 1], -1)
        mask = np.cumsum(step)[:-1].astype(np.int32)
        cut = at[ends][:-1]
        return np.split(flat, cut), np.split(mask, cut)

    def decode(self, ids: list[int]) -> str:
        return self.codec.decode_bytes(ids).decode()

    def show(self, ids: list[int]) -> str:
        """The formatted text of ids."""
        out, plain = [], []
        for i in ids:
            if i >= self.first:
                out += [self.decode(plain), CONTROL[i - self.first]]
                plain = []
            else:
                plain.append(i)
        return "".join([*out, self.decode(plain)])

    def turn(self, ids: np.ndarray, mask: np.ndarray) -> tuple[str, str, str | None, int]:
        """(role, text, text under the mask, formatted length) of the ids of a turn; null under the mask if that is the text itself."""
        opened, closed = int(ids[0]), int(ids[-1])
        if closed != (self.opens[opened][1] if opened in self.opens else self.id[OTHER[2]]):
            raise ValueError("a turn doesn't end as it began")
        if opened in self.opens:
            role, begin = self.opens[opened][0], 1
            size = sum(map(len, MARKS[role]))
        else:
            begin = int(np.flatnonzero(ids == self.id[OTHER[1]])[0]) + 1
            named = self.decode(ids[1 : begin - 1].tolist())
            role, size = unescape(named), sum(map(len, OTHER)) + len(named)
        shown = self.decode(ids[begin:-1].tolist())
        text = unescape(shown)
        under = mask.astype(bool)
        if not under.any():
            loss = ""
        elif under[begin:-1].all() and not under[:begin].any() and not under[-1]:
            loss = None
        else:
            loss = unescape(self.show(ids[under].tolist()))
        return role, text, loss, size + len(shown)


def _template(ranks: bytes) -> Template:
    return only_model("chat", ranks, lambda: Template(ranks))


def parts_of(batch: pa.RecordBatch, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold some millions of bytes each, one row at least."""
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0)))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + most)))
        yield batch.slice(a, b - a)
        a = b


def format_turns(turns: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """conv_id, turn, ids, mask: one row for each row of ``turns`` (conv_id, turn, role, text).

    The tokens of a conversation are those of its turns in order.
    """
    data = ship(turns.sparkSession).sparkContext.broadcast(tokenizer_bytes("byte_bpe_50k.tiktoken", tokenizer_path))
    kinds = {n: turns.schema[n].dataType.simpleString() for n in ("conv_id", "turn")}

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = _template(data.value)
        for whole in batches:
            for b in parts_of(whole):
                ids, mask = template.format(*([x or "" for x in b.column(c).to_pylist()] for c in ("role", "text")))
                yield pa.record_batch([b.column("conv_id"), b.column("turn"), pa.array(ids, pa.list_(pa.int32())), pa.array(mask, pa.list_(pa.int32()))], names=["conv_id", "turn", "ids", "mask"])

    text = [F.col(c).cast("string").alias(c) for c in ("role", "text")]
    return turns.select("conv_id", "turn", *text).mapInArrow(make, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, {FORMATTED}")


def read_turns(formatted: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """conv_id, turn, role, text, loss, chars: what the ids and masks of turns say. A null ``loss`` stands for the text itself, which moves only once."""
    data = ship(formatted.sparkSession).sparkContext.broadcast(tokenizer_bytes("byte_bpe_50k.tiktoken", tokenizer_path))
    kinds = {n: formatted.schema[n].dataType.simpleString() for n in ("conv_id", "turn")}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = _template(data.value)
        for b in batches:
            ids, mask = (b.column(c).flatten().to_numpy() for c in ("ids", "mask"))
            ends = np.cumsum(b.column("ids").value_lengths().to_numpy())
            got = list(map(template.turn, np.split(ids, ends[:-1]), np.split(mask, ends[:-1]))) if ends.size else []
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
            cols = [pa.array([g[k] for g in got], t) for k, t in enumerate(kinds)]
            yield pa.record_batch([b.column("conv_id"), b.column("turn"), *cols], names=["conv_id", "turn", "role", "text", "loss", "chars"])

    out = f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, text string, loss string, chars bigint"
    return formatted.select("conv_id", "turn", "ids", "mask").mapInArrow(read, out)


DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the conversations of a sorted stream; holds a turn at a time."""
    fields = [f.split() for f in DIGESTS.split(", ")]
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    done: list[tuple] = []
    conv: object = _digest  # no conversation yet
    n = loss_chars = chars = 0
    turns, loss = hashlib.sha256(), hashlib.sha256()

    def flush() -> pa.RecordBatch:
        return pa.record_batch([pa.array([d[k] for d in done], kinds[f[1]]) for k, f in enumerate(fields)], names=[f[0] for f in fields])

    for b in batches:
        cols = [b.column(c) for c in ("conv_id", "role", "text", "loss", "chars")]
        for row in zip(*cols, strict=True):
            c, role, text, under, size = (x.as_py() for x in row)
            if c != conv:
                if conv is not _digest:
                    done.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                conv, n, loss_chars, chars, turns, loss = c, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            n += 1
            turns.update(f"{role}\n{text}\n".encode())
            under = text if under is None else under
            loss.update(under.encode())
            loss_chars += len(under)
            chars += size
        if len(done) >= 1000:
            yield flush()
            done.clear()
    if conv is not _digest:
        done.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
    yield flush()


def chat_digests(turns: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: read back from the formatted turns."""
    plain = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    back = read_turns(format_turns(plain, tokenizer_path), tokenizer_path)
    return back.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_digest, DIGESTS)

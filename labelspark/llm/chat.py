r"""Chat formatting by columnar byte assembly.

A turn becomes `<|im_start|>role`, a newline, the text, `<|im_end|>` and a
newline. In texts and roles every `<`, some `\`, `|` gets one more `\` after
the `<`, so no text can hold a control string; a role's newline and its own
escape sign are written as two characters. Both are undone exactly.

For a batch of turns the lengths of all pieces, their cumulative offsets and
the places of escapes are computed in numpy, and headers and contents are
copied into one buffer that becomes an Arrow array without another copy.

A conversation comes out in parts, in order and of bounded size, so that one of
any length needs no more memory than a batch of turns.

Defined results: a null text or role is empty; turns are ordered by turn (null
first), ties by role, then text; repeated rows are repeated turns; rows with a
null conv_id are one conversation; an empty table gives an empty table; columns
beside conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark.llm.common import bound_batches, partitions

START, END = b"<|im_start|>", b"<|im_end|>\n"
#: Roles whose texts are learnt.
LEARNT = ("assistant",)
_CONTROL, _ESCAPED = re.compile(rb"<(\\*)\|"), re.compile(rb"<\\(\\*)\|")


def escape(text: bytes) -> bytes:
    return _CONTROL.sub(rb"<\\\1|", text)


def unescape(text: bytes) -> bytes:
    return _ESCAPED.sub(rb"<\1|", text) if b"<\\" in text else text


def escape_role(role: bytes) -> bytes:
    return escape(role.replace(b"%", b"%25").replace(b"\n", b"%0A"))


def unescape_role(role: bytes) -> bytes:
    return unescape(role).replace(b"%0A", b"\n").replace(b"%25", b"%")


def _control_places(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where a `<` begins `<`, some backslashes, `|` inside one text; data holds the texts one after another."""
    bars = np.flatnonzero(data == 0x7C)
    back = bars - 1
    behind = np.flatnonzero((back >= 0) & (data[np.maximum(back, 0)] == 0x5C))
    if len(behind):
        slashes = np.flatnonzero(data == 0x5C)
        runs = slashes[np.r_[True, np.diff(slashes) > 1]]
        back[behind] = runs[np.searchsorted(runs, back[behind], side="right") - 1] - 1
    hit = (back >= 0) & (data[np.maximum(back, 0)] == 0x3C)
    at, bars = back[hit], bars[hit]
    return at[np.searchsorted(ends, at, side="right") == np.searchsorted(ends, bars, side="right")]


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All indices of the ranges, one after another."""
    total = int(lengths.sum())
    out = np.ones(total, np.int64)
    some = lengths > 0
    s, n = starts[some], lengths[some]
    if not total:
        return out
    first = np.cumsum(n) - n
    out[first] = s - np.r_[0, s[:-1] + n[:-1] - 1]
    return np.cumsum(out)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all turns, the end of each turn, and the start and end of each escaped text. Both arrays are large_binary without nulls."""
    coded = roles.dictionary_encode()
    headers = [START + escape_role(x.as_buffer().to_pybytes()) + b"\n" for x in coded.dictionary]
    table = np.frombuffer(b"".join(headers) + END, np.uint8)
    sizes = np.array([len(h) for h in headers], np.int64)
    begins = np.cumsum(sizes) - sizes
    which = coded.indices.to_numpy()
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    extra = _control_places(data, offsets[1:])
    added = np.searchsorted(extra, offsets)  # escapes before each text
    plain = np.diff(offsets)
    length = plain + np.diff(added)
    turn = sizes[which] + length + len(END)
    ends = np.cumsum(turn)
    text_at = ends - len(END) - length
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    # headers and ends are scattered from the table of headers, texts from their own buffer, shifted by the escapes before them
    out[_spread(ends - turn, sizes[which])] = table[_spread(begins[which], sizes[which])]
    for k in range(len(END)):
        out[ends - len(END) + k] = END[k]
    to = np.arange(len(data), dtype=np.int64) + np.repeat(text_at - offsets[:-1], plain)
    if len(extra):
        step = np.zeros(len(data) + 1, np.int64)
        step[extra + 1] = 1
        to += np.cumsum(step)[: len(data)] - np.repeat(added[:-1], plain)
        out[to[extra] + 1] = 0x5C
    out[to] = data
    return out, ends, text_at, text_at + length


_PARTS = "conv_id long, part long, formatted binary, loss array<long>"


def _format(learnt: tuple[bytes, ...]):
    def run(batches):
        at, part = object(), 0
        for b in batches:
            if not b.num_rows:
                continue
            roles, texts = b.column(1).cast(pa.large_binary()), b.column(2).cast(pa.large_binary())
            data, ends, text_starts, text_ends = assemble(roles, texts)
            counted = np.array([r.as_buffer().to_pybytes() in learnt for r in roles])
            ids = b.column(0).to_pylist()
            cuts = [0, *[k for k in range(1, len(ids)) if ids[k] != ids[k - 1]], len(ids)]
            bounds = np.r_[0, ends][cuts]
            loss, conv, parts = [], [], []
            for i, j, origin in zip(cuts, cuts[1:], bounds, strict=False):
                part = part + 1 if ids[i] == at and at is not None or ids[i] is None and at is None else 0
                at = ids[i]
                own = np.flatnonzero(counted[i:j]) + i
                loss.append(np.stack([text_starts[own], text_ends[own]], axis=1).ravel() - origin)
                conv.append(at)
                parts.append(part)
            # one buffer holds all turns of the batch; conversations are slices of it
            formatted = pa.Array.from_buffers(pa.binary(), len(conv), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(parts, pa.int64()), formatted, pa.array(loss, pa.list_(pa.int64()))], names=["conv_id", "part", "formatted", "loss"])

    return run


def format_chats(conversations: DataFrame, learnt: tuple[str, ...] = LEARNT) -> DataFrame:
    """(conv_id, part, formatted, loss): loss holds the start and end of each learnt text in the part's bytes. The parts of a conversation follow each other in one partition."""
    spark = conversations.sparkSession
    bound_batches(spark)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary").alias(c) for c in ("role", "text")])
    dealt = rows.repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(_format(tuple(x.encode() for x in learnt)), _PARTS)


def parse(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """Roles and texts of a part."""
    out = []
    for turn in formatted.split(START)[1:]:
        role, _, text = turn.partition(b"\n")
        out.append((unescape_role(role), unescape(text[: -len(END)])))
    return out


def _points(data: bytes) -> int:
    return len(data) - int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) == 0x80))


def _read_back(batches):
    """One row a conversation, from its parts in order."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    state: list | None = None
    for b in batches:
        done = []
        for conv, part, formatted, loss in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
            if part == 0:
                done += [state] if state else []
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            data = formatted.as_buffer().to_pybytes()
            for role, text in parse(data):
                state[1] += 1
                state[2].update(role + b"\n" + text + b"\n")
            for i, j in zip(loss[::2], loss[1::2], strict=True):
                text = unescape(data[i:j])
                state[3] += _points(text)
                state[4].update(text)
            state[5] += _points(data)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[k].hexdigest() if k in (2, 4) else d[k] for d in done], t) for k, t in enumerate(types)], names=names)
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([state[k].hexdigest() if k in (2, 4) else state[k]], t) for k, t in enumerate(types)], names=names)


def chat_report(conversations: DataFrame, learnt: tuple[str, ...] = LEARNT) -> DataFrame:
    """What the formatted conversations hold, read back from their bytes and loss spans."""
    return format_chats(conversations, learnt).mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

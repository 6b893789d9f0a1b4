"""Chat formatting by columnar byte assembly.

Every turn becomes `<|turn|>role<|text|>content<|end|>\\n`. Inside roles and contents each `<` and `[` is followed by an
inserted backslash, so that no control string (those of the template, `</s>`, `[INST]` and the like, all of which begin with
one of the two) can occur in a text; taking out the backslash after each `<` and `[` gives the text back. The
loss mask covers the content of assistant turns.

Rows are sorted by conversation and turn within hash partitions and handled as a stream: for a run of rows numpy computes
segment lengths, cumulative offsets and scatter indices, and copies headers and contents into one preallocated buffer that
becomes an Arrow string column. A conversation longer than a run comes out as several parts in order, so that no
conversation has to fit in memory.

Defined results: null roles and texts count as empty; a null conv_id is a conversation of its own; null turns come first;
turns with equal numbers are ordered by role and text and all kept; an empty table gives an empty table; only the four named
columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_row, slices, text_buffers

TURN, TEXT, END = b"<|turn|>", b"<|text|>", b"<|end|>\n"
ESCAPED = np.zeros(256, bool)
ESCAPED[[0x3C, 0x5B]] = True
BACKSLASH = 0x5C
PARTS = "conv_id long, part long, formatted string, mask_start array<long>, mask_end array<long>"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Write each row of data to out from at, with a backslash after each escaped byte; the rows' written lengths."""
    marks = ESCAPED[data]
    before = np.cumsum(marks) - marks
    row = np.repeat(np.arange(len(at)), np.diff(offsets))
    head = before[np.minimum(offsets[:-1], max(len(data) - 1, 0))] if len(data) else np.zeros(len(at), np.int64)
    to = at[row] + (np.arange(len(data)) - offsets[row]) + (before - head[row])
    out[to] = data
    out[to[marks] + 1] = BACKSLASH
    return np.diff(offsets) + by_row(marks, offsets)


def lengths(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(offsets) + by_row(ESCAPED[data], offsets)


def fixed(out: np.ndarray, at: np.ndarray, piece: bytes) -> None:
    out[at[:, None] + np.arange(len(piece))] = np.frombuffer(piece, np.uint8)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with all turns; the turns' offsets; where contents start and end."""
    rd, ro = text_buffers(roles)
    td, to = text_buffers(texts)
    role_len, text_len = lengths(rd, ro), lengths(td, to)
    total = len(TURN) + role_len + len(TEXT) + text_len + len(END)
    ends = np.cumsum(total)
    at = ends - total
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    fixed(out, at, TURN)
    scatter(out, at + len(TURN), rd, ro)
    mid = at + len(TURN) + role_len
    fixed(out, mid, TEXT)
    body = mid + len(TEXT)
    scatter(out, body, td, to)
    fixed(out, body + text_len, END)
    return out, np.concatenate([[0], ends]).astype(np.int64), body, body + text_len


def code_points(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions within [start of row, ...) to code points: cumulative heads at both ends."""
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return heads[start], heads[end]


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turn rows (conv_id, turn, role, text) to parts of conversations, in order."""
    open_id, number = object(), 0
    for part in slices(batches, 3):
        ids = part.column(0).to_pylist()
        roles = part.column(2)
        data, at, body, stop = assemble(roles, part.column(3))
        n = len(ids)
        cut = [0, *(i for i in range(1, n) if ids[i] != ids[i - 1]), n]
        loss = np.array([r == "assistant" for r in roles.to_pylist()], bool)
        numbers, starts, ends = [], [], []
        for a, b in zip(cut, cut[1:], strict=False):
            number = number + 1 if ids[a] == open_id else 0
            open_id = ids[a]
            numbers.append(number)
            rows = np.flatnonzero(loss[a:b]) + a
            p, q = code_points(data[at[a] : at[b]], body[rows] - at[a], stop[rows] - at[a])
            starts.append(p.tolist())
            ends.append(q.tolist())
        offsets = at[cut].astype(np.int32) if at[-1] < 2**31 else at[cut]
        kind = pa.string() if offsets.dtype == np.int32 else pa.large_string()
        text = pa.Array.from_buffers(kind, len(numbers), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        span = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array([ids[a] for a in cut[:-1]], pa.int64()), pa.array(numbers, pa.int64()), text, pa.array(starts, span), pa.array(ends, span)],
            names=["conv_id", "part", "formatted", "mask_start", "mask_end"],
        )


def unescape(text: str) -> str:
    return text.replace("<\\", "<").replace("[\\", "[")


def turns(formatted: str) -> list[tuple[str, str]]:
    """Read (role, text) back from whole turns."""
    out = []
    for piece in formatted.split(END.decode())[:-1]:
        role, _, text = piece.removeprefix(TURN.decode()).partition(TEXT.decode())
        out.append((unescape(role), unescape(text)))
    return out


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts in order to a row per conversation, read back from the formatted text and the mask."""
    current = None
    names = [x.split()[0] for x in DIGEST.split(", ")]

    def flush(rows: list) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    def row(c: list) -> tuple:
        return (c[0], c[1], c[2].hexdigest(), c[3], c[4].hexdigest(), c[5])

    for batch in batches:
        done = []
        for conv, number, text, start, end in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if number == 0:
                if current:
                    done.append(row(current))
                current = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, said in turns(text):
                current[1] += 1
                current[2].update(f"{role}\n{said}\n".encode())
            for a, b in zip(start, end, strict=True):
                said = unescape(text[a:b])
                current[3] += len(said)
                current[4].update(said.encode())
            current[5] += len(text)
        if done:
            yield flush(done)
    if current:
        yield flush([row(current)])


def format_chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, part, formatted, mask_start, mask_end: parts of a conversation in order; mask spans in code points of the part."""
    rows = rows.selectExpr(f"cast(`{conv}` as long) conv_id", f"cast(`{turn}` as long) turn", f"cast(`{role}` as string) role", f"cast(`{text}` as string) text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(parts, PARTS)


def read_back(formatted: DataFrame) -> DataFrame:
    """A row per conversation of format_chats' result, as it comes (its partitions hold whole conversations in order)."""
    return formatted.mapInArrow(digests, DIGEST)

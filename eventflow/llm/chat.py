"""Chat formatting by columnar byte assembly, with a loss mask, and its exact inverse.

Template: ``<s>`` opens a conversation; then one turn after the other::

    system     <<SYS>>\\n{text}\\n<</SYS>>\\n
    user       [INST] {text} [/INST]
    assistant  {space}{text} </s>                    (under the loss mask: {text})
    other      [ROLE]{role}[TEXT]{text}[/ROLE]

Inside texts and roles a backslash is doubled, and a control string gets a backslash
after its first character, so no control string is left in them and reading back is exact.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventflow.llm.common import text_of

CONTROL = r"(<)(/?s>|</?SYS>>)|(\[)(/?INST\]|/?ROLE\]|TEXT\])"
TURN = re.compile(
    r"<<SYS>>\n(?P<system>.*?)\n<</SYS>>\n|\[INST\] (?P<user>.*?) \[/INST\]| (?P<assistant>.*?) </s>"
    r"|\[ROLE\](?P<role>.*?)\[TEXT\](?P<other>.*?)\[/ROLE\]",
    re.S,
)
ESCAPED = re.compile(r"\\(\\?)")
KINDS = ("system", "user", "assistant")
# What stands before the role, between role and text, and after the text, by kind; the last is for other roles.
BEFORE = (b"<<SYS>>\n", b"[INST] ", b" ", b"[ROLE]")
BETWEEN = (b"", b"", b"", b"[TEXT]")
AFTER = (b"\n<</SYS>>\n", b" [/INST]", b" </s>", b"[/ROLE]")
OPEN = b"<s>"

#: Bytes put together at once, and the most a row of the output holds before a conversation goes on in the next.
SLICE_BYTES = 4 << 20
#: Longer segments are copied by themselves rather than by index.
LONG_SEGMENT = 1 << 16
FORMATTED = "conv_id {kind}, chunk int, text string, loss_start array<int>, loss_end array<int>"


def escape(texts: pa.Array) -> pa.Array:
    texts = pc.replace_substring(texts, "\\", "\\\\")
    return pc.replace_substring_regex(texts, CONTROL, r"\1\3\\\2\4")


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array, and where each text starts, with the end."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8), offsets


def assemble(roles: pa.Array, texts: pa.Array, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The turns' formatted bytes, the offset at which each begins (and the end), and the spans of assistant texts.

    ``opens`` marks the turns that begin a conversation.
    """
    kind = pc.index_in(roles, pa.array(KINDS)).fill_null(len(KINDS)).to_numpy(zero_copy_only=False)
    fixed = [OPEN, *BEFORE, *BETWEEN, *AFTER]
    length = np.array([len(x) for x in fixed])
    place = np.cumsum(length) - length
    pool = np.frombuffer(b"".join(fixed), np.uint8)
    role_bytes, role_at = _buffer(escape(roles))
    text_bytes, text_at = _buffer(escape(texts))
    source = np.concatenate([pool, role_bytes, text_bytes])
    n, other = len(kind), kind == len(KINDS)
    before, between, after = 1 + kind, 1 + len(BEFORE) + kind, 1 + 2 * len(BEFORE) + kind
    # Six segments a turn: opening, header, role, divider, text, end.
    lengths = np.column_stack(
        [opens * len(OPEN), length[before], np.diff(role_at) * other, length[between], np.diff(text_at), length[after]]
    )
    starts = np.column_stack(
        [
            np.zeros(n, np.int64),
            place[before],
            len(pool) + role_at[:-1],
            place[between],
            len(pool) + len(role_bytes) + text_at[:-1],
            place[after],
        ]
    )
    ends = np.cumsum(lengths.reshape(-1))
    at = (ends - lengths.reshape(-1)).reshape(n, -1)
    out = np.empty(int(ends[-1]) if n else 0, np.uint8)
    size, src, dst = lengths.reshape(-1), starts.reshape(-1), at.reshape(-1)
    short = np.flatnonzero(size <= LONG_SEGMENT)
    # The index of each byte within its segment, moved to where the segment is read and written.
    within = np.arange(size[short].sum()) - np.repeat(np.cumsum(size[short]) - size[short], size[short])
    out[within + np.repeat(dst[short], size[short])] = source[within + np.repeat(src[short], size[short])]
    for i in np.flatnonzero(size > LONG_SEGMENT):
        out[dst[i] : dst[i] + size[i]] = source[src[i] : src[i] + size[i]]
    answer = kind == KINDS.index("assistant")
    begin = np.r_[at[:, 0], len(out)]
    return out, begin, np.where(answer, at[:, 4], -1), np.where(answer, at[:, 4] + lengths[:, 4], -1)


def _rows(turns: pa.Table, chunk: int) -> pa.RecordBatch:
    """Whole conversations, or the next chunk of one, as one output row each."""
    turns = turns.combine_chunks()
    keys = turns.column(0).combine_chunks() if turns.column(0).num_chunks != 1 else turns.column(0).chunk(0)
    first = _first(keys)
    number = np.zeros(len(first), np.int32)
    number[:1] = chunk
    opens = np.zeros(len(keys), np.int64)
    opens[first[number == 0]] = 1
    roles, texts = (turns.column(i).combine_chunks() for i in (1, 2))
    out, begin, loss_start, loss_end = assemble(roles, texts, opens)
    offsets = np.r_[begin[first], len(out)].astype(np.int32)
    text = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(out))
    answer = np.flatnonzero(loss_start >= 0)
    row = np.searchsorted(first, answer, side="right") - 1
    list_at = pa.array(np.searchsorted(row, np.arange(len(first) + 1)), pa.int32())
    spans = [pa.ListArray.from_arrays(list_at, pa.array((x[answer] - offsets[row]).astype(np.int32))) for x in (loss_start, loss_end)]
    return pa.RecordBatch.from_arrays(
        [keys.take(pa.array(first)), pa.array(number), text, *spans], ["conv_id", "chunk", "text", "loss_start", "loss_end"]
    )


def _first(keys: pa.Array) -> np.ndarray:
    """Where a new conversation begins; nulls are one conversation."""
    if not len(keys):
        return np.empty(0, np.int64)
    codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])


def format_chat(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Formatted conversations: conv_id, chunk, text, loss_start and loss_end (byte offsets of assistant texts in ``text``).

    Turns stand in order of ``turn_col`` (nulls first; ties by role, then text). Null
    roles and texts count as empty; null conversation ids are one conversation. A
    conversation is one row (chunk 0) unless its turns exceed a few MB: then it goes on in
    chunks 1, 2, .., cut between turns, and memory stays bounded. Repeated turns are kept.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), text_of(role_col).alias("role"), text_of(text_col).alias("text"), F.col(turn_col).alias("turn")
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text").drop("turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chunk = None, 0
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            while held.num_rows:
                sizes = np.cumsum(pc.add(pc.binary_length(held.column(1)), pc.binary_length(held.column(2))).to_numpy())
                first = _first(held.column(0).combine_chunks())
                last = int(first[-1])
                upto = int(np.searchsorted(sizes, SLICE_BYTES, side="right")) or 1
                if upto >= held.num_rows:  # room for more: only what is surely complete goes out
                    upto = last
                elif (whole := first[(first > 0) & (first <= upto)]).size:
                    upto = int(whole[-1])
                if not upto:
                    break
                yield _rows(held.slice(0, upto), chunk)
                # If the cut is inside a conversation, what follows is its next chunk.
                begins = first[first <= upto]
                inside = upto not in first
                chunk = (chunk + 1 if len(begins) == 1 else 1) if inside else 0
                held = held.slice(upto)
        if held is not None and held.num_rows:
            yield _rows(held, chunk)

    kind = turns.schema[conv_col].dataType.simpleString()
    return rows.mapInArrow(run, FORMATTED.format(kind=kind))


def turns_of(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted row."""
    at = len(OPEN) if text.startswith(OPEN.decode()) else 0
    while at < len(text):
        found = TURN.match(text, at)
        if found is None:
            raise ValueError(f"not a turn at {at}")
        kind = found.lastgroup
        role = unescape(found["role"]) if kind == "other" else kind
        yield role, unescape(found[kind])
        at = found.end()


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted rows hold, read back from them: a row per conversation.

    conv_id, n_turns, turns_sha256 (of role, newline, text, newline per turn), loss_chars
    and loss_sha256 (of all unescaped text under the loss mask), formatted_chars.
    """
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_row, done = None, []

        def close() -> None:
            key, n, whole, chars, loss, total = open_row
            done.append((key, n, whole.hexdigest(), chars, loss.hexdigest(), total))

        for batch in batches:
            for row in batch.to_pylist():
                if not row["chunk"]:
                    if open_row:
                        close()
                    open_row = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                data = row["text"].encode()
                for role, text in turns_of(row["text"]):
                    open_row[1] += 1
                    open_row[2].update(f"{role}\n{text}\n".encode())
                for start, end in zip(row["loss_start"], row["loss_end"]):
                    masked = unescape(data[start:end].decode())
                    open_row[3] += len(masked)
                    open_row[4].update(masked.encode())
                open_row[5] += len(row["text"])
            if done:
                yield _digest_rows(done, batch.schema.field(0).type)
                done = []
        if open_row:
            close()
            yield _digest_rows(done, batch.schema.field(0).type)

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return ordered.mapInArrow(
        run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def _digest_rows(rows: list[tuple], key: pa.DataType) -> pa.RecordBatch:
    kinds = (key, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

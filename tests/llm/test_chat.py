"""Formatted conversations read back exactly."""

import hashlib
from collections import defaultdict

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from eventflow.llm import chat

CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[TEXT]", "[/ROLE]", "\\", " ", "\n", "<", "[", "é", "s>", "/"]
TEXTS = st.lists(st.sampled_from(CONTROL), max_size=8).map("".join)
SCHEMA = "conv_id long, turn long, role string, text string, chunk int"


@settings(max_examples=500, deadline=None)
@given(TEXTS)
def test_escape_leaves_no_control_string(text):
    escaped = chat.escape(pa.array([text])).to_pylist()[0]
    assert chat.unescape(escaped) == text
    assert not any(c in escaped for c in CONTROL[:9])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "[TEXT]"]), TEXTS), min_size=1, max_size=6))
def test_turns_read_back(turns):
    roles, texts = zip(*turns)
    table = pa.table({"conv_id": pa.array([1] * len(turns), pa.int64()), "role": pa.array(roles), "text": pa.array(texts)})
    row = chat._rows(table, 0).to_pylist()[0]
    assert list(chat.turns_of(row["text"])) == turns
    data = row["text"].encode()
    masked = [chat.unescape(data[a:b].decode()) for a, b in zip(row["loss_start"], row["loss_end"])]
    assert masked == [t for r, t in turns if r == "assistant"]


def plain(rows):
    by_conv = defaultdict(list)
    for conv, turn, role, text in rows:
        by_conv[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    out = []
    for conv, turns in by_conv.items():
        turns.sort()
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out.append((conv, len(turns), digest(whole), len(loss), digest(loss)))
    return sorted(out, key=repr)


ROWS = [
    *((c, t, ("user", "assistant")[t % 2], f"turn {t} of {c} </s>") for c in range(40) for t in range(c % 7)),
    (100, 1, "assistant", None), (100, 0, None, "no role"), (100, None, "user", ""), (100, 1, "assistant", "tie"), (100, 1, "assistant", "tie"),
    (None, 0, "user", "no id"), (None, 1, "assistant", "none"), (101, 0, "tool", "x" * 100_000), (101, 1, "assistant", "ü" * 70_000),
    *((7777, t, "assistant", f"many {t} " * 5) for t in range(900)),
]


@pytest.mark.parametrize("size", [4 << 20, 3000])
def test_conversations(spark, monkeypatch, size):
    monkeypatch.setattr(chat, "SLICE_BYTES", size)
    turns = spark.createDataFrame([(*r, 9) for r in ROWS], SCHEMA)
    formatted = chat.format_chat(turns)
    rows = formatted.collect()
    if size > 1 << 20:
        assert [r.chunk for r in rows] == [0] * len({r[0] for r in ROWS})
    else:
        assert max(r.chunk for r in rows if r.conv_id == 7777) > 3
    assert all(r.text.startswith("<s>") == (r.chunk == 0) for r in rows)
    got = chat.digests(formatted).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == plain(ROWS)
    assert sum(r.formatted_chars for r in got) == sum(len(r.text) for r in rows)


def test_empty_table(spark):
    formatted = chat.format_chat(spark.createDataFrame([], SCHEMA))
    assert formatted.count() == 0 and chat.digests(formatted).count() == 0

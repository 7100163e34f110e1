"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole. Control strings mark the start of a turn, of its text and
its end; they are special tokens, so no token crosses them. Inside roles and texts every
``<`` that begins a control string gets a tilde, and one that already has tildes gets one
more: escaping is reversible and leaves no control string behind. The rendering is encoded
once with offsets. Turn spans and token spans are both sorted, so binary search finds the
tokens of each assistant text.

Turns are sorted by range over (conversation, turn), so a conversation of any length is
spread over tasks and rendered in segments of whole turns, ``SEGMENT_CHARS`` code points or
one turn each; as tokens never cross a turn, segments are encoded as the whole would be.
Reading back streams the segments of a conversation in order and holds one at a time.

Defined cases: null texts and roles are empty; turns are ordered by number, nulls first,
then role, then text; repeated rows are turns of their own; a null conversation id is a
conversation of its own; turns of any length are rendered whole; other columns are not read;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer
from tokenizers.processors import ByteLevel

from pairloom.llm.common import quoted

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
LOSS_ROLE = "assistant"
SEGMENT_CHARS = 1 << 20
SEGMENTS = "conv_id {key}, part long, turns long, formatted string, ids array<int>, loss_mask binary, loss_starts array<int>, loss_stops array<int>"


def escape(text: str) -> str:
    return re.sub(r"<(~*)\|", r"<\1~|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(~*)~\|", r"<\1|", text)


@lru_cache(4)
def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a file with exact offsets and the control strings as special tokens."""
    own = Tokenizer.from_file(path)
    own.post_processor = ByteLevel(trim_offsets=False)
    own.add_special_tokens([TURN, TEXT, END])
    return own


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The rendering of ``(role, text)`` turns and the sorted spans of its loss texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        parts += [head, body, END]
        if role == LOSS_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def loss_mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """For each token, 1 if it lies in a span; both are sorted and spans do not overlap."""
    mask = np.zeros(len(offsets), np.uint8)
    if len(offsets) and spans:
        first = np.searchsorted(offsets[:, 1], [s for s, _ in spans], "right")
        last = np.searchsorted(offsets[:, 0], [e for _, e in spans], "left")
        for a, b in zip(first.tolist(), last.tolist()):
            mask[a:b] = 1
    return mask


def masked_spans(offsets: np.ndarray, mask: np.ndarray) -> tuple[list[int], list[int]]:
    """Code point spans of the runs of masked tokens, as the tokens' own offsets give them."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask, [0])).astype(np.int8)))
    starts, stops = edges[::2], edges[1::2] - 1
    return offsets[starts, 0].tolist() if len(starts) else [], offsets[stops, 1].tolist() if len(stops) else []


def format_segment(turns: list[tuple[str, str]], path: str) -> dict:
    text, spans = render(turns)
    encoded = tokenizer(path).encode(text, add_special_tokens=False)
    offsets = np.array(encoded.offsets, np.int64).reshape(-1, 2)
    mask = loss_mask(offsets, spans)
    starts, stops = masked_spans(offsets, mask)
    return {
        "turns": len(turns), "formatted": text, "ids": encoded.ids, "loss_mask": mask.tobytes(), "loss_starts": starts, "loss_stops": stops,
    }


def format_conversations(
    df: DataFrame, path: str, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Formatted segments of whole turns, see ``SEGMENTS``; ``part`` orders those of a
    conversation. ``loss_mask`` has one byte for each id; the spans are code points."""
    kind = dict(df.dtypes)[key]
    rows = df.select(
        quoted(key).alias("conv_id"), quoted(turn).alias("turn"),
        *(F.coalesce(quoted(c), F.lit("")).cast("binary").alias(n) for c, n in ((role, "role"), (text, "text"))),
    )
    order = ["conv_id", "turn", "role", "text"]
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = SEGMENTS.format(key=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, state = TaskContext.get().partitionId() << 32, {"conv": None, "turns": [], "chars": 0}
        first = True
        conv_kind = None

        def flush() -> pa.RecordBatch:
            nonlocal part
            made = format_segment(state["turns"], path)
            made = {"conv_id": state["conv"], "part": part, **made}
            part += 1
            state["turns"], state["chars"] = [], 0
            kinds = [conv_kind, pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(made.values(), kinds)], names=list(made))

        for batch in batches:
            conv_kind = batch.schema.field(0).type
            for conv, role_, text_ in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if state["turns"] and (conv != state["conv"] or state["chars"] >= SEGMENT_CHARS):
                    yield flush()
                state["conv"], first = conv, False
                state["turns"].append((role_.decode("utf-8", "replace"), text_.decode("utf-8", "replace")))
                state["chars"] += len(text_)
        if not first and state["turns"]:
            yield flush()

    return sorted_.mapInArrow(run, schema)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The ``(role, text)`` turns of a rendering."""
    turns = []
    for turn in formatted.split(END)[:-1]:
        role, text = turn.removeprefix(TURN).split(TEXT, 1)
        turns.append((unescape(role), unescape(text)))
    return turns


DIGESTS = "conv_id {key}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"


def read_back(segments: DataFrame) -> DataFrame:
    """One row of digests for each conversation, from its segments alone, see ``DIGESTS``."""
    schema = DIGESTS.format(key=dict(segments.dtypes)["conv_id"])
    slim = segments.select("conv_id", "part", "formatted", "loss_starts", "loss_stops", "loss_mask")
    sorted_ = slim.repartition("conv_id").sortWithinPartitions("conv_id", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict | None = None

        def done(kind: pa.DataType) -> pa.RecordBatch:
            values = [
                state["conv"], state["n"], state["all"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["formatted"], state["tokens"], state["n_loss"],
            ]
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], k) for v, k in zip(values, kinds)],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "n_loss_tokens"],
            )

        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, _, formatted, starts, stops, mask in zip(*(c.to_pylist() for c in batch.columns)):
                if state is not None and conv != state["conv"]:
                    yield done(kind)
                    state = None
                if state is None:
                    state = {"conv": conv, "n": 0, "chars": 0, "formatted": 0, "tokens": 0, "n_loss": 0, "all": hashlib.sha256(), "loss": hashlib.sha256()}
                for role, text in parse(formatted):
                    state["n"] += 1
                    state["all"].update(f"{role}\n{text}\n".encode())
                for a, b in zip(starts, stops):
                    loss = unescape(formatted[a:b])
                    state["chars"] += len(loss)
                    state["loss"].update(loss.encode())
                state["formatted"] += len(formatted)
                state["tokens"] += len(mask)
                state["n_loss"] += mask.count(1)
        if state is not None:
            yield done(kind)

    return sorted_.mapInArrow(run, schema)

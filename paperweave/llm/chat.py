r"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with offsets, and the spans of its assistant texts are laid over the sorted
token spans by binary search. The template puts a control token on both sides of every text, so no token reaches over the
edge of a turn:

    <|im_start|>role<|im_sep|>text<|im_end|>  ...

Control strings inside roles and texts are escaped by one more backslash between `<` and `|` (`<|` becomes `<\|`, `<\|`
becomes `<\\|`), which unescape() takes back exactly.

Defined cases: null roles and texts count as empty; a very long conversation is one block of its own; turns are sorted by number, null first, ties by role and text; repeated
rows are turns of their own; a null conv_id is a conversation; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
LEARNED_ROLE = "assistant"
FORMATTED = "conv_id long, formatted string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>"
#: Characters rendered and encoded at a time.
BLOCK = 1 << 20

_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")
_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(SEPARATOR) + "(.*?)" + re.escape(END), re.DOTALL)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The whole conversation and the spans of the texts that are learned."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEPARATOR}", escape(text)
        if role == LEARNED_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """True for the tokens that overlap a span; starts, ends and spans are sorted."""
    out = np.zeros(len(starts), bool)
    if spans:
        a, b = np.array(spans).T
        for lo, hi in zip(np.searchsorted(ends, a, side="right"), np.searchsorted(starts, b, side="left"), strict=True):
            out[lo:hi] = True
    return out


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """Read back from a rendered conversation."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def loss_text(formatted: str, starts: np.ndarray, ends: np.ndarray, loss: np.ndarray) -> str:
    """Read back from the mask: all text under it, each run of tokens unescaped by itself."""
    out, run, at = [], [], 0
    for i in np.flatnonzero(loss):
        if i and not loss[i - 1] and run:
            out.append(unescape("".join(run)))
            run = []
        run.append(formatted[max(at, starts[i]) : max(at, ends[i])])  # tokens of one letter share its offsets
        at = max(at, ends[i])
    return "".join([*out, unescape("".join(run))])


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    t = Tokenizer.from_file(path)
    t.add_special_tokens([START, SEPARATOR, END])
    return t


def _format(path: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode_batch

        def encoded(block: list[tuple]) -> pa.RecordBatch:
            ids, starts, ends, loss = [], [], [], []
            for (_, _, spans), e in zip(block, encode([x[1] for x in block], add_special_tokens=False), strict=True):
                at = np.array(e.offsets, np.int32).reshape(-1, 2)
                ids.append(np.array(e.ids, np.int32))
                starts.append(at[:, 0])
                ends.append(at[:, 1])
                loss.append(mask(at[:, 0], at[:, 1], spans))
            ints = pa.list_(pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in block], pa.int64()), pa.array([x[1] for x in block], pa.string()), pa.array(ids, ints), pa.array(starts, ints), pa.array(ends, ints), pa.array(loss, pa.list_(pa.bool_()))], names=["conv_id", "formatted", "ids", "starts", "ends", "loss"])

        for batch in it:
            block, size = [], 0
            for conv, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text, spans = render([(x["role"] or "", x["text"] or "") for x in turns])
                block.append((conv, text, spans))
                size += len(text)
                if size >= BLOCK:
                    yield encoded(block)
                    block, size = [], 0
            if block:
                yield encoded(block)

    return run


def format_conversations(rows: DataFrame, path: str) -> DataFrame:
    """One row for each conversation, see FORMATTED."""
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return whole.mapInArrow(_format(path), FORMATTED)


def _digest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
    for batch in it:
        rows = []
        for k in range(batch.num_rows):
            conv, formatted = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
            starts, ends, loss = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in (2, 3, 4))
            turns, learned = turns_of(formatted), loss_text(formatted, starts, ends, loss)
            rows.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), sha(learned), len(formatted)))
        if rows:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), taken from the formatted output alone."""
    return formatted.select("conv_id", "formatted", "starts", "ends", "loss").mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

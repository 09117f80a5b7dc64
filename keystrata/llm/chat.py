"""Chat formatting by incremental black-box rendering.

A template is any function from a list of turns to a string. It is never taken apart: the turns' spans are found by
rendering successive prefixes of a conversation and comparing consecutive outputs, and the text's place inside a
turn's span by rendering that turn with other texts. A template that changes what it wrote for earlier turns is
reported (``rewrites``), and no loss is put on such a conversation, since its spans can't be trusted.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.shared import small

Turns = list[tuple[str, str]]

#: Control strings of the default template and what stands for them inside a text.
ESCAPES = {"\\": "\\\\", "###": "\\h", "</turn>": "\\t"}
_CONTROL = re.compile(r"\\|###|</turn>")
_ESCAPED = re.compile(r"\\(\\|h|t|c)")
_PLAIN = {"\\": "\\", "h": "###", "t": "</turn>", "c": ":"}
_TURN = re.compile(r"### ([^:]*): (.*?)</turn>\n", re.DOTALL)


def escape(text: str) -> str:
    """Takes every control string out of a text; ``unescape`` brings it back."""
    return _CONTROL.sub(lambda m: ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _PLAIN[m[1]], text)


@lru_cache(256)
def _line(role: str, text: str) -> str:
    return f"### {escape(role).replace(':', chr(92) + 'c')}: {escape(text)}</turn>\n"


def render_default(turns: Turns) -> str:
    """The default template: ``### Role: text </turn>`` lines with escaped texts."""
    return "".join([_line(role, text) for role, text in turns])


def shared_prefix(a: str, b: str, known: int = 0) -> int:
    """How many characters two strings begin with in common; ``known`` is a guess of how many at least."""
    low, high = (known if a[:known] == b[:known] else 0), min(len(a), len(b))
    step = 16
    while low < high:
        n = min(step, high - low)
        if a[low : low + n] == b[low : low + n]:
            low, step = low + n, step * 2
        elif n == 1:
            break
        else:
            step = n // 2
    return low


def parse_default(formatted: str) -> Turns:
    """Reads turns back from the default template's output."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def locate(render: Callable[[Turns], str], turns: Turns) -> tuple[str, list[tuple[int, int, int, int]], bool]:
    """The rendered conversation, each turn's (start, end, text start, text end), and whether earlier output changed.

    Only a turn's own text is told from its frame: two probes with other texts give the frame's common prefix and suffix.
    """
    spans, before, rewrites = [], render([]), False
    for k, (role, _) in enumerate(turns):
        now = render(turns[: k + 1])
        if not now.startswith(before):
            rewrites = True
            shared = shared_prefix(before, now)
            spans = [(min(a, shared), min(b, shared), min(c, shared), min(d, shared)) for a, b, c, d in spans]
            before = now[:shared]
        one, other = (render([*turns[:k], (role, probe)]) for probe in ("a", "b"))
        head = shared_prefix(one, other, len(before))
        tail = shared_prefix(one[head:][::-1], other[head:][::-1])
        spans.append((len(before), len(now), head, max(head, len(now) - tail)))
        before = now
    return before, spans, rewrites


OUT = "conv_id bigint, formatted string, spans array<struct<role:string,start:int,end:int,text_start:int,text_end:int,loss:boolean>>, rewrites boolean"


def format_chats(conversations: DataFrame, render: Callable[[Turns], str] = render_default, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: the formatted string, its turns' spans (code points) with the loss mask, ``rewrites``.

    Null roles and texts count as empty, a null turn comes first; repeated rows are turns of their own, ties go by
    role, then text; rows without conv_id form one conversation with a null id. A conversation is one string, so its
    turns meet in one row; only that row must fit in memory. Other columns play no part.
    """
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out = []
            for row in batch.to_pylist():
                turns = [(t["role"], t["text"]) for t in row["turns"]]
                formatted, spans, rewrites = locate(render, turns)
                out.append({
                    "conv_id": row["conv_id"], "formatted": formatted, "rewrites": rewrites,
                    "spans": [dict(zip(("role", "start", "end", "text_start", "text_end"), (role, *span), strict=True), loss=role == loss_role and not rewrites) for (role, _), span in zip(turns, spans, strict=True)],
                })
            yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)

    return whole.mapInArrow(apply, OUT)


_SPAN = pa.struct([("role", pa.string()), *((x, pa.int32()) for x in ("start", "end", "text_start", "text_end")), ("loss", pa.bool_())])
_SCHEMA = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("spans", pa.list_(_SPAN)), ("rewrites", pa.bool_())])


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and digests read back from the formatted strings and their loss masks."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out = []
            for row in batch.to_pylist():
                text = row["formatted"]
                turns = parse_default(text)
                loss = "".join(unescape(text[s["text_start"] : s["text_end"]]) for s in row["spans"] if s["loss"])
                sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
                out.append((row["conv_id"], len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text), row["rewrites"]))
            yield pa.RecordBatch.from_arrays([pa.array(x, type=k) for x, k in zip(zip(*out, strict=True) if out else [[]] * 7, _DIGEST, strict=True)], names=_NAMES)

    return formatted.mapInArrow(apply, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, rewrites boolean")


_DIGEST = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
_NAMES = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites"]
#: A conversation that repeats the template's control strings in its texts.
CONTROL_CASE = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]

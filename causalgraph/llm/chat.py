"""Chat formatting by incremental rendering of black-box templates.

A template is any callable from a list of {"role", "text"} to a string.  The prefixes
of a conversation are rendered one after the other, and consecutive outputs compared:
what the longer one has beyond the shorter is the span of its last turn.  Two forms
count as appending: r(k) = r(k-1) + new, and with a constant tail r(k-1) = body + tail,
r(k) = body + new + tail.  A template that does neither has rewritten history at that
turn, and the turn gets no span.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

Template = Callable[[list[dict]], str]

SCHEMA = "conv_id long, turn long, turn_no int, role string, template string, span_start long, span_end long, rendered_chars long, rewrites_history boolean, conversation_rewritten boolean"


def tagged(messages: list[dict]) -> str:
    """Each turn between begin and end marks."""
    return "".join(f"<|im_start|>{m['role']}\n{m['text']}<|im_end|>\n" for m in messages)


def headed(messages: list[dict]) -> str:
    """Headings over the turns between a begin and an end mark of the whole."""
    return "<s>" + "".join(f"### {m['role'].capitalize()}:\n{m['text']}\n\n" for m in messages) + "</s>"


def folded(messages: list[dict]) -> str:
    """System text is folded into the next user turn, which rewrites what a lone system turn rendered."""
    out, held = "<s>", ""
    for m in messages:
        if m["role"] == "system":
            held += f"<<SYS>>{m['text']}<</SYS>>\n"
        elif m["role"] == "user":
            out, held = out + f"[INST] {held}{m['text']} [/INST]", ""
        else:
            out += f" {m['text']} "
    return out + (f"[INST] {held}[/INST]" if held else "")


def trimmed(messages: list[dict]) -> str:
    """Only the last assistant turn keeps its lines; earlier ones are cut to their last line."""
    last = max((i for i, m in enumerate(messages) if m["role"] == "assistant"), default=-1)
    return "".join(f"[{m['role']}]{m['text'].rsplit(chr(10), 1)[-1] if m['role'] == 'assistant' and i != last else m['text']}[/]" for i, m in enumerate(messages))


TEMPLATES: dict[str, Template] = {"tagged": tagged, "headed": headed, "folded": folded, "trimmed": trimmed}


def common_prefix(a: str, b: str) -> int:
    """Length of the longest common prefix, by halving (compares in C)."""
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def spans(template: Template, messages: list[dict]) -> list[tuple[int | None, int | None, int, bool]]:
    """(start, end, length of the prefix's rendering, rewrites) of each turn.

    A start counts characters of the rendering that ends with the turn; where no later
    turn rewrites, it is also the place in the whole rendering.  A turn that begins like
    the tail would seem to start later; so the longest tail that any turn shows counts
    wherever it fits (if all turns begin so, the common beginning passes for the end of
    the turn before).
    """
    outs = [template(messages[:k]) for k in range(2)] if messages else []
    found: list[tuple[int, int, int]] = []  # common prefix, length before, length now; -1: rewritten
    ends: list[tuple[str, str, str]] = []  # the tail, what precedes it, what ends the longer output
    for k in range(1, len(messages) + 1):
        before, now = outs[0], outs[1]
        p = common_prefix(before, now)
        tail = before[p:]
        ok = len(now) >= len(before) and now.endswith(tail)
        found.append((p if ok else -1, len(before), len(now)))
        ends.append((tail, before[max(0, p - 64) : p], now[-len(tail) - 64 :]))
        if k < len(messages):
            outs = [now, template(messages[: k + 1])]
    longest = max((n - p for p, n, _ in found if p >= 0), default=0)
    out: list[tuple[int | None, int | None, int, bool]] = []
    for (p, _, size), (tail, head, end) in zip(found, ends):
        if p < 0:
            out.append((None, None, size, True))
            continue
        more = longest - len(tail)
        if 0 < more <= len(head) and end.endswith(head[len(head) - more :] + tail):
            p, tail = p - more, head[len(head) - more :] + tail
        out.append((p, size - len(tail), size, False))
    return out


def format_spans(conversations: DataFrame, templates: dict[str, Template] | None = None) -> DataFrame:
    """One row for each turn of each conversation and template; see SCHEMA.

    Turns are ordered by (turn, role, text), nulls first; repeated turns are turns of
    their own.  A null text renders as empty, a null role as "unknown"; rows with null
    conv_id form one conversation.  An empty table gives no rows, other columns are
    ignored.  Each conversation is shuffled once and rendered by one task.
    """
    templates = TEMPLATES if templates is None else templates
    turns = F.sort_array(F.collect_list(F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")))).alias("turns")
    grouped = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(turns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            rows = []
            for conv, turns in zip(batch.column("conv_id"), batch.column("turns")):
                conv, turns = conv.as_py(), turns.as_py()
                messages = [{"role": t["role"] if t["role"] is not None else "unknown", "text": t["text"] or ""} for t in turns]
                for name, template in templates.items():
                    found = spans(template, messages)
                    changed = any(f[3] for f in found)
                    rows += [(conv, t["turn"], i, t["role"], name, a, b, n, r, changed) for i, (t, (a, b, n, r)) in enumerate(zip(turns, found))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)], names)

    return grouped.mapInArrow(run, SCHEMA)


def op5_chat_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_spans(table(spark, sf_dir, "conversations"))

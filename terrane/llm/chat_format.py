"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) to a string. Successive turn prefixes are rendered and each
output is compared with the one before: what was appended is the span of the new turn. A template whose longer
output does not begin with the shorter one rewrites history; it is reported, with the first code point that
changed, and the earlier spans are withdrawn. Turns arrive sorted and stream through: a partition never holds more
than one conversation.

Cases. A null text or role counts as empty; turns order by (turn, role, text), nulls first, so repeated turns stay
and order alike; conversations with a null id form one conversation; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm.common import small_batches

#: The control strings of the templates in use.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>")

_ALTERNATIVES = "|".join(f"{re.escape(c[0])}BACK{re.escape(c[1:])}" for c in sorted(CONTROL, key=len, reverse=True))
_PLAIN = re.compile(_ALTERNATIVES.replace("BACK", r"\\*"))
_ESCAPED = re.compile(_ALTERNATIVES.replace("BACK", r"\\+"))

Turns = list[tuple[str, str]]
Template = Callable[[Turns], str]


def escape(text: str) -> str:
    """Control strings get a backslash after their first character, and those that have some get one more."""
    return _PLAIN.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


def _role_out(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def _role_in(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def chatml(turns: Turns) -> str:
    """Marked turns: start marker, role, line end, escaped text, end marker, line end."""
    return "".join(f"<|im_start|>{_role_out(role)}\n{escape(text)}<|im_end|>\n" for role, text in turns)


def read_chatml(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end bound the escaped text."""
    turns, at = [], 0
    while at < len(formatted):
        line = formatted.index("\n", at)
        end = formatted.index("<|im_end|>", line)
        turns.append((_role_in(formatted[at + len("<|im_start|>") : line]), unescape(formatted[line + 1 : end]), line + 1, end))
        at = end + len("<|im_end|>\n")
    return turns


class Incremental:
    """Spans of turns, found from outside the template."""

    def __init__(self, template: Template):
        self.template, self.turns, self.formatted = template, [], ""
        self.spans: list[tuple[int, int] | None] = []
        self.rewrites: list[tuple[int, int]] = []  # (turn, first code point that changed)

    def push(self, role: str, text: str) -> None:
        self.turns.append((role, text))
        now, was = self.template(self.turns), self.formatted
        if now.startswith(was):
            self.spans.append((len(was), len(now)))
        else:
            low, high = 0, min(len(was), len(now))
            while low < high:  # the longest common prefix, by halves
                middle = (low + high + 1) // 2
                low, high = (middle, high) if now.startswith(was[:middle]) else (low, middle - 1)
            self.rewrites.append((len(self.turns) - 1, low))
            self.spans = [s if s and s[1] <= low else None for s in self.spans] + [(low, len(now))]
        self.formatted = now


OUT = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("formatted", pa.string()),
        ("spans", pa.list_(pa.struct([("role", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))),
        ("rewrites_history", pa.bool_()),
        ("first_change", pa.int64()),
    ]
)
OUT_DDL = "conv_id bigint, formatted string, spans array<struct<role: string, start: bigint, end: bigint>>, rewrites_history boolean, first_change bigint"


def _format(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        weight = 0
        state, current = None, object()

        def close() -> None:
            nonlocal weight
            spans = [{"role": r, "start": s[0], "end": s[1]} if s else {"role": r, "start": None, "end": None} for (r, _), s in zip(state.turns, state.spans, strict=True)]
            rows.append(
                {"conv_id": current, "formatted": state.formatted, "spans": spans, "rewrites_history": bool(state.rewrites), "first_change": min((c for _, c in state.rewrites), default=None)}
            )
            weight += len(state.formatted)

        for batch in batches:
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if state is None or conv != current:
                    if state is not None:
                        close()
                        if weight > 4_000_000:
                            yield pa.RecordBatch.from_pylist(rows, schema=OUT)
                            rows, weight = [], 0
                    state, current = Incremental(template), conv
                state.push(role or "", text or "")
        if state is not None:
            close()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=OUT)

    return run


def format_chats(turns: DataFrame, template: Template = chatml) -> DataFrame:
    """One row for each conversation: formatted text, span of each turn, whether the template rewrites history."""
    small_batches(turns.sparkSession)
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), "role", "text", F.col("turn").alias("__turn"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "__turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(_format(template), OUT_DDL)


def loss_spans(formatted: str, spans: list[dict], roles=("assistant",)) -> list[tuple[int, int]]:
    """The escaped texts of the turns to learn from: parts of their spans, without the markers."""
    out = []
    for s in spans:
        if s["role"] in roles and s["start"] is not None:
            _, _, start, end = read_chatml(formatted[s["start"] : s["end"]])[0]
            out.append((s["start"] + start, s["start"] + end))
    return out


DIGEST_DDL = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, rewrites_history boolean"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            text = r["formatted"]
            turns = read_chatml(text)
            loss = [unescape(text[a:b]) for a, b in loss_spans(text, r["spans"])]
            whole = "".join(f"{role}\n{t}\n" for role, t, _, _ in turns)
            rows.append(
                {
                    "conv_id": r["conv_id"], "n_turns": len(turns), "turns_sha256": hashlib.sha256(whole.encode()).hexdigest(),
                    "loss_chars": sum(map(len, loss)), "loss_sha256": hashlib.sha256("".join(loss).encode()).hexdigest(),
                    "formatted_chars": len(text), "rewrites_history": r["rewrites_history"],
                }
            )
        fields = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("rewrites_history", pa.bool_())]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return format_chats(turns.unionByName(extra)).mapInArrow(_digests, DIGEST_DDL)

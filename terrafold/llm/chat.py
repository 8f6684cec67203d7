"""Chat formatting: conversations rendered by a compiled template, and read back from its output."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import grouped
from .templates import Template

#: Strings that mark turns; inside texts their first character is escaped.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
INSTRUCT = (
    "{% for m in messages %}"
    "{% if m.role == 'user' %}<s>[INST] {{ m.text|escape }} [/INST]"
    "{% elif m.role == 'assistant' %}<s>{% generation %}{{ m.text|escape }}{% endgeneration %}</s>"
    "{% else %}<s>[ROLE]{{ m.role|escape }}[/ROLE]{{ m.text|escape }}</s>{% endif %}"
    "{% endfor %}"
)
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_MARKS = {"<": r"\l", "[": r"\s"}
_ESCAPED = re.compile(r"\\([bls])")
_PLAIN = {"b": "\\", "l": "<", "s": "["}
_TURN = re.compile(r"<s>(?:\[INST\] (?P<user>.*?) \[/INST\]|\[ROLE\](?P<role>.*?)\[/ROLE\](?P<text>.*?)</s>|(?P<assistant>.*?)</s>)", re.S)


def escape(text) -> str:
    text = "" if text is None else str(text)
    if "\\" in text:
        text = text.replace("\\", r"\b")
    if "<" in text or "[" in text:
        text = _CONTROL.sub(lambda m: _MARKS[m[0][0]] + m[0][1:], text)
    return text


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _PLAIN[m[1]], text) if "\\" in text else text


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a text that INSTRUCT rendered."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError("not a formatted conversation")
        if m["user"] is not None:
            out.append(("user", unescape(m["user"])))
        elif m["role"] is not None:
            out.append((unescape(m["role"]), unescape(m["text"])))
        else:
            out.append(("assistant", unescape(m["assistant"])))
        at = m.end()
    return out


_MASK = "array<struct<begin:bigint,end:bigint>>"


def format_chats(turns: DataFrame, template: str = INSTRUCT) -> DataFrame:
    """(conv_id, formatted, loss_mask) for each conversation of turns(conv_id, turn, role, text).

    Rows go by turn, ties by role, then text; a null turn comes first, null roles and texts are
    empty, and rows with a null conv_id form one conversation. loss_mask has the code points
    (begin, end) of the template's generation blocks. Repeated rows are turns like others. An
    empty table gives an empty table; other columns are not read. A conversation, which becomes
    one text, is the largest thing held at once.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()

    def render(batches):
        compiled = Template(template, {"escape": escape})
        ids, texts, masks = [], [], []
        pack = lambda: pa.RecordBatch.from_arrays(
            [pa.concat_arrays(ids), pa.array(texts, pa.string()), pa.array(masks, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))],
            ["conv_id", "formatted", "loss_mask"],
        )
        size = 0
        for group in grouped(batches, ["conv_id"]):
            messages = [{"role": r or "", "text": t or ""} for r, t in zip(group.column("role").to_pylist(), group.column("text").to_pylist())]
            text, marks = compiled.render({"messages": messages})
            ids.append(group.column("conv_id").combine_chunks()[:1])
            texts.append(text)
            masks.append([{"begin": a, "end": b} for a, b in marks])
            size += len(text)
            if size > 1 << 22:
                yield pack()
                ids, texts, masks, size = [], [], [], 0
        if texts:
            yield pack()

    rows = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(render, f"conv_id {kind}, formatted string, loss_mask {_MASK}")


def chat_digests(formatted: DataFrame) -> DataFrame:
    """What the formatted texts say when they are read back: turns, and the text under the mask."""
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def read(batches):
        sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        for batch in batches:
            n, turns, chars, loss, sizes = [], [], [], [], []
            for text, mask in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                found = read_turns(text)
                learnt = "".join(unescape(text[m["begin"] : m["end"]]) for m in mask)
                n.append(len(found))
                turns.append(sha("".join(f"{r}\n{t}\n" for r, t in found)))
                chars.append(len(learnt))
                loss.append(sha(learnt))
                sizes.append(len(text))
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(turns, pa.string()), pa.array(chars, pa.int64()), pa.array(loss, pa.string()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    schema = f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return formatted.select("conv_id", "formatted", "loss_mask").mapInArrow(read, schema)

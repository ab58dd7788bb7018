"""Chat formatting in budgeted, turn-aligned windows.

Prefix sums of turn tokens cut a conversation into cells of `span_tokens`; a cell is packed, turn by
turn, into windows within the budget. Each window repeats the system turn and up to `history_tokens`
of the turns before it; repeated turns are never under the loss mask, so every assistant text is a
target once. A conversation of any length is many small cells, so none is held in one task.

Defined results: null texts and roles are empty; rows go by turn (null last), then role, then text, and
repeated rows stay, as turns of their own. A null conv_id is one conversation. A turn above the budget
is a window of its own, marked over_budget. An empty table gives no windows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from siftmark.llm.common import materialise, runs

START, END = "<|im_start|>", "<|im_end|>\n"
_OPEN = re.compile(r"<(\\*)\|")
_OPENED = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


@dataclass(frozen=True)
class Budget:
    """Tokens: of a window in all, of the history that it repeats, and of the cells cut by prefix sums."""

    window_tokens: int = 2048
    history_tokens: int = 256
    span_tokens: int = 1024


def escape(text: str) -> str:
    """Put a backslash into every control opening, and one more where one stands already."""
    return _OPEN.sub(lambda m: f"<\\{m[1]}|", text)


def unescape(text: str) -> str:
    return _OPENED.sub(lambda m: f"<{m[1]}|", text)


def _role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) of each turn of a window, as they were before formatting."""
    return [
        (unescape(role).replace("%0A", "\n").replace("%25", "%"), unescape(text))
        for role, text in _TURN.findall(formatted)
    ]


def default_tokens(text: Column) -> Column:
    """Words and single marks, and four for the template of a turn."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]")) + 4


def _pack(batches: Iterator[pa.RecordBatch], budget: Budget, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Windows of each cell: rows come by conversation, cell and place, those of the cell before as history."""
    out: list[dict] = []
    for _, rows in runs(batches, "conv_id", "_cell_key"):
        own = [r for r in rows if r["own"]]
        if not own:
            continue
        past = [r for r in rows if not r["own"]]
        room = max(0, budget.window_tokens - own[0]["sys_tokens"])
        window: list[dict] = []
        spans: list[tuple[list[dict], list[dict]]] = []
        used = 0

        def history(before: list[dict]) -> tuple[list[dict], int]:
            kept, total = [], 0
            for r in reversed(before):
                if total + r["tokens"] > min(budget.history_tokens, room):
                    break
                total += r["tokens"]
                kept.append(r)
            return kept[::-1], total

        context, used = history(past)
        for r in own:
            cost = 0 if r["is_system"] else r["tokens"]
            if window and used + cost > room:
                spans.append((context, window))
                past = past + window
                context, used = history([p for p in past if not p["is_system"]])
                window = []
            if not window and used + cost > room:
                context, used = [], 0
            window.append(r)
            used += cost
        spans.append((context, window))
        for context, window in spans:
            body, loss, at = [], [], 0
            for i, r in enumerate([*context, *[w for w in window if not w["is_system"]]]):
                head, text = f"{START}{_role(r['role'])}\n", escape(r["text"])
                if i >= len(context) and r["role"] == "assistant":
                    loss.append({"start": at + len(head), "end": at + len(head) + len(text)})
                turn = f"{head}{text}{END}"
                at += len(turn)
                body.append(turn)
            tokens = sum(r["tokens"] for r in [*context, *window] if not r["is_system"])
            out.append({
                "conv_id": window[0]["conv_id"], "first_turn": window[0]["place"], "n_turns": len(window),
                "n_history": len(context), "body": "".join(body), "loss": loss, "body_tokens": tokens,
                "over_budget": tokens > room,
            })
        if len(out) >= 500:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def format_windows(turns: DataFrame, budget: Budget = Budget(), tokens=default_tokens) -> DataFrame:
    """conv_id, first_turn, n_turns, n_context, n_tokens, over_budget, formatted and loss spans per window.

    turns has conv_id, turn, role and text; the first n_context turns of a window are repeated ones.
    Spans are [start, end) in code points of formatted.
    """
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_last(), F.col("role"), F.col("text")]
    rows = rows.withColumn("tokens", tokens(F.col("text")).cast("long"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    rows = materialise(rows, "chat-turns").withColumn("_part", F.shiftright("_id", 33))

    # Prefix sums inside (conversation, part); the parts of a conversation are few rows.
    inside = W.partitionBy("conv_id", "_part").orderBy("_id").rowsBetween(W.unboundedPreceding, -1)
    parts = W.partitionBy("conv_id").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = rows.groupBy("conv_id", "_part").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    offsets = offsets.select(
        F.col("conv_id").alias("c"), F.col("_part").alias("p"),
        F.coalesce(F.sum("t").over(parts), F.lit(0)).alias("t0"), F.coalesce(F.sum("n").over(parts), F.lit(0)).alias("n0"),
    )
    first = rows.groupBy(F.col("conv_id").alias("s")).agg(F.min_by(F.struct("role", "text", "tokens"), "_id").alias("h"))
    system = first.where("h.role = 'system'").select("s", F.col("h.text").alias("sys_text"), F.col("h.tokens").alias("sys_tokens"))
    zero = F.lit(0).cast("long")
    placed = (
        rows.withColumns({"t1": F.coalesce(F.sum("tokens").over(inside), zero), "n1": F.count("*").over(inside)})
        .join(offsets, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("_part") == F.col("p")))
        .join(system.select("s", "sys_tokens"), F.col("conv_id").eqNullSafe(F.col("s")), "left")
        .withColumn("place", F.col("n0") + F.col("n1"))
        .withColumn("is_system", F.col("sys_tokens").isNotNull() & (F.col("place") == 0))
        .withColumn("sys_tokens", F.coalesce("sys_tokens", zero))
        .withColumn("before", F.when(F.col("is_system"), zero).otherwise(F.col("t0") + F.col("t1") - F.col("sys_tokens")))
        .withColumn("cell", F.floor(F.col("before") / budget.span_tokens))
    )
    # A turn may be history of the next cell only, as history is no longer than a cell.
    reach = min(budget.history_tokens, budget.span_tokens)
    near = ~F.col("is_system") & (F.col("before") >= (F.col("cell") + 1) * budget.span_tokens - reach)
    copies = F.when(near, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    dealt = placed.select("conv_id", "place", "role", "text", "tokens", "sys_tokens", "is_system", "cell", F.explode(copies).alias("ahead"))
    dealt = dealt.select(
        "conv_id", (F.col("cell") + F.col("ahead")).alias("_cell_key"), "place", "role", "text", "tokens", "sys_tokens",
        "is_system", (F.col("ahead") == 0).alias("own"),
    )
    dealt = dealt.repartition("conv_id", "_cell_key").sortWithinPartitions("conv_id", "_cell_key", "place")
    kind = turns.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, first_turn long, n_turns long, n_history long, body string, loss array<struct<start:long,end:long>>, body_tokens long, over_budget boolean"
    arrow = _arrow(turns, schema)
    packed = dealt.mapInArrow(lambda batches: _pack(batches, budget, arrow), schema)

    # The system turn goes before every body; only the first window has it as a turn of its own.
    head = F.concat(F.lit(f"{START}system\n"), F.regexp_replace("sys_text", r"<(\\*)\|", r"<\\$1|"), F.lit(END))
    joined = packed.join(system, F.col("conv_id").eqNullSafe(F.col("s")), "left")
    joined = joined.withColumn("head", F.coalesce(head, F.lit("")))
    shift = F.length("head").cast("long")
    repeated = (F.col("sys_text").isNotNull() & (F.col("first_turn") > 0)).cast("long")
    return joined.select(
        "conv_id", "first_turn", "n_turns", (F.col("n_history") + repeated).alias("n_context"),
        (F.col("body_tokens") + F.coalesce("sys_tokens", zero)).alias("n_tokens"), "over_budget",
        F.concat("head", "body").alias("formatted"),
        F.transform("loss", lambda s: F.struct((s["start"] + shift).alias("start"), (s["end"] + shift).alias("end"))).alias("loss"),
    )


def _arrow(turns: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(turns.sparkSession.createDataFrame([], schema).schema)


def _digest(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Windows come by conversation and place; two running hashes are all that is held of a conversation."""
    out, key, state = [], None, None

    def close() -> None:
        out.append({
            "conv_id": key[0], "n_turns": state[0], "turns_sha256": state[1].hexdigest(), "loss_chars": state[2],
            "loss_sha256": state[3].hexdigest(), "formatted_chars": state[4], "n_windows": state[5],
        })

    for batch in batches:
        for row in batch.to_pylist():
            if key != (row["conv_id"],):
                if key is not None:
                    close()
                key, state = (row["conv_id"],), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            formatted = row["formatted"]
            for role, text in parse(formatted)[row["n_context"]:]:
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            for span in row["loss"]:
                text = unescape(formatted[span["start"]:span["end"]])
                state[2] += len(text)
                state[3].update(text.encode())
            state[4] += len(formatted)
            state[5] += 1
        if len(out) >= 1000:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out.clear()
    if key is not None:
        close()
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of the turns and of the text under the loss mask, parsed from the formatted windows."""
    kind = windows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
    arrow = _arrow(windows, schema)
    rows = windows.select("conv_id", "first_turn", "n_context", "formatted", "loss")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "first_turn")
    return rows.mapInArrow(lambda batches: _digest(batches, arrow), schema)

"""Chat formatting: a finite-state machine over roles, and text segments with loss flags from a declarative template.

Only DataFrame functions. A conversation becomes one string, so its size is bounded by a row's.

Defined cases: rows go by turn, then role, then text (nulls first), so repeated rows and ties have one order; a null
role or text counts as empty; rows with a null conv_id belong to no common conversation, and each makes one of its own;
roles that the template does not list are written with their name and make the conversation invalid; an empty table
gives an empty result; other columns are ignored. No conversation is dropped: `valid` and `error_turn` tell the verdict.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Role:
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Control strings all start with '[' or '<' and hold no other '[', '<' or '\\': none can arise where two parts meet."""

    roles: dict[str, Role] = field(
        default_factory=lambda: {"system": Role("<<SYS>>", "<</SYS>>"), "user": Role("[INST]", "[/INST]"), "assistant": Role("<s>", "</s>", True)}
    )
    other: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[/TURN]")
    start: str = "start"
    #: (state, role) -> next state; anything else is an error.
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user",
            ("user", "assistant"): "assistant", ("assistant", "user"): "user",
        }
    )
    accept: tuple[str, ...] = ("user", "assistant")

    def controls(self) -> list[str]:
        return sorted({c for r in self.roles.values() for c in (r.open, r.close)} | set(self.other), key=lambda c: (-len(c), c))

    def any_control(self) -> str:
        return "|".join(map(re.escape, self.controls()))


DEFAULT = Template()


def escape(text: Column, template: Template = DEFAULT) -> Column:
    """Double backslashes, then break every control string by a backslash after its first character."""
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, rf"(?s)(?={template.any_control()})(.)", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _segments(turn: Column, t: Template) -> Column:
    role, text = turn["role"], escape(turn["text"], t)

    def parts(opened: Column, closed: str, loss: bool) -> Column:
        seg = lambda x, flag: F.struct(x.alias("text"), F.lit(flag).alias("loss"))
        return F.array(seg(opened, False), seg(text, loss), seg(F.lit(closed), False))

    out = parts(F.concat(F.lit(t.other[0]), escape(role, t), F.lit(t.other[1])), t.other[2], False)
    for name, r in t.roles.items():
        out = F.when(role == name, parts(F.lit(r.open), r.close, r.loss)).otherwise(out)
    return out


def format_chats(rows: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """conv_id, formatted, segments array<struct<text, loss>>, valid, error_turn (0-based, null if valid)."""
    t = template
    none = F.lit("")
    turn = F.struct(F.col("turn"), F.coalesce("role", none).alias("role"), F.coalesce("text", none).alias("text"))
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    grouped = rows.select("conv_id", alone.alias("_alone"), turn.alias("_t")).groupBy("conv_id", "_alone").agg(F.sort_array(F.collect_list("_t")).alias("turns"))
    moves = F.create_map(*[F.lit(x) for (s, r), to in t.moves.items() for x in (f"{s}>{r}", to)])
    start = F.struct(F.lit(t.start).alias("state"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("error"))

    def step(acc: Column, x: Column) -> Column:
        to = F.coalesce(moves[F.concat(acc["state"], F.lit(">"), x["role"])], F.lit("error"))
        error = F.coalesce(acc["error"], F.when(to == "error", acc["i"]))
        return F.struct(to.alias("state"), (acc["i"] + 1).alias("i"), error.alias("error"))

    checked = grouped.withColumn("_end", F.aggregate("turns", start, step)).withColumn("segments", F.flatten(F.transform("turns", lambda x: _segments(x, t))))
    return checked.select(
        "conv_id",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "segments",
        (F.col("_end.error").isNull() & F.col("_end.state").isin(*t.accept)).alias("valid"),
        F.col("_end.error").alias("error_turn"),
    )


def read_turns(formatted: Column, template: Template = DEFAULT) -> Column:
    """The turns of a formatted string, as array<struct<role, text>>: the inverse of format_chats."""
    t = template
    spans = [rf"{re.escape(a)}.*?{re.escape(b)}" for a, b in [*((r.open, r.close) for r in t.roles.values()), (t.other[0], t.other[2])]]
    raw = F.regexp_extract_all(formatted, F.lit(f"(?s)(?:{'|'.join(spans)})"), F.lit(0))

    def parse(x: Column) -> Column:
        turn = lambda role, a, b: F.struct(role.alias("role"), unescape(F.substr(x, a + F.lit(1), F.length(x) - a - F.lit(len(b)))).alias("text"))
        named = F.substring_index(F.substr(x, F.lit(len(t.other[0]) + 1)), t.other[1], 1)
        out = turn(unescape(named), F.length(named) + F.lit(len(t.other[0]) + len(t.other[1])), t.other[2])
        for name, r in t.roles.items():
            out = F.when(F.startswith(x, F.lit(r.open)), turn(F.lit(name), F.lit(len(r.open)), r.close)).otherwise(out)
        return out

    return F.transform(raw, parse)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def chat_digest(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Counts and digests read back from the output of format_chats."""
    back = formatted.withColumn("_turns", read_turns(F.col("formatted"), template)).withColumn("_loss", loss_text(F.col("segments")))
    said = F.array_join(F.transform("_turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def digest_sql(table: str, template: Template = DEFAULT) -> str:
    """DuckDB SQL for the digest of a table with non-null conv_ids."""
    t = template
    q = lambda s: "'" + s.replace("'", "''") + "'"
    marks = lambda c: f"(length({c}) + length({c}) - length(replace({c}, '\\', '')) + len(regexp_extract_all({c}, {q(t.any_control())})))"
    known = " ".join(f"WHEN role = {q(n)} THEN {len(r.open) + len(r.close)}" for n, r in t.roles.items())
    loss = " OR ".join(f"role = {q(n)}" for n, r in t.roles.items() if r.loss)
    order = "ORDER BY turn NULLS FIRST, role, text"
    ok = " OR ".join(f"(p = {q(s)} AND role = {q(r)})" for (s, r) in t.moves)
    ends = ", ".join(map(q, t.accept))
    return f"""
    WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM {table}),
    s AS (SELECT *, coalesce(lag(role) OVER w, {q(t.start)}) AS p, lead(role) OVER w IS NULL AS last FROM r
          WINDOW w AS (PARTITION BY conv_id {order}))
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
      CAST(coalesce(sum(length(text)) FILTER ({loss}), 0) AS BIGINT) AS loss_chars,
      sha256(coalesce(string_agg(text, '' {order}) FILTER ({loss}), '')) AS loss_sha256,
      CAST(sum({marks('text')} + CASE {known} ELSE {sum(map(len, t.other))} + {marks('role')} END) AS BIGINT) AS formatted_chars,
      bool_and({ok}) AND bool_or(last AND role IN ({ends})) AS valid
    FROM s GROUP BY conv_id"""

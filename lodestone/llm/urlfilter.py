"""URL filters: glob rules as one bit-parallel wildcard automaton (multiword Shift-And), run over canonical URLs.

Every rule becomes a glob over the canonical URL "." + host + path: "*" is any run of characters other than "/",
"**" any run, "?" one character other than "/". All rules sit in one bit vector of 64-bit words; one step per byte
moves all of them: D = ((D << 1) & B[c]) | (D & L[c]), where B marks the states that byte c may enter and L the states
that loop on it. A batch of URLs advances together, so the state is a matrix of URLs x words.

Defined cases: a null URL, or one without "://", has an empty host and path and matches no host rule; ids are carried
as they are, repeated rows stay repeated, the table's other columns are ignored. The rule set is a parameter (bounded),
shipped with the function.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        return f"*.{self.host}{self.path}**"


#: The host and path rules of the registered query.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))
#: Globs that judge URLs no host rule fits; what none of them matches is allowed.
BLOCK_GLOBS = (".ads.**", "*.doubleclick.*/**", "**/ads/**", "**/login**", "**/wp-admin/**", "**.exe", "**.zip", "**.apk")


class ShiftAnd:
    """All globs at once. States of a glob: one before each symbol, one after the last."""

    def __init__(self, globs: list[str]):
        self.count, enter, loops, firsts, finals = len(globs), [], [], [], []
        for g in globs:
            firsts.append(len(enter))
            enter.append(None)
            loops.append("")
            k = 0
            while k < len(g):
                if g[k] == "*":
                    wide = g[k : k + 2] == "**"
                    loops[-1] = "**" if wide or loops[-1] == "**" else "*"
                    k += 1 + wide
                    continue
                for byte in g[k].encode() if g[k] != "?" else (None,):
                    enter.append("?" if byte is None else byte)
                    loops.append("")
                k += 1
            finals.append(len(enter) - 1)
        self.words = max(1, -(-len(enter) // 64))
        self.enter, self.loop = np.zeros((256, self.words), np.uint64), np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        bit = lambda s: (s // 64, np.uint64(1) << np.uint64(s % 64))
        for s, (sym, loop) in enumerate(zip(enter, loops)):
            w, b = bit(s)
            if sym == "?":
                self.enter[[c for c in range(256) if c != 47], w] |= b
            elif sym is not None:
                self.enter[sym, w] |= b
            if loop == "**":
                self.loop[:, w] |= b
            elif loop == "*":
                self.loop[[c for c in range(256) if c != 47], w] |= b
        for s in firsts:
            w, b = bit(s)
            self.start[w] |= b
        self.finals = [bit(s) for s in finals]

    def match(self, urls: list[bytes]) -> np.ndarray:
        """bool matrix of URLs x globs."""
        n = len(urls)
        lengths = np.array([len(u) for u in urls], np.int64)
        order = np.argsort(-lengths, kind="stable")  # longest first: the active ones are a prefix
        flat, starts = np.frombuffer(b"".join(urls), np.uint8), np.cumsum(lengths) - lengths
        state = np.tile(self.start, (n, 1))
        ends, sorted_lengths = starts[order], -lengths[order]
        active = np.searchsorted(sorted_lengths, -np.arange(int(lengths.max(initial=0))), "left")
        one, top = np.uint64(1), np.uint64(63)
        for t, m in enumerate(active.tolist()):
            chars, d = flat[ends[:m] + t], state[:m]
            moved = d << one
            if self.words > 1:
                moved[:, 1:] |= d[:, :-1] >> top
            state[:m] = (moved & self.enter[chars]) | (d & self.loop[chars])
        out = np.zeros((n, self.count), bool)
        for g, (w, b) in enumerate(self.finals):
            out[order, g] = (state[:, w] & b) != 0
        return out


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((k for k in map(rest.find, "?#") if k >= 0), default=len(rest))
    rest = rest[:cut]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


_LOWER = {c: c + 32 for c in range(65, 91)}


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, block_globs: tuple[str, ...] = BLOCK_GLOBS) -> DataFrame:
    """page_id, host, path, rule, verdict for every row. The longest fitting rule wins, ties go to the lesser name."""
    ranked = sorted(rules, key=lambda r: (-len(r.name), r.name))
    machine = ShiftAnd([r.glob for r in ranked] + list(block_globs))
    names, verdicts = [r.name for r in ranked] + [None], [r.verdict for r in ranked]

    def judge(batches):
        for batch in batches:
            parts = [split_url(u) for u in batch.column("url").to_pylist()]
            if not parts:
                continue
            hit = machine.match([f".{h}{p}".encode() for h, p in parts])
            first = np.where(hit[:, : len(ranked)].any(1), hit[:, : len(ranked)].argmax(1), len(ranked))
            method = hit[:, len(ranked) :].any(1)
            verdict = [verdicts[k] if k < len(ranked) else ("block" if m else "allow") for k, m in zip(first.tolist(), method.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), pa.array([h for h, _ in parts]), pa.array([p for _, p in parts]), pa.array([names[k] for k in first.tolist()], pa.string()), pa.array(verdict, pa.string())],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    return pages.select("page_id", "url").mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string")


def _regex(glob: str) -> str:
    import re

    out = ""
    for part in re.findall(r"\*\*|\*|\?|[^*?]+", glob):
        out += {"**": "[\\s\\S]*", "*": "[^/]*", "?": "[^/]"}.get(part) or re.escape(part)
    return out


def judge_sql(table: str, rules: tuple[Rule, ...] = RULES, block_globs: tuple[str, ...] = BLOCK_GLOBS) -> str:
    """DuckDB SQL by string functions for the rules and regular expressions for the globs."""
    rows = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in rules)
    globs = " OR ".join(f"regexp_full_match('.' || host || path, '{_regex(g)}')" for g in block_globs) or "false"
    return f"""
    WITH u AS (SELECT row_number() OVER () AS k, page_id, CASE WHEN url IS NULL OR NOT contains(url, '://') THEN '' ELSE regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*') END AS rest FROM {table}),
    h AS (SELECT k, page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path FROM u),
    r(v, rh, rp) AS (VALUES {rows}),
    f AS (SELECT k, rh || rp AS rule, v, row_number() OVER (PARTITION BY k ORDER BY length(rh || rp) DESC, rh || rp) AS n FROM h JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
    SELECT page_id, host, path, rule, coalesce(v, CASE WHEN {globs} THEN 'block' ELSE 'allow' END) AS verdict
    FROM h LEFT JOIN f ON h.k = f.k AND n = 1"""

"""Quality rules: word statistics, and a hashed n-gram log-likelihood ratio between trusted text and the whole corpus.

Words and word pairs fall in a fixed number of buckets. The raw multinomial counts every n-gram of every document; the
target multinomial counts those of the trusted documents. A document's score is the sum of its n-grams' log ratios
log(p_target / p_raw), divided by their number; it is kept when the base rules pass and the score reaches the threshold.
A document's own n-grams are left out of both multinomials when it is scored, so a document is not judged by itself; the
target is shrunk towards the raw corpus by PRIOR n-grams per bucket, and a bucket without other n-grams counts 0: with
little evidence scores go to 0. Ratios are fixed-point integers (1 / SCALE nats), so a score does not depend on the order of
summation.

Trusted documents are labelled rows (quality 1, not toxic, no contradicting label): at most `max_trusted` of them, drawn by
a hash of the id. That bound is a parameter; all raw counts and all verdicts cover every document.

Defined cases: a null or empty text has no words and fails the base rules; a document without a label is judged like
any other; without trusted documents every score is 0; repeated rows stay repeated; an empty table gives an empty
result; other columns are ignored. Very long texts are handled one at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCKS, blocks_batch, drawn, packed_blocks, pieces, split_words, summed_arrays, tidy, to_bytes

BUCKETS = 1 << 16
PRIOR = 8
SCALE = 1 << 16
#: Mean log ratio (nats per n-gram) from which a document is kept.
THRESHOLD = -0.08
MAX_TRUSTED = 20_000
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\r\x0b\x0c"


def coded(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of texts: each word's number, where each text's words begin, and the distinct words' hashes (the first
    32 bits of md5)."""
    codes, starts, distinct = split_words(texts)
    first = b"".join([hashlib.md5(w).digest()[:4] for w in to_bytes(distinct)])
    return codes.astype(np.int64), starts, np.frombuffer(first, ">u4").astype(np.int64)


def buckets(hashes: np.ndarray, m: int = BUCKETS) -> np.ndarray:
    """Buckets of all words and all pairs of neighbours."""
    return np.concatenate([hashes % m, (31 * hashes[:-1] + hashes[1:] + 7) % m])


def repeated_words(codes: np.ndarray, distinct: int) -> int:
    """Words that lie in a 3-word window found twice or more."""
    if len(codes) < 4:
        return 0
    if distinct < 1 << 21:
        key = (codes[:-2] * distinct + codes[1:-1]) * distinct + codes[2:]
    else:  # three numbers do not fit in 63 bits
        pair = np.unique(codes[:-2] * distinct + codes[1:-1], return_inverse=True)[1]
        key = pair.astype(np.int64) * distinct + codes[2:]
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    inside = np.zeros(len(codes), bool)
    for k in range(3):
        inside[k : len(codes) - 2 + k] |= twice
    return int(inside.sum())


def base_counts(text: bytes | None) -> tuple[int, int, int]:
    """Code points in words, symbols, repeated lines."""
    if not text:
        return 0, 0, 0
    seen: set[bytes] = set()
    repeated = 0
    for line in text.split(b"\n"):
        if line.strip(SPACE):
            repeated += line in seen
            seen.add(line)
    return len(text.translate(None, SPACE).decode("utf-8", "replace")), len(text) - len(text.translate(None, SYMBOLS)), repeated


def trusted_ids(labels: DataFrame, limit: int = MAX_TRUSTED) -> np.ndarray:
    """Sorted ids of at most `limit` trusted rows, drawn by hash."""
    sure = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).filter("q = 1 AND t = 0")
    rows = drawn(sure.select("doc_id"), F.col("doc_id"), limit)
    return np.sort(np.array([r["doc_id"] for r in rows], np.int64))


@dataclass(frozen=True)
class Model:
    """Counts of all buckets and the trusted ids: a fixed size, whatever the corpus."""

    raw: np.ndarray
    target: np.ndarray
    trusted: np.ndarray

    def score(self, doc_id: int | None, grams: np.ndarray) -> int:
        """Fixed-point mean log ratio of a document's n-grams, judged by the other documents."""
        if not len(grams) or not len(self.trusted):
            return 0
        prior, own = PRIOR * len(self.raw), doc_id is not None and is_in(doc_id, self.trusted)
        b, c = np.unique(grams, return_counts=True)
        r = (self.raw[b] - c).astype(np.float64)
        t = (self.target[b] - (c if own else 0)).astype(np.float64)
        n, total = self.n_raw - len(grams), self.n_target - (len(grams) if own else 0)
        known = r > 0
        ratio = np.log((t[known] * n + prior * r[known]) / (r[known] * (total + prior)))
        return int((np.rint(ratio * SCALE).astype(np.int64) * c[known]).sum()) // len(grams)

    @cached_property
    def n_raw(self) -> int:
        return int(self.raw.sum())

    @cached_property
    def n_target(self) -> int:
        return int(self.target.sum())


def is_in(doc_id: int, ids: np.ndarray) -> bool:
    k = int(np.searchsorted(ids, doc_id))
    return k < len(ids) and ids[k] == doc_id


def fit(docs: DataFrame, labels: DataFrame, m: int = BUCKETS, limit: int = MAX_TRUSTED) -> Model:
    trusted = trusted_ids(labels, limit)

    @tidy
    def count(batches):
        raw, target, some = np.zeros(m, np.int64), np.zeros(m, np.int64), False
        for table in pieces(batches):
            ids = table["doc_id"].to_pylist()
            codes, starts, hashes = coded(table["text"])
            chosen = np.isin(np.array([-1 if i is None else i for i in ids], np.int64), trusted) & np.array([i is not None for i in ids])
            text = np.repeat(np.arange(len(ids)), np.diff(starts))
            same = text[1:] == text[:-1]  # pairs do not reach over texts
            h = hashes[codes]
            one, two = h % m, ((31 * h[:-1] + h[1:] + 7) % m)[same]
            raw += np.bincount(one, minlength=m) + np.bincount(two, minlength=m)
            if chosen.any():
                good = chosen[text]
                target += np.bincount(one[good], minlength=m) + np.bincount(two[good[1:][same]], minlength=m)
            some = True
        if some:
            yield blocks_batch([*packed_blocks(raw, 0), *packed_blocks(target, 1)])

    raw, target = summed_arrays(docs.select("doc_id", "text").mapInArrow(count, BLOCKS), m, 2)
    return Model(raw, target, trusted)


STATS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score long"


def judged(table: pa.Table, model: Model, threshold: float) -> Iterator[tuple]:
    """The statistics and the verdict of every row of doc_id, text."""
    codes, starts, hashes = coded(table["text"])
    for k, (doc_id, text) in enumerate(zip(table["doc_id"].to_pylist(), to_bytes(table["text"]))):
        mine = codes[starts[k] : starts[k + 1]]
        n, (chars, symbols, lines) = len(mine), base_counts(text)
        repeats = repeated_words(mine, len(hashes))
        failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
        score = model.score(doc_id, buckets(hashes[mine], len(model.raw)) if n else mine)
        yield doc_id, n, chars, symbols, lines, repeats, failed, bool(not failed and score >= int(threshold * SCALE)), score


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, keep_rows: bool = False) -> DataFrame:
    """Statistics and verdict of every document; with keep_rows the rows of docs that are kept, with all their columns."""
    model = fit(docs, labels)

    @tidy
    def stats(batches):
        for table in pieces(batches):
            rows = judged(table, model, threshold)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.int64()])],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"],
            )

    @tidy
    def kept(batches):
        for table in pieces(batches):
            good = [row[7] for row in judged(table, model, threshold)]
            yield from table.filter(pa.array(good, pa.bool_())).combine_chunks().to_batches()

    if keep_rows:
        return docs.mapInArrow(kept, docs.schema)
    return docs.select("doc_id", "text").mapInArrow(stats, STATS)


def judge_sql(documents: str = "documents", labels: str = "labels", threshold: float = THRESHOLD, m: int = BUCKETS) -> str:
    """DuckDB SQL for tables with at most MAX_TRUSTED trusted rows; minutes on large tables, seconds on small ones."""
    return f"""
    WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM {documents}),
    w AS (SELECT k, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
    x AS (SELECT k, doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w),
    h AS (SELECT *, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) AS h, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM x WINDOW o AS (PARTITION BY k ORDER BY i)),
    g AS (SELECT *, lead(h) OVER (PARTITION BY k ORDER BY i) AS h2 FROM h),
    b AS (SELECT k, doc_id, h % {m} AS b FROM g UNION ALL SELECT k, doc_id, (31 * h + h2 + 7) % {m} FROM g WHERE h2 IS NOT NULL),
    t AS (SELECT doc_id FROM {labels} WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1 AND max(toxic) = 0),
    o1 AS (SELECT b.k, b.b, count(*) AS c, bool_or(t.doc_id IS NOT NULL) AS own FROM b LEFT JOIN t USING (doc_id) GROUP BY b.k, b.b),
    c AS (SELECT b, sum(c) AS raw, coalesce(sum(c) FILTER (own), 0) AS target FROM o1 GROUP BY b),
    n AS (SELECT sum(raw) AS n, sum(target) AS t, (SELECT count(*) FROM t) AS sure FROM c),
    z AS (SELECT k, sum(c) AS len FROM o1 GROUP BY k),
    e AS (SELECT o1.k, o1.c, len, (raw - c)::DOUBLE AS r, (target - CASE WHEN own THEN c ELSE 0 END)::DOUBLE AS g, n - len AS n, t - CASE WHEN own THEN len ELSE 0 END AS t, sure
      FROM o1 JOIN c USING (b) JOIN z USING (k), n),
    s AS (SELECT k, CAST(floor(coalesce(sum(c * round_even({SCALE} * ln((g * n + {PRIOR * m} * r) / (r * (t + {PRIOR * m}))), 0)) FILTER (r > 0 AND sure > 0), 0) / any_value(len)) AS BIGINT) AS score FROM e GROUP BY k),
    tri AS (SELECT k, i, count(*) OVER (PARTITION BY k, w, w2, w3) > 1 AS twice FROM g WHERE w3 IS NOT NULL),
    rep AS (SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM tri WHERE twice) GROUP BY k),
    l AS (SELECT k, count(*) - count(DISTINCT line) AS n FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY k),
    o AS (SELECT w.k, w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
      CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines,
      CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(score, 0) AS score FROM w LEFT JOIN l USING (k) LEFT JOIN rep USING (k) LEFT JOIN s USING (k)),
    f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM o)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND score >= {int(threshold * SCALE)} AS kept, score FROM f"""

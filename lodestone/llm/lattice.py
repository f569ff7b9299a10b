"""SentencePiece encoding and decoding over a relational lattice.

Lattice: the bounded-length substrings of every distinct word are exploded and equi-joined to the piece table; the matches
are the word's edges, which are grouped by word and folded to the word's pieces. The fold follows the model's kind: Viterbi
(best sum of scores) for unigram models; for BPE models, whose scores are merge ranks and not log probabilities, the merge
of the best adjacent pair until none is left. Viterbi over a BPE model would not give the ids that the model defines.

Two forms of the same lattice. `encode_words` is the one in DataFrame functions: explode, join, group, and a fold by the
higher-order function `aggregate`, over a table of words. `encode` and `digest` run it over documents in Arrow batches: a
task's words are cut (where no piece reaches across: before a run of word marks, around line breaks) and numbered by
Arrow, the substrings of all new ones are exploded and joined length by length, and all words are folded side by side. The
DataFrame form costs 100 to 400 core microseconds a distinct word, the batch form about 3 (README). Every word of every
text goes this way, whatever its frequency; no text and no word is shuffled, nothing is broadcast but the model.

Decoding joins the pieces of the ids, byte pieces as bytes, and drops the word mark put in front.

Defined cases: a null or empty text has no pieces and decodes to the empty text; characters without a piece become byte
pieces; the word mark itself (U+2581) in a text is a space to the model and decodes as one; words of any length are
encoded (beyond LONG characters one by one, BPE by a heap, so that a merge costs the logarithm of the length); very long
texts are handled one at a time; repeated rows stay repeated; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Remembered, pieces, tidy

MARK = "▁"
#: Bytes of words and of their ids that a task remembers, about.
MEMORY = 48 << 20
#: Characters of the words that are folded side by side at once, about, and of the longest word among them.
AT_ONCE, LONG = 1 << 18, 256


@dataclass(frozen=True)
class Pieces:
    """A piece table. kind: 'bpe' or 'unigram'."""

    kind: str
    table: tuple[tuple[str, int, float], ...]  # piece, id, score
    byte_ids: tuple[int, ...]
    unk: int
    prefix: bool

    @property
    def longest(self) -> int:
        return max(len(p) for p, _, _ in self.table)


def load_pieces(model_file: str) -> Pieces:
    """Read a SentencePiece model with the identity normaliser."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(model_file, "rb") as f:
        m.ParseFromString(f.read())
    spec, types = m.normalizer_spec, pb.ModelProto.SentencePiece
    if spec.name != "identity" or spec.remove_extra_whitespaces or m.trainer_spec.model_type not in (1, 2):
        raise ValueError("unigram and BPE models with the identity normaliser only")
    table = tuple((p.piece, i, p.score) for i, p in enumerate(m.pieces) if p.type == types.NORMAL)
    if any("\n" in p or re.search(f"[^{MARK}]{MARK}", p) for p, _, _ in table):
        raise ValueError("a piece reaches over a word border")
    by = {p.piece: i for i, p in enumerate(m.pieces) if p.type == types.BYTE}
    unk = next(i for i, p in enumerate(m.pieces) if p.type == types.UNKNOWN)
    return Pieces("unigram" if m.trainer_spec.model_type == 1 else "bpe", table, tuple(by[f"<0x{b:02X}>"] for b in range(256)) if by else (), unk, spec.add_dummy_prefix)


def edges(words: DataFrame, model: Pieces) -> DataFrame:
    """word, edges array<struct<s, l, id, score>>: one edge for every substring that is a piece."""
    spark = words.sparkSession
    table = F.broadcast(spark.createDataFrame(list(model.table), "piece string, id int, score double"))  # as large as the model file
    n = F.length("word")
    starts = words.select("word", F.explode(F.sequence(F.lit(1), n)).alias("s"))
    spans = starts.select("word", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(model.longest), n - F.col("s") + 1))).alias("l"))
    found = spans.withColumn("piece", F.substring("word", F.col("s"), F.col("l"))).join(table, "piece")
    grouped = found.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("s", "l", "id", "score"))).alias("edges"))
    return words.join(grouped, "word", "left").withColumn("edges", F.coalesce("edges", F.array().cast("array<struct<s:int,l:int,id:int,score:double>>")))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _merged(n: Column, lattice: Column) -> Column:
    """BPE: cuts 1..n+1, and one merge per step: the edge with the best score (leftmost first) that spans two segments."""

    def step(cuts: Column, _: Column) -> Column:
        spans_two = lambda e, at: (at > 0) & (F.try_element_at(cuts, (at + 2).cast("int")) == e["s"] + e["l"])
        fits = F.filter(lattice, lambda e: F.coalesce(_let(F.array_position(cuts, e["s"]), lambda at: spans_two(e, at)), F.lit(False)))
        best = F.array_max(F.transform(fits, lambda e: F.struct(e["score"].alias("score"), (-e["s"]).alias("left"), e["l"].alias("l"))))
        merge = lambda x: F.when(x.isNull(), cuts).otherwise(F.filter(cuts, lambda c: (c <= -x["left"]) | (c >= x["l"] - x["left"])))
        return _let(best, merge)

    start = F.sequence(F.lit(1), n + 1)
    return F.when(n < 2, start).otherwise(F.aggregate(F.sequence(F.lit(2), n), start, step))


#: What a character without a piece costs more than the least score, in unigram models.
UNKNOWN_PENALTY = 10.0


def _viterbi(n: Column, lattice: Column, worst: float) -> Column:
    """Unigram: the best path to every place, folded from left to right. Single characters without a piece cost a penalty."""
    best = "struct<score:double,cuts:array<int>>"
    first = F.array(F.struct(F.lit(0.0).alias("score"), F.array(F.lit(1)).alias("cuts"))).cast(f"array<{best}>")

    def step(paths: Column, end: Column) -> Column:
        single = F.struct(end.alias("s"), F.lit(1).alias("l"), F.lit(-1).alias("id"), F.lit(worst - UNKNOWN_PENALTY).alias("score"))
        into = F.filter(lattice, lambda e: e["s"] + e["l"] == end + 1)
        score = lambda e: F.element_at(paths, e["s"])["score"] + e["score"]
        best_of = lambda edges: F.array_max(F.transform(edges, lambda e: F.struct(score(e).alias("score"), e["l"].alias("l"))))
        top = _let(into, lambda x: best_of(F.when(F.exists(x, lambda e: e["l"] == 1), x).otherwise(F.concat(x, F.array(single)))))
        cuts = lambda t: F.concat(F.element_at(paths, (end + 1 - t["l"]).cast("int"))["cuts"], F.array((end + 1).cast("int")))
        return F.concat(paths, F.array(_let(top, lambda t: F.struct(t["score"].alias("score"), cuts(t).alias("cuts"))))).cast(f"array<{best}>")

    return F.element_at(F.aggregate(F.sequence(F.lit(1), n), first, step), -1)["cuts"]


def fold(lattice: DataFrame, model: Pieces) -> DataFrame:
    """word, ids from word, edges."""
    n, e = F.length("word"), F.col("edges")
    cuts = _merged(n, e) if model.kind == "bpe" else _viterbi(n, e, min(s for _, _, s in model.table))
    steps = lattice.withColumn("_cuts", cuts)
    span = lambda i: F.struct(F.element_at("_cuts", i).alias("s"), (F.element_at("_cuts", i + 1) - F.element_at("_cuts", i)).alias("l"))
    steps = steps.withColumn("_spans", F.when(F.size("_cuts") > 1, F.transform(F.sequence(F.lit(1), F.size("_cuts") - 1), span)).otherwise(F.array()))

    def ids(x: Column) -> Column:
        known = F.filter(e, lambda y: (y["s"] == x["s"]) & (y["l"] == x["l"]))
        char = F.hex(F.encode(F.substring(F.col("word"), x["s"], x["l"]), "UTF-8"))
        if model.byte_ids:
            code = lambda j: F.conv(F.substring(char, 2 * j - 1, F.lit(2)), 16, 10).cast("int")
            other = F.transform(F.sequence(F.lit(1), (F.length(char) / 2).cast("int")), lambda j: F.element_at(F.array(*map(F.lit, model.byte_ids)), code(j) + 1))
        else:
            other = F.array(F.lit(model.unk))
        return F.when(F.size(known) > 0, F.array(F.element_at(known, 1)["id"])).otherwise(other)

    return steps.select("word", F.flatten(F.transform("_spans", ids)).alias("ids"))


def encode_words(words: DataFrame, model: Pieces) -> DataFrame:
    """word, ids for every word (with word marks for spaces) of a table: the lattice in DataFrame functions."""
    return fold(edges(words.select("word").filter("word IS NOT NULL").distinct(), model), model)


#: More than any rank, and a key of no candidate.
_NO_RANK, _NO_KEY = np.int32(2**31 - 1), np.int64(2**62)


class Lattice:
    """The piece table as arrays, for words in batches. In words, a space stands for the word mark."""

    def __init__(self, model: Pieces):
        self.model, self.longest = model, model.longest
        table = sorted(model.table, key=lambda p: -p[2])  # by rank: the best score first
        self.id_of_rank = np.array([i for _, i, _ in table], np.uint32)
        self.score_of_rank = np.array([x for _, _, x in table], np.float64)
        self.order = np.append(0, np.cumsum(np.diff(self.score_of_rank) != 0)).astype(np.int64)  # pieces of one score merge from the left
        # The pieces' prefixes as a tree: node k + 1 is reached by key k = (node before, character).
        keys: dict[int, int] = {}
        ranks = {0: _NO_RANK}
        for rank, (piece, _, _) in enumerate(table):
            node = 0
            for c in piece.replace(MARK, " "):
                node = keys.setdefault(node << 21 | ord(c), len(keys) + 1)
            ranks.setdefault(node, rank)
        self.keys = np.fromiter(keys, np.int64, len(keys))
        self.rank_at = np.array([ranks.get(n, _NO_RANK) for n in range(len(keys) + 1)], np.int32)
        self.byte_ids = np.array(model.byte_ids, np.uint32)
        # What each id decodes to.
        out = [b""] * (1 + max(*(i for _, i, _ in model.table), *model.byte_ids, model.unk))
        for piece, i, _ in model.table:
            out[i] = piece.replace(MARK, " ").encode()
        for b, i in enumerate(model.byte_ids):
            out[i] = bytes([b])
        out[model.unk] = " \u2047 ".encode()
        self.table = out

    @cached_property
    def _join(self) -> pa.Array:
        return pa.array(self.keys)

    def edges(self, points: np.ndarray, room: np.ndarray) -> np.ndarray:
        """ranks[i, l - 1]: the rank of the piece that begins at character i and has l of them. room: characters from i to
        the end of its word. Explodes substrings by length and joins them to the table's prefixes, while there are any."""
        out = np.full((len(points), self.longest), _NO_RANK, np.int32)
        at, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        for l in range(self.longest):
            if l:
                fits = room[at] > l
                at, node = at[fits], node[fits]
            if not len(at):
                break
            found = pc.index_in(pa.array(node << 21 | points[at + l]), value_set=self._join)
            hit = np.asarray(found.is_valid())
            at, node = at[hit], found.drop_null().to_numpy().astype(np.int64) + 1
            out[at, l] = self.rank_at[node]
        return out

    def merged(self, ranks: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """BPE: where segments begin, after merging each word's best adjacent pair (the leftmost of equals) until none is left.
        A word takes one merge per round; all words take it together. ends: of the word, for every character."""
        n = len(ranks)
        here = np.arange(n)
        end, before, inner = here + 1, here - 1, np.zeros(n, bool)

        def key(a: np.ndarray) -> np.ndarray:
            """Rank and place of the pair of the segment at a and the next one."""
            b = end[a]
            some = b < ends[a]
            length = end[np.where(some, b, a)] - a
            some &= length <= self.longest
            rank = ranks[a, np.where(some, length, 1) - 1]
            return np.where(some & (rank < _NO_RANK), self.order[np.minimum(rank, len(self.order) - 1)] << 32 | a, _NO_KEY)

        best = key(here)
        while True:
            top = np.minimum.reduceat(best, starts)
            top = top[top < _NO_KEY]
            if not len(top):
                return np.flatnonzero(~inner)
            a = top & 0xFFFFFFFF
            b = end[a]
            end[a], inner[b], best[b] = end[b], True, _NO_KEY
            after = a[end[a] < ends[a]]
            before[end[after]] = after
            best[a] = key(a)
            p = before[a]
            p = p[(p >= 0) & (ends[p] == ends[a])]
            best[p] = key(p)

    def best_paths(self, ranks: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Unigram: where the segments of each word's best path begin; of equals that whose last segment is longest."""
        worst = self.score_of_rank.min() - UNKNOWN_PENALTY
        score = np.full((len(ranks), self.longest), -np.inf)
        known = ranks < _NO_RANK
        score[known] = self.score_of_rank[ranks[known]]
        score[~known[:, 0], 0] = worst
        stops = ends[starts]
        best, last = np.zeros(len(ranks) + len(starts)), np.zeros(len(ranks) + len(starts), np.int64)
        base = starts + np.arange(len(starts))  # place of a word's zeroth state
        words = np.arange(len(starts))
        for k in range(1, int((stops - starts).max(initial=0)) + 1):
            words = words[stops[words] - starts[words] >= k]
            top, length = np.full(len(words), -np.inf), np.zeros(len(words), np.int64)
            for l in range(1, min(k, self.longest) + 1):
                into = best[base[words] + k - l] + score[starts[words] + k - l, l - 1]
                better = into >= top
                top[better], length[better] = into[better], l
            best[base[words] + k], last[base[words] + k] = top, length
        begins = np.zeros(len(ranks), bool)
        at, words = stops - starts, np.arange(len(starts))
        while len(words):
            at = at - last[base[words] + at]
            begins[starts[words] + at] = True
            on = at > 0
            at, words = at[on], words[on]
        return np.flatnonzero(begins)

    def ids(self, words: pa.Array) -> pa.Array:
        """The ids (4 bytes each) of every word."""
        lengths = pc.utf8_length(words).to_numpy().astype(np.int64)
        out, a = [pa.array([], pa.binary())], 0
        upto = np.cumsum(lengths)
        while a < len(words):
            if lengths[a] > LONG:
                out.append(pa.array([self._long(words[a].as_py())], pa.binary()))
                a += 1
                continue
            long = np.flatnonzero(lengths[a:] > LONG)[:1]
            most = a + int(long[0]) if len(long) else len(words)
            b = min(most, max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + AT_ONCE, "right"))))
            out.append(self._side_by_side(words.slice(a, b - a), lengths[a:b]))
            a = b
        return pa.concat_arrays(out)

    def _side_by_side(self, words: pa.Array, lengths: np.ndarray) -> pa.Array:
        data = b"".join(words.cast(pa.binary()).to_pylist())
        points = np.frombuffer(data.decode().encode("utf-32-le"), "<u4").astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        ends = np.repeat(starts + lengths, lengths)
        ranks = self.edges(points, ends - np.arange(len(points)))
        begins = (self.merged if self.model.kind == "bpe" else self.best_paths)(ranks, starts, ends)
        segment = np.minimum(np.append(begins[1:], len(points)), ends[begins]) - begins
        rank = ranks[begins, np.minimum(segment, self.longest) - 1]
        known = rank < _NO_RANK
        raw = np.frombuffer(data, np.uint8)
        first = np.append(np.flatnonzero(raw & 0xC0 != 0x80), len(raw))  # first byte of every character
        count = np.where(known | (not len(self.byte_ids)), 1, first[begins + 1] - first[begins])
        place = np.cumsum(count) - count
        ids = np.full(count.sum(), self.model.unk, "<u4")
        ids[place[known]] = self.id_of_rank[rank[known]]
        if len(self.byte_ids):
            for k in range(4):
                some = ~known & (count > k)
                ids[place[some] + k] = self.byte_ids[raw[first[begins[some]] + k]]
        at = np.searchsorted(begins, np.append(starts, len(points)))
        offsets = 4 * np.append(place, len(ids))[at]
        return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids)])

    @cached_property
    def _pieces(self) -> dict[str, int]:
        return {p.replace(MARK, " "): k for k, p in enumerate(x[0] for x in sorted(self.model.table, key=lambda x: -x[2]))}

    def _long(self, word: str) -> bytes:
        cuts, ids = self._heap(word) if self.model.kind == "bpe" else self._path(word), []
        for a, b in zip(cuts, cuts[1:]):
            rank = self._pieces.get(word[a:b])
            if rank is not None:
                ids.append(int(self.id_of_rank[rank]))
            else:
                ids += [int(self.byte_ids[x]) for x in word[a:b].encode()] if len(self.byte_ids) else [self.model.unk]
        return np.array(ids, "<u4").tobytes()

    def _heap(self, word: str) -> list[int]:
        n, ranks = len(word), self._pieces
        after, before, ends, gone = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), bytearray(n)
        heap = []

        def offer(a: int) -> None:
            b = after[a]
            if b < n and ends[b] - a <= self.longest and (rank := ranks.get(word[a : ends[b]])) is not None:
                heapq.heappush(heap, (int(self.order[rank]), a, ends[b]))

        for a in range(n - 1):
            offer(a)
        while heap:
            _, a, end = heapq.heappop(heap)
            b = after[a]
            if gone[a] or b >= n or ends[b] != end:
                continue
            gone[b], ends[a], after[a] = 1, end, after[b]
            if after[b] < n:
                before[after[b]] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        return [a for a in range(n) if not gone[a]] + [n]

    def _path(self, word: str) -> list[int]:
        worst = self.score_of_rank.min() - UNKNOWN_PENALTY
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            options = [(best[end - n][0] + self.score_of_rank[self._pieces[p]], n) for n in range(1, min(end, self.longest) + 1) if (p := word[end - n : end]) in self._pieces]
            if not any(n == 1 for _, n in options):
                options.append((best[end - 1][0] + worst, 1))
            best.append(max(options))
        cuts, at = [len(word)], len(word)
        while at:
            at -= best[at][1]
            cuts.append(at)
        return cuts[::-1]


def valid_text(texts) -> pa.Array:
    """A string column as one array, nulls as empty texts, bytes that are not UTF-8 replaced."""
    texts = pc.fill_null(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, "")
    try:
        return texts.cast(pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in texts.cast(pa.binary()).to_pylist()], pa.string())


def cut_words(texts: pa.Array, prefix: bool) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Each word's number among the distinct ones, where each text's words begin, and the distinct words. A word: spaces and
    what follows, up to the next space or line break; line breaks stand alone."""
    if prefix:
        texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(" ", texts, ""))
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    raw = np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]]
    at = (at - at[0]).astype(np.int64)
    begins = np.ones(len(raw) + 1, bool)
    space, line = raw == 32, raw == 10
    begins[1:-1] = line[1:] | line[:-1] | (space[1:] & ~space[:-1])
    begins[at] = True
    places = np.flatnonzero(begins)
    words = pa.Array.from_buffers(pa.string(), len(places) - 1, [None, pa.py_buffer(places.astype(np.int32)), pa.py_buffer(raw)]).dictionary_encode()
    return words.indices.to_numpy(zero_copy_only=False), np.searchsorted(places, at), words.dictionary


class Coder:
    """Encodes and decodes texts in batches; a task's own, gone with it."""

    def __init__(self, lattice: Lattice, memory: int = MEMORY):
        self.lattice, self.known = lattice, Remembered(lattice.ids, memory)
        self.table = pa.array(lattice.table, pa.binary())

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin (one more entry than texts)."""
        texts = pc.replace_substring(valid_text(texts), MARK, " ")
        codes, starts, words = cut_words(texts, self.lattice.model.prefix)
        each = self.known(words).take(pa.array(codes))
        if not len(each):
            return np.zeros(0, "<u4"), np.zeros(len(starts), np.int64)
        _, offsets, data = each.buffers()
        at = np.frombuffer(offsets, np.int32)[each.offset : each.offset + len(each) + 1][starts].astype(np.int64) // 4
        return np.frombuffer(data or b"", "<u4"), at

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> Iterator[bytes]:
        """The bytes of every text. starts: where each text's ids begin."""
        parts = self.table.take(pa.array(ids))
        if not len(parts):
            yield from [b""] * (len(starts) - 1)
            return
        _, offsets, data = parts.buffers()
        at = np.frombuffer(offsets, np.int32)[parts.offset : parts.offset + len(parts) + 1][starts].tolist()
        view = memoryview(data or b"")
        drop = self.lattice.model.prefix
        for a, b in zip(at, at[1:]):
            yield bytes(view[a + (drop and view[a : a + 1] == b" ") : b])

    def decodes_back(self, ids: np.ndarray, starts: np.ndarray, texts) -> list[bool]:
        """Whether the decoded text is the text (U+2581 as a space)."""
        want = pc.replace_substring(valid_text(texts), MARK, " ").cast(pa.binary()).to_pylist()
        return [x == y for x, y in zip(self.decode(ids, starts), want)]


def encode(docs: DataFrame, model: Pieces, read_back: bool = False) -> DataFrame:
    """doc_id, n_pieces, ids; and decodes_back as in digest, if they are to be read back."""
    lattice = Lattice(model)

    @tidy
    def run(batches):
        c = Coder(lattice)
        for table in pieces(batches, 4 << 20):
            ids, starts = c.encode(table["text"])
            lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids.astype(np.int32)))
            columns = {"doc_id": table["doc_id"].combine_chunks(), "n_pieces": pa.array(np.diff(starts)), "ids": lists}
            if read_back:
                columns["decodes_back"] = pa.array(c.decodes_back(ids, starts, table["text"]), pa.bool_())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_pieces long, ids array<int>" + ", decodes_back boolean" * read_back)


def decode(encoded: DataFrame, model: Pieces) -> DataFrame:
    """doc_id, text from doc_id, ids. Null ids decode to the empty text."""
    lattice = Lattice(model)

    @tidy
    def run(batches):
        c = Coder(lattice)
        for b in batches:
            lists = b.column("ids")
            starts = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)))
            texts = [x.decode("utf-8", "replace") for x in c.decode(lists.flatten().to_numpy(zero_copy_only=False), starts)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


DIGEST = "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, decodes_back boolean"


def digest(docs: DataFrame, model: Pieces) -> DataFrame:
    """Encode and decode every document: counts, crc32 of the ids (little-endian, 4 bytes each), and whether the decoded
    text is the text (U+2581 as a space)."""
    lattice = Lattice(model)

    @tidy
    def run(batches):
        c = Coder(lattice)
        is_byte = np.zeros(len(lattice.table), bool)
        is_byte[list(model.byte_ids)] = True
        for table in pieces(batches, 4 << 20):
            ids, starts = c.encode(table["text"])
            of_bytes = np.append(0, np.cumsum(is_byte[ids]))[starts]
            sums = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), starts[1:].tolist())]
            columns = {
                "doc_id": table["doc_id"].combine_chunks(),
                "n_pieces": pa.array(np.diff(starts)),
                "n_byte_pieces": pa.array(np.diff(of_bytes)),
                "ids_crc32": pa.array(sums, pa.int64()),
                "decodes_back": pa.array(c.decodes_back(ids, starts, table["text"]), pa.bool_()),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.select("doc_id", "text").mapInArrow(run, DIGEST)

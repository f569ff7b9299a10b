"""Token ids in binary files: one id array over all documents, document boundaries in Elias-Fano code.

A file holds one shard of documents in ascending doc_id order (nulls last, ties by text): a magic, the ids (2 or 4 bytes
each), the Elias-Fano code of the cumulative lengths, the doc_ids, and a footer with the sections' places. The manifest
(Parquet) lists the files; the ids before a file are the sum over the files before it. Files appear under their name only
when whole, and writing a shard again gives the same bytes.

Texts are encoded word by word where the tokenizer's settings show that it never joins tokens over white space: then a
text's ids are those of its words in a row, and a Python worker encodes a distinct word once while its bounded memory holds it.
Other tokenizers encode whole texts.

Defined cases: a null or empty text has only the end id; repeated rows are documents of their own; an empty table gives no
file and an empty result; other columns are ignored, whatever their names. A text's ids are built in one piece, however
long it is.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Remembered, kept, pieces, split_words, to_bytes, work_path
from .eliasfano import EliasFano
from .shards import Committed, batch_of, filesystem, shard_bounds, with_shard

MAGIC = b"IDSEF001"
SHARD_BYTES = 32 << 20
#: Bytes of words and of their ids that a Python worker remembers, about.
MEMORY = 48 << 20
#: Tokenizer settings under which words can be encoded one by one: white space parts words and is dropped, case is ignored,
#: and a letter is always cut from what is no letter. (Fixed values of the tokenizer file format.)
BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
    "post_processor": None,
}


def cuts_at_space(settings: dict) -> bool:
    """Whether a text's ids are those of its words in a row, and those of a word are those of its stem and its end."""
    special = all("<" in t["content"] and not t["content"].split()[1:] and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in settings["added_tokens"])
    return special and not settings.get("truncation") and all(settings.get(k) == v for k, v in BY_WORD.items())


class Encoder:
    """Encodes texts with a tokenizer file. Where its settings allow, every distinct word is encoded once while the bounded
    memory holds it: words are split, numbered and looked up by Arrow. Else each text is encoded as a whole."""

    def __init__(self, path: str, memory: int = MEMORY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        settings = json.loads(self.tokenizer.to_str())
        self.by_word = cuts_at_space(settings)
        self.stems = Remembered(self._new, memory)
        # Which tokens end a run of letters: the vocabulary marks them with a suffix.
        suffix, vocabulary = settings["model"].get("end_of_word_suffix"), self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _plain(self, texts: list[bytes], at_once: int) -> pa.Array:
        out = []
        for a in range(0, len(texts), at_once):
            part = [t.decode("utf-8", "replace") for t in texts[a : a + at_once]]
            out += [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        return pa.array(out, pa.binary())

    def _new(self, words: pa.Array) -> pa.Array:
        """The ids of stems. Those of letters only are encoded many at a time, with spaces between, and told apart by the
        tokens that end a word; should those be of another number, one by one."""
        letters = pc.match_substring_regex(words, "^\\pL+$")
        some, others = words.filter(letters), words.filter(pc.invert(letters))
        out = []
        for a in range(0, len(some), 1024):
            part = some.slice(a, 1024)
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part.to_pylist())], add_special_tokens=False)[0].ids, self.kind)
            last = np.flatnonzero(self.ends[ids])
            if len(last) != len(part):
                out.append(self._plain(to_bytes(part), 4096))
                continue
            at = np.append(0, last + 1).astype(np.int32) * self.kind.itemsize
            out.append(pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(at), pa.py_buffer(ids)]))
        found = pa.concat_arrays([*out, self._plain(to_bytes(others), 4096)])
        mask = letters.to_numpy(zero_copy_only=False)
        return found.take(pa.array(np.where(mask, np.cumsum(mask) - 1, len(some) + np.cumsum(~mask) - 1)))

    def _ids_of(self, words: pa.Array) -> pa.Array:
        """The ids of distinct words. A stem is a word in lower case without a full stop or comma behind its last letter;
        words with '<' keep their case, as special tokens heed it."""
        lower = pc.if_else(pc.match_substring(words, "<"), words, pc.ascii_lower(words))
        stems = pc.replace_substring_regex(lower, "([a-z])[.,]$", "\\1")
        cut = pc.not_equal(pc.binary_length(stems), pc.binary_length(lower))
        ends = pc.if_else(cut, pc.if_else(pc.ends_with(lower, "."), ".", ","), "")
        stems, ends = stems.dictionary_encode(), ends.dictionary_encode()
        return pc.binary_join_element_wise(self.stems(stems.dictionary).take(stems.indices), self._plain(to_bytes(ends.dictionary), 8).take(ends.indices), b"")

    def encode_all(self, texts) -> list[bytes | memoryview]:
        """The ids of every text of a column, as bytes; a null text has none."""
        if not self.by_word:
            return self._plain([t or b"" for t in to_bytes(texts)], 64).to_pylist()
        codes, starts, words = split_words(texts)
        each = self._ids_of(words).take(pa.array(codes))
        _, ends, data = each.buffers()
        if not len(each):
            return [b""] * (len(starts) - 1)
        at = np.frombuffer(ends, np.int32)[each.offset : each.offset + len(each) + 1][starts].tolist()
        view = memoryview(data or b"")
        return [view[a:b] for a, b in zip(at, at[1:])]


MANIFEST = "file string, shard int, docs long, ids long, bytes long, sha256 string"


class _Shard:
    def __init__(self, path: str, shard: int, kind: np.dtype):
        self.file, self.hash, self.kind, self.shard = Committed(path, f"ids-{shard:06d}.bin"), hashlib.sha256(), kind, shard
        self.doc_ids, self.lengths = [], []
        self._write(MAGIC)

    def _write(self, data: bytes | memoryview) -> None:
        self.file.write(data)
        self.hash.update(data)

    def add(self, doc_id: int | None, *parts: bytes | memoryview) -> None:
        for ids in parts:
            self._write(ids)
        self.doc_ids.append(doc_id)
        self.lengths.append(sum(map(len, parts)) // self.kind.itemsize)

    def close(self) -> tuple:
        ends = np.concatenate([[0], np.cumsum(self.lengths)])
        sections = [EliasFano.of(ends).to_bytes(), np.array([x or 0 for x in self.doc_ids], "<i8").tobytes(), np.packbits([x is None for x in self.doc_ids]).tobytes()]
        at, places = self.file.size, []
        for s in sections:
            self._write(s)
            places.append((at, len(s)))
            at += len(s)
        footer = json.dumps({"docs": len(self.lengths), "ids": int(ends[-1]), "kind": self.kind.str, "sections": places}).encode()
        self._write(footer + struct.pack("<Q", len(footer)) + MAGIC)
        return self.file.commit(), self.shard, len(self.lengths), int(ends[-1]), self.file.size, self.hash.hexdigest()


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode all texts with the tokenizer file and write them below path; returns the manifest."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text")
    sizes = rows.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    bounds = shard_bounds(sizes, "doc_id", max(1, -(-total // shard_bytes)), "n")
    sharded = with_shard(rows, "doc_id", bounds).repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_last(), "text")

    def write(batches):
        coder, out, done = kept(("ids", tokenizer), lambda: Encoder(tokenizer)), None, []
        end = np.array([end_id], coder.kind).tobytes()
        for table in pieces(batches):
            ids = coder.encode_all(table["text"])
            for doc_id, shard, data in zip(table["doc_id"].to_pylist(), table["shard"].to_pylist(), ids):
                if out is None or out.shard != shard:
                    done += [out.close()] if out else []
                    out = _Shard(path, shard, coder.kind)
                out.add(doc_id, data, end)
        done += [out.close()] if out else []
        yield batch_of(done, ["file", "shard", "docs", "ids", "bytes", "sha256"], [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()])

    sharded.mapInArrow(write, MANIFEST).write.parquet(f"{path}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


class IdFile:
    """Random access to a written file: ids(i) reads only document i's ids."""

    def __init__(self, path: str, name: str):
        fs, root = filesystem(path)
        self.file = fs.open_input_file(f"{root}/{name}")
        size = self.file.size()
        tail = self.file.read_at(8 + len(MAGIC), size - 8 - len(MAGIC))
        if tail[8:] != MAGIC:
            raise ValueError(f"{name} is not whole")
        length = struct.unpack("<Q", tail[:8])[0]
        footer = json.loads(self.file.read_at(length, size - 8 - len(MAGIC) - length))
        self.docs, self.n_ids, self.kind = footer["docs"], footer["ids"], np.dtype(footer["kind"])
        ends, ids, nulls = (self.file.read_at(n, at) for at, n in footer["sections"])
        self.ends = EliasFano.from_bytes(ends)
        none = np.unpackbits(np.frombuffer(nulls, np.uint8))[: self.docs]
        self.doc_ids = [None if x else int(i) for i, x in zip(np.frombuffer(ids, "<i8"), none)]

    def slice(self, start: int, stop: int) -> np.ndarray:
        w = self.kind.itemsize
        return np.frombuffer(self.file.read_at((stop - start) * w, len(MAGIC) + start * w), self.kind)

    def ids(self, i: int) -> np.ndarray:
        return self.slice(self.ends[i], self.ends[i + 1])


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids before it in the whole corpus), n_tokens and ids_crc32 of every document, from the files."""
    files = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    before = F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = files.select("file", before.alias("base")).repartition(spark.sparkContext.defaultParallelism, "file")

    def read(batches):
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                f = IdFile(path, name)
                first, start = 0, 0
                while first < f.docs:
                    # Documents of about a million ids at a time; every boundary is selected from the code.
                    ends = [start]
                    while first + len(ends) <= f.docs and ends[-1] - start < 1 << 20:
                        ends.append(f.ends[first + len(ends)])
                    data = f.slice(start, ends[-1]).astype("<u4")
                    rows = [(f.doc_ids[first + k], base + a, b - a, zlib.crc32(data[a - start : b - start])) for k, (a, b) in enumerate(zip(ends, ends[1:]))]
                    yield batch_of(rows, ["doc_id", "start", "n_tokens", "ids_crc32"], [pa.int64()] * 4)
                    first, start = first + len(rows), ends[-1]

    return files.mapInArrow(read, READ)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1, **options) -> DataFrame:
    path = work_path(docs.sparkSession, "ids")
    write_ids(docs, path, tokenizer, end_id, **options)
    return read_ids(docs.sparkSession, path)

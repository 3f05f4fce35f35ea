"""Token ids in bit-plane files.

A file holds the ids of consecutive documents, as unsigned 32-bit integers:

    magic `WMPLANE1` | per block: its planes, each a zstandard frame | document table, a zstandard frame | index | tail

A block is BLOCK ids. Its bytes are transposed: all lowest bytes, all second bytes, ... (byte planes), or, where that
compresses better, all lowest bits, ... (bit planes). Planes that are all zero take no bytes. The index has a row per
block: offset, ids, kind of plane, number of planes, and then the bytes of each plane. The document table (Arrow) has
the id and length of each document. The tail holds the places of both. So any block can be read alone.

Files go through pyarrow's file systems (local and shared paths, object stores, HDFS), under a temporary name first, so
an attempt that is lost leaves nothing under the final one, and one that is repeated writes the same bytes again.
"""

from __future__ import annotations

import re
import struct
import json
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import public_tokenizers
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.common import batched, cut, like, shared_dir
from waymark.llm.token_count import tokenizer

MAGIC, BLOCK = b"WMPLANE1", 65_536
TAIL = struct.Struct("<QQQQ8s")  # place of the document table, place of the index, blocks, documents


def _planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4).T
    if not bits:
        return [row.tobytes() for row in raw]
    return [np.packbits((row >> b) & 1).tobytes() for row in raw for b in range(8)]


def encode_block(ids: np.ndarray, level: int = 1) -> tuple[int, list[bytes]]:
    """(1 for bit planes, else 0; the planes, compressed; zero planes are empty, and absent at the end). Bit planes are
    tried on the first 4096 ids."""
    c = zstandard.ZstdCompressor(level=level)
    pack = lambda part, bits: [c.compress(p) if p.count(0) != len(p) else b"" for p in _planes(part, bits)]
    size = lambda bits: sum(map(len, pack(ids[:4096], bits)))
    kind = int(size(True) < size(False))
    planes = pack(ids, bool(kind))
    while planes and not planes[-1]:
        planes.pop()
    return kind, planes


def decode_block(kind: int, planes: list[bytes], n: int) -> np.ndarray:
    d = zstandard.ZstdDecompressor()
    out = np.zeros((4, n), np.uint8)
    for k, p in enumerate(planes):
        if p:
            row = np.frombuffer(d.decompress(p), np.uint8)
            if kind:
                out[k // 8] |= np.unpackbits(row, count=n) << (k % 8)
            else:
                out[k] = row
    return np.ascontiguousarray(out.T).view("<u4").reshape(-1)


class Writer:
    """Writes documents one after another; holds one block of ids at most, and the document lengths."""

    def __init__(self, sink, block: int = BLOCK):
        self.sink, self.block, self.at = sink, block, 0
        self.held: list[np.ndarray] = []
        self.n, self.names, self.lengths, self.index = 0, [], [], []
        self._put(MAGIC)

    def _put(self, raw: bytes) -> None:
        self.sink.write(raw)
        self.at += len(raw)

    def add(self, name, ids: np.ndarray) -> None:
        self.names.append(name)
        self.lengths.append(len(ids))
        self.held.append(ids)
        self.n += len(ids)
        if self.n >= self.block:
            self._flush(False)

    def _flush(self, all_: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        i = 0
        while len(ids) - i >= self.block or (all_ and i < len(ids)):
            part = ids[i : i + self.block]
            kind, planes = encode_block(part)
            self.index.append((self.at, len(part), kind, [len(p) for p in planes]))
            for p in planes:
                self._put(p)
            i += len(part)
        self.held, self.n = [ids[i:].copy()], len(ids) - i

    def close(self, name_type: pa.DataType) -> None:
        self._flush(True)
        docs_at = self.at
        table = pa.table({"id": pa.array(self.names, name_type), "n": pa.array(self.lengths, pa.int64())})
        with pa.ipc.new_stream(out := pa.BufferOutputStream(), table.schema) as w:
            w.write_table(table)
        self._put(zstandard.ZstdCompressor().compress(out.getvalue().to_pybytes()))
        index_at = self.at
        for offset, n, kind, sizes in self.index:
            self._put(struct.pack(f"<QIBB{len(sizes)}I", offset, n, kind, len(sizes), *sizes))
        self._put(TAIL.pack(docs_at, index_at, len(self.index), len(self.lengths), MAGIC))


class Reader:
    """Random access to the blocks of a file (an open pyarrow input file)."""

    def __init__(self, source):
        self.source, size = source, source.size()
        docs_at, index_at, blocks, docs, magic = TAIL.unpack(source.read_at(TAIL.size, size - TAIL.size))
        if magic != MAGIC or source.read_at(8, 0) != MAGIC:
            raise ValueError("not a token file")
        table = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(source.read_at(index_at - docs_at, docs_at))).read_all()
        self.names, self.lengths = table["id"].combine_chunks(), table["n"].to_numpy()
        raw, i, self.index = source.read_at(size - TAIL.size - index_at, index_at), 0, []
        for _ in range(blocks):
            offset, n, kind, planes = struct.unpack_from("<QIBB", raw, i)
            self.index.append((offset, n, kind, struct.unpack_from(f"<{planes}I", raw, i + 14)))
            i += 14 + 4 * planes
        if len(self.lengths) != docs:
            raise ValueError("the document table is damaged")

    def block(self, k: int) -> np.ndarray:
        offset, n, kind, sizes = self.index[k]
        raw, planes, i = self.source.read_at(sum(sizes), offset), [], 0
        for s in sizes:
            planes.append(raw[i : i + s])
            i += s
        return decode_block(kind, planes, n)

    def documents(self) -> Iterator[np.ndarray]:
        """The ids of each document in turn; one block and one document in memory."""
        k, held = 0, np.zeros(0, np.uint32)
        for length in self.lengths:
            parts, n = [held], len(held)
            while n < length:
                parts.append(self.block(k))
                n += len(parts[-1])
                k += 1
            whole = np.concatenate(parts) if len(parts) > 1 else held
            yield whole[:length]
            held = whole[length:]


#: A run of these letters is one pre-token, which no normalization but lower-casing changes.
WORD_ALONE = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: ASCII marks after a word are a pre-token of their own: but not apostrophes ('s), nor what begins special tokens.
MARKS = "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"
BEYOND_LATIN = "[^\\x{00}-\\x{ff}]"
#: How the special tokens begin.
SPECIAL = "<|"
#: Pieces that a worker remembers in each of two generations.
REMEMBERED = 200_000
#: Pieces that a worker remembers in columns, at some 50 bytes each; bytes of texts that it looks up at once.
TABLED, TOGETHER = 1_000_000, 8 << 20


class PieceEncoder:
    """Ids of pieces without white space, as bytes of little-endian 32-bit integers, by the tokenizers library. Pieces that
    are one word go to it many at a time, and come apart again at the tokens that end a word. It remembers pieces; the older
    of two generations goes when the younger is full."""

    def __init__(self, path: str, together: int = 256):
        self.t, self.together = tokenizer(path), together
        vocabulary = self.t.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _alone(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.t.encode_batch_fast(pieces, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        groups = [words[i : i + self.together] for i in range(0, len(words), self.together)]
        out: list[bytes] = []
        for group, e in zip(groups, self.t.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            raw, ends = ids.tobytes(), (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            out += [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)] if len(ends) == len(group) else self._alone(group)
        return out

    def _unknown(self, pieces: set[str]) -> set[str]:
        """Those of pieces that aren't remembered; those of the older generation come into the younger."""
        new = pieces.difference(self.known)
        if self.older and (back := new.intersection(self.older)):
            self.known.update(zip(back, map(self.older.__getitem__, back), strict=True))
            new -= back
        return new

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids of (at least) these pieces."""
        new = self._unknown(pieces)
        words, marked, other = [], [], []
        for p in new:
            word = p.rstrip(MARKS)
            if (word.isascii() and word.isalpha()) or WORD_ALONE.fullmatch(word):
                if len(word) == len(p):
                    words.append(p)
                else:
                    marked.append((p, word, p[len(word) :]))
            else:
                other.append(p)
        parts = self._unknown({m[1] for m in marked}.difference(new))
        words += parts
        other += self._unknown({m[2] for m in marked}.difference(new))
        known = self.known
        known.update(zip(words, self._words(words), strict=True))
        known.update(zip(other, self._alone(other), strict=True))
        for p, word, marks in marked:
            known[p] = known[word] + known[marks]
        return known

    def age(self) -> None:
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}


def lowered(pieces: pa.Array) -> pa.Array:
    """The tokenizer lower-cases character by character; where Arrow does the same, it is done first, so that fewer pieces
    differ. But the tokenizer looks for its special tokens before it lower-cases, so pieces that may hold one (or something
    like one) stay as they are."""
    kept = pc.or_(pc.match_substring(pieces, SPECIAL), pc.match_substring_regex(pieces, BEYOND_LATIN))
    return pc.if_else(kept, pieces, pc.utf8_lower(pieces))


def split_pieces(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """What stands between spaces, tabs and line ends: (number of pieces in each text, all pieces); empty pieces may occur.
    Vertical tabs and form feeds, at which ascii_split_whitespace splits too, don't end a piece."""
    odd = any(pc.any(pc.match_substring(texts, c)).as_py() for c in "\x0b\x0c")
    lists = pc.split_pattern_regex(texts, "[ \t\n\r]+") if odd else pc.ascii_split_whitespace(texts)
    return pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten()


class PieceTable:
    """Ids of pieces in columns, for many pieces at a time: each distinct piece of a call is looked up once, those not in the
    table are learned from a PieceEncoder. Beyond `most` rows the half used last stays. Row 0 is no piece but the end id."""

    def __init__(self, path: str, end_id: int | None, most: int = TABLED):
        self.encoder, self.most, self.calls = PieceEncoder(path), most, 0
        self.names = pa.array([""], pa.large_string()).slice(1)
        self.ids = np.array([] if end_id is None else [end_id], "<u4")
        self.start, self.n, self.used = np.zeros(1, np.int64), np.full(1, len(self.ids)), np.zeros(1, np.int64)

    def rows(self, pieces: pa.Array) -> np.ndarray:
        """The row of each piece."""
        self.calls += 1
        coded = pieces.dictionary_encode()
        low = lowered(coded.dictionary).dictionary_encode()
        distinct = low.dictionary
        at = pc.index_in(distinct, value_set=self.names)
        new = distinct.filter(at.is_null())
        row = at.fill_null(-1).to_numpy().astype(np.int64) + 1
        if len(new):
            row[row == 0] = len(self.n) + np.arange(len(new))
            self._add(new)
        self.used[row] = self.calls
        return row[low.indices.to_numpy()][coded.indices.to_numpy()]

    def _add(self, new: pa.Array) -> None:
        pieces = new.to_pylist()
        known = self.encoder.learn(set(pieces))
        raw = [known[p] for p in pieces]
        self.encoder.age()
        n = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        self.start = np.concatenate((self.start, len(self.ids) + np.cumsum(n) - n))
        self.n, self.used = np.concatenate((self.n, n)), np.concatenate((self.used, np.zeros(len(n), np.int64)))
        self.ids = np.concatenate((self.ids, np.frombuffer(b"".join(raw), "<u4")))
        self.names = pa.concat_arrays([self.names, new])

    def ids_of(self, rows: np.ndarray) -> np.ndarray:
        """The ids of these rows, one after another."""
        n = self.n[rows]
        return self.ids[np.repeat(self.start[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    def age(self) -> None:
        if len(self.names) > self.most:
            kept = 1 + np.sort(np.argsort(self.used[1:], kind="stable")[-(self.most // 2) :])
            rows = np.concatenate(([0], kept))
            self.ids, self.names = self.ids_of(rows), self.names.take(pa.array(kept - 1))
            self.n, self.used = self.n[rows], self.used[rows]
            self.start = np.cumsum(self.n) - self.n


def by_piece(path: str) -> bool:
    """Whether a text's ids are those of its lower-cased pieces between white space, as the tokenizer's own file says: it
    lower-cases, makes white space single spaces, and keeps of a text only what a pattern finds that can't hold a space."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    steps = lambda x, many: x.get(many, [x]) if x else []
    norms, first = steps(said.get("normalizer"), "normalizers"), next(iter(steps(said.get("pre_tokenizer"), "pretokenizers")), {})
    kinds = {n["type"] for n in norms}
    spaces = any(n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " " for n in norms)
    words = first.get("type") == "Split" and first["behavior"] == "Removed" and first["invert"] and "Regex" in first["pattern"]
    return bool(kinds <= {"NFC", "Replace", "Lowercase"} and "Lowercase" in kinds and spaces and words and not regex.search(first["pattern"]["Regex"], " "))


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int | None):
    """texts (a list or an Arrow array) -> their ids (with end_id), as bytes of little-endian 32-bit integers: by pieces where
    the tokenizer allows it, else by the library on whole texts."""
    if by_piece(path):
        return piece_encoder(path, end_id)
    t, end = tokenizer(path), np.array([] if end_id is None else [end_id], "<u4").tobytes()

    def whole(texts: list[str | None] | pa.Array) -> list[bytes]:
        given = [x or "" for x in (texts if isinstance(texts, list) else texts.to_pylist())]
        out: list[bytes] = []
        for i in range(0, len(given), 64):
            out += [np.array(e.ids, "<u4").tobytes() + end for e in t.encode_batch_fast(given[i : i + 64], add_special_tokens=False)]
        return out

    return whole


def piece_encoder(path: str, end_id: int | None):
    """texts (a list or an Arrow array) -> their ids (with end_id), as bytes of little-endian 32-bit integers. The tokenizer
    drops white space, so a text's ids are those of its pieces, and each worker process encodes every distinct piece once
    while it remembers it, from task to task. What it remembers is found for all pieces of many texts at once, not by a step
    of Python for each."""
    table = PieceTable(path, end_id)

    def encode(texts: list[str | None] | pa.Array) -> list[bytes]:
        whole = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        whole = whole.fill_null("")
        share = np.cumsum(pc.binary_length(whole).to_numpy()) // TOGETHER
        cuts = np.flatnonzero(share[1:] != share[:-1]) + 1 if len(share) else share
        out: list[bytes] = []
        for i, j in zip([0, *cuts], [*cuts, len(whole)], strict=True):
            pieces, flat = split_pieces(whole.slice(i, j - i))
            ends = np.cumsum(pieces)
            rows = np.insert(table.rows(flat), ends, 0)
            upto = np.cumsum(table.n[rows])[ends + np.arange(len(ends))] * 4
            raw = table.ids_of(rows).tobytes()
            out += [raw[a:b] for a, b in zip([0, *upto.tolist()], upto.tolist(), strict=False)]
            table.age()
        return out

    return encode


def gathered(batches: Iterator[pa.RecordBatch], size: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in batches of about `size` bytes or more, without empty ones."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held += [batch] * bool(batch.num_rows)
        if sum(b.nbytes for b in held) >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def write_tokens(df: DataFrame, to: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int | None = 2) -> DataFrame:
    """Encode every text, write the ids in ascending id order to files `to`/part-<n>.wmp, and return the manifest: a row
    per file with its number, path, documents, tokens, and start (the ids in all files before it).

    Ids of a file are consecutive in the order (id nulls first, then text); the rows are range-partitioned over that
    order, so repeated ids don't gather in one task. Null and empty texts hold end_id alone. `to` must be a folder that
    all executors share. Token ids never travel: each task encodes the texts of its range and writes them. An empty
    table writes no file."""
    batched(df.sparkSession)
    path = path or public_tokenizers.path("word_bpe_49k.json")
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    tie = F.xxhash64("text")
    placed = rows.repartitionByRange("id", tie).sortWithinPartitions("id", tie, "text").withColumn("part", F.spark_partition_id())
    fs_, root = pa.fs.FileSystem.from_uri(to)
    fs_.create_dir(root, recursive=True)
    schema = "part int, file string, docs long, tokens long"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer, tokens = encoder(path, end_id), None, 0
        fs, top = pa.fs.FileSystem.from_uri(to)
        for batch in gathered(batches):
            if writer is None:
                part = batch.column(2)[0].as_py()
                draft, final = f"{top}/_{part}-{uuid.uuid4().hex}", f"{top}/part-{part:06d}.wmp"
                sink = fs.open_output_stream(draft)
                writer = Writer(sink)
            kind = batch.column(0).type
            for name, raw in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                writer.add(name, np.frombuffer(raw, "<u4"))
                tokens += len(raw) // 4
        if writer is not None:
            writer.close(kind)
            sink.close()
            fs.move(draft, final)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [f"part-{part:06d}.wmp"], "docs": pa.array([len(writer.lengths)], pa.int64()), "tokens": pa.array([tokens], pa.int64())})

    made = cut(placed.mapInArrow(write, schema))
    run = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return made.withColumn("start", F.coalesce(F.sum("tokens").over(run), F.lit(0)))


def read_tokens(spark: SparkSession, manifest: DataFrame, at: str, id_field: T.StructField) -> DataFrame:
    """The documents of the files in a manifest, all from the files: id, start, n_tokens, ids_crc32 (of the ids as
    little-endian unsigned 32-bit integers). A task reads a file, block by block."""
    names = [id_field.name, "start", "n_tokens", "ids_crc32"]
    schema = T.StructType([id_field, *(T.StructField(c, T.LongType()) for c in names[1:])])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pa.fs.FileSystem.from_uri(at)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(f"{top}/{row['file']}") as source:
                    reader = Reader(source)
                    crcs = [zlib.crc32(ids.astype("<u4").tobytes()) for ids in reader.documents()]
                starts = row["start"] + np.concatenate(([0], np.cumsum(reader.lengths)))[:-1]
                for i in range(0, len(crcs), 100_000):
                    j = min(len(crcs), i + 100_000)
                    yield pa.RecordBatch.from_arrays([reader.names[i:j], pa.array(starts[i:j], pa.int64()), pa.array(reader.lengths[i:j], pa.int64()), pa.array(crcs[i:j], pa.int64())], names)

    files = manifest.select("part", "file", "start")
    return files.repartitionByRange(max(1, manifest.count()), "part").mapInArrow(read, schema)


def store_and_read(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", to: str | None = None, **options) -> DataFrame:
    """write_tokens to a new folder in the shared one (or to `to`), then read_tokens."""
    to = to or f"{shared_dir(df.sparkSession)}/tokens-{uuid.uuid4().hex}"
    return read_tokens(df.sparkSession, write_tokens(df, to, id_col, text_col, **options), to, like(df, id_col))

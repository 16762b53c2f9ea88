"""Packing of token ids into sequences of a fixed length, online and in bounded space."""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import small_batches, text_or_empty, written

LENGTH = 1024
OPEN = 32
#: Partitions whose leftover windows are merged by one task.
MERGED = 64
#: White space beside the single space and the line feed: such texts go to the tokenizer whole.
ODD_SPACE = re.compile(r"[^\S\x20\n]")
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class ByteEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, remembering the chunks between spaces.

    The tokenizer's own pattern always parts a text before a space that a non-space follows and
    around a line feed between non-spaces, so such chunks can be encoded one by one; other texts
    (runs of white space, other white space, special tokens) go to the tokenizer whole. A punctuation mark after a
    (ASCII) letter is a chunk's own last part too.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str, remember: int = 300_000) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(json_path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.remember = remember

        class Chunks(dict):
            def __missing__(self, chunk: str) -> bytes:
                if chunk[-1:] in ".,!?;:" and chunk[-2:-1].isalpha() and chunk[-2:-1].isascii():
                    ids = self[chunk[:-1]] + self[chunk[-1]]
                else:
                    ids = array("I", encode(chunk)).tobytes()
                self[chunk] = ids
                return ids

        self.chunks = Chunks()

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if ODD_SPACE.search(text) or any(s in text for s in self.special):
            return self.exactly(text)
        get = self.chunks.__getitem__
        if len(self.chunks) > self.remember:
            self.chunks.clear()
        out: list[bytes] = []
        for k, line in enumerate(text.split("\n")):
            words = line.split(" ")
            if "" in words:  # runs of white space, or white space at an end
                return self.exactly(text)
            if k:
                out.append(get("\n"))
            out.append(get(words[0]))
            out += map(get, [" " + w for w in words[1:]])
        return b"".join(out)

    def exactly(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()


class Windows:
    """At most OPEN windows: best fit; when none fits, the fullest is filled from the piece and closed."""

    def __init__(self, first_id: int, length: int, most: int) -> None:
        self.next, self.length, self.most = first_id, length, most
        self.open: list[list] = []  # [used, rows]

    def number(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self, doc: int | None, start: int, end: int, ids: bytes, total: int) -> Iterator[tuple]:
        """Rows of closed sequences that [start, end) of a document's ids gives rise to."""

        def row(a: int, b: int) -> tuple:
            return doc, a, b - a, zlib.crc32(memoryview(ids)[4 * a : 4 * b]), total

        while end - start >= self.length:
            yield (*row(start, start + self.length), self.number(), 0)
            start += self.length
        while start < end:
            need = end - start
            fits = [w for w in self.open if self.length - w[0] >= need]
            if fits:
                best = max(fits, key=lambda w: w[0])
            elif len(self.open) < self.most:
                best = [0, []]
                self.open.append(best)
            else:
                best = max(self.open, key=lambda w: w[0])
            cut = min(end, start + self.length - best[0])
            best[1].append((*row(start, cut), best[0]))
            best[0] += cut - start
            start = cut
            if best[0] == self.length:
                self.open.remove(best)
                number = self.number()
                for *piece, offset in best[1]:
                    yield (*piece, number, offset)


def _packer(paths: tuple[str, str, str], length: int, most: int):  # noqa: ANN202
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encode, windows = ByteEncoder(*paths), Windows(part << 33, length, most)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "left_in", "used"]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 9, names)

        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) + b"\0\0\0\0"
                rows += [(*r, None, None) for r in windows.place(doc, 0, len(ids) // 4, ids, len(ids) // 4)]
            yield out(rows)
        rows = []
        for used, pieces in windows.open:
            number = windows.number()
            rows += [(*piece, number, offset, part, used) for *piece, offset in pieces]
        yield out(rows)

    return pack


def _merged(length: int, most: int):  # noqa: ANN202
    def merge(key: tuple, table: pa.Table) -> pa.Table:
        """Best fit of whole leftover windows, largest first; each has a place in one sequence."""
        sizes = sorted(zip(table["used"].to_pylist(), table["sequence_id"].to_pylist()), reverse=True)
        number, free, placed = (1 << 62) + (key[0].as_py() << 33), [[] for _ in range(length + 1)], []
        for used, window in sizes:
            room = next((r for r in range(used, length + 1) if free[r]), None)
            if room is None:
                at, room = number, length
                number += 1
            else:
                at = free[room].pop()
            placed.append((window, at, length - room))
            if room - used:
                free[room - used].append(at)
        return pa.table([pa.array(c, pa.int64()) for c in zip(*placed)], ["_window", "_sequence", "_shift"])

    return merge


def packed(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, length: int = LENGTH, open_windows: int = OPEN) -> DataFrame:
    """Pieces of every whole text: ids, then id 0, cut into sequences of at most ``length``.

    Each task keeps ``open_windows`` open windows, places what remains of a document best-fit,
    and when none fits fills the fullest from the piece and emits it; full stretches of a long
    document are sequences of their own. What tasks leave open is merged best-fit by groups of
    64 partitions, whole windows at a time. A null text is empty (id 0 alone), repeated rows are
    packed each by itself, an empty table gives no piece. Columns beside doc_id and text are not
    read.
    """
    small_batches(docs.sparkSession)
    pack = _packer((json_path, ranks_path, pattern), length, open_windows)
    rows = docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(pack, f"{PIECE}, sequence_id long, offset long, left_in long, used long")
    rows = written(rows, "packing")
    done = rows.where(F.col("left_in").isNull()).drop("left_in", "used")
    left = rows.where(F.col("left_in").isNotNull())
    windows = left.select("sequence_id", "used", F.floor(F.col("left_in") / MERGED).alias("_group")).distinct()
    placed = windows.groupBy("_group").applyInArrow(_merged(length, open_windows), "_window long, _sequence long, _shift long")
    moved = left.drop("left_in", "used").join(placed, F.col("sequence_id") == F.col("_window"))
    columns = [c for c in done.columns if c not in ("sequence_id", "offset")]
    return done.unionByName(moved.select(*columns, F.col("_sequence").alias("sequence_id"), (F.col("offset") + F.col("_shift")).alias("offset")))


def op4_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as files

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packed(docs, files.path("byte_bpe_50k.json"), files.path("byte_bpe_50k.tiktoken"), files.PATTERN)

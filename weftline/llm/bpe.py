"""BPE ids of texts from a table of distinct words, and texts back from ids."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import packed_groups, scan_bytes, small_batches, text_or_empty, unpacked_groups, written

#: Bytes of source files behind one group of documents and one bucket of words.
GROUP_BYTES = 16 << 20
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
SEPARATOR = "\n"


def group_of(key: Column, groups: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(groups)).cast("int")


def distinct_words(texts: Iterable[pa.Table]) -> list[str]:
    """Distinct words of texts, in order of first place; the tokenizer drops the white space between."""
    found: dict[str, None] = {}
    for table in texts:
        for text in table["text"]:
            found.update(dict.fromkeys(SPLIT.findall(text.as_py())))
    return list(found)


def squeezed(data: bytes) -> bytes:
    import zstandard

    return len(data).to_bytes(8, "little") + zstandard.ZstdCompressor(level=3).compress(data)


def unsqueezed(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data[8:], max_output_size=int.from_bytes(data[:8], "little"))


def split_words(data: bytes) -> list[str]:
    return unsqueezed(data).decode().split(SEPARATOR)


def by_bucket(words: Iterable[str], buckets: int) -> list[list[str]]:
    """Words by bucket, sorted: the same lists for the same words, in whatever order texts come."""
    lists: list[list[str]] = [[] for _ in range(buckets)]
    for word in words:
        lists[zlib.crc32(word.encode()) % buckets].append(word)
    for x in lists:
        x.sort()
    return lists


def word_lists(grouped: DataFrame, buckets: int) -> DataFrame:
    """By group of documents and bucket of words: the group's distinct words that fall there, compressed."""

    def listed(key: tuple, table: pa.Table) -> pa.Table:
        lists = by_bucket(distinct_words(unpacked_groups(table)), buckets)
        rows = [(b, squeezed(SEPARATOR.join(x).encode())) for b, x in enumerate(lists) if x]
        return pa.table([pa.array([key[0].as_py()] * len(rows), pa.int32()), pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["grp", "bucket", "words"])

    return grouped.groupBy("grp").applyInArrow(listed, "grp int, bucket int, words binary")


def encoded_words(lists: DataFrame, json_path: str) -> DataFrame:
    """The ids of the words of ``lists``, in their order: a bucket has all lists of its words, and encodes each word once.

    ids: how many ids each word has, then all ids end to end (unsigned 32-bit, compressed).
    """

    def encode(key: tuple, table: pa.Table) -> pa.Table:
        tokenizer = tokenizer_of(json_path)
        lists = [split_words(w) for w in table["words"].to_pylist()]
        number: dict[str, int] = {}
        for words in lists:
            for w in words:
                number.setdefault(w, len(number))
        distinct, ids = list(number), []
        for a in range(0, len(distinct), 20_000):
            ids += [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(distinct[a : a + 20_000], add_special_tokens=False)]
        count = np.array([len(x) for x in ids], np.uint32)
        packed = []
        for words in lists:
            at = [number[w] for w in words]
            # Byte planes: the high ones are nearly all zero and cost nothing.
            planes = np.concatenate([count[at], *[ids[k] for k in at]]).astype("<u4").view(np.uint8).reshape(-1, 4).T
            packed.append(squeezed(np.ascontiguousarray(planes).tobytes()))
        return pa.table([table["grp"].combine_chunks(), table["bucket"].combine_chunks(), pa.array(packed, pa.binary())], ["grp", "bucket", "ids"])

    return lists.groupBy("bucket").applyInArrow(encode, "grp int, bucket int, ids binary")


_tokenizers: dict[str, object] = {}


def tokenizer_of(json_path: str):  # noqa: ANN201
    """The tokenizer of a file, once a process; unused truncation and padding are switched off."""
    if json_path not in _tokenizers:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(json_path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _tokenizers[json_path] = tokenizer
    return _tokenizers[json_path]


def pieces_of(json_path: str) -> list[str | None]:
    """The id-to-piece table: the piece of each id, bounded by the vocabulary."""
    tokenizer = tokenizer_of(json_path)
    return [tokenizer.id_to_token(k) for k in range(tokenizer.get_vocab_size(with_added_tokens=True))]


class WordTable:
    """A group's words with their ids."""

    def __init__(self, lists: list[list[str]], table: pa.Table) -> None:
        self.rows: dict[str, tuple[int, ...]] = {}
        for bucket, ids in zip(table["bucket"].to_pylist(), table["ids"].to_pylist()):
            words = lists[bucket]
            flat = np.ascontiguousarray(np.frombuffer(unsqueezed(ids), np.uint8).reshape(4, -1).T).view("<u4").ravel().tolist()
            end = len(words)
            if sum(flat[:end]) != len(flat) - end:
                raise ValueError("the documents changed between the passes over them")
            for word, n in zip(words, flat[:end]):
                self.rows[word] = tuple(flat[end : end + n])
                end += n

    def __call__(self, text: str) -> list[int]:
        """The ids of a text, in the order of its words."""
        return list(chain.from_iterable(map(self.rows.__getitem__, SPLIT.findall(text))))


def text_of(ids: Iterable[int], pieces: list[str]) -> str:
    """The text of ids by the id-to-piece table: this vocabulary has no decoder of its own, pieces are joined by spaces."""
    return " ".join(map(pieces.__getitem__, ids))


def encoded(docs: DataFrame, json_path: str, digests: bool = False, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, n_tokens, ids and decoded text of every whole text (or the two digests of these).

    Documents are dealt into groups by a hash of doc_id. A first pass lists each group's distinct
    words by bucket; a bucket encodes each of its words once, whatever groups have it; a second
    pass joins the ids back by group, in the order of its sorted words, and puts them in the
    words' positions. The ids are then decoded through the id-to-piece table. A null text is empty: no ids. Repeated rows each have a
    result, an empty table has none.
    """
    small_batches(docs.sparkSession)
    groups = max(1, -(-scan_bytes(docs) // group_bytes))
    pieces = docs.sparkSession.sparkContext.broadcast([p or "" for p in pieces_of(json_path)])
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    grouped = packed_groups(rows, group_of(F.col("doc_id"), groups), groups)
    tables = written(encoded_words(word_lists(grouped, groups), json_path), "words")
    names = ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]

    def joined(key: tuple, texts: pa.Table, words: pa.Table) -> pa.Table:
        parts = list(unpacked_groups(texts))
        table = WordTable(by_bucket(distinct_words(parts), groups), words)
        decimal = list(map(str, range(len(pieces.value))))
        doc, n, ids, shown = [], [], [], []
        for part in parts:
            doc += part["doc_id"].to_pylist()
            for text in part["text"]:
                own = table(text.as_py())
                n.append(len(own))
                a, b = " ".join(map(decimal.__getitem__, own)), text_of(own, pieces.value)
                ids.append(hashlib.sha256(a.encode()).hexdigest() if digests else a)
                shown.append(hashlib.sha256(b.encode()).hexdigest() if digests else b)
        return pa.table([pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(shown, pa.string())], names)

    return grouped.groupBy("grp").cogroup(tables.groupBy("grp")).applyInArrow(joined, f"doc_id long, n_tokens long, {names[2]} string, {names[3]} string")


def decoded(rows: DataFrame, json_path: str, ids: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``: the text of an array column of ids, through the id-to-piece join.

    Pieces are looked up in the table of the whole vocabulary (bounded); an unknown id has no
    piece, a null array has no text.
    """
    pieces = rows.sparkSession.sparkContext.broadcast(pieces_of(json_path))

    @F.pandas_udf("string")
    def shown(column: pd.Series) -> pd.Series:
        table = pieces.value
        return column.map(lambda x: None if x is None else text_of([i for i in x if 0 <= i < len(table) and table[i] is not None], table))

    return rows.withColumn("decoded", shown(F.col(ids)))


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as files

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encoded(docs, files.path("word_bpe_49k.json"), digests=True)

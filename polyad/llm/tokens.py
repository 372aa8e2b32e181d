"""Encoding a corpus with a public byte-level tokenizer, whole texts of any length."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyad.plans.session import need

#: Where the public vocabulary files lie; a parameter of every function here.
ROOT = "/opt/tokenizers"
NAME = "byte_bpe_50k"
#: Texts longer than CHUNK characters are cut; neighbouring chunks share 2 * OVERLAP characters.
CHUNK, OVERLAP = 32_768, 1_024
#: Boundaries this near to the cut end of a chunk may depend on characters beyond it.
BLIND = 8
# Fixed value: the published pre-token pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(4)
def _ranks(root: str, name: str) -> dict[bytes, int]:
    with open(f"{root}/{name}.tiktoken", "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(4)
def _fast(root: str, name: str):
    import tiktoken

    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=_ranks(root, name), special_tokens={})


@lru_cache(4)
def _steady(root: str, name: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{root}/{name}.json")
    t.encode_special_tokens = True
    return t


@lru_cache(1)
def _pattern():
    import regex

    return regex.compile(PATTERN)


def encode_text(text: str | None, root: str = ROOT, name: str = NAME) -> list[int]:
    """Ids of one text; null and empty texts give an empty list. The fast encoder's regular
    expression engine overflows its stack on runs of some hundred thousand blanks; the other
    library of the same vocabulary then takes over."""
    if not text:
        return []
    try:
        return _fast(root, name).encode_ordinary(text)
    except BaseException as e:
        if isinstance(e, (KeyboardInterrupt, SystemExit, GeneratorExit)):
            raise
        return _steady(root, name).encode(text, add_special_tokens=False).ids


_STOPS = frozenset("\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f")


def _kana_or_han(c: str) -> bool:
    return "\u3041" <= c <= "\u3096" or "\u30a1" <= c <= "\u30fa" or "\u4e00" <= c <= "\u9fa5"


def boundaries(text: str) -> list[int]:
    """End offsets of the pre-tokens of ``text`` at which it can be parted: before a plain blank and
    not after one, or, for scripts without blanks, between a full stop or comma of theirs and a letter
    of theirs, which every version of Unicode has as such. A run of blanks is split differently if nothing follows it, and at other places
    regular expression engines may know different versions of Unicode's classes."""
    ends = (m.end() for m in _pattern().finditer(text))
    return [e for e in ends if e < len(text) and (text[e] in " \t\r\n" and not text[e - 1].isspace() or text[e - 1] in _STOPS and _kana_or_han(text[e]))]


def _lists(rows: list[list[int]]) -> pa.Array:
    sizes = np.fromiter((len(r) for r in rows), np.int64, len(rows))
    flat = np.fromiter(chain.from_iterable(rows), np.int32, int(sizes.sum()))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat))


def _encode(root: str, name: str, count_only: bool, tail: int):
    """mapInArrow function: the last column is the text, the ``tail`` columns before it stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):  # keeps batches of long id lists small
                part = b.slice(at, 512)
                ids = [encode_text(t, root, name) for t in part.column(tail).to_pylist()]
                out = pa.array([len(x) for x in ids], pa.int64()) if count_only else _lists(ids)
                yield pa.RecordBatch.from_arrays([*part.columns[:tail], out], names=[*part.schema.names[:tail], "ids"])

    return run


def _cut_up(chunk: int, overlap: int):
    """Rows (ident, rid, text) as rows (ident, rid, i, n, off, text) of overlapping chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r, (rid, text) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                n = -(-len(text) // chunk)
                for i in range(n):
                    a = max(0, i * chunk - overlap)
                    cols = [b.column(0).slice(r, 1), pa.array([rid], pa.int64()), pa.array([i], pa.int32()), pa.array([n], pa.int32()), pa.array([a], pa.int64()), pa.array([text[a : (i + 1) * chunk + overlap]])]
                    yield pa.RecordBatch.from_arrays(cols, names=["ident", "rid", "i", "n", "off", "text"])

    return run


def _pre_tokenise(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = b.to_pydict()
            heads, tails = [], []
            for i, n, off, text in zip(d["i"], d["n"], d["off"], d["text"], strict=True):
                ends = np.array(boundaries(text), np.int64)
                if i < n - 1:
                    ends = ends[ends < len(text) - BLIND]
                ends = ends + off
                heads.append(ends[(ends <= i * chunk + overlap)] if i else ends[:0])
                tails.append(ends[(ends >= (i + 1) * chunk - overlap)] if i < n - 1 else ends[:0])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(heads, longs), pa.array(tails, longs)], names=[*b.schema.names, "head", "tail"])

    return run


def encode(texts: DataFrame, ident: str = "doc_id", text: str = "text", root: str = ROOT, name: str = NAME, count_only: bool = False, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(ident, ids array<int>), or with ``count_only`` (ident, n_tokens), one row per input row.

    Ids have no special tokens; a string that looks like one is ordinary text. Null and empty
    texts give an empty list (0), blank texts are encoded. Repeated rows come out repeated, a
    null ident stays null, other columns are ignored, an empty table gives no rows.

    Texts of up to ``chunk`` characters are encoded where they lie, without a shuffle. Longer ones
    are cut into overlapping chunks that are pre-tokenised in parallel; two neighbours are cut at
    the first pre-token boundary that both found in their overlap, from which on they agree, and
    the pieces between cuts are encoded in parallel and put together. A text with a joint at which
    its chunks share no boundary (a run without a break longer than the overlap) is encoded whole.
    """
    need(texts, ident, text)
    kind = dict(texts.dtypes)[ident]
    last = "ids long" if count_only else "ids array<int>"
    src = texts.select(F.col(ident).alias("ident"), F.col(text).cast("string").alias("text"))
    is_long = F.length("text") > chunk
    short = src.where(~F.coalesce(is_long, F.lit(False))).mapInArrow(_encode(root, name, count_only, 1), f"ident {kind}, {last}")
    long = src.where(is_long).withColumn("rid", F.monotonically_increasing_id())
    shape = f"ident {kind}, rid long, i int, n int, off long, text string"
    pieces = long.select("ident", "rid", "text").mapInArrow(_cut_up(chunk, overlap), shape)
    found = pieces.repartition("rid", "i").mapInArrow(_pre_tokenise(chunk, overlap), shape + ", head array<long>, tail array<long>")
    w = Window.partitionBy("rid").orderBy("i")
    found = found.withColumn("cut", F.when(F.col("i") == 0, F.lit(0).cast("long")).otherwise(F.array_min(F.array_intersect(F.lag("tail").over(w), "head"))))
    found = found.withColumns({"lost": F.max(F.col("cut").isNull()).over(Window.partitionBy("rid")), "next": F.lead("cut").over(w)})
    a = F.when(F.col("lost"), F.col("i") * F.lit(chunk).cast("long")).otherwise(F.col("cut")) - F.col("off")
    z = F.when(F.col("i") == F.col("n") - 1, F.length("text").cast("long")).otherwise(F.when(F.col("lost"), (F.col("i") + 1) * F.lit(chunk).cast("long")).otherwise(F.col("next")) - F.col("off"))
    piece = F.substring(F.col("text"), (a + 1).cast("int"), (z - a).cast("int"))
    parts = found.select("ident", "rid", F.when(F.col("lost"), 0).otherwise(F.col("i")).alias("g"), "i", piece.alias("piece"))
    parts = parts.groupBy("rid", "g").agg(F.first("ident").alias("ident"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "piece"))), lambda x: x["piece"]), "").alias("text"))
    ids = parts.repartition("rid", "g").select("rid", "g", "ident", "text").mapInArrow(_encode(root, name, count_only, 3), f"rid long, g int, ident {kind}, {last}")
    if count_only:
        whole = ids.groupBy("rid").agg(F.first("ident").alias("ident"), F.sum("ids").alias("ids"))
    else:
        whole = ids.groupBy("rid").agg(F.first("ident").alias("ident"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("g", "ids"))), lambda x: x["ids"])).alias("ids"))
    return short.unionByName(whole.select("ident", "ids")).select(F.col("ident").alias(ident), F.col("ids").alias("n_tokens" if count_only else "ids"))


def decode(encoded: DataFrame, ident: str = "doc_id", ids: str = "ids", root: str = ROOT, name: str = NAME) -> DataFrame:
    """(ident, text): the bytes of the ids put together and read as UTF-8. Null lists give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id = {i: b for b, i in _ranks(root, name).items()}
        for b in batches:
            out = [None if x is None else b"".join([by_id[i] for i in x]).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=[ident, "text"])

    return encoded.select(ident, ids).mapInArrow(run, f"`{ident}` {dict(encoded.dtypes)[ident]}, text string")

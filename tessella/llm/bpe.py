"""Byte-level BPE: overlapping chunks are pre-tokenised apart, stitched, and encoded."""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a chunk and of its overlap with the next.
CHUNK, OVERLAP = 32_768, 512
#: Encoded pieces that a worker remembers at most, and rows of a batch it gives back.
CACHE, ROWS = 200_000, 256


class Codec(dict):
    """Ranks and pattern of a byte-level BPE, where the id of a byte string is its rank; as a
    dictionary, the ids of pre-tokens as little-endian 32-bit integers, encoded when first met."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        super().__init__()
        self.pattern = regex.compile(pattern)
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.merge = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def __missing__(self, piece: str) -> bytes:
        ids = self.merge(piece.encode("utf-8", "surrogatepass"))
        found = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = found
        return found

    def encode(self, pieces: list[str]) -> bytes:
        return b"".join([self[p] for p in pieces])

    def decode(self, ids: bytes) -> bytes:
        """The raw bytes of all ids one after the other."""
        table = self.bytes
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])


@lru_cache(maxsize=4)
def load(path: str, pattern: str) -> Codec:
    """One codec for each worker process, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return Codec(ranks, pattern)


def spans(length: int, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Start and end of the overlapping chunks of a text."""
    return [(s, min(length, s + chunk + overlap)) for s in range(0, max(length, 1), chunk)]


def boundaries(codec: Codec, text: str) -> np.ndarray:
    """Where the pre-tokens of a chunk start, and its end."""
    ends = np.cumsum([len(p) for p in codec.pattern.findall(text)], dtype=np.int64)
    return np.concatenate([np.zeros(1, np.int64), ends])


def stitch(codec: Codec, text: str, starts: list[tuple[int, np.ndarray]], chunk_ends: list[int]) -> np.ndarray:
    """All pre-token boundaries of a text from those of its chunks.

    What follows a boundary depends on the text after it alone. So where two neighbours share
    a boundary inside their overlap they agree from there on, except that a chunk's last
    pre-token may be cut short: it is never trusted. Where they share none (one pre-token spans
    the overlap) the text is matched onward from the last sure boundary until they do.
    """
    sure = starts[0][1] + starts[0][0]
    if chunk_ends[0] < len(text):
        sure = sure[:-2] if len(sure) > 2 else sure[:1]
    parts = [sure]
    for (begin, own), end in zip(starts[1:], chunk_ends[1:], strict=True):
        mine = own + begin
        if end < len(text):
            mine = mine[:-2] if len(mine) > 2 else mine[:1]
        last = parts[-1]
        tail = last[np.searchsorted(last, begin):]
        # The chunk's first boundary is where it was cut, so it only counts if its neighbour has it too.
        met = tail[np.isin(tail, mine, assume_unique=True)]
        if len(met):
            at = int(met[0])
            parts[-1] = last[: np.searchsorted(last, at)]
        else:
            at, more, there, end = int(last[-1]), [], set(mine.tolist()), int(mine[-1])
            while at < end and at not in there:
                at = codec.pattern.match(text, at).end()
                if at not in there:
                    more.append(at)
            if more:
                parts.append(np.asarray(more, np.int64))
            if at not in there:
                continue
        parts.append(mine[np.searchsorted(mine, at):])
    return np.concatenate(parts)


def encode_text(codec: Codec, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> bytes:
    """The ids of a text, by chunks in one process."""
    if len(text) <= chunk + overlap:
        return codec.encode(codec.pattern.findall(text))
    cuts = spans(len(text), chunk, overlap)
    return encode_cut(codec, text, [(s, boundaries(codec, text[s:e])) for s, e in cuts], [e for _, e in cuts])


def encode_cut(codec: Codec, text: str, starts: list[tuple[int, np.ndarray]], ends: list[int]) -> bytes:
    at = stitch(codec, text, starts, ends).tolist()
    if not at or at[-1] != len(text):
        at.append(len(text))
    return codec.encode([text[a:b] for a, b in zip(at, at[1:])])


def _found(codec: Codec, ids: bytes, decoded: bool) -> dict:
    return {"ids": ids, "data": codec.decode(ids)} if decoded else {"ids": ids}


def _short(path: str, pattern: str, decoded: bool) -> Callable:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = load(path, pattern)
        for frame in frames:
            for at in range(0, len(frame), ROWS):
                part = frame.iloc[at : at + ROWS].reset_index(drop=True)
                found = pd.DataFrame([_found(codec, codec.encode(codec.pattern.findall(t)), decoded) for t in part["text"]])
                found.insert(0, "doc_id", part["doc_id"])
                yield found

    return run


def _cuts(path: str, pattern: str) -> Callable:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = load(path, pattern)
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "key": frame["key"], "n": frame["n"], "begin": frame["begin"], "text": frame["text"], "at": [boundaries(codec, t).astype("<i8").tobytes() for t in frame["text"]]})

    return run


def _join(path: str, pattern: str, chunk: int, decoded: bool) -> Callable:
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        codec = load(path, pattern)
        copies = int((frame["begin"] == 0).sum())
        frame = frame.drop_duplicates("begin").sort_values("begin")
        text = "".join(t[:chunk] for t in frame["text"][:-1]) + frame["text"].iloc[-1]
        starts = [(int(b), np.frombuffer(a, "<i8")) for b, a in zip(frame["begin"], frame["at"])]
        ids = encode_cut(codec, text, starts, [int(b) + len(t) for b, t in zip(frame["begin"], frame["text"])])
        return pd.DataFrame({"doc_id": frame["doc_id"].iloc[:1].repeat(copies), **{name: [value] * copies for name, value in _found(codec, ids, decoded).items()}})

    return run


def encode(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, decoded: bool = False) -> DataFrame:
    """(doc_id, ids): every row's ids as little-endian 32-bit integers in one binary value.

    With `decoded`, a third column `data` holds the bytes that the ids decode to, found by the same
    worker, so that a round trip needs one Python process a task.

    Null texts count as empty and give no ids. A text of one chunk is encoded where it is read.
    Longer ones are cut into chunks that are dealt out and pre-tokenised apart, then meet per
    text to be stitched and encoded, whole. Rows that repeat id and text meet as one and come
    back as often as they were. `path` must exist on every executor.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = "doc_id string, ids binary" + ", data binary" * decoded
    # A string carries null and large ids unchanged through pandas.
    base = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text.alias("text"))
    limit = chunk + overlap
    short = base.where(F.length("text") <= limit).mapInPandas(_short(path, pattern, decoded), schema)
    begin = F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(chunk)))
    parts = base.where(F.length("text") > limit).withColumn("key", F.sha2("text", 256)).select("doc_id", "key", F.length("text").alias("n"), "text", begin.alias("begin"))
    parts = parts.select("doc_id", "key", "n", "begin", F.substring(F.col("text"), F.col("begin") + 1, F.lit(limit)).alias("text"))
    parts = parts.repartition("key", "begin").mapInPandas(_cuts(path, pattern), "doc_id string, key string, n int, begin int, text string, at binary")
    long = parts.groupBy("doc_id", "key").applyInPandas(_join(path, pattern, chunk, decoded), schema)
    return short.unionByName(long).withColumn("doc_id", F.col("doc_id").cast(kind))


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, data): the raw bytes of each row's ids; null ids give null."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = load(path, pattern)
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "ids": frame["ids"], "data": [None if i is None else codec.decode(i) for i in frame["ids"]]})

    base = encoded.select(F.col("doc_id").cast("string").alias("doc_id"), "ids")
    return base.mapInPandas(run, "doc_id string, ids binary, data binary").withColumn("doc_id", F.col("doc_id").cast(kind))


def query(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The op4 digest: ids and decoded bytes as checksums."""
    import public_tokenizers

    path, pattern = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    out = encode(docs, path, pattern, decoded=True)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))

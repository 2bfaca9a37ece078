"""Packing documents into fixed windows: best-fit decreasing on a segment tree of capacities."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.session import cut

#: Production parameters: tokens of a window, the id that ends a document, and the tokens that one task packs.
WINDOW, END_ID, GROUP = 2048, 1, 4_000_000
#: Encoded words that a worker remembers at most, bytes of text whose words are looked up at once, and rows it gives back at once.
CACHE, CHUNK, ROWS = 400_000, 1 << 20, 2_000
#: Bytes of a word that is parted here; longer ones go through the whole tokenizer and are not remembered.
LONG = 64


class Words(dict):
    """The ids of blank-free words (UTF-8) as little-endian 32-bit integers.

    The tokenizer's pre-tokens never hold a blank and its normaliser acts inside words, so a
    text's ids are those of its words one after the other. A word of plain Latin characters is
    its own normal form but for capitals; it is parted by the tokenizer's pattern here and its
    parts go to the merges, many at once: the last id of a part is the only one that ends a
    word, which tells the parts' ids apart. All other words, those with other white space and
    those that hold an added token, go through the whole tokenizer, as it is loaded.
    """

    PLAIN = re.compile("[ -~\u00a1-\u00ac\u00ae-\u00ff]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        with open(path, encoding="utf-8") as file:
            chain = json.load(file)
        normal, steps = chain["normalizer"]["normalizers"], chain["pre_tokenizer"]["pretokenizers"]
        known = [x["type"] for x in normal + steps] == ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"]
        suffix = chain["model"].get("end_of_word_suffix")
        self.pattern = regex.compile(steps[0]["pattern"]["Regex"] + "| ") if known and suffix else None
        self.added = re.compile("|".join(re.escape(t["content"]) for t in chain["added_tokens"]) or "(?!)")
        vocabulary = chain["model"]["vocab"]
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for token, k in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        # The byte level writes printable Latin bytes as themselves, and the others, in order, from U+0100 on.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in plain]
        # A blank parts the parts here and is never inside one.
        self.letter = {b: chr(0x100 + k) for k, b in enumerate(rest) if b != 0x20}
        self.parts: dict[str, bytes] = {}
        #: Words met in the texts at hand that are too long to be remembered.
        self.long: list[bytes] = []

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _merge(self, parts: list[str]) -> None:
        """Remember the ids of parts, each lower-case and without a blank."""
        plain = [p for p in parts if p.isascii()]
        rest = [p for p in parts if not p.isascii()]
        parts = plain + rest
        # Bytes of ASCII are written as themselves; only the rest is spelled out in the letters of the byte level.
        joined = " ".join([*plain, " ".join(rest).encode("utf-8").decode("latin-1").translate(self.letter)])
        ids = np.asarray(self.merges.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
        stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(stops) != len(parts) or (len(stops) and stops[-1] != 4 * len(ids)):
            raise ValueError("the merges do not end each part with one word end")
        data, stops = ids.tobytes(), stops.tolist()
        self.parts.update(zip(parts, [data[a:b] for a, b in zip([0, *stops], stops)]))

    def _learn(self, new: set[bytes]) -> None:
        """Remember the ids of words not met before."""
        joined = b" ".join(new).decode("utf-8", "surrogatepass")
        pairs = list(zip(new, joined.split(" ")))
        if self.pattern is None:
            plain, whole = [], pairs
        elif max(map(len, new)) <= LONG and self.PLAIN.fullmatch(joined) and not self.added.search(joined):
            plain, whole = pairs, []
        else:
            plain, whole = [], []
            for pair in pairs:
                (plain if len(pair[0]) <= LONG and self.PLAIN.fullmatch(pair[1]) and not self.added.search(pair[1]) else whole).append(pair)
        for word, text in whole:
            self[word] = self._whole(text)
        self.long = [word for word, _ in whole if len(word) > LONG]
        if not plain:
            return
        # All words are parted in one pass; a blank stands between two of them.
        flat = self.pattern.findall(" ".join([text for _, text in plain]).lower())
        fresh = set(flat).difference(self.parts)
        fresh.discard(" ")
        if fresh:
            self._merge(list(fresh))
        known, at, own = self.parts, 0, []
        for part in flat:
            if part == " ":
                self[plain[at][0]] = own[0] if len(own) == 1 else b"".join(own)
                at, own = at + 1, []
            else:
                own.append(known[part])
        self[plain[at][0]] = b"".join(own)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        # bytes.split() parts at the six ASCII blanks and nothing else.
        lists = [text.encode("utf-8", "surrogatepass").split() for text in texts]
        met = set().union(*lists)
        new = met.difference(self)
        if new:
            if len(self) + len(new) > CACHE:
                self.clear()
                self.parts.clear()
                new = met
            self._learn(new)
        found = [b"".join(map(self.__getitem__, words)) for words in lists]
        for word in self.long:
            del self[word]
        self.long = []
        return found


@lru_cache(maxsize=4)
def load(path: str) -> Words:
    return Words(path)


class Capacities:
    """Open windows in a segment tree over their remaining capacity, 1 to `size`.

    A node holds whether any leaf below it has a window; a leaf holds the windows with just
    that much room. Finding the tightest window, taking it and putting it back cost log(size).
    """

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.count = [0] * (2 * self.width)
        self.leaf: list[list] = [[] for _ in range(self.width)]

    def put(self, room: int, window) -> None:
        self.leaf[room].append(window)
        node, count = room + self.width, self.count
        while node:
            count[node] += 1
            node >>= 1

    def take(self, need: int):
        """(room, window) with the least room of at least `need`, or None; of equals the last opened."""
        count, node = self.count, need + self.width
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.width:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.width
        window = self.leaf[room].pop()
        while node:
            count[node] -= 1
            node >>= 1
        return room, window


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(window number, offset) of every piece: longest first, each into the tightest open window."""
    where, offset, found, open_ = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0, Capacities(window)
    for k in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[k])
        room, at = open_.take(need) or (window, None)
        if at is None:
            at, found = found, found + 1
        where[k], offset[k] = at, window - room
        if room > need:
            open_.put(room - need, at)
    return where, offset


def _encode(path: str, window: int, end_id: int) -> Callable:
    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list[str]]]:
        """Documents whose texts together have about CHUNK characters."""
        for frame in frames:
            names, texts, held = [], [], 0
            for name, text in zip(frame["doc_id"].tolist(), frame["text"].tolist()):
                names.append(name)
                texts.append(text)
                held += len(text)
                if held >= CHUNK or len(texts) >= ROWS:
                    yield names, texts
                    names, texts, held = [], [], 0
            yield names, texts

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, end = load(path), np.asarray([end_id], "<u4").tobytes()
        for names, texts in batches(frames):
            rows = []
            for name, ids in zip(names, words.encode(texts)):
                ids += end
                total = len(ids) // 4
                rows += [(name, start, min(window, total - start), ids[4 * start : 4 * (start + window)], total) for start in range(0, total, window)]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids", "doc_tokens"])

    return run


def pieces(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens.

    `ids` holds the piece's tokens as little-endian 32-bit integers: those of the tokenizer file
    as it is loaded, without special tokens put around a text (one that a text spells out is the
    tokenizer's own id for it). A document is its text's ids and `end_id`; a null or empty text
    is `end_id` alone. Documents over a window are cut into full windows and a rest. Repeated
    rows give pieces each; an empty table gives none. Texts of any length are read whole, where
    they lie. `path` must exist on every executor.
    """
    kind = docs.schema["doc_id"].dataType
    if kind.simpleString() not in ("bigint", "int", "smallint", "tinyint", "string"):
        raise TypeError(f"doc_id of type {kind.simpleString()} is not supported")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # A string carries a null id unchanged through pandas, where a column of integers would turn to floats.
    base = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text.alias("text"))
    out = base.mapInPandas(_encode(path, window, end_id), "doc_id string, start long, length long, ids binary, doc_tokens long")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def place(found: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """Add sequence_id and offset to pieces, rows with a `length` of 1 to `window`.

    The pieces are written out once. A full piece is a sequence of its own. The others, by their
    lengths alone, are dealt at random into groups of about `group` tokens, and each group is
    packed by one task, best fit decreasing. How the input was split into files or partitions
    does not matter: only the number of groups does, and a group leaves about one window open.
    Sequence ids are unique, not gapless; an empty table gives no rows.
    """
    rows = cut(found.withColumn("__row", F.monotonically_increasing_id()))
    rest = rows.where(F.col("length") < window).select(F.col("__row").alias("row"), "length")
    tokens = rest.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]
    groups = max(1, -(-tokens // group))

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("row")
        where, offset = best_fit(frame["length"].to_numpy(np.int64), window)
        return pd.DataFrame({"row": frame["row"], "sequence_id": (where * groups + key[0]) * 2, "offset": offset})

    dealt = rest.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(groups)))
    placed = dealt.groupBy("part").applyInPandas(run, "row long, sequence_id long, offset long")
    met = rows.where(F.col("length") < window).join(placed, F.col("__row") == F.col("row")).drop("row")
    full = rows.where(F.col("length") == window).withColumn("sequence_id", F.col("__row") * 2 + 1).withColumn("offset", F.lit(0).cast("long"))
    return full.unionByName(met).drop("__row")


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, group: int = GROUP) -> DataFrame:
    """The pieces of `docs` with their ids, each with its sequence_id and offset: see pieces() and place()."""
    return place(pieces(docs, path, window, end_id), window, group)


def padding(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row: sequences, tokens and padded tokens; a sequence whose length is a power of two is not padded."""
    sums = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    bare = F.col("n").bitwiseAND(F.col("n") - 1) == 0
    return sums.agg(F.count("*").alias("sequences"), F.sum("n").alias("tokens"), F.sum(F.when(bare, 0).otherwise(F.lit(window) - F.col("n"))).alias("padded"))


def query(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The op3 digest: the pieces with a checksum of their ids, taken before they are placed, so that no ids travel."""
    import public_tokenizers

    found = pieces(docs, path or public_tokenizers.path("word_bpe_49k.json"))
    return place(found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"))

"""Packing token sequences: minimum bin slack over the multiset of remaining lengths.

Documents are tokenised once and cut into full windows and a rest. The rests are packed on their
length histogram (at most `capacity` - 1 counts, however many documents): for each next window a
bitset subset-sum over the counts left finds the fullest reachable sum, backtracking gives the
multiset of lengths that reaches it, and that multiset is used for as many windows as its counts
allow. The list of such patterns is bounded by the histogram, not by the input. A task that cuts
pieces numbers them within each length as it goes; with the tasks' counts before it, a piece has its
rank among all of its length and looks its sequence and offset up.

Cases: a null or empty text is the end token alone; a null doc_id stays null; repeated rows are
packed as documents of their own; an empty table gives an empty result; extra columns are ignored;
very long runs of white space, which the faster encoder cannot hold, are left to `tokenizers`.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier.llm.common import bounded_batches, stored, table

CAPACITY, END = 2048, 1
#: Kept chunk encodings of a task; the memory is dropped when it is full.
MEMO = 150_000
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Where a piece stands: the task that cut it, and its place among that task's pieces of its length.
NUMBERED = f"{PIECE}, part long, inside long"
#: Characters encoded whole at once, and the run of white space beyond which the faster encoder's pattern overflows its stack.
SEGMENT, LONG_RUN = 1 << 18, 10_000
LONG_SPACE = re.compile(r"\s{%d}" % LONG_RUN)
#: Byte-level BPE files write bytes as printable characters: these stand for themselves.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def load_encoding(path: str):
    """A byte-level BPE file of `tokenizers` as an encoding of equal ids, whose lookups are faster."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    others = [b for b in range(256) if b not in PRINTABLE]
    to_byte = {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(others)}
    ranks = {bytes(to_byte[c] for c in token): i for token, i in vocab.items() if all(c in to_byte for c in token) and not token.startswith("<|")}
    return tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def added_tokens(path: str) -> dict[str, int]:
    """Tokens that the file takes out of a text before all else, and their ids; ones with rules of their own are refused."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)["added_tokens"]
    if any(t[k] for t in found for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens with rules of their own are not supported")
    return {t["content"]: t["id"] for t in found}


#: The pre-tokenisation that such files name by "ByteLevel" (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    """Token ids of many texts at once.

    A token never spans the place before a space that follows a non-space, so texts without a space
    followed by white space fall into chunks at spaces; each distinct chunk is encoded once. Other
    texts are encoded whole. All are cut at the file's added tokens first, as `tokenizers` does.
    """

    def __init__(self, path: str):
        self.path, self.encode, self.memo, self.slow = path, load_encoding(path).encode_ordinary, {}, None
        (self.newline,) = self.encode("\n")
        self.added = added_tokens(path)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def plain(self, text: str) -> list[int]:
        """The ids of a text without added tokens, in segments that end before a space after a non-space."""
        out, at = [], 0
        while at < len(text):
            end = at + SEGMENT
            while 0 < end < len(text) and (text[end] != " " or text[end - 1].isspace()):
                end = text.find(" ", end + 1)
            part = text[at:] if end < 0 or end >= len(text) else text[at:end]
            at += len(part)
            if not LONG_SPACE.search(part):
                out += self.encode(part)
                continue
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.path)
            out += self.slow.encode(part, add_special_tokens=False).ids
        return out

    def whole(self, text: str) -> np.ndarray:
        """The ids of one text, cut at added tokens."""
        if self.cut is None:
            return np.array(self.plain(text), np.uint32)
        return np.array([i for part in self.cut.split(text) for i in ([self.added[part]] if part in self.added else self.plain(part))], np.uint32)

    def learn(self, chunks: list[str]) -> None:
        """Encode new chunks: those without white space inside in one call, a newline (a token of its own) between."""
        if len(self.memo) > MEMO:
            self.memo = {}
        new = [c for c in chunks if c not in self.memo]
        simple = [c for c in new if len(w := c.split()) == 1 and (w[0] == c or c == " " + w[0])]
        flat = np.array(self.encode("\n".join(simple) + "\n"), np.uint32)
        ends = np.flatnonzero(flat == self.newline)
        if len(ends) == len(simple):
            data, begins = flat.tobytes(), np.concatenate([[0], ends[:-1] + 1])
            self.memo.update(zip(simple, [data[a:b] for a, b in zip((begins * 4).tolist(), (ends * 4).tolist(), strict=True)], strict=True))
        for c in new:
            if c not in self.memo:
                self.memo[c] = np.array(self.encode(c), np.uint32).tobytes()

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, where each text's ids begin and end)."""
        odd_space = re.compile(r" \s").search
        plain = ["\x00" not in t and not odd_space(t) and not LONG_SPACE.search(t) and not (self.cut and self.cut.search(t)) for t in texts]
        chunks = pc.split_pattern(pa.array([t.replace(" ", "\x00 ") if ok else "" for t, ok in zip(texts, plain, strict=True)], pa.large_string()), "\x00")
        coded = chunks.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        self.learn(words)
        known = [self.memo[w] for w in words]
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        starts, pool = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(known), np.uint32)
        which = coded.indices.to_numpy()
        n = sizes[which]
        ends = np.cumsum(n)
        out = pool[np.repeat(starts[which] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        at = np.concatenate([[0], ends])[chunks.offsets.to_numpy()]
        odd = [i for i, ok in enumerate(plain) if not ok]
        if not odd:
            return out, at
        parts = [out[at[i] : at[i + 1]] for i in range(len(texts))]
        for i in odd:
            parts[i] = self.whole(texts[i])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def runs(docs: list, texts: list[str], chars: int = 1 << 21) -> Iterator[tuple[list, list[str]]]:
    """Runs of rows of about so many characters, which bound what is encoded at once."""
    first = total = 0
    for i, text in enumerate(texts):
        total += len(text)
        if total >= chars:
            yield docs[first : i + 1], texts[first : i + 1]
            first, total = i + 1, 0
    if first < len(texts):
        yield docs[first:], texts[first:]


def tokenised_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Full windows of each document (its ids and the end token), then the rest. tokenizer: a file all tasks can open."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows: list[tuple] = []
            for docs, texts in runs(batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]):
                ids, at = encoder.ids(texts)
                for doc, a, b in zip(docs, at[:-1].tolist(), at[1:].tolist(), strict=True):
                    own = np.append(ids[a:b], np.uint32(END)).astype("<u4")
                    for s in range(0, len(own), capacity):
                        n = min(capacity, len(own) - s)
                        rows.append((doc, s, n, zlib.crc32(own[s : s + capacity]), len(own), part, int(seen[n])))
                        seen[n] += 1
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "inside"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * len(names), names)

    return bounded_batches(docs).select("doc_id", "text").mapInArrow(cut, NUMBERED)


def fullest(counts: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """The (length, times) whose sum comes closest to capacity from below.

    reach[i]: bit s is set if lengths up to the i-th (longest first) can sum to s. A length of count c
    is taken in blocks of 1, 2, 4, ... copies, so few shifts cover all counts; blocks also bound the
    steps back. It stops as soon as the capacity itself is reached.
    """
    mask, reach, blocks = (1 << (capacity + 1)) - 1, [1], []
    for length in np.flatnonzero(counts)[::-1].tolist():
        left, k = min(int(counts[length]), capacity // length), 1
        while left:
            k = min(k, left)
            reach.append((reach[-1] | reach[-1] << (length * k)) & mask)
            blocks.append((length, k))
            left, k = left - k, k * 2
        if reach[-1] >> capacity:
            break
    total, used = reach[-1].bit_length() - 1, {}
    for i in range(len(blocks), 0, -1):
        if not reach[i - 1] >> total & 1:
            length, k = blocks[i - 1]
            used[length] = used.get(length, 0) + k
            total -= length * k
    return sorted(used.items(), reverse=True)


def minimum_slack(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns [(length, times)] and for how many windows each is used, until no length is left."""
    counts, out = histogram.copy(), []
    while counts.any():
        longest = int(np.flatnonzero(counts)[-1])
        rest = counts.copy()
        rest[longest] -= 1
        rest[capacity - longest + 1 :] = 0
        used = dict(fullest(rest, capacity - longest))
        used[longest] = used.get(longest, 0) + 1
        times = min(int(counts[n]) // k for n, k in used.items())
        for n, k in used.items():
            counts[n] -= k * times
        out.append((sorted(used.items(), reverse=True), times))
    return out


def slots(patterns: list[tuple[list[tuple[int, int]], int]], first: int) -> list[tuple[int, ...]]:
    """(length, rank_from, rank_to, per_window, sequence, offset): ranks of a length that a pattern takes."""
    taken: dict[int, int] = {}
    out, sequence = [], first
    for used, times in patterns:
        offset = 0
        for length, k in used:
            at = taken.get(length, 0)
            out.append((length, at, at + k * times, k, sequence, offset))
            taken[length] = at + k * times
            offset += k * length
        sequence += times
    return out


def ranked(pieces: DataFrame) -> DataFrame:
    """`rank`: 0, 1, ... within each length: a piece's place in its task after the pieces of the tasks before."""
    tasks = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = tasks.select("length", "part", (F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    return pieces.join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("inside"))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Stored pieces, numbered by the tasks that cut them, with sequence_id and offset."""
    spark = pieces.sparkSession
    histogram = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most `capacity` rows
        histogram[row["length"]] = row["count"]
    full, histogram[capacity] = int(histogram[capacity]), 0
    plan = slots(minimum_slack(histogram, capacity), full)
    if full:
        plan.append((capacity, 0, full, 1, 0, 0))
    lookup = pd.DataFrame(plan or np.empty((0, 6)), columns=["length", "a", "b", "k", "sequence", "at"]).sort_values(["length", "a"]).astype("int64")
    sent = spark.sparkContext.broadcast([lookup[c].to_numpy() for c in lookup])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        length, a, _, k, sequence, at = sent.value
        key = length << 44 | a
        for rows in batches:
            if not len(rows):
                continue
            n, rank = rows["length"].to_numpy(), rows["rank"].to_numpy()
            i = np.searchsorted(key, n << 44 | rank, "right") - 1
            j = rank - a[i]
            yield rows.drop(columns="rank").assign(sequence_id=sequence[i] + j // k[i], offset=at[i] + j % k[i] * n)

    return ranked(pieces).select(*[c.split()[0] for c in PIECE.split(", ")], "rank").mapInPandas(place, f"{PIECE}, sequence_id long, offset long")


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(stored(tokenised_pieces(docs, tokenizer, capacity), "pieces"), capacity)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), default_tokenizer())

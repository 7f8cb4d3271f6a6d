"""Best-fit packing of token sequences with bound-certified repacking.

Documents become token ids and pieces of at most `capacity`. Pieces are spread evenly over
partitions; each partition is packed by best-fit decreasing, and dual-feasible functions give a
lower bound on its bins. A partition that meets its bound is proven optimal and closed. The others
release their emptiest bins; the released pieces are exchanged between partitions and packed again
for as long as that saves a bin.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symlake.llm.common import cut, prepare

CAPACITY, PARTITION_PIECES, ROUNDS = 2048, 50_000, 4
_SEPARATORS = "\t\n\x0b\x0c\r \x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B)))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """The ids of a word-end BPE file of the tokenizers library, some ten times faster on whole texts.

    The library spends its time on alignments that aren't needed here. This runs the same vocabulary
    as byte ranks: a text is normalised, each of its words gets a final mark, and the mark takes the
    place of the word-end suffix. Texts where the two could differ (special tokens, apostrophes, the
    mark itself, unusual controls) go to the library as they are.
    """

    _plain = re.compile("[\x01\x1c-\x1f']|<\\|")
    _class: np.ndarray | None = None

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {x["id"] for x in model["added_tokens"]}
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(visible)]
        byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {}
        for word, rank in model["model"]["vocab"].items():
            if rank not in special:
                ends = word.endswith("</w>")
                ranks[bytes(byte_of[c] for c in (word[:-4] if ends else word)) + b"\x01" * ends] = rank
        self.core = tiktoken.Encoding("words", pat_str="[^\x01]+\x01", mergeable_ranks=ranks, special_tokens={})._core_bpe
        if WordTokenizer._class is None:
            kinds = np.full(0x110000, 3, np.uint8)
            for c in range(0x110000):
                k = unicodedata.category(chr(c))[0]
                if k in "LN":
                    kinds[c] = 1 if k == "L" else 2
            kinds[[ord(c) for c in _SEPARATORS]] = 0
            WordTokenizer._class = kinds

    def __call__(self, text: str) -> np.ndarray:
        if self._plain.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        text = (text if text.isascii() else unicodedata.normalize("NFC", text)).lower()
        points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        if not len(points):
            return np.empty(0, np.uint32)
        kind = self._class[points]
        ends = np.ones(len(points), bool)
        ends[:-1] = (kind[1:] != kind[:-1]) | (kind[:-1] == 2)
        ends &= kind > 0
        times = (kind > 0).astype(np.int64) + ends
        marked = np.repeat(points, times)
        marked[np.cumsum(times)[ends] - 1] = 1
        return np.frombuffer(self.core.encode_to_tiktoken_buffer(marked.tobytes().decode("utf-32-le"), set()), np.uint32)


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document: its ids and a final 0, cut only where longer than capacity. Null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordTokenizer(vocabulary)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(0)).astype("<u4")
                for i, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    rows.append((doc_id, i, at, len(part), zlib.crc32(part.tobytes())))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _PIECES)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The best of the dual-feasible bounds: volume, the thresholds of Martello and Toth, the step functions of Fekete and Schepers."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1].astype(np.int64)
    size = np.arange(capacity + 1)
    numbers, volumes = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * size)])
    e = np.arange(0, capacity // 2 + 1)
    above = numbers[-1] - numbers[capacity - e + 1]
    between = volumes[capacity - e + 1] - volumes[e]
    best = int((above + -(-between // capacity)).max())
    for k in range(1, 21):
        scaled = size * (k + 1)
        exact = scaled % capacity == 0
        # k * capacity times the function's value, in whole numbers
        value = np.where(exact, size * k, scaled // capacity * capacity)
        best = max(best, int(-(-int((count * value).sum()) // (k * capacity))))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each length and the number of bins. Bins wait by free space; a bit mask finds the tightest that fits."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = used = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask ^= 1 << room
        else:
            b, room, used = used, capacity, used + 1
        bins[i], offsets[i] = b, capacity - room
        if room > n:
            if not free[room - n]:
                mask |= 1 << (room - n)
            free[room - n].append(b)
    return bins, offsets, used


def _packer(turn: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [pa.Table.from_batches([b]).select(["doc_id", "piece", "start", "length", "ids_crc32"]) for b in batches]
        if not parts:
            return
        whole = pa.concat_tables(parts)
        lengths = whole.column("length").to_numpy()
        bins, offsets, used = best_fit_decreasing(lengths, capacity)
        gap = used - lower_bound(lengths, capacity)
        out = np.zeros(len(lengths), bool)
        if gap > 0:
            fill = np.bincount(bins, weights=lengths, minlength=used)
            worst = np.argsort(fill, kind="stable")[: max(8 * gap, used // 4)]
            out = np.isin(bins, worst)
        base = (turn << 56) + (TaskContext.get().partitionId() << 28)
        whole = whole.append_column("sequence_id", pa.array(bins + base)).append_column("offset", pa.array(offsets)).append_column("released", pa.array(out))
        yield from whole.to_batches(max_chunksize=20_000)

    return run


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    docs needs doc_id and text; other columns are ignored. Every row is a document of its own, also
    where a doc_id is null or repeats. Null or empty text is the single id 0. An empty table gives no
    rows. Partitions hold about PARTITION_PIECES pieces each, so memory doesn't follow the input.
    """
    prepare(docs.sparkSession)
    pool = cut(token_pieces(docs, vocabulary or default_vocabulary(), capacity))
    done, bins = None, None
    for turn in range(ROUNDS):
        n = pool.count()
        packed = cut(pool.repartition(max(1, -(-n // PARTITION_PIECES))).mapInArrow(_packer(turn, capacity), _PIECES + ", sequence_id long, offset long, released boolean"))
        closed, opened = packed.filter("not released"), packed.filter("released")
        # Each bin has one piece at offset 0.
        now, still = packed.agg(F.count_if(F.col("offset") == 0), F.count_if((F.col("offset") == 0) & F.col("released"))).first()
        if bins is not None and now >= bins:
            break
        done = closed if done is None else done.unionByName(closed)
        pool, bins = opened, still
        if not still:
            break
    return (done if not bins else done.unionByName(pool)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

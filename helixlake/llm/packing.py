"""Best-fit packing of tokenised documents into sequences of bounded length.

Each task packs the documents of its own input split online: a fixed number of open bins hangs on a bitset
keyed by free space, a piece goes to the bin with the least space that still holds it, and when a new bin is
needed while all are open, the fullest closes. No document crosses the network and memory is the open bins.
What a task leaves half empty is packed once more, across tasks, by the same rule with whole bins as items.

Defined cases: a null or empty text is the single id that ends a document; only a document longer than a
sequence is cut; repeated rows are packed as often as they stand there; a null doc_id is packed and stays null;
an empty table gives an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import json
import os
import re
import string
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixlake.llm.common import Memory, bound_batches, scratch, slices, store

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

#: What a byte of a text is. A chunk is what stands between spaces; to the tokenizer more characters are white space, but
#: a chunk that holds these goes through it whole.
SPACE, LETTER, MARK, OTHER = range(4)
_KIND = np.array([SPACE if 9 <= b <= 13 or b == 32 else LETTER if chr(b) in string.ascii_letters else MARK if chr(b) in ".,;:!?*&%$#|)\"" else OTHER for b in range(256)], np.uint8)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: The second bytes of the letters from U+00C0 to U+00FE, whose first one is 0xC3. They are composed: normalisation leaves them.
_LATIN_SECOND = np.array([0x80 <= b <= 0xBE and b not in (0x97, 0xB7) for b in range(256)])
_LATIN_LOWER = np.array([b + 32 if 0x80 <= b <= 0x9E else b for b in range(256)], np.uint8)
#: By 4 x the kind of the byte before + its own. The tokenizer splits a chunk of letters and a tail of marks just between
#: them; what has another form is odd.
_STARTS, _STOPS, _ODD, _PIECE_OVER = (
    np.array([f(a, b) for a in range(4) for b in range(4)])
    for f in (
        lambda a, b: a == SPACE != b,
        lambda a, b: a != SPACE == b,
        lambda a, b: b == OTHER or (a, b) in ((SPACE, MARK), (MARK, LETTER)),
        lambda a, b: a != SPACE == b or (a, b) == (LETTER, MARK),
    )
)


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others
    follow from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class WordTokens:
    """Ids of whole texts by a public word-end BPE tokenizer, whose splits always fall on white space.

    The letter runs and tails of marks of many texts take the merges of the tokenizer's file through tiktoken's BPE, all in
    one call (a line end, which no chunk holds, stands for the end of a word). Odd chunks go through the tokenizer itself;
    each task remembers those that it has met, up to some bytes.
    """

    END = b"\n"
    #: Stands for an odd chunk, and is one itself.
    HOLE = 1
    #: A longer text is cut at the next space.
    CUT, _SPACES = 1 << 20, re.compile(rb"[\t-\r ]")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tiktoken import _tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _byte_letters()

        def written(token: str) -> bytes:
            body = token.removesuffix("</w>")
            own = bytes(letters[c] for c in body)
            return b"" if self.END in own else own + (self.END if body != token else b"")  # in no chunk

        order = [bytes([b]) for b in range(256)] + [bytes([b]) + self.END for b in range(256) if b != self.END[0]]
        order += filter(None, (written("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]))
        ids = {written(token): k for token, k in model["vocab"].items() if not token.startswith("<|")}
        self.id_of_rank = np.array([ids.get(t, -1) for t in order], np.int64)
        self.ends_piece = np.array([t.endswith(self.END) for t in order])
        self.merge = _tiktoken.CoreBPE({t: k for k, t in enumerate(order)}, {}, r"[^\n]+\n").encode_ordinary
        self.forget()

    def forget(self) -> None:
        """Empties the memory, at the end of a task."""
        self.odd = Memory(self._whole, 16 << 20)

    def _whole(self, text: bytes) -> bytes:
        return np.array(self.whole.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def _together(self, texts: list[bytes]) -> list[bytes]:
        data = b"\n".join([*texts, b""])
        x = np.frombuffer(data, np.uint8)
        kind, low = _KIND[x], _LOWER[x]
        first = np.flatnonzero(x == 0xC3)
        first = first[_LATIN_SECOND[x[first + 1]]]
        kind[first] = kind[first + 1] = LETTER
        low[first + 1] = _LATIN_LOWER[x[first + 1]]
        step = kind.copy()
        step[1:] += 4 * kind[:-1]
        # What to write for each byte: the end of a piece before it, and itself; for an odd chunk, a hole.
        line = np.empty((len(x), 2), np.uint8)
        line[:, 0], line[:, 1] = self.END[0], low
        there = np.empty((len(x), 2), bool)
        there[:, 0], there[:, 1] = _PIECE_OVER[step], kind != SPACE
        starts, stops = np.flatnonzero(_STARTS[step]), np.flatnonzero(_STOPS[step])
        odd = np.unique(np.searchsorted(starts, np.flatnonzero(_ODD[step]), side="right") - 1)
        starts, stops = starts[odd], stops[odd]
        if len(odd):
            edges = np.zeros(len(x), np.int8)
            edges[starts], edges[stops] = 1, -1
            there[np.cumsum(edges, dtype=np.int8).view(bool)] = False
            there[starts, 1], line[starts, 1] = True, self.HOLE
        written = line[there].tobytes()
        ranks = np.frombuffer(array("I", self.merge(written.decode())), np.uint32)
        found, ends = self.id_of_rank[ranks], np.r_[0, np.flatnonzero(self.ends_piece[ranks]) + 1]
        over = np.flatnonzero(there[:, 0])  # by piece
        own = {k: data[a:b] for k, a, b in zip(np.searchsorted(over, stops).tolist(), starts.tolist(), stops.tolist())}
        if len(lacking := np.flatnonzero(found < 0)):  # a merge that the vocabulary lacks
            pieces = written.split(self.END)
            own = {k: pieces[k] for k in np.unique(np.searchsorted(ends, lacking, side="right") - 1).tolist()} | own
        flat, places = found.astype("<u4").tobytes(), 4 * ends
        until = np.searchsorted(over, np.cumsum([len(t) + 1 for t in texts]) - 1, side="right")
        holes = np.array(sorted(own), np.int64)
        filled = zip(places[holes].tolist(), places[holes + 1].tolist(), [self.odd[own[k]] for k in holes.tolist()])
        out, at, filling = [], 0, next(filled, None)
        for end in places[until].tolist():
            parts = []
            while filling and filling[1] <= end:
                start, stop, ids = filling
                if at < start:
                    parts.append(flat[at:start])
                parts.append(ids)
                at, filling = stop, next(filled, None)
            parts.append(flat[at:end])
            out.append(b"".join(parts))
            at = end
        return out

    def _long(self, text: bytes) -> bytes:
        out, at = [], 0
        while at < len(text):
            cut = self._SPACES.search(text, at + self.CUT)
            end = cut.start() if cut else len(text)
            out += self._together([text[at:end]])
            at = end
        return b"".join(out)

    def ids_of(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each UTF-8 text."""
        return self._together(texts) if sum(map(len, texts)) <= 2 * self.CUT else [self._long(t) for t in texts]

    def ids(self, text: str) -> bytes:
        return self.ids_of([text.encode()])[0]


_tokens: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """One for each worker process, kept from task to task: of fixed size but for its memory, which each task empties."""
    if path not in _tokens:
        _tokens[path] = WordTokens(path)
    return _tokens[path]


class OpenBins:
    """At most `most` open bins of `size`; bit f of `bits` is set while an open bin has f free."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.open, self.made, self.bits = size, most, 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]

    def _take(self, free: int) -> int:
        at = self.by_free[free]
        name = at.pop()
        if not at:
            self.bits &= ~(1 << free)
        self.open -= 1
        return name

    def put(self, length: int) -> tuple[int, int]:
        """The bin for a piece and the piece's place in it."""
        if fitting := self.bits >> length:
            free = length + (fitting & -fitting).bit_length() - 1
            name = self._take(free)
        else:
            if self.open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, name = self.size, self.made
            self.made += 1
        if left := free - length:
            self.by_free[left].append(name)
            self.bits |= 1 << left
            self.open += 1
        return name, self.size - free


def tokenise_and_pack(docs: DataFrame, tokenizer_path: str, size: int, open_bins: int, end_id: int) -> DataFrame:
    end = np.array([end_id], "<u4").tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        bins, tokens = OpenBins(size, open_bins), word_tokens(tokenizer_path)
        try:
            for batch in slices(batches, size=tokens.CUT):
                rows: list[tuple] = []
                texts = [text or b"" for text in pc.cast(batch.column(1), pa.binary()).to_pylist()]
                for doc_id, ids in zip(batch.column(0).to_pylist(), tokens.ids_of(texts)):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * size)):
                        part = ids[at : at + 4 * size]
                        name, offset = bins.put(len(part) // 4)
                        rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), first + name, offset))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), TYPES)], NAMES)
        finally:
            tokens.forget()

    return docs.select("doc_id", "text").mapInArrow(pack, PIECES)


NAMES = [x.split()[0] for x in PIECES.split(", ")]
TYPES = [{"int": pa.int32(), "long": pa.int64()}[x.split()[1]] for x in PIECES.split(", ")]


def repack(bins: DataFrame, size: int, open_bins: int, bins_per_task: int) -> DataFrame:
    """Maps bins (sequence_id, used) that have space left to new bins and to their place in them. Each task
    takes the bins of a hash range, the fullest first."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        into, names = OpenBins(size, open_bins), []
        for frame in frames:
            to = []
            for name, used in zip(frame["sequence_id"].tolist(), frame["used"].tolist()):
                k, base = into.put(used)
                if k == len(names):
                    names.append(name)
                to.append((names[k], base))
            yield pd.DataFrame({"sequence_id": frame["sequence_id"], "into": [x[0] for x in to], "base": [x[1] for x in to]})

    tasks = max(1, -(-bins.count() // bins_per_task))
    dealt = bins.repartition(tasks, "sequence_id").sortWithinPartitions(F.desc("used"), "sequence_id")
    return dealt.mapInPandas(pack, "sequence_id long, into long, base long")


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = 2048, open_bins: int = 256, end_id: int = 0, bins_per_task: int = 50_000) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    bound_batches(docs.sparkSession)
    with scratch(docs.sparkSession) as kept:
        found = store(_packed(docs, tokenizer_path, size, open_bins, end_id, bins_per_task), "packed")
        kept.append(found.stored_at)
    return found


def _packed(docs: DataFrame, tokenizer_path: str, size: int, open_bins: int, end_id: int, bins_per_task: int) -> DataFrame:
    pieces = store(tokenise_and_pack(docs, tokenizer_path, size, open_bins, end_id), "pieces")
    used = pieces.groupBy("sequence_id").agg(F.sum("length").alias("used")).where(F.col("used") < size)
    moved = repack(store(used, "bins"), size, open_bins, bins_per_task)
    return pieces.join(moved, "sequence_id", "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.coalesce("into", "sequence_id").alias("sequence_id"),
        (F.col("offset") + F.coalesce("base", F.lit(0).cast("long"))).alias("offset"),
    )

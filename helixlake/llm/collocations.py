"""Phrase collocation mining: frequent phrases of 2 to 5 words and how strongly their words belong together.

1. Words become 64-bit hashes, runs of them Rabin-Karp fingerprints: differences of numpy prefix polynomials modulo 2^64, one
   subtraction and one product for every run of n words. Each task gathers equal fingerprints, up to some bytes, with their
   count, the place of an occurrence (the least hash of a text that holds one) and the sum of a second fingerprint; the
   shuffle sums them. First runs of one and two words; then those of three to five whose pairs of neighbours may all be
   frequent: a phrase is never more frequent than a phrase in it.
2. In a last pass over the texts only those that a place points to write out their phrases: frequent ones, once each. Filters
   of bounded size tell which; what passes by chance is joined away. Inside a text all runs of a fingerprint are compared
   in their words, and the second fingerprint of the phrase, times the count, must give the sum: else different
   phrases share the fingerprint, and those of such fingerprints are counted by their words.
3. Scores, cuts and ranks are DataFrame operations on the frequent phrases, in whole numbers of up to 38 digits.

Languages are counted apart; null is `und`, together with a language of that name. Pieces end at `.,;:!?` and at line
breaks, words at spaces and tabs, so that a phrase never crosses a piece or a text.

Defined cases: null and empty texts have no words; equal scores are ordered by count, then by the phrase's UTF-8 bytes; equal
scores of two cuts go to the shorter first part; repeated rows count as often as they stand there; a text of any length is
taken whole; an empty table gives an empty result; columns other than lang and text, doc_id among them, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixlake.llm.common import Memory, scratch, slices, store
from helixlake.llm.shingles import U, mixed

LONGEST, LEAST, TOP = 5, 100, 2000
FILTER_BITS = 1 << 26
#: Fingerprints that a task gathers before it lets them out, and phrases likewise.
GATHERED, PHRASES = 1 << 20, 200_000
#: Delimiters of pieces become line breaks, tabs become spaces, A-Z small letters.
TABLE = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256)).lower()
#: Odd, so that its powers can't vanish modulo 2^64.
BASE, SECOND = U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95)
BREAK, NOTHING = U(1), U(0)


class Hashes(Memory):
    """64-bit hashes of words; of the marks between pieces and of nothing, fixed values."""

    def __init__(self):
        import xxhash

        super().__init__(lambda word: xxhash.xxh3_64_intdigest(word) | 2)

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U, len(words))

    def clear(self) -> None:
        super().clear()
        self[b"\n"], self[b""] = int(BREAK), int(NOTHING)


class Words:
    """The words of some texts, one after the other, with the piece and the language of each."""

    def __init__(self, rows: list[tuple[str | None, str | None]], hashes: Hashes, keep: bool = False):
        import xxhash

        split = [("und" if lang is None else lang, t.encode().translate(TABLE).replace(b"\n", b" \n ").split(b" ")) for lang, t in rows if t]
        self.langs = sorted({lang for lang, _ in split})
        code = {lang: k for k, lang in enumerate(self.langs)}
        words = [w for _, own in split for w in (*own, b"\n")]
        h = hashes.of(words)
        lang = np.repeat(np.array([code[x] for x, _ in split], np.int64), [len(own) + 1 for _, own in split])
        piece = np.cumsum(h == BREAK)
        real = h > BREAK
        self.h, self.lang, self.piece = h[real], lang[real], piece[real]
        self.words = [words[k] for k in np.flatnonzero(real).tolist()] if keep else []
        texts = np.array([xxhash.xxh3_64_intdigest(t) >> 1 for _, t in rows if t], U)
        self.place = np.repeat(texts, [len(own) + 1 for _, own in split])[real]
        # Prefix polynomials: h0 + h1 B + h2 B^2 ..., so that a run's difference is divided by B^start: multiplied by its inverse.
        self.sums = [self._prefix(base) for base in (BASE, SECOND)]
        self.own = np.array([_lang_hash(x) for x in self.langs], U)

    def _prefix(self, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        rise = lambda x: np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(max(0, len(self.h) - 1), x, U)]))[: len(self.h)]
        return np.concatenate([np.zeros(1, U), np.cumsum(self.h * rise(base), dtype=U)]), rise(U(pow(int(base), -1, 1 << 64)))

    def checks(self, n: int, at: np.ndarray) -> np.ndarray:
        """The second fingerprints, of 32 bits."""
        prefix, inverse = self.sums[1]
        return (mixed((prefix[at + n] - prefix[at]) * inverse[at]) >> U(32)).astype(np.int64)

    def runs(self, n: int, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places of runs of n words within pieces (those among starts), and their fingerprints by language and length."""
        at = np.arange(len(self.h) - n + 1) if starts is None else starts[starts <= len(self.h) - n]
        at = at[self.piece[at] == self.piece[at + n - 1]] if len(at) else at.astype(np.int64)
        prefix, inverse = self.sums[0]
        prints = (prefix[at + n] - prefix[at]) * inverse[at]
        return at, mixed(prints ^ self.own[self.lang[at]] ^ mixed(np.full(1, n, U))) if len(at) else prints


def _lang_hash(lang: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(lang.encode(), seed=77)


class Filter:
    """FILTER_BITS bits: those at which some frequent fingerprint falls."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def has(self, prints: np.ndarray) -> np.ndarray:
        bit = prints & U(len(self.words) * 64 - 1)
        return (self.words[(bit >> U(6)).astype(np.int64)] >> (bit & U(63))) & U(1) == U(1)

    @staticmethod
    def of(prints: DataFrame, bits: int) -> Filter:
        bit = F.col("print").bitwiseAND(F.lit(bits - 1))
        by_word = prints.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast((print & {bits - 1}) & 63 as int))")).alias("bits"))
        found = by_word.toPandas()  # bits / 64 rows at most
        words = np.zeros(bits // 64, np.int64)
        words[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
        return Filter(words.view(U))


GROUPS = "print long, n long, place long, check long"


def _gathered(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Equal fingerprints once, with their counts, least places and sums of second fingerprints."""
    prints, n, place, check = (np.concatenate([x[k] for x in parts]) for k in range(4))
    order = np.argsort(prints, kind="stable")
    prints = prints[order]
    first = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]])) if len(prints) else np.zeros(0, np.int64)
    if not len(first):
        return [prints, n, place, check]
    return [prints[first], np.add.reduceat(n[order], first), np.minimum.reduceat(place[order], first), np.add.reduceat(check[order], first)]


def fingerprints(docs: DataFrame, lengths: list[int], pairs: Filter | None = None) -> DataFrame:
    """print, n, place, check: fingerprints of runs of these lengths with partial counts and sums; with pairs, only of runs
    whose pairs of neighbours all pass it."""
    shared = docs.sparkSession.sparkContext.broadcast(pairs)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size = Hashes(), [], 0
        hashes.clear()

        def out() -> pa.RecordBatch:
            prints, n, place, check = _gathered(held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64)), pa.array(n), pa.array(place.view(np.int64)), pa.array(check)], [x.split()[0] for x in GROUPS.split(", ")])

        for batch in slices(batches):
            w = Words(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())), hashes)
            starts, found = None, []
            if shared.value is not None:
                at, prints = w.runs(2)
                good = np.zeros(len(w.h) + LONGEST, bool)
                good[at[shared.value.has(prints)]] = True
            for n in lengths:
                if shared.value is not None:
                    starts = np.flatnonzero(np.logical_and.reduce([good[k : len(w.h) + k] for k in range(n - 1)]))
                at, prints = w.runs(n, starts)
                found.append([prints, np.ones(len(at), np.int64), w.place[at], w.checks(n, at)])
            held.append(_gathered(found))
            size += len(held[-1][0])
            if size > GATHERED:
                yield out()
                size = 0
        if held:
            yield out()

    return docs.select("lang", "text").mapInArrow(rows, GROUPS)


def frequent(partial: DataFrame, least: int) -> DataFrame:
    sums = partial.groupBy("print").agg(F.sum("n").alias("n"), F.min("place").alias("place"), F.sum("check").alias("check"))
    return sums.where(F.col("n") >= least)


def pointed_phrases(docs: DataFrame, wanted: Filter, pointed: Filter, longest: int) -> DataFrame:
    """print, place, check, lang, words, phrase: runs whose fingerprints pass the one filter, in texts to which they point by
    the other; and rows without a fingerprint, whose check is a number of words."""
    filters = docs.sparkSession.sparkContext.broadcast((wanted, pointed))
    schema = "print long, place long, check long, lang string, words int, phrase string"
    types = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[x.split()[1]] for x in schema.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, totals = Hashes(), {}
        hashes.clear()
        wanted, pointed = filters.value

        def out(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), types)], [x.split()[0] for x in schema.split(", ")])

        for batch in slices(batches):
            w = Words(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())), hashes, keep=True)
            for k, n in enumerate(np.bincount(w.lang, minlength=len(w.langs)).tolist()):
                totals[w.langs[k]] = totals.get(w.langs[k], 0) + n
            found, starts = [], None
            for n in range(1, longest + 1):
                at, prints = w.runs(n, starts)
                passed = wanted.has(prints)
                starts, prints = at[passed], prints[passed]  # a run that goes on begins with one that passed
                key = prints ^ w.place[starts]
                here = pointed.has(key) & pointed.has(key >> U(32))
                # One text at a time: groups by fingerprint and text.
                own = starts[here]
                for place in _verified(w, own, key[here], n):
                    phrase = b" ".join(w.words[place : place + n]).decode()
                    found.append((place, n, phrase))
            if found:
                place = np.array([x[0] for x in found])
                sizes = np.array([x[1] for x in found])
                prints, checks = np.zeros(len(found), U), np.zeros(len(found), np.int64)
                for n in np.unique(sizes).tolist():
                    own = np.flatnonzero(sizes == n)
                    prints[own], checks[own] = w.runs(n, place[own])[1], w.checks(n, place[own])
                texts = w.place[place].view(np.int64).tolist()
                yield out([(p, t, c, w.langs[w.lang[x]], n, phrase) for p, t, c, (x, n, phrase) in zip(prints.view(np.int64).tolist(), texts, checks.tolist(), found)])
        if totals:
            yield out([(None, None, n, lang, 0, None) for lang, n in totals.items()])

    return docs.select("lang", "text").mapInArrow(rows, schema)


def _verified(w: Words, at: np.ndarray, keys: np.ndarray, n: int) -> Iterator[int]:
    """A place of each different run among those at these places: of equal keys, each is compared in its words with the one
    that its group points to, and what differs forms groups of its own."""
    while len(at):
        _, first, group = np.unique(keys, return_index=True, return_inverse=True)
        point = at[first][group]
        same = np.array([w.words[a : a + n] == w.words[b : b + n] for a, b in zip(at.tolist(), point.tolist())], bool)
        yield from at[first].tolist()
        at, keys = at[~same], keys[~same]


def counted_phrases(docs: DataFrame, wanted: Filter, longest: int = LONGEST) -> DataFrame:
    """lang, words, phrase, f: runs whose fingerprints pass the filter, with partial counts by their words."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held = Hashes(), {}
        hashes.clear()

        def out() -> pa.RecordBatch:
            keys, f = list(held), list(held.values())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*keys), (pa.string(), pa.int32(), pa.string()))] + [pa.array(f, pa.int64())], ["lang", "words", "phrase", "f"])

        for batch in slices(batches):
            w = Words(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())), hashes, keep=True)
            for n in range(1, longest + 1):
                at, prints = w.runs(n)
                for place in at[shared.value.has(prints)].tolist():
                    key = (w.langs[w.lang[place]], n, b" ".join(w.words[place : place + n]).decode())
                    held[key] = held.get(key, 0) + 1
            if len(held) > PHRASES:
                yield out()
        if held:
            yield out()

    return docs.select("lang", "text").mapInArrow(rows, "lang string, words int, phrase string, f long")


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, bits: int = FILTER_BITS) -> DataFrame:
    """lang, words, phrase, f: every phrase of up to `longest` words that occurs `least` times or more in a language, and a
    row of no words with the number of the language's words."""
    short = store(frequent(fingerprints(docs, [1, 2]), least), "short-prints")
    lengths = list(range(3, longest + 1))
    prints = short
    if lengths:
        prints = short.unionByName(store(frequent(fingerprints(docs, lengths, Filter.of(short, bits)), least), "long-prints"))
    key = F.col("print").bitwiseXOR(F.col("place"))
    keys = prints.select(F.explode(F.array(key, F.shiftrightunsigned(key, 32))).alias("print"))
    written = store(pointed_phrases(docs, Filter.of(prints, bits), Filter.of(keys, bits), longest), "pointed-phrases")
    totals = written.where("words = 0").groupBy("lang", "words", "phrase").agg(F.sum("check").alias("f"))
    found = written.where("words > 0").withColumnRenamed("check", "own").distinct().join(prints, ["print", "place"])
    return _settled(docs, store(found, "found-phrases"), least, longest, bits).unionByName(totals)


def _settled(docs: DataFrame, found: DataFrame, least: int, longest: int, bits: int) -> DataFrame:
    """lang, words, phrase, f of found (print, n, check, own, lang, words, phrase): counts of fingerprints that one phrase has
    alone; phrases that share one are counted by their words."""
    alone = found.groupBy("print").agg(F.count("*").alias("_k"), F.max(F.col("check") != F.col("n") * F.col("own")).alias("_other"))
    shared = store(alone.where("_k > 1 or _other").select("print"), "shared-prints")
    clear = found.join(shared, "print", "left_anti").select("lang", "words", "phrase", F.col("n").alias("f"))
    if shared.isEmpty():
        return clear
    counted = counted_phrases(docs, Filter.of(shared, bits), longest).groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return clear.unionByName(counted.join(clear, ["lang", "words", "phrase"], "left_anti"))


def _whole(c: str, digits: int) -> Column:
    return F.col(c).cast(f"decimal({digits},0)")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, longest: int = LONGEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` collocations."""
    with scratch(docs.sparkSession) as kept:
        result = store(_ranked(store(frequent_phrases(docs, least, longest), "phrases"), top), "collocations")
        kept.append(result.stored_at)
    return result


def _ranked(found: DataFrame, top: int) -> DataFrame:
    totals = found.where("words = 0").select("lang", F.col("f").alias("n"))  # a row for each language
    counted = found.where("words > 0").select("lang", "phrase", "f")
    candidates = found.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    # What lies in a longer candidate that is as frequent says nothing of its own.
    size = F.col("words")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda k: F.array_join(F.slice("w", k, n), " "))))
    within = candidates.where("words > 2").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer"))
    within = within.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    own = candidates.join(within, ["lang", "phrase"], "left").where("longer is null or 100 * longer < 100 * a").drop("longer")
    cuts = own.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.withColumns({"first": F.array_join(F.slice("w", F.lit(1), F.col("k")), " "), "rest": F.array_join(F.slice("w", F.col("k") + 1, size - F.col("k")), " ")})
    cuts = cuts.join(counted.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(counted.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cuts = cuts.join(F.broadcast(totals), "lang")
    cuts = cuts.withColumns({"_up": F.lit(1000).cast("decimal(4,0)") * _whole("a", 15) * _whole("n", 17), "_down": _whole("l", 15) * _whole("r", 15)})
    cuts = cuts.withColumn("score", F.expr("_up div _down"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("lang", "phrase", "a", "n", "c.score", "c.l", "c.r")
    # The first ones of parts of a language hold the first ones of all.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    some = best.withColumn("_k", F.row_number().over(part)).where(F.col("_k") <= top).drop("_k")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

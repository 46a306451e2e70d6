"""Packing, near-duplicates and decontamination against brute force, and their defined cases."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helixlake.llm import queries
from helixlake.llm.components import connected_components
from helixlake.llm.decontaminate import decontaminate
from helixlake.llm.near_dup import near_duplicates
from helixlake.llm.packing import OpenBins, WordTokens, pack_documents

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rep long, hit int, bucket long, sequence_id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, 7, 7, 7, "x") for i, t in rows], DOCS)


def brute_components(rows, percent=75):
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            by[x].add(i)
    for i, s in sets.items():
        common = defaultdict(int)
        for x in s:
            for j in by[x]:
                common[j] += 1
        for j, c in common.items():
            if j > i and 100 * c >= percent * (len(s) + len(sets[j]) - c):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates_of_the_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op7_near_duplicates(spark, sf_dir).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_links_through_others(spark):
    """A chain: neighbours are near, the ends are not; all are one component."""
    base = [f"w{k}" for k in range(200)]
    rows = [(10 + k, " ".join(base[: 200 - 0] if k == 0 else [f"x_{j}" if j < 6 * k else w for j, w in enumerate(base)])) for k in range(12)]
    rows += [(1, None), (2, ""), (3, "one two"), (4, "ONE\ttwo"), (5, "one two three"), (6, " \n ")]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(frame(spark, rows)).collect()}
    want = brute_components(rows)
    assert {i: x[:2] for i, x in got.items()} == want
    assert got[4] == (1, 3, False) and got[1] == (0, 1, True)
    assert got[21][1] == 10


def test_near_duplicates_defined_cases(spark):
    assert near_duplicates(frame(spark, [])).collect() == []
    text = "a b c d e f g h i j"
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in near_duplicates(frame(spark, [(None, text), (7, text), (7, text), (8, text)])).collect())
    assert got == [("7", "7", True), ("7", "7", True), ("8", "7", False), ("None", "None", True)]


def test_components_of_a_path(spark):
    n = 60
    edges = spark.createDataFrame([(k, k + 1) if k % 2 else (k + 1, k) for k in range(n)] + [(3, 3), (100, 101)], "a long, b long")
    got = dict(connected_components(edges).collect())
    assert got == {**{k: 0 for k in range(n + 1)}, 100: 100, 101: 100}


def test_decontamination_against_brute_force(spark, sf_dir):
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: [w.lower() for w in re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").encode())]
    assert word.findall(b"a-b") == [b"a", b"b"]
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    docs += [(-1, None), (-2, ""), (-3, items[0][1]), (-4, (items[1][1] + " zz ") * 3), (-5, "Short item!")]
    items += [(9000, "short ITEM"), (9001, None), (9002, "...")]
    windows = defaultdict(set)
    for i, t in items:
        w = cut(t)
        for k in range(max(1, len(w) - 12)) if w else []:
            windows[tuple(w[k : k + 13])].add(i)
    want = {}
    for i, t in docs:
        w, hit, found = cut(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if own := windows.get(tuple(w[k : k + size])):
                    found |= own
                    hit |= set(range(k, k + size))
        names = ",".join(sorted(map(str, found)))
        want[i] = (len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate(frame(spark, docs), bench).collect()}
    assert got == want
    assert sum(x[4] for x in want.values()) > 3


def test_decontamination_near_items_and_empty_tables(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu xi")], "item_id long, text string")
    docs = frame(spark, [(1, "alpha beta so gamma then delta epsilon zeta eta theta iota kappa lam mu nu xi"), (2, "alpha " + "x " * 200 + "beta")])
    got = {r.doc_id: (r.n_hit, r.near_items) for r in decontaminate(docs, bench).collect()}
    assert got == {1: (0, 1), 2: (0, 0)}
    assert decontaminate(frame(spark, []), bench).collect() == []
    assert [r.n_hit for r in decontaminate(docs, bench.where("false")).collect()] == [0, 0]


@pytest.fixture(scope="module")
def tokens():
    made = WordTokens(queries.word_tokenizer())
    made.by_file = lambda text: np.array(made.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    return made


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=12), st.text("abcdefghijklmnopqrstuvwxyzéßÖ'.,!0", max_size=14)), max_size=8).map(" ".join))
def test_tokens_equal_the_tokenizer(tokens, text):
    want = np.array(tokens.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert tokens.ids(text) == want


def test_many_texts_take_their_merges_in_one_call(tokens, monkeypatch):
    """Whatever is new in them; and a text cut at its spaces, or with each merge lacking, has the same ids."""
    texts = [" ".join(f"{a}{b}Ört" for a in ("neu", "wört", "x") for b in "abcdefgh"), "", "Ends, so; \"said\" he)|\n\n\tit's 4x4 ..", "a\u00a0b c\x1cd \u0065\u0301 × ÷ ÿ Þ \x01", " \n", "Сло́во 漢字, don't!a !", "É" * 300 + "!" * 40]
    want = [tokens.by_file(t) for t in texts]
    assert [tokens.ids(t) for t in texts] == want
    calls, merge = [], tokens.merge
    monkeypatch.setattr(tokens, "merge", lambda text: calls.append(text) or merge(text))
    assert tokens.ids_of([t.encode() for t in texts]) == want and len(calls) == 1
    monkeypatch.setattr(tokens, "CUT", 5)
    assert tokens.ids_of([t.encode() for t in texts]) == want and len(calls) > 8
    monkeypatch.setattr(tokens, "id_of_rank", np.where(np.arange(len(tokens.id_of_rank)) % 3, tokens.id_of_rank, -1))
    assert tokens.ids_of([t.encode() for t in texts]) == want


def check_packing(rows, ids_of, got, size):
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert by.keys() == {i for i, _ in rows}
    total = 0
    for i, t in rows:
        ids, own = ids_of(t or "") + b"\0\0\0\0", sorted(by[i], key=lambda r: r.piece)
        total += len(ids) // 4
        assert [r.piece for r in own] == list(range(len(own)))
        for r in own:
            part = ids[4 * r.start : 4 * (r.start + r.length)]
            assert r.ids_crc32 == zlib.crc32(part) and r.length == size or r is own[-1] and len(part) == 4 * r.length > 0
        assert sum(r.length for r in own) == len(ids) // 4
    return len(places), -(-total // size)


def test_packing_the_whole_table(spark, sf_dir, tokens):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    made, least = check_packing(rows, tokens.by_file, queries.op8_pack(spark, sf_dir).collect(), 2048)
    assert made <= 1.03 * least + 1


def test_packing_defined_cases(spark, tokens):
    assert pack_documents(frame(spark, []), queries.word_tokenizer()).collect() == []
    rows = [(1, None), (2, ""), (3, "word " * 40), (4, "a b c")]
    docs = frame(spark, rows).repartition(4)
    made, _ = check_packing(rows, tokens.by_file, pack_documents(docs, queries.word_tokenizer(), size=16).collect(), 16)
    assert made == 3


def test_open_bins_prefers_the_fullest_that_fits_and_closes_the_fullest():
    bins = OpenBins(10, 2)
    assert [bins.put(n) for n in (6, 7, 3, 4, 9, 8, 1)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (3, 0), (2, 9)]
    bins.put(5)
    assert bins.open == 2

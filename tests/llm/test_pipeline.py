"""The pipeline against what its stages' brute-force versions keep."""

import re

import numpy as np

import corpus_pipeline
from tokenizers import Tokenizer

from helixlake.llm.pseudonyms import Pseudonyms
from helixlake.llm.queries import PSEUDONYM_KEY, word_tokenizer
from tests.llm.test_pairs import brute_components, check_packing


def contaminated(text, windows):
    words = [w.lower() for w in re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text.encode())]
    hit = set()
    for size in {len(w) for w in windows}:
        for k in range(len(words) - size + 1):
            if tuple(words[k : k + size]) in windows:
                hit |= set(range(k, k + size))
    return bool(hit) and 20 * len(hit) >= len(words)


def test_pipeline_keeps_what_brute_force_keeps(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    named = {i: t for i, t in docs.items() if t and any(map(str.isalpha, t))}
    components = brute_components(list(named.items()))
    first = {i: t for i, t in named.items() if components[i][1] == i}
    windows = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = [x.lower() for x in re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (r.text or "").encode())]
        windows |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12))} if w else set()
    clean = {i: t for i, t in first.items() if not contaminated(t, windows)}
    p = Pseudonyms(PSEUDONYM_KEY)
    rows = [(i, p.replaced(t)[0]) for i, t in clean.items()]
    tokenizer = Tokenizer.from_file(word_tokenizer())
    tokenizer.encode_special_tokens = True
    ids_of = lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    made, least = check_packing(rows, ids_of, corpus_pipeline.run(spark, sf_dir).collect(), 2048)
    assert made <= 1.03 * least + 1


def test_stages_keep_the_columns_and_repeated_rows_count_once(spark):
    rows = [(1, "a b c d e f g", "en", "s", 13, 0), (1, "a b c d e f g", "en", "s", 13, 0), (2, "a b c d e f g", None, None, None, 0), (3, "!!", "en", "s", 2, 0), (None, "other words than those", "en", "s", 5, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, count int")
    bench = {"sf_dir": "/root/testdata/sf0.001"}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, bench["sf_dir"])
        assert docs.columns == corpus_pipeline.COLUMNS, name
    assert sorted(str(r.doc_id) for r in docs.collect()) == ["1", "None"]


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    assert docs.collect() == []

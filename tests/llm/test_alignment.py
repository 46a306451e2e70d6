"""Cross-tokenizer alignment against a plain loop over tokens, and its defined cases."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest

from helixlake.llm import alignment, queries
from tests.llm.test_pairs import frame

A, B = (str(public_tokenizers.path(name)) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(A)
    whole.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    return whole, letters, sentencepiece.SentencePieceProcessor(model_file=B)


def brute(rows, tools):
    whole, letters, pieces = tools
    docs, counts = [], Counter()
    for i, text in rows:
        a, b = [], []
        if text:
            a = [(k, bytes(letters[c] for c in whole.id_to_token(k))) for k in whole.encode(" " + text, add_special_tokens=False).ids]
            for k in pieces.encode(text):
                p = pieces.id_to_piece(k)
                b.append((k, bytes([int(p[3:5], 16)]) if p.startswith("<0x") and p.endswith(">") else p.replace("▁", " ").encode()))
            raw = (" " + text).encode()
            if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
                a, b = [], []
        groups, x, y, u, v = [], [], [], 0, 0
        left, right = iter(a), iter(b)
        for k, own in left:
            x.append(k)
            u += len(own)
            while v < u:
                k, own = next(right)
                y.append(k)
                v += len(own)
            if u == v:
                groups.append((x, y))
                x, y = [], []
        docs.append((i, len(a), len(b), groups))
        counts.update((x[-1], y[-1]) for x, y in groups)
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = Counter()
    for i, n_a, n_b, groups in docs:
        links = [(x[-1], y[-1]) for x, y in groups]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        sha = hashlib.sha256(text.encode()).hexdigest() if text else ""
        out[(i, n_a, n_b, len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), sha)] += 1
    return out, counts, best


def found(df):
    return Counter(tuple(r) for r in df.collect())


def test_alignment_of_the_whole_table(spark, sf_dir, tools):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert found(queries.op13_token_alignment(spark, sf_dir)) == brute(rows, tools)[0]


CASES = [
    (1, None), (2, ""), (3, " "), (4, "a<|endoftext|>b <s> </s><unk><0x41>"), (5, "mark ▁ inside"), (6, "tab\tline\n\r\n  spaces   "), (7, "日本語 emoji 👩‍👩‍👧 é é"),
    (7, "the same the same"), (7, "the same the same"), (None, "no id at all"), (8, "\x00 nul \x1f \x85 \xa0 x"), (9, "1234567 l'été don't"), (10, "x" * 3000), (11, "Ɂ " + "wörd " * 50),
]


def test_defined_cases(spark, tools):
    want, counts, best = brute(CASES, tools)
    assert found(alignment.token_alignment(frame(spark, CASES), A, B)) == want
    pairs = {(r.a, r.b): (r.n, r.best) for r in alignment.id_pairs(frame(spark, CASES), A, B).collect()}
    assert pairs == {p: (n, n == best[p[1]]) for p, n in counts.items()}
    assert alignment.token_alignment(frame(spark, []), A, B).count() == 0
    texts = {r.doc_id: r.groups for r in alignment.aligned(frame(spark, [(1, "the same")]), A, B, groups=True).collect()}
    assert texts[1].count("|") == texts[1].count(";") + 1


def test_pairs_beyond_the_frequent_ones_are_joined(spark, tools, monkeypatch):
    monkeypatch.setattr(alignment, "FREQUENT", 2)
    assert found(alignment.token_alignment(frame(spark, CASES), A, B)) == brute(CASES, tools)[0]
    monkeypatch.setattr(alignment, "FREQUENT", 0)
    assert found(alignment.token_alignment(frame(spark, CASES), A, B)) == brute(CASES, tools)[0]


def test_one_very_long_text(spark, tools):
    rows = [(1, " ".join(f"word{k} Überß{k % 77}," for k in range(60_000))), (2, "short")]
    assert found(alignment.token_alignment(frame(spark, rows), A, B)) == brute(rows, tools)[0]

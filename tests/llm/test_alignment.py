"""op12 against a plain version that holds whole documents, and the machine on odd texts."""

import collections
import hashlib

import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from helixframe.llm import alignment, queries

SF = "/root/testdata/sf0.001"
A, B = queries.TOKENIZERS
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def plain(texts):
    """A row of COLUMNS for each text, by the libraries' own encoders and whole lists of ends."""
    first, second, letters = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B), alignment.byte_letters()
    first.encode_special_tokens = True
    name = {i: n for n, i in first.get_vocab().items()}
    rows, count = [], collections.Counter()
    for t in texts:
        if not t:
            rows.append(None)
            continue
        a = first.encode(" " + t, add_special_tokens=False).ids
        b = second.encode(t)
        parts_a = [bytes(letters[c] for c in name[i]) for i in a]
        names_b = [second.id_to_piece(i) for i in b]
        parts_b = [bytes([int(n[3:5], 16)]) if second.is_byte(i) else n.replace("▁", " ").encode() for i, n in zip(b, names_b, strict=True)]
        if not b"".join(parts_a) == b"".join(parts_b) == (" " + t).encode():
            rows.append(None)
            continue
        ends = []
        for parts in (parts_a, parts_b):
            ends.append([sum(map(len, parts[:0]))])
            at = 0
            ends[-1] = [at := at + len(p) for p in parts]
        links = [(a[i], b[j]) for e in set(ends[0]) & set(ends[1]) for i in range(len(a)) if ends[0][i] == e for j in range(len(b)) if ends[1][j] == e] if len(a) < 500 else None
        where = [{e: i for i, e in enumerate(x)} for x in ends]
        links = links if links is not None else [(a[where[0][e]], b[where[1][e]]) for e in set(ends[0]) & set(ends[1])]
        groups, i, j = [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            u, v = where[0][e] + 1, where[1][e] + 1
            groups.append(",".join(map(str, a[i:u])) + "|" + ",".join(map(str, b[j:v])))
            i, j = u, v
        count.update(links)
        rows.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = collections.defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [(0, 0, 0, 0, 0, 0, "") if r is None else (*r[:3], len(r[3]), sum(count[x] == best[x[1]] for x in r[3]), sum(count[x] for x in r[3]), r[4]) for r in rows]


def test_query_against_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([d.doc_id for d in docs], plain([d.text for d in docs]), strict=True))
    got = queries.op12_token_alignment(spark, SF).collect()
    assert len(got) == len(docs) and {r.doc_id: tuple(r[c] for c in COLUMNS) for r in got} == want
    assert sum(r.n_groups for r in got) > 10_000


@pytest.mark.parametrize("window,span", [(1 << 15, 1 << 18), (200, 64)])
def test_odd_rows(spark, monkeypatch, window, span):
    """In small windows and spans too; executors in local mode fork after the change only if their daemon is new, so the
    machine and the encoders are run here without Spark."""
    monkeypatch.setattr(alignment, "WINDOW", window)
    monkeypatch.setattr(alignment, "SPAN", span)
    monkeypatch.setattr(alignment.spans, "__defaults__", (span,))
    texts = ["", "a", " ", "  two  spaces \t\n", "<|endoftext|> <s> </s> <unk> <0x41> ▁ x", "é ß ½ ﬁ ｆｕｌｌ ̀     ﻿", "日本語のテキスト 한국어 😀👩‍👩‍👧 \U0010ffff", "x" * 3000, " " * 700, "one two three four " * 200, "\x00\x01\x7f", "don't we'll I'd " * 40, "12345 67,890.12 " * 30]
    a, b = alignment.ByteVocabulary(A), alignment.PieceVocabulary(B)
    assert a.by_rank and b.cuttable
    machine = alignment.Sweep((len(a.parts), len(b.parts)), tuple(alignment.np.uint32 if len(v.parts) > 1 << 16 else alignment.np.uint16 for v in (a, b)))
    for text, want in zip(texts, plain(texts), strict=True):
        ids = [v.tokens([text], [text.encode()])[0] for v in (a, b)] if text else [None, None]
        if ids[0] is None or ids[1] is None:
            assert want[0] == 0
            continue
        events = collections.defaultdict(lambda: [None, None])
        for side, (x, v) in enumerate(zip(ids, (a, b), strict=True)):
            for offset, run in alignment.runs(x, v.lengths):
                events[offset][side] = run
        machine.start()
        sums = [machine.window(tuple(events[o])) for o in sorted(events)]
        links = sum(int(alignment._pairs(s[3], False)[1].sum()) for s in sums if s[3])
        assert (*(sum(s[i] for s in sums) for i in range(3)), links, machine.digest.hexdigest()) == (*want[:4], want[6])


def test_rows_and_tables(spark):
    long = "The end of the story. " * 40_000
    rows = [(1, "one two"), (1, "one two"), (None, "one two"), (None, None), (2, ""), (3, long), (4, "line\nline\n")]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, n_a int, row string")
    got = alignment.align(df, "doc_id", "text", A, B).collect()
    assert sorted((repr(r.doc_id), *(r[c] for c in COLUMNS)) for r in got) == sorted((repr(k), *x) for (k, _), x in zip(rows, plain([t for _, t in rows]), strict=True))
    assert alignment.align(df.where("false"), "doc_id", "text", A, B).count() == 0
    broken = df.limit(1).select("doc_id", F.expr("cast(X'61ff62' as string)").alias("text"))
    assert [tuple(r) for r in alignment.align(broken, "doc_id", "text", A, B).collect()] == [(rows[0][0], 0, 0, 0, 0, 0, 0, "")]


def test_pairs_are_bounded():
    a, b = alignment.ByteVocabulary(A), alignment.PieceVocabulary(B)
    assert 80_000 < alignment.most_pairs(a, b) < 1_000_000


def test_other_merges_use_the_library(tmp_path):
    import json

    file = json.load(open(A, encoding="utf-8"))
    file["model"]["merges"][:2] = file["model"]["merges"][1::-1]
    other = tmp_path / "other.json"
    other.write_text(json.dumps(file))
    v = alignment.ByteVocabulary(str(other))
    assert not v.by_rank and v.encode(["the end"])[0] == Tokenizer.from_file(str(other)).encode(" the end", add_special_tokens=False).ids

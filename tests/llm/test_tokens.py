import base64
import random

import numpy as np
import pytest
import tiktoken
from tokenizers import Tokenizer

from fathomline.llm import tokens as t


@pytest.fixture(scope="module")
def theirs():
    made = Tokenizer.from_file(t.VOCABULARY)
    made.encode_special_tokens = True
    return lambda text: made.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def by_ranks():
    path = t.VOCABULARY.replace(".json", ".tiktoken")
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    made = tiktoken.Encoding("own", pat_str=t.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: made.encode_ordinary(text or "")


def lists(texts):
    ids, counts = t.Encoder(t.VOCABULARY).encode(texts)
    ends = np.concatenate([[0], np.cumsum(counts)])
    return [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)]


def odd_texts():
    rng = random.Random(4)
    pools = [range(32, 127), range(0x20, 0x3000), range(0x4E00, 0x9FFF), [32, 10, 9, 13, 0x85, 0x1C, 0x200B, 0xA0, 0x2028, 0x3000], [97, 98], [0x1F600, 0xFEFF, 39]]
    made = ["".join(chr(rng.choice(rng.choice(pools))) for _ in range(rng.randrange(60))) for _ in range(800)]
    return made + [None, "", " ", "<|endoftext|>", "<|im_start|>user", "a" * 20_000, "_" * 20_000, "汉" * 3000, " " * 500, "ab" * 9000]


def test_equal_to_both_libraries(theirs, by_ranks):
    texts = odd_texts()
    got = lists(texts)
    for text, ids in zip(texts, got, strict=True):
        assert ids == theirs(text) == by_ranks(text)


def test_whole_documents(spark, sf_dir, theirs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r["ids"] for r in t.token_ids(docs).collect()}
    assert got == {k: theirs(v) for k, v in texts.items()}
    counts = {r["doc_id"]: r["n_tokens"] for r in t.token_counts(docs, ["doc_id"]).collect()}
    assert counts == {k: len(v) for k, v in got.items()}


def test_pieces_and_forgetting_change_nothing(monkeypatch, theirs):
    monkeypatch.setattr(t, "WORDS_AT_ONCE", 50)
    monkeypatch.setattr(t, "KNOWN_WORDS", 30)
    texts = ["some words here " * 40, None, "x", "more of them, again and again " * 10, "", "word " * 51]
    assert lists(texts) == [theirs(x) for x in texts]


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None), (3, "")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["ids"]) for r in t.token_ids(df).collect())
    assert [x[0] for x in got] == [1, 1, 2, 3] and got[0] == got[1] and got[2][1] == got[3][1] == []
    assert t.token_ids(df.limit(0)).count() == 0

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import tokens

PIECES = ["hello", " world", "'s", "'", "'ll", "!!!", "  ", "\n\n", "\t", "é", "東京タワー", "🎬", "👩‍🍳", "123456", " 7", "a" * 40, "…", " ", "x́", "<|endoftext|>", "-", "_", "Привет", "\x85"]


def noise(rng, n):
    return "".join(rng.choice(PIECES) for _ in range(n))


@pytest.mark.parametrize("seed", range(6))
def test_join_of_any_cut_equals_the_whole(seed):
    rng, enc = random.Random(seed), tokens.encoder()
    for _ in range(150):
        kind = rng.random()
        text = noise(rng, rng.randint(1, 80)) if kind < 0.5 else rng.choice(["ab", "é", "!'", " ", "東", "0123"]) * rng.randint(1, 200) if kind < 0.8 else "".join(rng.choice("abcdefgh'stl ") for _ in range(300))
        size = rng.randint(1, max(1, len(text)))
        parts = [enc.encode_ordinary(text[i : i + size]) for i in range(0, len(text), size)]
        assert tokens.join_tree(parts, enc) == enc.encode_ordinary(text)


def test_same_ids_as_the_other_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    other = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    rng = random.Random(9)
    texts = [noise(rng, 30) for _ in range(50)]
    assert [tokens.encode_text(t) for t in texts] == [e.ids for e in other.encode_batch(texts, add_special_tokens=False)]
    assert json.loads(open(public_tokenizers.path("byte_bpe_50k.json")).read())["model"]["type"] == "BPE"


def test_corpus_with_short_and_long_texts(spark):
    rng = random.Random(3)
    rows = [(i, noise(rng, rng.choice([0, 1, 5, 60, 200]))) for i in range(60)] + [(100, None), (101, ""), (102, "   "), (103, "z" * 3000), (103, "z" * 3000), (103, "z" * 2999), (104, "y"), (104, "y"), (None, "w" * 300)]
    df = spark.createDataFrame([(*r, [1], "k") for r in rows], "doc_id long, text string, ids array<int>, __part string")
    want = sorted((str(k), tokens.encode_text(t)) for k, t in rows)
    assert sorted((str(r.doc_id), list(r.ids)) for r in tokens.encode_corpus(df, "doc_id", "text", chunk=64).collect()) == want
    counts = sorted((str(r.doc_id), r.n_tokens) for r in tokens.encode_corpus(df, "doc_id", "text", chunk=64, count=True).collect())
    assert counts == sorted((k, len(i)) for k, i in want)
    assert tokens.encode_corpus(df.limit(0), "doc_id", "text").collect() == []


def test_round_trip_of_a_very_long_text_without_blanks(spark):
    text = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(200_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    ids = tokens.encode_corpus(df, "doc_id", "text").select(F.col("ids")).first()[0]
    assert tokens.encoder().decode(ids) == text and list(ids) == tokens.encode_text(text)

import hashlib
import random

import numpy as np
import pytest

from kinetide.llm import bpe


def truth(text):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.tokenizer_file())
    ids = tok.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def hard_texts():
    r = random.Random(5)
    bits = ["Word", "word###", "É***", "éa,", "…,", "ª.", "ŉ;", "x',", "日.", "end.)", "it's", "DON'T", "a.", "b,", ").", "x..", "1234.", "é", "É", "H̱", "ẞ", "İ", "Σς", "<|endoftext|>", "<|ENDOFTEXT|>.", " ", "　", "日本語", "\x1c", "\x85", "\n", "\t", "🙂", "n.", "٣,"]
    base = " ".join(r.choice(bits) + r.choice(["", " ", "\n", "x"]) for _ in range(2000))
    long = "".join(r.choice("abcdefghij") for _ in range(200_000))
    out = [None, "", " ", "one", base, base[:5000], "pre " + base, base[100:] + "post", base.replace(" ", ""), "k" + base.replace(" ", ""), "a" * 150_000, long, long[5:] + " x"]
    return out + ["".join(r.choice(bits) for _ in range(r.randrange(80))) for _ in range(60)]


def test_encode_equals_the_library(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(hard_texts())]
    rows += [rows[4], (None, "null id", "clash", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, digest int").repartition(3)
    got = bpe.encode(docs, bpe.tokenizer_file(), result=bpe.digests, schema="n_tokens long, ids_sha256 string, decoded_sha256 string").collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str((i, *truth(t))) for i, t, *_ in rows)


def test_empty_table_and_plain_ids(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(docs, bpe.tokenizer_file()).count() == 0


def test_query_on_whole_table(spark, sf_dir):
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.op2_bpe(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        assert got.pop(r["doc_id"]) == truth(r["text"])
    assert not got


def test_cuts_are_whole_characters_and_bounded():
    data = ("é🙂" * 90_000).encode()
    ends = bpe.cut(data)
    assert ends[-1] == len(data) and max(b - a for a, b in zip([0, *ends], ends, strict=False)) <= bpe.MOST + bpe.LEAST + 8
    assert all(data[e] & 0xC0 != 0x80 for e in ends[:-1])


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_files_that_keep_white_space_encode_whole_texts(name):
    import public_tokenizers

    enc = bpe.Encoder(public_tokenizers.path(name))
    assert not enc.by_word
    assert enc.encode([b"a b"]) == enc._plain([b"a b"])


def shared_texts():
    r = random.Random(8)
    words = ["the cat ", "sat down ", " on", "  a\n", "mat. ", "é🙂", "don't ", "1234 "]
    base = "".join(r.choice(words) for _ in range(6000))
    return [None, "", " ", base, base[:9000], "pre" + base, base[777:] + " post", base[5000:15_000], "x " + base[1:]]


def test_encode_with_a_file_that_keeps_white_space(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, texts = Tokenizer.from_file(path), shared_texts()
    got = bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2), path).collect()
    size = bpe.Encoder(path).dtype
    assert {r["key"]: bpe.np.frombuffer(r["ids"], size).tolist() for r in got} == {i: tok.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}


@pytest.mark.parametrize("share", [1, 3])
def test_parts_that_disagree_are_encoded_whole(spark, monkeypatch, share):
    texts = shared_texts()
    real = bpe.agreeing
    fails = lambda enc, parts, ids: [ok and len(p) % share > 0 for p, ok in zip(parts, real(enc, parts, ids), strict=True)]
    monkeypatch.setattr(bpe, "agreeing", fails)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = bpe.encode(docs, bpe.tokenizer_file(), result=bpe.digests, schema="n_tokens long, ids_sha256 string, decoded_sha256 string").collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str((i, *truth(t))) for i, t in enumerate(texts))


def test_words_met_once_are_not_encoded_again_and_pieces_change_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "FEW_BYTES", 0)
    enc = bpe.Encoder(bpe.tokenizer_file())
    texts = [(t or "").encode() for t in hard_texts()]
    plain = enc._plain(texts)
    assert enc.encode(texts) == plain
    calls = []
    for name in ("_whole", "_letters"):
        monkeypatch.setattr(enc, name, lambda *a, make=getattr(enc, name): calls.append(a) or make(*a))
    assert enc.encode(texts) == plain and not calls
    monkeypatch.setattr(bpe, "PIECE", 300)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 200)
    assert bpe.Encoder(bpe.tokenizer_file()).encode(texts) == plain


def test_words_of_one_slot_are_told_apart():
    table = bpe.WordTable(64)
    words = [np.array(x, np.uint64) for x in np.random.RandomState(1).randint(0, 2**40, (3, 64))]
    table.slots = lambda key: np.full(len(key[0]), 127)
    table.add(words, np.arange(64))
    assert table.find(words).tolist() == list(range(64))
    assert table.find([words[0], words[2], words[1]]).tolist() == [-1] * 64

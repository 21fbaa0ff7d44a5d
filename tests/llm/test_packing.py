"""Ids of the packing operator against the unmodified public tokenizer."""

import random
import zlib

import numpy as np

from reelquery.llm import packing
from reelquery.llm.queries import tokenizer_path

END = "<|endoftext|>"


def test_added_tokens_have_their_own_ids(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    rnd = random.Random(5)
    parts = [END, END, " ", "  ", "\n", "one", "two three", "<|endof", "text|>", "é", "'s", "7", "."]
    texts = ["one<|endoftext|>two", END, END * 3, f"a {END} b", f"a  {END}\n {END}", "<|endoftext|", "", "no token here"]
    texts += ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 12))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: [*plain.encode(t, add_special_tokens=False).ids, packing.END_ID] for i, t in enumerate(texts)}
    assert want[0] == [505, 50256, 11545, packing.END_ID]
    got = packing.pack(docs, tokenizer_path("byte_bpe_50k.json")).collect()
    assert {r.doc_id for r in got} == set(want)
    for r in got:
        ids = want[r.doc_id]
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())


def test_stretches_agree_with_the_whole_text():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    with open(path, "rb") as f:
        encode = packing.Encoder(f.read())
    rnd = random.Random(6)
    spaces = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "\u00a0", "\u2003", "\x0b", "\x0c", "\x1c", "\x85", "\u180e", "\u200b", "\u2028", "\u3000"]
    common_ = "the a word's 12 3.5 don't I'll -- ??? é Ünï 中文 \U0001f600 \u0301 𝟘".split(" ")
    for k in range(3000):
        some = spaces if k % 2 else spaces[:6]
        t = "".join(rnd.choice(some if rnd.random() < 0.5 else common_) if rnd.random() < 0.9 else chr(rnd.choice([rnd.randrange(32, 0x300), rnd.randrange(0xE000, 0x1F000)])) for _ in range(rnd.randint(0, 25)))
        assert np.frombuffer(encode(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_full_bins_hold_whole_documents():
    rnd = random.Random(7)
    packer = packing.Packer(0)
    sizes = [min(20000, int(rnd.lognormvariate(5.5, 1.2)) + 1) for _ in range(5000)]
    for i, n in enumerate(sizes):
        packer.add(i, np.full(n, i, "<u4").tobytes())
    packer.finish()
    bins, docs = {}, {}
    for doc, start, n, _, tokens, sequence, offset in packer.done:
        bins.setdefault(sequence, []).append((offset, n))
        docs.setdefault(doc, []).append((start, n))
        assert tokens == sizes[doc]
    for pieces, whole in [(p, None) for p in bins.values()] + [(p, sizes[i]) for i, p in docs.items()]:
        at = 0
        for start, n in sorted(pieces):
            assert start == at and n > 0
            at += n
        assert at == whole if whole else at <= 2048
    padding = sum(0 if (t := sum(n for _, n in b)) & (t - 1) == 0 else 2048 - t for b in bins.values())
    assert len(docs) == len(sizes) and padding == 0
    needed = sum(1 + (n - 1) // 2048 for n in sizes)  # pieces of documents longer than a sequence
    assert len(packer.done) < 1.2 * needed


def test_same_length_documents_fill_bins_of_their_class():
    packer = packing.Packer(0)
    for i in range(8):
        packer.add(i, np.full(512, i, "<u4").tobytes())
    assert len(packer.done) == 8 and packer.next == 2 and not packer.waiting


def test_single_words_agree_with_the_tokenizer():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    with open(path, "rb") as f:
        encode = packing.Encoder(f.read())
    assert encode.merge
    rnd = random.Random(8)
    letters = [chr(c) for c in (*range(65, 91), *range(97, 123), *range(0xC0, 0x100)) if chr(c).isalpha()]
    for _ in range(5000):
        word = rnd.choice(["", " "]) + "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 24)))
        assert np.frombuffer(encode(word), "<u4").tolist() == plain.encode(word, add_special_tokens=False).ids, word
    german = "Über größere Straßen führt Ärger; ça va déjà, señor ¿qué? naïve Æther ÿ"
    assert np.frombuffer(encode(german), "<u4").tolist() == plain.encode(german, add_special_tokens=False).ids

import hashlib
import io
import random
import struct
import zlib

import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from spanloom.llm import byte_bpe, pieces, sorted_tokens

from .odd import DOCS, LONG, documents

RANKS, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
RNG = random.Random(4)
HARD = ["", "a" * 5000, "   \n\n  x", " " * 700, "é" * 400, "🙂‍🙂 ñ 中文字符" * 20, "".join(chr(RNG.randrange(32, 0x2FFF)) for _ in range(2000)), "abab" * 500, "0123456789" * 200, "<|endoftext|> x", "ab.,, cd., e.́ x'.s don't, 3.4, \x1c. \xa0,", "İSTANBUL ΣΑΣ É É", "a|b | c ||"]


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})


def test_transducer_is_the_merges(encoding):
    own = byte_bpe.codec(RANKS, public_tokenizers.PATTERN)
    for text in [*HARD, LONG[:20_000]]:
        (ids,) = own.encode([text])
        assert ids.tolist() == encoding.encode_ordinary(text)
        assert b"".join(raw for raw, _, _ in own.decode(ids, 3)) == text.encode()
        assert "".join(part for _, part, _ in own.decode(ids, 3)) == text
    assert [ids.tolist() for ids in own.encode([*HARD, LONG], most=500)] == [ids.tolist() for ids in own.encode([*HARD, LONG])] == encoding.encode_ordinary_batch([*HARD, LONG])


def test_tables_of_bounded_size(encoding):
    small = byte_bpe.Transducer(byte_bpe.load_ranks(RANKS), most_states=50)
    for text in ("international" * 30, " unbelievable", "zzzzqqqq" * 40, "international" * 30, " unbelievable"):
        assert small.run(text.encode()) == encoding._core_bpe.encode_single_piece(text.encode())
        assert len(small.states) <= 50


def test_cuts_are_the_patterns():
    cutter = pieces.Cutter(public_tokenizers.PATTERN)
    assert cutter.kinds is not None
    plain = pieces.Cutter(f"(?:{public_tokenizers.PATTERN})")
    assert plain.kinds is None
    rng, signs = random.Random(7), "'`'`strevmld aZé1²½٣ \t\n\x0b\x1c\x1d\x85\xa0\u2003\u3000\u200b.,-_中🙂́ʼ"
    texts = ["".join(rng.choices(signs, k=rng.randrange(0, 14))) for _ in range(20_000)]
    for some in (texts, [], [""], ["", ""], [" "], ["'s"], ["a'", "s"], ["x ", " y"]):
        (a, at), (b, bt) = cutter.split(some), plain.split(some)
        assert a.to_pylist() == b.to_pylist() and at.tolist() == bt.tolist()
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    assert cutter.split([every])[0].to_pylist() == plain.split([every])[0].to_pylist()


def test_parts_are_the_text():
    text = "one two  three\n four, five " * 50
    assert "".join(pieces.parts(text, 40)) == text and len(list(pieces.parts(text, 40))) > 20 and list(pieces.parts("", 4)) == [""]


def test_broken_bytes_are_told():
    decoder = byte_bpe.StreamDecoder([b"a", b"\xe2\x82", b"\xac", b"\xff"])
    assert decoder.feed([0, 1]) == (b"a\xe2\x82", "a") and decoder.feed([2])[1] == "€" and decoder.valid
    decoder.feed([3], True)
    assert not decoder.valid


def test_byte_bpe_rows(spark, encoding):
    got = byte_bpe.encode_documents(documents(spark), RANKS, public_tokenizers.PATTERN).collect()
    assert len(got) == len(DOCS)
    texts = {d: t or "" for d, t, *_ in DOCS}
    for r in got:
        ids = encoding.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() and r.valid_utf8
    assert byte_bpe.encode_documents(documents(spark).limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_word_memo_is_the_library():
    library = Tokenizer.from_file(WORDS)
    library.encode_special_tokens = True
    own = sorted_tokens.Encoder(WORDS, most_words=20)
    for text in [*HARD, LONG[:20_000], *HARD]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode([text])[0].tolist() == ids
    assert list(map(list, own.encode(HARD))) == [list(own.encode([t])[0]) for t in HARD] == list(map(list, own.encode(HARD, most=300)))
    rng, signs = random.Random(9), "'`'`stre aZéÉ1²\t\n\x1c\x85\xa0\u2003.,-|<_中🙂̱́HΣ"
    texts = ["".join(rng.choices(signs, k=rng.randrange(0, 14))) for _ in range(5_000)]
    assert list(map(list, own.encode(texts))) == [found.ids for found in library.encode_batch(texts, add_special_tokens=False)]


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), sorted_tokens.Encoder(path, split_special=False)
    assert own.memo is None
    for text in [*HARD, *SPECIAL]:
        assert own.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_token_rows(spark):
    library = Tokenizer.from_file(WORDS)
    start = 0
    want = []
    for doc_id, text, *_ in sorted(DOCS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    got = sorted(map(tuple, sorted_tokens.tokenised(documents(spark), WORDS).collect()), key=lambda r: r[1])
    assert got == want
    assert sorted_tokens.tokenised(documents(spark).limit(0), WORDS).count() == 0


SPECIAL = ["foo <|endoftext|> x<|startoftext|>", "<|endoftext|>", "A<|endoftext|>, B <|ENDOFTEXT|>", "<|EndOfText|> only", "naïve 中<|startoftext|><|startoftext|>é", "<|endoftext| >", "<| endoftext|>", "x <|endoftext|\n>", "a <|endoftext|>.\tb"]


def test_added_tokens_by_the_librarys_default():
    library = Tokenizer.from_file(WORDS)
    own = sorted_tokens.Encoder(WORDS, most_words=20, split_special=False)
    assert library.encode(SPECIAL[0], add_special_tokens=False).ids == [23435, 49407, 343, 49406]
    texts = [*HARD, *SPECIAL, " ".join(SPECIAL), LONG[:5000], *SPECIAL]
    want = []
    for text in texts:
        want.append(library.encode(text, add_special_tokens=False).ids)
        assert own.encode([text])[0].tolist() == want[-1]
    assert list(map(list, own.encode(texts))) == want


def test_token_rows_with_added_tokens(spark):
    library, docs, start, want = Tokenizer.from_file(WORDS), [*enumerate(SPECIAL), (100, "plain words"), (101, None)], 0, []
    for doc_id, text in docs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, sorted_tokens.tokenised(rows, WORDS).collect())) == want


@pytest.mark.parametrize("wide", [False, True])
def test_shard_lookup(wide):
    out, width = io.BytesIO(), 4 if wide else 2
    writer = sorted_tokens.Writer(out, wide, block_bytes=200)
    docs = {i * 7 - 300: [(i * k) % 60_000 for k in range(i % 9)] for i in range(300)}
    for doc_id, ids in sorted(docs.items()):
        writer.add(sorted_tokens.key_of(doc_id), struct.pack(f"<{len(ids)}{'I' if width == 4 else 'H'}", *ids))
    assert writer.close() == (300, sum(map(len, docs.values())))
    shard = sorted_tokens.Shard(io.BytesIO(out.getvalue()))
    assert len(shard.blocks) > 5 and {d: ids.tolist() for d, ids in shard.scan()} == docs
    assert all(shard.get(d) == ids for d, ids in docs.items())
    assert all(shard.get(d) is None for d in range(-1000, 3000) if d not in docs)

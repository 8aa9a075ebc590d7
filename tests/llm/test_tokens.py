"""Tokenizers against their libraries, and the token files' format."""

from __future__ import annotations

import hashlib
import random
import zlib

import fixtures as fx
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import zstandard
from tokenizers import Tokenizer

from quillrank.llm.prefix_bpe import encode_documents, encoder
from quillrank.llm.token_files import TokenFile, TokenFileWriter, read_token_files, text_encoder, write_token_files

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")


def odd_texts():
    r = random.Random(9)
    letters = " abcdefghijklmnopqrstuvwxyzTheQU  \n\t0123456789.,-éñü漢字🙂▁\x00\x1c  '<>|"
    out = ["".join(r.choice(letters) for _ in range(r.randrange(80))) for _ in range(3000)]
    out += ["".join(r.choice(["the", "ing", "re", " ", "tion", "an", "in", "s", "ers", "!!!", "==", "----", "  ", "\n"]) for _ in range(r.randrange(1, 60))) for _ in range(3000)]
    return out + [" " * k for k in range(40)] + ["", "</s> <s> <unk> <0x0A>", "<|endoftext|> a<|endoftext|>b", "a \n b", "x" * 30000, "a " * 20000]


def test_prefix_encoding_is_the_library_s():
    own, library = encoder(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for x in odd_texts():
        ids = library.encode(x, add_bos=True, add_eos=True)
        got = [own.bos, *np.frombuffer(own.encode(x), "<u4").tolist(), own.eos]
        assert got == ids, x
        assert own.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids), x


def test_compatibility_is_what_encoding_says():
    own, r = encoder(PIECES), random.Random(1)
    ids = [i for i in own.ids.values() if set(own.pieces[i]) != {"▁"}]
    for _ in range(3000):
        a, b = r.choice(ids), r.choice(ids)
        if own.merged(own.pieces[a])[0] == [own.pieces[a]] and own.merged(own.pieces[b])[0] == [own.pieces[b]]:
            assert own.compatible(a, b) == (own.merged(own.pieces[a] + own.pieces[b])[0] == [own.pieces[a], own.pieces[b]])


def test_decoding_of_any_ids():
    own, library, r = encoder(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES), random.Random(2)
    for _ in range(300):
        ids = [r.randrange(3, 32000) for _ in range(r.randrange(1, 8))]
        assert own.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids)


def test_encoded_documents(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = []
    for row in fx.rows():
        ids = library.encode(row[1] or "", add_bos=True, add_eos=True)
        want.append((row[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    found = encode_documents(fx.frame(spark), PIECES, with_ids=False)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    assert encode_documents(fx.frame(spark, []), PIECES).count() == 0


def test_encoding_is_the_library_s():
    library, own = Tokenizer.from_file(BYTES), text_encoder(BYTES)
    texts = odd_texts()
    for c in map(chr, range(0x260)):
        texts += [f"a{c}b", f" {c} ", f"{c}{c}a", f"\n{c}\n x", f"9{c}'s{c}  {c}", c * 3]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == want.ids, text
    assert own.quick is not None
    own.quick, kept = None, own.quick
    assert all(np.frombuffer(own.encode(x), "<u4").tolist() == library.encode(x, add_special_tokens=False).ids for x in texts[:50])
    own.quick = kept


def test_file_format(tmp_path):
    path = str(tmp_path / "x.zst")
    docs = [(i, np.arange(i * 7 % 50, dtype="<u4").tobytes()) for i in range(100)] + [(None, b""), (5, b"\1\0\0\0")]
    out = TokenFileWriter(path, frame_bytes=300)
    for d in docs:
        out.add(*d)
    out.close()
    file = TokenFile(path)
    assert [(i, x) for i, _, x in file.documents()] == docs and len(file.frames) > 10
    assert [x.tolist() for x in file.read(5)] == [list(range(35)), [1]] and file.read(1000) == []
    raw = (tmp_path / "x.zst").read_bytes()
    whole = zstandard.ZstdDecompressor().decompressobj
    at, body = 0, b""
    for n, _, _ in file.frames:  # every frame stands alone, with its own content checksum
        body += whole().decompress(raw[at : at + n])
        assert zstandard.get_frame_parameters(raw[at : at + n]).has_checksum
        at += n
    assert body == b"".join(x for _, x in docs)
    assert raw[-4:] == (0x8F92EAB1).to_bytes(4, "little") and raw[-5] == 0x80
    broken = bytearray(raw)
    broken[int(file.frames[0][0]) - 6] ^= 1
    (tmp_path / "y.zst").write_bytes(bytes(broken))
    with pytest.raises((ValueError, zstandard.ZstdError)):
        TokenFile(str(tmp_path / "y.zst")).frame(0)


def test_token_files(spark, tmp_path):
    library = Tokenizer.from_file(BYTES)
    data = [r for r in fx.rows() if r[0] is not None]
    files = write_token_files(fx.frame(spark, data), BYTES, folder=str(tmp_path / "t"), end_id=0)
    found = read_token_files(files).orderBy("start").collect()
    assert [r.doc_id for r in found] == sorted(r[0] for r in data)
    at = 0
    for r in found:
        assert r.start == at
        at += r.n_tokens
    want = []
    for row in data:
        ids = np.array([*library.encode(row[1] or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((row[0], len(ids), zlib.crc32(ids.tobytes())))
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == sorted(want)
    with_null = read_token_files(write_token_files(fx.frame(spark), BYTES)).orderBy("start").collect()
    assert [r.doc_id for r in with_null][:3] == [None] * 3
    assert read_token_files(write_token_files(fx.frame(spark, []), BYTES)).count() == 0

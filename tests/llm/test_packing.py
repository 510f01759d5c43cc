"""Packing: exact round trip, full cover, little padding."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from partita.llm import packing
from partita.llm.queries import QUERIES

DIR = "/root/testdata/sf0.001"


def test_layout_covers_each_item_once_with_little_padding():
    draw = random.Random(1)
    for n in (0, 1, 5, 3000):
        lengths = [min(2047, 1 + int(draw.expovariate(1 / 500))) for _ in range(n)]
        sequences = packing.layout(lengths)
        pieces = sorted(p for s in sequences for p in s)
        at = dict.fromkeys(range(n), 0)
        for i, start, k in pieces:
            assert start == at[i] and k > 0
            at[i] += k
        assert at == dict(enumerate(lengths))
        sums = [sum(p[2] for p in s) for s in sequences]
        assert max(sums, default=0) <= 2048
        waste = sum(0 if s & (s - 1) == 0 else 2048 - s for s in sums)
        assert waste <= 0.02 * sum(sums)


def test_query_round_trip(spark, tmp_path):
    given = spark.read.parquet(f"{DIR}/documents.parquet")
    docs = [tuple(d) for d in given.collect()] + [(10**6 + i, t, None, None, 0) for i, t in enumerate([None, "", "<|endoftext|>a b　É é don't İΣΑΣ \x1c x\u0085y", "word " * 9000])]
    spark.createDataFrame(docs, given.schema).write.parquet(f"{tmp_path}/documents.parquet")
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d[0]: np.array([*tok.encode(d[1] or "", add_special_tokens=False).ids, 1], dtype="<u4") for d in docs}
    got = QUERIES["op2_packing"](spark, str(tmp_path)).collect()
    at, seq = dict.fromkeys(ids, 0), {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        at[r.doc_id] += r.length
        seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert at == {k: len(v) for k, v in ids.items()}
    for pieces in seq.values():
        end = 0
        for offset, n in sorted(pieces):
            assert offset == end
            end += n
        assert end <= 2048


def test_new_pieces_are_encoded_as_lines(monkeypatch):
    """The ids of the plain tokenizer, and plain pieces are not given to it one by one."""
    import tokenizers

    alone = []

    class Counted:
        def __init__(self, tok):
            self.encode, self.batch = tok.encode, tok.encode_batch_fast

        @staticmethod
        def from_file(file):
            return Counted(Tokenizer.from_file(file))

        def encode_batch_fast(self, some, **more):
            alone.extend(some)
            return self.batch(some, **more)

    file, draw = public_tokenizers.path("word_bpe_49k.json"), random.Random(2)
    tok = Tokenizer.from_file(file)
    monkeypatch.setattr(tokenizers, "Tokenizer", Counted)
    encode = packing.encoder.__wrapped__(file)
    plain = " ".join("".join(draw.choice("abcdefgéÀ1?") for _ in range(draw.randint(1, 12))) for _ in range(3000))
    assert encode(plain).tolist() == tok.encode(plain, add_special_tokens=False).ids and not alone
    odd = ["<|endoftext|>a < |b <| endoftext|>", "a\tb \t ½ don't İx 'S", "́ é  x \x1c \x85 漢字 don't! a\tb \t c", "x" * 3000 + " y​z ﬁ", "İ a\tb \t"]
    for text in odd + ["".join(draw.choice("ab \t\n'séİ<|>½²漢 ­ſ") for _ in range(400)) for _ in range(50)]:
        assert encode(text).tolist() == tok.encode(text, add_special_tokens=False).ids

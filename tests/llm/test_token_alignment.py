import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from groundwork.llm import token_alignment
from groundwork.llm.pair_codes import Aligner, byte_characters
from groundwork.llm.token_alignment import Stripes, align

TEXTS = [
    None, "", " ", "\n", "\t", "a", "the cat  sat\n on the mat ", "don't\tstop", "x\n\ny", " lead", "trail ", "é à ü", "<|endoftext|> a </s> <s> <0x0A> <unk>", "a▁b", "▁",
    "a\x1cb c", "nb sp ace", "日本語 テスト 😀", "a" * 3000, "word " * 2000, "1 22 333\n4444", "a \n b", "a\n b", "'tis 's\n's don't", "a\r\nb", "ﬁ ① ½", "a\x00b", "é", "The same. The same.\nThe same.", "The same.",
]
NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def plain():
    """Figures of (doc_id, text) rows, worked out with the libraries over whole texts, token by token."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    stand, names = byte_characters(), {i: t for t, i in a.get_vocab().items()}

    def spans(parts):
        at = 0
        for part in parts:
            yield at, at + len(part)
            at += len(part)

    def one(text):
        if not text:
            return None
        ia, ib, whole = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text), f" {text}".encode()
        pa, pb = [bytes(stand[c] for c in names[i]) for i in ia], [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if b"".join(pa) != whole or b"".join(pb) != whole:
            return None
        sa, sb, links, k = list(spans(pa)), list(spans(pb)), [], 0
        for i, (low, high) in enumerate(sa):
            while k and sb[k - 1][1] > low:
                k -= 1
            while sb[k][1] <= low:
                k += 1
            for j in range(k, len(sb)):
                if sb[j][0] >= high:
                    break
                links.append((ia[i], ib[j]))
        ends = sorted({y for _, y in sa} & {y for _, y in sb})
        groups, i, j = [], 0, 0
        for end in ends:
            left, right = [], []
            while i < len(sa) and sa[i][1] <= end:
                left.append(str(ia[i]))
                i += 1
            while j < len(sb) and sb[j][1] <= end:
                right.append(str(ib[j]))
                j += 1
            groups.append(f"{','.join(left)}|{','.join(right)}")
        return len(ia), len(ib), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()

    def run(rows):
        known = [(i, one(t)) for i, t in rows]
        held = Counter(pair for _, x in known if x for pair in set(x[3]))
        best = {}
        for (left, _), n in held.items():
            best[left] = max(best.get(left, 0), n)
        out = []
        for i, x in known:
            links = x[3] if x else []
            counts = [held[p] for p in links]
            scored = (sum(n == best[p[0]] for p, n in zip(links, counts, strict=True)), sum(counts))
            out.append((i, *((x[0], x[1], x[2], len(links)) if x else (0, 0, 0, 0)), *scored, x[4] if x else ""))
        return out

    return run


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*NAMES).collect()), key=str)


@pytest.mark.parametrize("parts", (1, 5))
def test_odd_texts(spark, plain, parts):
    rng, words = random.Random(9), ["the", "of", "tion", "é", "\n", " ", "  ", "x1", "...", "ß", "</s>", "Weltkrieg"]
    rows = [*enumerate(TEXTS), (3, "again"), (None, "null id"), *((100 + k, "".join(rng.choices(words, k=30))) for k in range(200))]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, stripe string, batch int").repartition(parts)
    assert rows_of(align(df)) == sorted(plain(rows), key=str)


def test_many_parts_of_a_stripe(spark, plain, monkeypatch):
    """Small batches, small shares: stripes go to many tasks, blocks go out in many rows."""
    for name, value in (("SHARE", 64), ("ROWS", 3), ("CELLS", 5), ("BLOCK_BYTES", 400 << 20)):
        monkeypatch.setattr(token_alignment, name, value)
    rows = [(k, f"the cat sat on the {'mat' if k % 3 else 'hat'} {k}") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(align(df)) == sorted(plain(rows), key=str)


def test_documents(spark, plain):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert rows_of(align(docs)) == sorted(plain([tuple(r) for r in docs.select("doc_id", "text").collect()]), key=str)


def test_empty(spark):
    assert align(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_long_texts_go_in_pieces(plain, monkeypatch):
    from groundwork.llm import pair_codes

    text = "".join(random.Random(4).choices(["the ", "cat", "  ", "\n", "é ", "b"], k=3000)).strip()
    aligner = Aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    assert aligner.cut
    whole = next(iter(aligner.documents([text])))
    monkeypatch.setattr(pair_codes, "PIECE", 50)
    monkeypatch.setattr(pair_codes, "GENERATION", 2000)
    for _ in range(3):
        parts = next(iter(aligner.documents([text])))
        assert whole[1:] == parts[1:] and (whole[0] == parts[0]).all()
    assert (0, *whole[1:4], len(whole[0]), whole[4].hex()) == (*(r := plain([(0, text)])[0])[:5], r[7])


def test_stripes_have_every_code_once():
    stripes = Stripes(50257, 32000)
    codes = np.array([0, 31999, 32000, 50256 * 32000 + 31999, 123 * 32000 + 7], np.uint32)
    keys = stripes.keys(codes)
    assert len(set(keys.tolist())) == 5 and stripes.cells * 8 <= 100 << 20
    assert (keys // stripes.cells).max() < stripes.n

import hashlib
import random
import struct

import pytest

from recurq.llm import queries, sentence_pieces
from recurq.llm.queries import _piece_bpe
from recurq.llm.sentence_pieces import Encoder, unpacked


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=_piece_bpe())


def odd_texts():
    rng = random.Random(1)
    pool = "ab Z'9 ½²\t\n\r\x0b\x0c\x1c\x1f\x85\xa0 éß中😀_-!؟́ͅ▁\0</s><0x0A>the"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 80))) for _ in range(800)]
    return [*texts, "", " ", "  ", "   a  b ", "▁", "▁▁x", "<s></s><unk>", "ab " * 50 + " ", "a" * 5000, " " * 3000, "the" * 400, "中" * 700]


def same(library, texts, pairs):
    for text, (ids, decoded) in zip(texts, pairs, strict=True):
        want = library.encode(text, add_bos=True, add_eos=True)
        assert unpacked(ids) == want, text
        assert decoded.decode() == library.decode(want), text


def test_odd_texts_equal_the_library_in_arrow_batches(library):
    texts = odd_texts()
    encoder = Encoder(_piece_bpe())
    for k in range(0, len(texts), 90):
        same(library, texts[k : k + 90], encoder.encode_decode(texts[k : k + 90]))


def test_a_full_memory_and_words_beyond_arrays_change_nothing(library):
    texts = [" ".join(odd_texts()[k::40]) for k in range(40)]
    encoder = Encoder(_piece_bpe(), memo_entries=50, memo_chars=8, array_chars=12)
    for text in texts:
        same(library, [text, "the end", text], encoder.encode_decode([text, "the end", text]))
        assert len(encoder._words) < 5000 and max(map(len, encoder._words)) <= 8


def test_a_difference_from_the_library_is_an_error():
    encoder = Encoder(_piece_bpe())
    ids, decoded = encoder.encode_decode(["a text"])[0]
    encoder.check("a text", ids, decoded)
    with pytest.raises(ValueError, match="another way"):
        encoder.check("a text", ids + encoder.end, decoded)


def test_query_of_whole_documents(spark, sf_dir, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op11_sentence_pieces(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        ids = library.encode(docs[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_odd_tables(spark, library):
    rows = [(None, None, 1), (3, "", 2), (3, "", 2), (4, "word " * 60_000, 3), (5, "x y", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted(sentence_pieces.encoded(df, _piece_bpe, block_bytes=100).collect(), key=lambda r: (r.doc_id is not None, r.doc_id))
    assert [(r.doc_id, unpacked(r.ids), r.decoded) for r in got] == [(i, library.encode(t or "", add_bos=True, add_eos=True), t or "") for i, t, _ in rows]
    assert sentence_pieces.encoded(df.limit(0), _piece_bpe).collect() == []
